"""Sequences and trajectories derived from the star-schema tables, all totally ordered and integer-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_id():
    return (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("long")


def event_sequences(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """(id, entity, seq): a user's, or a user's week's, event types in time order."""
    e = table(spark, sf_dir, "events").select((week_id() if weekly else F.col("user_id")).alias("id"), F.col("user_id").alias("entity"), F.struct("ts", "event_id", "event_type").alias("e"))
    return e.groupBy("id", "entity").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["event_type"]).alias("seq"))


def supplier_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, seq): an order's suppliers in line order, under its customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("e"))
    seq = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["l_suppkey"].cast("string")).alias("seq"))
    return seq.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity")), "id").select("id", "entity", "seq")


def trip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, ts, pos, lon, lat): a weekly event sequence walked over the map, with planted jumps."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), week_id().alias("id"), "ts", "event_type")
    still = F.col("event_id") % 13 == 0
    dx = F.when(still, 0).when(F.col("event_type").isin("view", "purchase"), 1).when(F.col("event_type") == "signup", -1).otherwise(0)
    dy = F.when(still, 0).when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    w = W.partitionBy("id").orderBy("ts", "event_id")
    jump = F.when(F.col("event_id") % 97 == 0, 0.05).otherwise(0.0) + F.when(F.col("event_id") % 101 == 0, 0.3).otherwise(0.0)
    return e.select(
        "id", "entity", "ts", F.row_number().over(w).alias("pos"), (F.sum(dx).over(w) * 0.0025 + F.lit(-8.62) + jump).alias("lon"), (F.sum(dy).over(w) * 0.002 + F.lit(41.15)).alias("lat")
    )


def long_trips(spark: SparkSession, sf_dir: str, stretch: float = 2.5) -> DataFrame:
    """(id, entity, start_ts, points): a user's whole history walked over the map in longer steps and without jumps, each walk
    driven twice, so that sub-routes of every length band repeat."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), "ts", "event_type")
    still = F.col("event_id") % 13 == 0
    dx = F.when(still, 0).when(F.col("event_type").isin("view", "purchase"), 1).when(F.col("event_type") == "signup", -1).otherwise(0)
    dy = F.when(still, 0).when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    w = W.partitionBy("entity").orderBy("ts", "event_id")
    at = e.select("entity", "ts", F.row_number().over(w).alias("pos"), (F.sum(dx).over(w) * (0.0025 * stretch) + F.lit(-8.62)).alias("lon"), (F.sum(dy).over(w) * (0.002 * stretch) + F.lit(41.15)).alias("lat"))
    p = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat")))
    one = at.groupBy("entity").agg(F.min("ts").alias("start_ts"), F.transform(p, lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))
    return one.select(F.explode(F.array(F.col("entity"), F.col("entity") + 1_000_000)).alias("id"), "entity", "start_ts", "points")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, start_ts, points): one row a trip, points in order."""
    p = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat")))
    return trip_points(spark, sf_dir).groupBy("id", "entity").agg(F.min("ts").alias("start_ts"), F.transform(p, lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))


def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, seq): a document's lower-cased words, whatever letters they are written in."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("entity"), F.expr("filter(split(lower(text), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')").alias("seq"))


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips as raw rows with JSON polylines, beside a few rows that each break a rule."""
    t = trips(spark, sf_dir)
    line = F.concat(F.lit("["), F.array_join(F.transform("points", lambda p: F.concat(F.lit("["), F.round(p["lon"], 6).cast("string"), F.lit(","), F.round(p["lat"], 6).cast("string"), F.lit("]"))), ","), F.lit("]"))
    call = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int"))
    good = t.select(
        F.col("id").cast("string").alias("TRIP_ID"), call.alias("CALL_TYPE"), F.col("entity").alias("TAXI_ID"), F.unix_timestamp(F.col("start_ts").cast("timestamp")).alias("TIMESTAMP"), F.when(F.col("id") % 29 == 0, "True").otherwise("False").alias("MISSING_DATA"), line.alias("POLYLINE")
    )
    bad = [("x1", "False", "[]"), ("x2", "False", None), ("x3", "False", "[[oops"), ("x4", "False", "[[-8.62,41.15]]"), ("x5", "False", "[[-8.62,41.15],[-9.9,41.15]]"), ("x6", "True", "[[-8.62,41.15],[-8.61,41.15]]"), ("x7", "False", "[[-8.62,41.15],[-8.61,41.15]]"), ("x7", "False", "[[-8.62,41.15],[-8.61,41.15]]")]
    rows = spark.createDataFrame([(i, "A", 1, 1372636858, m, p) for i, m, p in bad], "TRIP_ID string, CALL_TYPE string, TAXI_ID long, TIMESTAMP long, MISSING_DATA string, POLYLINE string")
    return good.unionByName(rows)
