"""Cleaning rules, trip features, summaries, percentile fences and anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions.geo import haversine_km, in_box, path_km


def parse(raw: DataFrame) -> DataFrame:
    """points, n_points, duration and end points from the JSON polyline; malformed JSON parses to NULL."""
    pts = F.transform(F.from_json("POLYLINE", "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    df = raw.withColumn("points", pts).withColumn("n_points", F.coalesce(F.size("points"), F.lit(0)))
    first, last = F.get("points", F.lit(0)), F.try_element_at("points", F.lit(-1))
    return df.select(
        "*",
        F.when(F.col("n_points") > 0, (F.col("n_points") - 1) * C.GPS_INTERVAL_SEC).alias("duration_sec"),
        first["lon"].alias("start_lon"), first["lat"].alias("start_lat"), last["lon"].alias("end_lon"), last["lat"].alias("end_lat"),
        F.timestamp_seconds("TIMESTAMP").alias("start_time"),
    )


def on_map() -> Column:
    """Both end points lie in the box; NULL for a trip without points."""
    return in_box(F.col("start_lon"), F.col("start_lat"), C.LON_BOX, C.LAT_BOX) & in_box(F.col("end_lon"), F.col("end_lat"), C.LON_BOX, C.LAT_BOX)


def flags(parsed: DataFrame) -> DataFrame:
    complete, n = F.col("MISSING_DATA") == "False", F.col("n_points")
    enough, few = n >= C.MIN_POINTS, n <= C.MAX_POINTS
    valid = F.coalesce(complete & enough & few & on_map(), F.lit(False))
    return parsed.select("*", (~complete).alias("is_missing"), (~enough).alias("too_few"), (~few).alias("too_many"), (~on_map()).alias("off_map"), valid.alias("is_valid"))


def rejections(flagged: DataFrame) -> DataFrame:
    """One row: how many trips break each rule (one may break several), in a single pass."""
    rules = {"missing": "is_missing", "too_few": "too_few", "too_many": "too_many", "off_map": "off_map", "valid": "is_valid"}
    return flagged.agg(F.count("*").alias("total"), *[F.count_if(F.col(c)).alias(n) for n, c in rules.items()])


def deduplicated(trips: DataFrame, id_col: str = "TRIP_ID") -> DataFrame:
    """One row an id: the one that sorts first, so that the survivor is the same in every run."""
    others = [c for c in trips.columns if c != id_col]
    w = W.partitionBy(id_col).orderBy(*[F.col(c).asc_nulls_last() for c in others if not trips.schema[c].dataType.simpleString().startswith(("array", "map"))])
    return trips.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def clean(raw: DataFrame) -> DataFrame:
    good = flags(parse(raw)).filter("is_valid").drop("is_missing", "too_few", "too_many", "off_map", "is_valid")
    return deduplicated(good)


def features(trips: DataFrame) -> DataFrame:
    """Distances, speeds, extent and anomaly flags from points: array of struct(lon, lat).  Fewer than two points: NULLs."""
    n = F.size("points")
    pairs = F.zip_with(F.slice("points", F.lit(1), n - 1), F.slice("points", F.lit(2), n - 1), lambda a, b: haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]))
    a, z = F.get("points", F.lit(0)), F.try_element_at("points", F.lit(-1))
    lon, lat = F.transform("points", lambda p: p["lon"]), F.transform("points", lambda p: p["lat"])
    two = n >= 2
    df = trips.select(
        "*",
        n.alias("n"),
        ((n - 1) * C.GPS_INTERVAL_SEC).alias("seconds"),
        F.when(two, path_km(F.col("points"))).alias("total_distance_km"),
        F.when(two, haversine_km(a["lon"], a["lat"], z["lon"], z["lat"])).alias("straight_line_km"),
        F.when(two, F.array_max(pairs) / (C.GPS_INTERVAL_SEC / 3600.0)).alias("max_seg_speed_kmh"),
        F.when(two, F.array_min(lon)).alias("min_lon"), F.when(two, F.array_max(lon)).alias("max_lon"),
        F.when(two, F.array_min(lat)).alias("min_lat"), F.when(two, F.array_max(lat)).alias("max_lat"),
    )
    km, secs = F.col("total_distance_km"), F.col("seconds")
    df = df.select("*", F.when(secs > 0, km / (secs / 3600.0)).alias("avg_speed_kmh"), F.when(F.col("straight_line_km") > 0.05, km / F.col("straight_line_km")).alias("sinuosity"))
    m = C.METRO_MARGIN_DEG
    inside = in_box(F.col("min_lon"), F.col("min_lat"), C.LON_BOX, C.LAT_BOX, m) & in_box(F.col("max_lon"), F.col("max_lat"), C.LON_BOX, C.LAT_BOX, m)
    df = df.select(
        "*",
        (F.col("max_seg_speed_kmh") > C.MAX_SPEED_KMH).alias("is_teleport"),
        ((secs > 120) & (km < 0.1)).alias("is_idle"),
        (F.col("avg_speed_kmh") > 120).alias("is_too_fast"),
        (km < 0.05).alias("is_too_short"),
        (~inside).alias("is_offgrid"),
    )
    return df.withColumn("is_anomalous", F.col("is_teleport") | F.col("is_idle") | F.col("is_too_fast") | F.col("is_too_short") | F.col("is_offgrid"))


def profile(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95), exact: bool = True) -> DataFrame:
    """A row a column: count, mean, sample deviation, minimum, quantiles, maximum.  One pass over all columns.

    Exact quantiles keep each distinct value of a column in one task: for bounded input.  exact=False takes Greenwald-Khanna
    ones, off by at most one rank in 10,000, from summaries that merge.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(*map(F.lit, quantiles))) if exact else F.percentile_approx("v", list(quantiles), 10_000)
    out = long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("stddev"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
    return out.select("metric", "n", "mean", "stddev", "min", *[F.get("q", F.lit(i)).alias(f"p{round(p * 100)}") for i, p in enumerate(quantiles)], "max")


def approximate_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...], error: float = 0.01) -> DataFrame:
    """Greenwald-Khanna quantiles of one column: (quantile, value)."""
    got = df.agg(F.percentile_approx(column, list(quantiles), int(1 / error)).alias("q"))
    return got.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, quantiles)), F.col("i") + 1).alias("quantile"), "value")


def fences(feats: DataFrame, accuracy: int = 1_000_000) -> DataFrame:
    """One row of p99 fences over trips that are neither teleports nor too fast; no such trip: infinite fences."""
    plain = feats.filter("not coalesce(is_teleport, false) and not coalesce(is_too_fast, false)")
    p = lambda c: F.coalesce(F.percentile_approx(c, C.ANOMALY_QUANTILE, accuracy), F.lit(float("inf")))
    return plain.agg(p("total_distance_km").alias("fence_km"), p("sinuosity").alias("fence_sinuosity"))


def anomaly_scores(feats: DataFrame) -> DataFrame:
    """Five detectors and their sum.  The fences are one row, so they ride along as a broadcast."""
    df = feats.crossJoin(F.broadcast(fences(feats)))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    df = df.select(
        "*",
        one(F.col("is_teleport") | F.col("is_too_fast")).alias("a_speed"),
        one(F.col("is_idle")).alias("a_idle"),
        one(F.col("total_distance_km") > F.col("fence_km")).alias("a_distance"),
        one(F.col("sinuosity") > F.col("fence_sinuosity")).alias("a_shape"),
        one(F.col("is_offgrid")).alias("a_drift"),
    )
    return df.withColumn("anomaly_score", F.col("a_speed") + F.col("a_idle") + F.col("a_distance") + F.col("a_shape") + F.col("a_drift"))


def top_anomalies(scored: DataFrame, id_col: str = "id", k: int = 50) -> DataFrame:
    return scored.filter("anomaly_score > 0").orderBy(F.desc("anomaly_score"), F.col("total_distance_km").desc_nulls_last(), id_col).limit(k)
