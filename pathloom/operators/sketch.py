"""Mergeable sketches beside their exact twins: heavy hitters, counts, distinct counts, quantiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.mining import banded_top


def heavy_hitters(rows: DataFrame, key: str = "key", k: int = 100, capacity: int = 49_152) -> DataFrame:
    """(key, estimate) of about the k most frequent keys, from bounded memory: partial sketches merge on the executors."""
    got = rows.agg(F.expr(f"approx_top_k({key}, {k}, {capacity})").alias("t"))
    return got.select(F.explode("t").alias("x")).select(F.col("x.item").alias("key"), F.col("x.count").alias("estimate"))


def heavy_hitters_by_band(rows: DataFrame, bands: tuple[float, ...], length: str = "n", k: int = 100, capacity: int = 49_152) -> DataFrame:
    """(band, key, estimate): one sketch a band, all in one pass; rows need at least the band's length."""
    aggs = [F.expr(f"approx_top_k(case when {length} >= {b} then key end, {k + 1}, {capacity})").alias(f"b{i}") for i, b in enumerate(bands)]
    one = rows.agg(*aggs)
    per = F.array(*[F.struct(F.lit(float(b)).alias("band"), F.col(f"b{i}").alias("t")) for i, b in enumerate(bands)])
    flat = one.select(F.explode(per).alias("p")).select("p.band", F.explode("p.t").alias("x"))
    return flat.filter("x.item is not null").select("band", F.col("x.item").alias("key"), F.col("x.count").alias("estimate"))


def recounted(candidates: DataFrame, rows: DataFrame, least: int = 2) -> DataFrame:
    """Candidates with their exact count, which is both bounds at once; those below `least` are dropped."""
    exact = rows.join(candidates.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("support"))
    return candidates.join(exact, "key").filter(F.col("support") >= least)


def count_min(rows: DataFrame, key: str = "key", eps: float = 2 / 131072, confidence: float = 0.96875, seed: int = 1) -> bytes:
    """A serialised count-min sketch (depth 5, width 131,072 by default): its size does not depend on the rows."""
    return bytes(rows.agg(F.count_min_sketch(F.col(key).cast("string"), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("s")).first()["s"])


def murmur3(data: bytes, seed: int) -> int:
    """Murmur3 (32 bits, signed) as Spark's sketches take it: whole words, then each byte left over as a word of its own."""
    c1, c2, m = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    words = [w & m for w in struct.unpack(f"<{len(data) // 4}i", data[: len(data) // 4 * 4])]
    words += [(b - 256 if b > 127 else b) & m for b in data[len(data) // 4 * 4 :]]
    h = seed & m
    for w in words:
        h = (rotl(h ^ (rotl(w * c1 & m, 15) * c2 & m), 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Counters:
    """A count-min sketch as Spark serialises it: version, total, depth, width, a hash parameter a row, counters by row."""

    def __init__(self, sketch: bytes):
        _, self.total, self.depth, self.width = struct.unpack(">iqii", sketch[:20])
        at = 20 + 8 * self.depth
        self.table = np.frombuffer(sketch[at:], ">i8").reshape(self.depth, self.width)

    def estimate(self, key: str) -> int:
        data = key.encode()
        first = murmur3(data, 0)
        second = murmur3(data, first)
        out = None
        for i in range(self.depth):
            place = (first + i * second + (1 << 31)) % (1 << 32) - (1 << 31)  # as 32-bit integers wrap
            count = int(self.table[i, abs(place) % self.width])
            out = count if out is None else min(out, count)
        return out or 0


def count_min_estimates(keys: DataFrame, sketch: bytes, key: str = "key") -> DataFrame:
    """(key, estimate) for a table of keys of any size, never below the true count.

    The sketch rides along with each task, as a table of counters; a key's cells are found as the sketch itself finds them.
    """
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # its size does not depend on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(shared.value)
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counters.estimate(k) for k in names], pa.int64())], ["key", "estimate"])

    return keys.select(F.col(key).cast("string").alias("key")).mapInArrow(run, "key string, estimate long")


def distinct_counts(rows: DataFrame, by: str, what: str, rsd: float = 0.02) -> DataFrame:
    """(by, exact, approx, error): HyperLogLog and exact distinct counts side by side."""
    g = rows.groupBy(by).agg(F.countDistinct(what).alias("exact"), F.approx_count_distinct(what, rsd).alias("approx"))
    return g.withColumn("error", F.abs(F.col("approx") - F.col("exact")) / F.col("exact"))


def distinct_errors(counts: DataFrame) -> DataFrame:
    """One row over distinct_counts: groups, the mean relative and the largest absolute error, and the largest exact count."""
    off = F.abs(F.col("approx") - F.col("exact"))
    return counts.agg(F.count("*").alias("groups"), F.avg("error").alias("mean_relative"), F.max(off).alias("largest_absolute"), F.max("exact").alias("largest_exact"))


def accuracy(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: approx (key, estimate) against exact (key, support): overlap, precision, recall, mean errors."""
    j = exact.join(approx, "key", "full")
    both = F.col("support").isNotNull() & F.col("estimate").isNotNull()
    err = F.when(both, F.abs(F.col("estimate") - F.col("support")))
    out = j.agg(F.count_if(both).alias("overlap"), F.count("estimate").alias("found"), F.count("support").alias("wanted"), F.avg(err).alias("mae"), F.avg(err / F.col("support")).alias("mre"))
    return out.select("wanted", "found", "overlap", F.try_divide("overlap", "found").alias("precision"), F.try_divide("overlap", "wanted").alias("recall"), "mae", "mre")


__all__ = ["accuracy", "banded_top", "count_min", "count_min_estimates", "distinct_counts", "distinct_errors", "heavy_hitters", "heavy_hitters_by_band", "recounted"]
