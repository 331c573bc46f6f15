"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source size times.  The whole part is taken outright; the fraction
is rounded so that the words taken stay the same: two documents with fractions trade words, in random direction
(such that each fraction is kept in expectation), until one of them is whole; the other goes on.  Where the next
document is too small for that, several stand in for it.  A leaf is a bucket of a source, of about LEAF rows, taken in descending
size, so that the one left over is small.  Leaves' leftovers meet in groups of FAN, level by level, until each source has
one; chance decides that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import WORD, column, held, is_small, saved, thrifty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
LEAF, FAN = 1024, 64
#: Sources at most that are broadcast with their targets; more are joined by a shuffle.
FEW_SOURCES = 50_000
_COLS = "doc_id long, k long, size long, si int, bucket long, whole int, x double"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words for each source: share of all words by weight, at most `most` times its own, the excess shared anew."""
    names = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    free, budget = list(names), share * sum(size.values())
    while free:
        unit = budget / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = most * size[s]
            budget -= out[s]
        free = [s for s in free if s not in out]
        budget = max(budget, 0.0)
    return out


def pivot(size: list[int], x: list[float], rng: np.random.Generator) -> None:
    """Rounds x (0 to 1, descending sizes) in place but for one at most, keeping sum(size * x) and each expectation.

    The largest fractional document trades with the next ones, as many as can take its words in either direction.  It is whole
    after that; at the end, when too little is left to make it whole, some trading partner is.
    """
    for i in range(len(x)):
        if size[i] == 0 and 0 < x[i] < 1:
            x[i] = 1.0 if rng.random() < x[i] else 0.0
    live = [i for i in range(len(x)) if 0 < x[i] < 1]
    while len(live) > 1:
        i = live[0]
        gain, loss = size[i] * (1 - x[i]), size[i] * x[i]  # words it needs to be 1, gives to be 0
        parts, room = [], 1.0
        for j in live[1:]:
            w = min(room, size[j] * x[j] / gain, size[j] * (1 - x[j]) / loss)
            parts.append((j, w))
            room -= w
            if room <= 1e-12:
                break
        if room > 1e-12:  # too few words are left: pair it with the next one alone
            j = live[1]
            parts = [(j, 1.0)]
            up, down = min(gain, size[j] * x[j]), min(loss, size[j] * (1 - x[j]))
        else:
            up, down = gain, loss
        rise = rng.random() * (up + down) < down
        x[i] += up / size[i] if rise else -down / size[i]
        for j, w in parts:
            x[j] -= up * w / size[j] if rise else -down * w / size[j]
        for k in (i, *(j for j, _ in parts)):
            if x[k] < 1e-9 or x[k] > 1 - 1e-9:
                x[k] = float(round(x[k]))
        live = [k for k in live if 0 < x[k] < 1]


def _pivot(seed: int, level: int):
    """Rows (doc_id, k, size, si, bucket, whole, x, last) sorted by (si, bucket) and descending size: the same rows with x
    0 or 1, but for one left over a bucket, which is rounded too if its bucket is the source's last.  Holds a bucket."""

    def settled(rows: list[list]) -> pa.RecordBatch:
        if rows:
            rng = np.random.Generator(np.random.Philox(key=[seed, (level << 56) ^ (rows[0][3] << 32) ^ rows[0][4]]))
            x = [r[6] for r in rows]
            pivot([r[2] for r in rows], x, rng)
            for r, v in zip(rows, x):
                r[6] = v if v in (0.0, 1.0) or not r[7] else 1.0 if rng.random() < v else 0.0
        cols = list(zip(*(r[:7] for r in rows))) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "k", "size", "si", "bucket", "whole", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[list] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if now and (row[3], row[4]) != (now[0][3], now[0][4]):
                    yield settled(now)
                    now = []
                now.append(list(row))
        yield settled(now)

    return thrifty(run)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10) -> DataFrame:
    """One row per row of docs: id_col, k (a checksum of its row), size, source_size, target, copies, taken.

    Null and empty texts and texts without words have size 0 and take no words; a null id is an id like others, a null source is a
    source, the last one.  Ties and repeated rows are rounded each for itself; a very long text counts whole.  An empty table
    gives no rows.  The same rows give the same result, however they are laid out.  Other columns, whatever their names, enter
    k only.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"), words.alias("size"), row_key(docs).alias("k"))
    base = saved(base)
    per = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source: the mix names each
    goal = targets([(r["source"], r["size"]) for r in per])
    table = [(i, r["source"], r["size"], float(goal[r["source"]]), max(1, -(-r["n"] // LEAF))) for i, r in enumerate(sorted(per, key=lambda r: (r["source"] is None, r["source"] or "")))]
    # From Arrow: a list would go through Python workers of its own, which then stand idle beside the others.
    kinds = {"si": pa.int32(), "s": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "buckets": pa.int64()}
    source = spark.createDataFrame(pa.table({c: pa.array([t[i] for t in table], k) for i, (c, k) in enumerate(kinds.items())}))
    source = F.broadcast(source) if len(table) <= FEW_SOURCES else source
    rows = base.join(source, base.source.eqNullSafe(source.s))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.select("doc_id", "k", "size", "si", F.expr("pmod(xxhash64(doc_id, k), buckets)").alias("bucket"), F.floor(times).cast("int").alias("whole"), (times - F.floor(times)).alias("x"), (F.col("buckets") == 1).alias("last"))
    order = ["si", "bucket", F.desc("size"), "doc_id", "k"]
    done, most, level = [], max((t[4] for t in table), default=1), 0
    while True:
        got = saved(rows.repartition("si", "bucket").sortWithinPartitions(*order).mapInArrow(_pivot(seed, level), _COLS))
        done.append(got.filter("x in (0, 1)"))
        if most <= 1:
            break
        most, level = -(-most // FAN), level + 1
        left = got.filter("x not in (0, 1)").withColumn("bucket", F.expr(f"bucket div {FAN}"))
        rows = left.withColumn("last", F.lit(most <= 1))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.join(source.select("si", "source_size", "target"), "si").withColumn("copies", F.col("whole") + F.col("x").cast("int"))
    return out.select(F.col("doc_id").alias(id_col), "k", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def row_key(docs: DataFrame) -> Column:
    """A checksum of a row's columns; maps, which have no order of their own, by their JSON text."""
    return F.xxhash64(*[F.to_json(column(f.name)) if "map<" in f.dataType.simpleString() else column(f.name) for f in docs.schema.fields])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns whatever their names and types.

    Rows travel as one struct beside columns of ours, so that no name can clash.  Rows that are equal in every column are taken
    as often as all of them together.  Nulls, empty and long texts and an empty table: as in mix.
    """
    plan = mix(docs, id_col, text_col, source_col).select(F.col(id_col).alias("id"), "k", "copies")
    by = held(plan.groupBy("id", "k").agg(F.min("copies").alias("low"), F.count("*").alias("n"), F.sum("copies").alias("all")))
    twice = not by.filter("n > 1").isEmpty()
    by = F.broadcast(by) if is_small(by) else by
    full = docs.select(F.struct("*").alias("row"), column(id_col).cast("long").alias("own"), row_key(docs).alias("key"))
    out = full.join(by, F.col("own").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))).select("row", "own", "key", "low", "n", "all")
    copies = lambda rows, times: rows.filter(f"{times} > 0").select("row", F.explode(F.expr(f"sequence(1, int({times}))"))).select("row.*")
    if not twice:
        return copies(out, "low")
    # Rows that are equal in every column are one row, taken as often as all of them together, dealt over tasks.
    many = out.filter("n > 1").groupBy("own", "key").agg(F.first("row").alias("row"), F.first("all").alias("all"))
    many = many.filter("all > 0").select("row", "key", "all", F.explode(F.expr(f"sequence(0, int((all - 1) div {LEAF}))")).alias("part"))
    many = many.select("row", "key", "part", F.expr(f"least({LEAF}, all - part * {LEAF})").alias("times")).repartition("key", "part")
    return copies(out.filter("n = 1"), "low").unionByName(copies(many, "times"))
