"""Near-duplicate texts by bottom-k sketches of one hash function.

A text's shingle set is hashed once; its sketch is the SKETCH smallest hashes.  Texts with equal sets form a class
first, so that copies never meet each other.  Inverted lists of the retained values (one row per class and value) give
the overlaps of sketches.  In the smallest SKETCH hashes of a pair's union, shared ones are a sample of the union
without replacement, so fewer than HALF of them in both sketches means a Jaccard similarity below 0.75 but for about 2 pairs in
a million; sets of at most SKETCH shingles are known whole.  Such pairs are dropped, the others verified on full sets.

Lists of at most LIST classes emit their pairs, with the number of lists they share.  Values in longer lists are
counted per class: a pair that shares too few values of short lists for its estimate, even if it shared all of the
long ones, is dropped; a pair that shares long lists only must share HALF of them, so that only classes with that many
long-list values take part, by their rarest such values.  What is still long is joined into groups whose members are
compared tile by tile, in numpy, without emitting pairs.  No list is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.llm.common import column, components, dealt, held, hot_keys, saved, spread_join, text_batches, thrifty, with_ids
from pathloom.llm.shingles import sets

SKETCH = 64
HALF = SKETCH // 2
LIST = 64
#: Sets of one side of a tile on average, and shingles of them together.
TILE, TILE_SHINGLES = 512, 1 << 21
_LEAST = f"int(case when n > {SKETCH} then {HALF} else greatest(1, ceil(n * 0.65)) end)"


def alike(inter: int, n: int, m: int, percent: int) -> bool:
    return 100 * inter >= percent * (n + m - inter)


def _chunks(batch: pa.RecordBatch, most: int = 1 << 22, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of at most so many bytes together, or one row."""
    size = batch.column(text).cast(pa.large_string())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@thrifty
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _chunks(whole):
            found = sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], pa.binary()),
                    pa.array([s[:SKETCH].view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                ["id", "n", "digest", "sketch"],
            )


@thrifty
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _chunks(whole):
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in sets(b.column(1).to_pylist())], pa.binary())], ["id", "set"]
            )


def _verifier(percent: int):
    """Rows sorted by (a, s, b), a's own set first (b null): yields the pairs that are alike.  Holds the sets of one a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            a, b, part, s = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            got = []
            for i in range(len(a)):
                x = np.frombuffer(s[i].as_buffer(), np.uint64)
                if (a[i], part[i]) != now:
                    now, own = (a[i], part[i]), []
                if b[i] is None:
                    own.append(x.copy())
                elif any(alike(len(np.intersect1d(o, x, True)), len(o), len(x), percent) for o in own):
                    got.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

    return thrifty(run)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike.  A set travels once for each pair in which it stands second, and once as first; the
    partners of a class that has very many are dealt over several tasks, each with its set."""
    pairs = held(pairs)
    hot = hot_keys(held(pairs.groupBy("a").agg(F.count("*").alias("n"))), ["a"])
    pairs = dealt(pairs.select("a", "b"), hot, ["a"], "b").withColumnRenamed("_s", "s")
    second = pairs.join(full, pairs.b == full.id).select("a", "b", "s", "set")
    first = pairs.select("a", "s").distinct().join(full, F.col("a") == full.id).select("a", F.lit(None).cast("long").alias("b"), "s", "set")
    both = first.unionByName(second).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return both.mapInArrow(_verifier(percent), "a long, b long")


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all of a tile's alike sets: left against itself, or against right (numbered on).  Sketch overlaps
    come from a product of 0/1 matrices, best first; what is joined already is not verified again."""
    all_sets = left + (right or [])
    n, m = len(left), len(all_sets)
    vals = np.concatenate([s[:SKETCH] for s in all_sets])
    rows = np.repeat(np.arange(m), [min(SKETCH, len(s)) for s in all_sets])
    u, col, count = np.unique(vals, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    cols = np.unique(col[keep], return_inverse=True)[1]
    x = np.zeros((m, int(cols.max()) + 1 if len(cols) else 1), np.float32)
    x[rows[keep], cols] = 1
    over = x[:n] @ (x[n:] if right is not None else x).T
    size = np.array([len(s) for s in all_sets])
    least = np.where(size > SKETCH, HALF, np.maximum(1, np.ceil(size * 0.65)))
    a, b = size[:n, None], (size[n:] if right is not None else size)[None, :]
    la, lb = least[:n, None], (least[n:] if right is not None else least)[None, :]
    ok = (over >= np.maximum(la, lb)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    if right is None:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    order = np.argsort(-over[i, j], kind="stable")
    up, out = list(range(m)), []
    for p, q in zip(i[order].tolist(), (j[order] + (n if right is not None else 0)).tolist()):
        rp, rq = _find(up, p), _find(up, q)
        if rp != rq and alike(len(np.intersect1d(all_sets[p], all_sets[q], True)), size[p], size[q], percent):
            up[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return out


def _tiler(percent: int):
    """Rows (grp, i, j, side, id, set) sorted by tile: yields links.  Holds one tile of about 2 * TILE sets."""

    def links(tile: list[tuple[int, int, np.ndarray]], same: bool) -> list[tuple[int, int]]:
        left = [(k, s) for side, k, s in tile if side == 0]
        right = [] if same else [(k, s) for side, k, s in tile if side == 1]
        if not left or (not same and not right):
            return []
        names = [k for k, _ in left + right]
        return [(names[p], names[q]) for p, q in tile_links([s for _, s in left], None if same else [s for _, s in right], percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, []
        made = lambda x: pa.RecordBatch.from_arrays([pa.array([y[k] for y in x], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            g, i, j, side, k = (batch.column(c).to_pylist() for c in range(5))
            for r in range(len(g)):
                if (g[r], i[r], j[r]) != now:
                    if tile:
                        yield made(links(tile, now[1] == now[2]))
                    now, tile = (g[r], i[r], j[r]), []
                tile.append((side[r], k[r], np.frombuffer(batch.column(5)[r].as_buffer(), np.uint64).copy()))
        if tile:
            yield made(links(tile, now[1] == now[2]))

    return thrifty(run)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links), kept.

    Null, empty and blank texts have no shingles and link with nothing; a null id links with nothing, its component_id is null
    and it is kept.  Rows that share an id are one node, repeated rows too.  Texts of any length are read whole; a tile holds
    fewer of them where they are long.  An empty table gives no rows.  Other columns, whatever their names, are neither
    read nor returned.
    """
    base = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    with text_batches(docs.sparkSession):
        rows = saved(base.mapInArrow(_sketches, "id long, n long, digest binary, sketch array<long>"))
    named = rows.filter("id is not null and digest is not null")
    firsts = held(named.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("copies")))
    member = spread_join(named, firsts, ["digest"], "id", n="copies")
    cls = saved(member.filter("id = cid").select("cid", "n", "sketch", F.expr(_LEAST).alias("least")))

    value = cls.select(F.explode("sketch").alias("v"), "cid")
    lists = value.groupBy("v").agg(F.count("*").alias("df"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("df > 1")
    lists = held(lists)
    in_lists = saved(value.join(lists.filter("df > 2").select("v", "df"), "v"))
    two = lists.filter("df = 2 and lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    def pairs_of(x: DataFrame) -> DataFrame:
        c = x.groupBy("v").agg(F.array_sort(F.collect_set("cid")).alias("c")).select(F.posexplode("c").alias("i", "a"), "c")
        return c.select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))

    long_lists = in_lists.filter(F.col("df") > LIST)
    n_long = held(long_lists.groupBy("cid").agg(F.count("*").alias("h")))
    info = cls.select("cid", "n", "least").join(n_long, "cid", "left").na.fill(0, ["h"])
    shared = two.unionByName(pairs_of(in_lists.filter(F.col("df") <= LIST))).groupBy("a", "b").agg(F.count("*").alias("m"))
    ia, ib = (info.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("least").alias(f"l{k}"), F.col("h").alias(f"h{k}")) for k in "ab")
    close = shared.join(ia, "a").join(ib, "b")
    close = close.filter(f"m + least(ha, hb) >= greatest(la, lb) and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "m")

    # Pairs that share values of long lists only.
    able = long_lists.join(info.filter("h >= least").select("cid", "h", "least"), "cid")
    rare = able.withColumn("r", F.row_number().over(W.partitionBy("cid").orderBy("df", "v"))).filter("r <= h - least + 1").select("v", "cid")
    rare = saved(rare)
    again = rare.join(rare.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "v")
    close = saved(close.unionByName(pairs_of(again.filter(F.col("df") <= LIST)).distinct().withColumn("m", F.lit(0).cast("long"))))
    crowd = again.filter(F.col("df") > LIST).select("v", "cid")
    stars = held(crowd.join(crowd.groupBy("v").agg(F.min("cid").alias("lo")), "v").select(F.col("cid").alias("a"), F.col("lo").alias("b")).distinct())
    group = held(components(stars)) if not stars.isEmpty() else None

    ids = close.select(F.explode(F.array("a", "b")).alias("id"))
    if group is not None:
        ids = ids.unionByName(group.select(F.col("node").alias("id")))
    ids = held(ids.distinct())
    with text_batches(docs.sparkSession):
        full = saved(with_ids(base, ids, "id").mapInArrow(_full_sets, "id long, set binary"))

    # Best pairs of each class first: what they join need not be verified pair by pair.
    best = close.select("a", "b", "m").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    best = best.groupBy("a").agg(F.max_by("b", F.struct("m", -F.col("b"))).alias("b"), F.min("b").alias("b2"))
    best = best.select("a", F.explode(F.array("b", "b2")).alias("b"))
    best = held(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = saved(_verified(best, full, percent))
    root = held(components(links))
    ra, rb = (root.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
    rest = close.join(best, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    rest = rest.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    links = links.unionByName(_verified(rest, full, percent))
    if group is not None:
        group = group.join(cls.select(F.col("cid").alias("node"), "n").distinct(), "node")
        size = group.groupBy("root").agg(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES).alias("size"))
        chunked = group.join(size, "root").select("node", F.col("root").alias("grp"), F.ceil("size").cast("int").alias("k"))
        chunked = chunked.withColumn("c", F.expr("int(pmod(xxhash64(node), k))"))
        tiles = chunked.select("node", "grp", "c", F.explode(F.expr("sequence(0, k - 1)")).alias("o"))
        tiles = tiles.select("node", "grp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.expr("if(c <= o, 0, 1)").alias("side"))
        tiles = tiles.join(full, tiles.node == full.id).select("grp", "i", "j", "side", F.col("id"), "set")
        tiles = tiles.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "id")
        links = links.unionByName(tiles.mapInArrow(_tiler(percent), "a long, b long"))
    root = components(saved(links))
    out = member.select("id", "n", "cid").join(root.withColumnRenamed("node", "cid"), "cid", "left").select("id", "n", F.coalesce("root", "cid").alias("c"))
    rest = rows.filter("id is null or digest is null").select("id", "n", F.col("id").alias("c"))
    return out.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept")
    )
