"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label form a class first.  Rotations learned on a bounded sample (alternating sign codes and orthogonal
Procrustes steps) give balanced binary codes; substrings of the codes index hash tables.  Two vectors are
candidates where a substring is equal, and are reranked by the cosine of the original vectors in double precision, in the first
such table only, so that a link is counted once.  The number of tables follows from how often the learned codes keep a
substring for pairs at the threshold: it is raised until at most MISS of such pairs share none.  Where MOST_TABLES do not reach
that, substrings are shortened until they do.

A bucket with more than TILE classes is dealt out in tiles, every pair of parts once.  Tiles hand on counts and the edges of a
spanning forest, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column, components, held, is_small, saved, spread_join

SAMPLE = 20_000
ITERATIONS = 30
MISS = 0.004
TILE = 1024
#: Tables of one index at most (a smaller width needs fewer), and sample rows that give a label a mean of its own.
MOST_TABLES, OWN_MEAN = 120, 500
#: Vectors of one length and label up to which all are compared, without an index; lengths with an index at most (the others: likewise).
FEW, INDEXES = 64, 16


def itq(x: np.ndarray, bits: int, rng: np.random.Generator, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): sign((v - mean) @ projection) are the code bits of v."""
    mean = x.mean(0)
    z = x - mean
    _, vectors = np.linalg.eigh(z.T @ z)
    axes = vectors[:, ::-1][:, :bits]
    v = z @ axes
    rotation = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(iterations):
        b = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


class Index:
    """Learned rotations, and which bits make the substring of each table.

    Codes are centred by the mean of their label where the sample holds at least OWN_MEAN rows of it, else of all rows.  A width
    whose MOST_TABLES tables would miss more than MISS gives way to the next smaller one; at width 0 all vectors share one table.
    """

    def __init__(self, sample: np.ndarray, width: int, threshold: float, seed: int = 2, labels: list[str] | None = None):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._learn_centres(sample, labels)
        # Pairs at the threshold: each sample vector and one turned from it by that angle, in a random direction.
        x = sample[:4000]
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        y = threshold * x + math.sqrt(1 - threshold**2) * y
        own = None if labels is None else labels[:4000]
        x, y, centred = self._centred(x, own), self._centred(y, own), self._centred(sample, labels)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for self.width in range(min(width, self.dim), -1, -1):
            per = self.dim // self.width if self.width else 1
            most = -(-MOST_TABLES // per)
            missed, k, rate = np.ones(len(x), bool), 0, 1.0
            # Pairs still missed are the harder ones: a rate that would not do in all tables will not do.
            while self.width and (rate > MISS or not k) and k < most and (k < 4 or rate ** (most / k) <= MISS):
                if k == len(parts):
                    parts.append(itq(centred, self.dim, rng))
                a, b = (self._codes(z, parts[k]) for z in (x, y))
                missed &= ~(a == b).any(1)
                k, rate = k + 1, missed.mean()
            if rate <= MISS:
                break
        self.parts = parts[:k]
        self.tables = k * per if self.width else 1

    def _learn_centres(self, sample: np.ndarray, labels: list[str] | None) -> None:
        self.place: dict[str, int] = {}
        if labels is None:
            self.centres = np.zeros((1, self.dim))
            return
        rows: dict[str, list[int]] = {}
        for i, label in enumerate(labels):
            rows.setdefault(label, []).append(i)
        often = [k for k, at in rows.items() if len(at) >= OWN_MEAN]
        self.place = {k: i + 1 for i, k in enumerate(often)}
        self.centres = np.array([sample.mean(0), *(sample[rows[k]].mean(0) for k in often)])

    def _centred(self, x: np.ndarray, labels: list[str] | None) -> np.ndarray:
        return x - (self.centres[0] if labels is None else self.centres[[self.place.get(k, 0) for k in labels]])

    def _codes(self, x: np.ndarray, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        bits = ((x - part[0]) @ part[1]) >= 0
        per = self.dim // self.width
        weights = 1 << np.arange(self.width, dtype=np.int64)
        return (bits[:, : per * self.width].reshape(len(x), per, self.width) * weights).sum(2)

    def codes(self, x: np.ndarray, labels: list[str] | None = None) -> np.ndarray:
        """int32 substring codes, by vector and table."""
        if not self.width:
            return np.zeros((len(x), 1), np.int32)
        x = self._centred(x, labels)
        return np.concatenate([self._codes(x, p) for p in self.parts], axis=1).astype(np.int32)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, dim, digest, vec as bytes of doubles); digest null: links with nothing."""
    for b in batches:
        out = []
        for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else x.astype("<f8").tobytes()
            name = None if raw is None else hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest()
            out.append((len(x) if x is not None else 0, name, raw))
        cols = list(zip(*out)) if out else [()] * 3
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "label", "dim", "digest", "vec"])


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1.0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _coder(indexes: dict[int, Index]):
    """Adds codes: as many as the index with the most tables has, -1 where a length has fewer.  Vectors of a length without an
    index share one table."""
    most = max((ix.tables for ix in indexes.values()), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, dims = b.column(b.schema.get_field_index("vec")).to_pylist(), b.column(b.schema.get_field_index("dim")).to_numpy()
            labels = b.column(b.schema.get_field_index("label")).to_pylist()
            codes = np.full((len(vecs), most), -1, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(vecs[i] for i in at), np.float64).reshape(len(at), d)
                ix = indexes.get(int(d))
                if ix is None:
                    codes[at, 0] = 0
                else:
                    codes[at, : ix.tables] = ix.codes(_unit(x), [labels[i] for i in at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codes), pa.list_(pa.int32()))], [*b.schema.names, "codes"])

    return run


def tile_links(x: np.ndarray, codes: np.ndarray, weight: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links by row, weighted by copies; component by row as the index of its first row), for links first found in `table`.

    side 0 against side 1, or side 0 against itself where there is no side 1.
    """
    n = len(x)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    same = not len(right)
    if same:
        right = left
    hit = x[left] @ x[right].T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    for t in range(table):
        hit &= codes[left, t][:, None] != codes[right, t][None, :]
    links = np.zeros(n, np.int64)
    links[left] += hit @ weight[right]
    if not same:
        links[right] += hit.T @ weight[left]
    root = np.arange(n)
    if hit.any():
        while True:
            low = np.minimum(root[left], np.where(hit, root[right][None, :], n).min(1))
            new = root.copy()
            new[left] = low
            back = np.where(hit, new[left][:, None], n).min(0)
            new[right] = np.minimum(new[right], back)
            if (new == root).all():
                break
            root = new
    return links, root


def _linker(threshold: float):
    """Rows (gid, key, i, j, side, cid, m, dim, vec, codes) sorted by tile: (cid, links, root) of the rows with links."""
    names = ("gid", "key", "i", "j", "side", "cid", "m")
    tile_of = ("gid", "key", "i", "j")

    def solve(rows: dict[str, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _unit(rows["vec"].reshape(-1, dim))
        links, root = tile_links(x, rows["codes"], rows["m"], rows["side"], int(rows["key"][0] >> 32), threshold)
        at = np.flatnonzero(links)
        return rows["cid"][at], links[at], rows["cid"][root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the tile that is not yet whole

        def tile(parts: list[tuple]) -> list[np.ndarray]:
            rows = {k: np.concatenate([p[0][k] for p in parts]) for k in names}
            rows["vec"] = np.concatenate([p[1] for p in parts])
            rows["codes"] = np.concatenate([p[2] for p in parts])
            return list(solve(rows, parts[0][3])) if len(rows["cid"]) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            col = {k: b.column(b.schema.get_field_index(k)).to_numpy() for k in names}
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            vecs = b.column(b.schema.get_field_index("vec"))
            lists = b.column(b.schema.get_field_index("codes"))
            codes = lists.flatten().to_numpy().reshape(b.num_rows, -1)
            offs = np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset : vecs.offset + b.num_rows + 1]
            flat = np.frombuffer(vecs.buffers()[2], np.uint8)
            new = np.flatnonzero(np.any([np.diff(col[k]) != 0 for k in tile_of], axis=0)) + 1
            bounds = [0, *new.tolist(), b.num_rows]
            got: list[list[np.ndarray]] = []
            for s, e in zip(bounds, bounds[1:]):
                part = ({k: v[s:e] for k, v in col.items()}, np.frombuffer(flat[offs[s] : offs[e]].tobytes(), np.float64), codes[s:e], int(dims[s]))
                if held and any(held[0][0][k][0] != part[0][k][0] for k in tile_of):
                    got.append(tile(held))
                    held = []
                held.append(part)
            yield made(got)
        if held:
            yield made([tile(held)])

    def made(got: list[list[np.ndarray]]) -> pa.RecordBatch:
        got = [g for g in got if g]
        cols = [np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cid", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, width: int | None = None) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Null labels, null, empty and zero vectors, and vectors with null or non-finite components link with nothing; so do vectors of
    different lengths.  Equal vectors of a label are linked.  Rows that share an id are one node of the components, a null id is
    kept with a null component.  An empty table gives no rows.  Other columns, whatever their names, are neither read nor
    returned.
    """
    base = vectors.select(column(id_col).cast("long").alias("id"), column(label_col).cast("string").alias("label"), column(vector_col).cast("array<double>").alias("v"))
    rows = saved(base.mapInArrow(_digests, "id long, label string, dim int, digest binary, vec binary"))
    named = rows.filter("digest is not null and id is not null")
    cls = named.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("m"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    cls = held(cls)
    # Vectors of one label and length are a group, named by its smallest class: only they are ever compared.
    groups = held(cls.groupBy("label", "dim").agg(F.min("cid").alias("gid"), F.count("*").alias("n")))
    sizes = groups.groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n")).filter("most > 1")
    indexed = sizes.filter(F.col("most") > FEW).orderBy(F.desc("n"), "dim").limit(INDEXES).collect()
    found = None
    if indexed or not sizes.isEmpty():
        indexes: dict[int, Index] = {}
        for per in indexed:
            some = cls.filter(F.col("dim") == per["dim"]).orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("label", "vec").collect()
            x = _unit(np.frombuffer(b"".join(r["vec"] for r in some), np.float64).reshape(len(some), -1))
            bits = width or max(8, min(24, math.ceil(math.log2(per["most"])) - 4))
            indexes[per["dim"]] = Index(x, bits, threshold, labels=[r["label"] for r in some])
        own = cls.join(F.broadcast(groups.drop("n")), ["label", "dim"]) if is_small(groups) else spread_join(cls, groups, ["label", "dim"], "cid")
        own = own.select("cid", "m", "gid", "label", "dim", "vec")
        coded = saved(own.mapInArrow(_coder(indexes), "cid long, m long, gid long, label string, dim int, vec binary, codes array<int>"))
        key = (F.shiftleft(F.col("t").cast("long"), 32) + F.col("code")).alias("key")
        slim = coded.select("gid", F.posexplode("codes").alias("t", "code")).filter("code >= 0").select("gid", key)
        crowded = held(slim.groupBy("gid", "key").agg(F.count("*").alias("n")).filter(f"n > {TILE}").select("gid", "key", F.ceil(F.col("n") / TILE).cast("int").alias("k")))
        dealt = coded.select("cid", "m", "gid", "dim", "vec", "codes", F.posexplode("codes").alias("t", "code")).filter("code >= 0").withColumn("key", key)
        dealt = dealt.join(F.broadcast(crowded) if is_small(crowded) else crowded, ["gid", "key"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("c", F.expr("int(pmod(xxhash64(cid), k))"))
        dealt = dealt.select("*", F.explode(F.expr("sequence(0, k - 1)")).alias("o"))
        tiles = dealt.select("gid", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.expr("if(c <= o, 0, 1)").alias("side"), "cid", "m", "dim", "vec", "codes")
        tiles = tiles.repartition("gid", "key", "i", "j").sortWithinPartitions("gid", "key", "i", "j", "side")
        found = saved(tiles.mapInArrow(_linker(threshold), "cid long, links long, root long"))
    classes = held(cls.select("digest", "cid", F.col("m").alias("copies"), F.col("m").alias("n")))
    out = spread_join(named.select("id", "digest"), classes, ["digest"], "id")
    if found is not None:
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        root = components(found.filter("cid <> root").select("cid", "root"), "cid", "root")
        out = out.join(links, "cid", "left").join(root.select(F.col("node").alias("cid"), "root"), "cid", "left")
        out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "cid").alias("c"))
    else:
        out = out.select("id", (F.col("copies") - 1).alias("n"), F.col("cid").alias("c"))
    rest = rows.filter("digest is null or id is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
