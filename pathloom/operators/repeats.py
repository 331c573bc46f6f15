"""Repeats by suffix arrays: suffixes are dealt by their first tokens, and each bucket is mined in one sweep of its sorted suffixes.

All occurrences of a repeat of at least `prefix` tokens start in one bucket, so buckets are complete.  A bucket with more
suffixes than `bucket_limit` is dealt again by one token more; what is shorter than that depth is counted as n-grams there.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions import geo
from pathloom.functions import sequences as S
from pathloom.sources.store import kept

SCHEMA = "key string, support long, support_entities long, n int, best_right long, best_left long"


class _Group:
    """The suffixes under one branching prefix: its height, who holds it, who comes before it, and the best repeat inside."""

    __slots__ = ("height", "ids", "entities", "before", "best", "size", "at")

    def __init__(self, height: int, at: int):
        self.height, self.at = height, at
        self.ids: set = set()
        self.entities: set = set()
        self.before: dict = {}
        self.best, self.size = 0, 0

    def add(self, row: tuple) -> None:
        self.ids.add(row[0])
        self.entities.add(row[1])
        if row[2] is not None:
            self.before.setdefault(row[2], set()).add(row[0])
        self.size += 1

    def merge(self, other: _Group) -> None:
        """Takes in all of another group; the smaller sets are moved."""
        for name in ("ids", "entities"):
            x, y = getattr(self, name), getattr(other, name)
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            big |= small
            setattr(self, name, big)
        if len(self.before) < len(other.before):
            self.before, other.before = other.before, self.before
        for k, v in other.before.items():
            own = self.before.get(k)
            if own is None:
                self.before[k] = v
            elif len(own) < len(v):
                v |= own
                self.before[k] = v
            else:
                own |= v
        self.size += other.size


def mine_bucket(rows: list[tuple], least: int, depth: int, keep: Callable[[list], bool] | None = None) -> list[tuple]:
    """rows (id, entity, prev, suffix): each repeat that branches on the right, of at least depth tokens and least sequences.

    best_right: most sequences of a longer repeat that starts with it (0: none above the floor); best_left: most sequences
    that one token before it occurs in.  Sequence starts are no extension.  keep: which repeats count at all.
    """
    if len(rows) < least:
        return []
    rows = sorted(rows, key=lambda r: r[3])
    open_: list[_Group] = []
    out = []

    def close(g: _Group) -> int:
        """Reports a finished group if it counts; the best support that it hands to the group around it."""
        if g.height >= depth and len(g.ids) >= least and (keep is None or keep(rows[g.at][3][: g.height])):
            left = max(map(len, g.before.values()), default=0)
            out.append((S.SEP.join(rows[g.at][3][: g.height]), len(g.ids), len(g.entities), g.height, g.best, left))
            return max(len(g.ids), g.best)
        return g.best

    for i, row in enumerate(rows):
        shared = -1
        if i + 1 < len(rows):
            a, b = row[3], rows[i + 1][3]
            shared, most = 0, min(len(a), len(b))
            while shared < most and a[shared] == b[shared]:
                shared += 1
        if shared > 0 and (not open_ or open_[-1].height < shared):
            open_.append(_Group(shared, i))
        if open_:
            open_[-1].add(row)
        while open_ and open_[-1].height > shared:
            done = open_.pop()
            best = close(done)
            if shared > 0 and (not open_ or open_[-1].height < shared):
                open_.append(_Group(shared, done.at))
            if open_:
                open_[-1].best = max(open_[-1].best, best)
                open_[-1].merge(done)
    return out


def trip_guard(least_km: float = C.MIN_SUBROUTE_KM, most_km: float = C.MAX_SUBROUTE_KM, revisits: int = C.MAX_CELL_REVISITS) -> Callable[[list], bool]:
    """Keeps runs of cells of that length that enter no cell too often."""
    hops: dict[tuple, float] = {}

    def keep(cells: list) -> bool:
        km = 0.0
        for pair in zip(cells, cells[1:]):
            if pair not in hops:
                hops[pair] = geo.hop_km_of(*pair)
            km += hops[pair]
        return least_km <= km <= most_km and max(map(cells.count, set(cells))) <= revisits

    return keep


def _miner(least: int, depth: int, trips: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("id", "entity", "prev", "suffix"))))
        got = mine_bucket(rows, least, depth, trip_guard() if trips else None)
        cols = list(zip(*got)) if got else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "support", "support_entities", "n", "best_right", "best_left"])

    return run


def suffix_rows(corpus: DataFrame, prefix: int, most: int) -> DataFrame:
    return corpus.select("id", "entity", F.explode(S.suffixes(F.col("seq"), prefix, most)).alias("s")).select("id", "entity", "s.*")


def mine(corpus: DataFrame, least: int, prefix: int = C.SUFFIX_PREFIX_CELLS, most: int = C.SUFFIX_MAX_CELLS, bucket_limit: int = 200_000, trips: bool = False) -> DataFrame:
    """Repeats of (id, entity, seq) rows with at least `least` sequences; see SCHEMA.  An id may have several rows.

    trips: tokens are cells, and only repeats that trip_guard keeps count.  Buckets above bucket_limit suffixes are dealt by
    one token more until they fit (or suffixes end); the repeats of exactly the old depth there come from counting, so
    nothing is cut.  Each depth's suffixes are kept in the shared folder, and crowded buckets are joined by name, however many they are.
    """
    rows = suffix_rows(corpus, prefix, most)
    out, depth = None, prefix
    while True:
        # Buckets with fewer suffixes than sequences asked for hold no repeat: most buckets of a large alphabet.
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
        rows = kept(rows.join(sizes, "bucket"))
        crowd = F.col("c") > bucket_limit
        again = depth < most and not rows.filter(crowd).isEmpty()
        fits = (rows.filter(~crowd) if again else rows).select("id", "entity", "bucket", "prev", "suffix")
        mined = fits.groupBy("bucket").applyInArrow(_miner(least, depth, trips), SCHEMA)
        out = mined if out is None else out.unionByName(mined)
        if not again:
            return out
        hot = rows.filter(crowd).drop("c")
        out = out.unionByName(_level(hot, least, depth, trips))
        depth += 1
        rows = hot.filter(F.size("suffix") >= depth).withColumn("bucket", F.array_join(F.slice("suffix", 1, depth), S.SEP))


def _level(hot: DataFrame, least: int, depth: int, trips: bool) -> DataFrame:
    """The repeats of exactly `depth` tokens in crowded buckets, counted, where they branch on the right."""
    x = hot.select("id", "entity", "prev", "bucket", F.get("suffix", F.lit(depth)).alias("next"))
    per = x.groupBy("bucket").agg(F.countDistinct("id").alias("support"), F.countDistinct("entity").alias("support_entities"), F.countDistinct(F.coalesce("next", F.lit(""))).alias("ways"), F.count_if(F.col("next").isNull()).alias("ends"))
    right = x.filter("next is not null").groupBy("bucket", "next").agg(F.countDistinct("id").alias("c")).filter(F.col("c") >= least).groupBy("bucket").agg(F.max("c").alias("best_right"))
    left = x.filter("prev is not null").groupBy("bucket", "prev").agg(F.countDistinct("id").alias("c")).groupBy("bucket").agg(F.max("c").alias("best_left"))
    j = per.filter(f"support >= {least} and (ways > 1 or ends > 0)").join(right, "bucket", "left").join(left, "bucket", "left").na.fill(0, ["best_right", "best_left"])
    if trips:
        cells = F.split("bucket", S.SEP)
        km = geo.path_km(F.transform(cells, lambda c: geo.hex_centre(c)))
        j = j.filter(km.between(C.MIN_SUBROUTE_KM, C.MAX_SUBROUTE_KM) & S.revisits_ok(cells))
    return j.select(F.col("bucket").alias("key"), "support", "support_entities", F.lit(depth).alias("n"), "best_right", "best_left")


def maximal_at(repeats: DataFrame, floor: int) -> DataFrame:
    """Valid for floors from the mining floor on."""
    return repeats.filter((F.col("support") >= floor) & (F.greatest("best_right", "best_left") < floor))


def holes(repeats: DataFrame, n: int, percent: float = C.SUPPORT_X_PCT, top: int = 5) -> DataFrame:
    """(key, support, best_right, best_left): the best maximal repeats at a share of n sequences, and how far below the floor
    their best continuations on either side fall."""
    floor = C.min_support_for(percent, n)
    best = maximal_at(repeats, floor).orderBy(F.desc("support"), F.desc("n"), "key").limit(top)
    return best.select("key", "support", "best_right", "best_left", F.lit(floor).alias("floor"))


def calibrate(repeats: DataFrame, n: int, bands: tuple[float, ...] = C.LENGTH_BANDS_KM, floors: tuple[int, ...] = C.SUPPORT_FLOORS, k: int = C.TOP_K, length: str = "length_km") -> DataFrame:
    """Floors by length band over mined repeats, as mining.calibrate: valid for floors from the mining floor on."""
    from pathloom.operators import mining

    return mining.calibrate(repeats, n, bands, floors, k, length)
