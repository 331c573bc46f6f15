"""Best-fit packing of token pieces into sequences, by bin completion branch-and-bound over lengths.

Pieces of one length are alike, so the problem is the histogram of lengths: at most capacity - 1 counts, whatever
the corpus.  The driver takes the largest length left, enumerates undominated fillings of the room around it, and uses the
one of least waste for as many sequences as the counts allow (each such step exhausts a length, so that the steps are
bounded by the capacity too).  That best-fit descent is the incumbent; while it needs more sequences than the waste
bound (all tokens / capacity), the search goes back to other fillings, pruned where waste passes what a better
solution may have.  Pieces then find their place by their rank among pieces of their length, without another shuffle.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column, saved, text_batches, thrifty
from pathloom.llm.minhash import _chunks
from pathloom.llm.tokens import encoder, ids_of_long

CAPACITY = 4096
END = 1
#: Steps of one search for fillings, fillings tried at a step, steps back of the whole search, and pieces left below
#: which a filling is used once at a time.
FILL_STEPS, WIDTH, BACK, FEW = 600, 50, 800, 200
_LONG = 1 << 20


def fillings(room: int, lengths: list[int], count: np.ndarray, width: int = WIDTH, steps: int = FILL_STEPS) -> list[tuple[int, ...]]:
    """Up to width undominated sets of lengths (descending) that fit into room, least waste first.  lengths ascend."""
    best: list[tuple[int, tuple[int, ...]]] = []
    left = [steps]

    def dominated(chosen: tuple[int, ...], waste: int) -> bool:
        for i in range(len(chosen) - 1):
            pair = chosen[i] + chosen[i + 1]
            k = bisect.bisect_left(lengths, pair)
            if k < len(lengths) and lengths[k] <= pair + waste and count[lengths[k]] > chosen.count(lengths[k]):
                return True
        return False

    def go(free: int, top: int, chosen: tuple[int, ...]) -> bool:
        """True: enough.  top: index of the largest length still allowed."""
        k = min(top, bisect.bisect_right(lengths, free) - 1)
        leaf = True
        while k >= 0 and left[0] > 0:
            x = lengths[k]
            if count[x] > chosen.count(x):
                leaf = False
                left[0] -= 1
                if go(free - x, k, (*chosen, x)):
                    return True
                if len(best) >= width and best[-1][0] == 0:
                    return True
            k -= 1
        if leaf and (len(best) < width or free < best[-1][0]) and not dominated(chosen, free):
            bisect.insort(best, (free, chosen))
            del best[width:]
        return bool(best) and best[0][0] == 0 and (width == 1 or len(best) >= width)

    go(room, len(lengths) - 1, ())
    return [c for _, c in best] or [()]


def complete(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for all pieces, by length counts."""
    count = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        count[k] = v
    total = int((count * np.arange(capacity + 1)).sum())
    bound = -(-total // capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_n, back = total + 1, 0
    lengths = [int(x) for x in np.flatnonzero(count)]
    #: (sequence, times, other fillings to try; None: not yet looked for)
    path: list[tuple[tuple[int, ...], int, list[tuple[int, ...]] | None]] = []
    used, waste, left = 0, 0, int(count.sum())

    def put(pattern: tuple[int, ...], times: int) -> None:
        """Takes the pieces of `times` such sequences; a negative number gives them back."""
        nonlocal used, waste, left
        for x in set(pattern):
            had = count[x]
            count[x] -= times * pattern.count(x)
            if had and not count[x]:
                del lengths[bisect.bisect_left(lengths, x)]
            elif count[x] and not had:
                bisect.insort(lengths, x)
        used += times
        waste += times * (capacity - sum(pattern))
        left -= times * len(pattern)

    def around(big: int, width: int) -> list[tuple[int, ...]]:
        count[big] -= 1
        found = [(big, *o) for o in fillings(capacity - big, lengths, count, width)]
        count[big] += 1
        return found

    while True:
        if lengths:
            options: list[tuple[int, ...]] | None = around(lengths[-1], 1)
            fresh = True
        else:
            if used < best_n:
                best, best_n = [(p, t) for p, t, _ in path], used
            options, fresh = [], False
        if best is not None and (best_n <= bound or back > BACK):
            return best
        while not options or (best is not None and waste > (best_n - 1) * capacity - total):
            if not path or back > BACK:
                return best or []
            pattern, times, options = path.pop()
            put(pattern, -times)
            if options is None:
                options = [o for o in around(pattern[0], WIDTH) if o != pattern]
            fresh = False
            back += 1
        pattern = options[0]
        times = 1 if left <= FEW else int(min(count[x] // pattern.count(x) for x in set(pattern)))
        put(pattern, times)
        path.append((pattern, times, None if fresh else options[1:]))


def layout(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: rows (key = length << 48 | first rank, pieces a sequence, first sequence, offset)."""
    rows, taken, seq = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            c = pattern.count(x)
            rows.append((x << 48 | taken.get(x, 0), c, seq, offset))
            taken[x] = taken.get(x, 0) + c * times
            offset += c * x
        seq += times
    rows.sort()
    return dict(zip(("key", "per", "seq", "off"), np.array(rows, np.int64).reshape(-1, 4).T))


def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([END], np.uint32)
        for whole in batches:
            for b in _chunks(whole, 1 << 20):
                names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                if len(texts) == 1 and texts[0] and len(texts[0]) > _LONG:
                    ids = ids_of_long(e, texts[0])
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = e.encode(texts)
                out: list[tuple] = []
                for i, name in enumerate(names):
                    own = np.concatenate((ids[bounds[i] : bounds[i + 1]], end)).astype("<u4")
                    for p, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at : at + capacity]
                        out.append((name, p, at, len(cut), zlib.crc32(cut.tobytes())))
                cols = list(zip(*out)) if out else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return thrifty(run)


def _placer(table, first_of: dict[int, int], start_of: np.ndarray, capacity: int, n_packed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            at = b.column(b.schema.get_field_index("at")).to_numpy()
            length = b.column(3).to_numpy()
            index = (at & ((1 << 33) - 1)) + np.array([first_of[p] for p in (at >> 33).tolist()], np.int64)
            rank = index - start_of[length]
            full = length == capacity
            k = np.searchsorted(t["key"], (length << 48) | rank, "right") - 1
            if len(t["key"]):
                r = rank - (t["key"][k] & ((1 << 48) - 1))
                seq, off = t["seq"][k] + r // t["per"][k], t["off"][k] + r % t["per"][k] * length
            else:
                seq, off = np.zeros_like(rank), np.zeros_like(rank)
            seq, off = np.where(full, n_packed + rank, seq), np.where(full, 0, off)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    return thrifty(run)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have one piece, the end mark; texts longer than the capacity, however long, are cut into pieces of it.
    Rows are packed each for itself, whatever ids they share, repeated rows too; a null id is returned as it is.  Pieces of one
    length are alike: which of them goes where follows a hash, then the id.  An empty table gives no rows.  Other columns,
    whatever their names, are neither read nor returned.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    base = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    cut = base.mapInArrow(_cutter(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    with text_batches(spark):
        cut = saved(cut)
    order = ["length", F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = saved(ranked)
    parts = ranked.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    first_of, seen = {}, 0
    for r in parts:
        first_of[r["p"]] = seen
        seen += r["n"]
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    start_of = np.zeros(capacity + 2, np.int64)
    start_of[1:] = np.cumsum([counts.get(i, 0) for i in range(capacity + 1)])
    plan = complete({k: v for k, v in counts.items() if k < capacity}, capacity)
    table = spark.sparkContext.broadcast(layout(plan))  # rows bounded by the capacity
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(table, first_of, start_of, capacity, sum(t for _, t in plan)), schema)
