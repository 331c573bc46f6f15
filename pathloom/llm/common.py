"""What the operators share: text rules, shared-folder tables, size-checked and skew-proof joins, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a broadcast id set at most, as its columns hold them; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows of one key up to which no join deals them out.
LEAST_HOT = 64
#: Rows of texts that go to Python at once: the JVM and the worker each hold such a batch.
TEXT_ROWS = 1000
_own_dir: list[str] = []
_scopes: list[list[str | DataFrame]] = []


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else.  Where all is ASCII, lower() says the same in a fraction of the time."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def column(name: str) -> Column:
    """A top-level column by its name, which may hold dots (Spark cannot address names with a backtick)."""
    return F.col(f"`{name}`")


def held_out_py(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out(c: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1.  A null id is never held out."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def passages(text: Column, most: int, size: int = 500) -> Column:
    """The whole text where it has at most `most` characters, else passages of `size`, spread evenly over all of it, line by line."""
    n, parts = F.length(text), max(1, most // size)
    step = (n - size) / F.lit(max(1, parts - 1))
    some = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(n > most, F.array_join(some, "\n")).otherwise(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where a local session names none, one of our own; a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="pathloom-"))
    return _own_dir[0]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended: the folder's owner clears it
        pass


def saved(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there, and losing an executor
    loses none of it.  Tables go when their scope ends, those made outside any when the interpreter does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """The frame kept on the executors' disks until its scope ends, for tables that several plans read and that follow from saved
    ones by few steps: what a lost executor held is worked out again from those.  Its rows must not depend on their order, and
    held tables should not stand on many others: plans hold all that they stand on."""
    out = df.persist(StorageLevel.DISK_ONLY)
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What runs inside sends at most so many rows at once to Python; the session's own setting stands again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if 0 < int(own) <= rows:
        yield
        return
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def give_back() -> None:
    """Returns memory that this process has freed to the system: idle workers stay for a minute beside those that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def thrifty(run: Callable) -> Callable:
    """A function of mapInArrow that gives back its memory when its task ends."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Saved and held tables made inside go at its end.  What is to outlive it must be saved after it, or written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            if isinstance(made, str):
                _forget(spark, made)
            else:
                made.unpersist()


def settled(df: DataFrame, make) -> DataFrame:
    """make(df), saved, with all tables that it needed on its way deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom-{uuid.uuid4().hex}"
    with scope(spark):
        out = make(df)
        out.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_forget, spark, path)
    return spark.read.schema(out.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether the values of a saved frame hold BROADCAST_BYTES at most: counted, not estimated."""
    width = [F.coalesce(F.octet_length(column(f.name)), F.lit(0)) + 16 if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema.fields]
    per = width[0]
    for w in width[1:]:
        per = per + w
    return (df.agg(F.sum(per.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """rows that are (left_semi) or are not (left_anti) among ids, which must be saved or held, and distinct.  The ids are
    broadcast only if they are measured to be small; else both sides are shuffled."""
    return rows.join(F.broadcast(ids) if is_small(ids) else ids, id_col, how)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """(keys, _k) of the keys that hold more than half of what one task gets on average, and how many parts to deal each into.

    counts: saved or held, one row a key with its number of rows.  There can be at most two such keys a shuffle partition, so that
    the result may be broadcast whatever the size of the data.  None: there is none.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    fair = max(LEAST_HOT, total // (2 * parts))
    hot = counts.filter(F.col(n) > fair).select(*keys, F.ceil(F.col(n) / fair).cast("int").alias("_k"))
    return None if hot.isEmpty() else hot


def dealt(rows: DataFrame, hot: DataFrame | None, keys: list[str], by: str) -> DataFrame:
    """rows with a column _s: rows of a hot key are dealt into its parts by a hash of `by`, all others are in part 0."""
    if hot is None:
        return rows.withColumn("_s", F.lit(0))
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn("_s", F.coalesce(F.pmod(F.xxhash64(by), F.col("_k")).cast("int"), F.lit(0))).drop("_k")


def spread_join(rows: DataFrame, by: DataFrame, keys: list[str], spread: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with `by` (saved or held, one row a key, n: the rows of that key) on keys that are not null.

    Rows of a hot key are dealt over several tasks by `spread`, and by's row for it is repeated in each: one key, however
    large its group, never meets in one task.
    """
    hot = hot_keys(by, keys, n)
    if hot is None:
        return rows.join(by.drop(n), keys, how)
    each = by.drop(n).join(F.broadcast(hot), keys, "left")
    each = each.select(*by.drop(n).columns, F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)).alias("_s"))
    return dealt(rows, hot, keys, spread).join(each, [*keys, "_s"], how).drop("_s")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges: root is the smallest node reachable.  Large-star and small-star
    rounds; each ends in a saved table of at most one row per node and edge that is left.  Minima combine before their
    shuffle, and the joins are plain ones of two numbers a row, which adaptive execution splits where a hub is large."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = saved(e)
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()  # u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
