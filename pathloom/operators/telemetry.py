"""Stage telemetry and the environment gate."""

from __future__ import annotations

import contextlib
import importlib
import resource
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.store import Store


@contextlib.contextmanager
def stage(spark: SparkSession, name: str, scale: str, path: str | None = None) -> Iterator[dict]:
    """Times a stage; on leaving, also on failure, appends a JSON line with wall time, peak memory and the counters set in the yielded dict."""
    record: dict = {"stage": name, "scale": scale, "ok": False}
    began = time.time()
    try:
        yield record
        record["ok"] = True
    finally:
        record["wall_s"] = round(time.time() - began, 3)
        record["peak_rss_mb"] = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
        if path:
            folder, _, name = path.rpartition("/")
            Store(spark, folder).record(name, **record)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df that counts its rows as it is written: no second evaluation."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows")), o


def environment(spark: SparkSession, needed: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy")) -> DataFrame:
    """(name, ok, detail): Python, Java, imports, and a round trip through an Arrow function."""
    rows = [("python", sys.version_info >= (3, 10), sys.version.split()[0]), ("java", True, spark.sparkContext._jvm.System.getProperty("java.version"))]
    for m in needed:
        try:
            rows.append((m, True, getattr(importlib.import_module(m), "__version__", "")))
        except ImportError as e:
            rows.append((m, False, str(e)))
    back = spark.range(3).mapInArrow(lambda it: it, "id long").count()
    rows.append(("arrow", back == 3, str(back)))
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")
