"""Small files and checkpoints on any file system that Spark knows.

A Store is a folder, local or remote, whose small files are read and written whole, as text, lines, rows or JSON records.
"""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def checkpoints(spark: SparkSession) -> None:
    """Sees to it that checkpoints go to the folder that the session names; only a local session may do without one."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="pathloom-")
    spark.sparkContext.setCheckpointDir(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, for files that a query writes and reads again."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table beside the checkpoints: its lineage ends there, as with checkpoint(), but it is worked out
    once, not once to count and once to write.  Tables go when the interpreter ends."""
    spark = df.sparkSession
    path = scratch(spark, "kept")
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended: the folder's owner clears it
        pass


class Store:
    """The small files below one folder.  Names may hold slashes; folders on the way are made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = lambda name: hadoop.fs.Path(f"{self.root}/{name}")
        self._files = hadoop.fs.Path(self.root + "/").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __contains__(self, name: str) -> bool:
        return bool(self._files.exists(self._path(name)))

    def __getitem__(self, name: str) -> str:
        opened = self._files.open(self._path(name))
        try:
            return bytes(opened.readAllBytes()).decode("utf-8")
        finally:
            opened.close()

    def __setitem__(self, name: str, content: str | list[str]) -> None:
        """A text, or lines, each ended."""
        text = content if isinstance(content, str) else "".join(f"{x}\n" for x in content)
        made = self._files.create(self._path(name), True)
        try:
            made.write(bytearray(text.encode("utf-8")))
        finally:
            made.close()

    def record(self, name: str, **values) -> None:
        """One more JSON line at a file's end.  The file is small: it is written anew, as object stores cannot append."""
        self[name] = (self[name] if name in self else "") + json.dumps(values) + "\n"

    def put_rows(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("header", True).csv(f"{self.root}/{name}")

    def rows(self, name: str, schema: T.StructType | str) -> DataFrame:
        """A typed result table; an empty one where there is none."""
        if name not in self:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("header", True).csv(f"{self.root}/{name}")
