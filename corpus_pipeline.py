"""The corpus pipeline: toxicity filter, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, also columns
that the table has beyond the usual ones, whatever their names.  Nulls may stand in any column, and an empty table passes
through as one; what a stage makes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import column, held, settled, with_ids
from pathloom.llm.exact import without_duplicates
from pathloom.llm.minhash import near_duplicates
from pathloom.llm.mixing import mixed
from pathloom.llm.packing import pack
from pathloom.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts score as empty ones and stay; texts of any length are read whole; repeated rows are scored each for
    itself.  Labels of documents that are not in docs do not train, and without labels nothing goes.
    """
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the row with the largest id stays, whole.

    Null and empty texts are one group.  Null ids rank below all others.  Of repeated rows, and of rows that share id and text
    and differ elsewhere, one stays, the same in every run.
    """
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at 0.75 join, the document with the smallest id stays, whole.

    Null, empty and blank texts and rows with a null id link with nothing and stay.  Rows that share an id stay or go together.
    """
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), column("doc_id").cast("long").alias("id"))
    return with_ids(rows, held(gone), "id", "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its row up to twice, or not at all.

    A null source is a source, the last one.  Documents without words take none of the target and are taken or not by chance.
    Rows that are equal in every column are taken as often as all of them together.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's text, with its sequence and place in it.

    Null and empty texts have one piece, the end mark; longer ones than a sequence are cut.  Repeated rows, which the mix makes,
    are packed each for itself.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]
#: SQL can express neither the learned grammar nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row.  Each is written before the next one reads it; tables that it needed on its way go when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(docs, lambda rows, stage=stage: stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
