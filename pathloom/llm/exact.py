"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text (null: empty), A-Z lower-cased, is cut into blocks of BLOCK bytes.  Distinct blocks, deduplicated before the shuffle,
are sorted within their partitions and take their place as an integer name; then names of adjacent pairs take names in the
same way, until each text has one.  Texts of one number of blocks are equal exactly when their names are.

Only the naming of blocks moves text.  A block finds its name by its 64-bit checksum, which is unambiguous unless two
distinct blocks share one: naming sees all distinct blocks, so such checksums are known, and their blocks are joined by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column, held, lower_ascii, saved, spread_join, with_ids

BLOCK = 4096


def _names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, name) for each distinct key of rows: how many rows have it, and its place in the sorted order of its partition,
    partition by partition."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(rid, id, sha, blocks, name) for each row: equal texts, and only they, have equal (blocks, name)."""
    raw = lower_ascii(F.coalesce(column(text_col).cast("string"), F.lit(""))).cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("id"), raw.alias("t"))
    cut = F.expr(f"transform(sequence(0, greatest(0, int((octet_length(t) - 1) div {block}))), i -> substring(t, i * {block} + 1, {block}))")
    rows = base.select("rid", "id", F.sha2("t", 256).alias("sha"), cut.alias("b"))
    rows = rows.select("rid", "id", "sha", F.size("b").alias("blocks"), F.posexplode("b").alias("pos", "block"))
    rows = rows.withColumn("h", F.xxhash64("block"))

    # The hash leads the grouping so that the sort of a partition compares numbers first.
    named = saved(_names(rows, ["h", "block"]).select("h", "n", "name"))
    twice = named.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    head = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("id", "sha")]
    cols = ["rid", "pos", "blocks", *head, "name"]
    slim = rows.select("rid", "pos", "blocks", *head, "h")
    if twice.isEmpty():
        flat = spread_join(slim, named, ["h"], "rid").select("rid", "pos", "blocks", "id", "sha", "name")
    else:
        twice = held(twice)
        again = _names(rows.join(twice, "h"), ["h", "block"]).withColumn("name", -1 - F.col("name"))
        two = spread_join(rows.join(twice, "h"), saved(again), ["h", "block"], "rid").select(*cols)
        once = spread_join(slim, held(named.join(twice, "h", "left_anti")), ["h"], "rid")
        flat = once.select("rid", "pos", "blocks", "id", "sha", "name").unionByName(two)
    flat = saved(flat)

    done = [flat.filter("blocks = 1").select("rid", "id", "sha", "blocks", "name")]
    heads = flat.filter("blocks > 1 and pos = 0").select("rid", "id", "sha", "blocks")
    left, longest = flat.filter("blocks > 1").select("rid", "pos", "name"), flat.agg(F.max("blocks")).first()[0] or 0
    while longest > 1:
        odd = F.col("pos") % 2 == 1
        pairs = left.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("l"), F.max(F.when(odd, F.col("name"))).alias("r"))
        pairs = held(pairs.withColumn("r", F.coalesce("r", F.lit(-(2**63)))))
        left = saved(spread_join(pairs, saved(_names(pairs, ["l", "r"])), ["l", "r"], "rid").select("rid", "pos", "name"))
        longest = (longest + 1) // 2
    if longest:
        done.append(heads.join(left, "rid").select("rid", "id", "sha", "blocks", "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts are one group.  Texts of any length are cut into blocks, never held apart from
    their row.  Of equal texts the row with the largest id stays, of repeated rows one; null ids rank below all others, and a
    group of null ids only keeps one row, with a null keep_id.  An empty table gives no rows.  Other columns, whatever their
    names, are neither read nor returned.  A group's rows are dealt over tasks however many they are.
    """
    rows = saved(identities(docs, id_col, text_col))
    best = rows.groupBy("blocks", "name").agg(F.max(F.struct("id", "rid")).alias("best"), F.count("*").alias("n"))
    best = held(best.select("blocks", "name", F.col("best.id").alias("keep"), F.col("best.rid").alias("first"), F.col("n").alias("size"), "n"))
    out = spread_join(rows, best, ["blocks", "name"], "rid")
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("first")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole, with all columns whatever their names and types.

    Rows that go are found by id and digest of the text.  Of rows that share both and differ elsewhere the one whose JSON
    text sorts first stays, so that reruns agree.  Nulls, empty texts and an empty table: as in exact_duplicates.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    name = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), sha)
    seen = exact_duplicates(docs.select(column(id_col).alias("id"), text.alias("text")), "id", "text").select(name(F.col("id"), F.col("text_sha256")).alias("key"), F.col("kept"))
    by = seen.groupBy("key").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    by = held(by.filter("not stays or n > 1"))
    full = docs.select(F.struct("*").alias("row"), name(column(id_col), F.sha2(lower_ascii(text).cast("binary"), 256)).alias("key"))
    out = with_ids(full, by.select("key"), "key", "left_anti").select("row.*")
    again = by.filter("stays and n > 1").select("key")
    if not again.isEmpty():  # each task hands on one row a key
        out = out.unionByName(with_ids(full, held(again), "key").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return out
