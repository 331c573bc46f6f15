"""Every operator and stage on nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import common, exact, langid, minhash, mixing, packing, pii, secrets, toxicity, urls

SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType()) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    + [T.StructField(c, T.LongType()) for c in ("n", "low", "sum", "_k", "_id", "_c", "_r", "_i", "_s", "id", "h", "size", "bucket", "row", "key", "name", "kept", "a.b")]
    + [T.StructField("labels", T.MapType(T.StringType(), T.LongType())), T.StructField("spans", T.ArrayType(T.StringType()))]
)
LONG = "wort " * 300_000


def _row(i, text, lang="en", source="s", extra=99):
    return (i, text, lang, source, len(text or ""), *[extra] * 18, {"x": 1}, ["y"])


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        _row(1, None), _row(2, ""), _row(3, " \t\n"), _row(4, "one"), _row(5, "the same text of six words"), _row(6, "The same text of six words"),
        _row(7, "the same text of six words"), _row(8, LONG), _row(9, LONG + "x"), _row(None, "no id at all for this text"), _row(None, "no id at all for this text"),
        _row(10, "a b c d e f g", None, None), _row(11, None, None, None, None), _row(12, "kept as it is", extra=1), _row(12, "kept as it is", extra=2),
    ] + [_row(13, "repeated row with many words in it")] * 5
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def _whole(df):
    return Counter(r["json"] for r in df.select(F.sha2(F.to_json(F.struct("*")), 256).alias("json")).collect())


def test_stages_keep_all_columns(spark, odd, tables):
    cp = pytest.importorskip("corpus_pipeline")
    stage = dict(cp.STAGES)
    clean = stage["toxicity"](spark, odd, tables)
    assert clean.columns == odd.columns and _whole(clean) == _whole(odd)
    exact_ = stage["exact_dedup"](spark, odd, tables)
    got = exact_.collect()
    # Null and empty texts are one group, " \t\n" is another; of ids that are null only one row stays.
    assert Counter(r["doc_id"] for r in got) == Counter([11, 3, 4, 7, 8, 9, None, 10, 12, 13])
    assert [r["a.b"] for r in got if r["doc_id"] == 12] == [1] and exact_.columns == odd.columns and not _whole(exact_) - _whole(odd)
    near = stage["near_dedup"](spark, odd, tables)
    # 5, 6 and 7 are one set; so are 8 and 9 but for a shingle or two of few: all words are the same.
    left = Counter(r["doc_id"] for r in near.collect())
    sets = {8: minhash.sets([LONG])[0], 9: minhash.sets([LONG + "x"])[0]}
    alike = minhash.alike(len(set(sets[8]) & set(sets[9])), len(sets[8]), len(sets[9]), 75)
    assert left == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 1, 10: 1, 11: 1, 12: 2, 13: 5, None: 2} | ({} if alike else {9: 1}))
    assert near.columns == odd.columns and not _whole(near) - _whole(odd)
    mix = stage["source_mix"](spark, odd, tables)
    assert mix.columns == odd.columns and set(_whole(mix)) <= set(_whole(odd))
    plan = mixing.mix(odd).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()
    assert {r["doc_id"]: r["c"] for r in plan if r["c"]} == dict(Counter(r["doc_id"] for r in mix.select("doc_id").collect()))
    pieces = stage["packing"](spark, odd, tables).filter("piece = 0").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


def test_stages_pass_empty_tables_through(spark, odd, tables):
    cp = pytest.importorskip("corpus_pipeline")
    docs = odd.limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0 and (name == "packing" or out.columns == odd.columns)


def test_operators_return_a_row_a_row(spark, odd):
    ids = Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    train = odd.limit(0)
    model = toxicity.train(odd, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    every = {
        "near": minhash.near_duplicates(odd), "exact": exact.exact_duplicates(odd), "pii": pii.find(odd, pii.train(odd)), "secrets": secrets.scan(odd), "toxicity": toxicity.score(odd, model),
        "langid": langid.identify(odd, langid.train(odd)), "mix": mixing.mix(odd), "pack": packing.pack(odd).filter("piece = 0"), "urls": urls.judge(odd, "doc_id", "lang"),
    }
    for name, df in every.items():
        assert Counter(r["doc_id"] for r in df.select("doc_id").collect()) == ids, name
    assert langid.train(train) == {} and pii.train(train) == {} and toxicity.train(train, spark.createDataFrame([], "doc_id long, toxic int")).stems == {}


def test_equal_rows_are_taken_as_often_as_all_together(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1)] * 3000 + [(2, "d e", "s", 2)], "doc_id long, text string, source string, copies long")
    want = mixing.mix(df).agg(F.sum("copies")).first()[0]
    out = mixing.mixed(df)
    assert out.count() == want and out.columns == df.columns and {tuple(r) for r in out.distinct().collect()} <= {(1, "a b c", "s", 1), (2, "d e", "s", 2)}


# ---- what the operators share


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    by = common.saved(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    hot = common.hot_keys(by, ["k"])
    assert [r["k"] for r in hot.collect()] == [0]
    out = common.spread_join(rows, by, ["k"], "id")
    assert out.columns == ["k", "id", "top"] and out.count() == 20_000 and out.filter("k = 0 and top <> 19998").count() == 0
    parts = common.dealt(rows, hot, ["k"], "id").filter("k = 0").groupBy("_s").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 20_000 // 8
    assert common.hot_keys(common.saved(by.filter("n = 1")), ["k"]) is None


def test_broadcasts_go_by_measured_bytes(spark, monkeypatch):
    ids = common.saved(spark.range(1000))
    assert common.is_small(ids) and common.is_small(common.saved(spark.range(0)))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 7999)
    assert not common.is_small(ids)
    assert common.with_ids(spark.range(2000), ids, "id", "left_anti").count() == 1000


def test_tables_go_with_their_scope(spark):
    with common.scope(spark):
        inner = common.saved(spark.range(5))
        assert inner.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(inner.inputFiles()[0]).count()
    out = common.settled(spark.range(7), lambda d: common.saved(d).filter("id > 1"))
    assert out.count() == 5


def test_passages_come_from_the_whole_text(spark):
    text = "".join(f"{i:04d}" for i in range(5000))
    df = spark.createDataFrame([(text,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(common.passages(F.col("t"), 2000)).collect()]
    assert got[1:] == ["short", None] and len(got[0]) == 2003 and got[0][:500] == text[:500] and got[0][-500:] == text[-500:]


def test_sha_of_equal_texts(spark, odd):
    got = {(r["doc_id"], r["text_sha256"]) for r in exact.exact_duplicates(odd).collect()}
    assert (8, hashlib.sha256(LONG.encode()).hexdigest()) in got and (1, hashlib.sha256(b"").hexdigest()) in got
