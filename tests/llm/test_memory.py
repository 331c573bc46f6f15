import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkContext

from pathloom.llm import common, mixing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_known_stretches_take_few_bytes_each():
    e = tokens.Encoder(PATH)
    e.encode(["warm up"])
    tracemalloc.start()
    try:
        for i in range(6):
            e.encode([" ".join("".join(chr(97 + j // 26**k % 26) for k in range(4)) + chr(97 + i) for j in range(20_000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 6 * 20_000 * 60


def test_ids_are_the_same_when_generations_change(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    e = tokens.Encoder(PATH)
    long = "x" * 300
    for i in range(12):
        texts = [f"Word{k} it's {k * 7}.{i}, the end {long}{k % 3} été\t<" for k in range(i, i + 9)] + ["", None, "a <|b|> c", "  "]
        ids, bounds = e.encode(texts)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


def test_hashes_do_not_depend_on_how_many_bytes_go_at_once():
    raw = b"ab  cd,e " * 50 + b"z" * 90 + b" q"
    a = np.frombuffer(raw, np.uint8)
    kind = tokens._KIND[a]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    starts = np.flatnonzero((kind > 0) & ((before == 0) | (kind != before)))
    whole = tokens.stretch_hashes(a, kind, starts)
    for most in (1, 7, 64):
        assert all((x == y).all() for x, y in zip(whole, tokens.stretch_hashes(a, kind, starts, most)))


def test_the_mix_sends_no_list_through_python_workers(spark, monkeypatch):
    df = spark.sql("select * from values (1L, 'a b c', 's'), (2L, 'd e', null), (3L, null, 't') as t(doc_id, text, source)")

    def parallelize(*_, **__):
        raise AssertionError("a list went through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", parallelize)
    assert mixing.mix(df).count() == 3 and mixing.mix(df.limit(0)).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    with common.text_batches(spark):
        most = max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())
    assert most == common.TEXT_ROWS and spark.conf.get(name) == own
    spark.conf.set(name, 10)
    try:
        with common.text_batches(spark):
            assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, own)
