import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pathloom.llm import embeddings, exact, langid, minhash, mixing, packing, pii, queries, secrets, shingles, tokens, toxicity, urls
from pathloom.llm.common import components, held_out, held_out_py

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = {k: k + 32 for k in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingle_set(t):
    w = words(t)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOC)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


ODD = [None, "", "  \t\n", "one", "One two three", "one two three", "A b c d e", "a B c d e", "é ü ß Σ", "x" * 5000, "a b " * 3000]


@pytest.fixture(scope="module")
def mixed_texts():
    """Originals, exact copies in other case, near copies of all grades, texts that share passages, and odd ones."""
    r = random.Random(7)
    out = list(ODD)
    passage = prose(r, 60)
    for _ in range(25):
        base = prose(r, r.choice((6, 20, 60, 200)))
        out.append(base)
        for _ in range(r.randint(0, 5)):
            w = base.split()
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = "zz" + str(r.randint(0, 99))
            out.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
        if r.random() < 0.5:
            out.append(prose(r, 30) + " " + passage + " " + prose(r, 30))
    return out


@pytest.fixture(scope="module")
def hot_texts():
    """More near copies of one text than a list or tile holds, some too far from all others, and as many short texts around one passage."""
    r = random.Random(8)
    base, passage = prose(r, 146).split(), prose(r, 60)
    out = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = "q" + str(r.randint(0, 9999))
        out.append(" ".join(w))
    return out + [passage + " " + prose(r, r.randint(5, 60)) for _ in range(120)] + [" ".join(base)] * 100


def brute_near(texts, percent=75):
    sets = [shingle_set(t) for t in texts]
    return [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - i)], sets


@pytest.mark.parametrize("which,tile,limit", [("mixed_texts", 512, 64), ("hot_texts", 512, 64), ("hot_texts", 40, 16)])
def test_near_duplicates_equal_brute_force(spark, request, monkeypatch, which, tile, limit):
    texts = request.getfixturevalue(which)
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "LIST", limit)
    links, sets = brute_near(texts)
    want = roots(range(len(texts)), links)
    got = minhash.near_duplicates(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, None)], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 4 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (1, 1, True), (0, 0, True)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_shingles_of_long_texts_do_not_depend_on_segments(monkeypatch):
    t = prose(random.Random(1), 4000)
    want = shingles.sets([t])[0]
    monkeypatch.setattr(shingles, "_SEGMENT", 3000)
    assert (shingles.shingle_hashes(shingles.word_hashes(t)) == want).all() and len(want) == len(shingle_set(t))


def test_components(spark):
    r = random.Random(2)
    e = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = roots({v for p in e for v in p}, e)
    assert got == {k: v for k, v in want.items() if k in got} and {k for p in e for k in p if p[0] != p[1]} <= set(got)


# ---- vectors


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(3)
    rows, vecs = [], []
    for c in range(30):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12)) if c else 60):
            vecs.append((centre + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32))
    rows = [(i, v.tolist(), int(i % 2) if i % 11 else None) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [None] * 32, 1), (n + 4, [], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    ok = {i: (lab, np.array(v, np.float64)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.93]
    count = Counter(x for p in links for x in p)
    found, wanted = sum(r["n_links"] for r in got.values()), sum(count.values())
    assert all(r["n_links"] <= count[i] for i, r in got.items()) and found >= 0.98 * wanted
    root = roots([r[0] for r in rows], links)
    assert sum(got[i]["component_id"] != root[i] for i in got) <= 2 and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_index_keeps_its_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = embeddings.Index(x, 9, 0.93)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert (ix.codes(x) == ix.codes(y)).any(1).mean() > 0.985
    assert abs((((x - ix.parts[0][0]) @ ix.parts[0][1]) >= 0).mean() - 0.5) < 0.02


def turned(x, cosine, rng):
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("labels", [1, 2])
def test_index_keeps_its_recall_for_vectors_with_a_common_mean(monkeypatch, labels):
    monkeypatch.setattr(embeddings, "ITERATIONS", 5)
    rng = np.random.default_rng(5)
    lab = [str(i % labels) for i in range(6000)]
    means = np.linalg.qr(rng.standard_normal((64, 64)))[0][:labels]
    z = rng.standard_normal((6000, 64))
    z -= (z @ means.T) @ means
    x = np.sqrt(0.72) * means[[int(k) for k in lab]] + np.sqrt(0.28) * z / np.linalg.norm(z, axis=1, keepdims=True)
    ix = embeddings.Index(x, 18, 0.93, labels=lab)
    assert (ix.codes(x, lab) == ix.codes(turned(x, 0.93, rng), lab)).any(1).mean() > 0.99
    assert ix.tables <= embeddings.MOST_TABLES + 64 and ix.width < 18
    # Codes are balanced within each label.
    bits = (ix._centred(x, lab) - ix.parts[0][0]) @ ix.parts[0][1] >= 0
    assert all(abs(bits[[k == c for k in lab]].mean() - 0.5) < 0.05 for c in set(lab))


@pytest.mark.parametrize("indexes", [16, 1])
def test_links_of_mixed_lengths_equal_brute_force(spark, monkeypatch, indexes):
    monkeypatch.setattr(embeddings, "INDEXES", indexes)
    rng = np.random.default_rng(8)
    rows = []
    for dim, pairs in ((16, 400), (64, 300), (128, 300), (24, 20)):
        x = rng.standard_normal((pairs, dim))
        # All that tells the pairs of one length from others lies in the last components.
        x[:, : dim // 2] *= 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(v.tolist(), 1) for v in (*x, *turned(x, 0.935, rng))]
    rows = [(i, *r) for i, r in enumerate(rows)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for dim in (16, 64, 128, 24):
        ids = [i for i, v, _ in rows if len(v) == dim]
        x = np.array([rows[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want = (x @ x.T >= 0.93).sum() - len(x)
        assert 0.98 * want <= sum(got[i] for i in ids) <= want


def test_an_index_that_no_substring_serves_compares_all(monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TABLES", 1)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = embeddings.Index(x, 2, -0.999)
    assert ix.width == 0 and (ix.codes(x) == ix.codes(turned(x, -0.999, rng))).any(1).all()


# ---- spans

EM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def pii_by_rules(t):
    o = [("email", *m.span()) for m in EM.finditer(t)]
    o += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    o += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return o + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def secrets_by_rules(t):
    o = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    o += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    o += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(o, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


PARTS = ["1", "4", "25", "256", "0001", ".", "@", "a.b", "+", "-", " ", "é", "(", "token", "Secret", "api_key", "=", ": ", '"', "0123456789abcdef", "AKIA", "QWER12345678ABCDEF", "abcdefghijkl", "4111111111111111", "+1 (202) 555-0199", "10.0.0.1", "me@x.org"]


def test_base_spans_equal_the_rules():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 18)))
        assert pii.base_spans(t) == pii_by_rules(t), t
        assert [x for x in secrets.spans(t) if x[0] in secrets.BASE] == secrets_by_rules(t), t


@pytest.mark.parametrize("find", [pii.base_spans, secrets.spans])
def test_spans_of_long_runs_take_linear_time(find):
    for t in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "+1 " * 60_000, "token " * 30_000, "@" * 100_000, "1 " * 100_000):
        find(t)


@pytest.mark.parametrize("op", ["pii", "secrets"])
def test_span_queries(spark, op):
    texts = [None, "", "mail me@x.org or me@x.org, 4111 1111 1111 1111", 'token = "0123456789abcdef0123"', "é 10.0.0.1 é"]
    df = docs_of(spark, texts).withColumn("id", F.lit(9)).withColumn("spans", F.lit("x"))
    got = {r["doc_id"]: r for r in (pii.find(df, pii.train(df)) if op == "pii" else secrets.scan(df)).collect()}
    for i, t in enumerate(texts):
        base = (pii_by_rules if op == "pii" else secrets_by_rules)(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[i]["spans"].split(","))
    assert (pii.find(df.limit(0), {}) if op == "pii" else secrets.scan(df.limit(0))).count() == 0


def test_the_field_carries_a_label_to_a_distant_similar_token():
    r = random.Random(5)
    lines = [f"call +1 (202) 555-{r.randint(1000, 9999)} now" for _ in range(60)] + [f"order {r.randint(10**9, 10**10 - 1)} done" for _ in range(60)]
    model = pii.fit([x for t in lines for x in pii.training_rows(t)])
    t = "call +1 (202) 555-0199 now " + "word " * 300 + "again 202 555 0199 please"
    base = pii.base_spans(t)
    assert [k for k, *_ in base] == ["phone"]
    assert [(k, t[s:e]) for k, s, e in pii.added(t, base, model)] == [("phone", "202 555 0199")]
    alone = "word " * 20 + "again 202 555 0199 please"
    assert pii.added(alone, [], model) == []


@pytest.mark.parametrize("lean", [0.1, 1.0, 2.0])
@pytest.mark.parametrize("first,again", [("+1 (202) 555-0199", "202 555 0199"), ("+1 (202) 555-0199", "1 202 555 0199")])
@pytest.mark.parametrize("repeats", [2, 8, 32, 300])
def test_the_field_labels_all_repeats_of_an_observed_number(lean, first, again, repeats):
    model = {"bias": [lean, 0.0, 0.0, 0.0, 0.0]}
    t = first + " word " + f"{again} word " * repeats
    assert pii.added(t, pii.base_spans(t), model) == [("phone", m.start(), m.end()) for m in re.finditer(f"(?<!\\+){again}", t)]
    assert pii.added(f"{again} word " * repeats, [], model) == []


def test_messages_reach_the_end_of_a_long_chain():
    node = np.array([[0.0, 50.0]] + [[0.1, 0.0]] * 40)
    assert pii.messages(node, [(i, i + 1, 8.0) for i in range(40)]).argmax(1).tolist() == [1] * 41


def test_all_keys_of_one_tail_are_compared():
    # In order of appearance: 12025550199, 993335550199 (similar to neither) and 2025550199.
    model = {"bias": [1.0, 0.0, 0.0, 0.0, 0.0]}
    t = "+1 (202) 555-0199 word 993335550199 word 202 555 0199 word"
    assert [(k, t[s:e]) for k, s, e in pii.added(t, pii.base_spans(t), model)] == [("phone", "202 555 0199")]
    t = "me@x.org word aa@y.org word " + " word ".join(f"me (at) h{i} (dot) com" for i in range(20)) + " word"
    assert len([s for s in pii.added(t, pii.base_spans(t), model) if s[0] == "email"]) == 20


def test_transition_scores_equal_exhaustive_search():
    rng = np.random.default_rng(7)
    for _ in range(20):
        node, factor = rng.standard_normal((5, 3)), rng.standard_normal((3, 3)) * 2
        score = {w: sum(node[i, k] for i, k in enumerate(w)) + sum(factor[a, b] for a, b in zip(w, w[1:])) for w in np.ndindex(3, 3, 3, 3, 3)}
        best = pii.messages(node, [], [(i, i + 1) for i in range(4)], factor)
        assert tuple(best.argmax(1)) == max(score, key=score.get)


def test_transitions_are_trained_and_used():
    r = random.Random(11)
    lines = []
    for _ in range(60):
        phones = " and ".join(f"+1 (202) 555-{r.randint(1000, 9999)}" for _ in range(4))
        lines += [phones, " and ".join(str(r.randint(10**9, 10**10 - 1)) for _ in range(4))]
    model = pii.fit([x for t in lines for x in pii.training_rows(t)])
    none, phone = pii.LABELS.index("none"), pii.LABELS.index("phone")
    assert model["after_phone"][phone] > model["after_phone"][none] and model["after_none"][none] > model["after_none"][phone]
    assert model["after_phone"][none] == pytest.approx(model["next_none"][phone])
    # Two observed numbers on either side decide a candidate whose own shape says little.
    m = {"bias": [0.5, 0.0, 0.0, 0.0, 0.0], "after_phone": [0.0, 0.0, 0.0, 0.0, 1.0], "after_none": [1.0, 0.0, 0.0, 0.0, 0.0]}
    t = "+1 (202) 555-0199 word 4445556666 word +1 (303) 555-0111 word"
    assert [(k, t[s:e]) for k, s, e in pii.added(t, pii.base_spans(t), m)] == [("phone", "4445556666")]


def test_messages_make_a_chain_agree():
    node = np.array([[0.0, 6.0], [0.5, 0.0], [0.5, 0.0]])
    assert pii.messages(node, [(0, 1, 3.0), (1, 2, 3.0)]).argmax(1).tolist() == [1, 1, 1]
    assert pii.messages(node, []).argmax(1).tolist() == [1, 0, 0]


def test_checksums_decide():
    body = "abcDEF0123456789abcDEF01234567"
    good = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    assert ("token", 2, 42) in secrets.spans("x " + good) and not [x for x in secrets.spans("x " + good[:-1] + ("0" if good[-1] != "0" else "1")) if x[0] == "token"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0." + "A" * 20
    assert "signed" in {x[0] for x in secrets.spans(jwt)} and "signed" not in {x[0] for x in secrets.spans(jwt.replace("eyJhbGci", "eyJhXXci"))}


# ---- toxicity and language


def test_grammar_states():
    s = toxicity.compose
    assert s([("insult", 2.0)]) == [("plain", 2.0)]
    assert s([("target", 0), ("", 0), ("insult", 2.0)])[0][0] == "aimed"
    assert s([("target", 0), ("negation", 0), ("insult", 2.0)])[0][0] == "negated"
    assert s([("report", 0), ("target", 0), ("insult", 2.0)])[0][0] == "reported"
    assert s([("threat", 0)]) == [] and s([("threat", 0), ("target", 0)]) == [("aimed", toxicity.THREAT_WEIGHT)]
    assert s([("negation", 0)] + [("", 0)] * 6 + [("insult", 2.0)])[0][0] == "plain"


def test_a_clause_is_read_whole():
    m = toxicity.Model(stems={"moron$": 2.0})
    far = " word" * 200
    assert m.evidence("she said" + far + " moron") == pytest.approx(2.0 * toxicity.FACTOR["reported"])
    assert m.evidence("she said moron" + far + " moron") == pytest.approx(4.0 * toxicity.FACTOR["reported"])
    assert m.evidence("she said." + far + " moron") == pytest.approx(2.0)
    assert m.evidence("moron" + far + " she said" + far + " moron. moron") == pytest.approx(2.0 + 2.0 * toxicity.FACTOR["reported"] + 2.0)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / max(1, sum(r["predicted"] for r in got)) > 0.9 and hit / sum(r["toxic"] for r in got) > 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_toxicity_of_odd_rows(spark):
    m = toxicity.fit([(f"you are a moron {i}", 1) for i in range(30)] + [(f"what a fine day {i}", 0) for i in range(60)])
    df = docs_of(spark, [None, "", "you moron, you moron", "fine day", "x" * 100_000])
    got = {r["doc_id"]: r for r in toxicity.score(df, m).collect()}
    assert got[0]["score"] == got[1]["score"] and got[2]["score"] > got[3]["score"]
    assert toxicity.without_toxic(df.limit(0), m).count() == 0 and toxicity.fit([]).score("moron") < 0.7
    assert [r["doc_id"] for r in toxicity.without_toxic(df, m).collect()] == [i for i in range(5) if not got[i]["predicted"]]


def test_held_out_is_crc32(spark):
    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r["h"] == held_out_py(r["id"])


def test_suffix_automaton_and_parse():
    r = random.Random(4)
    for _ in range(40):
        s = [r.randint(1, 3) for _ in range(r.randint(1, 14))]
        t = langid.automaton(s, 8)
        for _ in range(30):
            q = [r.randint(1, 3) for _ in range(r.randint(1, 6))]
            at = 0
            for c in q:
                at = t[at, c] if at >= 0 else -1
            assert (at >= 0) == any(s[i : i + len(q)] == q for i in range(len(s)))


def brute_phrases(text, known):
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        i, n = i + max(1, k), n + 1
    return n


def test_cross_parse_equals_brute_force():
    r = random.Random(6)
    train = {"aa": "".join(r.choice("abc ") for _ in range(200)), "bb": "".join(r.choice("bcd ") for _ in range(200))}
    m = langid.Model(train)
    texts = ["".join(r.choice("abcdx ") for _ in range(r.randint(1, 80))) for _ in range(60)]
    cost = m.costs(texts)
    clean = lambda t: "".join(chr(c) if c else "_" for c in langid.plain(t).tolist())
    for t, row in zip(texts, cost):
        p = clean(t)
        for k, lang in enumerate(m.langs):
            assert row[k] == pytest.approx(brute_phrases(p, clean(train[lang])) * m.bits[k] / len(p))


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_language"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    df = docs_of(spark, [None, "", "12 %", "the thing"])
    assert [r["lang_pred"] for r in langid.identify(df, {"en": "the thing of it"}).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert langid.identify(df, langid.train(df.limit(0))).filter("lang_pred <> 'und'").count() == 0


# ---- urls


def test_url_parts_and_rules(spark):
    cases = ["http://A.example.COM/en/7?x", "https://x.net/de/1", "https://example.net/de/8#t", "b.org/es/", None, "", "ftp://org", "http://notcom/en/", "http://x.com/en/?q", "://h", "http://u.example.com/en/71/a://b", "http://x.com/fr"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("q"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, u in enumerate(cases):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fit)[1] if fit else None)
        if fit:
            assert got[i]["verdict"] == max(fit)[2]
        assert got[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_model_equals_brute_force(spark):
    texts = [("http://a.com/x", 0, 2), ("http://b.com/y", 1, 1), ("http://a.org/z", 0, 1)]
    df = spark.createDataFrame([(i, t, y, w) for i, (t, y, w) in enumerate(texts)], "tid long, text string, y int, w long")
    grams = urls._grams(df, ["tid", "y", "w"])
    counts = grams.groupBy("gram").agg(F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("c0"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("c1"))
    got = {r["gram"]: r["diff"] for r in urls._probabilities(grams.select("gram").distinct(), counts).collect()}
    count = defaultdict(Counter)
    for t, y, w in texts:
        t = urls.START * urls.ORDER + t
        for i in range(urls.ORDER, len(t)):
            for k in range(urls.ORDER + 1):
                count[y, k][t[i - k : i + 1]] += w

    def p(y, gram):
        out = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            h = gram[urls.ORDER - k : urls.ORDER]
            n = sum(c for g, c in count[y, k].items() if g[:-1] == h)
            types = sum(1 for g in count[y, k] if g[:-1] == h)
            if n:
                out = (count[y, k][h + gram[-1]] + types * out) / (n + types)
        return out

    for g, d in got.items():
        assert d == pytest.approx(np.log(p(1, g)) - np.log(p(0, g)))


# ---- packing


def test_tokens_equal_the_tokenizer():
    import public_tokenizers

    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    texts = ODD + ["Don't we'll “!?” äbc 3.14 x<|endoftext|>y <|STARTOFTEXT|>", "ÀÉ ﬁ Σας ΣΑΣ!'s \x1c a\x1fb '' ''' it's''s", "日本語 テスト…!!! #@!'t 12a3 a1'b2", "é!́ ́a !'re ''re 1're"]
    texts += ["".join(r.choice("ab'sS1!é\u0301 \n\u00a0“…") for _ in range(40)) for _ in range(500)]
    ids, at = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tok.encode(t or "", add_special_tokens=False).ids
    long = prose(r, 3000)
    assert "".join(tokens.pieces_of(long, 1000)) == long
    assert np.concatenate([e.encode([p])[0] for p in tokens.pieces_of(long, 1000)]).tolist() == e.tok.encode(long, add_special_tokens=False).ids


def fewest(items, room):
    """The optimum by exhaustive search."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= room and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_packing_is_optimal_on_small_cases(seed):
    r = random.Random(seed)
    items = sorted((r.randint(10, 60) for _ in range(r.randint(1, 11))), reverse=True)
    plan = packing.complete(dict(Counter(items)), 100)
    assert sorted(x for p, t in plan for x in p * t) == sorted(items) and all(sum(p) <= 100 for p, _ in plan)
    assert sum(t for _, t in plan) == fewest(items, 100)


def test_pack_places_every_piece_once(spark):
    r = random.Random(1)
    texts = [*ODD, *(prose(r, r.choice((3, 50, 400, 3000, 9000))) for _ in range(40)), *["same text"] * 30]
    df = docs_of(spark, texts).unionByName(docs_of(spark, texts[:5])).withColumn("piece", F.lit(1))
    rows = packing.pack(df).collect()
    import public_tokenizers

    tok = tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).tok
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    seqs = defaultdict(list)
    for x in rows:
        own = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert x["start"] == 4096 * x["piece"] and len(own) == x["length"] and zlib.crc32(own.tobytes()) == x["ids_crc32"]
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert Counter(x["doc_id"] for x in rows) == Counter(i for k in (range(len(texts)), range(5)) for i in k for _ in range(-(-len(ids[i]) // 4096)))
    bins: list[int] = []
    for n in sorted((x["length"] for x in rows), reverse=True):  # first-fit decreasing is never better
        k = next((i for i, b in enumerate(bins) if b + n <= 4096), None)
        bins.append(n) if k is None else bins.__setitem__(k, bins[k] + n)
    assert len(seqs) <= len(bins)
    assert packing.pack(df.limit(0)).count() == 0


# ---- exact duplicates


@pytest.mark.parametrize("block", [4096, 3])
def test_exact_duplicates(spark, mixed_texts, block):
    texts = [(t or "")[:60] if block == 3 else t for t in mixed_texts]
    ids = exact.identities(docs_of(spark, texts), block=block).collect()
    names = defaultdict(set)
    for r in ids:
        names[(texts[r["id"]] or "").translate(LOW)].add((r["blocks"], r["name"]))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    if block == 3:
        return
    got = {r["doc_id"]: r for r in exact.exact_duplicates(docs_of(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOW)].append(i)
    for t, own in groups.items():
        for i in own:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), i == max(own), hashlib.sha256(t.encode()).hexdigest())


def test_block_names_do_not_trust_checksums(spark, monkeypatch):
    """With a checksum that nearly all blocks share, names still tell texts apart."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda c: F.length(F.col(c)) % 2)
    texts = ["aa", "bb", "aa", "cccc", "dddd", "b", "bb" * 3]
    ids = exact.identities(docs_of(spark, texts), block=2).collect()
    by = defaultdict(set)
    for r in ids:
        by[r["blocks"], r["name"]].add(texts[r["id"]])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(texts))


def test_exact_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "A"), (1, "a"), (1, "b"), (2, "B"), (None, "n"), (None, "N"), (3, None), (4, "")], "doc_id long, text string").withColumn("name", F.lit(0)).withColumn("key", F.lit("k"))
    kept = exact.without_duplicates(df).collect()
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept) == Counter([(1, "a"), (2, "b"), (None, "n"), (4, "")])
    assert exact.exact_duplicates(df).filter("kept").count() == 4 and exact.exact_duplicates(df.limit(0)).count() == 0
    assert kept[0].__fields__ == df.columns


# ---- mixing


def test_targets():
    t = mixing.targets([("b", 100), (None, 50), ("a", 10)])
    assert t["a"] == 20 and t["b"] + t[None] == pytest.approx(220) and t[None] == 100 and t["b"] == pytest.approx(120)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_pivot_keeps_sums_and_expectations():
    x0, size = [0.3, 0.5, 0.7, 0.2, 0.6, 0.9], [900, 500, 400, 90, 80, 10]
    mean = np.zeros(6)
    for s in range(4000):
        x = list(x0)
        mixing.pivot(size, x, np.random.default_rng(s))
        assert sum(0 < v < 1 for v in x) <= 1 and sum(a * b for a, b in zip(size, x)) == pytest.approx(sum(a * b for a, b in zip(size, x0)))
        mean += x
    assert mean / 4000 == pytest.approx(x0, abs=0.03)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(0, 60)), "en", r.choice(["hot"] * 6 + ["a", "b", None]), 0) for i in range(400)] + [(400, None, "en", "nothing", 0), (401, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("size", F.lit(1)).withColumn("x", F.lit(0.5))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda rs: sorted((x["doc_id"], x["size"], x["taken"]) for x in rs)
    assert key(got) == key(again) and len(got) == len(rows)
    by = defaultdict(list)
    source = {i: s for i, _, _, s, _ in rows}
    for x in got:
        assert x["taken"] <= 2 * x["size"]
        by[source[x["doc_id"]]].append(x)
    for s, own in by.items():
        if s != "nothing":
            assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 60
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.groupBy("doc_id").count().agg(F.sum("count")).first()[0] == sum(x["copies"] for x in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_repeats_repeated_rows(spark):
    df = spark.createDataFrame([Row(doc_id=1, text="a b c", source="s")] * 4 + [Row(doc_id=2, text="d e", source="s")])
    plan, out = mixing.mix(df).collect(), mixing.mixed(df).collect()
    assert len(out) == sum(x["copies"] for x in plan)


# ---- pipeline


def test_pipeline_stages_equal_brute_force(spark, mixed_texts, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(i, 1, 0) for i in range(len(mixed_texts))], "doc_id long, quality int, toxic int").write.parquet(str(labels))
    docs = docs_of(spark, mixed_texts)
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "packing"]
    a = stage["toxicity"](spark, docs, str(tmp_path))
    assert a.count() == len(mixed_texts)
    b = stage["exact_dedup"](spark, docs, str(tmp_path))
    last = {(t or "").translate(LOW): i for i, t in enumerate(mixed_texts)}
    left = sorted(last.values())
    assert sorted(r["doc_id"] for r in b.collect()) == left and b.columns == docs.columns
    c = stage["near_dedup"](spark, b, str(tmp_path))
    links, _ = brute_near([mixed_texts[i] for i in left])
    root = roots(range(len(left)), links)
    assert sorted(r["doc_id"] for r in c.collect()) == sorted({left[v] for v in root.values()})
    d = stage["source_mix"](spark, c, str(tmp_path))
    assert d.columns == docs.columns
    e = stage["packing"](spark, d, str(tmp_path))
    assert e.filter("piece = 0").count() == d.count()


def test_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and json.dumps(queries.ORACLE_SQL)
