import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.operators import compare, graph, match, mining, quality, repeats, similarity, sketch
from pathloom.sources import trips as T
from pathloom.sources.store import Store


def corpus(spark, seqs, entity=None):
    rows = [(i, entity(i) if entity else i, s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "id long, entity long, seq array<string>")


def random_seqs(seed, n=40, most=12, letters="abc"):
    r = random.Random(seed)
    return [[r.choice(letters) for _ in range(r.randint(0, most))] for _ in range(n)]


def brute_support(seqs, low, high):
    c = Counter()
    for s in seqs:
        c.update({tuple(s[i : i + n]) for n in range(low, high + 1) for i in range(len(s) - n + 1)})
    return {">".join(k): v for k, v in c.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_support_closed_maximal(spark, seed, parts):
    seqs = random_seqs(seed)
    t = mining.token_support(corpus(spark, seqs).repartition(parts), 1, 6)
    sup = {r["key"]: r["support"] for r in t.collect()}
    assert sup == brute_support(seqs, 1, 6)
    best = defaultdict(int)
    for k, v in sup.items():
        toks = k.split(">")
        for p in (toks[1:], toks[:-1]):
            best[">".join(p)] = max(best[">".join(p)], v)
    assert {r["key"] for r in mining.closed(t).collect()} == {k for k, v in sup.items() if best[k] < v}
    assert {r["key"] for r in mining.maximal(t, 4).collect()} == {k for k, v in sup.items() if v >= 4 and best[k] < 4}
    assert {r["key"] for r in mining.maximal(t, 4).collect()} <= {r["key"] for r in mining.closed(t).collect()}


def test_calibration(spark):
    seqs = random_seqs(3)
    ext = mining.extensions(mining.token_support(corpus(spark, seqs), 1, 6)).cache()
    rows = mining.calibrate(ext, len(seqs), (1, 3), floors=(2, 5, 10, 1000), k=3).collect()
    assert {r["floor"] for r in rows} == {2, 5, 10}
    for b in (1.0, 3.0):
        own = {r["floor"]: (r["routes"], r["chosen"]) for r in rows if r["band"] == b}
        good = [f for f, (n, _) in own.items() if n >= 3]
        assert [f for f, (_, c) in own.items() if c] == [max(good) if good else 2]
    assert mining.calibrate(ext, 1, (1,), floors=(2,)).count() == 0


def test_exact_guard(spark):
    with pytest.raises(C.LimitExceeded):
        mining.exact_top(None, 10, limit=5)


def brute_intervals(strings):
    s = sorted(strings)
    out = set()
    for l in range(len(s)):
        for r in range(l + 1, len(s)):
            h = 0
            while all(len(x) > h for x in s[l : r + 1]) and len({x[h] for x in s[l : r + 1]}) == 1:
                h += 1
            p = s[l][:h]
            if h and (l == 0 or s[l - 1][:h] != p) and (r == len(s) - 1 or s[r + 1][:h] != p):
                out.add((h, l, r))
    return out


@pytest.mark.parametrize("strings", [["aa", "aa"], ["aaaa", "aaab", "aab"], ["abc"], ["abc", "abd", "bcd"], ["a", "ab", "abc"], ["abab", "ab", "ba", "bab"], ["x", "y"], []])
def test_branching_repeats_are_the_intervals_of_sorted_suffixes(strings):
    got = repeats.mine_bucket([(i, i, None, list(s)) for i, s in enumerate(strings)], 2, 1)
    s = sorted(strings)
    assert sorted((len(k.split(">")), n, "".join(k.split(">"))) for k, n, *_ in got) == sorted((h, r - l + 1, s[l][:h]) for h, l, r in brute_intervals(strings))


def brute_repeats(seqs, least, depth=3):
    occ = defaultdict(list)
    for i, s in enumerate(seqs):
        for a in range(len(s)):
            for n in range(depth, len(s) - a + 1):
                occ[tuple(s[a : a + n])].append((i, s[a - 1] if a else None, s[a + n] if a + n < len(s) else None))
    kept = {}
    for k, o in occ.items():
        ids = {x[0] for x in o}
        nxt = {x[2] for x in o}
        if len(ids) >= least and len(o) > 1 and (len(nxt) > 1 or None in nxt):
            kept[k] = (len(ids), o)
    out = {}
    for k, (n, o) in kept.items():
        right = max((m for q, (m, _) in kept.items() if len(q) > len(k) and q[: len(k)] == k), default=0)
        before = defaultdict(set)
        for i, p, _ in o:
            if p is not None:
                before[p].add(i)
        out[">".join(k)] = (n, right, max(map(len, before.values()), default=0))
    return out


@pytest.mark.parametrize("limit", [200_000, 5])
@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_repeats_equal_brute_force(spark, seed, limit):
    seqs = random_seqs(seed, n=30, most=10, letters="ab")
    got = repeats.mine(corpus(spark, seqs, entity=lambda i: i % 7), 2, bucket_limit=limit).collect()
    assert len({r["key"] for r in got}) == len(got)
    mine = {r["key"]: r["support"] for r in got}
    want = brute_repeats(seqs, 2)
    assert mine == {k: v[0] for k, v in want.items()}
    assert all(r["support_entities"] <= r["support"] for r in got)
    if limit > 5:
        assert {r["key"]: (r["support"], r["best_right"], r["best_left"]) for r in got} == want


def test_automaton_equals_brute_force():
    r = random.Random(11)
    for _ in range(400):
        pats = [tuple(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 5))]
        text = [r.choice("abcde") for _ in range(r.randint(0, 15))]
        want = {i for i, p in enumerate(pats) if any(tuple(text[a : a + len(p)]) == p for a in range(len(text)))}
        assert match.PatternTrie(pats).matches(text) == want


def test_containment_support(spark):
    c = corpus(spark, [["a", "b", "c"], ["b", "c"], [], ["c", "b"]])
    p = spark.createDataFrame([("x", ["b", "c"]), ("y", ["z"])], "pattern_id string, tokens array<string>")
    assert {r["pattern_id"]: r["support"] for r in match.containment_support(c, p).collect()} == {"x": 2}


@pytest.mark.parametrize("edges,want", [([(0, 1), (0, 2), (0, 3)], [[0, 1, 2, 3]]), ([(0, 1), (1, 2), (2, 3), (3, 4)], [[1, 0, 2]]), ([(0, 1)], [])])
def test_star_clusters(spark, edges, want):
    df = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")
    got = defaultdict(set)
    for r in similarity.star_clusters(df).collect():
        got[r["cid"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def brute_stars(edges, least):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    gone, out = set(), {}
    for v in sorted(near, key=lambda x: (-len(near[x]), x)):
        own = {v} | (near[v] - gone)
        if v not in gone and len(own) >= least:
            out[v] = own
            gone |= own
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("seed", [1, 2])
def test_star_clusters_equal_brute_force(spark, seed, kind):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(55)}
    edges = [(f"n{a:02d}", f"n{b:02d}") if kind == "string" else (a, b) for a, b in edges]
    got = defaultdict(set)
    for x in similarity.star_clusters(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect():
        got[x["cid"]].add(x["node"])
    assert got == brute_stars(edges, 3)


def brute_longest(members, least):
    held = defaultdict(set)
    for i, m in enumerate(members):
        for s in m:
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    held[tuple(s[a:b])].add(i)
    good = [(-len(k), -len(v), k) for k, v in held.items() if len(v) >= least]
    return min(good)[2] if good else ()


def test_longest_shared_run_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        members = [[[r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 5))]
        least = r.randint(1, 3)
        assert similarity.longest_shared_run(members, least) == brute_longest(members, least)


def test_lsh_pairs_are_those_that_share_a_bucket(spark):
    import hashlib

    r = random.Random(4)
    sets = {i: {r.choice("abcdefghijkl") for _ in range(r.randint(1, 9))} for i in range(40)}
    sets |= {100 + i: set(sets[i % 4]) for i in range(12)}
    hashes = {i: [min(hashlib.sha256(x.encode()).hexdigest()[12 * t : 12 * t + 12] for x in s) for t in range(5)] for i, s in sets.items()}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): 1 - jac(a, b) for a in sets for b in sets if a < b and jac(a, b) >= 0.7 and any(x == y for x, y in zip(hashes[a], hashes[b]))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sh array<string>")
    got = {(x["a"], x["b"]): x["distance"] for x in similarity.lsh_pairs(df).collect()}
    assert set(got) == set(want) and got == pytest.approx(want)


def test_shared_runs_count_members_not_segments(spark):
    one_trip = [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "c"]]
    assert similarity.longest_shared_run([one_trip], 2) == ()
    assert similarity.longest_shared_run([[["x", "a", "b", "c"]], [["a", "b", "c", "y"]], [["q"]]], 2) == ("a", "b", "c")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_pairs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    sets = {i: {r.choice("abcdefgh") for _ in range(r.randint(1, 6))} for i in range(25)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sh array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(x["a"], x["b"]) for x in similarity.jaccard_pairs(df, 0.6).collect()} == want


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("a", "c", 1), ("d", "a", 2)], "f string, t string, w long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(15):
        lost = rank["c"]
        rank = {n: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(rank[f] * w / {"a": 4, "b": 1, "d": 2}[f] for f, t, w in (("a", "b", 3), ("b", "c", 1), ("a", "c", 1), ("d", "a", 2)) if t == n) for n in "abcd"}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(rank)
    assert [r["node"] for r in graph.dangling(e).collect()] == ["c"]


def test_heavy_paths_follow_the_flow(spark):
    e = spark.createDataFrame([("a", "b", 9), ("b", "c", 8), ("b", "x", 5), ("c", "d", 6), ("z", "a", 7), ("q", "r", 1)], "f string, t string, w long")
    keys = {r["key"] for r in graph.heavy_paths(e).collect()}
    assert "z>a>b>c>d" in keys and not any("q" in k for k in keys)


def brute_paths(edges, least_w, seeds, least_share, most):
    """The rule, edge by edge."""
    e = {(f, t): (w, km) for f, t, w, km in edges if w >= least_w}
    out = set()
    for f, t in [k for k, _ in sorted(e.items(), key=lambda x: (-x[1][0], x[0]))][:seeds]:
        path, km = [f, t], e[f, t][1]
        for ahead in (True, False):
            while True:
                end = path[-1] if ahead else path[0]
                ways = {k: v for k, v in e.items() if k[0 if ahead else 1] == end}
                new = [(v[0], k[1 if ahead else 0], v[1]) for k, v in ways.items() if k[1 if ahead else 0] not in path]
                if not new or max(new)[0] < least_share * sum(v[0] for v in ways.values()) or km + max(new)[2] > most:
                    break
                km += max(new)[2]
                path = [*path, max(new)[1]] if ahead else [max(new)[1], *path]
        out.add(">".join(path))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_heavy_paths_equal_brute_force(spark, seed):
    r = random.Random(seed)
    edges = {(f, t): (r.randint(3, 30), float(r.randint(1, 4))) for f in "abcdefgh" for t in "abcdefgh" if f != t and r.random() < 0.35}
    rows = [(f, t, w, km) for (f, t), (w, km) in edges.items()]
    got = graph.heavy_paths(spark.createDataFrame(rows, "f string, t string, w long, km double"), 5, 20, 0.4, 12.0).collect()
    assert {x["key"] for x in got} == brute_paths(rows, 5, 20, 0.4, 12.0) and all(x["n"] == x["key"].count(">") + 1 for x in got)


def test_neighbours_of_a_route(spark):
    c = corpus(spark, [["x", "a", "b", "y", "a", "b"], ["a", "b", "c"], ["z", "a", "b"], ["aa", "b"]])
    routes = spark.createDataFrame([("a>b",)], "key string")
    assert {(r["id"], r["before"], r["after"]) for r in match.neighbours(c, routes).collect()} == {(0, "x", "y"), (1, None, "c"), (2, "z", None)}


def test_sketches(spark):
    rows = spark.createDataFrame([(f"k{i % 7 * (i % 3)}", i % 3 + 1) for i in range(2000)], "key string, n int")
    exact = rows.groupBy("key").agg(F.count("*").alias("support"))
    top = sketch.heavy_hitters(rows, k=5)
    for r in sketch.recounted(top, rows).collect():
        assert r["estimate"] == r["support"]
    est = sketch.count_min_estimates(exact, sketch.count_min(rows)).join(exact, "key").collect()
    assert all(r["estimate"] >= r["support"] for r in est)
    # A narrow sketch, where rows collide: the same estimates as Spark's own.
    words = spark.createDataFrame([(f"key {i * 7919 % 400} é",) for i in range(3000)], "key string")
    narrow = sketch.count_min(words, eps=0.05)
    jvm = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(narrow))
    got = sketch.count_min_estimates(words.distinct(), narrow).collect()
    assert len(got) == 400 and all(r["estimate"] == jvm.estimateCount(r["key"]) for r in got)
    assert sketch.accuracy(top, exact.orderBy(F.desc("support"), "key").limit(5)).first()["recall"] == 1.0


def test_quality_rules_keep_three_valued_logic(spark):
    raw = spark.createDataFrame([("1", "False", "[]"), ("2", "False", None), ("3", "False", "[[oops"), ("4", "False", "[[-8.6,41.15],[-8.6,41.16]]"), ("5", "True", "[[-8.6,41.15],[-9.9,41.16]]")], "TRIP_ID string, MISSING_DATA string, POLYLINE string").withColumn("TIMESTAMP", F.lit(0).cast("long"))
    r = quality.rejections(quality.flags(quality.parse(raw))).first().asDict()
    assert r == {"total": 5, "missing": 1, "too_few": 3, "too_many": 0, "off_map": 1, "valid": 1}


def test_features_of_short_trips(spark):
    t = spark.createDataFrame([(1, [(-8.6, 41.15)]), (2, [(-8.6, 41.15), (-8.6, 41.15)]), (3, [(-8.6, 41.15), (-8.5, 41.15)])], "id long, points array<struct<lon:double,lat:double>>")
    got = {r["id"]: r for r in quality.features(t).collect()}
    assert got[1]["total_distance_km"] is None and got[2]["sinuosity"] is None and got[2]["is_too_short"]
    assert got[3]["is_teleport"] and got[3]["is_too_fast"]


def test_anomaly_fences_of_nothing_are_infinite(spark):
    t = spark.createDataFrame([], "id long, points array<struct<lon:double,lat:double>>")
    assert quality.fences(quality.features(t)).first()["fence_km"] == float("inf")


def test_scaling_and_power_law(spark):
    runs = spark.createDataFrame([("a", 2, "s", 12 + 150.0), ("b", 4, "s", 12 + 75.0)], "run_id string, workers int, stage string, wall_s double")
    r = {x["run_id"]: x for x in compare.scaling(runs).collect()}
    assert r["a"]["serial_fraction"] is None and r["b"]["serial_fraction"] == pytest.approx(12 / 162)
    p = spark.createDataFrame([(float(x), 3.0 * x**1.5) for x in (1, 2, 4, 8)], "x double, y double")
    f = compare.power_law(p).first()
    assert (f["a"], f["b"], f["r2"]) == pytest.approx((3.0, 1.5, 1.0))
    assert compare.power_law(p.limit(2)).first()["b"] is None


def test_buckets_medians_supports(spark):
    h = {r["h"]: r["b"] for r in spark.range(24).select(F.col("id").alias("h"), compare.hour_bucket(F.col("id")).alias("b")).collect()}
    assert h[0] == "night" and h[6] == "morning_peak" and h[23] == "evening" and None not in h.values()
    m = compare.upper_median(spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)], "k string, n int"), ["k"], "n").first()
    assert m["median"] == 3
    assert C.min_support_for(0.5, 1000) == 5 and C.min_support_for(0.5, 10) == 2 and C.percent_of(1, 0) == 0.0


def test_paths_and_scales():
    assert C.join_path("gs://b/x/", "y", "z") == "gs://b/x/y/z" and C.join_path("/a", "b") == "/a/b"
    assert C.data_paths("/d", "mid").clean == "/d/clean_mid"
    with pytest.raises(ValueError):
        C.data_paths("/d", "huge")


@pytest.mark.parametrize("text", ["plain", "áé → ü", "", "x" * 50_000, "line\n"])
def test_small_files(spark, tmp_path, text):
    store = Store(spark, f"file://{tmp_path}")
    assert "a/b.txt" not in store
    store["a/b.txt"] = text
    assert "a/b.txt" in store and store["a/b.txt"] == text
    store["lines"] = ["x", text.replace("\n", "")]
    assert store["lines"] == "x\n" + text.replace("\n", "") + "\n"
    store.record("l.jsonl", a=1)
    store.record("l.jsonl", a=2)
    assert store["l.jsonl"] == '{"a": 1}\n{"a": 2}\n'


def test_result_tables_are_typed_and_may_be_missing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    schema = "subroute string, length_km double"
    assert store.rows("none", schema).count() == 0
    store.put_rows("routes", spark.createDataFrame([("a>b", 1.5), ("a>b", 1.5), ("c>d", 0.5)], schema))
    got = store.rows("routes", schema)
    assert got.dtypes == [("subroute", "string"), ("length_km", "double")]
    assert [r["subroute"] for r in T.distinct_routes(got, 1.0).collect()] == ["a>b"]


def test_raw_trips_survive_csv(spark, tmp_path):
    raw = spark.createDataFrame([("1", "A", 20, 1372636858, "False", "[[-8.6,41.15],[-8.61,41.16]]"), ("2", "B", 21, 1372636859, "True", "[]")], "TRIP_ID string, CALL_TYPE string, TAXI_ID long, TIMESTAMP long, MISSING_DATA string, POLYLINE string")
    T.write_sample_csv(raw, f"file://{tmp_path}/csv", 2)
    back = T.read_raw(spark, f"file://{tmp_path}/csv")
    assert back.columns == T.RAW_SCHEMA.names and sorted(map(tuple, back.select(raw.columns).collect())) == sorted(map(tuple, raw.collect()))
    assert back.filter("ORIGIN_CALL is null and DAY_TYPE is null").count() == 2


def test_sampling_does_not_depend_on_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "TRIP_ID")
    a = {r[0] for r in T.sample_rows(df, 50).collect()}
    assert a == {r[0] for r in T.sample_rows(df.repartition(9), 50).collect()} and len(a) == 50
    assert 60 < T.sample_share(df, 100, 1000).count() < 140 and T.sample_share(df, 2000, 1000).count() == 1000


def test_miners_are_compared_over_all_sequences(spark):
    from pathloom.plans import registry
    from pathloom.sources import derived

    sf = "/root/testdata/sf0.001"
    holds = {}
    for r in derived.event_sequences(spark, sf, weekly=True).collect():
        for n in range(3, 9):
            for i in range(len(r["seq"]) - n + 1):
                holds.setdefault(">".join(r["seq"][i : i + n]), set()).add(r["id"])
    best = sorted(((len(v), k) for k, v in holds.items()), key=lambda x: (-x[0], x[1]))[:40]
    windows, suffixes = registry._miners(spark, sf)
    assert [(r["support"], r["key"]) for r in windows.collect()] == best
    mined = {r["key"]: r["support"] for r in suffixes.collect()}
    assert len(mined) == 40 and all(len(holds[k]) == n for k, n in mined.items() if k.count(">") < 8)
    got = registry.QUERIES["exact_recall_miners"](spark, sf).first()
    assert (got["total"], got["found"], got["mismatched"]) == (40, len(set(mined) & {k for _, k in best}), 0)
    assert registry.QUERIES["method_overlap_miners"](spark, sf).first()["total"] == 40


def _line(q, r, n, dq=1, dr=0):
    return [f"{q + i * dq}_{r + i * dr}" for i in range(n)]


def test_planted_corridors_are_found_once_and_without_gaps(spark):
    """Twenty and twelve trips over two corridors of their own, and a trip whose cells jump over a gap in the first one."""
    a, b = _line(0, 0, 12), _line(0, 40, 9)
    seqs = [[f"{100 + i}_{200 + i}"] + a + [f"{300 + i}_{i}"] for i in range(20)]
    seqs = [x[1:-1] if i % 2 else x for i, x in enumerate(seqs)] + [list(b) for _ in range(12)] + [a[:5] + _line(60, 0, 5) + a[5:]]
    rows = spark.createDataFrame([(i, i % 7, s) for i, s in enumerate(seqs)], "id long, entity long, cells array<string>")
    got = {r["key"]: r for r in similarity.corridors(rows).collect()}
    assert set(got) == {">".join(a), ">".join(b)}
    assert got[">".join(a)]["support"] == 20 and got[">".join(b)]["support"] == got[">".join(b)]["members"] == 12
    assert got[">".join(a)]["n"] == 12 and got[">".join(a)]["length_km"] == pytest.approx(11 * 3**0.5 * C.HEX_EDGE_KM, rel=0.01)
    assert similarity.corridors(rows.filter("id in (0, 30)")).count() == 0
    # A smaller sample counts support over all trips.
    some = similarity.corridors(rows, cap=16).collect()
    assert all(r["support"] == got[r["key"]]["support"] for r in some if r["key"] in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_trip_repeats_keep_length_and_revisits(spark, seed):
    r = random.Random(seed)
    seqs = []
    for _ in range(25):
        at = [0, 0]
        s = ["0_0"]
        for _ in range(r.randint(2, 14)):
            at[r.randint(0, 1)] += r.choice((-1, 1))
            s.append(f"{at[0]}_{at[1]}")
        seqs.append(s)
    keep = repeats.trip_guard()
    every = repeats.mine(corpus(spark, seqs), 2).collect()
    want = {x["key"]: (x["support"], x["best_left"]) for x in every if keep(x["key"].split(">"))}
    for limit in (200_000, 5):
        got = repeats.mine(corpus(spark, seqs), 2, trips=True, bucket_limit=limit).collect()
        assert {x["key"]: (x["support"], x["best_left"]) for x in got} == want and want
        if limit > 5:
            assert all(x["best_right"] == max((s for k, (s, _) in want.items() if k.startswith(x["key"] + ">")), default=0) for x in got)


def test_run_tiers(spark):
    cols = "key string, support long, n int, length_km double"
    base = spark.createDataFrame([("a>b", 100, 2, 1.0), ("b>c", 50, 2, 1.0), ("x>y", 10, 2, 1.0)], cols)
    run = spark.createDataFrame([("a>b", 100, 2, 1.0), ("b>c", 49, 2, 5.0), ("p>q", 10, 2, None)], cols)
    got = {(r["tier"], r["name"]): (r["ok"], r["differing"]) for r in compare.run_tiers(run, base).collect()}
    assert got == {("exact", "keys"): (False, 2), ("exact", "support"): (False, 1), ("close", "support"): (False, 1), ("loose", "partners"): (True, 1), ("sane", "lengths"): (False, 1), ("sane", "hops"): (False, 1)}
    assert all(r["ok"] for r in compare.run_tiers(base, base).collect())


def test_null_walks_follow_observed_steps(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "f string, t string")
    got = compare.null_walks(e, [3, 5, 2, 4]).collect()
    steps = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}
    assert len(got) == 4 and all(set(zip(r["tokens"], r["tokens"][1:])) <= steps for r in got)
    assert all(len(r["tokens"]) == n or r["tokens"][-1] == "d" for r, n in zip(sorted(got, key=lambda r: int(r["pattern_id"])), [3, 5, 2, 4]))
    assert sorted(map(str, compare.null_walks(e.repartition(5), [3, 5, 2, 4]).collect())) == sorted(map(str, got))


def test_geohash_centres_lie_in_their_cells(spark):
    df = spark.createDataFrame([(-8.62, 41.15), (10.4, 57.6), (-179.9, -89.9), (0.0, 0.0)], "lon double, lat double")
    from pathloom.functions import geo

    for p in (1, 5):
        cell = geo.geohash(F.col("lon"), F.col("lat"), p)
        c = geo.geohash_centre(cell)
        for r in df.select("lon", "lat", cell.alias("c"), c["lon"].alias("x"), c["lat"].alias("y"), geo.geohash(c["lon"], c["lat"], p).alias("again")).collect():
            assert r["again"] == r["c"] and abs(r["x"] - r["lon"]) <= 360 / 2 ** ((5 * p + 1) // 2) and abs(r["y"] - r["lat"]) <= 180 / 2 ** (5 * p // 2)


def test_leaks_and_drops(spark):
    from pathloom.operators import encoding

    feats = spark.createDataFrame([(1, True, False), (2, False, False), (3, None, None), (4, False, True)], "id long, is_teleport boolean, is_idle boolean")
    feats = feats.selectExpr("*", "false AS is_too_fast", "false AS is_too_short", "false AS is_offgrid").withColumn("is_anomalous", F.col("is_teleport") | F.col("is_idle"))
    assert encoding.drops(feats).first().asDict() == {"trips": 4, "is_teleport": 1, "is_idle": 1, "is_too_fast": 0, "is_too_short": 0, "is_offgrid": 0, "encoded": 2}
    assert encoding.leaked(feats.select("id").filter("id < 4"), feats).first().asDict() == {"encoded": 3, "leaked": 1}


def _sets_with_copies(seed, letters):
    r = random.Random(seed)
    sets = {i: {r.choice(letters) for _ in range(r.randint(1, 9))} for i in range(40)}
    return sets | {100 + i: set(sets[r.randrange(8)]) for i in range(20)} | {200 + i: {"only", "copies"} for i in range(4)}


def _jaccard_edges(sets, least):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


@pytest.mark.parametrize("seed", [5, 6])
def test_clusters_of_classes_are_those_of_all_members(spark, seed):
    """Without a pair of copies: sets meet by prefixes, equal ones as one class, four copies alone are a cluster."""
    sets = _sets_with_copies(seed, "abcdefghijkl")
    pairs, member = similarity.jaccard_classes(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sh array<string>"), 0.6)
    cid = {x["id"]: x["cid"] for x in member.collect()}
    assert cid == {i: min(k for k in sets if sets[k] == sets[i]) for i in sets}
    assert {(x["a"], x["b"]) for x in pairs.collect()} == {(a, b) for a, b in _jaccard_edges(sets, 0.6) if cid[a] == a and cid[b] == b and sets[a] != sets[b]}
    got = defaultdict(set)
    for x in similarity.class_clusters(pairs, member).collect():
        got[x["cid"]].add(x["node"])
    assert got == brute_stars(_jaccard_edges(sets, 0.6), 3) and got[200] == {200, 201, 202, 203}


def test_candidate_pairs_move_each_set_once(spark):
    """Sixty sets that are all alike: 1,770 pairs, verified in one tile that has each set once."""
    sets = {i: {f"w{k}" for k in range(40)} | {f"x{i}"} for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "cid long, sh array<string>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    got = similarity._similar(pairs, df, 0.9)
    assert got.count() == 1770 and got.filter("abs(jaccard - 40 / 42d) > 1e-12").count() == 0
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString() and got.select("a").distinct().count() == 59


@pytest.mark.parametrize("seed", [7, 8])
def test_bits_tell_the_same_pairs_as_prefixes(spark, seed):
    """Few shingles: sets are compared as bits, copies as one class, without a join on shingles that all share."""
    sets = _sets_with_copies(seed, "abcdefgh")
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sh array<string>")
    got = similarity.jaccard_pairs(df, 0.6)
    assert {(x["a"], x["b"]) for x in got.collect()} == _jaccard_edges(sets, 0.6)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_exact_top_beyond_its_guard_is_whole(spark, monkeypatch):
    from pathloom.plans.registry import QUERIES

    want = sorted(map(tuple, QUERIES["exact_top_guarded"](spark, "/root/testdata/sf0.001").collect()))
    guarded = mining.exact_top
    monkeypatch.setattr(mining, "exact_top", lambda seg, n: guarded(seg, n, limit=5))
    assert want and sorted(map(tuple, QUERIES["exact_top_guarded"](spark, "/root/testdata/sf0.001").collect())) == want


def test_top_windows_are_those_of_all_windows(spark):
    """Two segments an id, copies, cells entered too often, and windows cut off in one trip and not in another."""
    r = random.Random(9)
    walk = lambda n: [f"{q}_{r.randint(0, 1)}" for q in (r.randint(0, 3) for _ in range(n))]
    rows = [(i, i % 5, k, w, [1.5 * x for x in range(len(w))]) for i in range(12) for k in range(2) for w in [walk(r.randint(2, 60))]]
    rows += [(i + 100, e + 3, k, w, c) for i, e, k, w, c in rows if i < 6]
    seg = spark.createDataFrame(rows, "id long, entity long, seg int, cells array<string>, cum array<double>")
    cols = ["band", "key", "support", "support_entities", "n", "rank"]
    want = mining.banded_top(mining.support(mining.km_windows(seg)).filter("not truncated").withColumn("length_km", F.round("length_km", 6))).select(cols)
    got = mining.top_windows(seg, digits=6).select(cols)
    assert want.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_star_rounds_and_the_last_edges_give_the_same_clusters(spark, seed, monkeypatch):
    """All turns in one task, all in rounds, and some of both; nodes with members of their own, named by structs."""
    sets = _sets_with_copies(seed, "abcdefghijkl")
    want = brute_stars(_jaccard_edges(sets, 0.6), 3)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, sh array<string>")
    pairs, member = similarity.jaccard_classes(df, 0.6)
    name = lambda c: F.struct(F.lit(7).alias("cap"), F.col(c).alias("id"))
    named = pairs.select(name("a").alias("a"), name("b").alias("b")), member.select(name("cid").alias("cid"), "id")
    for last in (0, 12, 200_000):
        monkeypatch.setattr(similarity, "LAST", last)
        for p, m in ((pairs, member), named):
            got = defaultdict(set)
            for x in similarity.class_clusters(p, m).collect():
                got[x["cid"]["id"] if p is not pairs else x["cid"]].add(x["node"])
            assert got == want


def test_crowded_buckets_make_no_pairs_of_unlike_sets(spark, monkeypatch):
    """All sets share the least hash, so that each pair has a bucket in common: bits leave those few that may be alike."""
    import hashlib

    monkeypatch.setattr(similarity, "BLOCK", 16)  # buckets are compared as tiles
    least = min((f"w{k}" for k in range(5000)), key=lambda w: hashlib.sha256(w.encode()).hexdigest())
    r = random.Random(3)
    sets = {i: {least} | {f"w{r.randrange(5000)}" for _ in range(r.choice((3, 9, 70, 300)))} for i in range(90)}
    sets |= {100 + i: sets[i] | {f"new{i}"} for i in range(60)}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): 1 - jac(a, b) for a in sets for b in sets if a < b and jac(a, b) >= 0.7}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "cid long, sh array<string>")
    near = {(x["a"], x["b"]) for x in similarity._bucket_pairs(similarity.sketches(df), 0.7).collect()}
    assert set(want) <= near and len(near) < 2 * len(want)
    got = {(x["a"], x["b"]): x["distance"] for x in similarity.lsh_pairs(df.withColumnRenamed("cid", "id")).collect()}
    assert set(got) == set(want) and got == pytest.approx(want)


def test_corridors_of_several_caps_are_those_of_each(spark):
    from pathloom.operators import encoding
    from pathloom.sources import derived as D

    rows = encoding.encode(D.trips(spark, "/root/testdata/sf0.01")).select("id", "entity", "cells")
    caps = [300, 10_000]
    both = similarity.corridors_by_cap(rows, caps).collect()
    for cap in caps:
        assert sorted(tuple(x)[1:] for x in both if x["cap"] == cap) == sorted(map(tuple, similarity.corridors(rows, cap).collect()))
    assert {x["cap"] for x in both} >= {10_000}
