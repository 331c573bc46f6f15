import math

import pytest
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions import geo
from pathloom.functions import sequences as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def pts(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in xy])


def py_hav(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * C.EARTH_RADIUS_KM * math.asin(math.sqrt(a))


def test_haversine(spark):
    v = one(spark, geo.haversine_km(F.lit(-8.61), F.lit(41.14), F.lit(-8.6), F.lit(41.16)))
    assert v == pytest.approx(py_hav(-8.61, 41.14, -8.6, 41.16), rel=1e-12)
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(41.0), F.lit(-8.0), F.lit(41.0))) is None


@pytest.mark.parametrize("to,deg", [((0.0, 1.0), 0), ((1.0, 0.0), 90), ((0.0, -1.0), 180), ((-1.0, 0.0), 270)])
def test_bearing(spark, to, deg):
    assert one(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(to[0]), F.lit(to[1]))) == pytest.approx(deg, abs=1e-9)


def test_hexagon_is_the_nearest_centre(spark):
    for lon, lat in ((-8.62, 41.15), (-8.6137, 41.1533), (-8.7, 41.08), (-8.5001, 41.29)):
        cell = one(spark, geo.hex_cell(F.lit(lon), F.lit(lat)))
        q, r = map(int, cell.split("_"))

        def away(q, r):
            x, y = (q * math.sqrt(3) + r * math.sqrt(3) / 2) * C.HEX_EDGE_KM, r * 1.5 * C.HEX_EDGE_KM
            px, py = (lon - geo.LON0) * geo.KM_PER_DEG * geo.COS0, (lat - geo.LAT0) * geo.KM_PER_DEG
            return math.hypot(px - x, py - y)

        assert away(q, r) == min(away(q + i, r + j) for i in (-1, 0, 1) for j in (-1, 0, 1))


@pytest.mark.parametrize("lon,lat,p,want", [(-5.603, 42.605, 5, "ezs42"), (10.40744, 57.64911, 11, "u4pruydqqvj"), (-8.62, 41.15, 6, None)])
def test_geohash(spark, lon, lat, p, want):
    got = one(spark, geo.geohash(F.lit(lon), F.lit(lat), p))
    assert len(got) == p and (want is None or got == want)


def test_compact(spark):
    assert one(spark, S.compact(arr("a", "a", "b", "b", "a"))) == ["a", "b", "a"]
    assert one(spark, S.compact(arr())) == []


@pytest.mark.parametrize("seq,ok", [(["a", "b", "a"], True), (["a", "b", "a", "b", "a"], False), ([], True)])
def test_revisits(spark, seq, ok):
    assert one(spark, S.revisits_ok(arr(*seq))) is ok


def test_split_at_gaps(spark):
    hops = F.array(*map(F.lit, (0.3, 5.0, 0.3, 9.0)))
    assert one(spark, S.split_at_gaps(arr("a", "b", "c", "d", "e"), hops, 1.0)) == [["a", "b"], ["c", "d"]]
    assert one(spark, S.split_at_gaps(arr("a"), F.array().cast("array<double>"), 1.0)) == []


def test_a_window_never_spans_a_gap(spark):
    cells = arr("0_0", "1_0", "9_0", "10_0")
    df = spark.range(1).select(F.lit(1).alias("id"), F.lit(1).alias("entity"), cells.alias("cells"))
    from pathloom.operators.encoding import segments

    parts = [r["cells"] for r in segments(df).collect()]
    assert parts == [["0_0", "1_0"], ["9_0", "10_0"]]


def test_windows_km(spark):
    cum = F.array(*map(F.lit, (0.0, 0.6, 1.2, 1.8)))
    got = one(spark, S.windows_km(arr("a", "b", "c", "d"), cum, 1.0, 1.3))
    assert sorted((w["key"], round(w["length_km"], 3), w["n"], w["truncated"]) for w in got) == [("a>b>c", 1.2, 3, True), ("b>c>d", 1.2, 3, False)]


def test_ngrams_and_windows(spark):
    assert one(spark, S.ngrams(arr("a", "b", "a", "b"), 2)) == ["a>b", "b>a"]
    assert one(spark, S.ngrams(arr("a"), 2)) == []
    got = {(w["key"], w["n"]) for w in one(spark, S.windows_up_to(arr("a", "b", "c"), 2, 5))}
    assert got == {("a>b", 2), ("b>c", 2), ("a>b>c", 3)}


def test_suffixes(spark):
    got = one(spark, S.suffixes(arr("a", "b", "c", "d")))
    assert [(s["bucket"], s["prev"], s["suffix"]) for s in got] == [("a>b>c", None, ["a", "b", "c", "d"]), ("b>c>d", "a", ["b", "c", "d"])]
    assert one(spark, S.suffixes(arr("a", "b"))) == []


def test_transitions(spark):
    assert [(s["f"], s["t"]) for s in one(spark, S.transitions(arr("a", "b", "a", "b")))] == [("a", "b"), ("b", "a")]


def test_parents_and_containment(spark):
    assert one(spark, S.parent_left(F.lit("a>b>c"))) == "b>c" and one(spark, S.parent_right(F.lit("a>b>c"))) == "a>b"
    assert one(spark, S.parent_left(F.lit("a"))) == ""
    assert one(spark, S.contains_run(arr("aa", "b", "c"), F.lit("b>c"))) and not one(spark, S.contains_run(arr("aa", "b", "c"), F.lit("a>b")))


def test_densify(spark):
    got = one(spark, geo.densify(pts((-8.62, 41.15), (-8.61, 41.15)), 0.2, 2.0))
    d = py_hav(-8.62, 41.15, -8.61, 41.15)
    assert len(got) == 1 + math.ceil(d / 0.2) and got[-1]["lon"] == -8.61
    assert len(one(spark, geo.densify(pts((-8.62, 41.15), (-8.1, 41.15)), 0.2, 2.0))) == 2  # a gap stays a gap
    assert len(one(spark, geo.densify(pts((-8.62, 41.15)), 0.2, 2.0))) == 1


def test_sampling_phase_does_not_change_the_filled_cells(spark):
    line = [(-8.62 + 0.0004 * i, 41.15) for i in range(60)]

    def cells(p):
        return F.transform(geo.densify(p, geo.cell_step_km() / 8, C.MAX_HOP_KM), lambda x: geo.hex_cell(x["lon"], x["lat"]))

    a, b = one(spark, S.compact(cells(pts(*line[0::6])))), one(spark, S.compact(cells(pts(*line[2::6]))))
    # The two samplings begin and end at different points of one line: all cells between those are the same, in the same order.
    assert len(b) > 5 and a[: len(b) + 1][1:] == b[: len(b)] or a[: len(b)] == b
