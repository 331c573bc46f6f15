"""Queries over whole trips, files and experiments: raw scans, mined routes, corridors, hold-out, comparisons of methods and scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions import geo
from pathloom.functions import sequences as S
from pathloom.operators import compare, encoding, graph, match, mining, quality, repeats, similarity, sketch
from pathloom.plans import oracle as O
from pathloom.plans.registry import _PARSED, _cells, _repeat_sql, query, rounded
from pathloom.sources import derived as D
from pathloom.sources import trips as T
from pathloom.sources.store import Store, kept, scratch


def _segments(spark, sf):
    return encoding.segments(encoding.encode(D.trips(spark, sf)))


# ---- files


@query(f"WITH {_PARSED} SELECT trip_id AS \"TRIP_ID\", any_value(call_type) AS \"CALL_TYPE\", CAST(any_value(n) AS INTEGER) AS n_points, any_value(lon1) AS start_lon, any_value(lat2) AS end_lat FROM val WHERE ok GROUP BY trip_id")
def raw_csv_scan(spark, sf):
    """Raw trips written as CSV, read back with the fixed schema, and cleaned."""
    path = scratch(spark, "raw")
    T.write_raw(D.raw_trips(spark, sf), path)
    return quality.clean(T.read_raw(spark, path)).select("TRIP_ID", "CALL_TYPE", "n_points", "start_lon", "end_lat")


@query(f"WITH {_PARSED}, one AS (SELECT DISTINCT trip_id, call_type, md FROM raw WHERE trip_id <> 'x7') SELECT trip_id AS \"TRIP_ID\", call_type AS \"CALL_TYPE\", md AS \"MISSING_DATA\" FROM one ORDER BY md5(trip_id), trip_id LIMIT 100")
def sample_csv(spark, sf):
    """A sample of raw trips in the order of a digest of their ids, through its CSV file."""
    path = scratch(spark, "sample")
    T.write_sample_csv(D.raw_trips(spark, sf).filter("TRIP_ID <> 'x7'"), path, 100)
    return T.read_raw(spark, path).select("TRIP_ID", "CALL_TYPE", "MISSING_DATA")


_ROUTES = f"""w3 AS (SELECT id, array_to_string(cells[i : j], '>') AS key, cums[j] - cums[i] AS km FROM (SELECT *, unnest(generate_series(i + 2, len(cells))) AS j FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM segs WHERE id % 5 <> 0)) WHERE j <= i + 4 AND cums[j] - cums[i] >= 1)
, best AS (SELECT key FROM (SELECT key, count(DISTINCT id) AS support FROM w3 GROUP BY key ORDER BY support DESC, key LIMIT 50))"""
_HELD = """hraw AS (SELECT id, pos, {cell} AS cell FROM pts WHERE id % 5 = 0 AND id IN (SELECT id FROM pts GROUP BY id HAVING count(*) >= 2))
, hc AS (SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY pos) AS pc FROM hraw) WHERE pc IS NULL OR pc <> cell)
, hh AS (SELECT *, CASE WHEN p IS NOT NULL THEN {hop} END AS km FROM (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY k) AS p FROM hc))
, hs AS (SELECT id, g, '>' || string_agg(cell, '>' ORDER BY k) || '>' AS line, count(*) AS n FROM (SELECT *, sum(CASE WHEN km > {bound} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS g FROM hh) GROUP BY id, g HAVING count(*) >= 2)"""
_HELD = _HELD.format(cell=O.hex_cell("round(lon, 6)", "round(lat, 6)"), hop=O.cell_hop("p", "cell"), bound=O.num(C.MAX_HOP_KM))


@query(f"WITH {O.CELLS}, {_ROUTES}, {_HELD}, hit AS (SELECT DISTINCT id, g FROM hs JOIN best ON contains(line, '>' || key || '>')) SELECT (SELECT count(*) FROM hs) AS segments, (SELECT count(*) FROM hit) AS matched, round((SELECT count(*) FROM hit) / (SELECT count(*) FROM hs)::DOUBLE, 6) AS coverage")
def holdout_second_source(spark, sf):
    """Routes of one source, through their result table, found in segments of another: every fifth trip, from a raw CSV of its own."""
    seg = _segments(spark, sf)
    windows = seg.filter("id % 5 <> 0").select("id", "entity", F.explode(S.windows_km(F.col("cells"), F.col("cum"), 1.0, 1e9, 10**6)).alias("w")).select("id", "entity", "w.key", "w.length_km", "w.n", "w.truncated")
    best = mining.support(windows.filter("n between 3 and 5").dropDuplicates(["id", "key"])).orderBy(F.desc("support"), "key").limit(50)
    store = Store(spark, scratch(spark, "results"))
    store.put_rows("routes", best.select(F.col("key").alias("subroute"), "support", "length_km"))
    routes = T.distinct_routes(store.rows("routes", "subroute string, support long, length_km double"), 1.0)
    path = scratch(spark, "held")
    T.write_raw(D.raw_trips(spark, sf).filter("TRIP_ID not like 'x%' and cast(TRIP_ID as long) % 5 = 0"), path)
    held = quality.parse(T.read_raw(spark, path)).filter("n_points >= 2").select(F.col("TRIP_ID").alias("id"), F.col("TAXI_ID").alias("entity"), "points")
    other = encoding.segments(encoding.encode(held)).select(F.concat_ws("_", "id", "seg").alias("id"), F.col("cells").alias("seq"))
    return rounded(compare.coverage(other, match.as_patterns(routes, "subroute")), "coverage")


@query(f"WITH {O.CELLTOK}, {O.EDGES}, top AS (SELECT t AS node, sum(w) AS w FROM edges GROUP BY t ORDER BY w DESC, t LIMIT 20) SELECT 'Point' AS type, node, CAST(w AS BIGINT) AS w, round({O.centre('node')[0]}, 6) AS lon, round({O.centre('node')[1]}, 6) AS lat FROM top")
def geojson_zones(spark, sf):
    """The map's layer of busiest cells, written and read back from its features."""
    top = graph.edges(_cells(spark, sf)).groupBy(F.col("t").alias("node")).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "node").limit(20)
    centre = geo.hex_centre(F.col("node"))
    path = scratch(spark, "map")
    T.write_map({"zones": T.geojson_points(top.select("node", "w", centre["lon"].alias("lon"), centre["lat"].alias("lat")), ["node", "w"])}, path)
    shape = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<node:string,w:bigint>>"
    f = spark.read.text(f"{path}/zones").select(F.from_json("value", shape).alias("f"))
    return f.select("f.geometry.type", "f.properties.node", "f.properties.w", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


# ---- grids and encoding

_GX, _GY = O.geohash_axes("lon", "lat", 6)


@query(f"WITH {O.PTS} SELECT {O.geohash('lon', 'lat', 6)} AS cell, round(any_value({_GX}), 6) AS lon, round(any_value({_GY}), 6) AS lat FROM pts GROUP BY 1")
def geohash_centres(spark, sf):
    cells = D.trip_points(spark, sf).select(geo.geohash(F.col("lon"), F.col("lat"), 6).alias("cell")).distinct()
    c = geo.geohash_centre(F.col("cell"))
    return cells.select("cell", F.round(c["lon"], 6).alias("lon"), F.round(c["lat"], 6).alias("lat"))


_STEP = O.num(geo.cell_step_km() / 8)


@query(
    f"""WITH {O.FEATURES}, parts AS (SELECT *, CASE WHEN km > {_STEP} AND km <= {O.num(C.MAX_HOP_KM)} THEN CAST(ceil(km / {_STEP}) AS INTEGER) ELSE 1 END AS parts FROM hop)
, dense AS (SELECT id, pos, j, CASE WHEN plon IS NULL THEN lon ELSE plon + (lon - plon) * j / parts END AS lon, CASE WHEN plat IS NULL THEN lat ELSE plat + (lat - plat) * j / parts END AS lat FROM (SELECT *, unnest(generate_series(1, parts)) AS j FROM parts))
, dc AS (SELECT id, pos, j, {O.hex_cell('lon', 'lat')} AS cell FROM dense), dk AS (SELECT id, cell, row_number() OVER w AS k FROM (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY pos, j) AS pc FROM dc) WHERE pc IS NULL OR pc <> cell WINDOW w AS (PARTITION BY id ORDER BY pos, j))
, dh AS (SELECT id, k, CASE WHEN p IS NOT NULL THEN {O.cell_hop('p', 'cell')} END AS km FROM (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY k) AS p FROM dk))
, bare AS (SELECT id, count(*) AS n FROM (SELECT id, cell, lag(cell) OVER (PARTITION BY id ORDER BY pos) AS pc FROM (SELECT id, pos, {O.hex_cell('lon', 'lat')} AS cell FROM pts)) WHERE pc IS NULL OR pc <> cell GROUP BY id)
 SELECT id, CAST(count(*) AS INTEGER) AS n_cells, CAST(count(*) - any_value(n) AS INTEGER) AS n_cells_filled, round(coalesce(sum(km), 0), 6) AS encoded_len_km, round(coalesce(max(km), 0), 6) AS max_hop_km FROM dh JOIN bare USING (id) GROUP BY id"""
)
def encode_filled(spark, sf):
    """Cells of densified trips, and how many the filling added."""
    e = encoding.encode(D.trips(spark, sf), fill=True)
    return rounded(e.select("id", "n_cells", "n_cells_filled", "encoded_len_km", "max_hop_km"), "encoded_len_km", "max_hop_km")


_TURNS = [(f"hex_{e}", O.hex_cell("lon", "lat", e), *O.centre(O.hex_cell("lon", "lat", e), e)) for e in (0.461, 0.174, 0.066)] + [(f"geohash_{k}", O.geohash("lon", "lat", k), *O.geohash_axes("lon", "lat", k)) for k in (6, 7)]


@query(f"WITH {O.PTS} SELECT grid, cells, round(entropy, 6) AS entropy FROM ({' UNION ALL '.join(O.grid_turns(*t) for t in _TURNS)})")
def grid_turns(spark, sf):
    return rounded(encoding.grid_entropy(D.trips(spark, sf)), "entropy")


_FLAGS = ["is_teleport", "is_idle", "is_too_fast", "is_too_short", "is_offgrid"]
_ANY = " OR ".join(_FLAGS)


@query(f"WITH {O.FEATURES} SELECT count(*) AS trips, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FLAGS)}, count(*) FILTER (NOT coalesce({_ANY}, false)) AS encoded FROM feats")
def encoding_drops(spark, sf):
    return encoding.drops(quality.features(D.trips(spark, sf)))


@query(f"WITH {O.FEATURES} SELECT 'all' AS input, count(*) AS encoded, count(*) FILTER ({_ANY}) AS leaked FROM feats UNION ALL SELECT 'plain', count(*) FILTER (NOT coalesce({_ANY}, false)), 0 FROM feats")
def leak_check(spark, sf):
    """Anomalous trips among encoded ones: all trips, and those that the flags let through."""
    trips = D.trips(spark, sf)
    feats = quality.features(trips)
    plain = feats.filter(~F.coalesce(F.col("is_anomalous"), F.lit(False))).select(trips.columns)
    out = encoding.leaked(encoding.encode(trips), feats).withColumn("input", F.lit("all"))
    return out.unionByName(encoding.leaked(encoding.encode(plain), feats).withColumn("input", F.lit("plain"))).select("input", "encoded", "leaked")


# ---- routes of trips


def _trip_repeat_sql(least: int) -> str:
    return f"""{O.CELLS}, tw AS (SELECT id, entity, cells[i : j] AS w, cums[j] - cums[i] AS km, j - i + 1 AS n, CASE WHEN i > 1 THEN cells[i - 1] END AS prev, CASE WHEN j < len(cells) THEN cells[j + 1] END AS nxt
 FROM (SELECT *, unnest(generate_series(i + 2, least(len(cells), i + {C.SUFFIX_MAX_CELLS - 1}))) AS j FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM segs)))
, tg AS (SELECT *, array_to_string(w, '>') AS key FROM tw), rep AS (SELECT key, n, any_value(km) AS length_km, count(DISTINCT id) AS support, count(DISTINCT entity) AS support_entities FROM tg GROUP BY key, n
 HAVING count(DISTINCT id) >= {least} AND count(*) > 1 AND (count(DISTINCT nxt) > 1 OR count(*) FILTER (nxt IS NULL) > 0) AND any_value(km) BETWEEN 1 AND 60 AND len(list_filter(list_distinct(any_value(w)), lambda c: len(list_filter(any_value(w), lambda x: x = c)) > 2)) = 0)
, lft AS (SELECT key, max(c) AS m FROM (SELECT key, prev, count(DISTINCT id) AS c FROM tg WHERE prev IS NOT NULL GROUP BY key, prev) GROUP BY key)
, rgt AS (SELECT a.key, max(b.support) AS m FROM rep a JOIN rep b ON starts_with(b.key, a.key || '>') GROUP BY a.key)
, reps AS (SELECT rep.key, support, support_entities, CAST(n AS INTEGER) AS n, coalesce(rgt.m, 0) AS best_right, coalesce(lft.m, 0) AS best_left, length_km FROM rep LEFT JOIN rgt USING (key) LEFT JOIN lft USING (key))"""


def _mined(spark, sf, least):
    return repeats.mine(_segments(spark, sf).select("id", "entity", F.col("cells").alias("seq")), least, trips=True)


def _with_km(routes):
    return routes.withColumn("length_km", geo.path_km(F.transform(F.split("key", S.SEP), lambda c: geo.hex_centre(c))))


@query(f"WITH {_trip_repeat_sql(2).replace('any_value(w)', 'min(w)')} SELECT key, support, support_entities, n, best_right, best_left FROM reps")
def trip_repeats(spark, sf):
    """Repeated sub-routes of 1 to 60 km that enter no cell more than twice, by suffix arrays over gap-free segments."""
    return _mined(spark, sf, 2)


@query(f"WITH {_trip_repeat_sql(2).replace('any_value(w)', 'min(w)')}, fl AS (SELECT greatest(2, CAST(ceil(0.005e0 * count(DISTINCT id)) AS BIGINT)) AS f FROM pts) SELECT key, support, best_right, best_left, CAST(f AS INTEGER) AS floor FROM reps, fl WHERE support >= f AND greatest(best_right, best_left) < f ORDER BY support DESC, n DESC, key LIMIT 5")
def trip_holes(spark, sf):
    return repeats.holes(_mined(spark, sf, 2), D.trips(spark, sf).count())


@query(
    f"""WITH {_trip_repeat_sql(2).replace('any_value(w)', 'min(w)')}, fl AS (SELECT f FROM (VALUES {', '.join(f'({f})' for f in C.SUPPORT_FLOORS)}) v(f) WHERE f <= (SELECT count(DISTINCT id) FROM pts))
, cnt AS (SELECT band, f, (SELECT count(*) FROM reps WHERE support >= f AND greatest(best_right, best_left) < f AND length_km >= band) AS routes FROM fl, (VALUES (1), (3), (5), (10), (20), (40)) b(band))
 SELECT CAST(band AS DOUBLE) AS band, CAST(f AS INTEGER) AS floor, routes, f = coalesce(max(CASE WHEN routes >= 100 THEN f END) OVER (PARTITION BY band), min(f) OVER (PARTITION BY band)) AS chosen FROM cnt"""
)
def trip_floor_calibration(spark, sf):
    """Maximal routes by floor and length band from one mining at the lowest floor."""
    return repeats.calibrate(_with_km(_mined(spark, sf, 2)), D.trips(spark, sf).count())


@query(f"WITH {_trip_repeat_sql(2).replace('any_value(w)', 'min(w)')} SELECT CAST(band AS DOUBLE) AS band, key, support, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band ORDER BY support DESC, round(length_km, 6) DESC, key) AS INTEGER) AS rank FROM reps, (VALUES (1), (3), (5), (10), (20), (40)) b(band) WHERE length_km >= band) WHERE rank <= 100")
def trip_repeat_top(spark, sf):
    """The best repeated sub-routes of each length band."""
    top = mining.banded_top(_with_km(_mined(spark, sf, 2)).withColumn("length_km", F.round("length_km", 6)))
    return top.select("band", "key", "support", "n", "rank")


@query(
    f"""WITH {O.LONG_WINDOWS} SELECT CAST(band AS DOUBLE) AS band, key, support, support_entities, CAST(n AS INTEGER) AS n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band ORDER BY support DESC, round(length_km, 6) DESC, key) AS INTEGER) AS rank
 FROM ksup, (VALUES (1), (3), (5), (10), (20), (40)) b(band) WHERE length_km >= band AND support >= 2 AND NOT truncated) WHERE rank <= 100"""
)
def long_trip_top(spark, sf):
    """The best windows of every length band, up to 40 km, over trips that are long enough to fill them."""
    seg = encoding.segments(encoding.encode(D.long_trips(spark, sf)))
    return mining.top_windows(seg, digits=6).select("band", "key", "support", "support_entities", "n", "rank")


@query(f"WITH {O.KMWINDOWS} SELECT key, support FROM ksup WHERE NOT truncated AND support >= 2 ORDER BY support DESC, key LIMIT 50")
def sketch_km_top(spark, sf):
    """Sketched windows of 1 to 60 km, those cut off at the cap left out on both sides, recounted exactly."""
    rows = mining.km_windows(_segments(spark, sf))
    good = rows.join(rows.groupBy("key").agg(F.max("truncated").alias("cut")).filter("not cut").select("key"), "key", "left_semi")
    return sketch.recounted(sketch.heavy_hitters(good, k=400), good).orderBy(F.desc("support"), "key").limit(50).select("key", "support")


@query(f"WITH {O.KMWINDOWS} SELECT key, support, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY support DESC, round(length_km, 9) DESC, key) AS INTEGER) AS rank FROM ksup WHERE length_km >= 1 AND support >= 2 AND NOT truncated) WHERE rank <= 100")
def exact_top_guarded(spark, sf):
    """Exhaustive windows behind their guard; where it refuses, because there are more trips than they are meant for, the one
    band that is asked for is counted by itself, as in seq_exact_topk."""
    seg = kept(_segments(spark, sf))
    try:
        top = mining.exact_top(seg, seg.select("id").distinct().count())
    except C.LimitExceeded:
        table = mining.support(mining.km_windows(seg)).filter("not truncated").withColumn("length_km", F.round("length_km", 9))
        top = mining.banded_top(table, (1.0,))
    return top.filter("band = 1.0").select("key", "support", "rank")


@query(
    f"""WITH {O.CELLTOK}, top AS (SELECT key FROM (SELECT array_to_string([a, tok, c], '>') AS key, count(DISTINCT id) AS s FROM (SELECT id, tok, lag(tok) OVER w AS a, lead(tok) OVER w AS c FROM tok WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY 1 ORDER BY s DESC, key LIMIT 20))
, ln AS (SELECT id, '>' || string_agg(tok, '>' ORDER BY pos) || '>' AS line FROM tok GROUP BY id), h AS (SELECT id, key, line, instr(line, '>' || key || '>') AS p FROM ln JOIN top ON contains(line, '>' || key || '>'))
 SELECT id, key, nullif(regexp_extract(substr(line, 1, p - 1), '([^>]*)$', 1), '') AS before, nullif(regexp_extract(substr(line, p + length(key) + 2), '^([^>]*)', 1), '') AS after FROM h"""
)
def route_neighbours(spark, sf):
    """The cells on either side of the 20 most frequent three-cell routes, where each trip first takes them."""
    c = _cells(spark, sf)
    top = mining.token_support(c, 3, 3).orderBy(F.desc("support"), "key").limit(20)
    return match.neighbours(c, top)


# ---- corridors of clusters


@query()
def corridors(spark, sf):
    """What star clusters of similar trips share, with support over all trips, ranked."""
    found = similarity.corridors(encoding.encode(D.trips(spark, sf)))
    return rounded(mining.banded_top(found.withColumn("length_km", F.round("length_km", 9))), "length_km")


@query()
def cap_experiment(spark, sf):
    """Corridors of smaller samples against those of all trips: partners by tokens, the same key, and supports that differ (none may)."""
    enc = kept(encoding.encode(D.trips(spark, sf)).select("id", "entity", "cells"))
    n = enc.count()
    caps = sorted({max(1, n // 4), max(1, n // 2), n})
    found = kept(similarity.corridors_by_cap(enc, caps)).select("cap", "key", "support", F.split("key", S.SEP).alias("tokens"))
    whole = found.filter(F.col("cap") == caps[-1]).drop("cap")
    out = None
    for cap in caps:
        own = found.filter(F.col("cap") == cap).drop("cap")
        loose = similarity.set_match_share(whole, own).select(F.col("share").alias("loose"))
        row = compare.exact_recall(whole, own).crossJoin(loose).select(F.lit(cap).alias("cap"), "total", "found", "mismatched", "loose")
        out = row if out is None else out.unionByName(row)
    return out


# ---- methods and scales

_METHODS = f"""m AS (SELECT 'windows' AS method, key, support, n FROM sup WHERE n >= 3 UNION ALL SELECT 'closed', key, support, n FROM ext WHERE n >= 3 AND greatest(best_right, best_left) < support
 UNION ALL SELECT 'maximal', key, support, n FROM ext WHERE n >= 3 AND support >= 10 AND greatest(best_right, best_left) < 10)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY support DESC, key) AS r FROM m) WHERE r <= 40), tk AS (SELECT method, key, list_distinct(string_split(key, '>')) AS s FROM best)"""


def _methods(spark, sf):
    t = mining.token_support(D.event_sequences(spark, sf, weekly=True), 2, 8)
    ext = mining.extensions(t)
    best = F.greatest("best_right", "best_left")
    kinds = {"windows": ext, "closed": ext.filter(best < F.col("support")), "maximal": ext.filter((F.col("support") >= 10) & (best < 10))}
    return {k: v.filter("n >= 3").orderBy(F.desc("support"), "key").limit(40).select("key", "support", "n", F.split("key", S.SEP).alias("tokens")) for k, v in kinds.items()}


@query(
    f"""WITH {O.WSEQ}, {O.grams(2, 8)}, {O.SUPPORT}, {O.EXT}, {_METHODS} SELECT x.method, o.method AS other, count(*) FILTER (EXISTS (SELECT 1 FROM tk y WHERE y.method = o.method AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE >= 0.5)) AS matched, count(*) AS total,
 round(count(*) FILTER (EXISTS (SELECT 1 FROM tk y WHERE y.method = o.method AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE >= 0.5)) / count(*)::DOUBLE, 6) AS share FROM tk x, (SELECT DISTINCT method FROM tk) o WHERE x.method <> o.method GROUP BY x.method, o.method"""
)
def method_matrix(spark, sf):
    """For each pair of methods, how many of one's best routes of three tokens and more have a partner in the other's."""
    return rounded(compare.overlap_matrix(_methods(spark, sf)), "share")


@query(
    f"""WITH {_repeat_sql(O.WSEQ, 3)}, a AS (SELECT key, count(DISTINCT id) AS support, n FROM grams WHERE n <= 8 GROUP BY key, n ORDER BY support DESC, key LIMIT 40), b AS (SELECT key, support FROM repeats ORDER BY support DESC, key LIMIT 40)
, j AS (SELECT a.support AS s, b.support AS b FROM a FULL JOIN b USING (key)), ta AS (SELECT list_distinct(string_split(key, '>')) AS s FROM a), tb AS (SELECT list_distinct(string_split(key, '>')) AS s FROM b)
, un AS (SELECT count(*) AS n, (SELECT count(*) FROM tb) AS total FROM tb WHERE NOT EXISTS (SELECT 1 FROM ta WHERE len(list_intersect(ta.s, tb.s)) / len(list_distinct(list_concat(ta.s, tb.s)))::DOUBLE >= 0.5))
, c AS (SELECT count(*) FILTER (s IS NULL OR b IS NULL) AS keys, count(*) FILTER (s <> b) AS support, count(*) FILTER (abs(s - b) > 0.01e0 * b) AS close FROM j)
 SELECT 'exact' AS tier, 'keys' AS name, keys = 0 AS ok, keys AS differing FROM c UNION ALL SELECT 'exact', 'support', support = 0, support FROM c UNION ALL SELECT 'close', 'support', close = 0, close FROM c
 UNION ALL SELECT 'loose', 'partners', (total - n) / total::DOUBLE >= 0.5, n FROM un UNION ALL SELECT 'sane', 'lengths', true, 0 UNION ALL SELECT 'sane', 'hops', true, 0"""
)
def run_tiers(spark, sf):
    """Window counts held against suffix repeats, tier by tier."""
    seq = D.event_sequences(spark, sf, weekly=True)
    top = lambda t: t.orderBy(F.desc("support"), "key").limit(40).select("key", "support", "n", (F.col("n") * geo.cell_step_km()).alias("length_km"))
    return compare.run_tiers(top(mining.token_support(seq, 3, 8)), top(repeats.mine(seq, 3)))


_SCALES = (("0.125", "2"), ("0.25", "4"), ("0.5", "8"), ("1.0", "g"))
_FLOORS = (2, 5, 20)
_SCALED = f"""{O.WSEQ}, {O.grams(2, 8)}, sc(scale, top) AS (VALUES {', '.join(f"({s}e0, '{t}')" for s, t in _SCALES)}), sn AS (SELECT scale, count(*) AS trips FROM seqs JOIN sc ON substr(md5(CAST(id AS VARCHAR)), 1, 1) < top GROUP BY scale)
, ss AS (SELECT scale, key, n, count(DISTINCT id) AS support FROM grams JOIN sc ON substr(md5(CAST(id AS VARCHAR)), 1, 1) < top GROUP BY scale, key, n)
, se AS (SELECT a.scale, a.key, a.n, a.support, greatest(coalesce(r.m, 0), coalesce(l.m, 0)) AS best FROM ss a LEFT JOIN (SELECT scale, regexp_extract(key, '^(.*)>[^>]*$', 1) AS p, max(support) AS m FROM ss GROUP BY 1, 2) r ON r.p = a.key AND r.scale = a.scale
 LEFT JOIN (SELECT scale, regexp_extract(key, '^[^>]*>(.*)$', 1) AS p, max(support) AS m FROM ss GROUP BY 1, 2) l ON l.p = a.key AND l.scale = a.scale)
, fs AS (SELECT sn.scale, trips, f AS floor, (SELECT count(*) FROM se WHERE se.scale = sn.scale AND support >= f AND best < f) AS routes, (SELECT max(n) FROM se WHERE se.scale = sn.scale AND support >= f AND best < f) AS longest FROM sn, (VALUES (2), (5), (20)) v(f))"""


def _scaled(spark, sf):
    """Maximal routes by scale and floor: samples by the first digit of a digest of the id, all in one mining."""
    seq = D.event_sequences(spark, sf, weekly=True)
    digit = F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 1)
    scales = F.filter(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(t).alias("top")) for s, t in _SCALES]), lambda x: digit < x["top"])
    rows = seq.select("id", "entity", "seq", F.explode(scales).alias("x")).select("x.scale", "id", "entity", "seq")
    w = rows.select("scale", F.explode(S.windows_up_to(F.col("seq"), 2, 8)).alias("w")).select("scale", "w.key", "w.n").groupBy("scale", "key", "n").agg(F.count("*").alias("support"))
    ext = mining.extensions(w, ("scale",))
    best = F.greatest("best_right", "best_left")
    keep = F.filter(F.array(*map(F.lit, _FLOORS)), lambda f: (F.col("support") >= f) & (best < f))
    got = ext.select("scale", "n", F.explode(keep).alias("floor")).groupBy("scale", "floor").agg(F.count("*").alias("routes"), F.max("n").alias("longest"))
    trips = rows.groupBy("scale").agg(F.count("*").alias("trips")).select("scale", "trips", F.explode(F.array(*map(F.lit, _FLOORS))).alias("floor"))
    return trips.join(got, ["scale", "floor"], "left").na.fill(0, ["routes"])


@query(f"WITH {_SCALED} SELECT scale, trips, floor, routes, CAST(longest AS INTEGER) AS longest FROM fs")
def floor_scaling(spark, sf):
    return _scaled(spark, sf).select("scale", "trips", "floor", "routes", "longest")


@query(f"WITH {_SCALED}, p AS (SELECT floor, ln(trips) AS x, ln(routes) AS y FROM fs WHERE routes > 0) SELECT floor, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN exp(regr_intercept(y, x)) END, 6) AS a, round(CASE WHEN count(*) >= 3 THEN regr_slope(y, x) END, 6) AS b, round(CASE WHEN count(*) >= 3 THEN regr_r2(y, x) END, 6) AS r2 FROM p GROUP BY floor")
def floor_power_law(spark, sf):
    """Routes against trips at each floor, as a power law."""
    ln = _scaled(spark, sf).filter("routes > 0").select("floor", F.log("trips").alias("x"), F.log("routes").alias("y"))
    ok = F.count("*") >= 3
    fit = ln.groupBy("floor").agg(F.count("*").alias("n"), F.when(ok, F.exp(F.regr_intercept("y", "x"))).alias("a"), F.when(ok, F.regr_slope("y", "x")).alias("b"), F.when(ok, F.regr_r2("y", "x")).alias("r2"))
    return rounded(fit, "a", "b", "r2")
