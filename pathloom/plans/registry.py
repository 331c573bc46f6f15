"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom import config as C
from pathloom.functions import geo
from pathloom.functions import sequences as S
from pathloom.operators import compare, encoding, graph, match, mining, quality, repeats, similarity, sketch
from pathloom.plans import oracle as O
from pathloom.sources import derived as D
from pathloom.sources import trips as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- sequence support


@query(f"WITH {O.SEQ}, {O.grams(3, 3)}, {O.SUPPORT} SELECT key, support FROM sup ORDER BY support DESC, key LIMIT 100")
def seq_ngram_support(spark, sf):
    s = D.event_sequences(spark, sf).select("id", F.explode(S.ngrams(F.col("seq"), 3)).alias("key"))
    return s.groupBy("key").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "key").limit(100)


BANDS = "(VALUES (2), (3), (4), (5)) b(band)"


@query(
    f"""WITH {O.WSEQ}, {O.grams(2, 6)}, {O.SUPPORT} SELECT CAST(band AS INTEGER) AS band, key, CAST(n AS INTEGER) AS n, support, rank FROM (SELECT band, key, n, support, CAST(row_number() OVER (PARTITION BY band ORDER BY support DESC, n DESC, key) AS INTEGER) AS rank
 FROM sup, {BANDS} WHERE n >= band AND support >= 2) WHERE rank <= 100"""
)
def seq_window_bands(spark, sf):
    t = mining.token_support(D.event_sequences(spark, sf, weekly=True), 2, 6)
    return mining.banded_top(t, (2, 3, 4, 5), length="n").select("band", "key", "n", "support", "rank")


@query(
    f"""WITH {O.KMWINDOWS} SELECT CAST(band AS DOUBLE) AS band, key, support, support_entities, round(length_km, 6) AS length_km, CAST(n AS INTEGER) AS n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band ORDER BY support DESC, round(length_km, 9) DESC, key) AS INTEGER) AS rank
 FROM ksup, (VALUES (1), (3), (5), (10), (20), (40)) b(band) WHERE length_km >= band AND support >= 2 AND NOT truncated) WHERE rank <= 100"""
)
def seq_exact_topk(spark, sf):
    trips = D.trips(spark, sf)
    seg = encoding.segments(encoding.encode(trips))
    # Lengths are sums in another order than an oracle may take; ties are told apart at a millionth of a metre.
    t = mining.support(mining.km_windows(seg)).filter("not truncated").withColumn("length_km", F.round("length_km", 9))
    top = mining.banded_top(t)
    return rounded(top.select("band", "key", "support", "support_entities", "length_km", "n", "rank"), "length_km")


@query(f"WITH {O.SUPPLIERS}, {O.grams(2, 3)} SELECT key, CAST(n AS INTEGER) AS n, count(DISTINCT id) AS support, count(DISTINCT entity) AS support_entities FROM grams GROUP BY key, n HAVING count(DISTINCT id) >= 2")
def supplier_ngrams(spark, sf):
    return mining.token_support(D.supplier_sequences(spark, sf), 2, 3, entities=True).filter("support >= 2").select("key", "n", "support", "support_entities")


# ---- cleaning, features, anomalies

_PARSED = f"""{O.PTS}, t0 AS (SELECT id, entity, min(ts) AS s, array_agg(struct_pack(lon := round(lon, 6), lat := round(lat, 6)) ORDER BY pos) AS p FROM pts GROUP BY id, entity)
, raw AS (SELECT CAST(id AS VARCHAR) AS trip_id, entity AS taxi_id, ['A', 'B', 'C'][id % 3 + 1] AS call_type, CASE WHEN id % 29 = 0 THEN 'True' ELSE 'False' END AS md, p FROM t0
 UNION ALL SELECT * FROM (VALUES ('x1', 1, 'A', 'False', []), ('x2', 1, 'A', 'False', NULL), ('x3', 1, 'A', 'False', NULL), ('x4', 1, 'A', 'False', [{{'lon': -8.62e0, 'lat': 41.15e0}}]),
 ('x5', 1, 'A', 'False', [{{'lon': -8.62e0, 'lat': 41.15e0}}, {{'lon': -9.9e0, 'lat': 41.15e0}}]), ('x6', 1, 'A', 'True', [{{'lon': -8.62e0, 'lat': 41.15e0}}, {{'lon': -8.61e0, 'lat': 41.15e0}}]),
 ('x7', 1, 'A', 'False', [{{'lon': -8.62e0, 'lat': 41.15e0}}, {{'lon': -8.61e0, 'lat': 41.15e0}}]), ('x7', 1, 'A', 'False', [{{'lon': -8.62e0, 'lat': 41.15e0}}, {{'lon': -8.61e0, 'lat': 41.15e0}}])) v(trip_id, taxi_id, call_type, md, p))
, par AS (SELECT *, coalesce(len(p), 0) AS n, p[1].lon AS lon1, p[1].lat AS lat1, p[-1].lon AS lon2, p[-1].lat AS lat2 FROM raw)
, flg AS (SELECT *, lon1 BETWEEN -8.75e0 AND -8.45e0 AND lat1 BETWEEN 41.05e0 AND 41.3e0 AND lon2 BETWEEN -8.75e0 AND -8.45e0 AND lat2 BETWEEN 41.05e0 AND 41.3e0 AS onmap FROM par)
, val AS (SELECT *, coalesce(md = 'False' AND n >= 2 AND n <= 4000 AND onmap, false) AS ok FROM flg)"""


@query(f"WITH {_PARSED} SELECT count(*) AS total, count(*) FILTER (md <> 'False') AS missing, count(*) FILTER (n < 2) AS too_few, count(*) FILTER (n > 4000) AS too_many, count(*) FILTER (NOT onmap) AS off_map, count(*) FILTER (ok) AS valid FROM val")
def traj_clean_rules(spark, sf):
    return quality.rejections(quality.flags(quality.parse(D.raw_trips(spark, sf))))


@query(f"WITH {_PARSED} SELECT trip_id AS \"TRIP_ID\", any_value(call_type) AS \"CALL_TYPE\", CAST(any_value(n) AS INTEGER) AS n_points, CAST((any_value(n) - 1) * 15 AS INTEGER) AS duration_sec, any_value(lon1) AS start_lon, any_value(lat2) AS end_lat FROM val WHERE ok GROUP BY trip_id")
def traj_clean(spark, sf):
    return quality.clean(D.raw_trips(spark, sf)).select("TRIP_ID", "CALL_TYPE", "n_points", "duration_sec", "start_lon", "end_lat")


@query(f"WITH {_PARSED} SELECT count(*) - count(DISTINCT trip_id) AS duplicates, count(DISTINCT trip_id) AS written FROM val WHERE ok")
def traj_dedupe(spark, sf):
    good = quality.flags(quality.parse(D.raw_trips(spark, sf))).filter("is_valid").select("TRIP_ID", "TIMESTAMP")
    kept = quality.deduplicated(good).agg(F.count("*").alias("written"))
    return good.agg(F.count("*").alias("n")).crossJoin(kept).select((F.col("n") - F.col("written")).alias("duplicates"), "written")


_F = ["total_distance_km", "straight_line_km", "max_seg_speed_kmh", "avg_speed_kmh", "sinuosity", "min_lon", "max_lon", "min_lat", "max_lat"]
_FLAGS = ["is_teleport", "is_idle", "is_too_fast", "is_too_short", "is_offgrid"]


@query(f"WITH {O.FEATURES} SELECT id, CAST(n AS INTEGER) AS n, {', '.join(f'round({c}, 6) AS {c}' for c in _F)}, {', '.join(_FLAGS)}, {' OR '.join(_FLAGS)} AS is_anomalous FROM feats")
def traj_features(spark, sf):
    f = quality.features(D.trips(spark, sf))
    return rounded(f.select("id", "n", *_F, *_FLAGS, "is_anomalous"), *_F)


_P = ["total_distance_km", "straight_line_km", "max_seg_speed_kmh", "avg_speed_kmh", "sinuosity", "seconds"]


@query(
    f"WITH {O.FEATURES}, long AS ({' UNION ALL '.join(f'''SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS v FROM feats''' for c in _P)}) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev(v), 6) AS stddev, round(min(v), 6) AS \"min\", "
    + ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{p}" for q, p in ((0.25, 25), (0.5, 50), (0.75, 75), (0.95, 95)))
    + ', round(max(v), 6) AS "max" FROM long GROUP BY metric'
)
def traj_feature_summary(spark, sf):
    return rounded(quality.profile(quality.features(D.trips(spark, sf)), _P), "mean", "stddev", "min", "p25", "p50", "p75", "p95", "max")


@query(f"WITH {O.FEATURES} SELECT count(*) AS trips, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FLAGS)}, count(*) FILTER ({' OR '.join(_FLAGS)}) AS is_anomalous FROM feats")
def traj_flag_counts(spark, sf):
    f = quality.features(D.trips(spark, sf))
    return f.agg(F.count("*").alias("trips"), *[F.count_if(c).alias(c) for c in (*_FLAGS, "is_anomalous")])


_FENCES = "fence AS (SELECT quantile_disc(total_distance_km, 0.99) AS fence_km, quantile_disc(sinuosity, 0.99) AS fence_sinuosity FROM feats WHERE NOT coalesce(is_teleport, false) AND NOT coalesce(is_too_fast, false))"


@query(f"WITH {O.FEATURES}, {_FENCES} SELECT round(fence_km, 6) AS fence_km, round(fence_sinuosity, 6) AS fence_sinuosity FROM fence")
def anomaly_fences(spark, sf):
    return rounded(quality.fences(quality.features(D.trips(spark, sf))), "fence_km", "fence_sinuosity")


_SCORES = """sc AS (SELECT id, CAST(coalesce(is_teleport OR is_too_fast, false) AS INTEGER) AS a_speed, CAST(coalesce(is_idle, false) AS INTEGER) AS a_idle, CAST(coalesce(total_distance_km > fence_km, false) AS INTEGER) AS a_distance,
 CAST(coalesce(sinuosity > fence_sinuosity, false) AS INTEGER) AS a_shape, CAST(coalesce(is_offgrid, false) AS INTEGER) AS a_drift, total_distance_km FROM feats, fence)"""


@query(f"WITH {O.FEATURES}, {_FENCES}, {_SCORES} SELECT id, a_speed, a_idle, a_distance, a_shape, a_drift, a_speed + a_idle + a_distance + a_shape + a_drift AS anomaly_score, round(total_distance_km, 6) AS dist_km FROM sc WHERE a_speed + a_idle + a_distance + a_shape + a_drift > 0 ORDER BY anomaly_score DESC, round(sc.total_distance_km, 9) DESC NULLS LAST, id LIMIT 50")
def anomaly_top50(spark, sf):
    s = quality.anomaly_scores(quality.features(D.trips(spark, sf))).withColumn("total_distance_km", F.round("total_distance_km", 9))
    return quality.top_anomalies(s).select("id", "a_speed", "a_idle", "a_distance", "a_shape", "a_drift", "anomaly_score", F.round("total_distance_km", 6).alias("dist_km"))


# ---- encoding


@query(f"WITH {O.CELLS} SELECT id, cell, CAST(k AS INTEGER) AS k FROM cells")
def traj_cells(spark, sf):
    return encoding.encode(D.trips(spark, sf)).select("id", F.posexplode("cells").alias("k", "cell")).select("id", "cell", (F.col("k") + 1).alias("k"))


@query(f"WITH {O.CELLS} SELECT id, seg, CAST(len(cells) AS INTEGER) AS n, array_to_string(cells, '>') AS key, round(cums[-1], 6) AS km FROM segs")
def traj_gap_segments(spark, sf):
    s = encoding.segments(encoding.encode(D.trips(spark, sf)))
    return s.select("id", "seg", F.size("cells").alias("n"), F.array_join("cells", S.SEP).alias("key"), F.round(F.element_at("cum", -1), 6).alias("km"))


@query(f"WITH {O.CELLS} SELECT id, CAST(count(*) AS INTEGER) AS n_cells, round(coalesce(sum(km), 0), 6) AS encoded_len_km, round(coalesce(max(km), 0), 6) AS max_hop_km FROM hopkm GROUP BY id")
def traj_hops(spark, sf):
    return rounded(encoding.encode(D.trips(spark, sf)).select("id", "n_cells", "encoded_len_km", "max_hop_km"), "encoded_len_km", "max_hop_km")


@query(
    f"""WITH {O.CELLS}, per AS (SELECT id, count(*) AS n, sum(km) AS km, max(km) AS hop FROM hopkm GROUP BY id), r AS (SELECT id, count(*) AS raw FROM rawc GROUP BY id)
 SELECT count(*) AS trips, round(avg(raw), 6) AS avg_raw, round(avg(n), 6) AS avg_cells, round(avg(CAST(raw AS DOUBLE) / n), 6) AS avg_ratio, round(max(coalesce(hop, 0)), 6) AS worst_hop_km, count(*) FILTER (hop > {C.MAX_HOP_KM!r}) AS over_bound FROM per JOIN r USING (id)"""
)
def encoding_summary(spark, sf):
    return rounded(encoding.encoding_summary(encoding.encode(D.trips(spark, sf))), "avg_raw", "avg_cells", "avg_ratio", "worst_hop_km")




@query(
    f"""WITH {O.FEATURES}, parts AS (SELECT id, CASE WHEN km > {geo.cell_step_km() / 8!r}::DOUBLE AND km <= {C.MAX_HOP_KM!r}::DOUBLE THEN CAST(ceil(km / {geo.cell_step_km() / 8!r}::DOUBLE) AS BIGINT) ELSE 1 END AS k FROM hop)
 SELECT id, CAST(sum(k) AS BIGINT) AS n_filled FROM parts GROUP BY id"""
)
def traj_densify(spark, sf):
    """The first point counts as one part, as every other step counts its parts."""
    t = D.trips(spark, sf)
    return t.select("id", F.size(geo.densify(F.col("points"), geo.cell_step_km() / 8, C.MAX_HOP_KM)).cast("long").alias("n_filled"))


@query(f"WITH {O.CELLS}, c AS (SELECT id, cell, count(*) AS n FROM cells GROUP BY id, cell) SELECT id, max(n) <= 2 AS ok FROM c GROUP BY id")
def revisit_guard(spark, sf):
    return encoding.encode(D.trips(spark, sf)).select("id", S.revisits_ok(F.col("cells")).alias("ok"))


@query(
    f"""WITH {O.CELLS}, st AS (SELECT pc2 AS f, cell AS t, count(*) AS c FROM hops WHERE pc2 IS NOT NULL GROUP BY pc2, cell)
, br AS (SELECT f, c, degrees(atan2(sin(radians(lo2 - lo1)) * cos(radians(la2)), cos(radians(la1)) * sin(radians(la2)) - sin(radians(la1)) * cos(radians(la2)) * cos(radians(lo2 - lo1)))) AS d
 FROM (SELECT f, c, {O.centre('f')[0]} AS lo1, {O.centre('f')[1]} AS la1, {O.centre('t')[0]} AS lo2, {O.centre('t')[1]} AS la2 FROM st))
, sec AS (SELECT f, CAST(floor((CASE WHEN d < 0 THEN d + 360 ELSE d END) / 45) AS BIGINT) AS s, sum(c) AS c FROM br GROUP BY 1, 2), tot AS (SELECT f, sum(c) AS n FROM sec GROUP BY f)
 SELECT f AS cell, CAST(n AS BIGINT) AS n, round(abs(-sum(c / n * log2(c / n))), 6) AS entropy FROM sec JOIN tot USING (f) GROUP BY f, n"""
)
def grid_entropy(spark, sf):
    e = encoding.cell_entropy(encoding.encode(D.trips(spark, sf)))
    return e.select("cell", "n", F.round(F.abs("entropy"), 6).alias("entropy"))


_GRIDS = [(f"hex_{e}", O.hex_cell("lon", "lat", e)) for e in (0.461, 0.174, 0.066)] + [(f"geohash_{k}", O.geohash("lon", "lat", k)) for k in (6, 7)]


@query(f"WITH {O.PTS} SELECT grid, trips, round(avg_cells, 6) AS avg_cells, round(avg_ratio, 6) AS avg_ratio, cells FROM ({' UNION ALL '.join(O.grid_stats(n, c) for n, c in _GRIDS)})")
def grid_compare(spark, sf):
    return rounded(encoding.grid_comparison(D.trips(spark, sf)), "avg_cells", "avg_ratio")


@query(f"WITH {O.PTS} SELECT {O.geohash('lon', 'lat', 6)} AS cell, count(*) AS n FROM pts GROUP BY 1")
def geohash_cells(spark, sf):
    p = D.trip_points(spark, sf)
    return p.groupBy(geo.geohash(F.col("lon"), F.col("lat"), 6).alias("cell")).agg(F.count("*").alias("n"))


# ---- closed, maximal, floors, holes

_GRAMS = f"{O.WSEQ}, {O.grams(2, 8)}, {O.SUPPORT}, {O.EXT}"
_EXT_COLS = "key, CAST(n AS INTEGER) AS n, support, best_right, best_left"


def _weekly(spark, sf):
    return mining.token_support(D.event_sequences(spark, sf, weekly=True), 2, 8)


@query(f"WITH {_GRAMS} SELECT {_EXT_COLS} FROM ext WHERE greatest(best_right, best_left) < support")
def closed_ngrams(spark, sf):
    return mining.closed(_weekly(spark, sf)).select("key", "n", "support", "best_right", "best_left")


@query(f"WITH {_GRAMS} SELECT {_EXT_COLS} FROM ext WHERE support >= 10 AND greatest(best_right, best_left) < 10")
def maximal_ngrams(spark, sf):
    return mining.maximal(_weekly(spark, sf), 10).select("key", "n", "support", "best_right", "best_left")


@query(
    f"""WITH {_GRAMS}, fl AS (SELECT f FROM (VALUES {', '.join(f'({f})' for f in C.SUPPORT_FLOORS)}) v(f) WHERE f <= (SELECT count(*) FROM seqs))
, cnt AS (SELECT band, f, (SELECT count(*) FROM ext WHERE support >= f AND greatest(best_right, best_left) < f AND n >= band) AS routes FROM fl, (VALUES (2), (3), (4), (6)) b(band))
 SELECT CAST(band AS DOUBLE) AS band, CAST(f AS INTEGER) AS floor, routes, f = coalesce(max(CASE WHEN routes >= 100 THEN f END) OVER (PARTITION BY band), min(f) OVER (PARTITION BY band)) AS chosen FROM cnt"""
)
def floor_calibration(spark, sf):
    n = D.event_sequences(spark, sf, weekly=True).count()
    return mining.calibrate(mining.extensions(_weekly(spark, sf)), n, (2, 3, 4, 6))


@query(
    f"""WITH {_GRAMS}, fl AS (SELECT greatest(2, CAST(ceil(0.005e0 * count(*)) AS BIGINT)) AS f FROM seqs), best AS (SELECT key, support FROM ext, fl WHERE support >= f AND greatest(best_right, best_left) < f ORDER BY support DESC, n DESC, key LIMIT 5)
 SELECT key, support, child, child_support FROM (SELECT b.key, b.support, k.key AS child, k.support AS child_support, row_number() OVER (PARTITION BY b.key ORDER BY k.support DESC NULLS LAST, k.key) AS r FROM best b
 LEFT JOIN sup k ON regexp_extract(k.key, '^(.*)>[^>]*$', 1) = b.key) WHERE r <= 3"""
)
def support_holes(spark, sf):
    n = D.event_sequences(spark, sf, weekly=True).count()
    return mining.holes(_weekly(spark, sf), n).select("key", "support", "child", "child_support")


# ---- suffix repeats


def _repeat_sql(base: str, least: int) -> str:
    return f"""{base}, {O.grams(3, None)}, rep AS (SELECT key, n, count(DISTINCT id) AS support, count(DISTINCT entity) AS support_entities FROM grams GROUP BY key, n
 HAVING count(DISTINCT id) >= {least} AND count(*) > 1 AND (count(DISTINCT nxt) > 1 OR count(*) FILTER (nxt IS NULL) > 0))
, lft AS (SELECT key, max(c) AS m FROM (SELECT key, prev, count(DISTINCT id) AS c FROM grams WHERE prev IS NOT NULL GROUP BY key, prev) GROUP BY key)
, rgt AS (SELECT a.key, max(b.support) AS m FROM rep a JOIN rep b ON starts_with(b.key, a.key || '>') GROUP BY a.key)
, repeats AS (SELECT rep.key, support, support_entities, CAST(n AS INTEGER) AS n, coalesce(rgt.m, 0) AS best_right, coalesce(lft.m, 0) AS best_left FROM rep LEFT JOIN rgt USING (key) LEFT JOIN lft USING (key))"""


@query(f"WITH {_repeat_sql(O.WSEQ, 3)} SELECT * FROM repeats")
def suffix_repeats(spark, sf):
    return repeats.mine(D.event_sequences(spark, sf, weekly=True), 3)


@query(f"WITH {_repeat_sql(O.WSEQ, 3)} SELECT * FROM repeats WHERE support >= 5 AND greatest(best_right, best_left) < 5")
def suffix_maximal(spark, sf):
    return repeats.maximal_at(repeats.mine(D.event_sequences(spark, sf, weekly=True), 3), 5)


@query(f"WITH {_repeat_sql(O.SUPPLIERS, 2)} SELECT key, support, support_entities FROM repeats")
def repeat_entities(spark, sf):
    return repeats.mine(D.supplier_sequences(spark, sf), 2).select("key", "support", "support_entities")


def _bucket_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN hour({c}) >= {a} AND hour({c}) < {b} THEN '{n}'" for n, a, b in C.TIME_BUCKETS) + " END"


@query(
    f"""WITH {O.EV}, st AS (SELECT wid AS id, {_bucket_sql('min(ts)')} AS bucket FROM ev GROUP BY wid), tok AS (SELECT wid AS id, entity, event_type AS tok, row_number() OVER (PARTITION BY wid ORDER BY ts, event_id) AS pos FROM ev)
, seqs AS (SELECT id, entity, list(tok ORDER BY pos) AS seq FROM tok GROUP BY id, entity), {O.grams(3, 3)}
 SELECT bucket, key, count(DISTINCT id) AS support FROM grams JOIN st USING (id) GROUP BY bucket, key HAVING count(DISTINCT id) >= 2"""
)
def temporal_support(spark, sf):
    """Support by the hour bucket in which a sequence starts."""
    start = D.table(spark, sf, "events").groupBy(D.week_id().alias("id")).agg(F.min("ts").alias("s"))
    seq = D.event_sequences(spark, sf, weekly=True).join(start, "id").select("id", compare.hour_bucket(F.hour("s")).alias("bucket"), F.explode(S.ngrams(F.col("seq"), 3)).alias("key"))
    return seq.groupBy("bucket", "key").agg(F.count("*").alias("support")).filter("support >= 2")


_FLOOR_PCT = 0.05


@query(
    f"""WITH {O.WSEQ}, {O.grams(3, None)}, st AS (SELECT wid AS id, {_bucket_sql('min(ts)')} AS bucket FROM ev GROUP BY wid), sb AS (SELECT id, bucket FROM st UNION ALL SELECT id, 'all' FROM st), nb AS (SELECT bucket, count(*) AS trips, greatest(2, CAST(round({_FLOOR_PCT / 100!r}::DOUBLE * count(*)) AS BIGINT)) AS floor FROM sb GROUP BY bucket)
, rep AS (SELECT bucket, key, n, count(DISTINCT id) AS support FROM grams JOIN sb USING (id) GROUP BY bucket, key, n HAVING count(DISTINCT id) >= 2 AND count(*) > 1 AND (count(DISTINCT nxt) > 1 OR count(*) FILTER (nxt IS NULL) > 0))
, lft AS (SELECT bucket, key, max(c) AS m FROM (SELECT bucket, key, prev, count(DISTINCT id) AS c FROM grams JOIN sb USING (id) WHERE prev IS NOT NULL GROUP BY bucket, key, prev) GROUP BY bucket, key)
, rgt AS (SELECT a.bucket, a.key, max(b.support) AS m FROM rep a JOIN rep b ON b.bucket = a.bucket AND starts_with(b.key, a.key || '>') GROUP BY a.bucket, a.key)
, mx AS (SELECT bucket, rep.key, support FROM rep JOIN nb USING (bucket) LEFT JOIN lft USING (bucket, key) LEFT JOIN rgt USING (bucket, key) WHERE support >= floor AND greatest(coalesce(lft.m, 0), coalesce(rgt.m, 0)) < floor)
, top AS (SELECT bucket, list_distinct(string_split(key, '>')) AS s FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY support DESC, key) AS r FROM mx) WHERE r <= 100)
, ov AS (SELECT bucket, count(*) AS routes, count(*) FILTER (EXISTS (SELECT 1 FROM top y WHERE y.bucket = 'all' AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE >= 0.5)) AS matched FROM top x WHERE bucket <> 'all' GROUP BY bucket)
 SELECT bucket, trips, CAST(floor AS BIGINT) AS floor, routes, matched, round(matched / routes::DOUBLE, 6) AS share, CASE WHEN avg(matched / routes::DOUBLE) OVER () >= 0.8 THEN 'structural' WHEN avg(matched / routes::DOUBLE) OVER () >= 0.5 THEN 'shared core' ELSE 'distinct' END AS verdict FROM ov JOIN nb USING (bucket)"""
)
def temporal_overlap(spark, sf):
    """A row a bucket of start hours: its maximal repeats matched against those of all sequences, and the verdict on the mean.

    All buckets are mined at once, at the lowest floor, with the bucket in each token; a bucket's own floor is a share of
    its sequences.
    """
    return compare.temporal_overlap(D.event_sequences(spark, sf, weekly=True).join(D.table(spark, sf, "events").groupBy(D.week_id().alias("id")).agg(compare.hour_bucket(F.hour(F.min("ts"))).alias("bucket")), "id"), _FLOOR_PCT).withColumn("share", F.round("share", 6))


# ---- graph


@query(f"WITH {O.CELLTOK}, {O.EDGES} SELECT f, t, w FROM edges")
def transition_edges(spark, sf):
    return graph.edges(_cells(spark, sf))


def _cells(spark, sf):
    return encoding.encode(D.trips(spark, sf)).select("id", "entity", F.col("cells").alias("seq"))


_RANK = """nodes AS (SELECT f AS node FROM edges UNION SELECT t FROM edges), outw AS (SELECT f, sum(w) AS ow FROM edges GROUP BY f), nn AS (SELECT count(*) AS c FROM nodes), r0 AS (SELECT node, 1e0 / c AS pr FROM nodes, nn)"""
for _i in range(1, C.PAGERANK_ITERATIONS + 1):
    _RANK += f""", d{_i} AS MATERIALIZED (SELECT coalesce(sum(pr), 0) AS lost FROM r{_i - 1} WHERE node NOT IN (SELECT f FROM outw)), r{_i} AS MATERIALIZED (SELECT node, 0.15e0 / c + 0.85e0 * lost / c + 0.85e0 * coalesce(s, 0) AS pr FROM nodes CROSS JOIN nn CROSS JOIN d{_i} LEFT JOIN
 (SELECT t, sum(pr * w / ow) AS s FROM edges JOIN outw USING (f) JOIN r{_i - 1} ON node = f GROUP BY t) x ON x.t = node)"""


@query(f"WITH {O.CELLTOK}, {O.EDGES}, {_RANK} SELECT node, round(pr, 9) AS rank FROM r{C.PAGERANK_ITERATIONS}")
def pagerank(spark, sf):
    return rounded(graph.pagerank(graph.edges(_cells(spark, sf))), "rank", digits=9)


@query(
    f"""WITH {O.CELLTOK}, {O.EDGES}, {_RANK} SELECT node, round(pr, 9) AS rank, CAST(coalesce((SELECT sum(w) FROM edges WHERE t = node), 0) AS BIGINT) AS in_traffic, (SELECT count(DISTINCT entity) FROM tok WHERE tok = node) AS entities,
 round({O.centre('node')[0]}, 6) AS lon, round({O.centre('node')[1]}, 6) AS lat FROM r{C.PAGERANK_ITERATIONS} ORDER BY round(pr, 12) DESC, node LIMIT 50"""
)
def activity_zones(spark, sf):
    c = _cells(spark, sf)
    z = graph.activity_zones(graph.edges(c), c.select(F.explode("seq").alias("node"), "entity"))
    return rounded(rounded(z.select("node", "rank", "in_traffic", "entities", "lon", "lat"), "rank", digits=9), "lon", "lat")


@query(
    f"""WITH {O.CELLTOK}, {O.EDGES}, {_RANK}, z AS (SELECT node, pr FROM r{C.PAGERANK_ITERATIONS} ORDER BY round(pr, 12) DESC, node LIMIT 50) SELECT node, (SELECT count(DISTINCT entity) FROM tok WHERE tok = node) AS entities, true AS close FROM z"""
)
def activity_zones_sketched(spark, sf):
    """Distinct entities of the zones by a HyperLogLog sketch, held against the exact counts: close is within a tenth."""
    c = _cells(spark, sf)
    e, visits = graph.edges(c), c.select(F.explode("seq").alias("node"), "entity")
    exact = visits.groupBy("node").agg(F.countDistinct("entity").alias("entities"))
    z = graph.activity_zones(e, visits, exact=False).select("node", F.col("entities").alias("guess")).join(exact, "node")
    return z.select("node", "entities", (F.abs(F.col("guess") - F.col("entities")) <= F.greatest(F.lit(1), 0.1 * F.col("entities"))).alias("close"))


@query(f"WITH {O.CELLTOK}, {O.EDGES} SELECT DISTINCT t AS node FROM edges WHERE t NOT IN (SELECT f FROM edges)")
def dangling_nodes(spark, sf):
    return graph.dangling(graph.edges(_cells(spark, sf)))


_WALK = "SELECT sid, {add}, km + c.km AS km, k + 1 AS k FROM (SELECT x.*, list_filter(nx, lambda s: NOT list_contains(path, s.t))[1] AS c FROM {name} x JOIN {table} ON node = path[{end}]) WHERE c IS NOT NULL AND km + c.km <= 60"
_PATHS = f"""fr AS (SELECT f, t, w, {O.cell_hop('f', 't')} AS km FROM edges WHERE w >= 5)
, fwd AS (SELECT f AS node, list(struct_pack(t := t, km := km) ORDER BY w DESC, t DESC) FILTER (w / tot >= 0.4e0) AS nx FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY f) AS DOUBLE) AS tot FROM fr) GROUP BY f)
, bwd AS (SELECT t AS node, list(struct_pack(t := f, km := km) ORDER BY w DESC, f DESC) FILTER (w / tot >= 0.4e0) AS nx FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY t) AS DOUBLE) AS tot FROM fr) GROUP BY t)
, seeds AS (SELECT row_number() OVER () AS sid, [f, t] AS path, km FROM (SELECT * FROM fr ORDER BY w DESC, f, t LIMIT 3000))
, ahead AS (SELECT sid, path, km, 0 AS k FROM seeds UNION ALL {_WALK.format(add='list_append(path, c.t) AS path', name='ahead', table='fwd', end='-1')})
, mid AS (SELECT sid, arg_max(path, k) AS path, arg_max(km, k) AS km FROM ahead GROUP BY sid)
, back AS (SELECT sid, path, km, 0 AS k FROM mid UNION ALL {_WALK.format(add='list_prepend(c.t, path) AS path', name='back', table='bwd', end='1')})
, routes AS (SELECT DISTINCT array_to_string(path, '>') AS key FROM (SELECT sid, arg_max(path, k) AS path FROM back GROUP BY sid))
, lines AS (SELECT id, '>' || string_agg(tok, '>' ORDER BY pos) || '>' AS line FROM tok GROUP BY id)"""


@query(f"WITH RECURSIVE {O.CELLTOK}, {O.EDGES}, {_PATHS} SELECT key, count(*) AS support FROM routes JOIN lines ON contains(line, '>' || key || '>') GROUP BY key")
def heavy_paths(spark, sf):
    """Dominant-flow paths that whole trips follow, with their support."""
    c = _cells(spark, sf)
    e = graph.edges(c).withColumn("km", geo.cell_hop_km(F.col("f"), F.col("t")))
    paths = graph.heavy_paths(e)
    return match.containment_support(c, match.as_patterns(paths)).filter("support > 0").withColumnRenamed("pattern_id", "key")


@query(f"WITH RECURSIVE {O.CELLTOK}, {O.EDGES}, {_PATHS}, s AS (SELECT key, count(*) AS support FROM routes JOIN lines ON contains(line, '>' || key || '>') GROUP BY key) SELECT key, support, CAST(row_number() OVER (ORDER BY support DESC, len(string_split(key, '>')) DESC, key) AS INTEGER) AS rank FROM s ORDER BY rank LIMIT 100")
def heavy_paths_top(spark, sf):
    """The best of them, in one order for all engines: support, length, key."""
    return mining.banded_top(heavy_paths(spark, sf).withColumn("n", F.size(F.split("key", S.SEP))), (1,), length="n", least_support=1).select("key", "support", "rank")


# ---- containment, mixes, hold-out



@query("WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') || ' ' AS p FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) AND p <> '  '")
def pattern_containment(spark, sf):
    words = lambda c: F.expr(f"filter(split(lower({c}), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words("text").alias("seq"))
    pats = D.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("pattern_id"), words("text").alias("tokens"))
    return match.matches(docs, pats).select(F.col("id").alias("doc_id"), F.col("pattern_id").cast("long").alias("item_id"))


@query(
    f"""WITH {O.WSEQ}, {O.grams(3, 3)}, {O.SUPPORT}, top AS (SELECT key FROM sup ORDER BY support DESC, key LIMIT 20), hit AS (SELECT DISTINCT id FROM grams JOIN top USING (key)), lab AS (SELECT id, ['A', 'B', 'C'][id % 3 + 1] AS call FROM seqs)
 SELECT call, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round((SELECT count(*) FROM lab l2 WHERE l2.call = lab.call) / (SELECT count(*) FROM lab)::DOUBLE, 6) AS base_share FROM hit JOIN lab USING (id) GROUP BY call"""
)
def call_mix(spark, sf):
    seq = D.event_sequences(spark, sf, weekly=True)
    top = mining.token_support(seq, 3, 3).orderBy(F.desc("support"), "key").limit(20)
    hit = match.matches(seq, match.as_patterns(top)).select(F.lit(1).alias("band"), "id")
    labels = seq.select("id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("call"))
    return rounded(compare.mix(hit, labels, "call").select("call", "n", "share", "base_share"), "share", "base_share")


@query(
    f"""WITH {O.WSEQ}, {O.grams(4, 4)}, tr AS (SELECT key FROM grams WHERE id % 5 <> 0 GROUP BY key ORDER BY count(DISTINCT id) DESC, key LIMIT 50), hit AS (SELECT DISTINCT id FROM grams JOIN tr USING (key) WHERE id % 5 = 0)
 SELECT (SELECT count(*) FROM seqs WHERE id % 5 = 0) AS segments, (SELECT count(*) FROM hit) AS matched, round((SELECT count(*) FROM hit) / (SELECT count(*) FROM seqs WHERE id % 5 = 0)::DOUBLE, 6) AS coverage"""
)
def holdout_coverage(spark, sf):
    """How many unseen sequences (every fifth id) hold one of the 50 best patterns of the others."""
    seq = D.event_sequences(spark, sf, weekly=True)
    best = mining.token_support(seq.filter("id % 5 <> 0"), 4, 4).orderBy(F.desc("support"), "key").limit(50)
    return rounded(compare.coverage(seq.filter("id % 5 = 0"), match.as_patterns(best)), "coverage")


_NULL = """wk AS (SELECT key, n, row_number() OVER (ORDER BY support DESC, key) - 1 AS walk FROM (SELECT key, n, count(DISTINCT id) AS support FROM grams WHERE id % 5 <> 0 GROUP BY key, n ORDER BY support DESC, key LIMIT 50))
, stp AS (SELECT DISTINCT tok AS f, t FROM (SELECT id, tok, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS t FROM tok WHERE id % 5 <> 0) WHERE t IS NOT NULL)
, sts AS (SELECT f, row_number() OVER (ORDER BY md5('42:' || f), f) - 1 AS i FROM (SELECT DISTINCT f FROM stp) ORDER BY i LIMIT 50), walks AS (SELECT walk, n, 1 AS i, [f] AS path FROM wk JOIN sts ON sts.i = walk % (SELECT count(*) FROM sts)
 UNION ALL SELECT walk, n, i + 1, list_append(path, nt) FROM (SELECT walk, any_value(n) AS n, any_value(w.i) AS i, any_value(path) AS path, arg_min(t, md5('42:' || CAST(w.i AS VARCHAR) || ':' || CAST(walk AS VARCHAR) || ':' || t)) AS nt FROM walks w JOIN stp ON f = path[-1] WHERE w.i < n GROUP BY walk))
, null_keys AS (SELECT array_to_string(arg_max(path, i), '>') AS key FROM walks GROUP BY walk), unseen AS (SELECT id, '>' || array_to_string(seq, '>') || '>' AS line FROM seqs WHERE id % 5 = 0)
, cov AS (SELECT (SELECT count(*) FROM unseen WHERE EXISTS (SELECT 1 FROM wk WHERE contains(line, '>' || key || '>'))) / (SELECT count(*) FROM unseen)::DOUBLE AS own, (SELECT count(*) FROM unseen WHERE EXISTS (SELECT 1 FROM null_keys WHERE contains(line, '>' || key || '>'))) / (SELECT count(*) FROM unseen)::DOUBLE AS random)"""


@query(f"WITH RECURSIVE {O.WSEQ}, {O.grams(3, 6)}, {_NULL} SELECT round(own, 6) AS own, round(random, 6) AS random, round(CASE WHEN random > 0 THEN own / random ELSE 'inf'::DOUBLE END, 6) AS lift FROM cov")
def holdout_lift(spark, sf):
    """Coverage of unseen sequences by the best patterns, against random walks of the same lengths on the observed steps."""
    seq = D.event_sequences(spark, sf, weekly=True)
    seen, unseen = seq.filter("id % 5 <> 0"), seq.filter("id % 5 = 0")
    best = mining.token_support(seen, 3, 6).orderBy(F.desc("support"), "key").limit(50)
    lengths = [r["n"] for r in best.select("n", "support", "key").orderBy(F.desc("support"), "key").collect()]
    own = compare.coverage(unseen, match.as_patterns(best))
    null = compare.coverage(unseen, compare.null_walks(graph.edges(seen), lengths))
    return rounded(compare.lift(own, null), "own", "random", "lift")


# ---- similarity

_SHINGLES = f"{O.WSEQ}, {O.grams(2, 2)}, sh AS (SELECT DISTINCT id, key FROM grams), sz AS (SELECT id, count(*) AS c FROM sh GROUP BY id)"


@query(f"WITH {_SHINGLES}, ix AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM sh x JOIN sh y ON x.key = y.key AND x.id < y.id GROUP BY x.id, y.id) SELECT a, b, round(i / (p.c + q.c - i)::DOUBLE, 6) AS jaccard FROM ix JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE i / (p.c + q.c - i)::DOUBLE >= 0.7")
def jaccard_pairs_exact(spark, sf):
    return rounded(similarity.jaccard_pairs(similarity.shingled(D.event_sequences(spark, sf, weekly=True)), 0.7), "jaccard")


_MINIMA = ", ".join(f"list_min(list_transform(sh, lambda x: substr(sha256(x), {12 * t + 1}, 12)))" for t in range(C.LSH_TABLES))


@query(
    f"""WITH {O.WORDS}, mh AS (SELECT id, unnest([{_MINIMA}]) AS h, unnest(generate_series(1, {C.LSH_TABLES})) AS t FROM shs), cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM mh x JOIN mh y ON x.t = y.t AND x.h = y.h AND x.id < y.id)
, jc AS (SELECT a, b, len(list_intersect(p.sh, q.sh)) AS i, len(p.sh) + len(q.sh) AS s FROM cand JOIN shs p ON p.id = a JOIN shs q ON q.id = b) SELECT a, b, round(1 - i / (s - i)::DOUBLE, 6) AS distance FROM jc WHERE i / (s - i)::DOUBLE >= {1 - C.LSH_MAX_DISTANCE - 1e-12!r}::DOUBLE"""
)
def lsh_pairs(spark, sf):
    return rounded(similarity.lsh_pairs(similarity.shingled(D.word_sequences(spark, sf))), "distance")


_STARS = f"""{O.WORDS}, sx AS (SELECT id, unnest(sh) AS s FROM shs), rare AS (SELECT s FROM sx GROUP BY s HAVING count(*) > 1), ix AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM sx x JOIN rare USING (s) JOIN sx y USING (s) WHERE x.id < y.id GROUP BY 1, 2)
, ed AS (SELECT a, b FROM ix JOIN shs p ON p.id = a JOIN shs q ON q.id = b WHERE i / (len(p.sh) + len(q.sh) - i)::DOUBLE >= 0.6), nb AS (SELECT id, list(o) AS near, count(*) AS d FROM (SELECT a AS id, b AS o FROM ed UNION ALL SELECT b, a FROM ed) GROUP BY id)
, od AS (SELECT id, near, row_number() OVER (ORDER BY d DESC, id) AS k FROM nb), step AS (SELECT 0::BIGINT AS k, 0::BIGINT AS cid, []::BIGINT[] AS own, []::BIGINT[] AS gone
 UNION ALL SELECT k, id, own, list_concat(gone, own) FROM (SELECT od.k, id, gone, CASE WHEN list_contains(gone, id) OR len(list_filter(near, lambda x: NOT list_contains(gone, x))) < 2 THEN []::BIGINT[] ELSE list_append(list_filter(near, lambda x: NOT list_contains(gone, x)), id) END AS own FROM step JOIN od ON od.k = step.k + 1))"""


@query(f"WITH RECURSIVE {_STARS} SELECT cid, unnest(own) AS node FROM step")
def star_clusters(spark, sf):
    return similarity.class_clusters(*similarity.jaccard_classes(similarity.shingled(D.word_sequences(spark, sf)), 0.6))


@query()
def shared_runs(spark, sf):
    seq = D.word_sequences(spark, sf)
    return similarity.shared_runs(similarity.class_clusters(*similarity.jaccard_classes(similarity.shingled(seq), 0.6)), seq)


# ---- sketches


def _grams(spark, sf, low=2, high=4):
    return D.event_sequences(spark, sf, weekly=True).select("id", F.explode(S.windows_up_to(F.col("seq"), low, high)).alias("w")).select("id", "w.key", "w.n")


@query(f"WITH {O.WSEQ}, {O.grams(2, 4)}, {O.SUPPORT} SELECT key, support FROM sup ORDER BY support DESC, key LIMIT 50")
def topk_sketch(spark, sf):
    """Candidates from the sketch, recounted exactly, the best 50."""
    rows = _grams(spark, sf)
    c = sketch.heavy_hitters(rows, k=200)
    return sketch.recounted(c, rows).orderBy(F.desc("support"), "key").limit(50).select("key", "support")


@query(f"WITH {O.WSEQ}, {O.grams(2, 4)}, {O.SUPPORT} SELECT CAST(band AS DOUBLE) AS band, key, support, rank FROM (SELECT band, key, support, CAST(row_number() OVER (PARTITION BY band ORDER BY support DESC, key) AS INTEGER) AS rank FROM sup, (VALUES (2), (3), (4)) b(band) WHERE n >= band AND support >= 2) WHERE rank <= 50")
def topk_sketch_bands(spark, sf):
    """One sketch a length band in one pass, candidates recounted exactly, the best 50 of each."""
    rows = _grams(spark, sf)
    found = sketch.recounted(sketch.heavy_hitters_by_band(rows, (2, 3, 4), k=200), rows)
    w = W.partitionBy("band").orderBy(F.desc("support"), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter("rank <= 50").select("band", "key", "support", "rank")


@query(f"WITH {O.WSEQ}, {O.grams(2, 4)}, {O.SUPPORT} SELECT key, support, true AS never_below, true AS close FROM sup ORDER BY support DESC, key LIMIT 100")
def cms_estimates(spark, sf):
    """Count-min estimates of the top keys: never below the count, and above it by at most the promised share of all rows."""
    rows = _grams(spark, sf)
    top = rows.groupBy("key").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "key").limit(100)
    eps = 2 / 131072
    j = sketch.count_min_estimates(top, sketch.count_min(rows, eps=eps)).join(top, "key").crossJoin(rows.agg(F.count("*").alias("rows")))
    return j.select("key", "support", (F.col("estimate") >= F.col("support")).alias("never_below"), (F.col("estimate") - F.col("support") <= F.ceil(F.col("rows") * eps)).alias("close"))


@query("SELECT event_type, count(DISTINCT user_id) AS exact FROM events GROUP BY event_type")
def distinct_exact(spark, sf):
    return sketch.distinct_counts(D.table(spark, sf, "events"), "event_type", "user_id").select("event_type", "exact")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS exact, true AS close FROM lineitem GROUP BY l_suppkey")
def hll_vs_exact(spark, sf):
    """Distinct orders of each supplier, exact and by HyperLogLog: close is within five standard errors of the sketch."""
    return sketch.distinct_counts(D.table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey").select("l_suppkey", "exact", (F.col("error") <= 0.1).alias("close"))


@query("SELECT count(DISTINCT l_suppkey) AS groups, true AS mean_within, true AS worst_within FROM lineitem")
def hll_error(spark, sf):
    """The sketch's mean relative and largest absolute error over all groups, against what it promises."""
    e = sketch.distinct_errors(sketch.distinct_counts(D.table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey"))
    return e.select("groups", (F.col("mean_relative") <= 0.04).alias("mean_within"), (F.col("largest_absolute") <= 0.1 * F.col("largest_exact")).alias("worst_within"))


@query("SELECT 0.25e0 AS quantile, quantile_disc(l_extendedprice, 0.25) AS value FROM lineitem UNION ALL SELECT 0.5e0, quantile_disc(l_extendedprice, 0.5) FROM lineitem UNION ALL SELECT 0.75e0, quantile_disc(l_extendedprice, 0.75) FROM lineitem")
def quantile_sketch(spark, sf):
    return quality.approximate_quantiles(D.table(spark, sf, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.75), error=1e-6)


@query("SELECT 100::BIGINT AS wanted, 100::BIGINT AS found, true AS recalled, 0e0 AS mae, 0e0 AS mre, 0e0 AS cms_mae")
def sketch_accuracy(spark, sf):
    """Top-100 sketch against exact counts: at this capacity no key is evicted, so that estimates are exact but ties may be cut
    differently; and the count-min sketch's mean error on the same keys."""
    rows = _grams(spark, sf)
    exact = rows.groupBy("key").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "key").limit(100)
    cms = sketch.count_min_estimates(exact, sketch.count_min(rows)).join(exact, "key").agg(F.avg(F.col("estimate") - F.col("support")).alias("cms_mae"))
    a = sketch.accuracy(sketch.heavy_hitters(rows, k=100), exact).crossJoin(cms)
    return rounded(a.select("wanted", "found", (F.col("recall") >= 0.9).alias("recalled"), "mae", "mre", "cms_mae"), "mae", "mre", "cms_mae")


# ---- comparisons


def _two(spark, sf):
    seq = D.event_sequences(spark, sf, weekly=True)
    t = mining.token_support(seq, 3, 3)
    return t.orderBy(F.desc("support"), "key").limit(40), mining.token_support(seq.filter("id % 2 = 0"), 3, 3).orderBy(F.desc("support"), "key").limit(40)


_TWO = f"{O.WSEQ}, {O.grams(3, 3)}, a AS (SELECT key, count(DISTINCT id) AS support FROM grams GROUP BY key ORDER BY 2 DESC, 1 LIMIT 40), b AS (SELECT key, count(DISTINCT id) AS support FROM grams WHERE id % 2 = 0 GROUP BY key ORDER BY 2 DESC, 1 LIMIT 40)"


@query(
    f"""WITH {_TWO}, m AS (SELECT a.key FROM a WHERE EXISTS (SELECT 1 FROM b WHERE len(list_intersect(string_split(a.key, '>'), string_split(b.key, '>'))) / len(list_distinct(list_concat(string_split(a.key, '>'), string_split(b.key, '>'))))::DOUBLE >= 0.5))
 SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM m) / (SELECT count(*) FROM a)::DOUBLE AS share"""
)
def method_overlap(spark, sf):
    a, b = (x.select(F.split("key", S.SEP).alias("tokens")) for x in _two(spark, sf))
    return similarity.set_match_share(a, b)


@query(f"WITH {_TWO} SELECT count(*) AS total, count(b.key) AS found, count(*) FILTER (b.support <> a.support) AS mismatched, count(b.key) / count(*)::DOUBLE AS recall FROM a LEFT JOIN b USING (key)")
def exact_recall(spark, sf):
    return compare.exact_recall(*_two(spark, sf))


def _miners(spark, sf):
    """The top 40 of the window counts and of the suffix repeats, both over all weekly sequences."""
    seq = D.event_sequences(spark, sf, weekly=True)
    top = lambda t: t.select("key", "support").orderBy(F.desc("support"), "key").limit(40)
    return top(mining.token_support(seq, 3, 8)), top(repeats.mine(seq, 3))


_MINERS = f"""{_repeat_sql(O.WSEQ, 3)}, a AS (SELECT key, count(DISTINCT id) AS support FROM grams WHERE n <= 8 GROUP BY key ORDER BY support DESC, key LIMIT 40), b AS (SELECT key, support FROM repeats ORDER BY support DESC, key LIMIT 40)"""


@query(
    f"""WITH {_MINERS}, m AS (SELECT a.key FROM a WHERE EXISTS (SELECT 1 FROM b WHERE len(list_intersect(string_split(a.key, '>'), string_split(b.key, '>'))) / len(list_distinct(list_concat(string_split(a.key, '>'), string_split(b.key, '>'))))::DOUBLE >= 0.5))
 SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM m) / (SELECT count(*) FROM a)::DOUBLE AS share"""
)
def method_overlap_miners(spark, sf):
    a, b = (x.select(F.split("key", S.SEP).alias("tokens")) for x in _miners(spark, sf))
    return similarity.set_match_share(a, b)


@query(f"WITH {_MINERS} SELECT count(*) AS total, count(b.key) AS found, count(*) FILTER (b.support <> a.support) AS mismatched, count(b.key) / count(*)::DOUBLE AS recall FROM a LEFT JOIN b USING (key)")
def exact_recall_miners(spark, sf):
    return compare.exact_recall(*_miners(spark, sf))


@query(f"WITH {O.SUPPLIERS}, {O.grams(2, 2)}, s AS (SELECT key, count(DISTINCT id) AS p, count(DISTINCT entity) AS e FROM grams GROUP BY key) SELECT count(*) AS routes, round(avg(p / e::DOUBLE), 6) AS per_entity, count(*) FILTER (e = 1) AS single_entity FROM s")
def entity_diversity(spark, sf):
    return rounded(compare.entity_diversity(mining.token_support(D.supplier_sequences(spark, sf), 2, 2, entities=True)), "per_entity")


@query(f"WITH {O.WSEQ}, s AS (SELECT entity, len(seq) AS n FROM seqs) SELECT entity, CAST(list_sort(list(n))[count(*) // 2 + 1] AS INTEGER) AS median FROM s GROUP BY entity")
def upper_medians(spark, sf):
    return compare.upper_median(D.event_sequences(spark, sf, weekly=True).select("entity", F.size("seq").alias("n")), ["entity"], "n")


@query("WITH c AS (SELECT l_suppkey, count(*) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY l_suppkey) SELECT round(exp(regr_intercept(ln(y), ln(x))), 6) AS a, round(regr_slope(ln(y), ln(x)), 6) AS b, round(regr_r2(ln(y), ln(x)), 6) AS r2, count(*) AS n FROM c")
def powerlaw_fit(spark, sf):
    c = D.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("x"), F.sum("l_quantity").alias("y"))
    return rounded(compare.power_law(c), "a", "b", "r2")


_RUNS = [("r2", 2, 100.0, 312.0), ("r5", 5, 80.0, 140.0), ("r10", 10, 70.0, 90.0), ("r16", 16, 70.0, 60.0)]
_RUN_ROWS = [(r, w, s, t) for r, w, a, b in _RUNS for s, t in (("one", a), ("two", b))] + [("part", 10, "one", 5.0)]


@query(
    f"""WITH runs(run_id, workers, stage, wall_s) AS (VALUES {', '.join(f"('{r}', {w}, '{s}', {t}e0)" for r, w, s, t in _RUN_ROWS)}), p AS (SELECT run_id, workers, count(DISTINCT stage) AS st, sum(wall_s) AS total FROM runs GROUP BY ALL), w AS (SELECT * FROM p WHERE st = (SELECT max(st) FROM p))
, b AS (SELECT workers AS w0, total AS t0 FROM w ORDER BY workers, run_id LIMIT 1), j AS (SELECT run_id, workers, total, t0 / total AS speedup, workers / w0::DOUBLE AS ratio FROM w, b)
, k AS (SELECT *, CASE WHEN ratio > 1 THEN (1 / speedup - 1 / ratio) / (1 - 1 / ratio) END AS sf FROM j)
 SELECT run_id, workers, total, round(speedup, 6) AS speedup, round(speedup / ratio, 6) AS efficiency, round(CASE WHEN sf BETWEEN 0 AND 1 THEN sf END, 6) AS serial_fraction, round((workers + 1) * 0.1942e0 * total / 3600, 6) AS usd FROM k"""
)
def karp_flatt(spark, sf):
    runs = spark.createDataFrame(_RUN_ROWS, "run_id string, workers int, stage string, wall_s double")
    return rounded(compare.scaling(runs), "speedup", "efficiency", "serial_fraction", "usd")


@query(f"WITH {O.WSEQ}, {O.grams(2, 4)}, {O.SUPPORT}, r AS (SELECT 'windows' AS method, b.band, sup.* FROM sup, (VALUES (2), (3)) b(band) WHERE n >= band) SELECT method, CAST(band AS INTEGER) AS band, count(*) AS routes, max(support) AS top_support, CAST(max(n) AS INTEGER) AS longest FROM r GROUP BY method, band")
def method_summary(spark, sf):
    t = mining.token_support(D.event_sequences(spark, sf, weekly=True), 2, 4)
    rows = t.select("*", F.explode(F.filter(F.array(F.lit(2), F.lit(3)), lambda b: F.col("n") >= b)).alias("band"), F.lit("windows").alias("method"))
    return compare.method_summary(rows)


@query("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, 'exact' AS verdict")
def run_difference(spark, sf):
    """A run against another one of the same input in another layout: no row differs."""
    t = mining.token_support(D.event_sequences(spark, sf), 3, 3)
    return compare.run_difference(t, mining.token_support(D.event_sequences(spark, sf).repartition(5), 3, 3))


_ENDS = [f"string_split(key, '>')[{i}]" for i in (1, -1)]


@query(
    f"""WITH {O.KMWINDOWS} SELECT rank, support, CAST(n AS INTEGER) AS n, CAST(len(string_split(key, '>')) AS INTEGER) AS points, {', '.join(f'round({O.centre(c)[0]}, 6) AS lon{i}, round({O.centre(c)[1]}, 6) AS lat{i}' for i, c in enumerate(_ENDS, 1))}
 FROM (SELECT *, CAST(row_number() OVER (ORDER BY support DESC, round(length_km, 9) DESC, key) AS INTEGER) AS rank FROM ksup WHERE length_km >= 1 AND support >= 2) WHERE rank <= 25"""
)
def geojson_routes(spark, sf):
    """The map's layer of 25 routes as GeoJSON features, read back: properties, number of points, and both ends."""
    seg = encoding.segments(encoding.encode(D.trips(spark, sf)))
    top = mining.banded_top(mining.support(mining.km_windows(seg)).withColumn("length_km", F.round("length_km", 9)), (1.0,), k=25)
    points = top.withColumn("p", F.transform(F.split("key", S.SEP), lambda c: geo.hex_centre(c)))
    shape = "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<rank:int,support:bigint,n:int>>"
    f = T.geojson_lines(points, "p", ["rank", "support", "n"]).select(F.from_json("feature", shape).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    ends = [F.element_at(F.element_at("c", i), k).alias(f"{name}{n}") for n, i in ((1, 1), (2, -1)) for k, name in ((1, "lon"), (2, "lat"))]
    return f.select("rank", "support", "n", F.size("c").alias("points"), *ends)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def sampled_rows(spark, sf):
    """The deterministic sampler: 500 events in the order of a digest of their ids."""
    return T.sample_rows(D.table(spark, sf, "events"), 500, "event_id").select("event_id", "user_id", "event_type")


# Further queries stand in a module of their own, which takes its helpers from here.
from pathloom.plans import routes  # noqa: E402, F401
