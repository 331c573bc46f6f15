"""DuckDB SQL of the derived sequences and trajectories, as common table expressions."""

import math

from pathloom import config as C
from pathloom.functions import geo

#: Event sequences by user and by user and week.
EV = """ev AS (SELECT event_id, user_id AS entity, CAST(user_id * 10 + floor((day(ts) - 1) / 7) AS BIGINT) AS wid, ts, event_type FROM events)"""
SEQ = EV + """, tok AS (SELECT entity AS id, entity, event_type AS tok, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS pos FROM ev)
, seqs AS (SELECT id, entity, list(tok ORDER BY pos) AS seq FROM tok GROUP BY id, entity)"""
WSEQ = EV + """, tok AS (SELECT wid AS id, entity, event_type AS tok, row_number() OVER (PARTITION BY wid ORDER BY ts, event_id) AS pos FROM ev)
, seqs AS (SELECT id, entity, list(tok ORDER BY pos) AS seq FROM tok GROUP BY id, entity)"""
SUPPLIERS = """tok AS (SELECT l_orderkey AS id, o_custkey AS entity, CAST(l_suppkey AS VARCHAR) AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey), seqs AS (SELECT id, entity, list(tok ORDER BY pos) AS seq FROM tok GROUP BY id, entity)"""


def grams(low: int, high: int | None) -> str:
    """Every window of low to high tokens: (id, entity, pos, n, key, prev, next)."""
    most = f"least(len(seq) - s + 1, {high})" if high else "len(seq) - s + 1"
    return f"""starts AS (SELECT id, entity, seq, unnest(generate_series(1, len(seq))) AS s FROM seqs)
, grams AS (SELECT id, entity, s AS pos, n, array_to_string(seq[s : s + n - 1], '>') AS key, CASE WHEN s > 1 THEN seq[s - 1] END AS prev, CASE WHEN s + n <= len(seq) THEN seq[s + n] END AS nxt
 FROM (SELECT *, unnest(generate_series({low}, {most})) AS n FROM starts))"""


SUPPORT = "sup AS (SELECT key, n, count(DISTINCT id) AS support FROM grams GROUP BY key, n)"
EXT = """ext AS (SELECT a.key, a.n, a.support, coalesce(r.m, 0) AS best_right, coalesce(l.m, 0) AS best_left FROM sup a
 LEFT JOIN (SELECT regexp_extract(key, '^(.*)>[^>]*$', 1) AS p, max(support) AS m FROM sup GROUP BY 1) r ON r.p = a.key
 LEFT JOIN (SELECT regexp_extract(key, '^[^>]*>(.*)$', 1) AS p, max(support) AS m FROM sup GROUP BY 1) l ON l.p = a.key)"""


def num(x: float) -> str:
    return f"({x!r})::DOUBLE"


PTS = EV + f""", step AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_type IN ('view', 'purchase') THEN 1 WHEN event_type = 'signup' THEN -1 ELSE 0 END AS dx,
 CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS dy FROM ev)
, pts AS (SELECT wid AS id, entity, ts, row_number() OVER w AS pos,
 CAST(sum(dx) OVER w AS DOUBLE) * {num(0.0025)} + {num(-8.62)} + (CASE WHEN event_id % 97 = 0 THEN {num(0.05)} ELSE 0e0 END + CASE WHEN event_id % 101 = 0 THEN {num(0.3)} ELSE 0e0 END) AS lon,
 CAST(sum(dy) OVER w AS DOUBLE) * {num(0.002)} + {num(41.15)} AS lat FROM step WINDOW w AS (PARTITION BY wid ORDER BY ts, event_id))"""


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"({num(2 * C.EARTH_RADIUS_KM)} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


FEATURES = PTS + f""", lagged AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pts WINDOW w AS (PARTITION BY id ORDER BY pos))
, hop AS (SELECT *, CASE WHEN plon IS NOT NULL THEN {hav('plon', 'plat', 'lon', 'lat')} END AS km FROM lagged)
, agg AS (SELECT id, entity, min(ts) AS start_ts, count(*) AS n, (count(*) - 1) * {C.GPS_INTERVAL_SEC} AS seconds, sum(km) AS total_distance_km, max(km) / {num(C.GPS_INTERVAL_SEC / 3600.0)} AS max_seg_speed_kmh,
 arg_min(lon, pos) AS lon1, arg_min(lat, pos) AS lat1, arg_max(lon, pos) AS lon2, arg_max(lat, pos) AS lat2, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM hop GROUP BY id, entity)
, f0 AS (SELECT id, entity, start_ts, n, seconds, total_distance_km, max_seg_speed_kmh, CASE WHEN n >= 2 THEN {hav('lon1', 'lat1', 'lon2', 'lat2')} END AS straight_line_km,
 CASE WHEN n >= 2 THEN min_lon END AS min_lon, CASE WHEN n >= 2 THEN max_lon END AS max_lon, CASE WHEN n >= 2 THEN min_lat END AS min_lat, CASE WHEN n >= 2 THEN max_lat END AS max_lat FROM agg)
, f1 AS (SELECT *, CASE WHEN seconds > 0 THEN total_distance_km / (seconds / 3600e0) END AS avg_speed_kmh, CASE WHEN straight_line_km > {num(0.05)} THEN total_distance_km / straight_line_km END AS sinuosity FROM f0)
, feats AS (SELECT *, max_seg_speed_kmh > 200 AS is_teleport, seconds > 120 AND total_distance_km < {num(0.1)} AS is_idle, avg_speed_kmh > 120 AS is_too_fast, total_distance_km < {num(0.05)} AS is_too_short,
 NOT (min_lon BETWEEN {num(C.LON_BOX[0] - 0.05)} AND {num(C.LON_BOX[1] + 0.05)} AND min_lat BETWEEN {num(C.LAT_BOX[0] - 0.05)} AND {num(C.LAT_BOX[1] + 0.05)}
 AND max_lon BETWEEN {num(C.LON_BOX[0] - 0.05)} AND {num(C.LON_BOX[1] + 0.05)} AND max_lat BETWEEN {num(C.LAT_BOX[0] - 0.05)} AND {num(C.LAT_BOX[1] + 0.05)}) AS is_offgrid FROM f1)"""


def hex_cell(lon: str, lat: str, edge: float = C.HEX_EDGE_KM) -> str:
    x, y = f"(({lon} - {num(geo.LON0)}) * {num(geo.KM_PER_DEG * geo.COS0)})", f"(({lat} - {num(geo.LAT0)}) * {num(geo.KM_PER_DEG)})"
    q = f"(({x} * {num(math.sqrt(3.0) / 3.0)} - {y} / 3e0) / {num(edge)})"
    r = f"(({y} * {num(2.0 / 3.0)}) / {num(edge)})"
    return f"""(SELECT CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR)
 FROM (SELECT rq, rr, rs, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM (SELECT q, r, floor(q + 0.5e0) AS rq, floor(r + 0.5e0) AS rr, floor(-q - r + 0.5e0) AS rs FROM (SELECT {q} AS q, {r} AS r))))"""


_Q = "CAST(split_part({c}, '_', 1) AS DOUBLE)"
_R = "CAST(split_part({c}, '_', 2) AS DOUBLE)"


def centre(c: str, edge: float = C.HEX_EDGE_KM) -> tuple[str, str]:
    q, r = _Q.format(c=c), _R.format(c=c)
    e = num(edge)
    x = f"(({q} * {num(math.sqrt(3.0))} + {r} * {num(math.sqrt(3.0) / 2.0)}) * {e})"
    y = f"({r} * 1.5e0 * {e})"
    return f"({x} / {num(geo.KM_PER_DEG * geo.COS0)} + {num(geo.LON0)})", f"({y} / {num(geo.KM_PER_DEG)} + {num(geo.LAT0)})"


def cell_hop(a: str, b: str) -> str:
    return hav(*centre(a), *centre(b))


#: Cells in order without consecutive repeats, their hops, and gap-free segments of at least two cells with prefix sums.
CELLS = PTS + f""", rawc AS (SELECT id, entity, ts, pos, {hex_cell('lon', 'lat')} AS cell FROM pts)
, prevc AS (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY pos) AS pc FROM rawc)
, cells AS (SELECT id, entity, cell, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM prevc WHERE pc IS NULL OR pc <> cell)
, hops AS (SELECT *, lag(cell) OVER (PARTITION BY id ORDER BY k) AS pc2 FROM cells)
, hopkm AS (SELECT id, entity, cell, k, CASE WHEN pc2 IS NOT NULL THEN {cell_hop('pc2', 'cell')} END AS km FROM hops)
, segno AS (SELECT *, sum(CASE WHEN km > {num(C.MAX_HOP_KM)} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS g FROM hopkm)
, segsize AS (SELECT *, count(*) OVER (PARTITION BY id, g) AS size, row_number() OVER (PARTITION BY id, g ORDER BY k) AS i FROM segno)
, kept AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY id ORDER BY g) - 1 AS INTEGER) AS seg FROM segsize WHERE size >= 2)
, cumul AS (SELECT id, entity, seg, i, cell, sum(CASE WHEN i = 1 THEN 0e0 ELSE km END) OVER (PARTITION BY id, seg ORDER BY i) AS cum FROM kept)
, segs AS (SELECT id, entity, seg, list(cell ORDER BY i) AS cells, list(cum ORDER BY i) AS cums FROM cumul GROUP BY id, entity, seg)"""
KMWINDOWS = CELLS + f""", ij AS (SELECT *, unnest(generate_series(i + 1, len(cells))) AS j FROM (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM segs))
, win AS (SELECT id, entity, cells[i : j] AS w, cums[j] - cums[i] AS km, j - i + 1 AS n, coalesce(cums[j + 1] - cums[i] > 60, false) AS tr FROM ij WHERE cums[j] - cums[i] BETWEEN 1 AND 60)
, okwin AS (SELECT id, entity, array_to_string(w, '>') AS key, km, n, tr FROM win WHERE len(list_filter(list_distinct(w), lambda c: len(list_filter(w, lambda x: x = c)) > 2)) = 0)
, ksup AS (SELECT key, count(DISTINCT id) AS support, count(DISTINCT entity) AS support_entities, max(km) AS length_km, max(n) AS n, bool_or(tr) AS truncated FROM okwin GROUP BY key)"""
EDGES = """steps AS (SELECT id, tok AS f, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS t FROM tok), edges AS (SELECT f, t, count(DISTINCT id) AS w FROM steps WHERE t IS NOT NULL GROUP BY f, t)"""
CELLTOK = CELLS + """, tok AS (SELECT id, entity, cell AS tok, k AS pos FROM cells)"""


def geohash(lon: str, lat: str, precision: int = 6) -> str:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    ix = f"least(greatest(CAST(floor(({lon} + 180e0) / 360e0 * {1 << nx}) AS BIGINT), 0), {(1 << nx) - 1})"
    iy = f"least(greatest(CAST(floor(({lat} + 90e0) / 180e0 * {1 << ny}) AS BIGINT), 0), {(1 << ny) - 1})"
    chars = []
    for c in range(precision):
        terms = []
        for k in range(5 * c, 5 * c + 5):
            axis, at = ("gx", nx - 1 - k // 2) if k % 2 == 0 else ("gy", ny - 1 - k // 2)
            terms.append(f"(({axis} >> {at}) & 1) * {1 << (4 - k % 5)}")
        chars.append(f"substr('{geo.GEOHASH_ALPHABET}', CAST({' + '.join(terms)} + 1 AS BIGINT), 1)")
    return f"(SELECT {' || '.join(chars)} FROM (SELECT {ix} AS gx, {iy} AS gy))"


def grid_stats(name: str, cell: str) -> str:
    """One row of the grid comparison, over the points table."""
    return f"""SELECT '{name}' AS grid, (SELECT count(DISTINCT id) FROM pts) AS trips, avg(kept) AS avg_cells, avg(raw / kept::DOUBLE) AS avg_ratio, (SELECT count(DISTINCT c) FROM (SELECT {cell} AS c FROM pts)) AS cells
 FROM (SELECT id, count(*) AS raw, count(*) FILTER (p IS NULL OR p <> c) AS kept FROM (SELECT id, c, lag(c) OVER (PARTITION BY id ORDER BY pos) AS p FROM (SELECT id, pos, {cell} AS c FROM pts)) GROUP BY id)"""


def geohash_axes(lon: str, lat: str, precision: int) -> tuple[str, str]:
    """The middle of a point's geohash cell."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = f"least(greatest(floor(({lon} + 180e0) / 360e0 * {1 << nx}), 0), {(1 << nx) - 1})"
    y = f"least(greatest(floor(({lat} + 90e0) / 180e0 * {1 << ny}), 0), {(1 << ny) - 1})"
    return f"(-180e0 + ({x} + 0.5e0) / {1 << nx} * 360e0)", f"(-90e0 + ({y} + 0.5e0) / {1 << ny} * 180e0)"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d = f"radians({lon2} - {lon1})"
    return f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})))"


def grid_turns(name: str, cell: str, lon: str, lat: str) -> str:
    """One row of the mean entropy of directions, over the points table; lon, lat: the middle of a point's cell."""
    return f"""SELECT '{name}' AS grid, count(*) AS cells, avg(ent) AS entropy FROM (SELECT f, abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS ent FROM (SELECT f, CAST(floor((CASE WHEN d < 0 THEN d + 360 ELSE d END) / 45) AS BIGINT) AS s, CAST(count(*) AS DOUBLE) AS c
 FROM (SELECT p AS f, {bearing('plo', 'pla', 'lo', 'la')} AS d FROM (SELECT *, lag(c) OVER w AS p, lag(lo) OVER w AS plo, lag(la) OVER w AS pla FROM (SELECT id, pos, {cell} AS c, {lon} AS lo, {lat} AS la FROM pts) WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE p IS NOT NULL AND p <> c) GROUP BY 1, 2) GROUP BY f)"""


#: The tokens of a document: lower-cased, cut at ASCII white space.
WORDS = """docw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
, shs AS (SELECT id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '>' || w[i + 1])) AS sh FROM docw WHERE len(w) >= 2)"""

#: Whole histories in longer steps without jumps; each stands for two trips.
LONG_PTS = f"""ev AS (SELECT event_id, user_id AS entity, user_id AS wid, ts, event_type FROM events), step AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_type IN ('view', 'purchase') THEN 1 WHEN event_type = 'signup' THEN -1 ELSE 0 END AS dx,
 CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS dy FROM ev)
, pts AS (SELECT wid AS id, entity, ts, row_number() OVER w AS pos, CAST(sum(dx) OVER w AS DOUBLE) * {num(0.0025 * 2.5)} + {num(-8.62)} AS lon, CAST(sum(dy) OVER w AS DOUBLE) * {num(0.002 * 2.5)} + {num(41.15)} AS lat FROM step WINDOW w AS (PARTITION BY wid ORDER BY ts, event_id))"""
LONG_WINDOWS = KMWINDOWS.replace(PTS, LONG_PTS).replace("count(DISTINCT id) AS support", "2 * count(DISTINCT id) AS support")
