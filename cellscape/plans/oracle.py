"""DuckDB equivalents of the fixtures, and helpers to write a query's SQL."""

from __future__ import annotations

from cellscape import fixtures as fx
from cellscape.functions import scores as S

KINDS = "['trunk', 'primary', 'secondary', 'residential', 'track', 'footway', 'construction']"
SPEED = "CASE highway WHEN 'trunk' THEN 35.0 WHEN 'primary' THEN 30.0 WHEN 'secondary' THEN 25.0 WHEN 'residential' THEN 15.0 WHEN 'track' THEN 10.0 WHEN 'footway' THEN 3.5 ELSE 15.0 END::DOUBLE"
VEHICULAR = "'trunk', 'primary', 'secondary', 'residential', 'track'"
ARTERIAL = "'trunk', 'primary'"
CLASS = "CASE WHEN {0} >= 0 AND {0} < 0.35 THEN 1 WHEN {0} < 0.65 THEN 2 WHEN {0} <= 1 THEN 3 END"
BAND = "CASE WHEN {0} THEN 'Inside Candidate Hazard-Based Red Zone' WHEN {1} <= 500 THEN 'Within 500 m' WHEN {1} <= 1000 THEN '500 m to 1 km' WHEN {1} <= 2000 THEN '1 km to 2 km' WHEN {1} <= 5000 THEN '2 km to 5 km' WHEN {1} <= 10000 THEN '5 km to 10 km' ELSE 'Beyond 10 km' END"
FLAGS = {"vf_high_child_pop": "coalesce(child_proportion, 0) > 0.151", "vf_high_sc": "coalesce(sc_proportion, 0) > 0.246", "vf_high_dependency": "coalesce(non_worker_rate, 0) > 0.579", "vf_high_illiteracy": "coalesce(illiteracy_rate, 0) > 0.34"}
FLAG_COUNT = " + ".join(f"CAST({c} AS INT)" for c in FLAGS.values())
TIER = "CASE WHEN overlap THEN 'Tier1_AttentionPriority' WHEN distance_m IS NULL THEN 'Unknown' WHEN distance_m <= 500 AND coalesce(hazard_class >= 2, false) THEN 'Tier1_AttentionPriority' WHEN distance_m <= 2000 THEN 'Tier2_ElevatedAttention' WHEN distance_m <= 5000 THEN 'Tier3_Monitoring' ELSE 'BeyondProximity' END"


def rect(x: str, y: str, row: str, col: str) -> str:
    """Squared distance of a point from a cell."""
    dx, dy = f"greatest(abs({x} - ({col} + 0.5::DOUBLE) * 30) - 15, 0)", f"greatest(abs({y} + ({row} + 0.5::DOUBLE) * 30) - 15, 0)"
    return f"({dx} * {dx} + {dy} * {dy})"


def paths(net: str, starts: str, weights: tuple[str, ...] = ("length_m", "minutes")) -> str:
    """A recursive table paths(set, weight, node, dist) from starts (set, node) over both directions of a net."""
    both = " UNION ALL ".join(f"SELECT '{w}' AS weight, {a} AS a, {b} AS b, {w} AS w FROM {net}" for w in weights for a, b in (("u", "v"), ("v", "u")))
    begin = " UNION ALL ".join(f"SELECT set, '{w}' AS weight, node, 0.0::DOUBLE AS dist FROM ({starts})" for w in weights)
    return f"steps AS ({both}), paths(set, weight, node, dist) USING KEY (set, weight, node) AS ({begin} UNION SELECT set, weight, b, min(d) FROM (SELECT p.set, p.weight, s.b, p.dist + s.w AS d FROM paths p JOIN steps s ON s.a = p.node AND s.weight = p.weight LEFT JOIN recurring.paths k ON k.set = p.set AND k.weight = p.weight AND k.node = s.b WHERE k.dist IS NULL OR p.dist + s.w < k.dist) GROUP BY set, weight, b)"


def warped(source: str, value: str, weigh: bool = True) -> str:
    """Cells of a grid of degrees (fixtures.GEO) on the grid of metres (fixtures.GROUND) of the same size, by the inverse series."""
    k, (lon, lat, dx, dy), (x0, y0, cx, cy) = S._K0 * S._RADIUS, fx.GEO, fx.GROUND
    wave = lambda f, g, terms: " + ".join(f"{c!r}::DOUBLE * {f}({2 * (i + 1)} * xi) * {g}({2 * (i + 1)} * eta)" for i, c in enumerate(terms))
    back = " + ".join(f"{c!r}::DOUBLE * sin({2 * (i + 1)} * chi)" for i, c in enumerate(S._DELTA))
    grid = f"SELECT r AS row, c AS col, ({y0!r}::DOUBLE - (r + 0.5::DOUBLE) * {cy!r}::DOUBLE) / {k!r}::DOUBLE AS xi, ({x0!r}::DOUBLE + (c + 0.5::DOUBLE) * {cx!r}::DOUBLE - {S._FE!r}::DOUBLE) / {k!r}::DOUBLE AS eta FROM (SELECT unnest(range(0, (SELECT max(row) + 1 FROM {source}))) AS r), (SELECT unnest(range(0, {fx.GRID_COLS})) AS c)"
    turned = f"SELECT row, col, xi - ({wave('sin', 'cosh', S._BETA)}) AS xp, eta - ({wave('cos', 'sinh', S._BETA)}) AS ep FROM ({grid})"
    sphere = f"SELECT row, col, xp, ep, asin(sin(xp) / cosh(ep)) AS chi FROM ({turned})"
    place = f"SELECT row, col, ({lat!r}::DOUBLE - degrees(chi + {back})) / {dy!r}::DOUBLE - 0.5 AS y, ({S._LON0!r}::DOUBLE + degrees(atan2(sinh(ep), cos(xp))) - {lon!r}::DOUBLE) / {dx!r}::DOUBLE - 0.5 AS x FROM ({sphere})"
    if not weigh:
        return f"SELECT t.row, t.col, g.{value} FROM ({place}) t LEFT JOIN {source} g ON g.row = floor(t.y + 0.5) AND g.col = floor(t.x + 0.5)"
    around = f"SELECT t.row, t.col, (1 - abs(t.y - (floor(t.y) + k.i))) * (1 - abs(t.x - (floor(t.x) + k.j))) AS w, g.{value} AS v FROM ({place}) t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) LEFT JOIN {source} g ON g.row = floor(t.y) + k.i AND g.col = floor(t.x) + k.j"
    return f"SELECT row, col, sum(w * v) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0) AS {value} FROM ({around}) GROUP BY row, col"


FIXTURES: dict[str, str] = {
    "g_dem": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / 10000 END AS elev FROM orders",
    "g_valley": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, o_totalprice / 100000 + 0.5::DOUBLE * abs(o_orderkey % 100 - 50) + 0.2::DOUBLE * (o_orderkey // 100) AS elev FROM orders",
    "g_geo": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / 100000 + 0.5::DOUBLE * abs(o_orderkey % 100 - 50) + 0.2::DOUBLE * (o_orderkey // 100) END AS elev FROM orders",
    "ground": warped("g_geo", "elev"),
    "g_lulc": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CAST([10, 20, 30, 40, 50, 70, 80][o_orderkey % 7 + 1] AS INT) AS code, o_orderkey % 5 = 0 AS protected, o_orderkey % 97 <> 0 AS valid FROM orders",
    "scores": "SELECT CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 7919 % 1001) / 1000.0::DOUBLE END AS terrain, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE (o_orderkey * 104729 % 1001) / 1000.0::DOUBLE END AS flood FROM orders",
    "census0": "SELECT c_custkey AS village_id, c_name AS name, c_nationkey AS subdist, CASE c_custkey % 10 WHEN 0 THEN 'TOWN' ELSE 'VILLAGE' END AS level, CAST(CASE c_custkey % 41 WHEN 0 THEN 0 ELSE 100 + floor(abs(c_acctbal)) END AS BIGINT) AS tot_p FROM customer",
    "census": "SELECT *, tot_p // 5 AS no_hh, tot_p * (village_id % 30) // 100 AS p_06, tot_p * (village_id % 53) // 100 AS p_ill, tot_p * (village_id % 71) // 100 AS non_work_p, tot_p * (village_id % 37) // 100 AS p_sc, tot_p * (village_id % 3) // 100 AS p_st FROM census0",
    "centroid": "SELECT c_custkey AS village_id, ((c_custkey * 7919 % 3000) + 0.25::DOUBLE) * CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 1 END AS x, -((c_custkey * 104729 % 4500) + 0.25::DOUBLE) * CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 1 END AS y, c_nationkey AS subdist, c_name AS name FROM customer WHERE c_custkey % 17 <> 0",
    "facility": "SELECT s_suppkey AS facility_id, s_name AS name, (s_suppkey * 3571 % 3000) + 0.25::DOUBLE AS x, -((s_suppkey * 2741 % 4500) + 0.25::DOUBLE) AS y, ['HEALTH', 'HOSPITAL', 'SCHOOL', 'EMERGENCY', 'OTHER'][s_nationkey % 5 + 1] AS category FROM supplier",
    "incident": "SELECT event_id, upper(event_type) AS hazard_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date, year(ts) AS year, (user_id * 613 % 30000) + (event_id % 7) * 40 + 0.25::DOUBLE AS x, -((user_id * 419 % 45000) + 0.25::DOUBLE) AS y, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS fatalities, 'src' || (event_id % 3) AS provider, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 25 * (event_id % 12) END AS uncertainty_m FROM events",
    "tags": "SELECT p_partkey AS id, p_name || ['', ' CHC', ' Primary Health Centre', ' Sub-Centre', ' Vidyalaya', ' ITI', ' Thana', ' Panchayat Bhavan', ' Dak Ghar', ' Court', ' Dispensary', ' Anganwadi'][p_partkey % 12 + 1] AS name, CASE WHEN p_partkey % 4 = 0 THEN ['hospital', 'clinic', 'doctors', 'school', 'college', 'police', 'fire_station', 'community_centre', 'townhall'][p_size % 9 + 1] END AS amenity, CASE WHEN p_partkey % 19 = 0 THEN 'centre' END AS healthcare, lower(p_type) AS building, CASE WHEN p_partkey % 17 = 0 THEN 'government' END AS office, CASE WHEN p_partkey % 5 = 0 THEN 'yes' END AS emergency, (p_partkey * 3571 % 3000) + 0.25::DOUBLE AS x, -((p_partkey * 2741 % 4500) + 0.25::DOUBLE) AS y FROM part",
    "road": f"SELECT p_partkey AS u, p_partkey + 1 AS v, p_retailprice / 10 AS length_m, {KINDS}[p_partkey % 7 + 1] AS highway, p_partkey AS seq FROM part WHERE p_partkey % 211 <> 210",
    "road_x": f"SELECT l_partkey AS u, (l_partkey * 7) % (SELECT count(*) FROM part) AS v, l_extendedprice / 100 AS length_m, {KINDS}[l_linenumber % 7 + 1] AS highway, 100000000 + l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_orderkey % 50 = 0",
    "ways0": f"SELECT p_partkey * 2 AS seq, {KINDS}[(p_partkey // 3) % 7 + 1] AS highway, p_partkey AS p, 'e' AS way, p_name FROM part WHERE p_partkey % 50 < 49 UNION ALL SELECT p_partkey * 2 + 1, {KINDS}[(p_partkey // 5) % 7 + 1], p_partkey, 's', p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 100000000 + p_partkey, {KINDS}[(p_partkey + 1) % 7 + 1], p_partkey, 'e', p_name FROM part WHERE p_partkey % 50 < 49 AND p_partkey % 11 = 0",
    "ways": "SELECT seq, highway, CASE WHEN p % 3 = 0 THEN p_name END AS name, CASE WHEN p % 9 = 0 THEN 'NH-1' END AS ref, CASE WHEN p % 4 = 0 THEN 'paved' END AS surface, way, 60.0::DOUBLE * (p % 50) + 0.5::DOUBLE AS x0, -(60.0::DOUBLE * (p // 50) + 0.5::DOUBLE) AS y0, 60.0::DOUBLE * (p % 50) + 30.5::DOUBLE AS xm, -(60.0::DOUBLE * (p // 50) + 0.5::DOUBLE) - 2.0::DOUBLE * (p % 7) AS ym, CASE WHEN way = 'e' THEN 60.0::DOUBLE * (p % 50 + 1) + 0.5::DOUBLE ELSE 60.0::DOUBLE * (p % 50) + 0.5::DOUBLE END AS x1, CASE WHEN way = 'e' THEN -(60.0::DOUBLE * (p // 50) + 0.5::DOUBLE) ELSE -(60.0::DOUBLE * (p // 50 + 1) + 0.5::DOUBLE) END AS y1 FROM ways0",
    "segs0": "SELECT *, 0 AS pos, x0 AS x, y0 AS y, xm AS x2, ym AS y2 FROM ways WHERE way = 'e' UNION ALL SELECT *, 1, xm, ym, x1, y1 FROM ways WHERE way = 'e' UNION ALL SELECT *, 0, x0, y0, x1, y1 FROM ways WHERE way = 's'",
    "segs": f"SELECT *, {SPEED} AS speed_kmh, highway IN ({VEHICULAR}) AS is_vehicular, highway IN ({ARTERIAL}) AS is_arterial, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) AS len FROM segs0 WHERE highway <> 'construction'",
    "net": "SELECT least(a, b) AS u, greatest(a, b) AS v, round_even(arg_max(len, o), 2) AS length_m, round_even(arg_max(len / 1000 / speed_kmh * 60, o), 4) AS minutes, arg_max(is_arterial, o) AS is_arterial FROM (SELECT *, CAST(round(x * 10) AS BIGINT) * 2147483648 + CAST(round(y * 10) AS BIGINT) + 1073741824 AS a, CAST(round(x2 * 10) AS BIGINT) * 2147483648 + CAST(round(y2 * 10) AS BIGINT) + 1073741824 AS b, {'s': seq, 'p': pos} AS o FROM segs) WHERE a <> b GROUP BY 1, 2",
    "vnet": "SELECT least(a, b) AS u, greatest(a, b) AS v, round_even(arg_max(len, o), 2) AS length_m, round_even(arg_max(len / 1000 / speed_kmh * 60, o), 4) AS minutes, arg_max(is_arterial, o) AS is_arterial FROM (SELECT *, CAST(round(x * 10) AS BIGINT) * 2147483648 + CAST(round(y * 10) AS BIGINT) + 1073741824 AS a, CAST(round(x2 * 10) AS BIGINT) * 2147483648 + CAST(round(y2 * 10) AS BIGINT) + 1073741824 AS b, {'s': seq, 'p': pos} AS o FROM segs WHERE is_vehicular) WHERE a <> b GROUP BY 1, 2",
    "net_node": "SELECT node, floor(node / 2147483648.0)::BIGINT / 10.0::DOUBLE AS x, (node % 2147483648 - 1073741824) / 10.0::DOUBLE AS y FROM (SELECT u AS node FROM net UNION SELECT v FROM net)",
    "vnet_node": "SELECT node, floor(node / 2147483648.0)::BIGINT / 10.0::DOUBLE AS x, (node % 2147483648 - 1073741824) / 10.0::DOUBLE AS y FROM (SELECT u AS node FROM vnet UNION SELECT v FROM vnet)",
    "area": "SELECT l_orderkey * 10 + l_linenumber AS area_id, l_extendedprice * 12 AS area_m2, l_quantity AS mean_slope, l_discount * 10 AS mean_score, l_extendedprice / 10 AS hazard_distance_m, l_returnflag AS flag FROM lineitem",
    # derived
    "grad": "SELECT *, CASE WHEN lag(col) OVER a IS NULL THEN (lead(elev) OVER a - elev) / 30.0::DOUBLE WHEN lead(col) OVER a IS NULL THEN (elev - lag(elev) OVER a) / 30.0::DOUBLE ELSE (lead(elev) OVER a - lag(elev) OVER a) / 60.0::DOUBLE END AS gx, CASE WHEN lag(row) OVER d IS NULL THEN (lead(elev) OVER d - elev) / 30.0::DOUBLE WHEN lead(row) OVER d IS NULL THEN (elev - lag(elev) OVER d) / 30.0::DOUBLE ELSE (lead(elev) OVER d - lag(elev) OVER d) / 60.0::DOUBLE END AS gy FROM g_dem WINDOW a AS (PARTITION BY row ORDER BY col), d AS (PARTITION BY col ORDER BY row)",
    "slope": "SELECT row, col, elev, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM grad",
    "overlay": "SELECT *, 0.6::DOUBLE * terrain AS ct, 0.4::DOUBLE * flood AS cf, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * terrain + 0.4::DOUBLE * flood)) AS score FROM scores WHERE terrain IS NOT NULL AND flood IS NOT NULL UNION ALL SELECT *, CASE WHEN terrain IS NOT NULL THEN NULL END, NULL, NULL FROM scores WHERE terrain IS NULL OR flood IS NULL",
    "neighbours": "SELECT * FROM (VALUES (0, 1, 1, 0), (1, 1, 2, 1), (1, 0, 4, 2), (1, -1, 8, 3), (0, -1, 16, 4), (-1, -1, 32, 5), (-1, 0, 64, 6), (-1, 1, 128, 7)) t(dr, dc, code, ord)",
    "flow": "SELECT c.row, c.col, c.elev, CASE WHEN c.elev IS NULL THEN NULL ELSE coalesce(arg_min(n.code, {'d': -(c.elev - b.elev) / (30.0::DOUBLE * CASE WHEN n.dr <> 0 AND n.dc <> 0 THEN 2.0::DOUBLE ** 0.5::DOUBLE ELSE 1.0::DOUBLE END), 'o': n.ord}) FILTER (WHERE c.elev > b.elev), 0) END AS flow_dir FROM g_valley c CROSS JOIN neighbours n LEFT JOIN g_valley b ON b.row = c.row + n.dr AND b.col = c.col + n.dc GROUP BY c.row, c.col, c.elev",
    "ptr": "SELECT f.row * 100 + f.col AS id, CASE WHEN f.flow_dir > 0 THEN (f.row + n.dr) * 100 + f.col + n.dc END AS nxt FROM flow f LEFT JOIN neighbours n ON n.code = f.flow_dir",
    "mask": "SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, score, ct, cf FROM overlay WHERE score >= 0.65",
    "cellid": "SELECT row, col, score, ct, cf, row * 2147483648 + col AS id FROM mask",
    "zone_cells": "SELECT c.row, c.col, c.score, c.ct, c.cf, r.zone FROM cellid c JOIN (SELECT id, min(root) AS zone FROM reach GROUP BY id) r USING (id)",
    "zone_stats": "SELECT zone, count(*) AS pixel_count, count(*) * 900.0::DOUBLE AS area_m2, round_even(avg(score), 6) AS mean_score, round_even(max(score), 6) AS max_score, round_even(min(score), 6) AS min_score, round_even(avg(ct), 6) AS mean_terrain, round_even(avg(cf), 6) AS mean_flood FROM zone_cells GROUP BY zone",
    "kept_zone": "SELECT *, row_number() OVER (ORDER BY mean_score DESC, max_score DESC, area_m2 DESC, zone) AS rank FROM zone_stats WHERE area_m2 >= 5000",
    "kept_cells": "SELECT c.*, k.rank AS zone_rank FROM zone_cells c JOIN kept_zone k USING (zone)",
    "village": "SELECT c.*, t.x, t.y FROM census c JOIN centroid t USING (village_id) WHERE c.level = 'VILLAGE'",
    "sampled": "SELECT v.*, s.terrain, s.flood, s.score, CASE WHEN s.score < 0.35 THEN 1 WHEN s.score < 0.65 THEN 2 WHEN s.score <= 1 THEN 3 END AS hazard_class FROM village v LEFT JOIN overlay s ON s.row = CAST(floor(-v.y / 30) AS BIGINT) AND s.col = CAST(floor(v.x / 30) AS BIGINT)",
    "facility_near": "SELECT v.village_id, arg_min(f.facility_id, {'d': sqrt((v.x - f.x) ** 2 + (v.y - f.y) ** 2), 'i': f.facility_id}) AS facility_id, round_even(min(sqrt((v.x - f.x) ** 2 + (v.y - f.y) ** 2)), 1) AS distance_m FROM village v CROSS JOIN facility f GROUP BY v.village_id",
    "zone_near": f"SELECT village_id, arg_min(zone, {{'d': d, 'r': zone_rank}}) AS nearest_zone, round_even(sqrt(min(d)), 1) AS distance_m FROM (SELECT v.village_id, k.zone, k.zone_rank, {rect('v.x', 'v.y', 'k.row', 'k.col')} AS d FROM village v CROSS JOIN kept_cells k) GROUP BY village_id",
    "exposure": f"SELECT v.*, k.zone AS matched_zone, n.nearest_zone, n.distance_m, k.zone IS NOT NULL AS overlap, {BAND.format('k.zone IS NOT NULL', 'n.distance_m')} AS band FROM village v LEFT JOIN kept_cells k ON k.row = CAST(floor(-v.y / 30) AS BIGINT) AND k.col = CAST(floor(v.x / 30) AS BIGINT) LEFT JOIN zone_near n USING (village_id)",
    "rates": "SELECT village_id, subdist, tot_p, no_hh, " + ", ".join(f"CASE WHEN tot_p > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {c} / tot_p::DOUBLE)) END AS {n}" for n, c in (("illiteracy_rate", "p_ill"), ("child_proportion", "p_06"), ("non_worker_rate", "non_work_p"), ("sc_proportion", "p_sc"), ("st_proportion", "p_st"))) + " FROM census",
    "profile": f"SELECT *, {TIER} AS priority_tier FROM (SELECT e.*, s.terrain, s.flood, s.score, s.hazard_class, r.illiteracy_rate, r.child_proportion, r.non_worker_rate, r.sc_proportion, r.st_proportion, {FLAG_COUNT} AS vulnerability_flag_count FROM exposure e JOIN sampled s USING (village_id) JOIN rates r USING (village_id))",
    "stack": f"SELECT o.row, o.col, sl.slope, o.terrain, o.flood, o.score, {CLASS.format('o.score')} AS hazard_class, {CLASS.format('o.flood')} AS flood_class, g.code, CASE WHEN g.valid THEN CAST(g.code IN (10, 50, 70, 80, 90) OR g.protected AS INT) END AS eco, k.zone FROM overlay o JOIN slope sl USING (row, col) JOIN g_lulc g USING (row, col) LEFT JOIN kept_cells k ON k.row = o.row AND k.col = o.col",
    "screen": "SELECT *, CASE WHEN slope IS NOT NULL AND score IS NOT NULL THEN CAST(coalesce(hazard_class = 3, false) OR coalesce(flood_class = 3, false) OR zone IS NOT NULL OR slope > 20 OR coalesce(eco = 1, false) AS INT) END AS excluded FROM stack",
    "openid": "SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, slope, terrain, flood, score, code, CAST(row AS BIGINT) * 2147483648 + col AS id FROM screen WHERE excluded = 0",
    "area_cells": "SELECT c.*, r.zone FROM openid c JOIN (SELECT id, min(root) AS zone FROM area_reach GROUP BY id) r USING (id)",
    "area_stats": "SELECT zone, count(*) AS pixel_count, count(*) * 900.0::DOUBLE AS area_m2, avg((col + 0.5::DOUBLE) * 30) AS x, -avg((row + 0.5::DOUBLE) * 30) AS y, " + ", ".join(f"round_even({f}({c}), 4) AS {n}_{c}" for c in ("slope", "terrain", "flood", "score") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + " FROM area_cells GROUP BY zone",
    "area_code": "SELECT zone, CAST(arg_max(code, {'n': n, 'c': -code}) AS INT) AS dominant_code FROM (SELECT zone, code, count(*) AS n FROM area_cells GROUP BY ALL) GROUP BY zone",
    "cand": "SELECT *, printf('CA-%04d', rank) AS area_id FROM (SELECT *, row_number() OVER (ORDER BY area_m2 DESC, zone) AS rank FROM area_stats WHERE area_m2 >= 2700) JOIN area_code USING (zone)",
    "cand_near": f"SELECT area_id, arg_min(zone, {{'d': d, 'r': zone_rank}}) AS nearest_zone, round_even(sqrt(min(d)), 1) AS hazard_distance_m FROM (SELECT a.area_id, k.zone, k.zone_rank, {rect('a.x', 'a.y', 'k.row', 'k.col')} AS d FROM cand a CROSS JOIN kept_cells k) GROUP BY area_id",
    "cand_home": "SELECT a.area_id, arg_min(v.village_id, {'d': (a.x - v.x) * (a.x - v.x) + (a.y - v.y) * (a.y - v.y), 'i': v.village_id}) AS nearest_village, arg_min(v.tot_p, {'d': (a.x - v.x) * (a.x - v.x) + (a.y - v.y) * (a.y - v.y), 'i': v.village_id}) AS nearest_village_pop, round_even(sqrt(min((a.x - v.x) * (a.x - v.x) + (a.y - v.y) * (a.y - v.y))), 1) AS nearest_village_m FROM cand a CROSS JOIN village v GROUP BY a.area_id",
    "attributes": f"SELECT *, {SPEED} AS speed_kmh, highway IN ({VEHICULAR}) AS is_vehicular, highway IN ({ARTERIAL}) AS is_arterial FROM road WHERE highway <> 'construction' AND length_m > 0",
    "mixed": f"SELECT least(u, v) AS u, greatest(u, v) AS v, arg_max(length_m, {{'s': seq, 'l': length_m}}) AS length_m, round_even(arg_max(length_m / 1000 / {SPEED} * 60, {{'s': seq, 'l': length_m}}), 4) AS minutes FROM (SELECT * FROM road UNION ALL SELECT * FROM road_x) WHERE u <> v AND highway <> 'construction' AND length_m > 0 GROUP BY 1, 2",
    "kinds": "SELECT *, " + "{kinds}" + " AS k FROM (SELECT *, coalesce(amenity, '') AS am, coalesce(healthcare, '') AS hc, coalesce(building, '') AS bld, coalesce(office, '') AS off, lower(coalesce(name, '')) AS nm FROM tags)",
    "place": "SELECT *, k.kind AS facility_broad_type, k.category AS facility_category, printf('FAC-%03d', row_number() OVER (ORDER BY k.kind, k.category, name, id)) AS facility_id FROM kinds",
}


def case_of_rules() -> str:
    """The facility rules as one CASE, from their table of values."""
    from cellscape.operators.facilities import OTHER, RULES

    column = {"amenity": "am", "healthcare": "hc", "building": "bld", "office": "off"}
    out = []
    for tests, parts, kind, category, evidenced, receiver, by_tag, by_name in RULES:
        tagged = " OR ".join(f"contains({column[t]}, '{v}')" if how == "has" else f"{column[t]} = '{v}'" for t, how, vs in tests for v in vs) or "false"
        named = " OR ".join(f"contains(nm, '{p}')" for p in parts)
        says = "coalesce(emergency, '') IN ('yes', 'designated')" if evidenced is None else str(evidenced).lower()
        out.append(f"WHEN ({tagged}) OR ({named}) THEN {{'kind': '{kind}', 'category': '{category}', 'evidenced': {says}, 'receiver': {str(receiver).lower()}, 'trigger': CASE WHEN {tagged} THEN '{by_tag}' ELSE '{by_name}' END}}")
    return f"CASE {' '.join(out)} ELSE {{'kind': '{OTHER[0]}', 'category': '{OTHER[1]}', 'evidenced': false, 'receiver': false, 'trigger': '{OTHER[2]}'}} END"


FIXTURES["kinds"] = FIXTURES["kinds"].replace("{kinds}", case_of_rules())


def reach(name: str, cells: str) -> str:
    """A recursive table (id, root) of cells: the smallest id that each reaches over eight neighbours (of name_adj)."""
    near = ", ".join(f"({r}, {c})" for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)
    adj = f"{name}_adj AS MATERIALIZED (SELECT c.id AS a, n.id AS b FROM {cells} c CROSS JOIN (VALUES {near}) o(dr, dc) JOIN {cells} n ON n.row = c.row + o.dr AND n.col = c.col + o.dc)"
    return f"{adj}, {name}(id, root) USING KEY (id) AS (SELECT id, id AS root FROM {cells} UNION SELECT b, min(root) FROM (SELECT e.b, r.root FROM {name} r JOIN {name}_adj e ON e.a = r.id JOIN recurring.{name} k ON k.id = e.b WHERE r.root < k.root) GROUP BY b)"


RECURSIVE = {"reach": reach("reach", "cellid"), "area_reach": reach("area_reach", "openid")}
_NEEDS = {
    "ground": ["g_geo"],
    "census": ["census0"], "grad": ["g_dem"], "slope": ["grad"], "overlay": ["scores"], "flow": ["g_valley", "neighbours"], "ptr": ["flow", "neighbours"], "mask": ["overlay"], "cellid": ["mask"], "reach": ["cellid"], "zone_cells": ["cellid", "reach"],
    "zone_stats": ["zone_cells"], "kept_zone": ["zone_stats"], "kept_cells": ["zone_cells", "kept_zone"], "village": ["census", "centroid"], "sampled": ["village", "overlay"], "facility_near": ["village", "facility"], "zone_near": ["village", "kept_cells"],
    "exposure": ["village", "kept_cells", "zone_near"], "rates": ["census"], "profile": ["exposure", "sampled", "rates"], "stack": ["overlay", "slope", "g_lulc", "kept_cells"], "screen": ["stack"], "openid": ["screen"], "area_reach": ["openid"],
    "area_cells": ["openid", "area_reach"], "area_stats": ["area_cells"], "area_code": ["area_cells"], "cand": ["area_stats", "area_code"], "cand_near": ["cand", "kept_cells"], "cand_home": ["cand", "village"], "attributes": ["road"], "mixed": ["road", "road_x"],
    "kinds": ["tags"], "place": ["kinds"], "ways": ["ways0"], "segs0": ["ways"], "segs": ["segs0"], "net": ["segs"], "vnet": ["segs"], "net_node": ["net"], "vnet_node": ["vnet"],
}


def sql(body: str, *names: str, last: str = "") -> str:
    """body with the named fixtures, and those they need, as common table expressions; last are further ones, which may recur."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [RECURSIVE[n] if n in RECURSIVE else f"{n} AS ({FIXTURES[n]})" for n in order] + ([last] if last else [])
    recurs = last or any(n in RECURSIVE for n in order)
    return f"WITH {'RECURSIVE ' if recurs else ''}{', '.join(parts)} {body}" if parts else body


def on_ground(body: str, *names: str, last: str = "") -> str:
    """sql, with the warped terrain in place of both elevation fixtures."""
    text = sql(body, "ground", *names, last=last)
    for fixture in ("g_dem", "g_valley"):
        text = text.replace(f"FROM {fixture}", "FROM ground").replace(f"JOIN {fixture}", "JOIN ground")
    return text
