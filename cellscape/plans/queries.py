"""Registered queries, by survey id, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape import fixtures as fx
from cellscape.components import checkpoint_folder, staged
from cellscape.functions import scores as S
from cellscape.operators import facilities as fac
from cellscape.operators import georef, grid, polygons, quality, roads, spatial, summaries, tiles, views
from cellscape.operators import tables as T
from cellscape.plans import pipelines as P
from cellscape.plans.oracle import BAND, CLASS, FIXTURES, FLAG_COUNT, FLAGS, RECURSIVE, TIER, on_ground, paths, sql, warped
from cellscape.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_overlay, _zone_cells, _villages = P.overlay, P.zone_cells, P.villages


# Terrain and hydrology


@query("G1_slope", sql("SELECT row, col, round(slope, 6) AS slope FROM slope", "slope"))
def _(spark, d):
    return grid.slope(fx.g_dem(spark, d)).select("row", "col", F.round("slope", 6).alias("slope"))


@query("G2_aspect", sql("SELECT row, col, CASE WHEN elev IS NULL OR gx IS NULL OR gy IS NULL THEN NULL WHEN sqrt(gx * gx + gy * gy) < 1e-8 THEN -1.0 ELSE round((90 - degrees(atan2(-gy, gx)) + 360) % 360, 6) END AS aspect FROM grad", "grad"))
def _(spark, d):
    return grid.aspect(fx.g_dem(spark, d)).select("row", "col", F.round("aspect", 6).alias("aspect"))


@query("G3_flow_direction", sql("SELECT row, col, flow_dir FROM flow", "flow"))
def _(spark, d):
    return grid.flow_direction(fx.g_valley(spark, d)).select("row", "col", "flow_dir")


@query("G4_flow_accumulation", sql("SELECT w.at AS id, count(*) AS acc FROM walk w GROUP BY w.at", "ptr").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT w.at", ", walk AS (SELECT id AS src, id AS at FROM ptr UNION ALL SELECT w.src, p.nxt FROM walk w JOIN ptr p ON p.id = w.at WHERE p.nxt IS NOT NULL) SELECT w.at"))
def _(spark, d):
    acc = tiles.flow_accumulation(grid.flow_direction(fx.g_valley(spark, d)))
    return acc.select((F.col("row") * 100 + F.col("col")).alias("id"), "acc")


@query("G4_accumulation_by_pointers", ORACLE_SQL["G4_flow_accumulation"])
def _(spark, d):
    flow = grid.flow_direction(fx.g_valley(spark, d))
    ids = flow.select((F.col("row") * 100 + F.col("col")).cast("long").alias("id"), (F.col("to_row") * 100 + F.col("to_col")).cast("long").alias("to"))
    return grid.flow_accumulation(ids)


_WALK = "walk AS (SELECT id AS src, id AS at FROM ptr UNION ALL SELECT w.src, p.nxt FROM walk w JOIN ptr p ON p.id = w.at WHERE p.nxt IS NOT NULL), acc AS (SELECT w.at AS id, count(*) AS acc FROM walk w GROUP BY w.at), wet AS (SELECT s.row, s.col, s.slope, a.acc, CASE WHEN s.slope IS NOT NULL THEN ln(a.acc * 30.0::DOUBLE / greatest(tan(radians(greatest(s.slope, 0.1::DOUBLE))), 1e-4)) END AS twi FROM slope s JOIN acc a ON a.id = s.row * 100 + s.col)"
_C1 = _WALK + ", scored AS (SELECT *, CASE WHEN slope IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, slope / 60.0::DOUBLE)) END AS terrain, CASE WHEN twi IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (twi - 3.5) / 10.0::DOUBLE)) END AS flood FROM wet), hazard AS (SELECT *, CASE WHEN terrain IS NOT NULL AND flood IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * terrain + 0.4::DOUBLE * flood)) END AS score FROM scored)"


@query("G5_wetness", on_ground("SELECT row, col, acc, round(twi, 6) AS twi FROM wet", "slope", "ptr", last=_WALK))
def _(spark, d):
    return P.hazard_classes(spark, d).select("row", "col", "acc", F.round("twi", 6).alias("twi"))


@query("C1_hazard_classes", on_ground(f"SELECT {CLASS.format('round(score, 9)')} AS hazard_class, count(*) AS cells, round(avg(score), 6) AS mean_score FROM hazard GROUP BY 1", "slope", "ptr", last=_C1))
def _(spark, d):
    out = P.hazard_classes(spark, d).withColumn("hazard_class", S.classify(F.round("score", 9)))
    return out.groupBy("hazard_class").agg(F.count("*").alias("cells"), F.round(F.avg("score"), 6).alias("mean_score"))


_C2 = _C1 + f", rated AS (SELECT *, 0.6::DOUBLE * terrain AS ct, 0.4::DOUBLE * flood AS cf FROM hazard WHERE score >= {P.STEEP}), cellid AS (SELECT row, col, score, ct, cf, row * 2147483648 + col AS id FROM rated), {RECURSIVE['reach']}" + "".join(f", {n} AS ({FIXTURES[n]})" for n in ("zone_cells", "zone_stats", "kept_zone"))


@query("C1_C2_zones_from_elevation", on_ground("SELECT rank, zone, pixel_count, area_m2, mean_score, mean_terrain, mean_flood FROM kept_zone", "slope", "ptr", last=_C2))
def _(spark, d):
    """From elevation in degrees to ranked zones, each step on the one before."""
    kept, _ = P.zones_from_elevation(spark, d, P.STEEP)
    return kept.select("rank", "zone", "pixel_count", "area_m2", "mean_score", "mean_terrain", "mean_flood")


@query("P3_warped_terrain", sql("SELECT row, col, round(elev, 5) AS elev FROM ground", "ground"))
def _(spark, d):
    return P.terrain(spark, d).cells.select("row", "col", F.round("elev", 5).alias("elev"))


@query("P4_warped_cover", sql(f"SELECT row, col, code FROM ({warped('g_lulc', 'code', weigh=False)})", "g_lulc"))
def _(spark, d):
    """Land cover in degrees on the terrain's grid, by the nearest cell."""
    given = P.elevation(spark, d).grid
    x0, y0, dx, dy = fx.GROUND
    return georef.warp(georef.Layer(fx.g_lulc(spark, d), given), georef.Grid(x0, y0, dx, dy, given.rows, given.cols), "code", "nearest").cells


_GRIDS = "SELECT 'terrain' AS layer, {0} AS x0, {1} AS y0, (SELECT max(row) + 1 FROM g_geo) AS rows, 'EPSG:32644' AS crs, true AS aligned, '' AS differs UNION ALL SELECT 'shifted', {0} + 15.0, {1}, (SELECT max(row) + 1 FROM g_geo), 'EPSG:32644', false, 'origin' UNION ALL SELECT 'degrees', 79.0, 30.5, (SELECT max(row) + 1 FROM g_geo), 'EPSG:4326', false, 'crs,origin,step' UNION ALL SELECT 'cut', {0}, {1}, (SELECT max(row) FROM g_geo), 'EPSG:32644', false, 'size'"


@query("S9_J13_grids", sql(f"SELECT layer, x0::DOUBLE AS x0, y0::DOUBLE AS y0, rows::BIGINT AS rows, crs, aligned, differs FROM ({_GRIDS.format(*fx.GROUND[:2])})", "g_geo"))
def _(spark, d):
    """Grids of one size that a count of rows and columns can't tell apart."""
    given = P.elevation(spark, d)
    x0, y0, dx, dy = fx.GROUND
    ground = georef.Grid(x0, y0, dx, dy, given.grid.rows, given.grid.cols)
    grids = {"terrain": ground, "shifted": replace(ground, x0=x0 + 15), "degrees": given.grid, "cut": replace(ground, rows=ground.rows - 1)}
    return georef.described(spark, {n: georef.Layer(given.cells, g) for n, g in grids.items()}).select("layer", "x0", "y0", "rows", "crs", "aligned", "differs")


@query("J13_warped_side_by_side", sql(f"SELECT g.row, g.col, round(g.elev, 5) AS elev, c.code FROM ground g LEFT JOIN ({warped('g_lulc', 'code', weigh=False)}) c USING (row, col)", "ground", "g_lulc"))
def _(spark, d):
    """Terrain and a cover in degrees side by side: the cover is on another grid and is warped."""
    ground, given = P.terrain(spark, d), P.elevation(spark, d).grid
    both = georef.co_registered({"elev": ground, "code": georef.Layer(fx.g_lulc(spark, d), given)}, {"elev": "elev", "code": "code"}, {"code": "nearest"})
    return both.cells.select("row", "col", F.round("elev", 5).alias("elev"), "code")


# Scores and classes


@query("P6_linear_score", sql("SELECT row, col, CASE WHEN slope IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, slope / 60.0::DOUBLE)), 6) END AS terrain FROM slope", "slope"))
def _(spark, d):
    return grid.slope(fx.g_dem(spark, d)).select("row", "col", F.round(S.linear_score(F.col("slope"), 0.0, 60.0), 6).alias("terrain"))


@query("P7_linear_score_twi", sql("SELECT area_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (mean_slope - 3.5) / 10.0::DOUBLE)), 6) AS flood FROM area", "area"))
def _(spark, d):
    return fx.area(spark, d).select("area_id", F.round(S.linear_score(F.col("mean_slope"), 3.5, 13.5), 6).alias("flood"))


_CLASS = "CASE WHEN {0} >= 0 AND {0} < 0.35 THEN 1 WHEN {0} < 0.65 THEN 2 WHEN {0} <= 1 THEN 3 END"


@query("P9_classify", sql(f"SELECT row, col, {_CLASS.format('terrain')} AS class FROM scores", "scores"))
def _(spark, d):
    return fx.scores(spark, d).select("row", "col", S.classify(F.col("terrain")).alias("class"))


@query("P10_overlay", sql("SELECT row, col, round(ct, 6) AS ct, round(cf, 6) AS cf, round(score, 6) AS score FROM overlay", "overlay"))
def _(spark, d):
    return _overlay(spark, d).select("row", "col", *[F.round(c, 6).alias(c) for c in ("ct", "cf", "score")])


@query("G16_class_distribution", sql(f"SELECT {_CLASS.format('score')} AS class, count(*) AS cells, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct_total, count(*) * 900.0::DOUBLE AS area_m2 FROM overlay GROUP BY 1", "overlay"))
def _(spark, d):
    return T.distribution(_overlay(spark, d).withColumn("class", S.classify(F.col("score"))), "class").withColumn("area_m2", F.col("cells") * 900.0)


_TEXT3 = "CASE WHEN {c} < 0.35 THEN 'Lower {t} (score < 0.35)' WHEN {c} < 0.65 THEN 'Moderate {t} (score 0.35-0.65)' ELSE 'Higher {t} (score >= 0.65)' END"
_SCALE = "CASE WHEN {0} / 10000 > 10000 THEN 'VERY_LARGE_UNFILTERED_TERRAIN_SCREEN — This polygon represents a large contiguous terrain area. Configurable filters (slope threshold, minimum mapping unit) are NOT_CONFIGURED. This is NOT a discrete relocation site recommendation.' WHEN {0} / 10000 > 100 THEN 'Large terrain cluster (> 100 ha). Minimum mapping unit filter NOT_CONFIGURED — sub-areas may vary in suitability.' WHEN {0} / 10000 > 10 THEN 'Moderate terrain cluster (10-100 ha).' ELSE 'Small terrain cluster (< 10 ha).' END"
_SLOPES = "CASE WHEN mean_slope < 15 THEN 'Gentle terrain (mean slope < 15 degrees)' WHEN mean_slope < 30 THEN 'Moderate terrain (mean slope 15-30 degrees)' ELSE 'Steep terrain (mean slope >= 30 degrees)' END"
_BUFFER = "CASE WHEN hazard_distance_m <= 500 THEN 'Within 500m of Candidate Red Zone boundary' WHEN hazard_distance_m <= 2000 THEN '500m to 2km from nearest Candidate Red Zone' ELSE 'Beyond 2km from nearest Candidate Red Zone (' || printf('%.1f', hazard_distance_m / 1000) || 'km)' END"


@query("P11_P15_area_context", sql(f"SELECT area_id, {_SLOPES} AS slope_context, {_TEXT3.format(c='mean_score', t='terrain susceptibility indicator')} AS terrain_context, {_TEXT3.format(c='mean_score', t='terrain-derived flood exposure')} AS flood_context, {_BUFFER} AS buffer_context, {_SCALE.format('area_m2 * 15')} AS scale FROM area", "area"))
def _(spark, d):
    c = F.col
    return fx.area(spark, d).select("area_id", S.slope_context(c("mean_slope")).alias("slope_context"), S.score_context(c("mean_score"), S.TERRAIN).alias("terrain_context"), S.score_context(c("mean_score"), S.FLOOD).alias("flood_context"), S.hazard_buffer_context(c("hazard_distance_m")).alias("buffer_context"), S.area_scale(c("area_m2") * 15 / 10000).alias("scale"))


@query("P16_token_count", sql("SELECT p_partkey, CAST(len(regexp_extract_all(p_type, 'E')) AS INT) AS n FROM part"))
def _(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", S.token_count(F.col("p_type"), "E").alias("n"))


_CAP = "CASE WHEN area_m2 > 1000000 THEN 'AREA_EXCEEDS_SITE_PLANNING_SCALE' ELSE 'PRELIMINARY_DWELLING_UNIT_SCENARIO' END AS capacity_status, CASE WHEN area_m2 <= 1000000 THEN CAST(trunc(area_m2 * 0.4::DOUBLE / 25) AS BIGINT) END AS estimated_household_capacity, CASE WHEN area_m2 <= 1000000 THEN CAST(trunc(area_m2 * 0.4::DOUBLE / 25) * 4 AS BIGINT) END AS estimated_population_capacity, CASE WHEN area_m2 <= 1000000 THEN area_m2 * 0.4::DOUBLE >= 2500 AND trunc(area_m2 * 0.4::DOUBLE / 25) >= 10 ELSE false END AS capacity_viable"
_CAP_NAMES = ["capacity_status", "estimated_household_capacity", "estimated_population_capacity", "capacity_viable"]


@query("P17_capacity", sql(f"SELECT area_id, {_CAP} FROM area", "area"))
def _(spark, d):
    return T.capacity(fx.area(spark, d)).select("area_id", *_CAP_NAMES)


@query("P18_proximity_band", sql("SELECT area_id, " + BAND.format("flag = 'R'", "hazard_distance_m") + " AS band FROM area", "area"))
def _(spark, d):
    return fx.area(spark, d).select("area_id", S.proximity_band(F.col("flag") == "R", F.col("hazard_distance_m")).alias("band"))


@query("P19_rates", sql("SELECT village_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in S.RATES) + " FROM rates", "rates"))
def _(spark, d):
    return T.rates(fx.census(spark, d)).select("village_id", *[F.round(c, 6).alias(c) for c in S.RATES])


@query("P20_vulnerability", sql("SELECT village_id, " + ", ".join(f"{c} AS {n}" for n, c in FLAGS.items()) + f", {FLAG_COUNT} AS flag_count, ({FLAG_COUNT}) || ' of 4 vulnerability factors flagged' AS context FROM rates", "rates"))
def _(spark, d):
    return T.vulnerability(T.rates(fx.census(spark, d))).select("village_id", *FLAGS, F.col("vulnerability_flag_count").alias("flag_count"), F.col("vulnerability_context").alias("context"))


@query("P36_active_flags", sql("SELECT village_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(("High Child Population", "High SC Population", "High Dependency Ratio", "High Illiteracy Rate"), FLAGS.values(), strict=True)) + ") AS flags FROM rates", "rates"))
def _(spark, d):
    return T.vulnerability(T.rates(fx.census(spark, d))).select("village_id", F.array_join("active_flags", ",").alias("flags"))


@query("A12_flag_histogram", sql(f"SELECT {FLAG_COUNT} AS flag_count, count(*) AS villages FROM rates GROUP BY 1", "rates"))
def _(spark, d):
    return T.vulnerability(T.rates(fx.census(spark, d))).groupBy(F.col("vulnerability_flag_count").alias("flag_count")).agg(F.count("*").alias("villages"))


_ROAD_CATEGORY = "CASE WHEN {s} > 3000 OR {m} IS NULL THEN 'ISOLATED_GRAPH_DISCONNECTED' WHEN {m} > 90 OR {s} > 1500 THEN 'SEVERELY_REMOTE' WHEN {m} > 45 THEN 'REMOTE' WHEN {m} > 15 OR {s} > 500 THEN 'MODERATELY_ACCESSIBLE' ELSE 'HIGHLY_ACCESSIBLE' END"


@query("P27_road_category", sql(f"SELECT *, category IN ('ISOLATED_GRAPH_DISCONNECTED', 'SEVERELY_REMOTE') AS isolated FROM (SELECT area_id, {_ROAD_CATEGORY.format(s='hazard_distance_m', m='mean_slope')} AS category FROM area)", "area"))
def _(spark, d):
    out = fx.area(spark, d).select("area_id", S.road_category(F.col("hazard_distance_m"), F.col("mean_slope")).alias("category"))
    return out.withColumn("isolated", S.road_isolated(F.col("category")))


@query("P30_P31_incident_defaults", sql("SELECT event_id, coalesce(fatalities, 0) AS fatalities, coalesce(uncertainty_m, 100) AS uncertainty_m, CASE WHEN coalesce(uncertainty_m, 100) <= 50 THEN 'HIGH_PRECISION (≤ 50 m)' WHEN coalesce(uncertainty_m, 100) <= 100 THEN 'MODERATE_PRECISION (51–100 m)' WHEN coalesce(uncertainty_m, 100) <= 200 THEN 'VILLAGE_SCALE_PRECISION (101–200 m)' ELSE 'CORRIDOR_SCALE_PRECISION (> 200 m)' END AS band FROM incident", "incident"))
def _(spark, d):
    filled = fx.incident(spark, d).fillna({"fatalities": 0, "uncertainty_m": 100})
    return filled.select("event_id", "fatalities", "uncertainty_m", S.uncertainty_band(F.col("uncertainty_m")).alias("band"))


@query("P32_driver", sql("SELECT zone, CASE WHEN mean_terrain / mean_score * 100 >= 65 THEN 'Terrain Susceptibility Dominated (Steep Flanks)' WHEN mean_flood / mean_score * 100 >= 65 THEN 'Hydrological Convergence Dominated (Channel Corridor / Terraces)' ELSE 'Dual Predisposition (Steep Gully / Convergence Flanks)' END AS driver FROM zone_stats", "zone_stats"))
def _(spark, d):
    return P.zone_stats(_zone_cells(spark, d)).select("zone", S.dominant_driver(F.col("mean_terrain"), F.col("mean_flood"), F.col("mean_score")).alias("driver"))


@query("F7_ecological_mask", sql("SELECT row, col, CASE WHEN valid THEN CAST(code IN (10, 50, 70, 80, 90) OR protected AS INT) END AS excluded FROM g_lulc", "g_lulc"))
def _(spark, d):
    return T.ecological_mask(fx.g_lulc(spark, d)).select("row", "col", "excluded")


_LEGEND = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in T.LAND_COVER) + ") l(code, label)"
_COVER = "SELECT l.code, l.label, count(g.code) AS pixels, round_even(count(g.code) * 0.09::DOUBLE, 2) AS hectares, round_even(count(g.code) * 100.0::DOUBLE / (SELECT count(*) FROM {0} WHERE valid), 2) AS pct_of_terrain, CASE WHEN l.code IN (10, 50, 70, 80, 90) THEN 'EXCLUDED' ELSE 'PERMISSIBLE' END AS policy FROM " + _LEGEND + " LEFT JOIN {0} g ON g.code = l.code GROUP BY l.code, l.label"


@query("P33_G17_land_cover", sql(_COVER.format("g_lulc"), "g_lulc"))
def _(spark, d):
    return T.land_cover_summary(fx.g_lulc(spark, d), 0.09)


# Zones


@query("G6_zones_by_joins", sql("SELECT row, col, zone FROM zone_cells", "zone_cells"))
def _(spark, d):
    """Small tiles and no task that has all edges: the joins that a large grid takes."""
    cells = _overlay(spark, d).where("score >= 0.65").select("row", "col")
    return tiles.zones(cells, tile=16, local_edges=0).select("row", "col", "zone")


@query("G6_zones", sql("SELECT row, col, zone FROM zone_cells", "zone_cells"))
def _(spark, d):
    return _zone_cells(spark, d).select("row", "col", "zone")


@query("G7_G9_zone_stats", sql("SELECT zone, pixel_count, area_m2, mean_score, max_score, min_score, mean_terrain, mean_flood FROM zone_stats", "zone_stats"))
def _(spark, d):
    return P.zone_stats(_zone_cells(spark, d)).select("zone", "pixel_count", "area_m2", "mean_score", "max_score", "min_score", "mean_terrain", "mean_flood")


@query("G13_G14_bounds_centroid", sql("SELECT zone, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, round(avg((col + 0.5::DOUBLE) * 30), 6) AS x, round(-avg((row + 0.5::DOUBLE) * 30), 6) AS y FROM zone_cells GROUP BY zone", "zone_cells"))
def _(spark, d):
    at = spatial.cell_centres(P.zone_stats(_zone_cells(spark, d)).withColumnsRenamed({"mean_row": "row", "mean_col": "col"}))
    return at.select("zone", "min_row", "max_row", "min_col", "max_col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("F21_W1_ranked_zones", sql("SELECT rank, printf('RZ-%03d', rank) AS zone_id, zone, area_m2, mean_score FROM kept_zone", "kept_zone"))
def _(spark, d):
    return P.red_zones(spark, d)[0].select("rank", "zone_id", "zone", "area_m2", "mean_score")


@query("G15_painted_zones", sql("SELECT row, col, zone_rank FROM kept_cells", "kept_cells"))
def _(spark, d):
    return P.red_zones(spark, d)[1].select("row", "col", "zone_rank")


@query("A4_zone_totals", sql("SELECT count(*) AS zones, sum(area_m2) AS total_m2, round_even(avg(area_m2), 2) AS mean_m2, round_even(avg(mean_score), 6) AS mean_score, round_even(avg(mean_terrain), 6) AS mean_terrain, round_even(avg(mean_flood), 6) AS mean_flood, round_even(avg(mean_terrain) * 100 / avg(mean_score), 2) AS terrain_pct, round_even(avg(mean_flood) * 100 / avg(mean_score), 2) AS flood_pct, arg_max(zone, {'a': area_m2, 'r': -rank}) AS largest, arg_min(zone, {'a': area_m2, 'r': rank}) AS smallest, arg_min(zone, rank) AS first FROM kept_zone", "kept_zone"))
def _(spark, d):
    return summaries.zone_totals(P.red_zones(spark, d)[0])


@query("A5_retention", sql("SELECT count(*) AS initial, count(*) FILTER (WHERE area_m2 >= 5000) AS retained, count(*) FILTER (WHERE area_m2 < 5000) AS removed, round_even(sum(area_m2 / 10000), 4) AS initial_ha, round_even(coalesce(sum(area_m2 / 10000) FILTER (WHERE area_m2 >= 5000), 0), 4) AS retained_ha, round_even(coalesce(sum(area_m2 / 10000) FILTER (WHERE area_m2 < 5000), 0), 4) AS removed_ha FROM zone_stats", "zone_stats"))
def _(spark, d):
    return summaries.retention(P.zone_stats(_zone_cells(spark, d)), P.ZONE_M2)


@query("C2_red_zone_summary", sql("SELECT count(*) AS components, count(*) FILTER (WHERE area_m2 >= 5000) AS kept, sum(area_m2) FILTER (WHERE area_m2 >= 5000) AS kept_m2, sum(area_m2) FILTER (WHERE area_m2 < 5000) AS dropped_m2 FROM zone_stats", "zone_stats"))
def _(spark, d):
    s = P.zone_stats(_zone_cells(spark, d))
    big = F.col("area_m2") >= P.ZONE_M2
    return s.agg(F.count("*").alias("components"), F.count_if(big).alias("kept"), F.sum(F.when(big, F.col("area_m2"))).alias("kept_m2"), F.sum(F.when(~big, F.col("area_m2"))).alias("dropped_m2"))


@query("L6_top_zones", sql("SELECT rank, zone, mean_score FROM kept_zone ORDER BY rank LIMIT 10", "kept_zone"))
def _(spark, d):
    return views.top_zones(P.red_zones(spark, d)[0]).select("rank", "zone", "mean_score")


@query("G8_rings", sql("SELECT zone, sum(CASE WHEN x.row IS NULL THEN 1 ELSE 0 END) AS sides, sum(CASE WHEN x.row IS NULL THEN s.area ELSE 0 END) AS area_m2 FROM kept_cells m CROSS JOIN (SELECT 0 AS dr, 1 AS dc, 'E' AS side UNION ALL SELECT 1, 0, 'S' UNION ALL SELECT 0, -1, 'W' UNION ALL SELECT -1, 0, 'N') s0 LEFT JOIN kept_cells x ON x.row = m.row + s0.dr AND x.col = m.col + s0.dc AND x.zone = m.zone CROSS JOIN LATERAL (SELECT CASE s0.side WHEN 'E' THEN (m.col + 1) * 900 WHEN 'W' THEN -m.col * 900 ELSE 0 END AS area) s GROUP BY zone".replace("SELECT zone", "SELECT m.zone").replace("GROUP BY zone", "GROUP BY m.zone"), "kept_cells"))
def _(spark, d):
    found = grid.rings(grid.boundary_edges(P.red_zones(spark, d)[1])).select("zone", F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    shoelace = F.aggregate(F.zip_with("a", "b", lambda p, q: (p["x"] + q["x"]) * (p["y"] - q["y"]) / 2), F.lit(0.0), lambda t, v: t + v)
    return found.groupBy("zone").agg(F.sum(F.size("a")).alias("sides"), F.sum(shoelace).cast("long").alias("area_m2"))


# Corners, holes and parts of zones by counting the cells about each grid corner (Euler's number), parts by recursion.
_QUADS = """
four(id, root) AS (
    SELECT row * 2147483648 + col, row * 2147483648 + col FROM kept_cells
    UNION
    SELECT n.row * 2147483648 + n.col, f.root FROM four f, (VALUES (1), (-1), (2147483648), (-2147483648)) o(step), kept_cells n
    WHERE n.row * 2147483648 + n.col = f.id + o.step AND f.root < n.row * 2147483648 + n.col
),
parts AS (
    SELECT zone, count(DISTINCT root) AS polygons
    FROM (SELECT id, min(root) AS root FROM four GROUP BY id) f JOIN kept_cells k ON k.row * 2147483648 + k.col = f.id GROUP BY zone
),
quads AS (
    SELECT zone, sum(1 << (o.dr * 2 + o.dc)) AS mask
    FROM kept_cells k, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) GROUP BY zone, k.row + o.dr, k.col + o.dc
),
turns AS (
    SELECT zone, count(*) FILTER (WHERE mask IN (1, 2, 4, 8)) AS q1, count(*) FILTER (WHERE mask IN (7, 11, 13, 14)) AS q3,
           count(*) FILTER (WHERE mask IN (6, 9)) AS qd FROM quads GROUP BY zone
),
outlines AS (
    SELECT t.zone, p.polygons, p.polygons - (q1 - q3 + 2 * qd) // 4 AS holes, q1 + q3 + 2 * qd AS corners,
           (SELECT count(*) * 900.0::DOUBLE FROM kept_cells k WHERE k.zone = t.zone) AS area_m2
    FROM turns t JOIN parts p USING (zone)
)
"""


def _outlines(spark: SparkSession, d: str, **how) -> DataFrame:
    return polygons.multipolygons(polygons.polygons(P.red_zones(spark, d)[1], **how))


@query("G8_polygons", sql("SELECT * FROM outlines", "kept_cells", last=_QUADS))
def _(spark, d):
    return _outlines(spark, d).select("zone", F.size("polygons").alias("polygons"), "holes", "corners", "area_m2")


@query("G8_polygons_by_joins", sql("SELECT * FROM outlines", "kept_cells", last=_QUADS))
def _(spark, d):
    """Small tiles and no task that has all chains: the joins that a large grid takes."""
    return _outlines(spark, d, tile=16, local_edges=0, local_nodes=0).select("zone", F.size("polygons").alias("polygons"), "holes", "corners", "area_m2")


@query("K1_zone_features", sql("SELECT zone, polygons, holes, corners, area_m2 FROM outlines", "kept_cells", last=_QUADS))
def _(spark, d):
    """The zones as written features, counted and measured from what is read back."""
    path = _folder(spark, "zones")
    io.write_geojson(_outlines(spark, d), path, "MultiPolygon", "polygons", ["zone"])
    back = io.read_geojson(spark, path, "MultiPolygon", "polygons", "zone bigint").withColumn("rings", F.flatten("polygons"))
    total = lambda f, start: F.aggregate("rings", start, lambda t, r: t + f(r))
    corners, area = total(lambda r: F.size(r) - 1, F.lit(0)), total(polygons.shoelace, F.lit(0.0))
    return back.select("zone", F.size("polygons").alias("polygons"), (F.size("rings") - F.size("polygons")).alias("holes"), corners.alias("corners"), area.alias("area_m2"))


@query("G11_majority", sql("SELECT zone, dominant_code FROM area_code", "area_code"))
def _(spark, d):
    return grid.majority(P.area_cells(spark, d))


@query("G12_dilation", sql("SELECT DISTINCT m.row + o.dr AS row, m.col + o.dc AS col FROM mask m, (SELECT a.r AS dr, b.r AS dc FROM (SELECT unnest(range(-2, 3)) AS r) a, (SELECT unnest(range(-2, 3)) AS r) b WHERE abs(a.r) + abs(b.r) <= 2) o WHERE NOT EXISTS (SELECT 1 FROM mask x WHERE x.row = m.row + o.dr AND x.col = m.col + o.dc)", "mask"))
def _(spark, d):
    return grid.dilate(_overlay(spark, d).where("score >= 0.65").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")), 2)


@query("G8_boundary_edges", sql("SELECT side, count(*) AS edges FROM mask m, (VALUES (0, 1, 'E'), (1, 0, 'S'), (0, -1, 'W'), (-1, 0, 'N')) s(dr, dc, side) WHERE NOT EXISTS (SELECT 1 FROM mask x WHERE x.row = m.row + s.dr AND x.col = m.col + s.dc) GROUP BY side", "mask"))
def _(spark, d):
    return grid.boundary_edges(_zone_cells(spark, d)).groupBy("side").agg(F.count("*").alias("edges"))


# Spatial joins and priority


@query("J5_J11_nearest", sql("SELECT village_id, facility_id, distance_m FROM facility_near", "facility_near"))
def _(spark, d):
    return spatial.nearest(_villages(spark, d), fx.facility(spark, d), "village_id", "facility_id")


@query("J12_within_radius", sql("SELECT f.facility_id, count(*) FILTER (WHERE d <= 1000) AS n_1km, count(*) FILTER (WHERE d <= 2000) AS n_2km, count(*) FILTER (WHERE d <= 2000 AND h = 'CLICK') AS n_2km_click FROM facility f LEFT JOIN (SELECT facility_id, sqrt((f.x - i.x) ** 2 + (f.y - i.y) ** 2) AS d, i.hazard_type AS h FROM facility f JOIN incident i ON abs(f.x - i.x) <= 2000 AND abs(f.y - i.y) <= 2000) m USING (facility_id) GROUP BY 1", "facility", "incident"))
def _(spark, d):
    out = spatial.within_radius(fx.facility(spark, d), fx.incident(spark, d), "facility_id", {"n_1km": 1000.0, "n_2km": 2000.0}, {"click": F.col("hazard_type") == "CLICK"})
    return out.select("facility_id", "n_1km", "n_2km", "n_2km_click")


@query("J4_points_in_zones", sql("SELECT village_id, matched_zone AS zone FROM exposure", "exposure"))
def _(spark, d):
    return spatial.points_in_zones(_villages(spark, d), P.red_zones(spark, d)[1], "village_id").select("village_id", "zone")


@query("J5_nearest_zone", sql("SELECT village_id, nearest_zone, distance_m FROM exposure", "exposure"))
def _(spark, d):
    return P.exposure(spark, d).select("village_id", "nearest_zone", "distance_m")


@query("C3_exposure", sql("SELECT village_id, matched_zone, nearest_zone, distance_m, overlap, band FROM exposure", "exposure"))
def _(spark, d):
    return P.exposure(spark, d).select("village_id", "matched_zone", "nearest_zone", "distance_m", "overlap", "band")


@query("A6_inside_outside", sql("SELECT side, habitations, population, households, sc, st, " + ", ".join(f"round_even(coalesce(100.0::DOUBLE * {c} / nullif(sum({c}) OVER (), 0), 0), 2) AS {c}_pct" for c in ("habitations", "population", "households", "sc", "st")) + ", true AS reconciled FROM (SELECT s.side, count(e.village_id) AS habitations, coalesce(sum(tot_p), 0) AS population, coalesce(sum(no_hh), 0) AS households, coalesce(sum(p_sc), 0) AS sc, coalesce(sum(p_st), 0) AS st FROM (VALUES (true, 'Inside Candidate Hazard-Based Red Zone'), (false, 'Outside Candidate Hazard-Based Red Zone')) s(k, side) LEFT JOIN exposure e ON e.overlap = s.k GROUP BY s.side)", "exposure"))
def _(spark, d):
    return summaries.inside_outside(P.exposure(spark, d))


_BANDS = "(VALUES " + ", ".join(f"('{b}')" for b in S.BAND_ORDER) + ") b(band)"


@query("A7_exposure_by_band", sql("SELECT *, " + ", ".join(f"round_even(coalesce(100.0::DOUBLE * {c} / nullif(sum({c}) OVER (), 0), 0), 2) AS {c}_pct" for c in ("n", "population", "households", "sc", "st")) + f" FROM (SELECT b.band, count(e.village_id) AS n, coalesce(sum(tot_p), 0) AS population, coalesce(sum(no_hh), 0) AS households, coalesce(sum(p_sc), 0) AS sc, coalesce(sum(p_st), 0) AS st FROM {_BANDS} LEFT JOIN exposure e USING (band) GROUP BY b.band)", "exposure"))
def _(spark, d):
    return summaries.by_band(P.exposure(spark, d))


@query("L3_close_villages", sql("SELECT village_id, distance_m FROM exposure WHERE distance_m <= 500 ORDER BY 2, 1", "exposure"))
def _(spark, d):
    return views.close_villages(P.exposure(spark, d)).select("village_id", "distance_m")


@query("J14_sample", sql("SELECT village_id, terrain, flood, hazard_class FROM sampled", "sampled"))
def _(spark, d):
    cells = _overlay(spark, d).withColumn("hazard_class", S.classify(F.col("score"))).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "terrain", "flood", "hazard_class")
    there = spatial.sample_cells(_villages(spark, d), cells, ["terrain", "flood", "hazard_class"])
    return there.select("village_id", "terrain", "flood", S.clean_class(F.col("hazard_class")).alias("hazard_class"))


@query("P21_C4_priority", sql("SELECT village_id, distance_m, hazard_class, priority_tier FROM profile", "profile"))
def _(spark, d):
    return P.profiles(spark, d).select("village_id", "distance_m", "hazard_class", "priority_tier")


_CTX = "CASE WHEN hazard_class IS NULL THEN 'MH class unavailable (NoData)' ELSE 'MH Class ' || hazard_class END"
_AT = "'(distance: ' || printf('%.0f', round_even(distance_m, 0)) || 'm, nearest: ' || nearest_zone || ')'"
_REASON = f"CASE WHEN overlap THEN 'HARD RULE: Village centroid directly overlaps Candidate Hazard-Based Red Zone polygon. Village sits within red zone boundary. (' || {_CTX} || ' at centroid)' WHEN distance_m <= 500 AND hazard_class >= 2 THEN 'Centroid within 500m of Candidate Red Zone ' || {_AT} || ' AND ' || {_CTX} || ' at centroid (rule: MH Class ≥ 2). Close proximity with moderate-higher hazard terrain at centroid.' WHEN distance_m <= 500 AND hazard_class IS NULL THEN 'Centroid within 500m of Candidate Red Zone ' || {_AT} || ' but ' || {_CTX} || '. Cannot confirm Tier 1 MH class condition. Assigned Tier 2 (conservative — avoids unverified elevation).' WHEN distance_m <= 2000 THEN 'Centroid within 2000m of Candidate Red Zone ' || {_AT} || '. ' || {_CTX} || ' at centroid.' || CASE WHEN distance_m <= 500 THEN ' Note: within 500m threshold but ' || {_CTX} || ' (Lower class — below Tier 1 class threshold ≥ 2).' ELSE '' END WHEN distance_m <= 5000 THEN 'Centroid within 5000m of Candidate Red Zone ' || {_AT} || '. ' || {_CTX} || ' at centroid. Within monitoring proximity band.' ELSE 'Centroid beyond 5000m from nearest Candidate Red Zone ' || {_AT} || '. ' || {_CTX} || ' at centroid. Outside monitoring proximity band.' END"
_RULE = "CASE WHEN overlap THEN 'direct_zone_overlap = True (hard safety rule)' WHEN distance_m <= 500 AND hazard_class >= 2 THEN 'dist ≤ 500m AND mh_class ≥ 2' WHEN distance_m <= 500 AND hazard_class IS NULL THEN 'dist ≤ 500m; mh_class = NoData (conservative Tier 2)' WHEN distance_m <= 2000 THEN 'dist ≤ 2000m' WHEN distance_m <= 5000 THEN 'dist ≤ 5000m' ELSE 'dist > 5000m' END"


@query("P21_reasons", sql(f"SELECT village_id, {_RULE} AS applied_rule, {_REASON} AS priority_reason FROM profile", "profile"))
def _(spark, d):
    return P.profiles(spark, d).select("village_id", "applied_rule", "priority_reason")


@query("P23_horizon", sql("SELECT village_id, CASE priority_tier WHEN 'Tier1_AttentionPriority' THEN 'IMMEDIATE_FIELD_ASSESSMENT' WHEN 'Tier2_ElevatedAttention' THEN 'SHORT_TERM_PLANNING_REVIEW' WHEN 'Tier3_Monitoring' THEN 'MEDIUM_TERM_MONITORING' WHEN 'BeyondProximity' THEN 'ROUTINE_MONITORING' ELSE 'UNKNOWN' END AS relocation_horizon, CASE priority_tier WHEN 'Tier1_AttentionPriority' THEN '0-1' WHEN 'Tier2_ElevatedAttention' THEN '1-3' WHEN 'Tier3_Monitoring' THEN '3-10' WHEN 'BeyondProximity' THEN '10+' ELSE 'N/A' END AS planning_horizon_years FROM profile", "profile"))
def _(spark, d):
    return P.profiles(spark, d).select("village_id", "relocation_horizon", "planning_horizon_years")


@query("C4_village_tiers", sql("SELECT priority_tier, count(*) AS villages, sum(tot_p) AS population, sum(no_hh) AS households, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM profile GROUP BY priority_tier", "profile"))
def _(spark, d):
    return summaries.tier_distribution(P.profiles(spark, d)).drop("label")


@query("A10_classes", sql("SELECT c.class, count(p.village_id) AS villages FROM (VALUES ('Class_1'), ('Class_2'), ('Class_3'), ('NoData')) c(class) LEFT JOIN profile p ON coalesce('Class_' || p.hazard_class, 'NoData') = c.class GROUP BY c.class", "profile"))
def _(spark, d):
    return summaries.class_distribution(P.profiles(spark, d))


@query("A11_indicators", sql(" UNION ALL ".join(f"SELECT '{c}' AS indicator, 'AVAILABLE' AS status, round_even(avg({c}), 4) AS mean, round_even(median({c}), 4) AS median, round_even(min({c}), 4) AS min, round_even(max({c}), 4) AS max, count({c}) AS n FROM rates" for c in S.RATES), "rates"))
def _(spark, d):
    return summaries.indicator_stats(T.rates(fx.census(spark, d)), list(S.RATES))


@query("A15_block_summary", sql("SELECT subdist, count(*) AS villages, sum(tot_p) AS population, count(*) FILTER (WHERE priority_tier = 'Tier1_AttentionPriority') AS tier1_immediate, count(*) FILTER (WHERE priority_tier = 'Tier2_ElevatedAttention') AS tier2_short_term, count(*) FILTER (WHERE priority_tier = 'Tier3_Monitoring') AS tier3_monitoring, count(*) FILTER (WHERE priority_tier = 'BeyondProximity') AS beyond_proximity, coalesce(sum(tot_p) FILTER (WHERE priority_tier IN ('Tier1_AttentionPriority', 'Tier2_ElevatedAttention')), 0) AS at_risk_population, count(*) FILTER (WHERE vulnerability_flag_count >= 2) AS high_vulnerability_villages FROM profile GROUP BY subdist", "profile"))
def _(spark, d):
    return summaries.block_summary(P.profiles(spark, d))


_QUEUE = "priority_tier IN ('Tier1_AttentionPriority', 'Tier2_ElevatedAttention')"


@query("L1_action_queue", sql(f"SELECT village_id, priority_tier, distance_m, vulnerability_flag_count FROM profile WHERE {_QUEUE} AND vulnerability_flag_count >= 2 ORDER BY distance_m, village_id LIMIT 200", "profile"))
def _(spark, d):
    return views.action_queue(P.profiles(spark, d), high_vulnerability_only=True).select("village_id", "priority_tier", "distance_m", "vulnerability_flag_count")


@query("A16_queue_summary", sql(f"SELECT priority_tier, count(*) AS villages, sum(tot_p) AS population, sum(no_hh) AS households FROM profile WHERE {_QUEUE} GROUP BY 1", "profile"))
def _(spark, d):
    return views.queue_summary(P.profiles(spark, d))


@query("L2_attention_list", sql(f"SELECT village_id, distance_m, substring({_REASON}, 1, 200) AS reason FROM profile WHERE priority_tier = 'Tier1_AttentionPriority' ORDER BY 2, 1", "profile"))
def _(spark, d):
    return views.attention_list(P.profiles(spark, d)).select("village_id", "distance_m", "reason")


@query("K5_priority_report", sql(f"SELECT village_id AS Village_ID, name AS Village_Name, priority_tier AS Priority_Tier, distance_m AS Distance_to_Hazard_Zone_m, tot_p AS Total_Population, no_hh AS Households, subdist AS Sub_District_ID FROM profile WHERE {_QUEUE}", "profile"))
def _(spark, d):
    return views.priority_report(P.profiles(spark, d)).select("Village_ID", "Village_Name", "Priority_Tier", "Distance_to_Hazard_Zone_m", "Total_Population", "Households", "Sub_District_ID")


@query("C12_tiers_by_view", sql("SELECT priority_tier, count(*) AS n FROM profile WHERE priority_tier IN ('Tier1_AttentionPriority', 'Tier3_Monitoring') AND contains(lower(name), '00001') GROUP BY 1", "profile"))
def _(spark, d):
    shown = views.toggled(P.profiles(spark, d), {S.TIERS[0]: True, S.TIERS[1]: False, S.TIERS[2]: True})
    return views.name_contains(shown, "00001").groupBy("priority_tier").agg(F.count("*").alias("n"))


# Areas


@query("F6_A30_screening", sql("SELECT predicate, cells, round_even(cells * 0.09::DOUBLE, 2) AS hectares FROM (SELECT count(*) FILTER (WHERE v AND hazard_class = 3) AS hazard_class_3, count(*) FILTER (WHERE v AND flood_class = 3) AS flood_class_3, count(*) FILTER (WHERE v AND zone IS NOT NULL) AS red_zone, count(*) FILTER (WHERE v AND slope > 20) AS slope_max, NULL::BIGINT AS red_zone_buffer, NULL::BIGINT AS flood_class_2, NULL::BIGINT AS hazard_class_2, NULL::BIGINT AS elevation_max, count(*) FILTER (WHERE v AND eco = 1) AS ecological, count(*) FILTER (WHERE excluded = 1) AS \"all\" FROM (SELECT *, slope IS NOT NULL AND score IS NOT NULL AS v FROM screen)) UNPIVOT INCLUDE NULLS (cells FOR predicate IN (hazard_class_3, flood_class_3, red_zone, slope_max, red_zone_buffer, flood_class_2, hazard_class_2, elevation_max, ecological, \"all\"))", "screen"))
def _(spark, d):
    return summaries.mask_log(P.screened(spark, d)[1], 0.09)


@query("C5_candidate_areas", sql("SELECT area_id, pixel_count, area_m2, mean_slope, max_slope, dominant_code, nearest_zone, hazard_distance_m, nearest_village, nearest_village_pop, nearest_village_m FROM cand JOIN cand_near USING (area_id) JOIN cand_home USING (area_id)", "cand", "cand_near", "cand_home"))
def _(spark, d):
    return P.candidate_areas(spark, d).select("area_id", "pixel_count", "area_m2", "mean_slope", "max_slope", "dominant_code", "nearest_zone", "hazard_distance_m", "nearest_village", "nearest_village_pop", "nearest_village_m")


_FOUR = ("slope", "terrain", "flood", "score")


@query("G10_area_stats", sql("SELECT zone, " + ", ".join(f"round({f}({c}), 7) AS {n}_{c}" for c in _FOUR for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + " FROM area_cells GROUP BY zone", "area_cells"))
def _(spark, d):
    stats = grid.zone_summary(P.area_cells(spark, d), P.CELL_M2, {c: c for c in _FOUR}, digits=12)
    return stats.select("zone", *[F.round(f"{n}_{c}", 7).alias(f"{n}_{c}") for c in _FOUR for n in ("mean", "max", "min")])


@query("C6_area_context", sql(f"SELECT area_id, {_SLOPES} AS slope_context, {_BUFFER} AS hazard_buffer_context, {_SCALE.format('area_m2')} AS area_scale_context, 'slope_max_deg=20.0; redzone_buffer_m=NOT_CONFIGURED; exclude_flood_class_2=NOT_CONFIGURED; minimum_area_m2=2700.0; maximum_area_m2=NOT_CONFIGURED' AS screening_basis, 3 AS not_configured, {_CAP} FROM cand JOIN cand_near USING (area_id)", "cand", "cand_near"))
def _(spark, d):
    return P.area_context(P.candidate_areas(spark, d)).select("area_id", "slope_context", "hazard_buffer_context", "area_scale_context", "screening_basis", "not_configured", *_CAP_NAMES)


@query("A13_A14_area_totals", sql(f"SELECT count(*) AS areas, round_even(sum(area_m2) / 10000, 4) AS hectares, count(estimated_household_capacity) AS estimated, count(*) FILTER (WHERE capacity_viable) AS viable, coalesce(sum(estimated_household_capacity), 0) AS households, coalesce(sum(estimated_population_capacity), 0) AS population FROM (SELECT area_m2, {_CAP} FROM cand)", "cand"))
def _(spark, d):
    return summaries.area_totals(P.area_context(P.candidate_areas(spark, d)))


@query("C11_decision_summary", sql("SELECT (SELECT count(*) FROM profile) AS total_villages, (SELECT count(DISTINCT priority_tier) FROM profile) AS tiers, 7 AS bands, 4 AS classes, 5 AS indicators, (SELECT count(*) FROM cand) AS areas", "profile", "cand"))
def _(spark, d):
    n = lambda c: F.size(c).alias(c)
    return P.decision(spark, d).select("total_villages", n("tiers"), n("bands"), n("classes"), n("indicators"), F.col("areas")[0]["areas"].alias("areas"))


@query("C11_decision_parts", sql("SELECT 'tier' AS part, priority_tier AS name, count(*) AS n, sum(tot_p)::BIGINT AS population FROM profile GROUP BY 2 UNION ALL SELECT 'band', band, count(*), sum(tot_p)::BIGINT FROM profile GROUP BY 2", "profile"))
def _(spark, d):
    """What the summary says of tiers and bands that have villages."""
    made = staged(P.decision(spark, d), "decision")
    part = lambda c, name, n: made.select(F.inline(c)).select(F.lit(c[:-1]).alias("part"), F.col(name).alias("name"), F.col(n).alias("n"), "population")
    return part("tiers", "priority_tier", "villages").unionByName(part("bands", "band", "n")).where("n > 0")


# Incidents


_DEDUP = (
    "pr AS (SELECT a.event_id AS i, b.event_id AS j FROM incident a JOIN incident b ON a.hazard_type = b.hazard_type AND a.event_id < b.event_id AND abs(a.x - b.x) <= 500 AND abs(a.y - b.y) <= 500 "
    "WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 500 AND CASE WHEN a.date IS NOT NULL AND b.date IS NOT NULL THEN abs(date_diff('day', a.date, b.date)) <= 3 ELSE a.year = b.year END), "
    "need AS (SELECT j, count(*) AS n FROM pr GROUP BY j), "
    "st(id, leader) USING KEY (id) AS (SELECT event_id, event_id FROM incident WHERE event_id NOT IN (SELECT j FROM pr) "
    "UNION SELECT j, coalesce(lead, j) FROM (SELECT p.j, count(*) AS c, min(p.i) FILTER (WHERE s.leader = p.i) AS lead FROM (SELECT DISTINCT q.j FROM st JOIN pr q ON q.i = st.id) w JOIN pr p ON p.j = w.j JOIN recurring.st s ON s.id = p.i GROUP BY p.j) JOIN need USING (j) LEFT JOIN recurring.st t ON t.id = j WHERE c = n AND t.id IS NULL)"
)


@query("J17_dedup_invariant", sql("SELECT id AS event_id, leader FROM st", "incident", last=_DEDUP))
def _(spark, d):
    return spatial.dedup_events(fx.incident(spark, d), "event_id", "hazard_type")


@query("A23_dedup_summary", sql("SELECT (SELECT count(*) FROM incident) AS raw, count(*) FILTER (WHERE leader = id) AS canonical, count(*) FILTER (WHERE leader <> id) AS merged, count(DISTINCT leader) FILTER (WHERE leader <> id) AS leaders_with_duplicates FROM st", "incident", last=_DEDUP))
def _(spark, d):
    events = fx.incident(spark, d)
    merged = spatial.merged_events(events, spatial.dedup_events(events, "event_id", "hazard_type"), "event_id")
    return summaries.dedup_summary(events, merged)


@query("C9_inventory", sql("SELECT i.event_id, g.fatalities, g.provider, g.duplicate_count FROM incident i JOIN (SELECT leader, coalesce(greatest(max(CASE WHEN id = leader THEN coalesce(fatalities, 0) END), max(fatalities) FILTER (WHERE id <> leader)), 0) AS fatalities, string_agg(DISTINCT provider, ' + ' ORDER BY provider) AS provider, count(*) - 1 AS duplicate_count FROM st JOIN incident ON event_id = id GROUP BY leader) g ON g.leader = i.event_id", "incident", last=_DEDUP))
def _(spark, d):
    return P.inventory(spark, d).select("event_id", "fatalities", "provider", "duplicate_count")


_GONE = "SELECT g.leader, string_agg(e.provider, ', ' ORDER BY e.event_id) AS names, round_even(arg_min(sqrt((e.x - l.x) * (e.x - l.x) + (e.y - l.y) * (e.y - l.y)), e.event_id), 1) AS m FROM st g JOIN incident e ON e.event_id = g.id JOIN incident l ON l.event_id = g.leader WHERE g.id <> g.leader GROUP BY g.leader"


@query("K3_provenance", sql(f"SELECT printf('DIS-%d-%03d', i.year, row_number() OVER (PARTITION BY i.year ORDER BY i.date NULLS FIRST, i.event_id)) AS canonical_incident_id, i.year AS event_year, CASE WHEN d.leader IS NULL THEN 'UNIQUE_RECORD' ELSE 'MERGED_CROSS_SOURCE_DUPLICATE' END AS deduplication_status, coalesce(d.m, 0) AS spatial_offset_to_duplicate_m, coalesce(d.names, 'NONE (Unique Record)') AS merged_duplicate_source_info FROM incident i JOIN st s ON s.id = i.event_id AND s.leader = s.id LEFT JOIN ({_GONE}) d ON d.leader = i.event_id", "incident", last=_DEDUP))
def _(spark, d):
    return io.provenance(P.inventory(spark, d)).select("canonical_incident_id", "event_year", "deduplication_status", "spatial_offset_to_duplicate_m", "merged_duplicate_source_info")


_INCIDENT_JOIN = "SELECT v.village_id, arg_min(i.event_id, {'d': (v.x - i.x) * (v.x - i.x) + (v.y - i.y) * (v.y - i.y), 'i': i.event_id}) AS nearest_incident, round_even(sqrt(min((v.x - i.x) * (v.x - i.x) + (v.y - i.y) * (v.y - i.y))), 1) AS nearest_incident_m, count(*) FILTER (WHERE d <= 1000) AS n_1km, count(*) FILTER (WHERE d <= 2000) AS n_2km, count(*) FILTER (WHERE d <= 2000 AND hazard_type IN ('CLICK', 'VIEW')) AS n_2km_mass, count(*) FILTER (WHERE d <= 2000 AND hazard_type = 'PURCHASE') AS n_2km_flood FROM village v CROSS JOIN incident i CROSS JOIN LATERAL (SELECT sqrt((v.x - i.x) * (v.x - i.x) + (v.y - i.y) * (v.y - i.y)) AS d) GROUP BY v.village_id"


@query("J9_C9_village_incidents", sql(_INCIDENT_JOIN, "village", "incident"))
def _(spark, d):
    return P.village_incidents(spark, d, fx.incident(spark, d)).select("village_id", "nearest_incident", "nearest_incident_m", "n_1km", "n_2km", "n_2km_mass", "n_2km_flood")


@query("A22_incident_exposure", sql(f"SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c} > 0) AS with_{c}" for c in ("n_1km", "n_2km", "n_2km_mass", "n_2km_flood")) + f", count(*) FILTER (WHERE n_2km >= 2) AS chronic, round_even(avg(nearest_incident_m), 1) AS mean_nearest_m FROM ({_INCIDENT_JOIN})", "village", "incident"))
def _(spark, d):
    return summaries.incident_exposure(P.village_incidents(spark, d, fx.incident(spark, d)))


@query("W4_incident_ids", sql("SELECT event_id, printf('DIS-%d-%03d', year, row_number() OVER (PARTITION BY year ORDER BY date NULLS FIRST, event_id)) AS incident_id FROM incident", "incident"))
def _(spark, d):
    return T.incident_ids(fx.incident(spark, d)).select("event_id", "incident_id")


@query("A21_incident_counts", sql("SELECT 'hazard_type' AS attr, hazard_type AS value, count(*) AS n FROM incident GROUP BY 2 UNION ALL SELECT 'provider', provider, count(*) FROM incident GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM incident GROUP BY 2", "incident"))
def _(spark, d):
    return T.value_counts(fx.incident(spark, d), ["hazard_type", "provider", "year"])


# Roads


@query("P26_road_attributes", sql("SELECT u, v, speed_kmh, round(length_m / 1000 / speed_kmh * 60, 8) AS minutes, is_vehicular, is_arterial FROM attributes", "attributes"))
def _(spark, d):
    return roads.road_attributes(fx.road(spark, d), digits=8).select("u", "v", "speed_kmh", "minutes", "is_vehicular", "is_arterial")


@query("A17_road_summary", sql("SELECT highway, count(*) AS segments, round_even(sum(length_m) / 1000, 2) AS length_km, arg_min(speed_kmh, seq) AS assumed_speed_kmh, arg_min(is_vehicular, seq) AS is_vehicular, arg_min(is_arterial, seq) AS is_arterial FROM attributes GROUP BY highway", "attributes"))
def _(spark, d):
    return roads.road_summary(roads.road_attributes(fx.road(spark, d)))


@query("A17_road_totals", sql("SELECT count(*) AS segments, round_even(sum(length_m) / 1000, 2) AS total_km, round_even(sum(length_m) FILTER (WHERE is_vehicular) / 1000, 2) AS vehicular_km, round_even(sum(length_m) FILTER (WHERE is_arterial) / 1000, 2) AS arterial_km FROM attributes", "attributes"))
def _(spark, d):
    return roads.road_totals(roads.road_attributes(fx.road(spark, d)))


@query("R1_edges", sql("SELECT u, v, length_m, minutes, is_arterial FROM net", "net"))
def _(spark, d):
    return roads.lines_to_edges(P.lines(spark, d)).select("u", "v", "length_m", "minutes", "is_arterial")


@query("R2_vehicular_edges", sql("SELECT u, v, length_m, minutes, is_arterial FROM vnet", "vnet"))
def _(spark, d):
    return roads.lines_to_edges(P.lines(spark, d), vehicular_only=True).select("u", "v", "length_m", "minutes", "is_arterial")


_FLOOD = "flood0(node, root) USING KEY (node) AS (SELECT node, node AS root FROM ({nodes}) UNION SELECT b, min(root) FROM (SELECT e.b, f.root FROM flood0 f JOIN ({both}) e ON e.a = f.node JOIN recurring.flood0 k ON k.node = e.b WHERE f.root < k.root) GROUP BY b)"


def _flood(net: str) -> str:
    return _FLOOD.format(nodes=f"SELECT u AS node FROM {net} UNION SELECT v FROM {net}", both=f"SELECT u AS a, v AS b FROM {net} UNION ALL SELECT v, u FROM {net}")


def _mixed(spark, d):
    """Road and shortcuts as one network; of duplicate edges the last stays."""
    both = fx.road(spark, d).unionByName(fx.road_x(spark, d))
    return roads.last_edges(roads.road_attributes(both), ["seq", "length_m"])


@query("R3_components", sql("SELECT root AS component, count(*) AS nodes FROM flood0 GROUP BY root", "vnet", last=_flood("vnet")))
def _(spark, d):
    return roads.network_components(roads.lines_to_edges(P.lines(spark, d), vehicular_only=True))


@query("Q22_network_health", sql("SELECT (SELECT count(*) FROM vnet) AS edges, sum(n)::BIGINT AS nodes, count(*) AS components, max(n) AS largest, round_even(max(n) * 100.0::DOUBLE / sum(n), 2) AS largest_pct FROM (SELECT count(*) AS n FROM flood0 GROUP BY root)", "vnet", last=_flood("vnet")))
def _(spark, d):
    return roads.network_health(roads.lines_to_edges(P.lines(spark, d), vehicular_only=True)).select("edges", "nodes", "components", "largest", "largest_pct")


@query("R4_terminals", sql("SELECT DISTINCT node FROM (SELECT u AS node FROM attributes WHERE is_arterial UNION ALL SELECT v FROM attributes WHERE is_arterial)", "attributes"))
def _(spark, d):
    return roads.terminal_nodes(roads.road_attributes(fx.road(spark, d)))


_SETS = "SELECT 'a' AS set, u AS node FROM mixed WHERE u % 211 = 0 UNION SELECT 'b', u FROM mixed WHERE u % 500 = 1 UNION SELECT 'c', u FROM mixed WHERE u = (SELECT min(u) FROM mixed)"


def _paths(spark: SparkSession, d: str, **how) -> DataFrame:
    edges = _mixed(spark, d)
    least = edges.agg(F.min("u").alias("node"))
    some = lambda name, c: edges.where(c).select(F.lit(name).alias("set"), F.col("u").alias("node"))
    starts = some("a", "u % 211 = 0").unionByName(some("b", "u % 500 = 1")).unionByName(least.select(F.lit("c").alias("set"), "node")).distinct()
    return roads.shortest_paths(edges, starts, ["length_m", "minutes"], **how).select("set", "weight", "node", F.round("dist", 6).alias("dist"))


@query("R5_shortest_paths", sql("SELECT set, weight, node, round(dist, 6) AS dist FROM paths", "mixed", last=paths("mixed", _SETS)))
def _(spark, d):
    return _paths(spark, d)


@query("R5_paths_by_parts", sql("SELECT set, weight, node, round(dist, 6) AS dist FROM paths", "mixed", last=paths("mixed", _SETS)))
def _(spark, d):
    """However small the network, cut into parts of 400 nodes."""
    return _paths(spark, d, local_edges=0, part_nodes=400)


@query("R3_components_by_joins", sql("SELECT root AS component, count(*) AS nodes FROM flood0 GROUP BY root", "vnet", last=_flood("vnet")))
def _(spark, d):
    return roads.network_components(roads.lines_to_edges(P.lines(spark, d), vehicular_only=True), local_edges=0)


@query("R7_pair_path", sql("SELECT count(*) > 0 AS connected, round(min(dist), 6) AS dist FROM paths WHERE node = (SELECT max(v) FROM mixed)", "mixed", last=paths("mixed", "SELECT 'pair' AS set, (SELECT min(u) FROM mixed) AS node", ("length_m",))))
def _(spark, d):
    edges = _mixed(spark, d)
    a, b = edges.agg(F.min("u"), F.max("v")).first()
    return roads.pair_path(edges, a, b).select("connected", F.round("dist", 6).alias("dist"))


_SNAP = "SELECT v.village_id, arg_min(n.node, {{'d': (v.x - n.x) * (v.x - n.x) + (v.y - n.y) * (v.y - n.y), 'i': n.node}}) AS node, sqrt(min((v.x - n.x) * (v.x - n.x) + (v.y - n.y) * (v.y - n.y))) AS snap_m FROM village v CROSS JOIN {0} n GROUP BY v.village_id"


@query("J11_snap", sql("SELECT village_id, node, round(snap_m, 4) AS snap_m FROM (" + _SNAP.format("vnet_node") + ")", "village", "vnet_node"))
def _(spark, d):
    edges = roads.lines_to_edges(P.lines(spark, d), vehicular_only=True)
    return roads.snap(_villages(spark, d), edges, "village_id").select("village_id", "node", F.round("snap_m", 4).alias("snap_m"))


_TO = "CASE WHEN s.dx * s.dx + s.dy * s.dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((v.x - s.x) * s.dx + (v.y - s.y) * s.dy) / (s.dx * s.dx + s.dy * s.dy))) ELSE 0.0 END"
_NEAREST_ROAD = f"SELECT village_id, round_even(min(sqrt((vx - (x + t * dx)) * (vx - (x + t * dx)) + (vy - (y + t * dy)) * (vy - (y + t * dy)))), 1) AS dist_to_nearest_road_m FROM (SELECT v.village_id, v.x AS vx, v.y AS vy, s.*, {_TO} AS t FROM village v CROSS JOIN (SELECT *, x2 - x AS dx, y2 - y AS dy FROM segs) s) GROUP BY village_id"


@query("J8_nearest_road", sql(_NEAREST_ROAD, "village", "segs"))
def _(spark, d):
    return roads.nearest_road(_villages(spark, d), P.lines(spark, d), "village_id").select("village_id", "dist_to_nearest_road_m")


_ARTERIES = paths("vnet", "SELECT 'arterial' AS set, u AS node FROM vnet WHERE is_arterial UNION SELECT 'arterial', v FROM vnet WHERE is_arterial")
_ROADS = f"SELECT village_id, round_even(snap_m, 1) AS road_snapping_distance_m, ok AS network_route_exists, CASE WHEN ok THEN m END AS network_distance_to_arterial_m, CASE WHEN ok THEN t END AS network_travel_time_to_arterial_min, {_ROAD_CATEGORY.format(s='snap_m', m='t')} AS road_accessibility_category FROM (SELECT s.*, round_even(a.dist, 1) AS m, round_even(b.dist, 1) AS t, s.snap_m <= 3000 AND b.dist IS NOT NULL AS ok FROM ({_SNAP.format('vnet_node')}) s LEFT JOIN (SELECT * FROM paths WHERE weight = 'length_m') a ON a.node = s.node LEFT JOIN (SELECT * FROM paths WHERE weight = 'minutes') b ON b.node = s.node)"
_ROAD_NAMES = ["village_id", "road_snapping_distance_m", "network_route_exists", "network_distance_to_arterial_m", "network_travel_time_to_arterial_min", "road_accessibility_category"]


@query("R8_C7_road_access", sql(_ROADS, "village", "vnet", "vnet_node", last=_ARTERIES))
def _(spark, d):
    return P.village_roads(spark, d).select(*_ROAD_NAMES)


_CELL_ROAD = """
span AS (
    SELECT c.area_id, s.x - (k.col + 0.5::DOUBLE) * 30 AS p, s.y + (k.row + 0.5::DOUBLE) * 30 AS q, s.x2 - s.x AS e, s.y2 - s.y AS f
    FROM area_cells k JOIN cand c USING (zone) CROSS JOIN segs s
),
clip AS (
    SELECT *, CASE WHEN e = 0 THEN CASE WHEN abs(p) <= 15 THEN 0 ELSE 2 END ELSE least((-15 - p) / e, (15 - p) / e) END AS x0,
           CASE WHEN e = 0 THEN 1 ELSE greatest((-15 - p) / e, (15 - p) / e) END AS x1,
           CASE WHEN f = 0 THEN CASE WHEN abs(q) <= 15 THEN 0 ELSE 2 END ELSE least((-15 - q) / f, (15 - q) / f) END AS y0,
           CASE WHEN f = 0 THEN 1 ELSE greatest((-15 - q) / f, (15 - q) / f) END AS y1
    FROM span
),
corner AS (SELECT *, unnest([-15, -15, 15, 15]) AS a, unnest([-15, 15, -15, 15]) AS b FROM clip),
along AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((a - p) * e + (b - q) * f) / (e * e + f * f))) AS t FROM corner),
area_road AS (
    SELECT area_id, round_even(min(CASE WHEN greatest(0, x0, y0) <= least(1, x1, y1) THEN 0 ELSE least(
        sqrt((a - p - t * e) * (a - p - t * e) + (b - q - t * f) * (b - q - t * f)),
        sqrt(greatest(abs(p) - 15, 0) ** 2 + greatest(abs(q) - 15, 0) ** 2), sqrt(greatest(abs(p + e) - 15, 0) ** 2 + greatest(abs(q + f) - 15, 0) ** 2)) END), 1) AS dist_to_nearest_road_m
    FROM along GROUP BY area_id
)
"""
_AREA_ROADS = _ROADS.replace("village_id", "area_id").replace("FROM village v", "FROM cand v")


@query("J8_C7_area_roads", sql("SELECT * FROM (" + _AREA_ROADS + ") JOIN area_road USING (area_id)", "cand", "segs", "vnet", "vnet_node", last=_ARTERIES + "," + _CELL_ROAD))
def _(spark, d):
    return P.area_roads(spark, d).select("area_id", *_ROAD_NAMES[1:], "dist_to_nearest_road_m")


@query("A13_area_records", sql(f"SELECT area_id, round_even(area_m2 / 10000, 4) AS area_hectares, mean_slope, {_SLOPES} AS slope_context, hazard_distance_m, nearest_village_pop, estimated_household_capacity, r.road_accessibility_category FROM (SELECT *, {_CAP} FROM cand) JOIN cand_near USING (area_id) JOIN cand_home USING (area_id) JOIN ({_AREA_ROADS}) r USING (area_id)", "cand", "cand_near", "cand_home", "vnet", "vnet_node", last=_ARTERIES))
def _(spark, d):
    return P.area_report(spark, d).select("area_id", "area_hectares", "mean_slope", "slope_context", "hazard_distance_m", "nearest_village_pop", "estimated_household_capacity", "road_accessibility_category")


_MEASURES = ["road_snapping_distance_m", "network_travel_time_to_arterial_min"]


@query("A24_distance_quantiles", sql(" UNION ALL ".join(f"SELECT '{c}' AS measure, count(*) AS total, count({c}) AS n, round_even(min({c}), 3) AS min, round_even(quantile_cont({c}, 0.25), 3) AS p25, round_even(median({c}), 3) AS median, round_even(quantile_cont({c}, 0.75), 3) AS p75, round_even(max({c}), 3) AS max FROM ({_ROADS})" for c in _MEASURES), "village", "vnet", "vnet_node", last=_ARTERIES))
def _(spark, d):
    return summaries.distance_quantiles(staged(P.village_roads(spark, d), "village-roads"), _MEASURES)


@query("A18_access_summary", sql("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE road_accessibility_category = '{c}') AS {c.lower()}" for c in S.ROAD_CATEGORIES) + f", round_even(avg(network_travel_time_to_arterial_min), 1) AS mean_travel_time_to_arterial_min, count(*) FILTER (WHERE road_accessibility_category IN ('ISOLATED_GRAPH_DISCONNECTED', 'SEVERELY_REMOTE')) AS isolated FROM ({_ROADS})", "village", "vnet", "vnet_node", last=_ARTERIES))
def _(spark, d):
    return roads.access_summary(P.village_roads(spark, d)).drop("mean_dist_to_nearest_road_m")


@query("A24_snap_bands", sql(f"SELECT b.band, count(x.m) AS n, round_even(coalesce(100.0::DOUBLE * count(x.m) / nullif(sum(count(x.m)) OVER (), 0), 0), 1) AS pct FROM (VALUES ('<= 500'), ('500 - 1000'), ('1000 - 1500'), ('1500 - 3000'), ('> 3000')) b(band) LEFT JOIN (SELECT round_even(snap_m, 1) AS m, CASE WHEN round_even(snap_m, 1) <= 500 THEN '<= 500' WHEN round_even(snap_m, 1) <= 1000 THEN '500 - 1000' WHEN round_even(snap_m, 1) <= 1500 THEN '1000 - 1500' WHEN round_even(snap_m, 1) <= 3000 THEN '1500 - 3000' ELSE '> 3000' END AS band FROM ({_SNAP.format('vnet_node')})) x USING (band) GROUP BY b.band", "village", "vnet_node"))
def _(spark, d):
    snapped = roads.snap(_villages(spark, d), roads.lines_to_edges(P.lines(spark, d), vehicular_only=True), "village_id")
    return summaries.band_shares(snapped.select(F.bround("snap_m", 1).alias("m")), "m", [500, 1000, 1500, 3000])


@query("A25_F20_boundary_band", sql(f"SELECT road_accessibility_category, count(*) AS n FROM ({_ROADS}) WHERE road_snapping_distance_m BETWEEN 400 AND 1600 GROUP BY 1", "village", "vnet", "vnet_node", last=_ARTERIES))
def _(spark, d):
    return views.in_band(P.village_roads(spark, d), "road_snapping_distance_m", 400.0, 1600.0).groupBy("road_accessibility_category").agg(F.count("*").alias("n"))


@query("F16_arterial", sql("SELECT u, v FROM attributes WHERE is_arterial", "attributes"))
def _(spark, d):
    return views.arterial(roads.road_attributes(fx.road(spark, d))).select("u", "v")


# Facilities


@query("P24_facility_classes", sql("SELECT id, k.kind AS facility_broad_type, k.category AS facility_category, k.evidenced AS explicitly_evidenced_emergency_capability, k.receiver AS potential_emergency_receiving_facility, k.trigger AS classification_trigger FROM kinds", "kinds"))
def _(spark, d):
    return fx.tags(spark, d).select("id", F.inline(F.array(fac.classify_facility())))


_SIMPLE = "CASE WHEN contains(am, 'hospital') OR contains(hc, 'hospital') OR contains(nm, 'hospital') THEN 'HEALTHCARE_HOSPITAL' WHEN contains(nm, 'chc') OR contains(nm, 'community health') THEN 'HEALTHCARE_CHC' WHEN contains(nm, 'phc') OR contains(nm, 'primary health') THEN 'HEALTHCARE_PHC' WHEN contains(nm, 'subcentre') OR contains(nm, 'sub-centre') OR contains(nm, 'sub centre') THEN 'HEALTHCARE_SUBCENTRE' WHEN contains(am, 'clinic') OR contains(hc, 'clinic') OR contains(am, 'doctors') OR contains(nm, 'dispensary') OR hc = 'centre' THEN 'HEALTHCARE_CLINIC_OR_CENTRE' WHEN contains(am, 'pharmacy') THEN 'HEALTHCARE_PHARMACY' WHEN am = 'school' OR contains(nm, 'school') OR contains(nm, 'vidyalaya') OR contains(nm, 'inter college') THEN 'EDUCATION_SCHOOL' WHEN am = 'college' OR contains(nm, 'college') OR contains(nm, 'polytechnic') OR contains(nm, 'iti') THEN 'EDUCATION_HIGHER' WHEN am = 'university' OR contains(nm, 'university') THEN 'EDUCATION_UNIVERSITY' WHEN am = 'kindergarten' OR contains(nm, 'anganwadi') THEN 'EDUCATION_KINDERGARTEN' WHEN am = 'police' OR contains(nm, 'police') OR contains(nm, 'thana') OR contains(nm, 'chowki') THEN 'EMERGENCY_POLICE' WHEN am = 'fire_station' OR contains(nm, 'fire') THEN 'EMERGENCY_FIRE_STATION' WHEN am IN ('townhall', 'community_centre') OR contains(nm, 'panchayat') OR contains(nm, 'milan kendra') THEN 'CIVIC_COMMUNITY_CENTRE' ELSE 'OTHER_CIVIC_FACILITY' END"


@query("P25_simple_classes", sql(f"SELECT id, {_SIMPLE} AS facility_category FROM kinds", "kinds"))
def _(spark, d):
    return fx.tags(spark, d).select("id", fac.simple_category().alias("facility_category"))


@query("W3_facility_ids", sql("SELECT id, facility_id FROM place", "place"))
def _(spark, d):
    return P.mapped_facilities(spark, d).select("id", "facility_id")


@query("A19_facility_counts", sql("SELECT 'type' AS grouping, k.kind AS value, count(*) AS n FROM kinds GROUP BY 2 UNION ALL SELECT 'category', k.category, count(*) FROM kinds GROUP BY 2 UNION ALL SELECT 'emergency', 'evidenced', count(*) FROM kinds WHERE k.evidenced UNION ALL SELECT 'emergency', 'potential_receiver', count(*) FROM kinds WHERE k.receiver", "kinds"))
def _(spark, d):
    return fac.facility_counts(fac.classified(fx.tags(spark, d), "id"))


@query("F13_F15_facility_filters", sql("SELECT id FROM kinds WHERE upper(k.kind) = 'HEALTHCARE' AND (k.evidenced OR k.receiver) AND x BETWEEN 500 AND 2500 AND y BETWEEN -4000 AND -500", "kinds"))
def _(spark, d):
    some = views.emergency_capable(views.same_text(fac.classified(fx.tags(spark, d), "id"), "facility_broad_type", "healthcare"))
    return views.in_box(views.located(some), (500.0, -4000.0, 2500.0, -500.0)).select("id")


_SET_OF = {"health": "facility_broad_type = 'HEALTHCARE'", "hospital": "facility_category IN ('HEALTHCARE_HOSPITAL', 'HEALTHCARE_CHC')", "phc": "facility_category = 'HEALTHCARE_PHC'", "school": "facility_broad_type = 'EDUCATION'", "emergency": "facility_broad_type = 'EMERGENCY'"}
_FAC_NEAR = "SELECT v.village_id, " + ", ".join(f"round_even(sqrt(min(d) FILTER (WHERE {c})), 1) AS {n}_m, arg_min(facility_id, {{'d': d, 'i': facility_id}}) FILTER (WHERE {c}) AS {n}_id" for n, c in _SET_OF.items()) + " FROM village v CROSS JOIN place p CROSS JOIN LATERAL (SELECT (v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) AS d) GROUP BY v.village_id"


@query("J10_nearest_facilities", sql(_FAC_NEAR, "village", "place"))
def _(spark, d):
    return fac.nearest_facilities(_villages(spark, d), P.mapped_facilities(spark, d), "village_id").select("village_id", *[f"{n}_{k}" for n in _SET_OF for k in ("m", "id")])


_STARTS = " UNION ".join(f"SELECT '{n}' AS set, arg_min(n.node, {{'d': (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), 'i': n.node}}) AS node FROM place p CROSS JOIN net_node n WHERE {_SET_OF[n]} GROUP BY p.facility_id" for n in ("health", "hospital", "school"))
_PATH = lambda n, w: f"(SELECT node, dist FROM paths WHERE set = '{n}' AND weight = '{w}')"
_ACCESS = "SELECT s.village_id, " + ", ".join(f"CASE WHEN snap_m <= 3000 THEN round_even({n}a.dist + snap_m, 1) END AS network_{n}_m, CASE WHEN snap_m <= 3000 THEN round_even({n}b.dist + snap_m / 1000 / 4.0 * 60, 1) END AS network_{n}_min" for n in ("health", "hospital", "school")) + f" FROM ({_SNAP.format('net_node')}) s " + " ".join(f"LEFT JOIN {_PATH(n, 'length_m')} {n}a ON {n}a.node = s.node LEFT JOIN {_PATH(n, 'minutes')} {n}b ON {n}b.node = s.node" for n in ("health", "hospital", "school"))
_FLAGGED = f"SELECT *, coalesce(health_m <= 5000, false) AS has_health_within_5km, coalesce(school_m <= 3000, false) AS has_school_within_3km, coalesce(network_hospital_min <= 60, false) AS hospital_under_60min FROM ({_ACCESS}) JOIN ({_FAC_NEAR}) USING (village_id)"
_FAC_PATHS = paths("net", _STARTS)


@query("P28_P29_access", sql(f"SELECT village_id, network_health_m, network_health_min, network_hospital_m, network_hospital_min, network_school_m, network_school_min, has_health_within_5km, has_school_within_3km, hospital_under_60min FROM ({_FLAGGED})", "village", "place", "net", "net_node", last=_FAC_PATHS))
def _(spark, d):
    return P.village_facilities(spark, d).select("village_id", *[f"network_{n}_{k}" for n in fac.ROUTED for k in ("m", "min")], "has_health_within_5km", "has_school_within_3km", "hospital_under_60min")


@query("A20_C8_facility_summary", sql("SELECT count(*) AS total, " + ", ".join(f"round_even(avg({n}_m), 1) AS mean_{n}_m" for n in ("health", "hospital", "school")) + f", count(*) FILTER (WHERE has_health_within_5km) AS has_health_within_5km, count(*) FILTER (WHERE has_school_within_3km) AS has_school_within_3km, count(*) FILTER (WHERE hospital_under_60min) AS hospital_under_60min FROM ({_FLAGGED})", "village", "place", "net", "net_node", last=_FAC_PATHS))
def _(spark, d):
    return fac.access_summary(P.village_facilities(spark, d))


# Aggregates, sets, views


@query("A1_layer_stats", sql("SELECT count(score) AS n, min(score) AS lo, max(score) AS hi, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM overlay", "overlay"))
def _(spark, d):
    return T.layer_stats(_overlay(spark, d), "score")


@query("A2_percentiles", sql("SELECT " + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM overlay", "overlay"))
def _(spark, d):
    return T.percentiles(_overlay(spark, d), "score", [10, 25, 50, 75, 90, 95, 99])


@query("A3_dominance", sql("SELECT count(*) FILTER (WHERE ct - cf > 1e-5) AS terrain, count(*) FILTER (WHERE cf - ct > 1e-5) AS flood, count(*) FILTER (WHERE abs(ct - cf) <= 1e-5) AS equal, round(avg(ct) * 100 / avg(score), 4) AS terrain_pct, round(avg(cf) * 100 / avg(score), 4) AS flood_pct FROM overlay", "overlay"))
def _(spark, d):
    return summaries.dominance(_overlay(spark, d))


@query("A6_A7_exposure_bands", sql(f"SELECT b.band, count(a.area_id) AS n, coalesce(sum(a.area_id), 0) AS ids, round_even(coalesce(100.0::DOUBLE * count(a.area_id) / sum(count(a.area_id)) OVER (), 0), 2) AS n_pct FROM {_BANDS} LEFT JOIN (SELECT *, {BAND.format('false', 'hazard_distance_m')} AS band FROM area) a USING (band) GROUP BY b.band", "area"))
def _(spark, d):
    banded = fx.area(spark, d).withColumn("band", S.proximity_band(F.lit(False), F.col("hazard_distance_m")))
    return T.banded_totals(banded, "band", S.BAND_ORDER, {"ids": "area_id"}).select("band", "n", "ids", "n_pct")


@query("A8_distance_stats", sql("SELECT min(hazard_distance_m) AS lo, max(hazard_distance_m) AS hi, round(avg(hazard_distance_m), 6) AS mean, round(median(hazard_distance_m), 6) AS median FROM area", "area"))
def _(spark, d):
    return summaries.distance_stats(fx.area(spark, d), "hazard_distance_m")


@query("A28_layer_profile", sql("SELECT count(*) AS cells, count(*) - count(elev) AS nodata, 0::BIGINT AS nan, 0::BIGINT AS infinite, count(elev) AS valid, round_even(count(elev) * 100.0::DOUBLE / count(*), 2) AS coverage_pct, min(elev) AS lo, max(elev) AS hi, round(avg(elev), 6) AS mean, round(stddev_pop(elev), 6) AS std, count(*) FILTER (WHERE elev < 5) AS below, count(*) FILTER (WHERE elev > 40) AS above FROM g_dem", "g_dem"))
def _(spark, d):
    return summaries.layer_profile(fx.g_dem(spark, d), "elev", 5.0, 40.0)


@query("A29_class_scores", sql(f"SELECT {CLASS.format('score')} AS class, count(*) AS cells, min(score) AS lo, max(score) AS hi, round(avg(score), 6) AS mean FROM overlay GROUP BY 1", "overlay"))
def _(spark, d):
    return summaries.class_scores(_overlay(spark, d).withColumn("class", S.classify(F.col("score"))), "class", "score")


@query("P3_bilinear", sql("SELECT row, col, round(sum(w * v) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0), 4) AS elev FROM (SELECT t.row, t.col, (1 - abs(t.y - (floor(t.y) + k.i))) * (1 - abs(t.x - (floor(t.x) + k.j))) AS w, g.elev AS v FROM (SELECT r.r AS row, c.c AS col, (r.r + 0.5::DOUBLE) * 45 / 30 - 0.5 AS y, (c.c + 0.5::DOUBLE) * 45 / 30 - 0.5 AS x FROM (SELECT unnest(range(0, 40)) AS r) r, (SELECT unnest(range(0, 60)) AS c) c) t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) LEFT JOIN g_dem g ON g.row = floor(t.y) + k.i AND g.col = floor(t.x) + k.j) GROUP BY row, col", "g_dem"))
def _(spark, d):
    return grid.resample(fx.g_dem(spark, d), "elev", 40, 60, 45.0, fx.CELL).select("row", "col", F.round("elev", 4).alias("elev"))


@query("P4_nearest_resample", sql("SELECT r.r AS row, c.c AS col, g.code FROM (SELECT unnest(range(0, 40)) AS r) r CROSS JOIN (SELECT unnest(range(0, 60)) AS c) c LEFT JOIN g_lulc g ON g.row = floor((r.r + 0.5::DOUBLE) * 45 / 30) AND g.col = floor((c.c + 0.5::DOUBLE) * 45 / 30)", "g_lulc"))
def _(spark, d):
    return grid.resample(fx.g_lulc(spark, d), "code", 40, 60, 45.0, fx.CELL, "nearest").select("row", "col", "code")


_DIAMOND = "SELECT DISTINCT g.row, g.col FROM g_lulc g CROSS JOIN facility f WHERE abs((g.col + 0.5::DOUBLE) * 30 - f.x) + abs(-(g.row + 0.5::DOUBLE) * 30 - f.y) < 100.125 AND abs((g.col + 0.5::DOUBLE) * 30 - f.x) + abs(-(g.row + 0.5::DOUBLE) * 30 - f.y) > 40.125"


@query("J19_J20_protected", sql(f"SELECT count(*) * 0.09::DOUBLE AS extent_ha, (SELECT count(*) FROM ({_DIAMOND})) * 0.09::DOUBLE AS overlap_ha, round_even(100.0::DOUBLE * (SELECT count(*) FROM ({_DIAMOND})) / count(*), 4) AS overlap_pct FROM g_lulc", "g_lulc", "facility"))
def _(spark, d):
    return spatial.covered_share(fx.g_lulc(spark, d), spatial.rasterise(fx.protected(spark, d), "area_id"))


@query("C10_protected_cover", sql(f"SELECT excluded, count(*) AS cells FROM (SELECT CASE WHEN g.valid THEN CAST(g.code IN (10, 50, 70, 80, 90) OR p.row IS NOT NULL AS INT) END AS excluded FROM g_lulc g LEFT JOIN ({_DIAMOND}) p USING (row, col)) GROUP BY 1", "g_lulc", "facility"))
def _(spark, d):
    return P.protected_cover(spark, d).groupBy("excluded").agg(F.count("*").alias("cells"))


@query("J13_co_registration", sql("SELECT s.row, s.col, s.terrain, s.flood FROM scores s", "scores"))
def _(spark, d):
    s = fx.scores(spark, d)
    return spatial.co_registered({n: s.select("row", "col", F.col(n).alias("value")) for n in ("terrain", "flood")})


@query("J3_J21_named_stats", sql("SELECT t.village_id, c.tot_p, i.n AS incidents FROM centroid t LEFT JOIN census c USING (village_id) LEFT JOIN (SELECT event_id AS village_id, count(*) AS n FROM incident GROUP BY 1) i USING (village_id)", "centroid", "census", "incident"))
def _(spark, d):
    counts = fx.incident(spark, d).groupBy(F.col("event_id").alias("village_id")).agg(F.count("*").alias("incidents"))
    return fx.centroid(spark, d).select("village_id").join(fx.census(spark, d).select("village_id", "tot_p"), "village_id", "left").join(counts, "village_id", "left")


@query("P34_ground_spacing", sql("SELECT village_id, round(111320.0::DOUBLE * cos(radians(30.0::DOUBLE - y / 4500)), 6) AS metres FROM centroid", "centroid"))
def _(spark, d):
    return fx.centroid(spark, d).select("village_id", F.round(S.metres_per_degree_lon(30.0 - F.col("y") / 4500), 6).alias("metres"))


@query("F2_F18_key_filters", sql("SELECT village_id, name FROM centroid WHERE subdist = 7 UNION ALL SELECT village_id, name FROM centroid WHERE village_id = 11", "centroid"))
def _(spark, d):
    c = fx.centroid(spark, d).select("village_id", "name", "subdist")
    return views.by_keys(c, {"subdist": 7}).unionByName(views.by_keys(c, {"village_id": 11})).select("village_id", "name")


@query("F3_F4_point_box", sql("SELECT event_id FROM incident WHERE date IS NOT NULL AND x BETWEEN 1000 AND 9000 AND y BETWEEN -20000 AND -3000", "incident"))
def _(spark, d):
    return views.in_box(views.located(fx.incident(spark, d), ("x", "date")), (1000.0, -20000.0, 9000.0, -3000.0)).select("event_id")


@query("F5_envelopes", sql("SELECT zone FROM (SELECT zone, min(col) * 30 AS xmin, max(col) * 30 + 30 AS xmax, -max(row) * 30 - 30 AS ymin, -min(row) * 30 AS ymax FROM zone_cells GROUP BY zone) WHERE xmax >= 300 AND xmin <= 900 AND ymax >= -1500 AND ymin <= -600", "zone_cells"))
def _(spark, d):
    z = P.zone_stats(_zone_cells(spark, d))
    c = fx.CELL
    boxed = z.select("zone", (F.col("min_col") * c).alias("xmin"), (F.col("max_col") * c + c).alias("xmax"), (-F.col("max_row") * c - c).alias("ymin"), (-F.col("min_row") * c).alias("ymax"))
    return views.meets_box(boxed, "300,-1500,900,-600").select("zone")


@query("F10_search", sql("SELECT village_id FROM census WHERE contains(lower(name), '77') OR contains(CAST(village_id AS VARCHAR), '77') OR contains(lower(level), '77')", "census"))
def _(spark, d):
    return views.search(fx.census(spark, d), " 77", ["name", "village_id", "level"]).select("village_id")


@query("F12_high_vulnerability", sql(f"SELECT village_id FROM rates WHERE {FLAG_COUNT} >= 2", "rates"))
def _(spark, d):
    return views.high_vulnerability(T.vulnerability(T.rates(fx.census(spark, d)))).select("village_id")


@query("F14_years", sql("SELECT event_id FROM incident WHERE year BETWEEN (SELECT min(year) FROM incident) AND (SELECT min(year) FROM incident) AND hazard_type = 'CLICK'", "incident"))
def _(spark, d):
    events = fx.incident(spark, d)
    first = events.agg(F.min("year")).first()[0]
    return views.same_text(views.in_years(events, first, first), "hazard_type", "click").select("event_id")


@query("L5_pages", sql("SELECT event_id, hazard_type FROM incident ORDER BY event_id LIMIT 50 OFFSET 100", "incident"))
def _(spark, d):
    return views.paged(fx.incident(spark, d), "event_id", 100, 50).select("event_id", "hazard_type")


@query("L4_area_counts", sql("SELECT count(*) AS total, count(*) FILTER (WHERE area_m2 >= 300000) AS filtered, least(500, count(*) FILTER (WHERE area_m2 >= 300000)) AS displayed FROM area", "area"))
def _(spark, d):
    return views.area_page(fx.area(spark, d), 0, 900, least_m2=300_000)[1]


@query("U5_distinct", sql("SELECT DISTINCT flag, hazard_distance_m > 5000 AS far FROM area", "area"))
def _(spark, d):
    return fx.area(spark, d).select("flag", (F.col("hazard_distance_m") > 5000).alias("far")).distinct()


@query("W5_keep_first", sql("SELECT hazard_type, provider, event_id FROM (SELECT *, row_number() OVER (PARTITION BY hazard_type, provider ORDER BY fatalities DESC NULLS LAST, event_id) AS n FROM incident) WHERE n = 1", "incident"))
def _(spark, d):
    events = fx.incident(spark, d).withColumn("k", F.struct("hazard_type", "provider"))
    return T.keep_first(events, "k", [F.desc_nulls_last("fatalities"), F.asc("event_id")]).select("hazard_type", "provider", "event_id")


@query("W7_exemplar_cells", sql("SELECT name, arg_min(row, {'r': row, 'c': col}) AS row, arg_min(col, {'r': row, 'c': col}) AS col, arg_min(score, {'r': row, 'c': col}) AS score FROM (SELECT 'high' AS name, * FROM overlay WHERE score >= 0.9 UNION ALL SELECT 'low', * FROM overlay WHERE score <= 0.1 UNION ALL SELECT 'flood', * FROM overlay WHERE cf > ct) GROUP BY name", "overlay"))
def _(spark, d):
    return grid.first_cells(_overlay(spark, d), {"high": F.col("score") >= 0.9, "low": F.col("score") <= 0.1, "flood": F.col("cf") > F.col("ct")}, ["score"])


@query("P35_P37_projection", sql("SELECT area_id AS \"Area\", flag AS \"Flag\", 'slope_max_deg=20; redzone_buffer_m=NOT_CONFIGURED' AS \"Basis\" FROM area", "area"))
def _(spark, d):
    twice = fx.area(spark, d).select("area_id", "flag", F.lit("x").alias("flag"), T.screening_basis({"slope_max_deg": 20, "redzone_buffer_m": None}).alias("basis"))
    return T.project(twice, {"Area": "area_id", "Flag": "flag", "Basis": "basis"})


@query("A27_duplicate_keys", sql("SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    return fx.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("A26_value_counts", sql("SELECT 'amenity' AS attr, CASE WHEN p_partkey % 4 = 0 THEN ['hospital', 'clinic', 'doctors', 'school', 'college', 'police', 'fire_station', 'community_centre', 'townhall'][p_size % 9 + 1] END AS value, count(*) AS n FROM part GROUP BY 2"))
def _(spark, d):
    return T.value_counts(fx.tags(spark, d), ["amenity"])


@query("A27_null_profile", sql("SELECT count(*) AS n, count(*) - count(date) AS date_nulls, count(*) - count(fatalities) AS fatalities_nulls, count(DISTINCT provider) AS providers FROM incident", "incident"))
def _(spark, d):
    return fx.incident(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("date").isNull()).alias("date_nulls"), F.count_if(F.col("fatalities").isNull()).alias("fatalities_nulls"), F.countDistinct("provider").alias("providers"))


@query("J1_validated_join", sql("SELECT village_id, name, tot_p, x, y FROM village", "village"))
def _(spark, d):
    return _villages(spark, d).select("village_id", "name", "tot_p", "x", "y")


@query("J2_status_join", sql("SELECT c.village_id, CASE WHEN t.village_id IS NULL THEN 'NOT_FOUND_IN_PCA' ELSE 'JOINED' END AS join_status FROM census c LEFT JOIN centroid t USING (village_id)", "census", "centroid"))
def _(spark, d):
    return T.status_join(fx.census(spark, d), fx.centroid(spark, d).select("village_id", "x"), "village_id").select("village_id", "join_status")


@query("J16_match_diagnostics", sql("SELECT count(*) AS total, count(t.village_id) AS matched, count(*) - count(t.village_id) AS unmatched, sum(tot_p) FILTER (WHERE t.village_id IS NULL) AS unmatched_population FROM census c LEFT JOIN centroid t USING (village_id)", "census", "centroid"))
def _(spark, d):
    s = T.status_join(fx.census(spark, d), fx.centroid(spark, d).select("village_id", "x"), "village_id")
    miss = F.col("join_status") == T.NOT_JOINED
    return s.agg(F.count("*").alias("total"), F.count_if(~miss).alias("matched"), F.count_if(miss).alias("unmatched"), F.sum(F.when(miss, F.col("tot_p"))).alias("unmatched_population"))


@query("U2_U3_key_sets", sql("SELECT 'both' AS side, count(*) AS n FROM (SELECT village_id FROM census INTERSECT SELECT village_id FROM centroid) UNION ALL SELECT 'left', count(*) FROM (SELECT village_id FROM census EXCEPT SELECT village_id FROM centroid) UNION ALL SELECT 'right', count(*) FROM (SELECT village_id FROM centroid EXCEPT SELECT village_id FROM census)", "census", "centroid"))
def _(spark, d):
    a, b = fx.census(spark, d).select("village_id"), fx.centroid(spark, d).select("village_id")
    return a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("left").alias("side"), F.count("*").alias("n"))).unionByName(b.subtract(a).agg(F.lit("right").alias("side"), F.count("*").alias("n")))


@query("U6_provider_sets", sql("SELECT hazard_type, string_agg(DISTINCT provider, ' + ' ORDER BY provider) AS providers FROM incident GROUP BY hazard_type", "incident"))
def _(spark, d):
    return fx.incident(spark, d).groupBy("hazard_type").agg(F.array_join(F.array_sort(F.collect_set("provider")), " + ").alias("providers"))


@query("F8_F17_filters", sql("SELECT area_id FROM area WHERE flag IN ('A', 'R') AND area_m2 BETWEEN 200000 AND 600000 AND hazard_distance_m <= 4000", "area"))
def _(spark, d):
    return fx.area(spark, d).where(F.col("flag").isin("A", "R") & F.col("area_m2").between(200000, 600000) & (F.col("hazard_distance_m") <= 4000)).select("area_id")


@query("F9_F19_text_filters", sql("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'g') AND (regexp_matches(lower(p_type), '(small|economy)') OR p_size IN (3, 5, 7))"))
def _(spark, d):
    t = views.name_contains(fx.read(spark, d, "part"), "G", "p_name")
    return t.where(F.lower("p_type").rlike("(small|economy)") | F.col("p_size").isin(3, 5, 7)).select("p_partkey")


@query("W2_L4_area_pages", sql("SELECT area_id, area_m2, rank FROM (SELECT *, row_number() OVER (ORDER BY area_m2 DESC, area_id) AS rank FROM area) WHERE rank BETWEEN 101 AND 200", "area"))
def _(spark, d):
    return T.page(fx.area(spark, d), [F.desc("area_m2"), F.asc("area_id")], 100, 100).select("area_id", "area_m2", "rank")


@query("W6_exemplars", sql("SELECT hazard_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY hazard_type ORDER BY event_id) AS n FROM incident) WHERE n <= 3", "incident"))
def _(spark, d):
    return fx.incident(spark, d).withColumn("n", F.row_number().over(W.partitionBy("hazard_type").orderBy("event_id"))).where("n <= 3").select("hazard_type", "event_id")


_CHECKS = {
    "unique_key": "SELECT count(*) = count(DISTINCT village_id) FROM census", "no_nulls": "SELECT count(*) = count(name) FROM census", "range": "SELECT bool_and(tot_p BETWEEN 0 AND 100000) FROM census", "subset": "SELECT bool_and(p_sc <= tot_p) FROM census",
    "allowed": "SELECT bool_and(level IN ('TOWN', 'VILLAGE')) FROM census", "pattern": "SELECT bool_and(regexp_matches(name, '^Customer#')) FROM census", "row_count": "SELECT count(*) >= 1 FROM census", "sums_agree": "SELECT sum(tot_p) = (SELECT sum(tot_p) FROM village) FROM census",
    "same_nulls": "SELECT count(*) FILTER (WHERE (terrain IS NULL) <> (flood IS NULL)) = 0 FROM scores", "no_infinite": "SELECT count(*) FILTER (WHERE isinf(score)) = 0 FROM overlay", "reconciles": "SELECT max(abs(ct + cf - score)) <= 1e-6 FROM overlay", "required_columns": "SELECT false",
}


@query("Q_suite", sql(" UNION ALL ".join(f"SELECT '{k}' AS check, ({v}) AS passed" for k, v in _CHECKS.items()), "census", "village", "scores", "overlay"))
def _(spark, d):
    Q, c, o = quality, fx.census(spark, d), _overlay(spark, d)
    checks = [Q.unique_key(c, "village_id"), Q.no_nulls(c, "name"), Q.value_range(c, "tot_p", 0, 100000), Q.subset(c, "p_sc", "tot_p"), Q.allowed(c, "level", ["TOWN", "VILLAGE"]), Q.pattern(c, "name", "^Customer#"), Q.row_count(c, 1)]
    checks += [Q.sums_agree(c, "tot_p", _villages(spark, d), "tot_p"), Q.same_nulls(fx.scores(spark, d), "terrain", "flood"), Q.no_infinite(o, "score"), Q.reconciles(o, ["ct", "cf"], "score"), Q.required_columns(c, ["village_id", "geometry"])]
    return Q.suite(checks).select("check", "passed")


def _rises(table: str, by: str, value: str) -> str:
    return (
        f"SELECT count(*) FILTER (WHERE lo < most - 1e-6) = 0 FROM (SELECT lo, max(hi) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most "
        f"FROM (SELECT {by} AS k, min({value}) AS lo, max({value}) AS hi FROM {table} WHERE {by} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1))"
    )


def _in_classes(by: str) -> str:
    return (
        f"SELECT coalesce(count(*) FILTER (WHERE lo < before) = 0, false) FROM (SELECT min(score) AS lo, lag(max(score)) OVER (ORDER BY c) AS before "
        f"FROM (SELECT {_CLASS.format(by)} AS c, score FROM overlay) WHERE c IS NOT NULL GROUP BY c)"
    )


def _one_extent(shift: int) -> str:
    extent = "SELECT min(row + {0}) AS a, max(row + {0}) AS b, min(col) AS c, max(col) AS d, count(*) AS n FROM {1}"
    return f"SELECT count(*) = 1 FROM ({extent.format(0, 'g_dem')} UNION {extent.format(shift, 'g_lulc')})"


def _ranked(score: str) -> str:
    return (
        "SELECT min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AND bool_and(s <= coalesce(before, s)) "
        f"FROM (SELECT rank, {score} AS s, lag({score}) OVER (ORDER BY rank) AS before FROM kept_zone)"
    )


def _faces(turn: int) -> str:
    aspect = f"CASE WHEN sqrt(gx * gx + gy * gy) < 1e-8 THEN -1.0 ELSE (90 - degrees(atan2(-gy, gx)) + 360) % 360 + {turn} END"
    return (
        "SELECT count(*) FILTER (WHERE NOT (a = -1 OR (a >= 0 AND a < 360)) OR (slope = 0 AND a <> -1)) = 0 "
        f"FROM (SELECT {aspect} AS a, slope FROM grad JOIN slope USING (row, col) WHERE grad.elev IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL)"
    )


def _people(method: str, where: str) -> str:
    return (
        f"SELECT contains('{method}', 'Exact code-based join') AND count(*) FILTER (WHERE tot_p IS NULL) = 0 "
        f"AND sum(tot_p) = (SELECT sum(tot_p) FROM census WHERE {where}) FROM village"
    )


_PLACED = "level = 'VILLAGE' AND village_id IN (SELECT village_id FROM centroid)"
_LAYER_CHECKS = {
    "monotone": _rises("slope", "slope", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, slope / 60.0::DOUBLE))"),
    "monotone, another layer": _rises("overlay", "score", "ct"),
    "classes_ordered": _in_classes("score"),
    "classes_ordered, another layer": _in_classes("terrain"),
    "same_grid": _one_extent(0),
    "same_grid, a row off": _one_extent(1),
    "all_classed": f"SELECT count(*) FILTER (WHERE score IS NOT NULL AND {_CLASS.format('score')} IS NULL) = 0 FROM overlay",
    "all_classed, the highest left out": "SELECT count(*) FILTER (WHERE score >= 0.65) = 0 FROM overlay",
    "at_least": "SELECT min(area_m2) >= 5000 FROM kept_zone",
    "no_class_3": "SELECT count(*) FILTER (WHERE hazard_class = 3 AND excluded = 0) = 0 FROM screen",
    "within_box": "SELECT bool_and(x BETWEEN 0 AND 3000 AND y BETWEEN -4500 AND 0) FROM village",
    "ranks_in_order": _ranked("mean_score"),
    "ranks_in_order, by area": _ranked("area_m2"),
    "aspect_valid": _faces(0),
    "aspect_valid, turned": _faces(200),
    "demographics": _people("Exact code-based join", _PLACED),
    "demographics, by name": _people("Name match", _PLACED),
    "demographics, with towns": _people("Exact code-based join", "true"),
    "network_connected": "SELECT max(n) * 100.0 / sum(n) >= 80 FROM (SELECT count(*) AS n FROM flood0 GROUP BY root)",
}


@query("Q_layers", sql(" UNION ALL ".join(f"SELECT '{k}' AS check, ({v}) AS passed" for k, v in _LAYER_CHECKS.items()), "kept_zone", "screen", "village", "vnet", last=_flood("vnet")))
def _(spark, d):
    """Every check on layers that it should pass, and (named so) on ones that it may not."""
    Q = quality
    dem, zones = fx.g_dem(spark, d), P.red_zones(spark, d)[0]
    o = _overlay(spark, d).withColumn("class", S.classify(F.col("score")))
    sloped = grid.slope(dem).withColumn("linear", S.linear_score(F.col("slope"), 0.0, 60.0))
    faced = grid.aspect(dem).join(sloped.select("row", "col", "slope"), ["row", "col"])
    open_cells = P.screened(spark, d)[0].where("excluded = 0")
    layer = lambda df, c, down=0: df.select((F.col("row") + down).alias("row"), "col", F.col(c).alias("value"))
    cover = fx.g_lulc(spark, d)
    census, at = fx.census(spark, d), _villages(spark, d).withColumn("join_method", F.lit(P.CODED))
    people = lambda df: df.agg(F.sum("tot_p")).first()[0]
    placed = people(census.where("level = 'VILLAGE'").join(fx.centroid(spark, d).select("village_id"), "village_id", "left_semi"))
    named = lambda check, of: check.withColumn("check", F.concat("check", F.lit(f", {of}")))
    checks = [Q.monotone(sloped, "slope", "linear"), named(Q.monotone(o, "score", "ct"), "another layer")]
    checks += [Q.classes_ordered(o, "class", "score"), named(Q.classes_ordered(o.withColumn("class", S.classify(F.col("terrain"))), "class", "score"), "another layer")]
    checks += [Q.same_grid(spatial.aligned({"dem": layer(dem, "elev"), "cover": layer(cover, "code")})), named(Q.same_grid(spatial.aligned({"dem": layer(dem, "elev"), "cover": layer(cover, "code", 1)})), "a row off")]
    checks += [Q.all_classed(o, "score", "class"), named(Q.all_classed(o.withColumn("class", F.when(F.col("score") < 0.65, F.col("class"))), "score", "class"), "the highest left out")]
    checks += [Q.at_least(zones, "area_m2", P.ZONE_M2), Q.none_of(open_cells, F.col("hazard_class") == 3, "no_class_3"), Q.within_box(at, (0.0, -4500.0, 3000.0, 0.0))]
    checks += [Q.ranks_in_order(zones, "rank", "mean_score"), named(Q.ranks_in_order(zones, "rank", "area_m2"), "by area")]
    checks += [Q.aspect_valid(faced), named(Q.aspect_valid(faced.withColumn("aspect", F.when(F.col("aspect") >= 0, F.col("aspect") + 200).otherwise(F.col("aspect")))), "turned")]
    checks += [Q.demographics_known(at, placed), named(Q.demographics_known(at.withColumn("join_method", F.lit("Name match")), placed), "by name"), named(Q.demographics_known(at, people(census)), "with towns")]
    checks += [Q.network_connected(roads.network_health(roads.lines_to_edges(P.lines(spark, d), vehicular_only=True)))]
    return Q.suite(checks).select("check", "passed")


@query("Q20_duplicate_pairs", sql("SELECT o AS of, (SELECT count(*) = 0 FROM st WHERE leader <> id AND id % o = 0) AS passed FROM (VALUES (1000000000), (2)) v(o)", "incident", last=_DEDUP))
def _(spark, d):
    """Merged events against their leaders' rows: as they are, and with the even ones' rows lost."""
    events = fx.incident(spark, d)
    pairs = staged(spatial.dedup_events(events, "event_id", "hazard_type"), "pairs")
    merged = spatial.merged_events(events, pairs, "event_id")
    lost = merged.withColumn("duplicates", F.filter("duplicates", lambda e: e["event"] % 2 != 0))
    checks = [quality.duplicates_documented(m, pairs, "event_id").select(F.lit(n).alias("of"), "passed") for n, m in ((1000000000, merged), (2, lost))]
    return quality.suite(checks)


@query("Q19_record_errors", sql("SELECT event_id, concat_ws('; ', CASE WHEN date IS NULL THEN 'missing required field: date' END, CASE WHEN fatalities IS NULL THEN 'missing required field: fatalities' END, CASE WHEN hazard_type NOT IN ('CLICK', 'VIEW', 'PURCHASE') THEN 'invalid hazard_type: ' || hazard_type END) AS errors FROM incident WHERE date IS NULL OR fatalities IS NULL OR hazard_type NOT IN ('CLICK', 'VIEW', 'PURCHASE')", "incident"))
def _(spark, d):
    bad = quality.record_errors(fx.incident(spark, d), "event_id", ["date", "fatalities"], {"hazard_type": ["CLICK", "VIEW", "PURCHASE"]})
    return bad.select("event_id", F.array_join("errors", "; ").alias("errors"))


def _utm_sql() -> str:
    """Eastings and northings by the same series, written out in SQL."""
    e = 2 * S._N**0.5 / (1 + S._N)
    wave = lambda f, g, terms: " + ".join(f"{c!r}::DOUBLE * {f}({2 * (k + 1)} * xi) * {g}({2 * (k + 1)} * eta)" for k, c in enumerate(terms))
    r = S._K0 * S._RADIUS
    return (
        "WITH g AS (SELECT village_id, radians(30.0::DOUBLE - y / 4500) AS phi, radians(79.0::DOUBLE + x / 1500 - 81) AS lam FROM centroid), "
        f"t AS (SELECT village_id, lam, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM g), "
        "u AS (SELECT village_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t) "
        f"SELECT village_id, round({S._FE}::DOUBLE + {r!r}::DOUBLE * (eta + {wave('cos', 'sinh', S._ALPHA)}), 3) AS easting, round({r!r}::DOUBLE * (xi + {wave('sin', 'cosh', S._ALPHA)}), 3) AS northing, round(79.0::DOUBLE + c.x / 1500, 7) AS lon, round(30.0::DOUBLE - c.y / 4500, 7) AS lat FROM u JOIN centroid c USING (village_id)"
    )


@query("P1_P2_projection_round_trip", sql("SELECT * FROM (" + _utm_sql() + ")", "centroid"))
def _(spark, d):
    x, y = S.to_utm(79.0 + F.col("x") / 1500, 30.0 - F.col("y") / 4500)
    lon, lat = S.from_utm(F.col("e"), F.col("n"))
    moved = fx.centroid(spark, d).select("village_id", x.alias("e"), y.alias("n"))
    return moved.select("village_id", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_NESTED = """
corner AS (
    SELECT facility_id AS area_id, r, cx + dx * r AS x, cy + dy * r AS y
    FROM (SELECT facility_id, x AS cx, y AS cy FROM facility), (VALUES (100.125), (40.125)) s(r), (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) o(dx, dy)
)
"""


@query("P2_nested_geometry", sql("SELECT area_id, count(*) AS corners, round(sum(79.0::DOUBLE + x / 1500), 6) AS lon, round(sum(30.0::DOUBLE - y / 4500), 6) AS lat FROM corner GROUP BY area_id", "facility", last=_NESTED))
def _(spark, d):
    """Polygons in degrees, sent to metres and back inside their arrays."""
    degrees = lambda x, y: (79.0 + x / 1500, 30.0 - y / 4500)
    rings = fx.protected(spark, d).groupBy("area_id").agg(F.collect_list("ring").alias("rings"))
    back = polygons.projected(polygons.projected(polygons.projected(rings, degrees), S.to_utm), S.from_utm)
    corners = back.select("area_id", F.explode("rings").alias("ring")).select("area_id", F.explode(F.slice("ring", 1, 4)).alias("p"))
    return corners.groupBy("area_id").agg(F.count("*").alias("corners"), F.round(F.sum("p.x"), 6).alias("lon"), F.round(F.sum("p.y"), 6).alias("lat"))


@query("S2_K1_geojson_round_trip", sql("SELECT facility_id, name, x, y FROM facility", "facility"))
def _(spark, d):
    path = _folder(spark, "facilities")
    io.write_geojson_points(fx.facility(spark, d), path, ["facility_id", "name"])
    return io.read_geojson_points(spark, path, "facility_id: bigint, name: string")


@query("K4_long_summary", sql("SELECT category, metric, value, round(100 * value / sum(value) OVER (PARTITION BY metric), 6) AS percentage FROM (SELECT flag AS category, 'area_id' AS metric, sum(area_id)::DOUBLE AS value FROM area GROUP BY 1 UNION ALL SELECT flag, 'mean_slope', sum(mean_slope)::DOUBLE FROM area GROUP BY 1)", "area"))
def _(spark, d):
    return io.long_summary(fx.area(spark, d), "flag", ["area_id", "mean_slope"])


@query("S8_U1_catalogues", sql("SELECT 'a' AS raw_catalog, event_id, fatalities, NULL AS provider FROM incident WHERE event_id % 2 = 0 UNION ALL SELECT 'b', event_id, NULL, provider FROM incident WHERE event_id % 2 = 1", "incident"))
def _(spark, d):
    both = fx.incident(spark, d)
    return io.union_catalogues({"a": both.where("event_id % 2 = 0").select("event_id", "fatalities"), "b": both.where("event_id % 2 = 1").select("event_id", "provider")}).select("raw_catalog", "event_id", "fatalities", "provider")


# Sources and sinks: what Spark writes of the tables, read back


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_layer", sql("SELECT row, col, elev FROM g_dem", "g_dem"))
def _(spark, d):
    path = _folder(spark, "layer")
    bad = F.when(F.col("col") % 2 == 0, -9999.0).otherwise(float("nan"))
    fx.g_dem(spark, d).withColumn("elev", F.coalesce("elev", bad)).write.parquet(path)
    return io.read_layer(spark, path, "elev", -9999.0)


@query("S3_map_points", sql("SELECT 'node/' || id AS osm_id, name, CASE WHEN id % 6 = 0 THEN NULL ELSE round(79.0 + x / 10000, 6) END AS lon FROM tags WHERE id % 6 <> 0", "tags"))
def _(spark, d):
    path = _folder(spark, "elements")
    pairs = [x for k in ("name", "amenity", "healthcare", "office", "building", "emergency") for x in (F.lit(k), F.col(k))]
    lon, lat = F.round(79.0 + F.col("x") / 10000, 6), F.round(30.0 - F.col("y") / 10000, 6)
    place = F.struct(F.when(F.col("id") % 2 == 0, lat).alias("lat"), F.when(F.col("id") % 2 == 0, lon).alias("lon"))
    center = F.when((F.col("id") % 2 == 1), F.struct(lat.alias("lat"), lon.alias("lon")))
    e = F.struct(F.lit("node").alias("type"), F.col("id"), F.when(F.col("id") % 6 != 0, place["lat"]).alias("lat"), F.when(F.col("id") % 6 != 0, place["lon"]).alias("lon"), center.alias("center"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("tags"))
    fx.tags(spark, d).groupBy(F.pmod("id", F.lit(16)).alias("part")).agg(F.collect_list(e).alias("elements")).select(F.to_json(F.struct("elements"))).write.text(path)  # a document for each sixteenth
    return io.element_points(io.read_map_elements(spark, path)).select("osm_id", "name", "lon")


@query("S4_S5_map_ways", sql("SELECT 'road' AS kind, seq AS id, CASE WHEN way = 'e' THEN 3 ELSE 2 END AS points FROM ways UNION ALL SELECT 'polygon', p_partkey, 4 FROM part UNION ALL SELECT 'point', 1000000000 + p_partkey * 3 + k.k, 1 FROM part, (VALUES (0), (1), (2)) k(k)", "ways"))
def _(spark, d):
    path = _folder(spark, "ways")
    none = lambda t: F.lit(None).cast(t)
    road = F.struct(F.lit("way").alias("type"), F.col("seq").alias("id"), none("double").alias("lat"), none("double").alias("lon"), F.create_map(F.lit("highway"), F.col("highway")).alias("tags"), F.transform("points", lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"))).alias("geometry"), none("array<bigint>").alias("nodes"))
    part = fx.read(spark, d, "part")
    corner = part.select(F.col("p_partkey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select((1_000_000_000 + F.col("p_partkey") * 3 + F.col("k")).alias("id"), F.col("p_partkey"), "k")
    node = F.struct(F.lit("node").alias("type"), "id", (F.col("k") * 1.0).alias("lat"), (F.col("p_partkey") * 1.0).alias("lon"), F.create_map(F.lit("place"), F.lit("hamlet")).alias("tags"), none("array<struct<lat: double, lon: double>>").alias("geometry"), none("array<bigint>").alias("nodes"))
    at = [1_000_000_000 + F.col("p_partkey") * 3 + k for k in (0, 1, 2, 0)]
    outline = F.struct(F.lit("way").alias("type"), F.col("p_partkey").alias("id"), none("double").alias("lat"), none("double").alias("lon"), F.create_map(F.lit("name"), F.col("p_name")).alias("tags"), none("array<struct<lat: double, lon: double>>").alias("geometry"), F.array(*at).alias("nodes"))
    rows = fx.ways(spark, d).select(road.alias("e")).unionByName(corner.select(node.alias("e"))).unionByName(part.select(outline.alias("e")))
    rows.select(F.to_json(F.struct(F.array("e").alias("elements")))).write.text(path)
    elements = io.read_map_elements(spark, path)
    lines = io.element_lines(elements).select(F.lit("road").alias("kind"), "id", F.size("points").alias("points"))
    return lines.unionByName(io.settlements(elements).select("kind", "id", F.size("points").alias("points")))


@query("S6_S7_tables", sql("SELECT village_id, name, level, tot_p FROM census", "census"))
def _(spark, d):
    path = _folder(spark, "census")
    io.write_csv(fx.census(spark, d).select("village_id", "name", "level", "tot_p"), path)
    return io.read_table(spark, path, "village_id bigint, name string, level string, tot_p bigint")


@query("S9_S10_columns", sql("SELECT village_id, tot_p, NULL::BIGINT AS main_work_p FROM census", "census"))
def _(spark, d):
    rows = T.require_columns(fx.census(spark, d), ["village_id", "tot_p"])
    return T.optional_columns(rows.select("village_id", "tot_p"), {"tot_p": "bigint", "main_work_p": "bigint"})


@query("K2_X1_refreshed_layer", sql("SELECT row, col, CASE WHEN row < 8 AND col < 8 THEN coalesce(elev, 0) + 1 ELSE elev END AS elev FROM g_dem", "g_dem"))
def _(spark, d):
    path = _folder(spark, "tiles")
    dem = fx.g_dem(spark, d)
    io.write_cells(dem, path, 8)
    io.refresh_cells(dem.where("row < 8 AND col < 8").withColumn("elev", F.coalesce("elev", F.lit(0.0)) + 1), path, 8)
    return spark.read.parquet(path).select("row", "col", "elev")


@query("K6_summary_document", sql("SELECT count(*) AS villages, sum(tot_p) AS population FROM census", "census"))
def _(spark, d):
    path = _folder(spark, "summary")
    io.write_json(io.summary_json(fx.census(spark, d), {"villages": F.count("*"), "population": F.sum("tot_p")}), path)
    return spark.read.json(path).select(F.from_json("value", "villages bigint, population bigint").alias("v")).select("v.*")
