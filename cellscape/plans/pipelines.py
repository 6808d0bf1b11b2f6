"""End-to-end pipelines (C1-C12) on the derived fixtures; the registered queries read their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape import fixtures as fx
from cellscape.components import staged
from cellscape.functions import scores as S
from cellscape.operators import facilities as facility_ops
from cellscape.operators import grid, quality, roads, spatial, summaries, tiles, views
from cellscape.operators import tables as T
from cellscape.operators.georef import GEOGRAPHIC, METRIC, Grid, Layer, co_registered, warp

CELL, CELL_M2 = fx.CELL, fx.CELL * fx.CELL
ZONE_M2, AREA_M2, SLOPE_MAX = 5_000.0, 2_700.0, 20.0
STEEP = 0.22
"""The terrain of the fixtures is gentle: its zones begin at a lower score."""


def overlay(spark: SparkSession, d: str) -> DataFrame:
    return T.weighted_overlay(fx.scores(spark, d), {"terrain": ("ct", 0.6), "flood": ("cf", 0.4)})


def elevation(spark: SparkSession, d: str) -> Layer:
    """The elevation as it comes: cells on a grid of degrees."""
    cells = fx.g_geo(spark, d)
    rows = cells.agg(F.max("row")).first()[0]
    x0, y0, dx, dy = fx.GEO
    return Layer(cells, Grid(x0, y0, dx, dy, 0 if rows is None else rows + 1, fx.GRID_COLS, GEOGRAPHIC))


def terrain(spark: SparkSession, d: str) -> Layer:
    """The elevation on the grid of metres."""
    given = elevation(spark, d)
    x0, y0, dx, dy = fx.GROUND
    made = warp(given, Grid(x0, y0, dx, dy, given.grid.rows, given.grid.cols, METRIC), "elev")
    return Layer(staged(made.cells, "terrain"), made.grid)


def hazard_classes(spark: SparkSession, d: str) -> DataFrame:
    """Elevation in degrees to a metric terrain, and from that one slope, flow, wetness, scores, overlay and class."""
    ground = terrain(spark, d)
    sloped = Layer(grid.slope(ground.cells).select("row", "col", "slope"), ground.grid)
    flow = Layer(tiles.flow_accumulation(grid.flow_direction(ground.cells)), ground.grid)
    wet = co_registered({"slope": sloped, "acc": flow}, {"slope": "slope", "acc": "acc"}).cells
    wet = wet.withColumn("twi", F.when(F.col("slope").isNotNull(), grid.wetness(F.col("acc").cast("double"), F.col("slope"))))
    scored = wet.withColumns({"terrain": S.linear_score(F.col("slope"), 0.0, 60.0), "flood": S.linear_score(F.col("twi"), 3.5, 13.5)})
    both = T.weighted_overlay(scored, {"terrain": ("ct", 0.6), "flood": ("cf", 0.4)})
    return both.withColumn("hazard_class", S.classify(F.col("score"))).select("row", "col", "slope", "acc", "twi", "terrain", "flood", "ct", "cf", "score", "hazard_class")


def zones_from_elevation(spark: SparkSession, d: str, least: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """C1 and C2 in one: ranked zones of the terrain's cells that score `least` or more, and their cells with the zone's rank."""
    cells = hazard_classes(spark, d).where(F.col("score") >= least).select("row", "col", "score", "ct", "cf")
    found = staged(grid.zones(staged(cells, "terrain-mask"), keep=["score", "ct", "cf"]), "terrain-zones")
    kept = staged(grid.rank_zones(grid.kept_zones(zone_stats(found), ZONE_M2)), "terrain-kept")
    return kept, grid.painted(found, kept)


def zone_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the highest class with their zone."""
    cells = overlay(spark, d).where("score >= 0.65").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "score", "ct", "cf")
    return grid.zones(staged(cells, "zone-mask"), keep=["score", "ct", "cf"])


def zone_stats(cells: DataFrame) -> DataFrame:
    return grid.zone_summary(cells, CELL_M2, {"score": "score", "ct": "terrain", "cf": "flood"})


def red_zones(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Kept zones with their ranks, and their cells with the zone's rank."""
    cells = staged(zone_cells(spark, d), "zone-cells")
    kept = staged(grid.rank_zones(grid.kept_zones(zone_stats(cells), ZONE_M2)), "red-zones")
    return kept, staged(grid.painted(cells, kept), "red-zone-cells")


def villages(spark: SparkSession, d: str) -> DataFrame:
    return T.join_one_to_one(views.by_keys(fx.census(spark, d), {"level": "VILLAGE"}), fx.centroid(spark, d).select("village_id", "x", "y"), "village_id")


def exposure(spark: SparkSession, d: str, zones: DataFrame | None = None) -> DataFrame:
    """Villages with the zone that they lie in, the nearest zone, its distance and the band."""
    zones = red_zones(spark, d)[1] if zones is None else zones
    at = staged(villages(spark, d), "villages")
    inside = spatial.points_in_zones(at, zones, "village_id").select("village_id", F.col("zone").alias("matched_zone"))
    near = spatial.nearest_zone(at, zones, "village_id").select("village_id", F.col("zone").alias("nearest_zone"), "distance_m")
    out = at.join(inside, "village_id", "left").join(near, "village_id", "left").withColumn("overlap", F.col("matched_zone").isNotNull())
    return out.withColumn("band", S.proximity_band(F.col("overlap"), F.col("distance_m")))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """C4: exposure with the class at the centroid, rates, flags, tier, its reason and rule, and horizon."""
    cells = overlay(spark, d).withColumn("hazard_class", S.classify(F.col("score"))).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "terrain", "flood", "score", "hazard_class")
    there = spatial.sample_cells(exposure(spark, d), cells, ["terrain", "flood", "score", "hazard_class"])
    there = there.withColumn("hazard_class", S.clean_class(F.col("hazard_class")))
    with_rates = T.vulnerability(T.rates(there))
    args = (F.col("overlap"), F.col("distance_m"), F.col("hazard_class"))
    tiered = with_rates.withColumns({"priority_tier": S.priority_tier(*args), "applied_rule": S.tier_rule(*args), "priority_reason": S.tier_reason(*args, F.col("nearest_zone"))})
    return views.labelled(T.relocation_horizon(tiered))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """The layers of the grid side by side: slope, scores, classes, land cover and zone."""
    zones = red_zones(spark, d)[1].select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "zone")
    scored = overlay(spark, d).withColumns({"hazard_class": S.classify(F.col("score")), "flood_class": S.classify(F.col("flood"))})
    sloped = grid.slope(fx.g_dem(spark, d)).select("row", "col", "slope")
    return scored.join(sloped, ["row", "col"]).join(T.ecological_mask(fx.g_lulc(spark, d)), ["row", "col"]).join(zones, ["row", "col"], "left")


def screened(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The layers with `excluded`, and the mask's log."""
    cells = staged(layers(spark, d), "layers")
    valid = F.col("slope").isNotNull() & F.col("score").isNotNull()
    rules = {
        "hazard_class_3": F.col("hazard_class") == 3, "flood_class_3": F.col("flood_class") == 3, "red_zone": F.col("zone").isNotNull(), "slope_max": F.col("slope") > SLOPE_MAX, "red_zone_buffer": None,
        "flood_class_2": None, "hazard_class_2": None, "elevation_max": None, "ecological": F.coalesce(F.col("excluded") == 1, F.lit(False)),
    }
    mask, log = T.exclusion_mask(cells.withColumnRenamed("excluded", "eco").withColumn("excluded", F.col("eco")), rules, valid)
    return mask, log


def area_cells(spark: SparkSession, d: str) -> DataFrame:
    open_ = screened(spark, d)[0].where("excluded = 0").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "slope", "terrain", "flood", "score", "code")
    return staged(grid.zones(staged(open_, "area-mask"), keep=["slope", "terrain", "flood", "score", "code"]), "area-cells")


CODED = "Exact code-based join"


def population_known(at: DataFrame, census: DataFrame) -> bool:
    """Q21: whether the villages' people may be told: they come by code, are never null and add up to those of the census rows meant."""
    expected = census.agg(F.sum("tot_p")).first()[0] or 0
    return quality.demographics_known(at, expected).first()["passed"]


def candidate_areas(spark: SparkSession, d: str, cells: DataFrame | None = None, join_method: str = CODED) -> DataFrame:
    """Areas of a mapping unit or more by size, with layer statistics, dominant land cover, nearest zone and nearest village.

    The nearest village's people are told only if the demographics gate (Q21) lets them, else null.
    """
    cells = area_cells(spark, d) if cells is None else cells
    stats = grid.zone_summary(cells, CELL_M2, {"slope": "slope", "terrain": "terrain", "flood": "flood", "score": "score"}, digits=4)
    ranked = T.row_numbers(grid.kept_zones(stats, AREA_M2), [F.desc("area_m2"), F.col("zone")])
    areas = ranked.withColumn("area_id", F.format_string("CA-%04d", "rank")).join(grid.majority(cells), "zone", "left").withColumn("dominant_land_cover", T.land_cover_name(F.col("dominant_code")))
    areas = staged(spatial.cell_centres(areas.withColumnsRenamed({"mean_row": "row", "mean_col": "col"})).drop("row", "col"), "areas")
    near = spatial.nearest_zone(areas, red_zones(spark, d)[1], "area_id").select("area_id", F.col("zone").alias("nearest_zone"), F.col("distance_m").alias("hazard_distance_m"))
    at = staged(villages(spark, d), "area-villages")
    placed = views.by_keys(fx.census(spark, d), {"level": "VILLAGE"}).join(fx.centroid(spark, d).select("village_id"), "village_id", "left_semi")
    told = population_known(at.withColumn("join_method", F.lit(join_method)), placed)
    home = spatial.nearest(areas, at if told else at.withColumn("tot_p", F.lit(None).cast(at.schema["tot_p"].dataType)), "area_id", "village_id", ["name", "tot_p"])
    home = home.select("area_id", F.col("village_id").alias("nearest_village"), F.col("name").alias("nearest_village_name"), F.col("tot_p").alias("nearest_village_pop"), F.col("distance_m").alias("nearest_village_m"))
    return areas.join(near, "area_id", "left").join(home, "area_id", "left")


def area_context(areas: DataFrame) -> DataFrame:
    """Contexts and capacity of areas."""
    basis = T.screening_basis({"slope_max_deg": SLOPE_MAX, "redzone_buffer_m": None, "exclude_flood_class_2": None, "minimum_area_m2": AREA_M2, "maximum_area_m2": None})
    told = areas.withColumns({
        "slope_context": S.slope_context(F.col("mean_slope")), "terrain_context": S.score_context(F.col("mean_terrain"), S.TERRAIN), "flood_context": S.score_context(F.col("mean_flood"), S.FLOOD),
        "hazard_buffer_context": S.hazard_buffer_context(F.col("hazard_distance_m")), "area_scale_context": S.area_scale(F.col("area_m2") / 10_000), "screening_basis": basis,
    })
    return T.capacity(told.withColumn("not_configured", S.token_count(F.col("screening_basis"), "NOT_CONFIGURED")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return roads.road_attributes(fx.ways(spark, d))


def village_roads(spark: SparkSession, d: str) -> DataFrame:
    """Villages with their roads and the way to the arterial network."""
    return roads.road_access(villages(spark, d), staged(lines(spark, d), "road-lines"), "village_id")


def area_roads(spark: SparkSession, d: str, cells: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """Candidate areas with the road nearest to their cells and the way from their centre to the arterial network."""
    cells = area_cells(spark, d) if cells is None else cells
    areas = staged(candidate_areas(spark, d, cells) if areas is None else areas, "road-areas")
    own = cells.join(areas.select("zone", "area_id"), "zone").select("area_id", "row", "col")
    return roads.road_access(areas, staged(lines(spark, d), "road-lines"), "area_id", staged(own, "road-area-cells"))


def area_report(spark: SparkSession, d: str) -> DataFrame:
    """The candidate areas' records."""
    cells = area_cells(spark, d)
    areas = staged(area_context(candidate_areas(spark, d, cells)), "report-areas")
    return summaries.area_records(areas, area_roads(spark, d, cells, areas))


def mapped_facilities(spark: SparkSession, d: str) -> DataFrame:
    """Classified facilities with their ids."""
    return staged(facility_ops.facility_ids(facility_ops.classified(fx.tags(spark, d), "id"), "id"), "facility-ids")


def village_facilities(spark: SparkSession, d: str) -> DataFrame:
    """Villages with their nearest facilities and the way to them."""
    edges = staged(roads.lines_to_edges(lines(spark, d)), "all-edges")
    return facility_ops.facility_access(villages(spark, d), mapped_facilities(spark, d), edges, "village_id")


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Incidents merged to leaders, with defaults, band and id."""
    events = fx.incident(spark, d)
    merged = spatial.merged_events(events, spatial.dedup_events(events, "event_id", "hazard_type"), "event_id")
    filled = merged.fillna({"fatalities": 0, "uncertainty_m": 100})
    return T.incident_ids(filled.withColumn("uncertainty_band", S.uncertainty_band(F.col("uncertainty_m"))))


GROUPS = {"mass": ["CLICK", "VIEW"], "flood": ["PURCHASE"]}
"""The event types that stand for mass movements and floods."""


def village_incidents(spark: SparkSession, d: str, incidents: DataFrame) -> DataFrame:
    """Villages with their nearest incident and the incidents within 1 and 2 km."""
    at = staged(villages(spark, d), "incident-villages")
    near = spatial.nearest(at, incidents, "village_id", "event_id", ["hazard_type", "year"])
    counts = spatial.within_radius(at, incidents, "village_id", {"n_1km": 1000.0, "n_2km": 2000.0}, {k: F.col("hazard_type").isin(v) for k, v in GROUPS.items()})
    near = near.select("village_id", F.col("event_id").alias("nearest_incident"), F.col("hazard_type").alias("nearest_hazard_type"), F.col("year").alias("nearest_year"), F.col("distance_m").alias("nearest_incident_m"))
    return near.join(counts.select("village_id", "n_1km", "n_2km", "n_2km_mass", "n_2km_flood"), "village_id")


def protected_cover(spark: SparkSession, d: str) -> DataFrame:
    """Land cover with the cells of the protected polygons."""
    cells = spatial.rasterise(fx.protected(spark, d), "area_id").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct().withColumn("_in", F.lit(True))
    cover = fx.g_lulc(spark, d).drop("protected").join(cells, ["row", "col"], "left").withColumn("protected", F.coalesce("_in", F.lit(False))).drop("_in")
    return T.ecological_mask(cover)


def decision(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    return summaries.decision_summary(profiles(spark, d), area_context(candidate_areas(spark, d)))
