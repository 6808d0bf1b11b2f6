"""Summaries: one row, or one a category, of exposure, zones, areas, incidents and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.components import staged
from cellscape.functions import scores as S
from cellscape.operators import tables as T

POPULATION = {"population": "tot_p", "households": "no_hh", "sc": "p_sc", "st": "p_st"}
# The hazard types counted together about a point.
MASS_MOVEMENT = ["LANDSLIDE", "DEBRIS_FLOW", "ROCKFALL"]
FLOOD_TYPES = ["CLOUDBURST", "FLASH_FLOOD", "RIVERINE_FLOOD"]


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 of nothing."""
    return F.bround(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def zone_totals(zones: DataFrame) -> DataFrame:
    """A4: one row: zones, total and mean area, mean score and contributions with their shares, largest, smallest and first zone."""
    share = lambda c: pct(F.avg(c), F.avg("mean_score"))
    return zones.agg(
        F.count("*").alias("zones"), F.sum("area_m2").alias("total_m2"), F.bround(F.avg("area_m2"), 2).alias("mean_m2"), F.bround(F.avg("mean_score"), 6).alias("mean_score"),
        F.bround(F.avg("mean_terrain"), 6).alias("mean_terrain"), F.bround(F.avg("mean_flood"), 6).alias("mean_flood"), share("mean_terrain").alias("terrain_pct"), share("mean_flood").alias("flood_pct"),
        F.max_by("zone", F.struct("area_m2", -F.col("rank"))).alias("largest"), F.min_by("zone", F.struct("area_m2", "rank")).alias("smallest"), F.min_by("zone", "rank").alias("first"),
    )


def retention(zones: DataFrame, least_m2: float) -> DataFrame:
    """A5: one row of initial, retained and removed zones and hectares at a mapping unit."""
    kept, ha = F.col("area_m2") >= least_m2, F.col("area_m2") / 10_000
    part = lambda c: F.bround(F.coalesce(F.sum(F.when(c, ha)), F.lit(0.0)), 4)
    return zones.agg(F.count("*").alias("initial"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("removed"), part(F.lit(True)).alias("initial_ha"), part(kept).alias("retained_ha"), part(~kept).alias("removed_ha"))


def inside_outside(exposure: DataFrame) -> DataFrame:
    """Habitations, people, households and groups inside and outside of zones, their percentages, and that the two add up."""
    rows = exposure.groupBy(F.col("overlap")).agg(F.count("*").alias("habitations"), *[F.sum(c).alias(n) for n, c in POPULATION.items()])
    both = F.broadcast(exposure.sparkSession.createDataFrame([(True, S.INSIDE), (False, S.OUTSIDE)], "overlap boolean, side string")).join(rows, "overlap", "left").fillna(0)
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  two rows
    names = ["habitations", *POPULATION]
    whole = F.broadcast(exposure.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}") for n, c in POPULATION.items()]))
    out = both.join(whole).withColumns({f"{n}_pct": pct(F.col(n), total(n)) for n in names})
    agree: Column = F.lit(True)
    for n in POPULATION:
        agree = agree & (total(n) == F.col(f"_{n}"))
    return out.withColumn("reconciled", agree).select("side", *names, *[f"{n}_pct" for n in names], "reconciled")


def by_band(exposure: DataFrame) -> DataFrame:
    """Habitations and the four measures by proximity band, with percentages; empty bands too."""
    return T.banded_totals(exposure, "band", S.BAND_ORDER, POPULATION)


def distance_stats(df: DataFrame, column: str) -> DataFrame:
    """Least, most, mean and median."""
    middle = T.percentiles(df, column, [50]).withColumnRenamed("p50", "median")
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.round(F.avg(column), 6).alias("mean")).join(middle)


def tier_distribution(profiles: DataFrame) -> DataFrame:
    """Villages, share, people and households by tier, with its label."""
    by = profiles.groupBy("priority_tier").agg(F.count("*").alias("villages"), F.first("priority_tier_display").alias("label"), F.sum("tot_p").alias("population"), F.sum("no_hh").alias("households"))
    return by.withColumn("pct", pct(F.col("villages"), F.sum("villages").over(W.partitionBy())))  # one row a tier


def class_distribution(profiles: DataFrame) -> DataFrame:
    """A10: villages by hazard class at the centroid, classes without any and NoData too."""
    names = {1: "Class_1", 2: "Class_2", 3: "Class_3"}
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("hazard_class")), F.lit("NoData"))
    legend = profiles.sparkSession.createDataFrame([(n,) for n in (*names.values(), "NoData")], "class string")
    return F.broadcast(legend).join(profiles.groupBy(known.alias("class")).agg(F.count("*").alias("villages")), "class", "left").fillna(0)


def indicator_stats(profiles: DataFrame, indicators: list[str]) -> DataFrame:
    """(indicator, status, mean, median, min, max, n), rounded to 4; UNAVAILABLE without a value."""
    out = None
    for c in indicators:
        have = c in profiles.columns
        column = profiles.select(F.col(c).cast("double").alias(c)) if have else profiles.select(F.lit(None).cast("double").alias(c))
        one = column.agg(F.bround(F.avg(c), 4).alias("mean"), F.bround(F.min(c), 4).alias("min"), F.bround(F.max(c), 4).alias("max"), F.count(c).alias("n")).join(T.percentiles(column, c, [50], 12).select(F.bround("p50", 4).alias("median")))
        row = one.select(F.lit(c).alias("indicator"), F.when(F.col("n") > 0, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), "mean", "median", "min", "max", "n")
        out = row if out is None else out.unionByName(row)
    return out


def area_totals(areas: DataFrame) -> DataFrame:
    """One row: areas, hectares, estimated ones, and the household and population capacity."""
    return areas.agg(F.count("*").alias("areas"), F.bround(F.sum("area_m2") / 10_000, 4).alias("hectares"), F.count("estimated_household_capacity").alias("estimated"), F.count_if("capacity_viable").alias("viable"), F.coalesce(F.sum("estimated_household_capacity"), F.lit(0)).alias("households"), F.coalesce(F.sum("estimated_population_capacity"), F.lit(0)).alias("population"))


def block_summary(profiles: DataFrame) -> DataFrame:
    """Villages, people, tiers, people at risk and highly vulnerable villages by sub-district, most tier 1 and 2 villages first."""
    tier, risk = F.col("priority_tier"), F.col("priority_tier").isin(S.ACTION_TIERS)
    names = ["tier1_immediate", "tier2_short_term", "tier3_monitoring", "beyond_proximity"]
    by = profiles.groupBy("subdist").agg(F.count("*").alias("villages"), F.sum("tot_p").alias("population"), *[F.count_if(tier == t).alias(n) for t, n in zip(S.TIERS, names, strict=True)], F.coalesce(F.sum(F.when(risk, F.col("tot_p"))), F.lit(0)).alias("at_risk_population"), F.count_if(F.col("vulnerability_flag_count") >= 2).alias("high_vulnerability_villages"))
    return by.orderBy(F.desc(F.col(names[0]) + F.col(names[1])), "subdist")


def incident_exposure(points: DataFrame) -> DataFrame:
    """One row: points with an incident within 1 km, 2 km, of either group, and with several within 2 km."""
    return points.agg(F.count("*").alias("total"), *[F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in ("n_1km", "n_2km", "n_2km_mass", "n_2km_flood")], F.count_if(F.col("n_2km") >= 2).alias("chronic"), F.bround(F.avg("nearest_incident_m"), 1).alias("mean_nearest_m"))


def dedup_summary(events: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of raw, canonical and merged events, and leaders that absorbed any."""
    return events.agg(F.count("*").alias("raw")).join(merged.agg(F.count("*").alias("canonical"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("merged"), F.count_if(F.col("duplicate_count") > 0).alias("leaders_with_duplicates")))


def dedup_log(merged: DataFrame, key: str) -> DataFrame:
    """(leader, event, provider, spatial_offset_m, temporal_offset_days) of every merged event."""
    return merged.where(F.col("duplicate_count") > 0).select(F.col(key).alias("leader"), F.inline("duplicates"))


def band_shares(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """(band, n, pct) of the non-null values in (-inf, c1], (c1, c2], ... (ck, inf)."""
    names = [f"<= {cuts[0]:g}", *[f"{a:g} - {b:g}" for a, b in zip(cuts, cuts[1:], strict=False)], f"> {cuts[-1]:g}"]
    place = None
    for c, n in zip(cuts, names, strict=False):
        place = F.when(F.col(column) <= c, n) if place is None else place.when(F.col(column) <= c, n)
    legend = df.sparkSession.createDataFrame([(n,) for n in names], "band string")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.otherwise(names[-1]).alias("band")).agg(F.count("*").alias("n"))
    return F.broadcast(legend).join(counts, "band", "left").fillna(0).withColumn("pct", pct(F.col("n"), F.sum("n").over(W.partitionBy()), 1))


def distance_quantiles(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(measure, total, n, min, p25, median, p75, max) of each column's known values, rounded half to even: distances told to 0.1 have quartiles to 0.025."""
    out = None
    for c in columns:
        ends = df.agg(F.count("*").alias("total"), F.count(c).alias("n"), F.bround(F.min(c), digits).alias("min"), F.bround(F.max(c), digits).alias("max"))
        row = ends.join(T.percentiles(df, c, [25, 50, 75], 9)).select(F.lit(c).alias("measure"), "total", "n", "min", F.bround("p25", digits).alias("p25"), F.bround("p50", digits).alias("median"), F.bround("p75", digits).alias("p75"), "max")
        out = row if out is None else out.unionByName(row)
    return out


AREA_RECORD = [
    "area_id", "area_hectares", "mean_slope", "slope_context", "terrain_context", "flood_context", "hazard_buffer_context", "area_scale_context", "hazard_distance_m", "nearest_village_name",
    "nearest_village_pop", "estimated_household_capacity", "estimated_population_capacity", "dominant_land_cover", "road_accessibility_category",
]


def area_records(areas: DataFrame, access: DataFrame) -> DataFrame:
    """A record an area of its contexts, capacity and road access, as rows rather than one list."""
    return areas.join(access.select("area_id", "road_accessibility_category"), "area_id", "left").withColumn("area_hectares", F.bround(F.col("area_m2") / 10_000, 4)).select(*AREA_RECORD)


def layer_profile(cells: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row of a layer's cells: NoData, NaN, infinite and valid ones, coverage, statistics, values out of a range."""
    v = F.col(value).cast("double")
    valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = F.when(valid, v)
    return cells.agg(
        F.count("*").alias("cells"), F.count_if(v.isNull()).alias("nodata"), F.count_if(F.coalesce(F.isnan(v), F.lit(False))).alias("nan"), F.count_if(F.coalesce(F.abs(v) == float("inf"), F.lit(False))).alias("infinite"), F.count(ok).alias("valid"), pct(F.count(ok), F.count("*")).alias("coverage_pct"),
        F.min(ok).alias("lo"), F.max(ok).alias("hi"), F.round(F.avg(ok), 6).alias("mean"), F.round(F.stddev_pop(ok), 6).alias("std"), F.count_if(ok < low).alias("below"), F.count_if(ok > high).alias("above"),
    )


def class_scores(cells: DataFrame, code: str, score: str) -> DataFrame:
    """(code, cells, lo, hi, mean) of the scores of each class, NoData too."""
    return cells.groupBy(code).agg(F.count("*").alias("cells"), F.min(score).alias("lo"), F.max(score).alias("hi"), F.round(F.avg(score), 6).alias("mean"))


def dominance(cells: DataFrame) -> DataFrame:
    """A3: cells where either contribution is larger (by over 1e-5) or neither, and their shares of the mean score in percent."""
    diff = F.col("ct") - F.col("cf")
    return cells.agg(F.count_if(diff > 1e-5).alias("terrain"), F.count_if(-diff > 1e-5).alias("flood"), F.count_if(F.abs(diff) <= 1e-5).alias("equal"), F.round(F.try_divide(F.avg("ct") * 100, F.avg("score")), 4).alias("terrain_pct"), F.round(F.try_divide(F.avg("cf") * 100, F.avg("score")), 4).alias("flood_pct"))


def mask_log(log: DataFrame, hectares_a_cell: float) -> DataFrame:
    """(predicate, cells, hectares) of an exclusion mask's one-row log; null is not configured."""
    rows = log.unpivot([], log.columns, "predicate", "cells")
    return rows.withColumn("hectares", F.bround(F.col("cells") * hectares_a_cell, 2))


def decision_summary(profiles: DataFrame, areas: DataFrame) -> DataFrame:
    """C11, K6: one nested row: tiers, bands, classes, indicators and the areas' totals."""
    profiles = staged(profiles, "profiles")
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  each a few rows
    parts = [rows(tier_distribution(profiles).select("priority_tier", "villages", "pct", "population", "households"), "tiers"), rows(by_band(profiles).select("band", "n", "population"), "bands"), rows(class_distribution(profiles), "classes"), rows(indicator_stats(profiles, list(S.RATES)), "indicators"), rows(area_totals(areas), "areas")]
    out = profiles.agg(F.count("*").alias("total_villages"))
    for p in parts:
        out = out.join(p)
    return out
