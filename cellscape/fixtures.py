"""Input tables of the registered queries, derived from the given tables by integer arithmetic (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELL = 30.0
GRID_COLS = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation cells (row, col, elev), with missing cells as nulls."""
    return read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey div 100 as int) AS row", "cast(o_orderkey % 100 as int) AS col", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / 10000 END AS elev")


def g_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valley with long converging flow paths and no missing cell."""
    return read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey div 100 as int) AS row", "cast(o_orderkey % 100 as int) AS col", "o_totalprice / 100000 + 0.5 * abs(o_orderkey % 100 - 50) + 0.2 * (o_orderkey div 100) AS elev")


def g_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valley with missing cells, on a grid of degrees (GEO)."""
    return read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey div 100 as int) AS row", "cast(o_orderkey % 100 as int) AS col", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / 100000 + 0.5 * abs(o_orderkey % 100 - 50) + 0.2 * (o_orderkey div 100) END AS elev")


GEO = (79.0, 30.5, 0.0003, 0.00027)
"""Top left corner and steps of the grid of degrees."""
GROUND = (307950.0, 3375900.0, CELL, CELL)
"""Those of the grid of metres over it, of the same size."""


def g_lulc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover codes."""
    return read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey div 100 as int) AS row", "cast(o_orderkey % 100 as int) AS col", "CAST(element_at(array(10, 20, 30, 40, 50, 70, 80), cast(o_orderkey % 7 + 1 as int)) AS int) AS code", "o_orderkey % 5 = 0 AS protected", "o_orderkey % 97 <> 0 AS valid")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with terrain and flood scores in [0, 1] and nulls."""
    return read(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey div 100 as int) AS row", "cast(o_orderkey % 100 as int) AS col",
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 7919 % 1001) / 1000.0D END AS terrain",
        "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE (o_orderkey * 104729 % 1001) / 1000.0D END AS flood",
    )


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").selectExpr("c_custkey AS village_id", "c_name AS name", "c_nationkey AS subdist", "CASE c_custkey % 10 WHEN 0 THEN 'TOWN' ELSE 'VILLAGE' END AS level", "cast(CASE c_custkey % 41 WHEN 0 THEN 0 ELSE 100 + floor(abs(c_acctbal)) END as bigint) AS tot_p")
    return base.selectExpr("*", "tot_p div 5 AS no_hh", "tot_p * (village_id % 30) div 100 AS p_06", "tot_p * (village_id % 53) div 100 AS p_ill", "tot_p * (village_id % 71) div 100 AS non_work_p", "tot_p * (village_id % 37) div 100 AS p_sc", "tot_p * (village_id % 3) div 100 AS p_st")


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_custkey % 17 <> 0").selectExpr("c_custkey AS village_id", "((c_custkey * 7919 % 3000) + 0.25D) * CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 1 END AS x", "-((c_custkey * 104729 % 4500) + 0.25D) * CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 1 END AS y", "c_nationkey AS subdist", "c_name AS name")


def facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS facility_id", "s_name AS name", "(s_suppkey * 3571 % 3000) + 0.25D AS x", "-((s_suppkey * 2741 % 4500) + 0.25D) AS y", "element_at(array('HEALTH', 'HOSPITAL', 'SCHOOL', 'EMERGENCY', 'OTHER'), cast(s_nationkey % 5 + 1 as int)) AS category")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features with tags and a place."""
    amenity = "element_at(array('hospital', 'clinic', 'doctors', 'school', 'college', 'police', 'fire_station', 'community_centre', 'townhall'), cast(p_size % 9 + 1 as int))"
    suffix = "element_at(array('', ' CHC', ' Primary Health Centre', ' Sub-Centre', ' Vidyalaya', ' ITI', ' Thana', ' Panchayat Bhavan', ' Dak Ghar', ' Court', ' Dispensary', ' Anganwadi'), cast(p_partkey % 12 + 1 as int))"
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", f"concat(p_name, {suffix}) AS name", f"CASE WHEN p_partkey % 4 = 0 THEN {amenity} END AS amenity", "CASE WHEN p_partkey % 19 = 0 THEN 'centre' END AS healthcare", "lower(p_type) AS building",
        "CASE WHEN p_partkey % 17 = 0 THEN 'government' END AS office", "CASE WHEN p_partkey % 5 = 0 THEN 'yes' END AS emergency", "(p_partkey * 3571 % 3000) + 0.25D AS x", "-((p_partkey * 2741 % 4500) + 0.25D) AS y",
    )


def incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "upper(event_type) AS hazard_type", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE cast(ts as date) END AS date", "year(ts) AS year",
        "(user_id * 613 % 30000) + (event_id % 7) * 40 + 0.25D AS x", "-((user_id * 419 % 45000) + 0.25D) AS y",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(floor(value) as bigint) END AS fatalities", "concat('src', event_id % 3) AS provider", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 25 * (event_id % 12) END AS uncertainty_m",
    )


KINDS = "array('trunk', 'primary', 'secondary', 'residential', 'track', 'footway', 'construction')"


def road(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = f"element_at({KINDS}, cast(p_partkey % 7 + 1 as int))"
    return read(spark, sf_dir, "part").where("p_partkey % 211 <> 210").selectExpr("p_partkey AS u", "p_partkey + 1 AS v", "p_retailprice / 10 AS length_m", f"{kind} AS highway", "p_partkey AS seq")


def road_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcuts with duplicates; seq starts after that of road."""
    n = read(spark, sf_dir, "part").count()
    kind = f"element_at({KINDS}, cast(l_linenumber % 7 + 1 as int))"
    return read(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0").selectExpr("l_partkey AS u", f"(l_partkey * 7) % {n} AS v", "l_extendedprice / 100 AS length_m", f"{kind} AS highway", "100000000 + l_orderkey * 10 + l_linenumber AS seq")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads as lines over a lattice of 60 m: eastward ones of three points, some southward ones, and later copies of other classes."""
    at = "named_struct('x', 60.0D * (p_partkey % 50 + {0}) + 0.5D, 'y', -(60.0D * (p_partkey div 50 + {1}) + 0.5D))"
    bend = "named_struct('x', 60.0D * (p_partkey % 50) + 30.5D, 'y', -(60.0D * (p_partkey div 50) + 0.5D) - 2.0D * (p_partkey % 7))"
    base = read(spark, sf_dir, "part")
    kind = "element_at(" + KINDS + ", cast(({0}) % 7 + 1 as int)) AS highway"
    rest = ["CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name", "CASE WHEN p_partkey % 9 = 0 THEN 'NH-1' END AS ref", "CASE WHEN p_partkey % 4 = 0 THEN 'paved' END AS surface"]
    line = f"array({at.format(0, 0)}, {bend}, {at.format(1, 0)}) AS points"
    east = base.where("p_partkey % 50 < 49").selectExpr("p_partkey * 2 AS seq", kind.format("p_partkey div 3"), line, *rest)
    south = base.where("p_partkey % 3 = 0").selectExpr("p_partkey * 2 + 1 AS seq", kind.format("p_partkey div 5"), f"array({at.format(0, 0)}, {at.format(0, 1)}) AS points", *rest)
    again = base.where("p_partkey % 50 < 49 AND p_partkey % 11 = 0").selectExpr("100000000 + p_partkey AS seq", kind.format("p_partkey + 1"), line, *rest)
    return east.unionByName(south).unionByName(again)


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected polygons: a diamond with a hole about each place of supplier."""
    ring = lambda r: "array(" + ", ".join(f"named_struct('x', cx + {dx * r}D, 'y', cy + {dy * r}D)" for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))) + ") AS ring"
    at = facility(spark, sf_dir).selectExpr("facility_id AS area_id", "x AS cx", "y AS cy")
    return at.selectExpr("area_id", ring(100.125)).unionByName(at.selectExpr("area_id", ring(40.125)))


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS area_id", "l_extendedprice * 12 AS area_m2", "l_quantity AS mean_slope", "l_discount * 10 AS mean_score", "l_extendedprice / 10 AS hazard_distance_m", "l_returnflag AS flag")
