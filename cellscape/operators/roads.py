"""Road networks as edge tables. A node is a long that holds its coordinates, in tenths of a metre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.components import LOCAL_EDGES as LOCAL_COMPONENT_EDGES
from cellscape.components import components, staged
from cellscape.functions import scores as S
from cellscape.operators import spatial
from cellscape.operators.parts import PART_NODES, paths_by_parts, spread
from cellscape.shipping import ship

# Speeds in km/h by class, classes left out, vehicular and arterial classes, limits.
SPEEDS = {
    "trunk": 35.0, "trunk_link": 25.0, "primary": 30.0, "primary_link": 20.0, "secondary": 25.0, "secondary_link": 20.0, "tertiary": 20.0, "tertiary_link": 15.0,
    "unclassified": 18.0, "residential": 15.0, "service": 15.0, "track": 10.0, "path": 3.5, "bridleway": 4.0, "footway": 3.5, "steps": 2.0,
}
DEFAULT_SPEED = 15.0
EXCLUDED = ["construction", "proposed", "abandoned", "raceway"]
VEHICULAR = ["trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "service", "track"]
ARTERIAL = ["trunk", "trunk_link", "primary", "primary_link"]
MAX_SNAP_M, WALKING_KMH = 3000.0, 4.0
LOCAL_EDGES = 200_000
"""Up to so many edges one task walks the whole network; beyond it a task walks a part. Both give the same distances."""
_SHIFT, _HALF = 1 << 31, 1 << 30


def node(x: Column, y: Column) -> Column:
    """The node of a point, rounded half to even to 0.1 m."""
    tenth = lambda c: F.bround(F.bround(c, 1) * 10, 0).cast("long")
    return tenth(x) * F.lit(_SHIFT) + tenth(y) + F.lit(_HALF)


def node_x(n: Column) -> Column:
    return F.floor(n / F.lit(float(_SHIFT))).cast("long") / 10.0


def node_y(n: Column) -> Column:
    return (F.pmod(n, F.lit(_SHIFT)) - F.lit(_HALF)) / 10.0


def road_attributes(roads: DataFrame, digits: int = 4) -> DataFrame:
    """Drops excluded classes and zero lengths; adds speed, travel minutes (rounded half to even) and flags.

    The length is that of `points`, if the roads have them and no length_m.
    """
    if "length_m" not in roads.columns:
        steps = F.zip_with(F.expr("slice(points, 1, size(points) - 1)"), F.expr("slice(points, 2, size(points) - 1)"), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
        roads = roads.withColumn("length_m", F.bround(F.aggregate(steps, F.lit(0.0), lambda t, d: t + d), 2))
    speed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in SPEEDS.items() for x in (k, v)]), F.col("highway")), F.lit(DEFAULT_SPEED))
    kept = roads.where(~F.col("highway").isin(EXCLUDED) & (F.col("length_m") > 0)).withColumn("speed_kmh", speed)
    return kept.withColumns({"minutes": F.bround(F.col("length_m") / 1000 / F.col("speed_kmh") * 60, digits), "is_vehicular": F.col("highway").isin(VEHICULAR), "is_arterial": F.col("highway").isin(ARTERIAL)})


def segments(lines: DataFrame) -> DataFrame:
    """Lines (points array<struct<x, y>>, others) to their segments: x, y, x2, y2, pos and the other columns."""
    rest = [c for c in lines.columns if c != "points"]
    pairs = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    parts = lines.where(F.size("points") >= 2).select(*rest, F.posexplode(pairs).alias("pos", "s"))
    return parts.select(*rest, "pos", F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def lines_to_edges(lines: DataFrame, vehicular_only: bool = False) -> DataFrame:
    """Lines (seq, speed_kmh, points array<struct<x, y>>, other attributes) to undirected edges between points rounded to 0.1 m.

    Lengths and minutes are of the unrounded segments, zero-length edges go, and of duplicates the last in (seq, position) stays.
    """
    if vehicular_only:
        lines = lines.where("is_vehicular")
    parts = segments(lines.drop("length_m", "minutes"))
    length = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    made = parts.withColumns({"u": node(F.col("x"), F.col("y")), "v": node(F.col("x2"), F.col("y2")), "length_m": F.bround(length, 2)})
    if "speed_kmh" in made.columns:
        made = made.withColumn("minutes", F.bround(length / 1000 / F.col("speed_kmh") * 60, 4))
    return last_edges(made.drop("x", "y", "x2", "y2"), ["seq", "pos"])


def last_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Undirected edges (u < v), without loops; of duplicates the last by `order` stays."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    one = edges.where(F.col("u") != F.col("v")).withColumns({"_u": F.least("u", "v"), "_v": F.greatest("u", "v")})
    last = one.groupBy("_u", "_v").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.select(F.col("_u").alias("u"), F.col("_v").alias("v"), *[F.col("e")[c].alias(c) for c in rest])


def network_nodes(edges: DataFrame) -> DataFrame:
    """node, x, y of an edge table's nodes."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", node_x(F.col("node")).alias("x"), node_y(F.col("node")).alias("y"))


def network_components(edges: DataFrame, local_edges: int = LOCAL_COMPONENT_EDGES) -> DataFrame:
    """(component, nodes) sizes of an edge table (u, v); local_edges is that of `components`."""
    return components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), local_edges=local_edges).groupBy("component").agg(F.count("*").alias("nodes"))


def network_health(edges: DataFrame) -> DataFrame:
    """One row of nodes, edges, components, the largest's nodes and its share in percent."""
    sizes = network_components(edges).agg(F.sum("nodes").alias("nodes"), F.count("*").alias("components"), F.max("nodes").alias("largest"))
    return edges.agg(F.count("*").alias("edges")).join(sizes).withColumn("largest_pct", F.bround(F.col("largest") * 100.0 / F.col("nodes"), 2))


def terminal_nodes(edges: DataFrame) -> DataFrame:
    """Distinct end points of arterial edges."""
    return edges.where("is_arterial").select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _local_paths(edges: DataFrame, sources: DataFrame, weights: list[str]) -> DataFrame:
    """The paths of a small network in one task: its edges and starts in one group."""
    rows = edges.select("u", "v", F.array(*[F.col(w).cast("double") for w in weights]).alias("w"), F.lit(None).cast("string").alias("set"))
    rows = rows.unionByName(sources.select(F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("array<double>").alias("w"), F.col("set").cast("string").alias("set")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        both = pa.Table.from_batches(parts)
        edge = both.filter(both.column("v").is_valid())
        start = both.filter(both.column("v").is_null())
        u, v = edge.column("u").to_numpy(), edge.column("v").to_numpy()
        w = edge.column("w").combine_chunks().flatten().to_numpy().reshape(len(u), len(weights))
        at, names = start.column("u").to_numpy(), np.array(start.column("set").to_pylist(), dtype=object)
        nodes, code = np.unique(np.concatenate((u, v, at)), return_inverse=True)
        u, v, at = code[: len(u)], code[len(u) : 2 * len(u)], code[2 * len(u) :]
        for name in sorted(set(names)):
            for k, weight in enumerate(weights):
                dist = np.full(len(nodes), np.inf)
                dist[at[names == name]] = 0.0
                dist = spread(np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((w[:, k], w[:, k])), dist)
                hit = np.flatnonzero(np.isfinite(dist))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array([weight] * len(hit)), pa.array(nodes[hit]), pa.array(dist[hit])], names=["set", "weight", "node", "dist"])

    ship(edges.sparkSession)
    return rows.coalesce(1).mapInArrow(solve, "set string, weight string, node long, dist double")


def shortest_paths(edges: DataFrame, sources: DataFrame, weights: list[str], max_rounds: int = 10_000, local_edges: int = LOCAL_EDGES, part_nodes: int = PART_NODES) -> DataFrame:
    """(set, weight, node, dist) from sources (set, node): the paths by every weight from every set at once.

    A small network is walked by one task, a larger one part by part (parts.paths_by_parts) with the same distances.
    """
    slim = staged(edges.select("u", "v", *weights), "paths-edges")
    if slim.count() <= local_edges:
        return staged(_local_paths(slim, sources.select("set", "node").distinct(), weights), "paths-dist")
    return paths_by_parts(slim, sources, weights, node_x(F.col("node")), node_y(F.col("node")), part_nodes, max_rounds)


def pair_path(edges: DataFrame, a: int, b: int, weight: str = "length_m") -> DataFrame:
    """One row with whether b is reached from a, and the distance."""
    spark = edges.sparkSession
    found = shortest_paths(edges, spark.createDataFrame([("pair", a)], "set string, node long"), [weight]).where(F.col("node") == b)
    return found.agg(F.count("*").alias("n"), F.min("dist").alias("dist")).select((F.col("n") > 0).alias("connected"), "dist")


def nearest_road(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Each point's nearest line (ties to the smaller seq) with its distance and attributes, defaults where they are missing."""
    return _road_named(spatial.nearest(points, segments(lines), key, "seq", _ROAD, shape="segment"))


def nearest_road_of_areas(cells: DataFrame, lines: DataFrame, key: str, cell: float = 30.0) -> DataFrame:
    """The line nearest to each area, which is the squares of its cells (key, row, col), as nearest_road: 0 where one crosses it.

    Only cells at an area's side are held against lines, but for a line that lies wholly inside, which no side cell would meet at 0.
    """
    zone = cells.select(F.col(key).alias("zone"), "row", "col")
    squares = spatial.cell_centres(spatial.zone_sides(zone), cell).select(F.col("zone").alias(key), "x", "y")
    parts = segments(lines)
    near = spatial.nearest(squares, parts, key, "seq", _ROAD, digits=None, shape="segment", own=cell / 2).dropDuplicates([key])
    inside = spatial.to_cell(parts, cell).join(zone, ["row", "col"]).select(F.col("zone").alias(key), "seq", *_ROAD, F.lit(0.0).alias("distance_m"))
    told = F.struct("distance_m", "seq", *_ROAD)
    best = near.unionByName(inside).where("seq IS NOT NULL").groupBy(key).agg(F.min(told).alias("b"))
    all_ = zone.select(F.col("zone").alias(key)).distinct().join(best, key, "left")
    return _road_named(all_.select(key, "b.seq", *[F.col(f"b.{c}") for c in _ROAD], F.bround("b.distance_m", 1).alias("distance_m")))


_ROAD = ["name", "ref", "highway", "surface", "is_vehicular"]


def _road_named(near: DataFrame) -> DataFrame:
    """Attributes of the nearest line under the names of the report, defaults where they are missing."""
    defaults = {"name": "Unnamed Road", "ref": "None", "highway": "unknown", "surface": "unknown"}
    filled = near.fillna(defaults).fillna({"is_vehicular": False})
    names = {"distance_m": "dist_to_nearest_road_m", "name": "nearest_road_name", "ref": "nearest_road_ref", "highway": "nearest_road_highway_class", "surface": "nearest_road_surface", "is_vehicular": "nearest_road_is_vehicular"}
    return filled.drop("seq").withColumnsRenamed(names)


def snap(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Key, node, snap_m (not rounded) of each point's nearest network node."""
    return spatial.nearest(points, network_nodes(edges), key, "node", digits=None).withColumnRenamed("distance_m", "snap_m")


def road_access(points: DataFrame, lines: DataFrame, key: str, cells: DataFrame | None = None) -> DataFrame:
    """Points (key, x, y) with their nearest road, the way from the snapped node to the arterial network, category and isolation.

    lines are roads with attributes (road_attributes); paths run over the vehicular ones. Points that stand for areas come with these'
    cells (key, row, col): the nearest road is then the area's, the way that from its point.
    """
    edges = staged(lines_to_edges(lines, vehicular_only=True), "road-edges")
    snapped = snap(points, edges, key)
    paths = shortest_paths(edges, terminal_nodes(edges).select(F.lit("arterial").alias("set"), "node"), ["length_m", "minutes"])
    by_node = paths.groupBy("node").agg(*[F.bround(F.max(F.when(F.col("weight") == w, F.col("dist"))), 1).alias(n) for w, n in (("length_m", "to_m"), ("minutes", "to_min"))])
    met = snapped.join(by_node, "node", "left")
    reached = (F.col("snap_m") <= MAX_SNAP_M) & F.col("to_min").isNotNull()
    category = S.road_category(F.col("snap_m"), F.col("to_min"))
    out = met.select(key, F.bround("snap_m", 1).alias("road_snapping_distance_m"), F.coalesce(reached, F.lit(False)).alias("network_route_exists"), F.when(reached, F.col("to_m")).alias("network_distance_to_arterial_m"), F.when(reached, F.col("to_min")).alias("network_travel_time_to_arterial_min"), category.alias("road_accessibility_category"))
    out = out.withColumn("network_isolated_flag", S.road_isolated(F.col("road_accessibility_category")))
    near = nearest_road(points, lines, key) if cells is None else nearest_road_of_areas(cells, lines, key)
    return near.join(out, key)


def access_summary(access: DataFrame) -> DataFrame:
    """One row: points by category, mean distance and time (where there is a way), isolated points."""
    counts = [F.count_if(F.col("road_accessibility_category") == c).alias(c.lower()) for c in S.ROAD_CATEGORIES]
    return access.agg(F.count("*").alias("total"), *counts, F.bround(F.avg("dist_to_nearest_road_m"), 1).alias("mean_dist_to_nearest_road_m"), F.bround(F.avg("network_travel_time_to_arterial_min"), 1).alias("mean_travel_time_to_arterial_min"), F.count_if("network_isolated_flag").alias("isolated"))


def road_summary(roads: DataFrame) -> DataFrame:
    """Segments, km, and the first road's (by seq) speed and flags, for each class."""
    first = F.min_by(F.struct("speed_kmh", "is_vehicular", "is_arterial"), "seq")
    by = roads.groupBy("highway").agg(F.count("*").alias("segments"), F.bround(F.sum("length_m") / 1000, 2).alias("length_km"), first.alias("f"))
    return by.select("highway", "segments", "length_km", F.col("f.speed_kmh").alias("assumed_speed_kmh"), "f.is_vehicular", "f.is_arterial")


def road_totals(roads: DataFrame) -> DataFrame:
    """Kilometres of all, vehicular and arterial roads."""
    km = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0.0)) / 1000, 2)
    return roads.agg(F.count("*").alias("segments"), km("length_m").alias("total_km"), km(F.when(F.col("is_vehicular"), F.col("length_m"))).alias("vehicular_km"), km(F.when(F.col("is_arterial"), F.col("length_m"))).alias("arterial_km"))
