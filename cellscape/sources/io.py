"""Readers and writers of the feature formats: all of them Spark's own text, JSON and CSV readers on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.components import staged
from cellscape.operators.facilities import classify_facility


def read_geojson_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features, one a line or in collections, as properties plus x and y. properties is a DDL schema."""
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<double>>>"
    rows = spark.read.schema(f"type string, features array<{feature}>, properties struct<{properties}>, geometry struct<type: string, coordinates: array<double>>").json(path)
    one = F.array(F.struct("properties", "geometry"))
    found = rows.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(one)).alias("f"))
    return found.select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"))


def write_geojson_points(points: DataFrame, path: str, properties: list[str]) -> None:
    """K1: one point feature a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(path)


DEPTH = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiPolygon": 3}
"""How many arrays lie about a position of each kind of geometry."""


def write_geojson(features: DataFrame, path: str, kind: str, geometry: str, properties: list[str]) -> None:
    """K1: one feature a line. The column geometry holds (x, y) structs in as many arrays as the kind (DEPTH) has."""

    def positions(value: Column, depth: int) -> Column:
        return F.transform(value, lambda v: positions(v, depth - 1)) if depth else F.array(value["x"], value["y"])

    shape = F.struct(F.lit(kind).alias("type"), positions(F.col(geometry), DEPTH[kind]).alias("coordinates"))
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value")).write.text(path)


def read_geojson(spark: SparkSession, path: str, kind: str, geometry: str, properties: str) -> DataFrame:
    """The features of a kind, one a line or in collections, as properties (a DDL schema) and geometry: (x, y) structs in arrays.

    Features of other kinds in the same files are left out, so a mixed file is read a kind at a time.
    """
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    rows = spark.read.schema(f"type string, features array<{feature}>, properties struct<{properties}>, geometry struct<type: string, coordinates: string>").json(path)
    one = F.array(F.struct("properties", "geometry"))
    found = rows.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(one)).alias("f")).where(F.col("f.geometry.type") == kind)

    def points(value: Column, depth: int) -> Column:
        if depth:
            return F.transform(value, lambda v: points(v, depth - 1))
        return F.struct(F.get(value, F.lit(0)).alias("x"), F.get(value, F.lit(1)).alias("y"))

    nested = "array<" * (DEPTH[kind] + 1) + "double" + ">" * (DEPTH[kind] + 1)
    return found.select("f.properties.*", points(F.from_json("f.geometry.coordinates", nested), DEPTH[kind]).alias(geometry))


ELEMENT = "struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>, nodes: array<bigint>>"


def read_map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map-service documents, one document a line."""
    return spark.read.schema(f"elements array<{ELEMENT}>").json(path).select(F.explode("elements").alias("e")).select("e.*")


def element_points(elements: DataFrame) -> DataFrame:
    """S3: id (type/id), name, lon, lat, tags and classes; the centre stands in for missing coordinates, elements without any are
    dropped, and one without a name is called by its category."""
    tag = lambda k: F.col("tags")[k]
    kinds = classify_facility(F.coalesce("tags", F.create_map().cast("map<string, string>")))
    unnamed = F.concat(F.lit("Unnamed "), F.initcap(F.replace("_c.facility_category", F.lit("_"), F.lit(" "))))
    some = lambda c: F.when(c != "", c)
    rows = elements.withColumn("_c", kinds).select(
        F.concat_ws("/", "type", "id").alias("osm_id"), F.coalesce(some(tag("name")), some(tag("name:en")), unnamed).alias("name"),
        F.coalesce("lon", "center.lon").alias("lon"), F.coalesce("lat", "center.lat").alias("lat"), "tags", "_c.*",
    )
    return rows.dropna(subset=["lon", "lat"])


def element_lines(elements: DataFrame) -> DataFrame:
    """Ways of two points or more, with class and points."""
    ways = elements.where((F.col("type") == "way") & (F.size("geometry") >= 2))
    points = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return ways.select("id", F.coalesce(F.col("tags")["highway"], F.lit("unclassified")).alias("highway"), F.col("tags")["name"].alias("name"), points.alias("points"))


def settlements(elements: DataFrame) -> DataFrame:
    """Id, kind (point, polygon or line), name and points of elements whose ways name their nodes (nodes array<bigint>).

    A node is a point; a way of three nodes or more that ends where it began is a polygon, another of two or more a line; nodes
    that aren't among the elements are left out of their way.
    """
    at = elements.where(F.col("type") == "node").select(F.col("id").alias("node"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    named = elements.withColumn("name", F.col("tags")["name"])
    points = named.where((F.col("type") == "node") & F.col("tags")["place"].isNotNull()).select("id", F.lit("point").alias("kind"), "name", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("points"))
    steps = named.where(F.col("type") == "way").select("id", "name", F.posexplode("nodes").alias("pos", "node")).join(at, "node")
    ways = steps.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("s")).select("id", "name", F.transform("s", lambda x: x["p"]).alias("points"))
    n = F.size("points")
    kind = F.when((n >= 3) & (F.element_at("points", 1) == F.element_at("points", -1)), "polygon").when(n >= 2, "line")
    return points.unionByName(ways.withColumn("kind", kind).where("kind IS NOT NULL"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header under an explicit schema."""
    return spark.read.csv(path, header=True, schema=schema)


def union_catalogues(named: dict[str, DataFrame]) -> DataFrame:
    """Catalogues with differing columns, each row marked with its catalogue."""
    frames = [df.withColumn("raw_catalog", F.lit(name)) for name, df in named.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_layer(spark: SparkSession, path: str, value: str, nodata: float | None = None) -> DataFrame:
    """A layer's cells (row, col, value as a double); NaN, infinite and NoData values are null."""
    v = F.col(value).cast("double")
    known = ~F.isnan(v) & (F.abs(v) < float("inf")) & ((v != nodata) if nodata is not None else F.lit(True))
    return spark.read.parquet(path).select("row", "col", F.when(known, v).alias(value))


BLOCK = 1024
"""Cells along the side of a folder's block of whole tiles; a tile of more cells is a block of its own."""


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    side = tile * max(1, BLOCK // tile)
    named = lambda size: F.concat_ws("_", F.floor(F.col("row") / size), F.floor(F.col("col") / size))
    return cells.withColumns({"tile": named(tile), "block": named(side)})


def _by_block(cells: DataFrame) -> DataFrame:
    return cells.repartition("block")


def write_cells(cells: DataFrame, path: str, tile: int = 1024) -> None:
    """K2: cells with their tile, a folder for each block of tiles: folders grow with the cells, however small the tiles are."""
    _by_block(_tiled(cells, tile)).write.partitionBy("block").parquet(path)


def refresh_cells(cells: DataFrame, path: str, tile: int = 1024) -> None:
    """Replaces the tiles that cells (all cells of those tiles) belong to; other tiles stay as they are, and so do the files of
    blocks without such a tile. The other tiles of a block with one are staged with the new ones, then the block is replaced."""
    spark = cells.sparkSession
    new = staged(_tiled(cells, tile), "refreshed-tiles")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        kept = spark.read.parquet(path).join(new.select("block").distinct(), "block", "left_semi").join(new.select("tile").distinct(), "tile", "left_anti")
        new = staged(kept.unionByName(new), "refreshed-blocks")
    _by_block(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)


def long_summary(df: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """K4: category, metric, value and percentage rows of the measures' sums."""
    sums = df.groupBy(by).agg(*[F.sum(m).cast("double").alias(m) for m in measures])
    rows = sums.unpivot([by], measures, "metric", "value").withColumnRenamed(by, "category")
    totals = rows.groupBy("metric").agg(F.sum("value").alias("total"))
    return rows.join(F.broadcast(totals), "metric").select("category", "metric", "value", F.round(100 * F.try_divide("value", "total"), 6).alias("percentage"))


def provenance(incidents: DataFrame) -> DataFrame:
    """K3: the audit rows of merged incidents (spatial.merged_events with incident_id): status, first offset and merged providers."""
    some = F.col("duplicate_count") > 0
    joined = F.when(some, F.array_join(F.transform("duplicates", lambda r: r["provider"]), ", ")).otherwise("NONE (Unique Record)")
    return incidents.select(
        F.col("incident_id").alias("canonical_incident_id"), "hazard_type", F.col("date").alias("event_date"), F.col("year").alias("event_year"), F.col("provider").alias("source_provider"),
        F.when(some, "MERGED_CROSS_SOURCE_DUPLICATE").otherwise("UNIQUE_RECORD").alias("deduplication_status"), F.col("spatial_offset_m").alias("spatial_offset_to_duplicate_m"), joined.alias("merged_duplicate_source_info"),
        F.bround("x", 2).alias("easting_utm44n"), F.bround("y", 2).alias("northing_utm44n"), F.col("uncertainty_m").cast("double").alias("coordinate_uncertainty_m"), F.col("fatalities").alias("fatalities_documented"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """K3, K4: CSV parts with headers."""
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """K6: a nested document a row."""
    df.write.json(path)


def summary_json(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """K6: a one-row JSON document of aggregates."""
    return df.agg(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("value"))
