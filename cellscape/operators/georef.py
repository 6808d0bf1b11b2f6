"""Grids that know where they are: descriptors, their comparison, and warping from one grid (and projection) to another.

A layer is a table of cells (row, col, value) and the `Grid` that says where they lie. Layers combine by position only if their grids
agree; a layer on another grid is warped or refused.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.functions.scores import from_utm, to_utm
from cellscape.shipping import ship

GEOGRAPHIC, METRIC = "EPSG:4326", "EPSG:32644"
TILE = 256
TOLERANCE = 1e-6
"""Two grids agree if their corners and steps differ by less than this share of a cell."""


@dataclass(frozen=True)
class Grid:
    """The top left corner (x0, y0), a cell's width and height, the size and the projection of a grid; rows run down."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int
    crs: str = METRIC

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (col + 0.5) * self.dx, F.lit(self.y0) - (row + 0.5) * self.dy

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col) of a coordinate; the centre of a cell has whole numbers."""
        return (F.lit(self.y0) - y) / self.dy - 0.5, (x - F.lit(self.x0)) / self.dx - 0.5

    def differs(self, other: Grid) -> list[str]:
        """What tells this grid from another: crs, size, origin, step."""
        near = lambda a, b, by: abs(a - b) <= TOLERANCE * by
        tests = {
            "crs": self.crs == other.crs, "size": (self.rows, self.cols) == (other.rows, other.cols),
            "origin": near(self.x0, other.x0, self.dx) and near(self.y0, other.y0, self.dy), "step": near(self.dx, other.dx, self.dx / max(1, self.cols)) and near(self.dy, other.dy, self.dy / max(1, self.rows)),
        }
        return [k for k, same in tests.items() if not same]


@dataclass(frozen=True)
class Layer:
    """Cells (row, col, value) on a grid."""

    cells: DataFrame
    grid: Grid


def convert(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one projection in another: geographic degrees or metres of zone 44 N. Others are refused."""
    if source == target:
        return x, y
    if (source, target) == (GEOGRAPHIC, METRIC):
        return to_utm(x, y)
    if (source, target) == (METRIC, GEOGRAPHIC):
        return from_utm(x, y)
    raise ValueError(f"no way from {source} to {target}")


def footprint(spark: SparkSession, source: Grid, crs: str, dx: float, dy: float, points: int = 21) -> Grid:
    """The grid of cells dx by dy in another projection that covers a grid: the bounds of points along its sides, out to whole cells."""
    at = spark.range(4 * points).select((F.col("id") % points / (points - 1)).alias("t"), F.floor(F.col("id") / points).alias("side"))
    across = F.when(F.col("side") < 2, F.col("t")).when(F.col("side") == 2, 0.0).otherwise(1.0) * (source.cols * source.dx) + source.x0
    down = F.lit(source.y0) - F.when(F.col("side") >= 2, F.col("t")).when(F.col("side") == 0, 0.0).otherwise(1.0) * (source.rows * source.dy)
    x, y = convert(across, down, source.crs, crs)
    left, right, bottom, top = at.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, y0 = math.floor(left / dx) * dx, math.ceil(top / dy) * dy
    return Grid(x0, y0, dx, dy, max(1, math.ceil((y0 - bottom) / dy)), max(1, math.ceil((right - x0) / dx)), crs)


def warp(layer: Layer, target: Grid, value: str = "value", method: str = "bilinear", tile: int = TILE) -> Layer:
    """A layer on another grid, in another projection if need be; every cell of the target is there, null where nothing valid is.

    bilinear: the mean of the four source cells about a target's centre by their closeness, over those that are valid. nearest: the
    source cell that holds the centre. Target cells go back to fractional places of the source; a task gets one tile of the source
    with a margin of a cell and the target cells that fall there, so each side is shuffled once and nothing is joined cell by cell.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method {method}")
    source, spark = layer.grid, layer.cells.sparkSession
    ship(spark)
    kind = layer.cells.schema[value].dataType
    every = spark.range(target.rows * target.cols).select(F.floor(F.col("id") / target.cols).alias("row"), (F.col("id") % target.cols).alias("col"))
    x, y = convert(*target.centre(F.col("row"), F.col("col")), target.crs, source.crs)
    down, across = source.place(x, y)
    placed = every.select("row", "col", down.alias("_y"), across.alias("_x"))
    if method == "nearest":
        placed = placed.withColumns({"_y": F.floor(F.col("_y") + 0.5).cast("double"), "_x": F.floor(F.col("_x") + 0.5).cast("double")})
    within = lambda c, n: F.floor(F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(float(n))) / tile)
    placed = placed.withColumns({"_tr": within("_y", source.rows), "_tc": within("_x", source.cols)})
    tiles = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / tile), F.floor((F.col(c) - 1) / tile))))
    cells = layer.cells.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    dealt = cells.withColumn("_tr", tiles("_r")).withColumn("_tc", tiles("_c"))

    def fill(wanted: pa.Table, given: pa.Table) -> pa.Table:
        dense = np.full((tile + 2, tile + 2), np.nan)
        y, x = wanted.column("_y").to_numpy(), wanted.column("_x").to_numpy()
        if given.num_rows:
            top, side = given.column("_tr")[0].as_py() * tile, given.column("_tc")[0].as_py() * tile
            dense[given.column("_r").to_numpy() - top, given.column("_c").to_numpy() - side] = given.column("_v").to_numpy()
            r, c = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
            inside = (r >= top) & (r < top + tile) & (c >= side) & (c < side + tile)
            row, col = np.where(inside, r - top, tile + 1), np.where(inside, c - side, tile + 1)
            total, weight = np.zeros(len(y)), np.zeros(len(y))
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)) if method == "bilinear" else ((0, 0),):
                v = dense[np.minimum(row + i, tile + 1), np.minimum(col + j, tile + 1)]
                w = (1 - np.abs(y - (r + i))) * (1 - np.abs(x - (c + j)))
                w = np.where(np.isnan(v), 0.0, w)
                total, weight = total + np.nan_to_num(v) * w, weight + w
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.where(weight > 0, total / weight, np.nan)
        else:
            out = np.full(len(y), np.nan)
        return pa.table({"row": wanted.column("row"), "col": wanted.column("col"), value: pa.array(out, pa.float64(), mask=np.isnan(out))})

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField(value, T.DoubleType())])
    made = placed.groupBy("_tr", "_tc").cogroup(dealt.groupBy("_tr", "_tc")).applyInArrow(fill, schema)
    return Layer(made.withColumn(value, F.col(value).cast(kind)), target)


def described(spark: SparkSession, layers: dict[str, Layer]) -> DataFrame:
    """One row a layer: its grid, whether it is the first layer's, and what tells them apart."""
    first = next(iter(layers.values())).grid
    rows = [(name, *asdict(g.grid).values(), not first.differs(g.grid), ",".join(first.differs(g.grid))) for name, g in layers.items()]
    return spark.createDataFrame(rows, "layer string, x0 double, y0 double, dx double, dy double, rows long, cols long, crs string, aligned boolean, differs string")


def co_registered(layers: dict[str, Layer], values: dict[str, str] | None = None, methods: dict[str, str] | None = None) -> Layer:
    """Layers side by side by position, as columns of their names, on the first one's grid.

    values: the layers' value columns (`value` if not told). A layer on another grid is refused, or warped if `methods` tells how; so
    is a cell outside its layer's grid.
    """
    values, methods = values or {}, methods or {}
    grid, out = next(iter(layers.values())).grid, None
    for name, layer in layers.items():
        value = values.get(name, "value")
        if other := grid.differs(layer.grid):
            if name not in methods:
                raise ValueError(f"{name} is on another grid ({', '.join(other)})")
            layer = warp(layer, grid, value, methods[name])
        if outside(layer).head(1):
            raise ValueError(f"{name} has cells outside its grid")
        one = layer.cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).alias(name))
        out = one if out is None else out.join(one, ["row", "col"], "full")
    return Layer(out, grid)


def outside(layer: Layer) -> DataFrame:
    """Cells of a layer that its grid doesn't have."""
    g = layer.grid
    return layer.cells.where((F.col("row") < 0) | (F.col("row") >= g.rows) | (F.col("col") < 0) | (F.col("col") >= g.cols))


def adopted(layer: Layer, crs: str, assumed: str | None = None) -> Layer:
    """A layer whose grid has no projection takes the assumed one; one in another projection than crs is warped to its footprint there."""
    g = layer.grid
    if not g.crs:
        if not assumed:
            raise ValueError("the grid has no projection")
        g = Grid(**{**asdict(g), "crs": assumed})
    if g.crs == crs:
        return Layer(layer.cells, g)
    step = (30.0, 30.0) if crs == METRIC else (1 / 3600, 1 / 3600)
    return warp(Layer(layer.cells, g), footprint(layer.cells.sparkSession, g, crs, *step))
