"""Warping against a plain warp point by point, and grids that differ."""

import math
from dataclasses import replace

import numpy as np
import pytest

from cellscape.functions.scores import to_utm
from cellscape.operators.georef import GEOGRAPHIC, METRIC, Grid, Layer, adopted, co_registered, convert, described, footprint, warp

SOURCE = Grid(79.0, 30.5, 0.0003, 0.00027, 40, 50, GEOGRAPHIC)


def plain(values, source, target, places, nearest):
    out = {}
    for (r, c), (x, y) in places.items():
        fr, fc = (source.y0 - y) / source.dy - 0.5, (x - source.x0) / source.dx - 0.5
        if nearest:
            out[(r, c)] = values.get((math.floor(fr + 0.5), math.floor(fc + 0.5)))
            continue
        total = weight = 0.0
        for i in (0, 1):
            for j in (0, 1):
                v = values.get((math.floor(fr) + i, math.floor(fc) + j))
                if v is not None:
                    w = (1 - abs(fr - math.floor(fr) - i)) * (1 - abs(fc - math.floor(fc) - j))
                    total, weight = total + v * w, weight + w
        out[(r, c)] = total / weight if weight > 0 else None
    return out


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(4)
    values = {(r, c): float(rng.random()) for r in range(40) for c in range(50) if rng.random() < 0.9}
    rows = [(r, c, values.get((r, c))) for r in range(40) for c in range(50)]
    return values, Layer(spark.createDataFrame(rows, "row int, col int, value double").repartition(3), SOURCE)


@pytest.mark.parametrize(("method", "tile"), [("bilinear", 7), ("nearest", 7), ("bilinear", 256)])
def test_warp_between_projections(spark, layer, method, tile):
    values, given = layer
    target = Grid(308000.0, 3375900.0, 33.0, 27.0, 50, 60, METRIC)
    from pyspark.sql import functions as F

    at = spark.range(3000).select(F.floor(F.col("id") / 60).alias("row"), (F.col("id") % 60).alias("col"))
    x, y = convert(*target.centre(F.col("row"), F.col("col")), METRIC, GEOGRAPHIC)
    places = {(r.row, r.col): (r.x, r.y) for r in at.select("row", "col", x.alias("x"), y.alias("y")).collect()}
    want = plain(values, SOURCE, target, places, method == "nearest")
    got = {(r.row, r.col): r.value for r in warp(given, target, method=method, tile=tile).cells.collect()}
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 1000
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


def test_warp_keeps_types_and_takes_nothing(spark):
    codes = spark.createDataFrame([(0, 0, 7), (0, 1, None)], "row int, col int, value int")
    same = Grid(0.0, 0.0, 30.0, 30.0, 1, 2)
    got = warp(Layer(codes, same), same, method="nearest").cells
    assert got.schema["value"].dataType.simpleString() == "int" and {(r.col, r.value) for r in got.collect()} == {(0, 7), (1, None)}
    assert [r.value for r in warp(Layer(codes.limit(0), same), same).cells.collect()] == [None, None]
    assert warp(Layer(codes, same), replace(same, rows=0)).cells.count() == 0
    with pytest.raises(ValueError, match="method"):
        warp(Layer(codes, same), same, method="cubic")
    with pytest.raises(ValueError, match="no way"):
        warp(Layer(codes, same), replace(same, crs="EPSG:3857"))


def test_footprint_covers_the_source(spark):
    from pyspark.sql import functions as F

    grid = footprint(spark, SOURCE, METRIC, 30.0, 30.0)
    x, y = to_utm(F.lit(SOURCE.x0) + F.col("c") * SOURCE.dx, F.lit(SOURCE.y0) - F.col("r") * SOURCE.dy)
    corners = spark.createDataFrame([(r, c) for r in (0, 40) for c in (0, 50)], "r int, c int").select(x.alias("x"), y.alias("y")).collect()
    assert grid.crs == METRIC and all(grid.x0 <= p.x <= grid.x0 + grid.cols * 30 and grid.y0 - grid.rows * 30 <= p.y <= grid.y0 for p in corners)
    assert grid.cols < 60 and grid.rows < 60


def test_grids_that_differ_are_refused_or_warped(spark, layer):
    grid = Grid(0.0, 0.0, 30.0, 30.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "row int, col int, value double")
    shifted = replace(grid, x0=30.0)
    told = {r.layer: (r.aligned, r.differs) for r in described(spark, {"a": Layer(cells, grid), "b": Layer(cells, shifted), "c": Layer(cells, replace(grid, crs=GEOGRAPHIC, dy=15.0)), "d": Layer(cells, replace(grid, x0=1e-6))}).collect()}
    assert told == {"a": (True, ""), "b": (False, "origin"), "c": (False, "crs,step"), "d": (True, "")}
    with pytest.raises(ValueError, match="origin"):
        co_registered({"a": Layer(cells, grid), "b": Layer(cells, shifted)})
    both = co_registered({"a": Layer(cells, grid), "b": Layer(cells, shifted)}, methods={"b": "nearest"}).cells
    assert {(r.row, r.col): (r.a, r.b) for r in both.collect()} == {(0, 0): (1.0, None), (0, 1): (2.0, 1.0), (1, 0): (3.0, None), (1, 1): (4.0, 3.0)}
    with pytest.raises(ValueError, match="outside"):
        co_registered({"a": Layer(cells, replace(grid, rows=1))})


def test_projection_is_adopted_or_converted(spark, layer):
    _, given = layer
    bare = Layer(given.cells, replace(SOURCE, crs=""))
    assert adopted(bare, GEOGRAPHIC, GEOGRAPHIC).grid == SOURCE
    moved = adopted(bare, METRIC, GEOGRAPHIC)
    assert moved.grid.crs == METRIC and moved.cells.where("value IS NOT NULL").count() > 1000
    with pytest.raises(ValueError, match="no projection"):
        adopted(bare, METRIC)
