"""Cell-table operators: gradients, flow, zones. A grid is rows (row, col, value); NoData is null; the grid is dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.components import staged
from cellscape.operators.ranking import row_numbers
from cellscape.operators.tiles import zones as zones

SQRT2 = 2.0**0.5
# Neighbour order and codes, E to NE clockwise.
NEIGHBOURS = [(0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32), (-1, 0, 64), (-1, 1, 128)]


TILE = 256
"""Cells along a tile's side; a tile with the cells around it is what one window sees."""


def _tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """cells dealt by tile, with _tr and _tc: a cell at a tile's side is in the neighbours too, so one shuffle serves all windows."""
    sides = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1)])))
    return cells.withColumn("_tr", sides("row")).withColumn("_tc", sides("col")).repartition("_tr", "_tc")


def _own(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """The cells in their own tiles."""
    return cells.where((F.floor(F.col("row") / tile) == F.col("_tr")) & (F.floor(F.col("col") / tile) == F.col("_tc"))).drop("_tr", "_tc")


def _windows() -> tuple[W, W]:
    """Along the rows and down the columns of a tile."""
    return W.partitionBy("_tr", "_tc", "row").orderBy("col"), W.partitionBy("_tr", "_tc", "col").orderBy("row")


def gradients(cells: DataFrame, value: str = "elev", cell: float = 30.0) -> DataFrame:
    """Adds gx (per column) and gy (per row): central differences, one-sided at the array's edge; null beside a null cell."""
    along, down = _windows()

    def one(w: W, at: str) -> Column:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        first, last = F.lag(at).over(w).isNull(), F.lead(at).over(w).isNull()
        return F.when(first, (after - F.col(value)) / cell).when(last, (F.col(value) - before) / cell).otherwise((after - before) / (2 * cell))

    return _own(_tiled(cells).withColumn("gx", one(along, "col")).withColumn("gy", one(down, "row")))


def slope(cells: DataFrame, value: str = "elev", cell: float = 30.0) -> DataFrame:
    """G1: slope in degrees."""
    return gradients(cells, value, cell).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)))).drop("gx", "gy")


def aspect(cells: DataFrame, value: str = "elev", cell: float = 30.0, downslope: bool = False) -> DataFrame:
    """Azimuth in degrees, -1 where flat, null on null cells. Uphill by default; downslope turns it by 180."""
    turn = 180.0 if downslope else 0.0
    azimuth = F.pmod(90.0 - F.degrees(F.atan2(-F.col("gy"), F.col("gx"))) + turn, F.lit(360.0))
    flat = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) < 1e-8
    some = F.col(value).isNotNull() & F.col("gx").isNotNull() & F.col("gy").isNotNull()
    return gradients(cells, value, cell).withColumn("aspect", F.when(some, F.when(flat, -1.0).otherwise(azimuth))).drop("gx", "gy")


def flow_direction(cells: DataFrame, value: str = "elev", cell: float = 30.0) -> DataFrame:
    """D8 code of the steepest positive drop (ties to the first neighbour in order), 0 if none, null on null cells; and the
    target cell. Two windows give each cell its eight neighbours: no self-join, and one shuffle by tile."""
    along, down = _windows()
    side = lambda f: F.when(F.abs(f("col").over(along) - F.col("col")) == 1, f(value).over(along))
    triple = _tiled(cells).withColumn("_t", F.array(side(F.lag), F.col(value), side(F.lead)))
    beside = lambda f: F.when(F.abs(f("row").over(down) - F.col("row")) == 1, f("_t").over(down))
    near = triple.withColumns({"_up": beside(F.lag), "_down": beside(F.lead)})
    name = {-1: "_up", 0: "_t", 1: "_down"}
    drops = [F.struct(((F.col(value) - F.get(F.col(name[dr]), F.lit(dc + 1))) / (cell * (SQRT2 if dr and dc else 1.0))).alias("drop"), F.lit(-k).alias("order"), F.lit(code).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc, code) in enumerate(NEIGHBOURS)]
    best = F.array_max(F.filter(F.array(*drops), lambda s: s["drop"] > 0))
    out = _own(near.withColumn("_b", best).drop("_t", "_up", "_down"))
    code = F.when(F.col(value).isNotNull(), F.coalesce("_b.code", F.lit(0)))
    return out.withColumns({"flow_dir": code, "to_row": F.col("row") + F.col("_b.dr"), "to_col": F.col("col") + F.col("_b.dc")}).drop("_b")


def flow_accumulation(pointers: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, acc) from (id, to): the number of ids upstream, itself included, or the sum of their weights `acc` if there are any; for
    pointers of any kind (tiles.flow_accumulation is for cells that flow to their neighbours). Pointer doubling: each round doubles the length of
    the paths it has followed, so rounds grow with the logarithm of the longest path. Pointers must not form cycles; too many
    rounds are an error. A pointer that reached an outlet is done after one more sum, so outlets are never a key of the jump's join.
    """
    pointers = pointers.select("id", "to", (F.col("acc") if "acc" in pointers.columns else F.lit(1)).cast("long").alias("acc"))
    outlets = pointers.where(F.col("to").isNull()).select(F.col("id").alias("to"), F.lit(True).alias("last"))
    ready = pointers.where(F.col("to").isNotNull()).join(outlets, "to", "left").select("id", "to", "acc", F.coalesce("last", F.lit(False)).alias("last"))
    ready = ready.unionByName(pointers.where(F.col("to").isNull()).select("id", "to", "acc", F.lit(True).alias("last")))
    now = staged(ready, "flow")
    for _ in range(max_rounds):
        open_ = F.col("to").isNotNull()
        if not now.where(open_).head(1):
            return now.select("id", "acc")
        gained = now.where(open_).groupBy("to").agg(F.sum("acc").alias("more")).withColumnRenamed("to", "id")
        moving, rest = now.where(open_ & ~F.col("last")), now.where(~open_ | F.col("last"))
        after = now.where(open_).select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("last").alias("ends"))
        jumped = moving.join(after, "to", "left").select("id", F.col("next").alias("to"), F.coalesce("ends", F.lit(False)).alias("last"), "acc")
        jumped = jumped.unionByName(rest.select("id", F.lit(None).cast(now.schema["to"].dataType).alias("to"), "last", "acc"))
        now = staged(jumped.join(gained, "id", "left").select("id", "to", "last", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "flow", instead_of=now)
    raise RuntimeError(f"pointers not at an end after {max_rounds} rounds: a cycle?")


def wetness(acc: Column, slope_deg: Column, cell: float = 30.0) -> Column:
    """Topographic wetness index."""
    return F.log(acc * cell / F.greatest(F.tan(F.radians(F.greatest(slope_deg, F.lit(0.1)))), F.lit(1e-4)))


def mean(layer: str, digits: int) -> Column:
    """The mean of a group, rounded half to even. Values count to six more decimals, so that their sum is exact: a sum of doubles depends
    on the order in which rows arrive, and a mean half-way between two roundings, as of 16 scores of four decimals, would go up in one
    run and down in the next. If some reach 1e9 or aren't finite, a group's values count as doubles."""
    exact = F.bround(F.avg(F.col(layer).try_cast(f"decimal({digits + 15},{digits + 6})")), digits).cast("double")
    return F.when(F.max(F.abs(layer)) < 1e9, exact).otherwise(F.bround(F.avg(layer), digits))


def zone_summary(cells: DataFrame, cell_area: float, stats: dict[str, str], digits: int = 6) -> DataFrame:
    """Size, area, bounds, centroid and mean, max and min of layers by zone; stats maps layer to prefix."""
    aggs = [F.count("*").alias("pixel_count"), (F.count("*") * cell_area).alias("area_m2"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "min"), (F.max, "max"))], F.avg("row").alias("mean_row"), F.avg("col").alias("mean_col")]
    for layer, prefix in stats.items():
        aggs += [mean(layer, digits).alias(f"mean_{prefix}"), *[F.bround(f(layer), digits).alias(f"{n}_{prefix}") for f, n in ((F.max, "max"), (F.min, "min"))]]
    return cells.groupBy("zone").agg(*aggs)


def majority(cells: DataFrame, code: str = "code") -> DataFrame:
    """Each zone's most frequent code (0 ignored, the smaller on ties)."""
    counts = cells.where(F.col(code).isNotNull() & (F.col(code) != 0)).groupBy("zone", code).count()
    return counts.groupBy("zone").agg(F.max_by(code, F.struct("count", -F.col(code))).alias("dominant_code"))


def dilate(mask: DataFrame, steps: int) -> DataFrame:
    """Cells within `steps` of the mask by rows plus columns, the mask left out."""
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-steps, steps + 1) for dc in range(-steps + abs(dr), steps - abs(dr) + 1)])
    around = mask.select("row", "col", F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    return around.join(mask.select("row", "col"), ["row", "col"], "left_anti")


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Sides of a zone's cells whose neighbour isn't in the zone: (zone, row, col, side)."""
    sides = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n).alias("side")) for dr, dc, n in ((0, 1, "E"), (1, 0, "S"), (0, -1, "W"), (-1, 0, "N"))])
    out = cells.select("zone", "row", "col", F.explode(sides).alias("s")).select("zone", "row", "col", "s.side", (F.col("row") + F.col("s.dr")).alias("_r"), (F.col("col") + F.col("s.dc")).alias("_c"))
    inside = cells.select("zone", F.col("row").alias("_r"), F.col("col").alias("_c"))
    return out.join(inside, ["zone", "_r", "_c"], "left_anti").select("zone", "row", "col", "side")


def rank_zones(summary: DataFrame, prefix: str = "RZ") -> DataFrame:
    """Rank by mean score, max score, area, then raster order; id from the rank."""
    ranked = row_numbers(summary, [F.desc("mean_score"), F.desc("max_score"), F.desc("area_m2"), F.col("zone")])
    return ranked.withColumn("zone_id", F.format_string(f"{prefix}-%03d", "rank"))


def kept_zones(summary: DataFrame, least_m2: float, most_m2: float | None = None) -> DataFrame:
    """zones of at least a mapping unit, and at most another."""
    return summary.where((F.col("area_m2") >= least_m2) & ((F.col("area_m2") <= most_m2) if most_m2 is not None else F.lit(True)))


def painted(zone_cells: DataFrame, ranked: DataFrame) -> DataFrame:
    """Zone cells of ranked zones with their rank (zone_rank)."""
    return zone_cells.join(ranked.select("zone", F.col("rank").alias("zone_rank")), "zone")


def rings(edges: DataFrame, cell: float = 30.0) -> DataFrame:
    """(zone, ring, points) of a zone's boundary sides (boundary_edges): closed rings of corner points, the zone on their right.

    Sides become directed corner to corner steps; at a corner where two rings touch the walk turns right first, so diagonal
    neighbours stay apart. Rings are stitched a zone at a time, on the zone's boundary alone.
    """

    def stitch(pdf):
        import pandas as pd

        starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, col, side in zip(pdf["row"], pdf["col"], pdf["side"], strict=True):
            a, b = {"N": ((row, col), (row, col + 1)), "E": ((row, col + 1), (row + 1, col + 1)), "S": ((row + 1, col + 1), (row + 1, col)), "W": ((row + 1, col), (row, col))}[side]
            starts.setdefault(a, []).append(b)
        out = []
        while starts:
            at = begin = min(starts)
            walk, before = [begin], None
            while True:
                options = starts[at]
                if before is None or len(options) == 1:
                    nxt = min(options)
                else:  # turn right: (dr, dc) -> (dc, -dr)
                    right = (at[0] + before[1], at[1] - before[0])
                    nxt = right if right in options else min(options)
                options.remove(nxt)
                if not options:
                    del starts[at]
                before, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
                walk.append(at)
                if at == begin:
                    break
            out.append((int(pdf["zone"].iloc[0]), len(out), [{"x": c * cell, "y": -r * cell} for r, c in walk]))
        return pd.DataFrame(out, columns=["zone", "ring", "points"])

    return edges.groupBy("zone").applyInPandas(stitch, "zone long, ring int, points array<struct<x: double, y: double>>")


def first_cells(cells: DataFrame, predicates: dict[str, Column], columns: list[str]) -> DataFrame:
    """The first cell in raster order that satisfies each predicate: (name, row, col, columns)."""
    marked = cells.select("row", "col", *columns, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in predicates.items()]))).alias("name"))
    return marked.groupBy("name").agg(F.min(F.struct("row", "col", *columns)).alias("c")).select("name", "c.*")


def resample(cells: DataFrame, value: str, rows: int, cols: int, cell: float, source_cell: float, method: str = "bilinear") -> DataFrame:
    """(row, col, value) on a grid of rows x cols cells, both grids with their top left corner at (0, 0).

    bilinear: the mean of the four source cells about a target's centre by their closeness, over those that aren't NoData.
    nearest: the source cell that holds the centre. A target that no valid source cell reaches is null.
    """
    spark = cells.sparkSession
    target = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    at = lambda c: (F.col(c) + 0.5) * cell / source_cell
    source = cells.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col(value).alias("_v"))
    if method == "nearest":
        placed = target.withColumns({"_r": F.floor(at("row")), "_c": F.floor(at("col"))})
        return placed.join(source, ["_r", "_c"], "left").select("row", "col", F.col("_v").alias(value))
    placed = target.withColumns({"_y": at("row") - 0.5, "_x": at("col") - 0.5})
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    around = placed.withColumn("_k", corners).withColumns({"_r": F.floor("_y") + F.col("_k.i"), "_c": F.floor("_x") + F.col("_k.j")})
    weight = (1 - F.abs(F.col("_y") - F.col("_r"))) * (1 - F.abs(F.col("_x") - F.col("_c")))
    met = around.withColumn("_w", weight).join(source, ["_r", "_c"], "left").withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(0.0))
    return met.groupBy("row", "col").agg(F.try_divide(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_w")), F.sum("_w")).alias(value))
