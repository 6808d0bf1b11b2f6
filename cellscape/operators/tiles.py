"""Grid operators by tile: a task solves one tile in numpy, and only what crosses tile sides meets in a small table.

Cells are rows (row, col, ...). A tile is `tile` x `tile` cells, so a task's memory doesn't depend on the grid; the tables between
tiles have an entry a side cell at most, a few hundredths of the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.components import components, labels, staged
from cellscape.shipping import ship

TILE = 256
WIDE = 1 << 31
"""Cells are named row * WIDE + col where one number has to do."""


def cell_id(row: str, col: str):
    return F.col(row).cast("long") * WIDE + F.col(col).cast("long")


def _dealt(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})


def downstream(ptr: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, ends): each node's weight with all that flows into it, and the last node of its way; ptr is -1 at an end."""
    n = len(ptr)
    way, ends = np.append(np.where(ptr >= 0, ptr, n), n), np.where(ptr >= 0, ptr, np.arange(n))
    total = np.append(weight, 0).astype(np.int64)
    for _ in range(64):
        if (way == n).all():
            return total[:n], ends
        total = total + np.bincount(way, weights=total, minlength=n + 1).astype(np.int64)  # exact up to 2**53 cells
        total[n] = 0
        way, ends = way[way], ends[ends]
    raise ValueError("flow pointers form a cycle")


def _pointers(table: pa.Table, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id it flows to or -1, place of that in the table or -1) of a tile's cells."""
    row, col, to_row, to_col = (table.column(c).fill_null(-1).to_numpy() for c in ("row", "col", "to_row", "to_col"))
    here, there = row * WIDE + col, np.where((to_row < 0) | (to_col < 0), -1, to_row * WIDE + to_col)
    order = np.argsort(here)
    at = np.minimum(np.searchsorted(here, there, sorter=order), len(here) - 1)
    return here, there, np.where(here[order[at]] == there, order[at], -1)


def flow_accumulation(cells: DataFrame, tile: int = TILE, local_nodes: int | None = None) -> DataFrame:
    """(row, col, acc) from cells (row, col, to_row, to_col; the last two null where nothing flows out): cells upstream, itself included.

    First every tile adds up its own cells: what leaves it goes to a cell at the side of the next tile, and the way of every side cell
    ends in such an exit or inside. Those ways are the pointers of a small graph of side cells, weighted by what enters there. Then
    every tile adds up again with what enters it. Cells flow to one of their eight neighbours, rows and columns are not negative;
    pointers in a cycle are an error.
    """
    spark = cells.sparkSession
    ship(spark)
    own = staged(cells.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "to_row", "to_col")]), "flow-cells")
    dealt = _dealt(own, tile)

    def leaves(table: pa.Table) -> pa.Table:
        here, there, ptr = _pointers(table, tile)
        total, ends = downstream(ptr, np.ones(len(ptr), dtype=np.int64))
        out = np.flatnonzero((ptr < 0) & (there >= 0))
        row, col = here // WIDE % tile, here % WIDE % tile
        side = np.flatnonzero((row == 0) | (row == tile - 1) | (col == 0) | (col == tile - 1))
        return pa.table({"id": np.concatenate([there[out], here[side]]), "to": np.concatenate([np.full(len(out), -1), there[ends[side]]]), "acc": pa.array(np.concatenate([total[out], np.full(len(side), -1)]), mask=np.arange(len(out) + len(side)) >= len(out))})

    left = staged(dealt.groupBy("_tr", "_tc").applyInArrow(leaves, "id long, to long, acc long"), "flow-sides")
    entered = left.where(F.col("acc").isNotNull()).groupBy("id").agg(F.sum("acc").alias("acc"))
    ways = left.where(F.col("acc").isNull()).select("id", F.when(F.col("to") >= 0, F.col("to")).alias("to"))
    inflow = accumulated(entered.join(ways, "id").select("id", "to", "acc"), LOCAL_NODES if local_nodes is None else local_nodes)
    into = _dealt(inflow.select(F.floor(F.col("id") / WIDE).alias("row"), (F.col("id") % WIDE).alias("col"), F.col("acc").alias("more")), tile)

    def sums(table: pa.Table, more: pa.Table) -> pa.Table:
        weight = np.ones(table.num_rows, dtype=np.int64)
        if table.num_rows:
            here, _, ptr = _pointers(table, tile)
            order = np.argsort(here)
            entry = more.column("row").to_numpy() * WIDE + more.column("col").to_numpy()
            weight[order[np.searchsorted(here, entry, sorter=order)]] += more.column("more").to_numpy()
            weight, _ = downstream(ptr, weight)
        return pa.table({"row": table.column("row"), "col": table.column("col"), "acc": weight})

    return dealt.groupBy("_tr", "_tc").cogroup(into.groupBy("_tr", "_tc")).applyInArrow(sums, "row long, col long, acc long")


LOCAL_NODES = 500_000
"""Up to so many side cells one task adds up the graph between tiles; beyond it the rounds of pointer doubling do."""


def accumulated(graph: DataFrame, local_nodes: int) -> DataFrame:
    """(id, acc): each node's weight with all that flows into it, of nodes (id, to, acc)."""
    from cellscape.operators.grid import flow_accumulation as doubled

    now = staged(graph, "flow-graph")
    if now.count() > local_nodes:
        return doubled(now)

    def whole(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            here, there = table.column("id").to_numpy(), table.column("to").fill_null(-1).to_numpy()
            order = np.argsort(here)
            at = np.minimum(np.searchsorted(here, there, sorter=order), len(here) - 1)
            total, _ = downstream(np.where(here[order[at]] == there, order[at], -1), table.column("acc").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total)], names=["id", "acc"])

    return now.coalesce(1).mapInArrow(whole, "id long, acc long")


def zones(mask: DataFrame, connectivity: int = 8, keep: list[str] | None = None, tile: int = TILE, local_edges: int | None = None) -> DataFrame:
    """(row, col, zone, keep) of the cells of mask (row, col): connected components, named by their smallest cell in raster order.

    A task labels its tile; labels that touch across a tile's side are the edges of a small graph, whose components rename them.
    local_edges is that of `components`.
    """
    ship(mask.sparkSession)
    keep = keep or []
    cells = mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *keep)
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    dealt = _dealt(cells, tile)

    def label(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        n = len(row)
        spot = np.full((tile + 1, tile + 2), -1, dtype=np.int64)  # a margin below and at both sides
        r, c = row % tile, col % tile + 1
        spot[r, c] = np.arange(n)
        root = row * WIDE + col
        a, b = [], []
        for dr, dc in steps:
            near = spot[r + dr, c + dc]
            a.append(np.flatnonzero(near >= 0))
            b.append(near[near >= 0])
        nodes, roots = labels(root[np.concatenate(a)], root[np.concatenate(b)])
        order = np.argsort(root)
        out = root.copy()
        out[order[np.searchsorted(root, nodes, sorter=order)]] = roots
        return table.select(["row", "col", *keep]).append_column("_label", pa.array(out))

    labelled = staged(dealt.groupBy("_tr", "_tc").applyInArrow(label, T.StructType([*cells.schema.fields, T.StructField("_label", T.LongType())])), "zone-labels")
    at = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    side = _dealt(labelled.where(at("row") | at("col")).select("row", "col", "_label"), tile)
    near = side.select(F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps])).alias("_p"), F.col("_label").alias("a"), F.col("_tr").alias("_ar"), F.col("_tc").alias("_ac")).select("_p.*", "a", "_ar", "_ac")
    crossing = near.join(side, ["row", "col"]).where((F.col("_ar") != F.col("_tr")) | (F.col("_ac") != F.col("_tc"))).select("a", F.col("_label").alias("b"))
    found = components(crossing, **({} if local_edges is None else {"local_edges": local_edges})).withColumnsRenamed({"node": "_label", "component": "_root"})
    return labelled.join(found, "_label", "left").select("row", "col", F.coalesce("_root", "_label").alias("zone"), *keep)
