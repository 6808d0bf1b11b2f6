"""Shortest paths part by part: a network is cut into parts of neighbouring nodes, a task walks through one part, and only the
nodes where a path enters a part meet in a table between the rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.components import staged
from cellscape.operators.ranking import row_numbers
from cellscape.shipping import ship

PART_NODES = 200_000
"""Nodes of a part: what a task holds at a time is these, their edges and one distance a node. Smaller parts are walked in bundles of so many nodes."""
KEYS = ["set", "weight", "bundle", "part", "node"]
REACHED = "set string, weight string, part long, node long, dist double"
FEW_BUNDLES = 1_000
TOGETHER = 16
STRIDE = 4.0
"""So many sets and weights are walked at once."""


def spread(u: np.ndarray, v: np.ndarray, w: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """The distances dist (infinite where none is known) carried along all directed edges u -> v of weights w >= 0, ends counted from 0."""
    return spread_all(u, v, w[None], np.zeros(1, dtype=np.int64), dist[None], np.flatnonzero(np.isfinite(dist)))[0]


def spread_all(u: np.ndarray, v: np.ndarray, w: np.ndarray, by: np.ndarray, dist: np.ndarray, front: np.ndarray) -> np.ndarray:
    """The same for several rows of dist at once, row k by the weights w[by[k]], beginning at the places front of the flat dist.

    Each step follows the edges of the nodes that were brought nearer and are within STRIDE mean edges of their row's nearest such node,
    until none is left: nodes further out wait, as most of them are brought nearer still. The rows take their steps together.
    """
    order = np.argsort(u, kind="stable")
    to, cost, edges, nodes = v[order], np.where(np.isnan(w), np.inf, w)[:, order].ravel(), len(u), dist.shape[1]
    degree = np.bincount(u, minlength=nodes)
    first = np.cumsum(degree) - degree
    finite = np.isfinite(cost)
    mean = np.array([c[f].mean() if f.any() else 0.0 for c, f in zip(cost.reshape(-1, edges), finite.reshape(-1, edges), strict=True)]) if edges else np.zeros(len(w))
    stride = STRIDE * mean[by]
    shape, dist = dist.shape, dist.ravel().copy()
    while len(front):
        row, far = front // nodes, dist[front]
        low = np.full(shape[0], np.inf)
        np.minimum.at(low, row, far)
        now = far <= low[row] + stride[row]
        waiting, front = front[~now], front[now]
        row, node = np.divmod(front, nodes)
        n = degree[node]
        edge = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
        new, end = np.repeat(dist[front], n) + cost[np.repeat(by[row] * edges, n) + edge], np.repeat(row * nodes, n) + to[edge]
        near = new < dist[end]
        np.minimum.at(dist, end[near], new[near])
        front = np.unique(np.concatenate((waiting, end[near])))
    return dist.reshape(shape)


def node_parts(nodes: DataFrame, x: Column, y: Column, part_nodes: int) -> DataFrame:
    """(node, part): parts of part_nodes nodes each, in strips of equal counts by x, each strip cut along y: as many strips as make parts
    about as wide as high, for the fewer parts a path crosses, the fewer rounds it takes.

    Nodes are numbered along the strips, so a part never has more however they lie; the last of a strip may reach into the next.
    """
    placed = staged(nodes.select("node", x.alias("x"), y.alias("y")), "part-nodes")
    parts = max(1.0, placed.count() / part_nodes)
    wide, high = (q[1] - q[0] if q else 0.0 for q in placed.approxQuantile(["x", "y"], [0.02, 0.98], 0.01))
    strips = max(1, round(min(parts, (parts * wide / high) ** 0.5 if high else parts if wide else 1)))
    cuts = placed.approxQuantile("x", [i / strips for i in range(1, strips)], 0.1 / strips) if strips > 1 else []
    strip = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("x")))
    numbered = row_numbers(placed.withColumn("strip", strip), ["strip", "y", "x", "node"], "rank")
    return staged(numbered.select("node", F.floor((F.col("rank") - 1) / F.lit(part_nodes)).cast("long").alias("part")), "parts")


def _groups(table: pa.Table):
    """(set, weight, the rows' places) of each set and weight of rows of REACHED."""
    codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("set", "weight")]
    names, weights = (c.dictionary.to_pylist() for c in codes)
    both = codes[0].indices.to_numpy().astype(np.int64) * len(weights) + codes[1].indices.to_numpy()
    order = np.argsort(both, kind="stable")
    ways, first = np.unique(both[order], return_index=True)
    yield from sorted(((names[k // len(weights)], weights[k % len(weights)], at) for k, at in zip(ways.tolist(), np.split(order, first[1:]), strict=True)), key=lambda g: g[:2])


def _walker(weights: list[str], leaving: bool):
    """A task's work on a bundle of parts: their edges in one row, and the distances known at some of their nodes.

    A way is walked inside its part only. What is leaving are the edges from nodes that this walk, begun at the new entries, brought
    nearer: what left by way of older entries went in the round that these were new.
    """

    def walk(packed: pa.Table, known: pa.Table) -> pa.Table:
        out = {c: [] for c in ("set", "weight", "part", "node", "dist")}
        if packed.num_rows and known.num_rows:
            edges = packed.column("edges").combine_chunks().flatten()
            edges = edges.take(pa.array(np.argsort(edges.field("u").to_numpy(), kind="stable")))
            u, v, own, to_part, *costs = (edges.field(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "part", "vpart", *[f"w{k}" for k in range(len(weights))]))
            nodes, first = np.unique(u, return_index=True)  # every edge is here in both directions, each at the part of its start
            inner = to_part == own
            at = np.searchsorted(nodes, u)
            a, b, over_from, over_to, over_part = at[inner], np.searchsorted(nodes, v[inner]), at[~inner], v[~inner], to_part[~inner]
            known_node, known_dist, known_new = (known.column(c).to_numpy() for c in ("node", "dist", "new"))
            places = np.searchsorted(nodes, known_node)
            cost, ways = np.stack(costs).astype(float), list(_groups(known))
            for some in (ways[k : k + TOGETHER] for k in range(0, len(ways), TOGETHER)):
                by = np.array([weights.index(weight) for _, weight, _ in some])
                before, fresh = np.full((len(some), len(nodes)), np.inf), []
                for k, (_, _, rows) in enumerate(some):
                    np.minimum.at(before[k], places[rows], known_dist[rows])
                    fresh.append(np.unique(places[rows][known_new[rows]]) if leaving else np.flatnonzero(np.isfinite(before[k])))
                reached = spread_all(a, b, cost[:, inner], by, before, np.concatenate([k * len(nodes) + f for k, f in enumerate(fresh)]))
                for k, (name, weight, _) in enumerate(some):
                    far = reached[k]
                    if leaving:
                        moved = far < before[k]
                        moved[fresh[k]] = True
                        used = moved[over_from]
                        over = far[over_from[used]] + cost[by[k]][~inner][used]
                        hit = np.isfinite(over)
                        ends, place = np.unique(over_to[used][hit], return_inverse=True)
                        least = np.full(len(ends), np.inf)
                        np.minimum.at(least, place, over[hit])
                        parts = np.zeros(len(ends), dtype=np.int64)
                        parts[place] = over_part[used][hit]
                    else:
                        hit = np.isfinite(far)
                        ends, least, parts = nodes[hit], far[hit], own[first][hit]
                    for c, value in zip(out, (np.full(len(ends), name, dtype=object), np.full(len(ends), weight, dtype=object), parts, ends, least), strict=True):
                        out[c].append(value)
        whole = {c: np.concatenate(x) if x else [] for c, x in out.items()}
        types = {"set": pa.string(), "weight": pa.string(), "part": pa.int64(), "node": pa.int64(), "dist": pa.float64()}
        return pa.table({c: pa.array(whole[c], types[c]) for c in whole})

    return walk


def paths_by_parts(edges: DataFrame, sources: DataFrame, weights: list[str], x: Column, y: Column, part_nodes: int = PART_NODES, max_rounds: int = 10_000) -> DataFrame:
    """(set, weight, node, dist) of undirected edges (u, v, weights) from sources (set, node): least sums of weights, for every node reached.

    x and y place the column `node`. A round takes the parts that a shorter way entered, walks through each from its new entries, and
    hands what leaves it to the next parts; it ends when no entry gets nearer. So rounds grow with the parts that a path crosses, not
    with its edges, and read the edges of the entered parts only. Parts of few nodes are walked by the bundle, up to PART_NODES nodes a
    task, each way inside its part all the same. Sums are taken along the path, as in one task, so both give the same numbers.
    Weights aren't negative; an edge with a null weight isn't there for it. Unsettled rounds are an error.
    """
    ship(edges.sparkSession)
    costs = [F.col(w).cast("double").alias(f"w{k}") for k, w in enumerate(weights)]
    both = edges.where(F.col("u") != F.col("v")).select("u", "v", *costs)
    both = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), *[f"w{k}" for k in range(len(weights))])), "parts-edges")
    part_of = node_parts(both.select(F.col("u").alias("node")).distinct(), x, y, part_nodes)
    bundle = F.floor(F.col("part") / max(1, PART_NODES // part_nodes)).cast("long").alias("bundle")
    known = both.join(part_of.select(F.col("node").alias("u"), "part"), "u").join(part_of.select(F.col("node").alias("v"), F.col("part").alias("vpart")), "v")
    packed = known.groupBy(bundle).agg(F.collect_list(F.struct("u", "v", "part", "vpart", *[f"w{k}" for k in range(len(weights))])).alias("edges"))
    packed = staged(packed.repartitionByRange("bundle"), "parts-packed")
    starts = staged(sources.select(F.col("set").cast("string").alias("set"), "node").distinct().withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights]))).join(part_of, "node", "left").select("set", "weight", bundle, "part", "node", F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "parts-starts")
    lone = starts.where("part IS NULL").select("set", "weight", "node", "dist")
    entries = staged(starts.where("part IS NOT NULL"), "parts-entries")

    def walked(rows: DataFrame, some: DataFrame, leaving: bool) -> DataFrame:
        return some.groupBy("bundle").cogroup(rows.groupBy("bundle")).applyInArrow(_walker(weights, leaving), REACHED)

    for _ in range(max_rounds):
        active = [r[0] for r in entries.where("new").select("bundle").distinct().collect()]  # a number for PART_NODES nodes
        if not active:
            break
        some = F.col("bundle").isin(active) if len(active) <= FEW_BUNDLES else F.lit(True)
        left = walked(entries.where(some), packed.where(some), True)
        none = F.lit(None).cast("double")
        met = entries.select(*KEYS, F.col("dist").alias("old"), none.alias("got")).unionByName(left.select("set", "weight", bundle, "part", "node", none.alias("old"), F.col("dist").alias("got")))
        least = met.groupBy(*KEYS).agg(F.min("old").alias("old"), F.min("got").alias("got"))
        nearer = F.coalesce(F.col("got") < F.col("old"), F.col("old").isNull())
        entries = staged(least.select(*KEYS, F.least("old", "got").alias("dist"), nearer.alias("new")), "parts-entries", instead_of=entries)
    else:
        raise RuntimeError(f"paths not settled after {max_rounds} rounds")
    return staged(walked(entries, packed, False).select("set", "weight", "node", "dist").unionByName(lone), "parts-dist")
