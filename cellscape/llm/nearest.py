"""Approximate nearest neighbours (operator 4): multiprobe p-stable hashing.

Each of `TABLES` tables hashes a vector by `HASHES` Gaussian projections, shifted and cut into cells of a width that is a share of
the typical distance to the k-th neighbour. That distance comes from a bounded sample (`FIT_ROWS` rows by a hash of the id); every
row is indexed. A query visits a table's buckets, its own and those perturbed by a cell either way in each projection, in order of the
estimated chance that a neighbour at that distance lies there, until these chances add up to `table_success`; with t tables a
neighbour is missed by all with a chance of about (1 - table_success) ** t.

Rows and queries meet by a shuffle on the bucket, so distances are computed of candidates only, and the best k of a query and task
go on. Buckets share tasks of about `TILE_ROWS` rows; a bucket with more rows, or more than `TILE_QUERIES` queries, is split into
tiles, each with a part of its rows and a part of its queries. Of equal vectors only those of the k + 1 smallest ids can be among a
query's nearest, so a group of copies is cut down to these before it is indexed. Buckets and candidates have no cap.

The typical distance only starts a query. It is settled once it has k candidates and the chance to have met a neighbour at its own
k-th exact distance, by the buckets it did visit, is that of the target. Else it visits the buckets that its own k-th distance asks
for besides (the k-th distance can only fall then, so one such round settles it); where the cells either way can't reach the target
at that distance, the list passes `WIDE_PROBES` a table, or fewer than k were found, it is compared with every row, in tiles too.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cellscape.llm.common import arrow_map, staged
from cellscape.llm.textarrays import mix64
from cellscape.shipping import ship

TABLES, HASHES, REACH = 4, 5, 1
TABLE_SUCCESS = 0.5
WIDTH_SHARE = 1.6
FIT_ROWS = 2_048
TILE_ROWS, TILE_QUERIES = 8_192, 2_048
WIDE_PROBES = 200
BROADCAST_TILES = 1_000_000
EVERY_ROW = -1
"""The key of the bucket that holds all rows; other keys are not negative."""
SEED = 71


class Hasher:
    """Projections, shifts and cell width; keys are exact for vectors of the fitted dimension."""

    def __init__(self, dim: int, distance: float, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim, self.tables, self.hashes, self.distance = dim, tables, hashes, distance
        self.width = WIDTH_SHARE * distance
        self.directions = rng.normal(size=(dim, tables * hashes))
        self.shift = rng.uniform(0, 1, size=tables * hashes)
        self.multiplier = rng.integers(1, 1 << 62, size=(tables, hashes)) * 2 + 1
        self.offsets = np.array(list(itertools.product(range(-REACH, REACH + 1), repeat=hashes)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions) / self.width + self.shift

    def keys(self, cell: np.ndarray) -> np.ndarray:
        """Bucket keys, [row, table], of integer cells [row, table * hashes]: 63 bits, so two buckets might share one, to no harm."""
        parts = cell.astype(np.int64).reshape(len(cell), self.tables, self.hashes)
        return self.mixed((parts * self.multiplier).sum(2), np.arange(self.tables))

    def mixed(self, sums: np.ndarray, table: np.ndarray | int) -> np.ndarray:
        return (mix64(sums.view(np.uint64) + np.uint64(self.dim) * np.uint64(TABLES + 1) + np.uint64(1) * np.asarray(table, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)

    def chances(self, x: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Log chance, [query, table, hash, cell either way], that a neighbour at the query's distance lies there."""
        at = self.cells(x)
        inside = (at - np.floor(at)).reshape(len(x), self.tables, self.hashes)
        edges = (np.arange(-REACH, REACH + 2) - inside[..., None]) * (self.width / np.maximum(distance, 1e-9 * self.distance))[:, None, None, None]
        return np.log(np.maximum(np.diff(0.5 * (1 + _erf(edges / math.sqrt(2))), axis=-1), 1e-300))

    def totals(self, log: np.ndarray) -> np.ndarray:
        """Chance of each of the offsets, for the log chances [hash, cell] of a query and table."""
        return np.exp(sum(log[j][self.offsets[:, j] + REACH] for j in range(self.hashes)))

    def visits(self, x: np.ndarray, success: float, distance: np.ndarray) -> list[list[np.ndarray] | None]:
        """For each query and table the offsets to visit, likeliest first; None for a query that can't reach success in every table."""
        out = []
        for log in self.chances(x, distance):
            mine = []
            for t in range(self.tables):
                total = self.totals(log[t])
                order = np.argsort(-total, kind="stable")
                mine.append(order[: int(np.searchsorted(np.cumsum(total[order]), success)) + 1])
            out.append(mine if all(len(v) < len(self.offsets) for v in mine) else None)
        return out

    def reached(self, x: np.ndarray, visits: list[list[np.ndarray]], distance: np.ndarray) -> np.ndarray:
        """The chance that a neighbour at the query's distance was met in some table, by the offsets visited."""
        return np.array([1 - np.prod([1 - min(1.0, self.totals(log[t])[v].sum()) for t, v in enumerate(mine)]) for log, mine in zip(self.chances(x, distance), visits, strict=True)])

    def probes(self, x: np.ndarray, visits: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """For each query and table the keys of the offsets to visit."""
        cell = np.floor(self.cells(x)).astype(np.int64).reshape(len(x), self.tables, self.hashes)
        base = (cell * self.multiplier).sum(2)
        moves = [(self.offsets * m).sum(1) for m in self.multiplier]
        return [[self.mixed(base[q, t] + moves[t][v], t) for t, v in enumerate(mine)] for q, mine in enumerate(visits)]


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function to about 1e-7 (rational approximation); only the order of visits depends on it."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that are not null or zero and whose components are all finite numbers."""
    kind = rows.schema["embedding"].dataType.elementType
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda v: v != 0))
    return some if isinstance(kind, (T.FloatType, T.DoubleType)) else some.withColumn("embedding", F.col("embedding").cast("array<double>"))


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def _by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length of vector."""
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, _matrix(col.take(pa.array(at)))


def fit_distance(rows: DataFrame, dim: int, k: int) -> float:
    """Median distance to the k-th neighbour among vectors of a length, over a bounded sample."""
    sample = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id", F.lit("neighbour sample")), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    x = _matrix(sample.column("embedding").combine_chunks())
    some = x[:128]
    d = np.sqrt(np.maximum((some**2).sum(1)[:, None] + (x**2).sum(1) - 2 * some @ x.T, 0))
    distance = float(np.median(np.sort(d, 1)[:, min(k, len(x) - 1)]))
    return distance if distance > 0 else float(np.sqrt((x**2).sum(1).mean()))


def closest(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query, all that tie with the k-th included; rows of its own id are none."""
    square, out = (x**2).sum(1), []
    step = max(1, (1 << 20) // max(1, len(x)))
    for begin in range(0, len(asked), step):
        q = asked[begin : begin + step]
        near = (q**2).sum(1)[:, None] + square - 2 * q @ x.T
        near[own[begin : begin + step, None] == ids] = np.inf
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
        bound = np.where(np.isfinite(bound), bound + 1e-9 * (1 + np.abs(bound) + (q**2).sum(1)), np.finfo(float).max)
        i, r = np.nonzero(near <= bound[:, None])
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], r[at : at + (1 << 16)]
            out.append((a + begin, b, np.sqrt(((x[b] - q[a]) ** 2).sum(1))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _first_k(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k first of their slot by score and id, each row once."""
    order = np.lexsort((row, vec_id, score, slot))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (slot[order][1:] != slot[order][:-1]) | (row[order][1:] != row[order][:-1])
    order = order[fresh]
    first = np.searchsorted(slot[order], slot[order])
    return order[np.arange(len(order)) - first < k]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first of each slot by score and id, each row once."""
    rank = F.row_number().over(W.partitionBy("slot").orderBy("score", "vec_id", "row"))
    return found.dropDuplicates(["slot", "row"]).withColumn("rank", rank).where(F.col("rank") <= k)


def met(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """slot, row, vec_id, score: for each query and task the k nearest of the rows that it meets in a bucket.

    indexed: row, vec_id, embedding, keys; asked: slot, vec_id, embedding, keys.
    """
    rows, queries = (df.select("*", F.explode("keys").alias("key")).drop("keys") for df in (indexed, asked))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).join(queries.groupBy("key").agg(F.count("*").alias("m")), "key")
    sizes = staged(sizes, "ann-buckets")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = max(1, 2 * -(-total // TILE_ROWS))
    tiles = sizes.where((F.col("n") > TILE_ROWS) | (F.col("m") > TILE_QUERIES)).select("key", F.ceil(F.col("n") / TILE_ROWS).alias("tr"), F.ceil(F.col("m") / TILE_QUERIES).alias("tq"))
    if tiles.count() <= BROADCAST_TILES:  # a checked size; beyond it the joins shuffle
        tiles = F.broadcast(tiles)

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        part, side = F.pmod(F.xxhash64(name), F.col(own)).cast("int"), {"tr": "r", "tq": "q"}
        large = df.join(tiles, "key").withColumn(side[own], part).withColumn(side[other], F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))).drop("tr", "tq").withColumn("task", F.col("key"))
        small = df.join(tiles.select("key"), "key", "left_anti").withColumns({"r": F.lit(-1), "q": F.lit(-1), "task": F.pmod("key", F.lit(shared))})
        return small.unionByName(large).groupBy("task", "r", "q")

    def meet(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and asked.num_rows:
            row_key, query_key = (t.column("key").to_numpy() for t in (rows, asked))
            by_row, by_query = np.argsort(row_key, kind="stable"), np.argsort(query_key, kind="stable")
            sorted_rows, sorted_queries = row_key[by_row], query_key[by_query]
            for key in np.intersect1d(row_key, query_key):
                i, j = (by[slice(np.searchsorted(ks, key), np.searchsorted(ks, key, side="right"))] for by, ks in ((by_row, sorted_rows), (by_query, sorted_queries)))
                mine, its = rows.take(pa.array(i)), asked.take(pa.array(j))
                slots, own, ids, row = its.column("slot").to_numpy(), its.column("vec_id").to_numpy(), mine.column("vec_id").to_numpy(), mine.column("row").to_numpy()
                lengths = {dim: (at, x) for dim, at, x in _by_length(mine.column("embedding").combine_chunks())}
                for dim, at, x in _by_length(its.column("embedding").combine_chunks()):
                    if dim in lengths:
                        here, vectors = lengths[dim]
                        q, r, d = closest(vectors, ids[here], x, own[at], k)
                        parts.append((slots[at][q], row[here][r], ids[here][r], d))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        slot, row, vec_id, score = columns
        kept = _first_k(slot, score, vec_id, row, k)
        return pa.table({"slot": slot[kept], "row": row[kept], "vec_id": vec_id[kept], "score": score[kept]})

    ship(indexed.sparkSession)
    return dealt(rows, "row", "tr", "tq").cogroup(dealt(queries, "slot", "tq", "tr")).applyInArrow(meet, "slot long, row long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, table_success: float = TABLE_SUCCESS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (fewer only if there are fewer other rows), ties to smaller ids.

    Both have vec_id and embedding; other columns are left aside. A query is no candidate of itself (of its vec_id). Vectors that
    are null, zero or hold null or non-finite components, and rows without id, take no part on either side; vectors of different
    lengths are no neighbours. A repeated vec_id is a candidate each time; an equal query asked twice counts once, and
    two vectors of one query id get k rows each, ranked by themselves. An empty table gives no rows.
    """
    spark = rows.sparkSession
    copies = valid_vectors(rows)
    copies = copies.withColumn("nth", F.row_number().over(W.partitionBy("embedding", "vec_id").orderBy("vec_id"))).where(F.col("nth") <= k)
    copies = copies.withColumn("nth", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    held = staged(copies.select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    lengths = [r[0] for r in held.select(F.size("embedding").alias("n")).distinct().collect()]
    hashers = spark.sparkContext.broadcast({dim: Hasher(dim, fit_distance(held, dim, k)) for dim in lengths})
    target = 1 - (1 - table_success) ** TABLES - 1e-9

    def lists(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for dim, at, x in _by_length(batch.column(1)):
                hasher = hashers.value[dim]
                for i, found in zip(at, hasher.keys(np.floor(hasher.cells(x))), strict=True):
                    keys[i] = np.unique(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(batch, keys)], names=["vec_id", "embedding", "row", "keys"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for dim, at, x in _by_length(batch.column(1)):
                if dim in hashers.value:
                    hasher = hashers.value[dim]
                    visits = hasher.visits(x, table_success, np.full(len(x), hasher.distance))
                    some = [i for i, v in enumerate(visits) if v is not None]
                    for i, found in zip(some, hasher.probes(x[some], [visits[i] for i in some]), strict=True):
                        keys[at[i]] = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(batch, keys)], names=["vec_id", "embedding", "slot", "keys"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            n, kth = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            for dim, at, x in _by_length(batch.column(1)):
                if dim not in hashers.value:
                    continue
                hasher = hashers.value[dim]
                for i in np.flatnonzero(n[at] < k):
                    keys[at[i]] = np.array([EVERY_ROW])
                full = np.flatnonzero(n[at] >= k)
                if not len(full):
                    continue
                x, at, own = x[full], at[full], np.asarray(kth[at[full]], dtype=np.float64)
                visits = hasher.visits(x, table_success, np.full(len(x), hasher.distance))
                before = [v or [np.zeros(0, np.int64)] * TABLES for v in visits]
                open_ = np.flatnonzero(hasher.reached(x, before, own) < target)
                for i, wide in zip(open_, hasher.visits(x[open_], table_success, own[open_]), strict=True):
                    more = [np.setdiff1d(w, v) for w, v in zip(wide or [], before[i], strict=False)]
                    keys[at[i]] = np.unique(np.concatenate(hasher.probes(x[i : i + 1], [more])[0])) if wide and max(map(len, wide)) <= WIDE_PROBES else np.array([EVERY_ROW])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(batch, keys)], names=["vec_id", "embedding", "slot", "keys"])

    kind = held.schema["embedding"].dataType.simpleString()
    indexed = staged(arrow_map(held.select("vec_id", "embedding", "row"), index, f"vec_id long, embedding {kind}, row long, keys array<long>"), "ann-index")
    asked = staged(valid_vectors(queries).dropDuplicates(["vec_id", "embedding"]).withColumn("slot", F.monotonically_increasing_id()), "ann-queries")
    kind = asked.schema["embedding"].dataType.simpleString()
    probing = staged(arrow_map(asked, start, f"vec_id long, embedding {kind}, slot long, keys array<long>"), "ann-probes")
    one = staged(_best(met(indexed, probing, k), k), "ann-found")
    state = asked.join(one.groupBy("slot").agg(F.count("*").alias("n"), F.max("score").alias("kth")), "slot", "left").select("vec_id", "embedding", "slot", F.coalesce("n", F.lit(0)).alias("n"), "kth")
    again = staged(arrow_map(state, widen, f"vec_id long, embedding {kind}, slot long, keys array<long>").where(F.size("keys") > 0), "ann-widened")
    found = [one.drop("rank")]
    every = F.array_contains("keys", F.lit(EVERY_ROW).cast("long"))
    for part, table in ((again.where(~every), indexed), (again.where(every), indexed.withColumn("keys", F.array(F.lit(EVERY_ROW).cast("long"))))):
        if part.head(1):
            found.append(met(table, part, k))
    best = _best(reduce(DataFrame.unionByName, found), k)
    return best.join(asked.select("slot", F.col("vec_id").alias("query_id")), "slot").select("query_id", "rank", "vec_id", "score")
