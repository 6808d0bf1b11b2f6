"""N-gram Jaccard join (operator 3): grouped prefix join over 5-word shingle sets.

Two documents link when 100 * |A and B| >= 75 * |A or B|. Then their prefixes share a shingle, a prefix being the first
n - ceil(3 n / 4) + 1 shingles of a set in one order for all: shingles of large document frequency last, the others by hash.

1. Counting. Frequencies are counted by 32-bit hash over all documents. Tasks deal sorted runs of them, delta coded, over hash
   ranges; a range reports those of at least `FREQUENT`. This list (the `MOST_FREQUENT` most frequent, a bound) is broadcast. It
   sets the order only: the join is exact under any order.
2. Grouping. Documents of one shingle set (two 64-bit digests and the size) are one group, so they share prefix and size;
   the join sees groups. Copies are counted and expanded by an equi-join at the end, never paired.
3. Filtering. Prefix shingles are dealt by hash range, each with its place in the set's order. At the first shingle that two sets
   share, they can have no more in common than what lies from there on in either; a shingle of up to `SMALL_RUN` groups gives all
   their pairs that pass this and the size filter. A longer run gives a chain (neighbours by size) and is kept for step 5.
4. Verifying. A pair's sets differ in at least as many shingles as their parity bitmaps (`BITS` bits: the parity of the shingles of
   each hash value) differ in bits, which refutes most false pairs. The two whole texts of each other pair are brought together
   and their sets compared exactly.
5. Long runs whose groups the links so far leave in several components give the pairs across components that sizes, places and
   bitmaps don't refute, which are verified too. Groups already connected need no further pair, as the result is connectivity; groups
   of a run's largest component aren't met with each other. A run is cut by size band (only neighbouring bands can link) and then
   into tiles of `TILE` by `TILE` groups, so no task has a whole run. No link between components can be lost.

Ranges are `4 x spark.sql.shuffle.partitions` or more, so a range's share falls as the partitions grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.components import components
from cellscape.llm.common import arrow_groups, arrow_map, shuffle_partitions, staged
from cellscape.llm.textarrays import distinct_sets, mix64, shingle_hashes, slices, words

SHINGLE = 5
FREQUENT = 16
MOST_FREQUENT = 2_000_000
SMALL_RUN = 8
BITS = 1024
FLUSH = 1_000_000
BROADCAST_IDS = 2_000_000
TILE, FIRSTS = 1_024, 16
BAND = 1.34
"""Sizes of a link differ by a factor of 4/3 at most, so by one band."""
LONG = T.LongType()


def _ranges(spark: SparkSession) -> int:
    """Hash ranges, a power of two."""
    return 1 << max(8, (4 * shuffle_partitions(spark) - 1).bit_length())


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingle_hashes(words(col), SHINGLE))


def _digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(values + np.uint64(salt)))))
        out.append(mix64(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _bitmaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BITS parity bits of each row's set, as 64-bit integers."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bit = (mix64(values + np.uint64(0x5EED)) & np.uint64(BITS - 1)).astype(np.int64)
    odd = (np.bincount(rows * BITS + bit, minlength=(len(first) - 1) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(-1, BITS // 64)


def _not_refuted(n_a: str, n_b: str, map_a: str, map_b: str) -> Column:
    """Whether sizes and bitmaps allow a link: the sets differ in at most (|a| + |b|) / 7 shingles."""
    low, high = F.least(n_a, n_b), F.greatest(n_a, n_b)
    differ = sum((F.bit_count(F.get(map_a, F.lit(i)).bitwiseXOR(F.get(map_b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return (4 * low >= 3 * high) & (7 * differ <= F.col(n_a) + F.col(n_b))


def _reaches(n: str, place: str, other: str) -> Column:
    """Whether what a set of n has from `place` on is enough for a link with a set of `other`."""
    return 7 * (F.col(n) - F.col(place)) >= 3 * (F.col(n) + F.col(other))


def deltas(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys (repeats allowed) as 16-bit steps; 65535 means a step of 65535 without a key."""
    step = np.diff(keys.astype(np.int64), prepend=0)
    out = np.full(int((step // 65535 + 1).sum()), 65535, dtype=np.uint16)
    out[np.cumsum(step // 65535 + 1) - 1] = step % 65535
    return out.tobytes()


def undeltas(raw: bytes) -> np.ndarray:
    step = np.frombuffer(raw, dtype=np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of frequent shingles, sorted, and their document frequencies."""
    ranges = _ranges(docs.sparkSession)
    shift = 32 - (ranges.bit_length() - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            bound = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
            some = np.flatnonzero(np.diff(bound))
            low = keys.astype(np.int64) & ((1 << shift) - 1)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([deltas(low[bound[r] : bound[r + 1]]) for r in some], pa.binary())], names=["r", "keys"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append((_sets(part.column(0))[0] >> np.uint64(32)).astype(np.uint32))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
                    held = []
        if held:
            yield flush()

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, keys = 0, []
        for batch in group:
            for row in range(batch.num_rows):
                r = batch.column(0)[row].as_py()
                keys.append(undeltas(batch.column(1)[row].as_py()))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        some = n >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array((key[some] + (r << shift)).astype(np.int64)), pa.array(n[some].astype(np.int64))], names=["key", "n"])

    counted = arrow_groups(arrow_map(docs.select("text"), deal, "r int, keys binary"), ["r"], count, "key long, n long")
    top = counted.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    key, n = top.column("key").to_numpy().astype(np.uint32), top.column("n").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def _prefix(values: np.ndarray, first: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, place in the row's order) of every row's prefix."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    weight = np.zeros(len(values), dtype=np.int64)
    if len(key):
        at = np.minimum(np.searchsorted(key, high), len(key) - 1)
        weight = np.where(key[at] == high, n[at], 0)
    size = np.diff(first)
    length = np.where(size > 0, size - -(-3 * size // 4) + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    common = np.flatnonzero(np.bincount(row, weights=weight > 0, minlength=len(size)) > 0)
    place = np.arange(len(values)) - first[row]
    if len(common):  # rows are sorted by hash as they are; only those with frequent shingles are ordered anew
        mine = np.isin(row, common)
        order = np.lexsort((values[mine], weight[mine], row[mine]))
        values = values.copy()
        values[mine] = values[mine][order]
    keep = place < length[row]
    return values[keep], row[keep], place[keep]


def groups_and_postings(docs: DataFrame, key: np.ndarray, n: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """rows (row_key, doc_id, n, d1, d2, bits) of every document, and prefix postings dealt by range as packed arrays."""
    spark = docs.sparkSession
    ranges = _ranges(spark)
    bits = ranges.bit_length() - 1
    shared = spark.sparkContext.broadcast((key, n))
    row_type = T.StructType([T.StructField("row_key", LONG), T.StructField("doc_id", LONG), T.StructField("n", LONG), T.StructField("d1", LONG), T.StructField("d2", LONG), T.StructField("bits", T.ArrayType(LONG))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = _sets(part.column(2))
                d1, d2 = _digests(values, first)
                flat = _bitmaps(values, first)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(d1), pa.array(d2), bits], names=row_type.names)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            token, group, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((group, token))
            token, group, size, place = token[order], group[order], size[order], place[order]
            fresh = np.ones(len(token), dtype=bool)  # a group's copies in this task post once
            fresh[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
            token, group, size, place = token[fresh], group[fresh], size[fresh], place[fresh]
            bound = np.searchsorted(token, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits))
            bound = np.append(bound, len(token))
            some = np.flatnonzero(np.diff(bound))
            short = (token >> np.uint64(32 - bits)).astype(np.uint32)  # with the range, the first 32 + bits bits
            column = lambda x: pa.array([x[bound[r] : bound[r + 1]].tobytes() for r in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), column(short), column(group), column(size), column(place)], names=["r", "tokens", "groups", "sizes", "places"])

        for batch in batches:
            for part in slices(batch, "text"):
                values, first = _sets(part.column(0))
                token, row, place = _prefix(values, first, *shared.value)
                size = np.diff(first)[row]
                held.append((token, _digests(values, first)[0][row], size.astype(np.uint32), place.astype(np.uint32)))
                if sum(len(h[0]) for h in held) >= FLUSH // 2:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return arrow_map(docs.select("row_key", "doc_id", "text"), digest, row_type), arrow_map(docs.select("text"), post, "r int, tokens binary, groups binary, sizes binary, places binary")


def _passes(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The size filter, for sizes small <= large."""
    return 4 * small >= 3 * large


def _neighbours(order: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries next to each other in `order` within a run."""
    same = run[order][1:] == run[order][:-1]
    return order[:-1][same], order[1:][same]


def _chain(run: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries: neighbours by size (and group) in their run."""
    return _neighbours(np.lexsort((group, size, run)), run)


def _pair_rows(group: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Distinct (smaller digest, larger digest) of pairs of different groups that pass the filters by size and, if given, place."""
    fits = (group[a] != group[b]) & _passes(np.minimum(size[a], size[b]), np.maximum(size[a], size[b]))
    if place is not None:
        fits &= 7 * np.minimum(size[a] - place[a], size[b] - place[b]) >= 3 * (size[a] + size[b])
    low, high = np.minimum(group[a[fits]], group[b[fits]]), np.maximum(group[a[fits]], group[b[fits]])
    return np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), dtype=np.int64)


def _all_pairs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of short runs; bounds are the runs' first entries and the end."""
    a, b = [], []
    size = np.diff(bounds)
    for gap in range(1, int(size.max(initial=1))):
        for_run = np.repeat(np.arange(len(size)), np.maximum(size - gap, 0))
        at = np.arange(len(for_run)) - np.searchsorted(for_run, for_run) + bounds[:-1][for_run]
        a.append(at)
        b.append(at + gap)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def candidate_pairs(postings: DataFrame) -> DataFrame:
    """kind 0: pairs (a, b) of group digests; kind 1: entries (a = token, b = group, place) of long runs."""

    def meet(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, parts = 0, []
        for batch in group:
            for row in range(batch.num_rows):
                r = batch.column(0)[row].as_py()
                parts.append(tuple(np.frombuffer(batch.column(i)[row].as_py(), dtype=t) for i, t in ((1, np.uint32), (2, np.int64), (3, np.uint32), (4, np.uint32))))
        token, gid, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        size, place = size.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((gid, token))
        token, gid, size, place = token[order], gid[order], size[order], place[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
        token, gid, size, place = token[fresh], gid[fresh], size[fresh], place[fresh]
        start = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
        length = np.diff(np.append(start, len(token)))
        per = np.repeat(length, length)
        short, long = (per > 1) & (per <= SMALL_RUN), per > SMALL_RUN
        shortened = length[(length > 1) & (length <= SMALL_RUN)]
        found = [_pair_rows(gid[short], size[short], *_all_pairs(np.concatenate(([0], np.cumsum(shortened)))), place[short])]
        if long.any():
            found.append(_pair_rows(gid[long], size[long], *_chain(token[long], gid[long], size[long])))
        pairs = np.unique(np.concatenate(found), axis=0)
        left = token[long].astype(np.int64) + (r << 32)
        kind = np.concatenate((np.zeros(len(pairs), dtype=np.int32), np.ones(len(left), dtype=np.int32)))
        columns = np.concatenate((pairs[:, 0], left)), np.concatenate((pairs[:, 1], gid[long])), np.concatenate((np.zeros(len(pairs), dtype=np.int64), place[long]))
        yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "a", "b", "place"])

    return arrow_groups(postings, ["r"], meet, "kind int, a long, b long, place long")


def _texts(docs: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """group, d1, text (compressed) of the wanted digests' groups, one text a group however often its row is repeated."""
    ids = groups.join(wanted, "d1", "left_semi").select(F.col("rep").alias("row_key"), "group", F.col("d1").alias("_1"), F.col("d2").alias("_2"))
    ids = staged(ids, "jaccard-wanted")
    if ids.count() <= BROADCAST_IDS:  # a checked size; beyond it the join shuffles
        ids = F.broadcast(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                d1, d2 = _digests(*_sets(part.column(4)))
                right = pa.array((d1 == part.column(2).to_numpy()) & (d2 == part.column(3).to_numpy()))
                part = part.filter(right)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([press.compress((t or "").encode()) for t in part.column(4).to_pylist()], pa.binary())], names=["group", "d1", "packed"])

    return arrow_map(docs.join(ids, "row_key").select("row_key", "group", "_1", "_2", "text"), pack, "group long, d1 long, packed binary").groupBy("group").agg(F.first("d1").alias("d1"), F.first("packed").alias("packed"))


def verified(docs: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) of groups among candidate pairs (a, b) of digests, each decided on the whole texts."""
    known = groups.select("d1", "n", "bits", "group")
    side = lambda k: known.select(F.col("d1").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"), F.col("group").alias(f"g_{k}"))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_not_refuted("n_a", "n_b", "bits_a", "bits_b") & (F.col("g_a") != F.col("g_b")))
    pairs = staged(pairs.select("a", "b").distinct(), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct()
    texts = staged(_texts(docs, groups, wanted), "jaccard-texts")
    left = texts.select(F.col("d1").alias("a"), F.col("group").alias("ga"), F.col("packed").alias("pa"))
    right = texts.select(F.col("d1").alias("b"), F.col("group").alias("gb"), F.col("packed").alias("pb"))
    met = pairs.join(left, "a").join(right, "b").select("ga", "gb", "pa", "pb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes = np.array([zstandard.frame_content_size(x.as_py()) for i in (2, 3) for x in batch.column(i)]).reshape(2, -1).sum(0)
            total, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
                part = batch.slice(at, stop - at)
                seen: dict[int, int] = {}
                texts: list[str] = []
                where = np.zeros((2, part.num_rows), dtype=np.int64)
                for side in (0, 1):
                    for k, (g, x) in enumerate(zip(part.column(side).to_pylist(), part.column(side + 2).to_pylist(), strict=True)):
                        if g not in seen:
                            seen[g] = len(texts)
                            texts.append(unpack.decompress(x).decode())
                        where[side, k] = seen[g]
                values, first = _sets(pa.array(texts, pa.string()))
                fits = []
                for i, j in where.T:
                    x, y = values[first[i] : first[i + 1]], values[first[j] : first[j + 1]]
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    fits.append(len(x) > 0 and 100 * common >= 75 * (len(x) + len(y) - common))
                part = part.select([0, 1]).filter(pa.array(fits, pa.bool_()))
                yield pa.RecordBatch.from_arrays(part.columns, names=["a", "b"])
                at = stop

    return arrow_map(met, compare, "a long, b long")


def _across(entries: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests across components within long runs, but for those that sizes, places or bitmaps refute."""
    found = components(links).withColumnRenamed("node", "group")
    named = groups.join(found, "group", "left").select(F.col("d1").alias("b"), F.coalesce("component", "group").alias("component"), "n", "bits")
    entries = entries.select("a", "b", "place").join(named.select("b", "component"), "b")
    sizes = entries.groupBy("a", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("a").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where(F.col("parts") > 1).select("a", "main")
    torn = entries.join(main, "a")
    firsts = torn.groupBy("b").agg(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("place", "a"))), 1, FIRSTS), lambda e: e["a"]).alias("firsts"))
    torn = torn.join(named.drop("component"), "b").join(firsts, "b").withColumn("band", F.floor(F.log("n") / F.lit(math.log(BAND))))
    torn = staged(torn.select("a", "b", "place", "component", "n", "bits", "firsts", "band", (F.col("component") != F.col("main")).alias("minor")), "jaccard-torn")
    minor = torn.where("minor").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))).drop("minor")
    other = torn.select("a", "band", F.col("b").alias("c"), *[F.col(x).alias(f"{x}_c") for x in ("place", "component", "n", "bits", "firsts", "minor")])
    parts = lambda df, name: df.groupBy("a", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    tiles = staged(parts(minor, "rows").join(parts(other, "cols"), ["a", "band"]), "jaccard-tiles")
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = minor.join(tiles, ["a", "band"]).withColumn("i", place("b", "rows")).withColumn("j", every("cols")).drop("rows", "cols")
    other = other.join(tiles, ["a", "band"]).withColumn("j", place("c", "cols")).withColumn("i", every("rows")).drop("rows", "cols")
    once = ~F.col("minor_c") | (F.col("b") < F.col("c"))
    # a pair meets at the first shingle that both lists have; before it they share none, so it is the one whose places count
    once = once & (F.coalesce(F.get(F.array_intersect("firsts", "firsts_c"), F.lit(0)), F.col("a")) == F.col("a"))
    pairs = minor.join(other, ["a", "band", "i", "j"]).where((F.col("component") != F.col("component_c")) & once & _reaches("n", "place", "n_c") & _reaches("n_c", "place_c", "n") & _not_refuted("n", "n_c", "bits", "bits_c"))
    return pairs.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, group of every row of docs (doc_id, text; other columns are left aside).

    component_id is the smallest doc_id that links reach, the row's own included; group numbers the sets. Rows without words, with an
    empty or null text, have no group, are linked with nothing and keep their own doc_id; a repeated row has the set of its
    copy and so its component; a null doc_id takes part and its component is the smallest id that isn't null, or null; an
    empty table gives no rows. Texts are compared whole, copies of one set are never paired.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    key, n = frequent_shingles(docs)
    rows, postings = groups_and_postings(docs, key, n)
    rows = staged(rows, "jaccard-rows")
    full = rows.where(F.col("n") > 0)
    groups = staged(full.groupBy("d1", "d2", "n").agg(F.min("row_key").alias("rep"), F.first("bits").alias("bits")).withColumn("group", F.monotonically_increasing_id()), "jaccard-groups")
    met = staged(candidate_pairs(postings), "jaccard-candidates")
    links = staged(verified(docs, groups, met.where(F.col("kind") == 0).select("a", "b")), "jaccard-links")
    entries = met.where(F.col("kind") == 1).select("a", "b", "place")
    if entries.head(1):
        links = links.unionByName(staged(verified(docs, groups, _across(entries, groups, links)), "jaccard-links"))
    found = components(links).withColumnRenamed("node", "group")
    named = full.drop("bits").join(groups.drop("rep", "bits"), ["d1", "d2", "n"]).join(found, "group", "left").withColumn("component", F.coalesce("component", "group"))
    named = staged(named.select("row_key", "doc_id", "n", "group", "component"), "jaccard-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component").select("row_key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "group")
    none = rows.where(F.col("n") == 0).select("row_key", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return out.unionByName(none)
