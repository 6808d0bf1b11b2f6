"""Line dedup (operator 7): pairwise patience alignment of documents that share line hashes.

A document's lines are cut at line feeds and stripped; blank ones don't count. What is hashed is the shortest run of lines that
reaches `min_words` words, from a line on or up to a line: one line if it is long enough, else several. Such runs are far rarer than
lines, and every line of a common block of `min_words` words lies in one that both documents hold. The k-th occurrence of a run in
a document has the key (hash, k), so every key is unique in its document, as patience diff asks of its anchors.

A key's owner is the document of smallest id that holds it. A later document is paired with the owner of each of its keys, never
with all holders, so pairs grow with the lines and not with the square of a run's frequency; nothing is lost by it, as a block
shared with any earlier document is made of runs that the document shares with their owners too. Keys so frequent that they would
fill a task by themselves (at most `4 x spark.sql.shuffle.partitions` of them can) get their owner by a broadcast, others by a
shuffled join.

For each pair the anchors are aligned by patience diff: their longest chain that runs forward in both documents is the alignment, and
the common blocks on it are deleted from the later document. What crosses the chain is no part of the alignment; a block of it (lines
that follow each other in both documents) is deleted as a moved passage only if it has `moved_words`, so short phrases that happen to
recur elsewhere stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.llm.common import arrow_map, shuffle_partitions, staged
from cellscape.llm.textarrays import IS_SPACE, buffers, mix64, slices, span_hashes, word_bounds

MIN_WORDS, MOVED_WORDS = 10, 25
_IS_NEWLINE = np.zeros(256, dtype=bool)
_IS_NEWLINE[10] = True


def stripped_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the non-blank lines without outer white space, and their words."""
    starts, ends = word_bounds(data, offsets, _IS_NEWLINE)
    word_starts, word_ends = word_bounds(data, offsets, IS_SPACE)
    low, high = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    some = high > low
    return word_starts[low[some]], word_ends[high[some] - 1], (high - low)[some]


def windows(col: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first line, line after the last, row, position of the first line, total) of every shortest run of lines with min_words;
    total: the words of all lines before each line."""
    data, offsets = buffers(col)
    starts, ends, words = stripped_lines(data, offsets)
    hashes, n = span_hashes(data, starts, ends), len(starts)
    row = np.searchsorted(offsets, starts, side="right") - 1
    total = np.concatenate(([0], np.cumsum(words)))
    ahead, back = np.searchsorted(total, total[:-1] + min_words), np.searchsorted(total, total[1:] - min_words, side="right") - 1
    first, after = np.concatenate((np.arange(n), back)), np.concatenate((ahead, np.arange(1, n + 1)))
    fine = (first >= 0) & (after <= n)
    first, after = first[fine], after[fine]
    fine = row[first] == row[after - 1]
    first, after = np.divmod(np.unique(first[fine] * (n + 1) + after[fine]), n + 1)
    key = np.zeros(len(first), dtype=np.uint64)
    for k in range(int((after - first).max()) if len(first) else 0):
        on = np.flatnonzero(first + k < after)
        key[on] = mix64(mix64(key[on]) + hashes[first[on] + k])
    order = np.lexsort((first, key, row[first]))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.zeros(0, dtype=np.int64)
    nth = np.empty(len(order), dtype=np.uint64)
    nth[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    return mix64(key + nth), first, after, row[first], first - np.searchsorted(row, row[first]), total


def longest_chain(values: list[int]) -> list[int]:
    """Indexes of a longest subsequence that never falls, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_right(tops, v)
        if at == len(tops):
            tops.append(v)
            heads.append(i)
        else:
            tops[at], heads[at] = v, i
        back[i] = heads[at - 1] if at else -1
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def moved(position: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray, words: np.ndarray, moved_words: int) -> np.ndarray:
    """Which anchors that cross their pair's chain are of a block with moved_words: anchors of one shift whose lines touch."""
    order = np.lexsort((position, at - position))
    shift, first, last = (at - position)[order], position[order], (position + size)[order]
    lines = np.maximum.accumulate(last + (np.cumsum(np.diff(shift, prepend=shift[:1]) != 0) << 32))  # the furthest line of the same shift so far
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = (shift[1:] != shift[:-1]) | (first[1:] > (lines[:-1] & ((1 << 32) - 1)))
    starts, block = np.flatnonzero(cut), np.cumsum(cut) - 1
    total = np.maximum.reduceat((begin + words)[order], starts) - np.minimum.reduceat(begin[order], starts)
    out = np.zeros(len(order), dtype=bool)
    out[order] = total[block] >= moved_words
    return out


def aligned(ids: np.ndarray, owner: np.ndarray, position: np.ndarray, at: np.ndarray, size: np.ndarray, begin: np.ndarray, words: np.ndarray, moved_words: int = MOVED_WORDS) -> np.ndarray:
    """Which anchors are of common blocks that go, for rows sorted by document, owner and position."""
    run = np.ones(len(ids), dtype=bool)
    run[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(run)
    stops = np.append(starts[1:], len(ids))
    falls = np.zeros(len(ids), dtype=bool)
    falls[1:] = (np.diff(at) < 0) & ~run[1:]
    gone = np.ones(len(ids), dtype=bool)
    for r in np.unique(np.searchsorted(starts, np.flatnonzero(falls), side="right") - 1):  # other pairs run forward as a whole
        own = slice(starts[r], stops[r])
        crossing = np.ones(stops[r] - starts[r], dtype=bool)
        crossing[longest_chain(at[own].tolist())] = False
        off = starts[r] + np.flatnonzero(crossing)
        gone[off] = moved(position[off], at[off], size[off], begin[off], words[off], moved_words)
    return gone


def removals(docs: DataFrame, min_words: int = MIN_WORDS, moved_words: int = MOVED_WORDS) -> DataFrame:
    """doc_id, firsts, lasts, keys: the blocks that go from each document that loses any, named by their anchors.

    An anchor is a run's first line, the line after its last and its key, by which a row of a repeated doc_id knows its own runs.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, first, after, row, position, total = windows(part.column(1), min_words)
                ids = part.column(0).to_numpy(zero_copy_only=False)[row]
                begin = total[first] - total[first - position]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (position, after - first, begin, total[after] - total[first])]], names=["doc_id", "run", "position", "size", "begin", "words"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            ids, owner, position, at, size, begin, words, key = (rows.column(c).to_numpy() for c in ("doc_id", "owner", "position", "at", "size", "begin", "words", "run"))
            gone = aligned(ids, owner, position, at, size, begin, words, moved_words)
            ids, position, size, key = ids[gone], position[gone], size[gone], key[gone]
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, dtype=np.int64)
            bounds = pa.array(np.append(first, len(ids)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (position, position + size, key)]
            return pa.RecordBatch.from_arrays([pa.array(ids[first]), *lists], names=["doc_id", "firsts", "lasts", "keys"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))  # the last document may go on in the next batch
            if last == 0 and held and held[-1].column(0)[-1].as_py() == ids[0]:
                held.append(batch)
                continue
            if last == 0 and held or last:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield settle(pa.Table.from_batches(held))

    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = shuffle_partitions(docs.sparkSession)
    held = staged(arrow_map(docs, runs, "doc_id long, run long, position int, size int, begin int, words int"), "line-runs")
    share = max(1, held.count() // (4 * partitions))
    first = held.groupBy("run").agg(F.min(F.struct("doc_id", "position")).alias("owner"), F.max("doc_id").alias("top"), F.count("*").alias("n")).where(F.col("top") > F.col("owner.doc_id"))
    first = staged(first.select("run", F.col("owner.doc_id").alias("owner"), F.col("owner.position").alias("at"), "n"), "line-owners")
    hot, cold = F.broadcast(first.where(F.col("n") > share)), first.where(F.col("n") <= share)
    owned = held.join(hot, "run").unionByName(held.join(hot.select("run"), "run", "left_anti").join(cold, "run"))
    anchors = owned.where(F.col("doc_id") > F.col("owner")).select("doc_id", "owner", "position", "at", "size", "begin", "words", "run")
    dealt = anchors.repartition(partitions, "doc_id").sortWithinPartitions("doc_id", "owner", "position", "size", "at")
    return arrow_map(dealt, align, "doc_id long, firsts array<int>, lasts array<int>, keys array<long>")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, moved_words: int = MOVED_WORDS) -> DataFrame:
    """docs (doc_id, text and any others) with repeated blocks of lines cut from later documents, and n_removed, n_removed_chars.

    Later means a larger doc_id; rows of a null doc_id or text and empty texts stay as they are, repeated rows of one doc_id are
    one document and aren't compared with each other, and an empty table gives none. Every row stays, if with an empty text.
    A cut line goes with its line feed. Names: a column n_removed or n_removed_chars of docs would be replaced.
    """
    gone = removals(docs, min_words, moved_words).select(F.col("doc_id").alias("_id"), F.struct("firsts", "lasts", "keys").alias("gone"))
    kept = [c for c in docs.columns if c not in ("text", "n_removed", "n_removed_chars")]
    joined = docs.select(F.struct(*kept).alias("row"), "text", F.col("doc_id").cast("long").alias("_doc")).join(gone, F.col("_doc") == F.col("_id"), "left").select("row", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hit = np.flatnonzero(part.column(2).is_valid().to_numpy(zero_copy_only=False))
                counts, chars = np.zeros(part.num_rows, dtype=np.int32), np.zeros(part.num_rows, dtype=np.int64)
                column = part.column(1)
                if len(hit):
                    texts = column.to_pylist()
                    some = part.take(pa.array(hit))
                    cuts = cut_runs(some.column(1), some.column(2).to_pylist(), min_words)
                    for d, (left, n) in zip(hit, cuts, strict=True):
                        counts[d], chars[d] = n, len(texts[d] or "") - len(left)
                        texts[d] = left if texts[d] is not None else None
                    column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(counts), pa.array(chars)], names=["row", "text", "n_removed", "n_removed_chars"])

    schema = joined.select("row", "text").schema.add("n_removed", T.IntegerType()).add("n_removed_chars", T.LongType())
    order = [F.col("row")[c].alias(c) if c != "text" else F.col("text") for c in docs.columns if c not in ("n_removed", "n_removed_chars")]
    return arrow_map(joined, cut, schema).select(*order, "n_removed", "n_removed_chars")


def cut_runs(col: pa.Array, gone: list[dict], min_words: int) -> list[tuple[str, int]]:
    """(text left, lines cut) of each row; an anchor whose run isn't this row's is another row's of that doc_id and is left alone."""
    key, _, _, row, position, _ = windows(col, min_words)
    key, bound = key.view(np.int64), np.searchsorted(row, np.arange(len(col) + 1))
    data, offsets = buffers(col)
    starts, ends, _ = stripped_lines(data, offsets)
    line = np.searchsorted(starts, offsets)
    out = []
    for d, text in enumerate(col.to_pylist()):
        mine = set(zip(position[bound[d] : bound[d + 1]].tolist(), key[bound[d] : bound[d + 1]].tolist(), strict=True))
        cut = np.zeros(line[d + 1] - line[d], dtype=bool)
        for p, q, k in zip(gone[d]["firsts"], gone[d]["lasts"], gone[d]["keys"], strict=True):
            if (p, k) in mine:
                cut[p:q] = True
        raw, kept, at = (text or "").encode(), [], 0
        for i in np.flatnonzero(cut):
            begin, stop = raw.rfind(b"\n", 0, starts[line[d] + i] - offsets[d]) + 1, raw.find(b"\n", ends[line[d] + i] - offsets[d])
            kept.append(raw[at : max(at, begin)])
            at = len(raw) if stop < 0 else stop + 1
        out.append(((b"".join(kept) + raw[at:]).decode(), int(cut.sum())))
    return out
