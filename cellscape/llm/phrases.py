"""Phrase collocation mining (operator 11): best-first branch and bound over prefixes, with counts of Spark aggregates.

A phrase of 2 to 4 words scores floor(2000000 a / (l + r)) at its worst cut: a is its count, l and r those of the two parts. A phrase
that begins with a pair p has l = f(first word) at its first cut, and a <= r and a <= f(p), so it scores at most
2000000 f(p) / (f(first word) + f(p)): the bound of p as a prefix. Its bound as a suffix is the mirror image, with its last word.

Words and pairs are counted first. A round then takes each language's best pairs, those of which a bound reaches a score `floor`, and
counts the phrases of 3 and 4 words that hold them. What reaches `floor` is then known whole, with all that could drop it:

* a phrase of 3 or 4 words that scores `floor` begins with a pair whose prefix bound reaches it and ends with one whose suffix bound
  does, so it and its parts are counted (a part that isn't proves a lower score);
* a phrase is dropped by a longer one only if an extension by one word drops it, as no longer phrase is more frequent; the extensions
  of a phrase that scores `floor` hold its pairs.

If a language has `top` survivors at its floor it is settled, ties included; else its floor goes down for the next round, at last to 0.
Floors come from a histogram of the pairs' scores: nothing of a language is sorted or gathered for them.

Tasks read whole texts in chunks, code their words exactly (a dictionary a chunk) and add up n-grams before anything is shuffled.
Which words and pairs count is told to tasks by bit maps of a fixed size: a false positive costs a row, never a result, so what is
broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.llm.common import arrow_map, staged
from cellscape.llm.textarrays import LOWER, buffers, mix64, span_hashes, word_bounds

LEAST, TOP, COVERED = 30, 2_000, 80
"""A candidate's least count, phrases a language, and the percentage of a candidate's count at which a longer one drops it."""
MAP_BITS = 26
"""A bit map's size as a power of two: 8 MB."""
CHUNK_BYTES, BATCH_ROWS = 4 << 20, 1 << 16
FIRST, FALL, BUCKET = 2, 8, 1_000
"""The first floor leaves about FIRST times `top` pairs above it, each next one FALL times more; scores are counted in buckets."""
ROUNDS = 30
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_GAP = ENDS_PIECE.copy()
IS_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)
COUNTS = "lang string, phrase string, f long"


@dataclass
class Chunk:
    """Words of some texts. word: each word's code, one for each word of each language; joined: whether the next word is of the same
    piece; lang, text and hash of each code; totals: words by language."""

    word: np.ndarray
    joined: np.ndarray
    lang: pa.Array
    text: pa.Array
    hashes: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows (lang, text) in chunks of about CHUNK_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield coded(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield coded(pa.Table.from_batches(held))


def coded(table: pa.Table) -> Chunk:
    data, offsets = buffers(table.column("text"))
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, IS_GAP)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(ENDS_PIECE[data], dtype=np.int32)[starts]
    joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~IS_GAP[data]])]).dictionary_encode()
    lang = pc.fill_null(table.column("lang").combine_chunks(), "und").dictionary_encode()
    n = max(1, len(spelled.dictionary))
    own, word = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * n + spelled.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    langs, texts = lang.dictionary.take(pa.array(own // n)), spelled.dictionary.cast(pa.large_string()).take(pa.array(own % n))
    return Chunk(word, joined, langs, texts, hashed(langs, texts))


def hashed(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A hash of each word of a language."""
    return mix64(_hashes(langs) * _STEP + _hashes(words))


def _hashes(values: pa.Array) -> np.ndarray:
    data, offsets = buffers(values.cast(pa.large_string()))
    return span_hashes(data, offsets[:-1], offsets[1:])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of words from theirs."""
    return mix64(a * _STEP + b)


def within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bit map holds (or may hold)."""
    at = hashes >> np.uint64(65 - (len(bits) << 6).bit_length())
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bit_map(phrases: DataFrame) -> np.ndarray:
    """The bit map of words or pairs (lang, phrase): 2**MAP_BITS bits whatever their number."""

    size = MAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, parts = batch.column("lang"), pc.split_pattern(batch.column("phrase"), " ", max_splits=1)
                hashes = hashed(lang, pc.list_element(parts, 0))
                if pc.list_value_length(parts)[0].as_py() == 2:
                    hashes = paired(hashes, hashed(lang, pc.list_element(parts, 1)))
                at = hashes >> np.uint64(64 - size)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    found = arrow_map(phrases.select("lang", "phrase"), run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _spelled(chunk: Chunk, codes: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    words = [chunk.text.take(pa.array(c)) for c in codes]
    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if len(words) > 1 else words[0]
    return pa.RecordBatch.from_arrays([chunk.lang.take(pa.array(codes[0])).cast(pa.string()), phrase.cast(pa.string()), pa.array(counts)], names=["lang", "phrase", "f"])


def _words(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """Each word's count, and all words of each language as the count of the empty phrase."""
    counts = np.bincount(chunk.word, minlength=len(chunk.text))
    yield _spelled(chunk, [np.arange(len(counts))], counts)
    total = pa.table({"lang": chunk.lang.cast(pa.string()), "f": counts}).group_by("lang").aggregate([("f", "sum")])
    yield pa.RecordBatch.from_arrays([total.column("lang").combine_chunks(), pa.array([""] * total.num_rows, pa.string()), total.column("f_sum").combine_chunks()], names=["lang", "phrase", "f"])


def _pairs(chunk: Chunk, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of words that the bit map holds."""
    known, n = within(words, chunk.hashes), len(chunk.text)
    first, second = chunk.word[:-1], chunk.word[1:]
    at = chunk.joined & known[first] & known[second]
    pair, counts = np.unique(first[at] * n + second[at], return_counts=True)
    if len(pair):
        yield _spelled(chunk, [pair // n, pair % n], counts)


def _longer(chunk: Chunk, pairs: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of 3 words whose pairs are in `pairs`, one of them in `best`, and of 4 words with two of them in `best`."""
    n, word = len(chunk.text), chunk.word
    at = np.flatnonzero(chunk.joined)
    pair, code = np.unique(word[at] * n + word[at + 1], return_inverse=True)
    hashes = paired(chunk.hashes[pair // n], chunk.hashes[pair % n])
    here, top, which = np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=np.int64)
    here[at], top[at], which[at] = within(pairs, hashes)[code], within(best, hashes)[code], code
    top &= here
    if len(word) < 3:
        return
    three = here[:-2] & here[1:-1] & (top[:-2] | top[1:-1])
    at = np.flatnonzero(three)
    triple, code, counts = np.unique(which[at] * n + word[at + 2], return_inverse=True, return_counts=True)
    if not len(triple):
        return
    begin = pair[triple // n]
    yield _spelled(chunk, [begin // n, begin % n, triple % n], counts)
    which3 = np.full(len(word), -1, dtype=np.int64)
    which3[at] = code
    at = at[at + 3 < len(word)]
    at = at[here[at + 2] & (top[at].astype(np.int8) + top[at + 1] + top[at + 2] >= 2)]
    four, counts = np.unique(which3[at] * n + word[at + 3], return_counts=True)
    if len(four):
        three = triple[four // n]
        begin = pair[three // n]
        yield _spelled(chunk, [begin // n, begin % n, three % n, four % n], counts)


def _added_up(docs: DataFrame, count, *maps: np.ndarray) -> DataFrame:
    """(lang, phrase, f) of what `count` finds in the texts, added up; maps are broadcast."""
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in maps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for found in count(chunk, *[s.value for s in shared]) if len(chunk.word) else ():
                yield from (found.slice(i, BATCH_ROWS) for i in range(0, found.num_rows, BATCH_ROWS))

    return arrow_map(docs.select(F.col("lang").cast("string").alias("lang"), "text"), run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.floor((wide(F.lit(1)) * 2_000_000 * wide(a) - (wide(F.lit(1)) * 2_000_000 * wide(a)) % wide(l + r)) / wide(l + r)).cast("long")


def _cut(phrase: Column, k: Column | int) -> tuple[Column, Column]:
    words = F.split(phrase, " ")
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def _with_scores(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, a) with l, r and score of their lowest cut, but those of which a part is not in counts (lang, phrase, f)."""
    size = F.size(F.split("phrase", " "))
    cuts = phrases.withColumn("_k", F.explode(F.sequence(F.lit(1), size - 1)))
    left, right = _cut(F.col("phrase"), F.col("_k"))
    cuts = cuts.withColumns({"_left": left, "_right": right})
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_c"), F.count("*").alias("_n"))
    return lowest.where(F.col("_n") == size - 1).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")


def _floors(pairs: DataFrame, many: int) -> DataFrame:
    """(lang, floor): the score above which about `many` pairs of the language lie, 0 if it has fewer."""
    buckets = pairs.groupBy("lang", F.floor(F.col("score") / BUCKET).alias("_b")).agg(F.count("*").alias("_n"))
    above = buckets.withColumn("_n", F.sum("_n").over(W.partitionBy("lang").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, 0)))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("_n") >= many, F.col("_b") * BUCKET)), F.lit(0)).cast("long").alias("floor"))


def survivors(docs: DataFrame, words: DataFrame, pairs: DataFrame, floors: DataFrame, least: int) -> DataFrame:
    """All phrases that score their language's floor or more and that no longer one drops: lang, phrase, a, l, r, score, floor."""
    known = pairs.join(floors, "lang")
    best = known.where(F.greatest("as_prefix", "as_suffix") >= F.col("floor"))
    longer = staged(_added_up(docs, _longer, bit_map(known), bit_map(best)).where(F.col("f") >= least), "phrases-longer")
    counts = words.select("lang", "phrase", "f").unionByName(pairs.select("lang", "phrase", F.col("a").alias("f"))).unionByName(longer)
    scored = pairs.select("lang", "phrase", "a", "l", "r", "score").unionByName(_with_scores(longer.withColumnRenamed("f", "a"), counts))
    words_of = F.size(F.split("phrase", " "))
    ends = F.explode(F.array(_cut(F.col("phrase"), 1)[1], _cut(F.col("phrase"), words_of - 1)[0]))
    within_longer = longer.select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longest"))
    reached = scored.join(floors, "lang").where(F.col("score") >= F.col("floor"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    dropped = F.coalesce(wide("_longest", 100) >= wide("a", COVERED), F.lit(False))
    return reached.join(within_longer, ["lang", "phrase"], "left").where(~dropped).drop("_longest")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, first: int = FIRST) -> DataFrame:
    """Each language's first `top` phrases of docs (lang, text; other columns are left aside): lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang is `und`. Repeated rows count as often as they are there. No texts, or none with a phrase that is
    there `least` times, give no rows; of equal scores the more frequent phrase comes first, then the smaller one by its bytes.
    """
    counted = staged(_added_up(docs, _words).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases-words")
    words, totals = counted.where("phrase <> ''"), counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    pairs = staged(_added_up(docs, _pairs, bit_map(words)).where(F.col("f") >= least).withColumnRenamed("f", "a"), "phrases-pairs")
    bounds = {"as_prefix": score(F.col("a"), F.col("l"), F.col("a")), "as_suffix": score(F.col("a"), F.col("a"), F.col("r"))}
    pairs = staged(_with_scores(pairs, words).withColumns(bounds), "phrases-bounds")
    done, many = [], first * top
    open_ = pairs.select("lang").distinct()
    for _ in range(ROUNDS):
        floors = staged(_floors(pairs.join(open_, "lang", "left_semi"), many), "phrases-floors")
        found = staged(survivors(docs, words, pairs, floors, least), "phrases-found")
        many *= FALL
        enough = found.groupBy("lang").count().where(F.col("count") >= top).select("lang")
        settled = staged(floors.where("floor = 0").select("lang").unionByName(enough).distinct(), "phrases-settled")
        done.append(found.join(settled, "lang", "left_semi"))
        open_ = floors.select("lang").join(settled, "lang", "left_anti")
        if not open_.head(1):
            break
    else:
        raise RuntimeError(f"languages without {top} phrases settled after {ROUNDS} rounds")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
