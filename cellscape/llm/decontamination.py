"""Benchmark decontamination (operator 10): a BM25 inverted index of test items, searched with block-max WAND.

Items are indexed by length class (up to 64 words, up to 128, and so on); the passages that are searched for a class are 2 x
`stride` words long and overlap by half, `stride` being the class's longest length, so an item's text lies whole in some passage and
an item's passages depend on its own length alone. Each passage is a query. Scores are BM25 contributions divided by the item's own
score, so an item's copy scores 1 and one threshold holds for all. Document frequencies and the mean length are those of all items.

The search is block-max WAND, a slice of passages at a time. An item's terms of smallest contribution, together at most half the
threshold, are non-essential: a passage that has only these can't reach it. Postings of the essential terms lie in blocks of
`ITEM_BLOCK` items with each block's largest contribution. A block's upper bound for a passage is the sum of these over the
passage's terms; only where it reaches what the block's easiest item needs are postings opened, and only items that reach
their own need are scored in full. Nothing above the threshold is lost, whatever the passage.

The indexes are broadcast in parts of about `INDEX_WORDS` words of items; further parts are further passes over the documents, with
the same statistics and so the same scores.

An item's answer is its column `answer`, if the items have one, else the last quarter of its words (`ANSWER_SHARE`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.llm.common import annotated, arrow_map, staged
from cellscape.llm.textarrays import LOWER, Words, buffers, shingle_hashes, slices, span_hashes, word_bounds

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP = ANSWER_OVERLAP = 0.5
ANSWER_SHARE = 0.25
SHINGLE = 5
MIN_STRIDE = 64
ITEM_BLOCK = 8
INDEX_WORDS = 2_000_000

_IS_GAP = np.ones(256, dtype=bool)
_IS_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def plain_words(col: pa.Array) -> Words:
    """Runs of letters and digits, A-Z lower-cased; marks between them don't count."""
    data, offsets = buffers(col)
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, _IS_GAP)
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, span_hashes(data, starts, ends))


@dataclass
class Index:
    """terms are sorted hashes. Item i has terms item_terms[i] with contributions weights[i] (they sum to 1). post_* are the
    essential postings of each term by block and by item (CSR over terms); need[i] is what essential terms must give item i."""

    item_ids: list[int | None]
    terms: np.ndarray
    item_terms: list[np.ndarray]
    weights: list[np.ndarray]
    need: np.ndarray
    block_need: np.ndarray
    block_first: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    post_first: np.ndarray
    post_item: np.ndarray
    post_weight: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int


@dataclass
class Statistics:
    """Of all items with a word: how many, their mean length, and how many hold each of some terms (sorted hashes)."""

    items: int
    mean: float
    terms: np.ndarray
    held: np.ndarray


def statistics(w: Words) -> Statistics:
    """Statistics of the items of w themselves."""
    sizes = np.diff(w.first)
    pairs = np.unique(np.stack([w.hashes, w.doc.astype(np.uint64)], axis=1), axis=0) if len(w.hashes) else np.zeros((0, 2), dtype=np.uint64)
    terms, held = np.unique(pairs[:, 0], return_counts=True)
    return Statistics(int((sizes > 0).sum()), float(sizes[sizes > 0].mean()) if (sizes > 0).any() else 1.0, terms, held)


def length_class(sizes: np.ndarray) -> np.ndarray:
    """0 for up to MIN_STRIDE words, 1 for up to twice as many, and so on."""
    return np.ceil(np.log2(np.maximum(sizes, MIN_STRIDE) / MIN_STRIDE)).astype(np.int64)


def build_indexes(ids: list[int | None], texts: list[str], answers: list[str | None], known: Statistics | None = None, threshold: float = THRESHOLD) -> list[Index]:
    """An index for each length class; known are the statistics of a larger set of items that these are part of."""
    whole = [t if a is None else f"{t}\n{a}" for t, a in zip(texts, answers, strict=True)]
    w = plain_words(pa.array(whole, pa.string()))
    asked = np.diff(plain_words(pa.array(texts, pa.string())).first)
    cuts = [int(n) if a is not None else None for n, a in zip(asked, answers, strict=True)]
    known, sizes = known or statistics(w), np.diff(w.first)
    out = []
    for c in np.unique(length_class(sizes[sizes > 0])):
        mine = np.flatnonzero((sizes > 0) & (length_class(sizes) == c))
        out.append(build_index([ids[i] for i in mine], [whole[i] for i in mine], [cuts[i] for i in mine], known, MIN_STRIDE << int(c), threshold))
    return out


def build_index(ids: list[int | None], texts: list[str], cuts: list[int | None], known: Statistics, stride: int, threshold: float = THRESHOLD) -> Index:
    """Index of the items that have a word; cuts are the words before an item's answer, where it is known."""
    w = plain_words(pa.array(texts, pa.string()))
    sizes = np.diff(w.first)
    some = np.flatnonzero(sizes > 0)
    terms, code = np.unique(w.hashes, return_inverse=True)
    item_terms, counts = [], []
    for i in some:
        t, c = np.unique(code[w.first[i] : w.first[i + 1]], return_counts=True)
        item_terms.append(t)
        counts.append(c)
    held, mean = known.held[np.searchsorted(known.terms, terms)], known.mean
    idf = np.log1p((known.items - held + 0.5) / (held + 0.5))
    weights, need, question, answer = [], [], [], []
    rows_t, rows_i, rows_w = [], [], []
    for k, i in enumerate(some):
        tf = counts[k]
        raw = idf[item_terms[k]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean))
        x = raw / raw.sum()
        weights.append(x)
        order = np.argsort(x, kind="stable")
        spare = np.cumsum(x[order]) <= threshold / 2
        need.append(threshold - x[order][spare].sum())
        essential = order[~spare]
        rows_t.append(item_terms[k][essential])
        rows_i.append(np.full(len(essential), k))
        rows_w.append(x[essential])
        mine = w.hashes[w.first[i] : w.first[i + 1]]
        cut = cuts[i] if cuts[i] is not None else len(mine) - max(1, int(len(mine) * ANSWER_SHARE)) if len(mine) > 1 else 0
        question.append(_units(mine[:cut] if cut else mine))
        answer.append(np.unique(mine[cut:] if cut < len(mine) else mine))
    t, i, x = (np.concatenate(v) if v else np.zeros(0) for v in (rows_t, rows_i, rows_w))
    t, i = t.astype(np.int64), i.astype(np.int64)
    order = np.lexsort((i, t))
    t, i, x = t[order], i[order], x[order]
    need_, n_blocks = np.array(need), -(-len(some) // ITEM_BLOCK)
    pairs, at = np.unique(t * max(1, n_blocks) + i // ITEM_BLOCK, return_inverse=True)
    block_max = np.zeros(len(pairs))
    np.maximum.at(block_max, at, x)
    block_need = np.minimum.reduceat(need_, np.arange(0, len(some), ITEM_BLOCK)) if len(some) else need_
    return Index(
        [ids[i] for i in some], terms, item_terms, weights, need_, block_need,
        np.searchsorted(pairs // max(1, n_blocks), np.arange(len(terms) + 1)), pairs % max(1, n_blocks), block_max,
        np.searchsorted(t, np.arange(len(terms) + 1)), i, x, question, answer, stride,
    )


def _units(words: np.ndarray) -> np.ndarray:
    """Distinct 5-word shingles, or the words themselves of a shorter run."""
    if len(words) < SHINGLE:
        return np.unique(words)
    none = np.zeros(0, dtype=np.int64)
    return np.unique(shingle_hashes(Words(none, none, none, np.zeros(len(words), dtype=np.int64), np.array([0, len(words)]), words), SHINGLE)[0])


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of terms, place in the postings) for every posting of every term."""
    n = first[terms + 1] - first[terms]
    entry = np.repeat(np.arange(len(terms)), n)
    return entry, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[terms], n)


def search(index: Index, w: Words, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, end word, score) of every passage and item whose score reaches the threshold."""
    if not len(index.terms) or not len(w.hashes):
        return []
    at = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hashes)
    known = known[index.post_first[at[known] + 1] > index.post_first[at[known]]]
    # passages: the cell of a word is its place div stride; a passage is a cell and the next one of its row
    cells = np.maximum(1, -(-np.diff(w.first) // index.stride))
    cell_first = np.concatenate(([0], np.cumsum(cells)))
    cell = cell_first[w.doc[known]] + (known - w.first[w.doc[known]]) // index.stride
    passage, term = np.concatenate((cell, cell - 1)), np.tile(at[known], 2)
    inside = np.concatenate((np.ones(len(cell), dtype=bool), cell > cell_first[w.doc[known]]))
    key = np.unique(passage[inside] * len(index.terms) + term[inside])
    passage, term = key // len(index.terms), key % len(index.terms)
    # block upper bounds
    entry, place = _expand(index.block_first, term)
    n_blocks = len(index.block_need)
    pb, group = np.unique(passage[entry] * n_blocks + index.block_of[place], return_inverse=True)
    bound = np.bincount(group, weights=index.block_max[place], minlength=len(pb))
    pb = pb[bound >= index.block_need[pb % n_blocks] - 1e-9]
    if not len(pb):
        return []
    # postings of the blocks left
    stay = np.isin(passage, pb // n_blocks)
    passage, term = passage[stay], term[stay]
    entry, place = _expand(index.post_first, term)
    item = index.post_item[place]
    stay = np.isin(passage[entry] * n_blocks + item // ITEM_BLOCK, pb)
    n_items = len(index.item_ids)
    pi, group = np.unique((passage[entry] * n_items + item)[stay], return_inverse=True)
    partial = np.bincount(group, weights=index.post_weight[place[stay]], minlength=len(pi))
    out = []
    for p, i in zip(*np.divmod(pi[partial >= index.need[pi % n_items] - 1e-9], n_items), strict=True):
        row = int(np.searchsorted(cell_first, p, side="right") - 1)
        begin = int(w.first[row] + (p - cell_first[row]) * index.stride)
        end = int(min(begin + 2 * index.stride, w.first[row + 1]))
        score = float(index.weights[i][np.isin(index.terms[index.item_terms[i]], w.hashes[begin:end])].sum())
        if score >= threshold - 1e-9:
            out.append((row, int(i), begin, end, score))
    return out


def verify(index: Index, item: int, words: np.ndarray) -> tuple[float, float]:
    """Shares of the item's question and answer that the words hold."""
    question, answer = index.question[item], index.answer[item]
    have = np.concatenate((np.unique(words), _units(words)))
    return float(np.isin(question, have).mean()), float(np.isin(answer, have).mean())


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, held: items of a batch that hold it; a null term has the items with a word, and their words in `words`."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = plain_words(part.column(0))
            s = statistics(w)
            yield pa.RecordBatch.from_arrays([pa.array([*s.terms.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(s.held, s.items).astype(np.int64)), pa.array(np.append(np.zeros(len(s.terms)), len(w.hashes)).astype(np.int64))], names=["term", "held", "words"])


def _parts(items: DataFrame, limit: int, threshold: float) -> Iterator[tuple[list[Index], bool]]:
    """Indexes of the items, dealt by a hash of the row into parts of about `limit` words, and whether there are more parts than one."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None)
    sized = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", answer.cast("string").alias("answer"))
    whole = F.concat_ws("\n", "text", "answer")
    parts = max(1, -(-(sized.agg(F.sum(F.size(F.split(whole, r"\s+")))).first()[0] or 0) // limit))
    counts = None
    if parts > 1:
        counts = staged(arrow_map(sized.select(whole.alias("text")), _term_counts, "term long, held long, words long").groupBy("term").agg(F.sum("held").alias("held"), F.sum("words").alias("words")), "benchmark-terms")
        total = counts.where(F.col("term").isNull()).first()
    for k in range(parts):
        part = sized if parts == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0], r[1]))
        known = None
        if counts is not None:
            mine = arrow_map(part.select(whole.alias("text")), _term_counts, "term long, held long, words long").where(F.col("term").isNotNull()).select("term").distinct()
            found = counts.select("term", "held").join(mine, "term").toArrow()
            term, held = found.column("term").to_numpy().view(np.uint64), found.column("held").to_numpy()
            order = np.argsort(term)
            known = Statistics(total["held"], total["words"] / max(1, total["held"]), term[order], held[order])
        yield build_indexes([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], known, threshold), parts > 1


def _verified(indexes: list[Index], texts: pa.Array, threshold: float) -> Iterator[tuple[int, int | None, int, float, float, float]]:
    """(row, item_id, word_at, score, question and answer overlap) of each passage that repeats an item."""
    w = plain_words(texts)
    for index in indexes:
        for row, item, begin, end, score in search(index, w, threshold):
            question, answer = verify(index, item, w.hashes[begin:end])
            if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                yield row, index.item_ids[item], begin - int(w.first[row]), score, question, answer


def marked(docs: DataFrame, items: DataFrame, name: str = "leaks", threshold: float = THRESHOLD, index_words: int = INDEX_WORDS) -> DataFrame:
    """docs (text and any others) with the number of passages and items that match, row by row; a column of that name is replaced.

    Of several parts each has a pass and a staged table of its own, so that one part's indexes are held at a time.
    """
    out = docs.drop(name)
    for k, (indexes, several) in enumerate(_parts(items, index_words, threshold)):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def count(texts: pa.Array, shared=shared) -> list[pa.Array]:
            rows = np.array([r for r, *_ in _verified(shared.value, texts, threshold)], dtype=np.int64)
            return [pa.array(np.bincount(rows, minlength=len(texts)).astype(np.int32))]

        found = annotated(out, [(f"_{name}_{k}", "int")], count)
        out = staged(found, "leaks", instead_of=out) if several else found
        if several:
            shared.destroy()
    parts = [c for c in out.columns if c not in docs.columns]
    return out.withColumn(name, sum((F.col(c) for c in parts), F.lit(0))).drop(*parts)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, item_id, word_at, score, question_overlap, answer_overlap: each item that a document repeats, at its best passage.

    docs (doc_id, text) and items (item_id, text, and answer if there is one); other columns are left aside. Null and empty texts on either side match
    nothing, and so do items without letters or digits; repeated rows of a doc_id give the best of them; ties go to the first
    passage; with empty tables there are no rows. An item of one word is question and answer at once.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("word_at", T.IntegerType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType()))])
    found = None
    for indexes, several in _parts(items, index_words, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[row], *rest) for row, *rest in _verified(shared.value, part.column(1), threshold)]
                    columns = zip(*rows, strict=True) if rows else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=schema.names)

        one = arrow_map(docs.select("doc_id", "text"), run, schema)
        if several:  # one part's indexes are held at a time
            one = staged(one, "leaks")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("score", (-F.col("word_at")).alias("before"), "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.before")).alias("word_at"), "best.score", "best.question_overlap", "best.answer_overlap")
