"""Toxicity (operator 2): a linear-chain conditional random field over words.

Labels come by document, the field wants them by token, so training first labels tokens: a word or a longer word's beginning whose
contexts (the words beside it) are found in toxic documents far more than chance allows, by a log likelihood ratio, marks the
tokens that have it, in toxic documents only. Distinct contexts are counted, not documents, so copies of one text count once.
A beginning may also stand in some other documents (MIN_RATE): stems of a language with few documents are met by chance in plain words.
The field has two states and hashed features of each token (the word, its beginnings and ending, the words beside it), and is
fitted on these sequences by gradient steps with exact forward-backward marginals.

Scoring runs forward-backward over every token of a text. A document's score is a logistic function, fitted on the training
documents, of the expected number of toxic tokens and the largest marginal; tokens whose marginal passes 1/2 give the offending
offsets. Long texts are cut into blocks whose 2 x 2 transfer matrices carry the state across, which is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import annotated, arrow_map, staged
from cellscape.llm.textarrays import Words, buffers, mix64, slices, span_hashes, word_bounds
from cellscape.shipping import ship

SAMPLE_DOCS = 1_200
"""At most about so many labelled toxic documents, and twice as many others, are fitted on (by a hash of doc_id)."""
SAMPLE_BYTES = 32 << 20
"""Of these, at most so many bytes of text, in the order of that hash; a longer text by itself isn't fitted on."""
TABLE_BITS = 20
TABLE = 1 << TABLE_BITS
STEPS = 20
BLOCK = 256
LAYER = 4
CHUNK_CHARS = 1 << 20
MIN_EVIDENCE, MIN_RATE = 25.0, 0.85
"""A word or beginning is evidence from this log likelihood ratio (one in about 2 million by chance) and share of toxic contexts on."""
_IS_GAP = np.ones(256, dtype=bool)
_IS_GAP[[*range(97, 123), *range(128, 256)]] = False
_KINDS = {"word": 1, "start4": 2, "start5": 3, "start6": 4, "start7": 5, "end3": 6, "before": 7, "after": 8}
_STEMS, _BEFORE, _AFTER = 5, 6, 7  # rows of features: so many are a word or a beginning; then those of the words beside it


def letter_words(col: pa.Array) -> Words:
    """Runs of letters in lower case."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    starts, ends = word_bounds(data, offsets, _IS_GAP)
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, span_hashes(data, starts, ends))


def features(w: Words) -> np.ndarray:
    """Table places of every token's features: one row a kind; a beginning is one of a longer word, else 0."""
    start = lambda n: np.where(w.ends - w.starts > n, span_hashes(w.data, w.starts, np.minimum(w.starts + n, w.ends)), np.uint64(0))
    before, after = np.zeros_like(w.hashes), np.zeros_like(w.hashes)
    if len(w.hashes):
        same = w.doc[1:] == w.doc[:-1]
        before[1:] = np.where(same, w.hashes[:-1], 0)
        after[:-1] = np.where(same, w.hashes[1:], 0)
    values = (w.hashes, start(4), start(5), start(6), start(7), span_hashes(w.data, np.maximum(w.ends - 3, w.starts), w.ends), before, after)
    return np.stack([(mix64(v + np.uint64(k)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for v, k in zip(values, _KINDS.values(), strict=True)])


@dataclass
class Blocks:
    """Tokens cut into blocks of BLOCK at most, longest first. place[b, t] is a token; size[b] its tokens; doc and nth say which
    block of which document; deep holds, for each n > 0, the blocks that are the n-th of theirs, and the ones before them."""

    place: np.ndarray
    size: np.ndarray
    token: np.ndarray
    deep: list[tuple[np.ndarray, np.ndarray]]


def cut_blocks(first: np.ndarray) -> Blocks:
    n = np.diff(first)
    per = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[doc] + nth * BLOCK
    size = np.minimum(BLOCK, first[doc + 1] - begin)
    order = np.argsort(-size, kind="stable")
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    place = begin[order][:, None] + np.arange(size.max(initial=0))[None, :]
    token = np.arange(size.max(initial=0))[None, :] < size[order][:, None]
    by_depth = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by_depth], np.arange(1, int(per.max(initial=0)) + 1))
    deep = [(at[by_depth[i:j]], at[by_depth[i:j] - 1]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return Blocks(np.where(token, place, 0), size[order], token, deep)


def forward_backward(u: np.ndarray, trans: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state by token, and (for fitting) the expected transitions and the log normaliser.

    u are log odds of the toxic state's emission, trans[x, y] weights from state x to y; a sequence starts in state 0.
    """
    nb, width = blocks.place.shape
    marginal, pairs, log_z = np.zeros(len(u)), np.zeros((2, 2)), 0.0
    if not nb:
        return marginal, pairs, np.array(log_z)
    e = np.where(blocks.token, np.exp(np.clip(u[blocks.place], -30, 30)), 1.0).T.copy()  # [t, b]
    active = np.searchsorted(-blocks.size, -np.arange(width), side="left")  # blocks longer than t
    (t00, t01), (t10, t11) = trans
    start, end = np.tile([1.0, 0.0], (nb, 1)), np.ones((nb, 2))
    if blocks.deep:
        multi = np.unique(np.concatenate([np.concatenate(d) for d in blocks.deep]))
        p = np.tile(np.eye(2), (len(multi), 1, 1))
        for t in range(width):
            m = np.searchsorted(multi, active[t])
            q, et = p[:m], e[t, multi[:m]]
            a, b = q[:, :, 0].copy(), q[:, :, 1].copy()
            q[:, :, 0] = a * t00 + b * t10
            q[:, :, 1] = (a * t01 + b * t11) * et[:, None]
            q /= q.sum((1, 2), keepdims=True)
        which = np.full(nb, -1)
        which[multi] = np.arange(len(multi))
        for here, before in blocks.deep:
            v = np.einsum("bi,bij->bj", start[before], p[which[before]])
            start[here] = v / v.sum(1, keepdims=True)
        for here, before in reversed(blocks.deep):
            v = np.einsum("bij,bj->bi", p[which[here]], end[here])
            end[before] = v / v.sum(1, keepdims=True)
    a0, a1 = start[:, 0].copy(), start[:, 1].copy()
    alpha0, alpha1 = np.empty((width, nb)), np.empty((width, nb))
    for t in range(width):
        m = active[t]
        x, y = a0[:m], a1[:m]
        n0, n1 = x * t00 + y * t10, (x * t01 + y * t11) * e[t, :m]
        s = n0 + n1
        log_z += np.log(s).sum()
        a0[:m], a1[:m] = n0 / s, n1 / s
        alpha0[t], alpha1[t] = a0, a1
    b0, b1 = end[:, 0].copy(), end[:, 1].copy()
    out = np.zeros((nb, width))
    for t in range(width - 1, -1, -1):
        m = active[t]
        x, y = alpha0[t, :m] * b0[:m], alpha1[t, :m] * b1[:m]
        s = x + y
        out[:m, t] = y / s
        p0, p1 = (alpha0[t - 1, :m], alpha1[t - 1, :m]) if t else (start[:m, 0], start[:m, 1])
        c0, c1 = b0[:m], b1[:m] * e[t, :m]
        z = p0 * (t00 * c0 + t01 * c1) + p1 * (t10 * c0 + t11 * c1)
        pairs += np.array([[(p0 * t00 * c0 / z).sum(), (p0 * t01 * c1 / z).sum()], [(p1 * t10 * c0 / z).sum(), (p1 * t11 * c1 / z).sum()]])
        n0, n1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
        s = n0 + n1
        b0[:m], b1[:m] = n0 / s, n1 / s
    marginal[blocks.place[blocks.token]] = out[blocks.token]
    return marginal, pairs, np.array(log_z)


@dataclass
class Model:
    """weights by table place, the emission's bias, log transition weights, and the document layer's coefficients."""

    weights: np.ndarray
    bias: float
    log_trans: np.ndarray
    layer: np.ndarray

    def marginals(self, w: Words) -> np.ndarray:
        return forward_backward(emission(self.weights, self.bias, features(w)), np.exp(self.log_trans), cut_blocks(w.first))[0]

    def scores(self, w: Words, marginal: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregates(w.first, marginal) @ self.layer, -50, 50)))


def aggregates(first: np.ndarray, marginal: np.ndarray) -> np.ndarray:
    """1, log(1 + expected toxic tokens), the largest marginal, and log(1 + expected tokens besides it) of each document."""
    n = len(first) - 1
    total, most = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        total[some] = np.add.reduceat(marginal, first[some])
        most[some] = np.maximum.reduceat(marginal, first[some])
    return np.stack([np.ones(n), np.log1p(total), most, np.log1p(total - most)], axis=1)


@dataclass
class Chunk:
    """Some training documents: their words' bounds, features and labels, without the texts."""

    first: np.ndarray
    places: np.ndarray
    toxic: np.ndarray


def training_chunks(texts: list[str], toxic: np.ndarray) -> list[Chunk]:
    """Documents in parts of about CHUNK_CHARS, so what is held of a part while it is read stays small."""
    out, start = [], 0
    ends = np.cumsum([len(t) for t in texts])
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_CHARS, side="right")))
        w = letter_words(pa.array(texts[start:stop], pa.string()))
        out.append(Chunk(w.first, features(w), toxic[start:stop]))
        start = stop
    return out


def token_labels(chunks: list[Chunk]) -> list[np.ndarray]:
    """For each chunk 1 for tokens of toxic documents that have a word or beginning of strong evidence, else 0."""
    is_toxic = [np.repeat(c.toxic, np.diff(c.first)) for c in chunks]
    labels = [np.zeros(len(t), dtype=bool) for t in is_toxic]
    for kind in range(_STEMS):
        keys = [mix64(mix64(c.places[_BEFORE].astype(np.uint64) * np.uint64(TABLE) + c.places[_AFTER].astype(np.uint64)) + mix64(c.places[kind].astype(np.uint64) * np.uint64(2) + t.astype(np.uint64))) for c, t in zip(chunks, is_toxic, strict=True)]
        at = np.unique(np.concatenate(keys), return_index=True)[1]
        place, mark = np.concatenate([c.places[kind] for c in chunks])[at], np.concatenate(is_toxic)[at]
        a, b = (np.bincount(place[m], minlength=TABLE).astype(np.float64) for m in (mark, ~mark))
        share = a.sum() / max(1.0, a.sum() + b.sum())
        rate = a / np.maximum(a + b, 1)
        ratio = 2 * (a * np.log(np.maximum(rate, 1e-12) / max(share, 1e-12)) + b * np.log(np.maximum(1 - rate, 1e-12) / max(1 - share, 1e-12)))
        strong = (rate > share) & (rate >= MIN_RATE) & (ratio >= MIN_EVIDENCE)
        for c, t, y in zip(chunks, is_toxic, labels, strict=True):
            y |= strong[c.places[kind]] & t
    return labels


def emission(weights: np.ndarray, bias: float, places: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state for each token."""
    u = np.full(places.shape[1], bias)
    for kind in places:
        u += weights[kind]
    return u


def fit(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Model:
    """Fit on whole texts with document labels. Without a token of evidence the field stays flat and scores the classes' share."""
    chunks = training_chunks(texts, toxic)
    labels = token_labels(chunks)
    seen, work = np.zeros((2, 2)), [cut_blocks(c.first) for c in chunks]
    for c, y in zip(chunks, labels, strict=True):
        gone = np.concatenate(([0], y[:-1])).astype(np.int64) if len(y) else np.zeros(0, np.int64)
        gone[c.first[:-1][np.diff(c.first) > 0]] = 0
        seen += np.bincount(gone * 2 + y, minlength=4).reshape(2, 2)
    weights, bias, log_trans = np.zeros(TABLE), -4.0, np.zeros((2, 2))
    g2, gb2, gt2 = np.full(TABLE, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(steps if any(y.any() for y in labels) else 0):
        g, gb, pairs = -0.05 * weights, 0.0, np.zeros((2, 2))
        for c, y, blocks in zip(chunks, labels, work, strict=True):
            marginal, some, _ = forward_backward(emission(weights, bias, c.places), np.exp(log_trans), blocks)
            d, pairs = y - marginal, pairs + some
            gb += d.sum()
            for kind in c.places:
                g += np.bincount(kind, weights=d, minlength=TABLE)
        g2, gb2, gt2 = g2 + g * g, gb2 + gb**2, gt2 + (seen - pairs) ** 2
        weights += 0.5 * g / np.sqrt(g2)
        bias += 0.5 * gb / np.sqrt(gb2)
        log_trans = np.clip(log_trans + 0.1 * (seen - pairs) / np.sqrt(gt2), -6, 6)
    model = Model(weights.astype(np.float32), bias, log_trans, np.zeros(LAYER))
    weights = model.weights
    x = np.concatenate([aggregates(c.first, forward_backward(emission(weights, bias, c.places), np.exp(log_trans), b)[0]) for c, b in zip(chunks, work, strict=True)])
    target, balance = toxic.astype(np.float64), np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(toxic)
    layer, ridge = np.zeros(LAYER), np.full(LAYER, 1e-2)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -50, 50)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (balance * (target - p)) - ridge * layer)
        layer += step
        if np.abs(step).max() < 1e-9:
            break
    model.layer = layer
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on rows of docs (doc_id, text) that labels (doc_id, toxic) mark; about sample_docs toxic ones and 2 x sample_docs others, by a hash of doc_id.

    Null labels, ids and texts are passed over; with one class only, or none, every text scores by its share (0.5 without any).
    One task fits, on the bounded sample; the driver sees its sizes and the model.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = F.when(F.col("toxic") == 1, min(1.0, sample_docs / sizes.get(1, 1))).otherwise(min(1.0, 2 * sample_docs / sizes.get(0, 1)))
    chosen = F.broadcast(marked.where(place < rate))  # about 3 x sample_docs ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull())
    rows = staged(rows.select("doc_id", "text", "toxic", place.alias("place"), F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("row")), "toxicity-sample")
    sizes = sorted((r["place"], r["doc_id"], r["bytes"], r["row"]) for r in rows.select("place", "doc_id", "bytes", "row").collect())
    fits, held = [], 0
    for _, _, size, row in sizes:
        if held + size <= sample_bytes:
            fits, held = [*fits, row], held + size
    fitted = rows.where(F.col("row").isin(fits)).select("doc_id", "text", "toxic").groupBy(F.lit(0).alias("all"))
    ship(docs.sparkSession)
    raw = fitted.applyInArrow(_fit_rows, "model binary").first()
    return pickle.loads(raw[0]) if raw else _by_share(np.zeros(0, dtype=bool))


def _by_share(toxic: np.ndarray) -> Model:
    """A model that gives every text the classes' share."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    return Model(np.zeros(TABLE, np.float32), -4.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share))] + [0.0] * (LAYER - 1)))


def _fit_rows(rows: pa.Table) -> pa.Table:
    """The pickled model of one table (all, doc_id, text, toxic)."""
    some = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
    toxic = np.array([t == 1 for _, _, t in some], dtype=bool)
    model = fit([t for _, t, _ in some], toxic) if toxic.any() and not toxic.all() else _by_share(toxic)
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


_SCORES = [("score", "double"), ("predicted", "int"), ("n_toxic", "int"), ("offsets", "array<array<bigint>>")]


def _scores(model: Model, texts: pa.Array) -> list[pa.Array]:
    w = letter_words(texts)
    marginal = model.marginals(w)
    score = model.scores(w, marginal)
    hit = np.flatnonzero(marginal >= 0.5)
    _, text_at = buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    spans = np.stack([w.starts[hit] - text_at[w.doc[hit]], w.ends[hit] - text_at[w.doc[hit]]], axis=1)
    n = np.bincount(w.doc[hit], minlength=len(texts))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(hit) + 1, 2, dtype=np.int32)), pa.array(spans.reshape(-1).astype(np.int64)))
    outer = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), inner)
    return [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n.astype(np.int32)), outer]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and any others) with score, predicted, n_toxic and offsets; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotated(docs, _SCORES, lambda texts: _scores(shared.value, texts))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_toxic, offsets of every row of docs (doc_id, text; others are left aside).

    offsets are [begin, end) in bytes of the lower-cased UTF-8 text of each token whose marginal is 1/2 or more. Null and empty
    texts score as texts without toxic tokens. Rows are independent: nothing is shuffled; repeated rows and null ids are rows like
    any other, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *_scores(shared.value, part.column(1))], names=["doc_id", *[n for n, _ in _SCORES]])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in _SCORES))
