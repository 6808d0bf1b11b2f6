"""Language identification (operator 1): multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language on Spark and keeps one table of log probabilities, `buckets` x languages, which is broadcast;
its size depends on the parameters alone. Scoring takes slices of texts in numpy: each n-gram's bucket picks its row of the
table, and one segmented sum a language gives the log likelihoods.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscape.llm.common import arrow_map
from cellscape.llm.textarrays import slices

BUCKETS = 1 << 16
ORDERS = (2, 3)
SAMPLE_DOCS = 4_000
"""At most about so many labelled documents of each language are counted (by a hash of doc_id); a bounded fit, as documented."""
SMOOTHING = 0.5
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_buckets(texts: list[str | None], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of every text, rows in order, and whether each text has a letter.

    Texts are lower-cased and what isn't a letter counts as a space; each text is seen with a space before and after it.
    """
    joined = "\0".join(f" {(t or '').replace(chr(0), ' ').lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bound = codes == 0
    letter = _letter_table()[codes]
    row = np.cumsum(bound, dtype=np.int32)
    has = np.zeros(len(texts), dtype=bool)
    has[row[letter]] = True
    codes = np.where(letter, codes, np.uint32(32))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    found, rows = [], []
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        inside = (row[: len(h)] == row[n - 1 :]) & ~bound[: len(h)]
        found.append(((h * np.uint32(0xC2B2AE35)) >> shift)[inside].astype(np.int32))
        rows.append(row[: len(h)][inside])
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(rows) if rows else np.zeros(0, np.int32), has


@dataclass
class Model:
    """langs in code point order; weights[l] are the log probabilities of the buckets, prior[l] that of the language."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out = np.tile(self.prior, (len(texts), 1))
        has = np.zeros(len(texts), dtype=bool)
        bucket, row, has = ngram_buckets(texts, self.orders, self.weights.shape[1])
        split = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, dtype=np.int64)
        for k in range(len(self.langs)):
            if len(row):
                np.add.at(out[:, k], row[split], np.add.reduceat(self.weights[k][bucket], split, dtype=np.float64))
        return out, has


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Model:
    """Fit on rows (doc_id, text, lang); rows without text or lang are passed over. Needs one language at least.

    Of each language about sample_docs rows are taken (all, if fewer), by a hash of doc_id; the counts are exact over these.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros(0), orders)
    langs = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == F.lit(k), F.lit(min(1.0, sample_docs / n))) for k, n in sizes.items()])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(place < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column(1).to_pylist()
                bucket, row, _ = ngram_buckets(part.column(0).to_pylist(), orders, buckets)
                for lang in set(names):
                    mine = np.fromiter((x == lang for x in names), dtype=bool, count=len(names))
                    totals.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                    totals[lang] += np.bincount(bucket[mine[row]], minlength=buckets)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = arrow_map(sample.select("text", "lang"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(langs), buckets), SMOOTHING)
    for batch in counted.toArrow().to_batches():  # languages x buckets entries at most
        at = np.searchsorted(np.array(langs), np.array(batch.column(0).to_pylist())) if batch.num_rows else np.zeros(0, int)
        table[at, batch.column(1).to_numpy()] += batch.column(2).to_numpy()
    prior = np.log(np.array([sizes[k] for k in langs], dtype=np.float64) / sum(sizes.values()))
    return Model(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32), prior, orders)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text).

    lang_pred is the language of largest posterior (ties: the first in code point order) and score that posterior. A null text,
    one without a letter, and any text under a model without languages get `und` and 0. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                if model.langs:
                    value, has = model.log_likelihoods(part.column(1).to_pylist())
                    best = value.argmax(1)
                    score = np.where(has, 1 / np.exp(value - value.max(1, keepdims=True)).sum(1), 0.0)
                    lang = [model.langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
                else:
                    score, lang = np.zeros(part.num_rows), [UNDETERMINED] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds; -1 for a null id, which is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds), F.lit(-1))
