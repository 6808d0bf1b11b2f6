"""Token counts (operator 9): overlap resynchronisation for huge documents.

A text up to `chunk_chars` long is encoded whole. A longer one is cut into chunks that overlap by `overlap_chars`, each is
encoded with offsets, and neighbouring encodings are spliced at a common boundary that is proven stable:

* no piece of the vocabulary has a word mark after another character (`crosses_words` proves it when the model is loaded), and
  byte and unknown pieces cover one character, so merges never reach across the start of a word; what a text's pieces are on
  either side of such a place doesn't depend on the other side. A word starts at a space that follows a non-space character.
* the splice also has to be a token boundary in both encodings. If the overlap holds no such place, it is doubled until it
  does or until it covers the text's rest, which is then one chunk.

The dummy space that the library puts before a text belongs to the first chunk alone; later chunks begin at the space of their
splice, which takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellscape.llm.common import arrow_map
from cellscape.llm.textarrays import slices

CHUNK_CHARS = 200_000
OVERLAP_CHARS = 2_000
LIMIT = 4096
_MARK = "▁"
_models: dict[bytes, object] = {}


def processor(model: bytes):
    """The processor of a model file's bytes, loaded once a worker; refused if a piece crosses words."""
    if model not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if crosses_words(sp):
            raise ValueError("a piece reaches across words; splices wouldn't be stable")
        _models[model] = sp
    return _models[model]


def crosses_words(sp) -> bool:
    """Whether a normal piece holds a word mark after a character that isn't one."""
    return any(_MARK in sp.id_to_piece(i).lstrip(_MARK) for i in range(sp.get_piece_size()))


def _starts(sp, text: str) -> list[tuple[int, int]]:
    """(begin, end) of each token in characters of text; the library tells bytes."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(char[p.begin]), int(char[p.end])) for p in sp.encode(text, return_type="proto").pieces]


def splice_point(left: list[int], right: set[int], text: str, low: int, high: int) -> int | None:
    """The first stable place in (low, high) where both encodings have a token boundary; places are offsets in text."""
    for at in left:
        if low < at < high and text[at] == " " and text[at - 1] not in (" ", _MARK) and at in right:
            return at
    return None


def count_tokens(sp, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """Tokens of a whole text, encoded in overlapping chunks if it is longer than chunk_chars."""
    total, begin = 0, 0
    while len(text) - begin > chunk_chars:
        overlap = overlap_chars
        while True:
            stop, back = begin + chunk_chars, begin + max(1, chunk_chars - overlap)
            if overlap >= chunk_chars and stop < len(text):  # no stable place so far: the chunk itself grows
                stop = min(len(text), begin + chunk_chars + overlap)
            left = _chunk(sp, text, begin, stop)
            at = None
            if stop < len(text):
                first = text.find(" ", back, stop)
                if first >= 0:
                    right = {b for b, _ in _chunk(sp, text, first, min(len(text), stop + overlap))}
                    at = splice_point([b for b, _ in left], right, text, max(first - 1, begin), stop)
            if at is not None or stop >= len(text):
                break
            overlap *= 2
        if at is None:
            return total + len(left)
        total += sum(b < at for b, _ in left)
        begin = at
    return total + len(_chunk(sp, text, begin, len(text)))


def _chunk(sp, text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Tokens of text[begin:end] with offsets in text. A chunk after the first begins with a space that stands in for the dummy one."""
    part = text[begin:end] if not begin else text[begin + 1 : end]
    shift = begin if not begin else begin + 1
    if begin and text[begin] != " ":
        raise AssertionError("a later chunk begins at a space")
    spans = _starts(sp, part)
    out = [(b + shift, e + shift) for b, e in spans]
    if begin and out:
        out[0] = (begin, out[0][1])
    return out


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text; other columns are left aside).

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; an empty table gives none.
    Rows are independent: no shuffle, and a task holds one slice of texts at a time. model is a path on the driver; the file's
    bytes (under 1 MB) are broadcast, so executors need no copy of it.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                counts = np.zeros(len(texts), dtype=np.int64)
                for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                    counts[i] = len(ids)
                for i in set(range(len(texts))) - set(short):
                    counts[i] = count_tokens(sp, texts[i], chunk_chars, overlap_chars)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select("doc_id", "text"), run, schema)
