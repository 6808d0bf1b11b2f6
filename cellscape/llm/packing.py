"""Packing (operator 12): documents into sequences of a fixed length, by shortest-pack-first over the histogram of their lengths.

A document's ids are cut into full sequences, which need no company, and a rest. Only the histogram of the rests (a count for each
length below the limit) decides how they are packed, so the plan is made on the driver from at most that many numbers, whatever the
corpus: lengths are placed longest first, each into the pack with the most room, and packs of one kind are one pattern with a count.

Packs that stay short would be padded. The emptiest of them are taken apart and their rests fill the others' room: a rest is cut where
that room ends. Room under `LEAST_CUT` ids stays padded, so documents aren't cut into crumbs; a pack whose total is a power of two
needs no padding and is left alone.

Rests are numbered in the order of their lengths, over ranges in parallel; which pack a rest is in follows from its number and the
plan, and joins back to the document's ids by its row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import arrow_map, staged
from cellscape.llm.textarrays import slices
from cellscape.operators.ranking import row_numbers

LIMIT, END_ID, LEAST_CUT = 4096, 2, 64
MEMO_WORDS, SLICE_BYTES = 3 << 19, 2 << 20
"""A worker that knows the ids of more words forgets the less used half of them."""
# Fixed value: the pattern whose matches are encoded by themselves. None crosses white space, which is dropped.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Numbers(dict):
    """Numbers of words, -1 of unknown ones."""

    def __missing__(self, word: bytes) -> int:
        return -1


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model file's bytes, made once a worker: what it knows of words serves its next tasks too."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


@dataclass
class Encoder:
    """Ids of texts by a tokenizer file's bytes.

    Where the file's rules drop white space and split at it, a text's ids are those of its words (split at ASCII white space) one
    after the other, and the ids of words are kept; else whole texts go to the library.
    """

    model: bytes
    at: Numbers = field(default_factory=lambda: Numbers())
    pool: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint32))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    uses: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def __post_init__(self):
        from tokenizers import Tokenizer

        self.library, spec = Tokenizer.from_buffer(self.model), json.loads(self.model)
        self.by_word = drops_space(spec)
        if self.by_word:  # the same model for words that the rules leave as they are
            split = [{"type": "WhitespaceSplit"}, *spec["pre_tokenizer"]["pretokenizers"][1:]]
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}}))
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        if not self.by_word:
            found = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, dtype=np.uint32)]), np.cumsum([0, *map(len, found)])
        raw = [t.encode() for t in texts]  # case is only kept where a special token, which has its own, may be meant
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        words = list(chain.from_iterable(split))
        if len(self.at) > MEMO_WORDS:
            self._forget()
        code = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            self._learn({words[i] for i in new})
            code[new] = [self.at[words[i]] for i in new]
        used = np.bincount(code)
        self.uses[: len(used)] += used
        ids, total = self._ids(code)
        return ids, total[np.cumsum([0, *map(len, split)])]

    def _ids(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, one after the other, and where each word's begin."""
        sizes = self.first[code + 1] - self.first[code]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[np.repeat(self.first[code] - total[:-1], sizes) + np.arange(total[-1])], total

    def _learn(self, words: set[bytes]) -> None:
        """Ids of words that aren't known yet. Marks behind a plain word are a part by themselves, so "word" and "word," are one to learn."""
        cut, plain, other = {}, set(), set()
        for w in words:
            word = w.decode()
            core = word.rstrip(MARKS)
            if not is_plain(core):
                other.add(w)
                continue
            plain.add(core.encode())
            if len(core) < len(word):
                cut[w] = (core.encode(), word[len(core) :].encode())
                other.add(cut[w][1])
        self._add_plain([w for w in plain if w not in self.at])
        self._add_texts([w for w in other if w not in self.at])
        if cut:
            parts = np.array([self.at[p] for pair in cut.values() for p in pair])
            ids, total = self._ids(parts)
            self._add(list(cut), ids, np.diff(total[::2]))

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        known, held = len(self.at), int(self.first[len(self.at)])
        self.at.update(zip(words, range(known, known + len(words)), strict=True))
        self.pool = _put(self.pool, held, ids)
        self.first = _put(self.first, known + 1, held + np.cumsum(sizes))
        self.uses = _put(self.uses, known, np.zeros(len(words), dtype=np.int64))

    def _add_plain(self, words: list[bytes]) -> None:
        """Plain words, all at once as one text; the model's own mark of a word's end tells them apart."""
        if words:
            ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("a word of the tokenizer's model has no end")
            self._add(words, ids, np.diff(ends, prepend=0))

    def _add_texts(self, words: list[bytes]) -> None:
        """Other words by the whole tokenizer, all at once as one text, told apart by their places in it."""
        if words:
            spelled = [w.decode() for w in words]
            found = self.library.encode(" ".join(spelled), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in spelled])
            own = np.searchsorted(ends, np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found)), side="right")
            self._add(words, np.array(found.ids, dtype=np.uint32), np.bincount(own, minlength=len(words)))

    def _forget(self) -> None:
        """Keep the more used half of the words."""
        kept = np.sort(np.argsort(-self.uses[: len(self.at)], kind="stable")[: len(self.at) // 2])
        words, sizes = list(self.at), np.diff(self.first)[kept]
        self.at = Numbers((words[i], k) for k, i in enumerate(kept.tolist()))
        first = np.concatenate(([0], np.cumsum(sizes)))
        self.pool = self.pool[np.repeat(self.first[kept] - first[:-1], sizes) + np.arange(first[-1])]
        self.first, self.uses = first, self.uses[kept]


def _put(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """array with `more` from place `at` on, with room to grow: it is copied only when it doubles."""
    if at + len(more) > len(array):
        array = np.concatenate([array[:at], np.zeros(at + len(more), dtype=array.dtype)])
    array[at : at + len(more)] = more
    return array


MARKS = ".,;:!?"


def is_plain(word: str) -> bool:
    """Whether a word is of small Latin letters only: no rule changes or splits it."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250") and word == word.lower()


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer file's rules make the ids of words independent of each other."""
    before = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    known = [n["type"] for n in before] == ["NFC", "Replace", "Lowercase"] and before[1]["pattern"] == {"Regex": r"\s+"} and before[1]["content"] == " "
    split = parts[0].get("type") == "Split" and parts[0]["pattern"] == {"Regex": SPLITS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    plain = not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "normalized", "single_word")) and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    return known and split and plain and [p["type"] for p in parts[1:]] == ["ByteLevel"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and spec["model"]["type"] == "BPE"


Pack = tuple[int, tuple[tuple[int, int], ...]]
"""How many packs there are of this kind, and their (length, times) in order."""


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[Pack]:
    """Packs of rests of at most `limit`, lengths placed longest first into the pack with the most room."""
    open_: dict[int, list[Pack]] = {}
    done: list[Pack] = []

    def put(room: int, pack: Pack) -> None:
        open_.setdefault(room, []).append(pack) if room else done.append(pack)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                many = limit // length
                if packs := left // many:
                    put(limit - many * length, (packs, ((length, many),)))
                if rest := left % many:
                    put(limit - rest * length, (1, ((length, rest),)))
                break
            count, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
            packs = min(count, left)
            times = max(1, min((room - max(open_, default=0)) // length, left // packs))
            put(room - times * length, (packs, (*pattern, (length, times))))
            if count > packs:
                put(room, (count - packs, pattern))
            left -= packs * times
    return done + [p for packs in open_.values() for p in packs]


@dataclass
class Plan:
    """Where rests go, by their number in the order of lengths (longest first, from 0).

    A slot is a run of numbers: `begin`, their `length`, the sequence of the first, how many share a sequence (`times`), the offset
    of the first there; a slot of sequence -1 is cut up: its first id is at place `stream` of a stream of ids that fills rooms. A room
    is a run of sequences with the same space: place in the stream, space, first sequence. `sequences` of them are packs.
    """

    begin: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    stream: np.ndarray
    room_at: np.ndarray
    room: np.ndarray
    room_sequence: np.ndarray
    sequences: int
    limit: int


def planned(histogram: dict[int, int], limit: int = LIMIT, least_cut: int = LEAST_CUT) -> Plan:
    """The plan for the rests of a histogram."""
    total = lambda pattern: sum(n * t for n, t in pattern)
    packs = sorted(shortest_pack_first(histogram, limit), key=lambda p: total(p[1]))
    short = [i for i, (_, pattern) in enumerate(packs) if limit - total(pattern) >= least_cut and total(pattern) & (total(pattern) - 1)]
    space = sum(packs[i][0] * (limit - total(packs[i][1])) for i in short)
    apart = dict.fromkeys(range(len(packs)), 0)
    for i in short:  # the emptiest first: so many of them that what they hold fits into the others' room
        fit = min(packs[i][0], space // limit)
        apart[i], space = fit, space - fit * limit
        if fit < packs[i][0]:
            break
    slots, rooms, loose, sequence = [], [], {}, 0
    for i, (count, pattern) in enumerate(packs):
        kept, at = count - apart[i], 0
        for length, times in pattern:
            if kept:
                slots.append((length, kept * times, sequence, times, at))
            if apart[i]:
                loose[length] = loose.get(length, 0) + apart[i] * times
            at += length * times
        if kept and i in short:
            rooms.append((limit - at, kept, sequence))
        sequence += kept
    slots += [(length, n, -1, 1, 0) for length, n in loose.items()]
    slots.sort(key=lambda s: (-s[0], s[2]))
    rooms.sort(reverse=True)
    counts = np.array([s[1] for s in slots], dtype=np.int64)
    length = np.array([s[0] for s in slots], dtype=np.int64)
    gone = np.array([s[2] < 0 for s in slots], dtype=bool)
    before = lambda x: np.concatenate(([0], np.cumsum(x)))[:-1]
    column = lambda rows, k: np.array([r[k] for r in rows], dtype=np.int64)
    return Plan(before(counts), length, column(slots, 2), column(slots, 3), column(slots, 4), before(counts * length * gone), before(column(rooms, 0) * column(rooms, 1)), column(rooms, 0), column(rooms, 2), sequence, limit)


def placed(plan: Plan, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rest, length, sequence, offset) of the pieces of rests with these numbers; rest is a place in `number`, its pieces in order."""
    slot = np.searchsorted(plan.begin, number, side="right") - 1
    nth, length = number - plan.begin[slot], plan.length[slot]
    whole = plan.sequence[slot] >= 0
    out = [(np.flatnonzero(whole), length[whole], (plan.sequence[slot] + nth // plan.times[slot])[whole], (plan.offset[slot] + nth % plan.times[slot] * length)[whole])]
    rest = np.flatnonzero(~whole)
    at, left = (plan.stream[slot] + nth * length)[rest], length[rest]
    while len(rest):
        k = np.searchsorted(plan.room_at, at, side="right") - 1
        within, room = (at - plan.room_at[k]) % plan.room[k], plan.room[k]
        piece = np.minimum(left, room - within)
        out.append((rest, piece, plan.room_sequence[k] + (at - plan.room_at[k]) // room, plan.limit - room + within))
        more = left > piece
        rest, at, left = rest[more], (at + piece)[more], (left - piece)[more]
    joined = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(c[order] for c in joined)


def token_ids(docs: DataFrame, model: bytes, end_id: int = END_ID) -> DataFrame:
    """doc_id, _row (a number of each row's own), doc_tokens and ids (little-endian, 2 bytes each where the ids are below 65,536, else 4) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = _wide(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, bounds = encode([t or "" for t in part.column("text").to_pylist()])
                raw = [np.append(ids[a:b], end_id).astype(wide).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_row"), pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "_row", "doc_tokens", "ids"])

    return arrow_map(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), run, "doc_id long, _row long, doc_tokens long, ids binary")


def _wide(model: bytes) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_buffer(model).get_vocab_size() <= 1 << 16 else "<u4"


def pack(docs: DataFrame, model: str, limit: int = LIMIT, end_id: int = END_ID, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces of all documents of docs (doc_id, text; other columns are left aside) in sequences of at most `limit` ids: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows and null ids are documents of their own; an empty table gives no pieces.
    Sequences of packs are numbered from 0, full ones of a single document behind them, not densely. model is a tokenizer file's path
    on the driver; its bytes are broadcast.
    """
    with open(model, "rb") as f:
        raw = f.read()
    wide = _wide(raw)
    told = staged(token_ids(docs, raw, end_id), "packing-ids")
    narrow = told.select("_row", (F.col("doc_tokens") % limit).cast("int").alias("_rest"), F.floor(F.col("doc_tokens") / limit).alias("_full"))
    counts = {r._rest: r.n for r in narrow.groupBy("_rest").agg(F.count("*").alias("n")).collect()}  # a row a length below the limit
    most = narrow.agg(F.max("_full")).first()[0] or 0
    plan = docs.sparkSession.sparkContext.broadcast(planned({k: n for k, n in counts.items() if k}, limit, least_cut))
    numbered = row_numbers(narrow.select("_row", "_rest"), [F.desc("_rest"), F.col("_row")], "_number")
    met = told.join(numbered.select("_row", "_number"), "_row").select("doc_id", "ids", "doc_tokens", "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Plan = plan.value
        for batch in batches:
            tokens, number = (batch.column(c).to_numpy() for c in ("doc_tokens", "_number"))
            row, size, sequence, offset = _pieces(own, tokens, number - 1, most)
            start = _starts(row, size)
            ids = [np.frombuffer(x, dtype=wide).astype("<u4") for x in batch.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[r][a : a + n]) for r, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *[pa.array(c, pa.int64()) for c in (start, size, crc, tokens[row], sequence, offset)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow_map(met, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pieces(plan: Plan, tokens: np.ndarray, number: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, sequence, offset) of the pieces of documents of so many tokens whose rests have these numbers, each row's in order."""
    full = tokens // plan.limit
    row = np.repeat(np.arange(len(tokens)), full)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    some = np.flatnonzero(tokens % plan.limit)
    rest, size, sequence, offset = placed(plan, number[some])
    parts = [(row, np.full(len(row), plan.limit), plan.sequences + number[row] * most + nth, np.zeros(len(row), dtype=np.int64)), (some[rest], size, sequence, offset)]
    joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(c[order] for c in joined)


def _starts(row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of the same row before each piece."""
    before = np.cumsum(size) - size
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
    return before - np.maximum.accumulate(np.where(first, before, 0)) if len(row) else before
