"""Packing: ids by the library, pieces that rebuild every document, sequences without gaps, little padding, and the plan by itself."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellscape.llm import packing as P
from cellscape.llm import queries as Q

MODEL = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Ａ ｂ", "é e ́x", "İSTANBUL ΟΔΟΣ Σ", "don't 's 'S we'll", "<|endoftext|>x <|startoftext|> <|endoftext|", "tab\tline\n\x0bvt\x0cff\rcr", "a b c　d\x85e\x1cf", "x" * 5_000, "½ ² 12 3٣", "̈́क़ क़", "🙂🙂 👨‍👩‍👧", "\x00 \x00", "word, word. word,. word.) Ünd ünd, straße. ǆ ǅ ŉ, ﬁ. ªº, ʼn i̇stan", "word " * 9_000, "w " * 4_095, "w " * 4_096]


def test_words_have_the_ids_of_texts():
    with open(MODEL, "rb") as f:
        encode = P.Encoder(f.read())
    assert encode.by_word
    texts = [*ODD, *[t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]]
    library = Tokenizer.from_file(MODEL)
    for part in (texts, texts[::-1]):
        ids, bounds = encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_other_rules_encode_whole_texts(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        encode = P.Encoder(f.read())
    ids, bounds = encode(["a b", "", " c"])
    assert not encode.by_word and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [encode.library.encode(t).ids for t in ("a b", "", " c")]
    monkeypatch.setattr(P, "MEMO_WORDS", 3)
    with open(MODEL, "rb") as f:
        encode = P.Encoder(f.read())
    for text in ("one two three four", "five six", "one two"):
        assert encode([text])[0].tolist() == encode.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {4095: 3}, {2100: 1000}, {300: 10_007}, {2048: 5, 1: 3}, {k: 3 for k in range(1, 4096)}, {1: 10**9, 4000: 10}, {3000: 50, 2500: 60, 700: 11}, {4096 - 70: 40, 3: 2}])
def test_plans_place_every_rest_once(histogram):
    packs = P.shortest_pack_first(histogram)
    held = Counter()
    for count, pattern in packs:
        assert sum(n * t for n, t in pattern) <= P.LIMIT
        held.update({n: 0 for n, _ in pattern})
        for n, t in pattern:
            held[n] += count * t
    assert held == Counter(histogram)
    plan, total = P.planned(histogram), sum(histogram.values())
    if total > 200_000:
        assert plan.sequences * P.LIMIT <= sum(n * c for n, c in histogram.items()) + 20 * P.LIMIT
        return
    rest, size, sequence, offset = P.placed(plan, np.arange(total))
    lengths = np.repeat(sorted(histogram, reverse=True), [histogram[k] for k in sorted(histogram, reverse=True)]) if total else np.zeros(0)
    assert np.array_equal(np.bincount(rest, size, minlength=total), lengths) and (np.diff(rest) >= 0).all()
    check_sequences(sequence, offset, size, sum(n * c for n, c in histogram.items()))


def check_sequences(sequence, offset, size, tokens):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], size[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (n > 0).all()
    ends = (o + n)[np.concatenate((first[1:], [True]))[: len(s)]]
    padded = np.where((ends & (ends - 1)) == 0, ends, P.LIMIT)
    assert (ends <= P.LIMIT).all() and padded.sum() - ends.sum() <= 0.016 * tokens + 2 * P.LIMIT


def whole(got, texts):
    """Every document is rebuilt by its pieces, and each piece has its ids' checksum."""
    library = Tokenizer.from_file(MODEL)
    ids = {i: [*e.ids, 2] for i, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for i, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = np.array(ids[i][r.start : r.start + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, len(own), r.ids_crc32) == (at, len(ids[i]), r.length, zlib.crc32(own.tobytes()))
            at += r.length
        assert at == len(ids[i])
    check_sequences(*[np.array([r[c] for r in got]) for c in ("sequence_id", "offset", "length")], sum(map(len, ids.values())))


def test_op12_on_the_table(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    whole(Q.op12_packing(spark, "/root/testdata/sf0.001").collect(), texts)


def test_pack_odd_documents(spark):
    rows = [*enumerate([None, *ODD]), *[(100 + i, "same text again " * 700) for i in range(40)]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(4)
    whole(P.pack(df, MODEL).collect(), dict(rows))
    twice = P.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), MODEL).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 3), (1, 3)]
    assert P.pack(df.limit(0), MODEL).count() == 0
