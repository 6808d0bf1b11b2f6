"""The operators' kernels against brute force, on small inputs."""

import itertools
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cellscape.llm import decontamination as D
from cellscape.llm import jaccard_join as J
from cellscape.llm import language_id as L
from cellscape.llm import line_dedup as N
from cellscape.llm import mixing as M
from cellscape.llm import textarrays as A
from cellscape.llm import token_counts as C
from cellscape.llm import toxicity as X
from cellscape.llm import warc as R

TEXTS = ["a b c d e f", "A B\tc  d\ne f", None, "", "one two", "   ", "x " * 50]


def test_shingles_match_a_plain_split():
    values, first = A.distinct_sets(*A.shingle_hashes(A.words(pa.array(TEXTS))))
    for d, text in enumerate(TEXTS):
        w = (text or "").lower().split()
        expected = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert first[d + 1] - first[d] == len(expected)
    sets = [set(values[first[d] : first[d + 1]].tolist()) for d in range(len(TEXTS))]
    assert sets[0] == sets[1] and sets[0] != sets[4]


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(TEXTS)], names=["id", "text"])
    parts = list(A.slices(batch, "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7)) and len(parts) > 2
    assert [len(A.words(p.column(1)).first) for p in parts] == [p.num_rows + 1 for p in parts]


def test_deltas_round_trip():
    keys = np.sort(np.array([0, 0, 5, 65534, 65535, 65536, 300_000, 2**31], dtype=np.int64))
    assert J.undeltas(J.deltas(keys)).tolist() == keys.tolist()


def test_bitmaps_never_refute_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        a, b = np.unique(base[: rng.integers(30, 41)]), np.unique(np.concatenate((base[: rng.integers(28, 41)], rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64))))
        maps = J._bitmaps(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        differ = sum(int(x ^ y).bit_count() if x >= 0 and y >= 0 else bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(*maps, strict=True))
        assert differ <= len(np.setxor1d(a, b))


def test_sainte_lague_matches_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes, most = rng.integers(1, 1000, 6).astype(float), rng.integers(1, 60, 6)
        seats = int(rng.integers(0, 200))
        given = np.zeros(6, dtype=int)
        for _ in range(min(seats, int(most.sum()))):
            given[np.argmax(np.where(given < most, votes / (2 * given + 1), -1))] += 1
        assert M.sainte_lague(votes, seats, most).tolist() == given.tolist()


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    rng = np.random.default_rng(0)
    first, u, trans = np.array([0, 3, 3, 14]), rng.normal(size=14), np.exp(rng.normal(size=(2, 2)))
    got = X.forward_backward(u, trans, X.cut_blocks(first))[0]
    for a, b in ((0, 3), (3, 14)):
        total, hit = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=b - a):
            v = np.prod([trans[p, y] * np.exp(u[a + k] * y) for k, (p, y) in enumerate(zip((0, *ys), ys))])
            total, hit = total + v, hit + v * np.array(ys)
        assert np.allclose(got[a:b], hit / total)


def test_patience_blocks():
    assert N.longest_chain([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    position, at = np.array([0, 1, 2, 5, 6, 9]), np.array([10, 11, 12, 3, 4, 5])
    ids, size, begin = np.zeros(6, dtype=int), np.array([1, 1, 1, 1, 1, 1]), np.array([0, 12, 24, 60, 72, 90])
    words = np.full(6, 12)
    assert N.aligned(ids, ids, position, at, size, begin, words, 24).all()  # the block off the chain has 36 words
    assert N.aligned(ids, ids, position, at, size, begin, words, 37).tolist() == [False] * 3 + [True] * 3
    assert N.moved(position[3:], at[3:], size[3:], begin[3:], words[3:], 24).tolist() == [True, True, False]
    assert N.aligned(ids, np.arange(6), position, at, size, begin, words, 24).all()


def test_wand_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary, 12)) for _ in range(30)]
    texts = [" ".join(rng.choice(vocabulary, 150)) + " " + items[i % 30] for i in range(10)] + [None, ""]
    (index,), w = D.build_indexes(list(range(30)), items, [None] * 30), D.plain_words(pa.array(texts))
    got = {(r, i, b) for r, i, b, _, _ in D.search(index, w)}
    want = set()
    for r in range(len(texts)):
        for c in range(max(1, -(-(w.first[r + 1] - w.first[r]) // index.stride))):
            b = w.first[r] + c * index.stride
            part = w.hashes[b : min(b + 2 * index.stride, w.first[r + 1])]
            want |= {(r, i, b) for i in range(30) if index.weights[i][np.isin(index.terms[index.item_terms[i]], part)].sum() >= D.THRESHOLD - 1e-9}
    assert got == want and got


def test_token_splices_are_exact():
    public = pytest.importorskip("public_tokenizers")
    sp = C.processor(Path(public.path("piece_bpe_32k.model")).read_bytes())
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = "".join(rng.choice(list("ab  \n\té漢.the▁"), rng.integers(1, 300)))
        assert C.count_tokens(sp, text, 30, 5) == len(sp.encode(text))


def test_ngram_rows_and_letters():
    bucket, row, has = L.ngram_buckets(["Ab", None, "12 3"])
    assert has.tolist() == [True, False, False] and len(bucket) == len(row)


def test_plain_text():
    page = "<html lang='en'><head><title>T &amp; t</title><script>x<y</script></head><body><p>One<br>two&nbsp;&lt;3</p><!-- no --><a href='/a?b=1&amp;c'>l</a></body>"
    assert R.plain_text(page).split("\n") == ["T & t", "One", "two <3", "l"]
    assert R.fields(page) == ("T & t", "en", ["/a?b=1&c"])


@pytest.mark.parametrize("piece", ["<title>", "<html ", "<a href='", "<!--", "<script>", "< ", "<p"])
def test_pages_of_open_tags_take_linear_time(piece):
    began = time.perf_counter()
    R.parse(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 2
