"""Phrase mining against its SQL and against plain counting, with floors that settle at once and ones that fall."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cellscape.llm import phrases as P
from cellscape.llm import queries as Q

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, top):
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        known = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in known.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        scored = []
        for p, a in known.items():
            s, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            if 100 * covered[p] < 80 * a:
                scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        n = sum(a for p, a in own.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, le, ri, n, -s) for i, (s, a, p, le, ri) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(25)] + ["Ä", "éa", "<|x|>"]
    rows = [(str(rng.choice(["en", "de"])), " ".join(str(w) + str(rng.choice(["", "", "", ".", ",\n", "\x0b", " "])) for w in rng.choice(vocabulary, 40, p=np.r_[[0.3, 0.2], np.full(26, 0.5 / 26)]))) for _ in range(250)]
    fixed = [("en", "The Quick brown fox"), ("en", "quick\tbrown  fox jumps"), (None, "und words here. Und words"), ("de", None), ("de", ""), (None, "a " * 3_000), ("en", "tail tail " * 20)]
    return rows + fixed * 6


@pytest.mark.parametrize(("least", "top", "first"), [(3, 10_000, 2), (3, 20, 1), (5, 7, 1), (2, 60, 1)])
def test_against_plain_counts(spark, made, least, top, first):
    docs = spark.createDataFrame([(i, t, lang, 7, 1) for i, (lang, t) in enumerate(made)], "doc_id long, text string, lang string, f int, phrase int").repartition(3)
    assert got(P.phrases(docs, least, top, first)) == plain(made, least, top)


def test_floors_fall_until_settled(spark, made, monkeypatch):
    """Everything the first floor leaves is dropped by longer phrases: the floor has to go down."""
    rows = [("en", f"p{i} q{i} r{i} s{i}") for i in range(30) for _ in range(4)] + [("en", f"x{i % 7} y{i % 5}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(P, "FALL", 2)
    assert got(P.phrases(docs, 3, 40, 1)) == plain(rows, 3, 40)


def test_small_maps_cost_rows_only(spark, made, monkeypatch):
    monkeypatch.setattr(P, "MAP_BITS", 7)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(made)], "doc_id long, text string, lang string")
    assert got(P.phrases(docs, 3, 50, 1)) == plain(made, 3, 50)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.range(1).select(*[P.score(*[P.F.lit(x).cast("long") for x in v]).alias(f"s{i}") for i, v in enumerate([(big, 4 * 10**18, 5 * 10**18), (7 * 10**17 - 1, 7 * 10**17, 7 * 10**17), (30, 31, 32)])]).first()
    assert list(row) == [2_000_000, 2_000_000 * (7 * 10**17 - 1) // (14 * 10**17), 60_000_000 // 63]


def test_op11_against_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({Q.ORACLE_SQL['op11_phrases']})").fetchall()
    assert got(Q.op11_phrases(spark, sf)) == sorted(want) and len(want) > 200


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.phrases(empty).count() == 0
    assert P.phrases(spark.createDataFrame([(1, None, None), (2, " .,", "en"), (3, "a b", "en")], empty.schema)).count() == 0
