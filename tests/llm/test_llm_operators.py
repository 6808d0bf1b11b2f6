"""The operators on Spark: nulls, empty and repeated rows, ties, clashing columns, empty tables."""

import base64
import hashlib
import itertools

import numpy as np
import pytest

from cellscape.llm import jaccard_join as J
from cellscape.llm.decontamination import decontaminate
from cellscape.llm.jaccard_join import similar_groups
from cellscape.llm.language_id import identify, train
from cellscape.llm.line_dedup import line_dedup
from cellscape.llm.mixing import mix, sainte_lague, source_blocks, source_targets
from cellscape.llm.nearest import nearest
from cellscape.llm.token_counts import token_counts
from cellscape.llm.warc import derivatives, responses, serialised

SCHEMA = "doc_id long, text string, source string, n int, size string, line string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], SCHEMA)


def brute_components(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, best = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    return {i: (len(sets[i]), best[i]) for i in sets}


def test_jaccard_components(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 60))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, " ".join(base)), (5, " ".join(base).upper())]
    for i in range(6, 60):  # a chain of near copies, which long runs hold
        w = list(base)
        for _ in range(int(rng.integers(1, 6))):
            w[int(rng.integers(0, 60))] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rng.choice(words, 40))) for i in range(20)]
    got = similar_groups(docs(spark, [(i, t, None) for i, t in rows]))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_jaccard_of_shared_passages_and_repeated_rows(spark, monkeypatch):
    """Documents that share a long passage without being similar, near copies among them, in tiles of four groups."""
    monkeypatch.setattr(J, "TILE", 4)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(900)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):  # 36 of 60 shingles or fewer are shared: similar to none, unless copied below
        own = list(rng.choice(words, int(rng.integers(14, 40))))
        rows.append((i, " ".join([*own[:7], *passage, *own[7:]])))
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 60, 7)] + [(200 + i, rows[i][1].upper()) for i in range(0, 60, 9)]
    rows += [(300, " ".join(passage)), (301, " ".join(passage[:36])), (None, None)]
    got = similar_groups(docs(spark, [(i, t, None) for i, t in rows * 3]))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert {i: next(iter(v)) for i, v in found.items()} == brute_components(rows) and all(len(v) == 1 for v in found.values())
    assert got.count() == 3 * len(rows) and similar_groups(docs(spark, [])).count() == 0


def test_line_dedup(spark):
    p = " ".join(f"p{i}" for i in range(12))
    q = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"start\n{p}\nmid\n{q}", "a"), (2, f"{q}\nown line\n{p}", "a"), (3, "short\nmid", "a"), (4, None, "a"), (5, "", "a"), (None, p, "a"), (6, f"{p}\n{p}", "a")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs(spark, rows), moved_words=12).collect()}
    assert got[1][1] == 0 and got[2] == ("own line\n", 2) and got[3] == ("short\nmid", 0) and got[4] == (None, 0) and got[None] == (p, 0)
    assert got[6] == (p, 1)
    assert line_dedup(docs(spark, rows)).columns == [*docs(spark, rows).columns, "n_removed", "n_removed_chars"]


def test_line_dedup_of_blocks_whose_lines_have_several_owners(spark):
    block = [" ".join(f"l{i}w{k}" for k in range(5)) for i in range(12)]
    rows = [(1, "\n".join(f"{line}\nother {i}" for i, line in enumerate(block[::2])), "a"), (2, "\n".join(["two", *block]), "a"), (3, "\n".join([*block, "three"]), "a"), (4, "\n".join(["four", block[3], "end"]), "a")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs(spark, rows)).collect()}
    assert got[3] == ("three", 12) and all(got[i] == (rows[i - 1][1], 0) for i in (1, 2, 4))


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), ["b", "a", None][i % 3]) for i in range(60)] + [(60, None, "a"), (60, None, "a"), (None, "w w w", "b"), (None, "w w w", "b"), (None, "w w v", "b")]
    one, two = (sorted(((r.doc_id or -1, r.size, r.taken, r.source or "") for r in mix(docs(spark, rows).repartition(n), block_words=2, shard_docs=7).collect())) for n in (1, 5))
    assert one == two and len(one) == len(rows) and all(0 <= t <= 3 * s for _, s, t, _ in one)
    by = {}
    for r in mix(docs(spark, rows), block_words=2, shard_docs=7).collect():
        taken, target = by.get(r.source, (0, 0))
        by[r.source] = (taken + r.taken, r.target)
    assert all(abs(a - b) <= 8 for a, b in by.values())
    assert mix(docs(spark, [])).count() == 0 and {r.taken for r in mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_targets_and_blocks_of_sources(spark):
    rows = [(k + 1, int(n), float(k % 3 + 1)) for k, n in enumerate([100, 10, 1000, 0, 10, 10, 5_000])]
    got = {r.place: r for r in source_blocks(source_targets(spark.createDataFrame(rows, "place long, source_size long, weight double")), 8, 3).collect()}
    targets, open_ = {}, {p: (n, w) for p, n, w in rows}
    while open_:
        rest, weight = 6130 - sum(targets.values()), sum(w for _, w in open_.values())
        over = {p: 3.0 * n for p, (n, w) in open_.items() if rest * w / weight > 3 * n}
        targets |= over or {p: rest * w / weight for p, (_, w) in open_.items()}
        open_ = {p: v for p, v in open_.items() if over and p not in over}
    assert {p: pytest.approx(r.target) for p, r in got.items()} == targets
    votes, most = np.array([targets[p] for p in sorted(targets)]), np.array([-(-3 * n // 8) for _, n, _ in rows])
    assert [got[p].blocks for p in sorted(got)] == sainte_lague(votes, round(votes.sum() / 8), most).tolist()


def test_nearest_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200} and sorted(got[0])[0][1:] == (304, 0.0)
    hits = 0
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:9]) & {v for _, v, _ in got[q]})
    assert hits >= 0.9 * 27
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0
    assert nearest(df.where("vec_id < 0"), df.where("vec_id = 0")).count() == 0


def test_nearest_of_repeated_rows_ties_and_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(0, x[0].tolist(), "q")] * 3 + [(1000 + i, x[5].tolist(), "q") for i in range(400)] + [(7, x[7].tolist(), "q")] * 40
    rows += [(3000 + i, rng.normal(size=3).tolist(), "q") for i in range(15)] + [(5000, x[5].tolist(), "q")] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    queries = df.where("vec_id IN (0, 5, 7, 3000, 5000) OR vec_id IN (1000, 1001)")
    got = {}
    for r in nearest(df, queries, table_success=0.999).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 5, 7, 3000, 5000, 1000, 1001}
    for q, vector in {(r.vec_id, tuple(r.embedding)) for r in queries.collect()}:
        near = sorted((float(np.sqrt(((np.array(v, dtype=np.float32).astype(float) - np.array(vector)) ** 2).sum())), i) for i, v, _ in rows if i != q and len(v) == len(vector))[:10]
        assert [(i, pytest.approx(d, abs=1e-12)) for d, i in near] == [(v, s) for _, v, s in sorted(got[q])], q


def test_nearest_at_several_densities(spark):
    rng = np.random.default_rng(5)
    one = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    copies, centres = one(1) + 1e-3 * rng.normal(size=(500, 64)), one(20)
    x = np.concatenate((copies, centres[np.arange(500) % 20] + 0.02 * rng.normal(size=(500, 64)), one(500)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for third in range(3):
        hits = 0
        for q in range(500 * third, 500 * third + 500, 25):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            assert len(got[q]) == 10
            hits += len(set(np.argsort(d)[:10]) & set(got[q]))
        assert hits >= 0.95 * 200


def test_language_and_tokens(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5 + [(None, None), ("123", "en")])]
    labelled = docs(spark, rows).withColumnRenamed("source", "lang")
    got = {r.doc_id: r.lang_pred for r in identify(labelled, train(labelled)).collect()}
    assert got[0] == "en" and got[1] == "de" and got[10] == "und" and got[11] == "und"
    odd = spark.createDataFrame([(None, "the cat", "x", 1.0), (1, "the cat " * 200_000, "x", 1.0), (1, "the cat", "x", 1.0)], "doc_id long, text string, lang_pred string, score double")
    assert {(r.doc_id, r.lang_pred) for r in identify(odd, train(labelled)).collect()} == {(None, "en"), (1, "en")} and identify(odd, train(labelled)).count() == 3
    public = pytest.importorskip("public_tokenizers")
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs(spark, rows), public.path("piece_bpe_32k.model")).collect()}
    assert counted[10] == (0, 0) and counted[0][0] == 19


def test_decontamination(spark):
    item = " ".join(f"term{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, "..."), (4, "one")], "item_id long, text string")
    rows = [(1, "noise " * 100 + item.upper() + " noise", "a"), (2, "noise " * 300, "a"), (3, None, "a"), (4, " ".join(item.split()[:10]), "a")]
    assert [(r.doc_id, r.item_id) for r in decontaminate(docs(spark, rows), items).collect()] == [(1, 1)]
    assert decontaminate(docs(spark, rows), items.where("item_id < 0")).count() == 0
    assert decontaminate(docs(spark, []), items).count() == 0


def test_decontamination_in_parts_and_beside_long_items(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([f"v{k}" for k in range(500)], int(rng.integers(8, 200)))) for _ in range(24)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    halves = texts[0].split()
    apart = " ".join([*halves[: len(halves) // 2], *["pad"] * 700, *halves[len(halves) // 2 :]])
    rows = [(i, "lead " * 40 + t + " tail", "a") for i, t in enumerate(texts)] + [(100, apart, "a"), (101, None, "a"), (0, "lead " * 40 + texts[0] + " tail", "a")]
    found = lambda got: sorted((r.doc_id, r.item_id, r.word_at, round(r.score, 9)) for r in got.collect())
    whole = found(decontaminate(docs(spark, rows), items))
    assert {(d, i) for d, i, _, _ in whole} == {(i, i) for i in range(24)}
    assert found(decontaminate(docs(spark, rows), items, index_words=500)) == whole
    longer = items.union(spark.createDataFrame([(99, " ".join(f"z{k}" for k in range(1000)))], items.schema))
    assert [f[:3] for f in found(decontaminate(docs(spark, rows), longer))] == [f[:3] for f in whole]


def test_decontamination_with_answers(spark):
    question, answer = " ".join(f"q{i}" for i in range(20)), "forty two apples"
    items = spark.createDataFrame([(1, question, answer)], "item_id long, text string, answer string")
    rows = [(1, f"x {question} and {answer}", "a"), (2, f"x {question} y", "a")]
    assert [r.doc_id for r in decontaminate(docs(spark, rows), items).collect()] == [1]


def test_warc_links(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; y</p>"), (2, None, None)], "page_id long, url string, html string")
    sources = responses(pages)
    made = derivatives(sources)
    ids = {r.page_id: r.record_id for r in sources.collect()}
    rows = made.collect()
    assert len(rows) == 4 and all(r.refers_to == ids[r.page_id] for r in rows)
    assert bytes(next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion")) == b"x & y"
    head = bytes(serialised(made).where("page_id = 1 AND record_type = 'conversion'").first().warc)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: conversion\r\n") and head.endswith(b"\r\n\r\nx & y\r\n\r\n")
    assert b"WARC-Payload-Digest: sha1:" in head and b"WARC-Refers-To: <urn:uuid:" in head and b"WARC-Source-Header: HTTP/1.1 200 OK" in head
    for kind, warc in ((r.record_type, bytes(r.warc)) for r in serialised(made.unionByName(responses(pages))).collect()):
        named, _, rest = warc.partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in named.decode().split("\r\n")[1:])
        block = rest[: int(lines["Content-Length"])]
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
        digests = ["sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (block, payload)]
        assert rest[len(block) :] == b"\r\n\r\n" and [lines["WARC-Block-Digest"], lines["WARC-Payload-Digest"]] == digests
        assert (kind == "response") == ("WARC-Source-Payload-Digest" not in lines)


def test_warc_of_repeated_and_empty_pages(spark):
    schema = "page_id long, url string, html string, block int, date int"
    page = "<p>same</p>"
    rows = [(1, "http://a/", page, 0, 0)] * 3 + [(None, None, page, 0, 0)] * 2 + [(2, "http://b/", "<p>" + "long " * 300_000, 0, 0)]
    sources = responses(spark.createDataFrame(rows, schema)).cache()
    assert sources.count() == 6 and sources.select("record_id").distinct().count() == 6
    made = derivatives(sources)
    assert made.count() == 12 and made.select("record_id").distinct().count() == 12
    assert made.join(sources.select("record_id"), made.refers_to == sources.record_id).count() == 12
    assert responses(spark.createDataFrame([], schema)).count() == 0 and derivatives(sources.where("page_id < 0")).count() == 0
