"""The registered queries against plain versions of their contracts, on the smallest tables and on odd inputs."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cellscape.llm import queries as Q
from cellscape.llm.language_id import identify
from cellscape.llm.language_id import train as train_language
from cellscape.llm.line_dedup import line_dedup
from cellscape.llm.nearest import nearest
from cellscape.llm.toxicity import SAMPLE_DOCS, score_toxicity, scored, train
from cellscape.llm.warc import responses

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_labels_of_held_out_documents(spark, documents):
    got = {r.doc_id: r for r in Q.op1_language_id(spark, SF).collect()}
    assert set(got) == {d[0] for d in documents} and all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    judged = [(got[i].lang_pred, lang) for i, text, lang, _ in documents if lang and text and re.search(r"[^\W\d_]", text) and fold(i, 3) == 1]
    assert len(judged) > 20 and sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert all(got[i].lang_pred == "und" for i, text, _, _ in documents if not text or not re.search(r"[^\W\d_]", text))


def test_op2_labels_of_held_out_documents(spark, documents):
    got = {r.doc_id: r for r in Q.op2_toxicity(spark, SF).collect()}
    assert set(got) == {d[0] for d in documents} and all(r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())


@pytest.mark.parametrize("sf, least_auc", [("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_op2_finds_toxic_documents_of_every_language(spark, sf, least_auc):
    """Held-out labels: ranking, few clean documents marked, and recall by language among texts of 20 different words or more."""
    path = SF.replace("sf0.001", sf)
    labelled = duckdb.sql(f"SELECT doc_id, toxic, lang, text FROM '{path}/labels.parquet' JOIN '{path}/documents.parquet' USING (doc_id) WHERE toxic IS NOT NULL").fetchall()
    got = {r.doc_id: (r.score, r.predicted) for r in Q.op2_toxicity(spark, path).select("doc_id", "score", "predicted").collect()}
    held = [(*got[i], toxic, lang, text) for i, toxic, lang, text in labelled if fold(i, 5) == 0]
    bad, good = [np.array([h[0] for h in held if h[2] == k]) for k in (1, 0)]
    assert ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2) >= least_auc
    assert sum(h[1] for h in held if h[2] == 0) <= 0.03 * len(good) + 1
    for lang in {h[3] for h in held if h[2] == 1}:
        found = [h[1] for h in held if h[2] == 1 and h[3] == lang and len(set(h[4].lower().split())) >= 20]
        assert sum(found) >= 0.9 * len(found), lang


def test_toxicity_learns_and_bounds_its_sample(spark):
    rng = np.random.default_rng(9)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[int(rng.integers(0, 30))] = "vilething"
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t, _ in rows] + [(400, None, "x", 7), (401, "", "x", 7), (None, "vilething", "x", 7), (402, (plain[0] + " ") * 200_000 + "vilething " + plain[1], "x", 7)], "doc_id long, text string, score string, offsets int")
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows if i % 2 == 0] + [(400, 1), (999, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == int(t) for i, _, t in rows if i % 2)
    assert got[400].predicted == 0 and got[401].predicted == 0 and got[402].n_toxic >= 1
    spans = [(t, got[i].offsets) for i, t, toxic in rows if toxic]
    assert sum("vilething" in [t[a:b] for a, b in o] for t, o in spans) >= 0.9 * len(spans)
    assert scored(docs, model).where("predicted = 1").count() >= 100 and scored(docs, model).columns[:2] == ["doc_id", "text"]
    small = train(docs, labels, sample_bytes=2_000)
    assert small.weights.shape == model.weights.shape and SAMPLE_DOCS > 0
    assert score_toxicity(docs, train(docs, labels.where("toxic = 0"))).where("predicted = 1").count() == 0
    assert score_toxicity(docs.limit(0), model).count() == 0 and train(docs.limit(0), labels).weights is not None


def test_op3_against_all_pairs(spark, documents):
    sets, links = {}, {}
    for i, text, _, _ in documents:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        links[i] = i
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    for _ in range(50):
        for a, b in pairs:
            links[a] = links[b] = min(links[a], links[b])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op3_jaccard_join(spark, SF).collect()} == {i: (len(sets[i]), links[i]) for i in sets}


def test_op4_recall(spark):
    rows = [(i, np.array(e, dtype=np.float64)) for i, e in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall() if e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    ids, x = np.array([i for i, _ in rows]), np.stack([e for _, e in rows])
    got = defaultdict(list)
    for r in Q.op4_nearest(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits, total = hits + len({int(ids[k]) for k in order} & {v for v, _ in got[q]}), total + len(order)
        assert all(s == d[ids == v][0] for v, s in got[q]) and len(got[q]) == len(order)
    assert hits >= 0.9 * total


def test_op6_shares(spark, documents):
    rows = Q.op6_mixing(spark, SF).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in documents}
    assert sorted(r.doc_id for r in rows) == sorted(size) and all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in rows)
    sums = defaultdict(int)
    for i, _, _, s in documents:
        sums[s] += size[i]
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while open_:
        rest, total = sum(sums.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sums[s]}
        target |= {s: 3.0 * sums[s] for s in over} if over else {s: rest * weight[s] / total for s in open_}
        open_ = open_ - over if over else set()
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sums[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 160 for s in names)  # a block of the quota, half of one and a short one of the selection


def plain_line_dedup(rows, least=10, moved=25):
    """A patience diff of every document with each first holder of its runs of lines that reach `least` words (the n-th of a text with
    their n-th); what crosses the longest chain goes in blocks of `moved` words only."""

    def runs(text):
        lines = [(k, line.strip(" \t\n\r\x0b\x0c")) for k, line in enumerate((text or "").split("\n"))]
        lines = [(k, line, len(WORD.findall(line))) for k, line in lines if line]
        found, seen = [], defaultdict(int)
        spans = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(x[2] for x in lines[i : j + 1]) >= least:
                    spans.add((i, j))
                    break
            for j in range(i, -1, -1):
                if sum(x[2] for x in lines[j : i + 1]) >= least:
                    spans.add((j, i))
                    break
        for i, j in sorted(spans):
            key = tuple(x[1] for x in lines[i : j + 1])
            found.append(((key, seen[key]), [x[0] for x in lines[i : j + 1]]))
            seen[key] += 1
        return found

    def chain(values):
        length = []
        for i, v in enumerate(values):
            length.append(1 + max([length[j] for j in range(i) if values[j] <= v], default=0))
        out, want = [], max(length)
        for i in range(len(values) - 1, -1, -1):  # the last of each length
            if length[i] == want and (not out or values[i] <= values[out[-1]]):
                out.append(i)
                want -= 1
        return set(out)

    owner, out = {}, {}
    for i, text in sorted(rows):
        mine, pairs, gone = runs(text), defaultdict(list), set()
        words = {k: len(WORD.findall(line)) for k, line in enumerate((text or "").split("\n"))}
        place = {k: n for n, k in enumerate(k for k in words if words[k])}
        for key, ks in mine:
            if key in owner:
                pairs[owner[key][0]].append((place[ks[0]], owner[key][1], ks))
            else:
                owner[key] = (i, place[ks[0]])
        for anchors in pairs.values():  # patience diff of the pair
            anchors.sort(key=lambda a: (a[0], len(a[2]), a[1]))
            forward = chain([a[1] for a in anchors])
            gone |= {k for n in forward for k in anchors[n][2]}
            blocks = defaultdict(set)
            for n, (p, at, ks) in enumerate(anchors):
                if n not in forward:
                    blocks[at - p] |= set(ks)
            for own in blocks.values():
                own, block = sorted(own, key=place.get), []
                for k in [*own, None]:
                    if k is None or block and place[k] != place[block[-1]] + 1:
                        if sum(words[x] for x in block) >= moved:
                            gone |= set(block)
                        block = []
                    block.append(k)
        out[i] = (len(gone), "\n".join(line for k, line in enumerate((text or "").split("\n")) if k not in gone))
    return out


def test_op7_against_all_earlier_documents(spark, documents):
    rng = np.random.default_rng(12)
    lines = [" ".join(f"w{rng.integers(0, 30)}" for _ in range(int(rng.integers(1, 7)))) for _ in range(40)]
    made = [(i, "\n".join(lines[int(k)] for k in (rng.integers(0, 40, int(rng.integers(1, 25))) if i % 3 else (rng.integers(0, 40) + np.arange(12)) % 40))) for i in range(80)]
    for rows in (made, [(i, t) for i, t, _, _ in documents if t is not None]):
        want = plain_line_dedup(rows)
        got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
        assert {i: t.rstrip("\n") for i, (_, t) in got.items()} == {i: t.rstrip("\n") for i, (_, t) in want.items()}
    assert any(n for n, _ in plain_line_dedup(made).values())


def test_op7_rests_on_the_alignment(spark, monkeypatch):
    """What crosses the pair's chain stays if it is short and goes if it is long; without the alignment both would go."""
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    a, b, c, long = say("a", 12), say("b", 11), say("c", 13), [say(f"m{k}-", 9) for k in range(4)]
    rows = [(1, "\n".join([a, b, c, *long])), (2, "\n".join([*long, "new", a, c, "more", b])), (3, "\n".join([c, "x", a, b])), (4, "\n".join([*long[:3], a, b, c]))]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: t.rstrip("\n") for i, t in got.items()} == {1: rows[0][1], 2: "\n".join(["new", a, c, "more", b]), 3: f"{c}\nx", 4: ""}
    want = plain_line_dedup(rows)
    assert {i: t.rstrip("\n") for i, t in got.items()} == {i: t.rstrip("\n") for i, (_, t) in want.items()}
    everything = plain_line_dedup(rows, moved=0)
    assert {i: n for i, (n, _) in everything.items()} != {i: n for i, (n, _) in want.items()}
    low = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), moved_words=0).collect()}
    assert low == {i: n for i, (n, _) in everything.items()}


def test_op8_links_every_page(spark):
    pages = duckdb.sql(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    ids = {r.record_id for r in responses(spark.read.parquet(f"{SF}/pages.parquet")).select("record_id").collect()}
    rows = Q.op8_warc_derivatives(spark, SF).collect()
    assert len(ids) == pages and len(rows) == 2 * pages and all(r.refers_to in ids for r in rows)
    assert {r.concurrent_to for r in rows if r.record_type == "metadata"} == {r.record_id for r in rows if r.record_type == "conversion"}


def test_op9_counts_are_the_library_s(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _, _ in documents}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op9_token_counts(spark, SF).collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, line int, row int")
    assert line_dedup(docs).count() == 0 and identify(docs, train_language(docs)).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"line {i} of a very long text that goes on and on and on" for i in range(40_000))
    rows = [(1, long, 0, 0, 0), (2, long, 0, 0, 0), (3, "a\n" * 100_000, 0, 0, 0), (3, "a\n" * 100_000, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, gone int, n_removed int")
    got = {(r.doc_id, r.n_removed, r.text == "") for r in line_dedup(docs).collect()}
    assert got == {(1, 0, False), (2, 40_000, True), (3, 0, False)}
