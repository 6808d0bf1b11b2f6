"""Stages of the pipeline decide on rows, also where doc_ids are null or repeated."""

import numpy as np
from corpus_pipeline import decontamination, jaccard_join, run


def text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_rows_of_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, leak = (text(x) for x in ("a", "b", "c", "d", "leak"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (None, a), (None, b), (2, c), (2, c), (2, d), (None, leak), (3, leak), (3, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(1, a), (None, b), (2, c), (2, d), (3, leak), (3, text("e"))], key=key)
    clean = decontamination(spark, docs, str(tmp_path))
    assert sorted(map(tuple, clean.collect()), key=key) == sorted([r for r in rows if r[1] != leak], key=key)


def test_whole_pipeline_against_plain_rules(spark, tmp_path):
    """Toxic, contaminated and copied documents go, repeated passages are cut, all others stay, and the mix takes from what is left."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    toxic = [(i, f"{prose(30)} vilething {prose(5)}", "a") for i in range(60)]
    clean = [(100 + i, prose(40), "ab"[i % 2]) for i in range(120)]
    leak, passage = prose(30), prose(30)
    odd = [(300, f"{prose(30)}\n{leak}", "a"), (301, f"{prose(30)}\n{passage}", "a"), (302, f"{prose(30)}\n{passage}", "b"), (303, clean[0][1] + " more", "a"), (304, clean[1][1], "b"), (305, None, "a"), (306, "", None)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, s, None) for i, t, s in toxic + clean + odd], "doc_id long, text string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _, _ in toxic[::2]] + [(i, 0) for i, _, _ in clean], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = run(spark, folder).collect()
    kept = {r.doc_id: r.size for r in rows}
    assert set(kept) == {i for i, _, _ in clean} | {301, 302, 305, 306}
    assert kept[301] == 60 and kept[302] == 30 and kept[305] == 0
    assert abs(sum(r.taken for r in rows) - sum(kept.values())) <= 128 and all(r.taken <= 3 * r.size for r in rows)
