"""The numbered operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on the folds whose crc32 remainder isn't 1."""
    from cellscape.llm.language_id import fold, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~fold(F.col("doc_id"), 3).isin(-1, 1)))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fitted on labelled documents of the folds whose crc32 remainder isn't 0."""
    from cellscape.llm.language_id import fold
    from cellscape.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) > 0))
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_toxic")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    from cellscape.llm.jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100."""
    from cellscape.llm.nearest import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    from cellscape.llm.license_scan import scan, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of every document."""
    from cellscape.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once blocks of lines that an earlier one holds are cut."""
    from cellscape.llm.line_dedup import line_dedup

    left = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_removed", "n_removed_chars", F.length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of every page's response."""
    from cellscape.llm.warc import derivatives, responses

    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", "block_digest", "source_payload_digest", "content_length")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k piece model."""
    import public_tokenizers
    from cellscape.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, with the item and its best passage."""
    from cellscape.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of 2 to 4 words of every language."""
    from cellscape.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of 4,096 ids."""
    import public_tokenizers
    from cellscape.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, faults and cheapest repair of every conversation after its damage."""
    from cellscape.llm.conversation_repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_jaccard_join, op4_nearest, op5_license_scan, op6_mixing, op7_line_dedup, op8_warc_derivatives, op9_token_counts, op10_decontamination, op11_phrases, op12_packing, op13_conversation_repair)}

# Links by a self-join on shingles, components by spreading the smallest id along them.
_OP3 = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
    SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)
), comp(doc_id, root) USING KEY (doc_id) AS (
    SELECT doc_id, doc_id FROM n
    UNION SELECT b, min(root) FROM (SELECT l.b, c.root FROM comp c JOIN l ON l.a = c.doc_id JOIN recurring.comp k ON k.doc_id = l.b WHERE c.root < k.root) GROUP BY b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""

# All phrases of 1 to 4 words counted, every candidate scored at each cut, then dropped by what holds it.
_OP11 = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), f AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS m, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k) GROUP BY ALL
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
    SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS g FROM f WHERE m >= 2 AND f >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f)::HUGEINT)::BIGINT AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[k + 1:c.m], ' ')
), s AS (
    SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY ALL
), parts AS (
    SELECT lang, array_to_string(g[i:j], ' ') AS phrase, max(a) AS a FROM (SELECT lang, g, m, a, i, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM c)) WHERE j - i + 1 < m GROUP BY ALL
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank
    FROM s LEFT JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase WHERE p.a IS NULL OR 100 * p.a < 80 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": _OP3, "op11_phrases": _OP11}
