"""A training-corpus pipeline of five operators; each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.llm.common import staged, table
from cellscape.llm.decontamination import marked
from cellscape.llm.jaccard_join import similar_groups
from cellscape.llm.line_dedup import line_dedup
from cellscape.llm.mixing import mix
from cellscape.llm.toxicity import scored, train

ORACLE_SQL = None


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with _id (their doc_id) and a doc_id of each row's own, staged so that it stays the same."""
    return staged(docs.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), f"pipeline-keyed-{name}")


def without(rows: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The keyed rows but those of the doc_ids gone, with the columns of docs."""
    left = rows.join(gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")
    return left.select(*[F.col("_id").alias(c) if c == "doc_id" else F.col(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict as toxic; fitted on the labelled documents of sf_dir.

    Rows are judged one by one: null and empty texts, null and repeated ids stay or go by their own text.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    own = {c: f"_{c}" for c in docs.columns if c != "text"}  # docs may have columns named like the scores
    kept = scored(docs.withColumnsRenamed(own), model).where("predicted = 0")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; a document of which nothing is left goes.

    Rows of a null id or text stay; n_chars is that of what is left.
    """
    left = line_dedup(docs)
    left = left.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*[changed.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest doc_id (null comes last). Documents without words stay."""
    rows = keyed(docs, "jaccard")
    found = similar_groups(rows).where("n_shingles > 0").select("doc_id", "component_id")
    found = staged(found.join(rows.select("doc_id", F.col("_id").cast("long").alias("_id")), "doc_id"), "pipeline-groups")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "doc_id")).alias("kept")).select(F.col("kept.doc_id").alias("_kept"))
    return without(rows, found.join(kept, F.col("doc_id") == F.col("_kept"), "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item; rows are judged one by one, as in toxicity."""
    return marked(docs, table(spark, sf_dir, "benchmark"), "_leaks").where("_leaks = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, target, taken."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
