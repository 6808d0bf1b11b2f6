"""Row numbers and paging over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.components import staged


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with row_number (from 1, a long) in a total order, within the values of `by` if given.

    Rows are dealt by ranges of the order, numbered in their range, and shifted by the rows of the ranges before; only the ranges'
    counts, one row a range (and value of `by`), meet in a task.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = staged(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    keys = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in ("_part", *by)]
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)))
    met = own.alias("_l").join(before.alias("_r"), on=keys)
    return met.select(*[F.col(f"_l.{c}").alias(c) for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))
