"""Shared pieces: tables, and Arrow functions with this package at hand in the workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cellscape.components import staged as staged
from cellscape.llm.textarrays import slices
from cellscape.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


ARROW_ROWS, ROWS_KEY = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def _ready(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches of whole texts small where the session hasn't said how large they may be.

    The setting stays for the session: Arrow plans read it when they run, not when they are made.
    """
    ship(spark)
    if ROWS_KEY not in spark.conf.getAll:
        spark.conf.set(ROWS_KEY, ARROW_ROWS)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for a function of this package."""
    _ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def annotated(docs: DataFrame, fields: list[tuple[str, str]], run) -> DataFrame:
    """docs with columns that run(slice of texts) gives, row by row; columns of these names are replaced, nothing is shuffled."""
    kept = docs.drop(*[n for n, _ in fields])
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *run(part.column(part.schema.get_field_index("text")))], names=schema.names)

    return arrow_map(kept, add, schema)


def arrow_groups(df: DataFrame, keys: list, run, schema) -> DataFrame:
    """df.groupBy(keys).applyInArrow for a function of this package."""
    _ready(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)
