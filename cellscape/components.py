"""Connected components of an edge table by repeated joins, and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscape.shipping import ship

LOCAL_EDGES = 100_000
"""Up to so many edges one task labels them in memory; beyond it the rounds of joins do. Both give the same components."""


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Where spark.checkpoint.dir is unset, a temporary one in local mode (as in tests); an
    error on a cluster, whose executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cellscape-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: work done once, kept if executors are lost.

    instead_of is a staged table that nothing reads once df is written, such as a loop's round before; its files go.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["staged_at"] = path
    old = instead_of.__dict__.get("staged_at") if instead_of is not None else None
    if old:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is made by a shuffle at any size. Spark goes by the files of a staged table, in which a key takes a few
    bytes, leaves out that explode makes copies, and would broadcast through the driver what is many times larger in memory."""
    return df.hint("merge")


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of edges a-b."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, now = np.minimum(root[u], root[v]), root.copy()
        np.minimum.at(now, root[u], low)
        np.minimum.at(now, root[v], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            return nodes, nodes[root]
        root = now


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        edges = pa.Table.from_batches(parts)
        found = labels(edges.column(0).to_numpy(), edges.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 200, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node it reaches. Isolated nodes aren't known here.

    Few edges are labelled by one task. Else by alternating star contraction: each node's larger neighbours, and the node itself,
    are joined to the smallest of its neighbourhood (large star), then its smaller neighbours to their smallest (small star). A
    round at least shortens every path, so rounds grow with the logarithm of a component's size; edges never outnumber those of
    the start. Too many rounds are an error, never a result that isn't finished.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    now, before = staged(both, "edges"), None
    if now.schema["u"].dataType.simpleString() == "bigint" and now.count() <= local_edges:
        ship(now.sparkSession)
        return now.coalesce(1).mapInArrow(_labelled, "node long, component long")
    for _ in range(max_rounds):
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = now.unionByName(turned)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(shuffled(least), "u").where(F.col("v") > F.col("u")).select(F.col("v"), F.col("m")).where(F.col("v") != F.col("m"))
        large = large.select(F.least("v", "m").alias("u"), F.greatest("v", "m").alias("v")).distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(shuffled(small_least), "v").select("v", "u", "m")
        nxt = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.m").alias("u"), F.col("e.v").alias("v")).where(F.col("u") != F.col("v")).distinct()
        now = staged(nxt, "edges", instead_of=now)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.countDistinct("v")).first()
        if after == before or after[0] == after[2] and _is_star(now):
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether no node is both a root and a leaf."""
    return not edges.select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_semi").head(1)
