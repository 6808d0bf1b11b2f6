"""Data-quality checks: each gives one row (check, passed, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.components import staged


def _row(df: DataFrame, name: str, passed: Column, observed: Column, expected: str) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), observed.cast("string").alias("observed"), F.lit(expected).alias("expected"))


def row_count(df: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Q1."""
    n = F.count("*")
    return _row(df, "row_count", (n >= least) & (n <= most if most is not None else F.lit(True)), n, f"{least} to {most}")


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """Q2: repeated keys are counted by key, so no set of all keys is held."""
    extra = df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"))
    return extra.select(F.lit("unique_key").alias("check"), (F.col("extra") == 0).alias("passed"), F.col("extra").cast("string").alias("observed"), F.lit("0").alias("expected"))


def no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Q3: nulls or blank text."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns])
    return _row(df, "no_nulls", F.count_if(bad) == 0, F.count_if(bad), "0")


def value_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Q4: nulls are passed over."""
    bad = F.count_if(~F.col(column).between(low, high))
    return _row(df, "range", bad == 0, bad, "0")


def allowed(df: DataFrame, column: str, values: list) -> DataFrame:
    """Q5, U4."""
    bad = F.count_if(~F.col(column).isin(values))
    return _row(df, "allowed", bad == 0, bad, "0")


def pattern(df: DataFrame, column: str, regex: str) -> DataFrame:
    """Q7."""
    bad = F.count_if(~F.col(column).rlike(regex))
    return _row(df, "pattern", bad == 0, bad, "0")


def reconciles(df: DataFrame, parts: list[str], whole: str, tolerance: float = 1e-6) -> DataFrame:
    """Q8, Q11: parts sum to the whole in every row."""
    off = F.max(F.abs(reduce(lambda a, b: a + b, [F.col(p) for p in parts]) - F.col(whole)))
    return _row(df, "reconciles", F.coalesce(off, F.lit(0.0)) <= tolerance, off, f"<= {tolerance}")


def subset(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Q9."""
    bad = F.count_if(F.col(part) > F.col(whole))
    return _row(df, "subset", bad == 0, bad, "0")


def same_nulls(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q10."""
    bad = F.count_if(F.col(a).isNull() != F.col(b).isNull())
    return _row(df, "same_nulls", bad == 0, bad, "0")


def no_infinite(df: DataFrame, column: str) -> DataFrame:
    """Q15."""
    bad = F.count_if(F.abs(F.col(column)) == float("inf"))
    return _row(df, "no_infinite", bad == 0, bad, "0")


def suite(checks: list[DataFrame]) -> DataFrame:
    """All checks' rows."""
    return reduce(DataFrame.unionByName, checks)


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Q6: decided on the schema; df is not read."""
    missing = [n for n in names if n not in df.columns]
    return df.sparkSession.createDataFrame([("required_columns", not missing, ",".join(missing), "")], "check string, passed boolean, observed string, expected string")


def sums_agree(df: DataFrame, part: str, whole: DataFrame, column: str) -> DataFrame:
    """Q8: the sum of a column here is that of another table's column."""
    both = df.agg(F.sum(part).alias("a")).join(whole.agg(F.sum(column).alias("b")))
    return both.select(F.lit("sums_agree").alias("check"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("passed"), F.col("a").cast("string").alias("observed"), F.col("b").cast("string").alias("expected"))


def monotone(df: DataFrame, by: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Value never falls by over the tolerance as `by` grows. Exact over all rows: for each distinct `by` the least value is
    held against the most of all smaller ones, along ranges of `by`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ends = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("k")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    dealt = staged(ends.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()), "monotone")
    before = lambda w: F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    tops = dealt.groupBy("part").agg(F.max("hi").alias("hi")).withColumn("most", before(W.orderBy("part"))).select("part", "most")
    fall = dealt.withColumn("own", before(W.partitionBy("part").orderBy("k"))).join(F.broadcast(tops), "part")
    bad = F.count_if(F.col("lo") < F.greatest("own", "most") - tolerance)
    return _row(fall, "monotone", bad == 0, bad, "0")


def classes_ordered(df: DataFrame, code: str, score: str) -> DataFrame:
    """Q12: the scores of a class all lie below those of the next; a few rows."""
    ends = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    over = ends.withColumn("before", F.lag("hi").over(W.orderBy(code)))
    bad = F.count_if(F.col("lo") < F.col("before"))
    return _row(over, "classes_ordered", bad == 0, bad, "0")


def same_grid(layers: DataFrame) -> DataFrame:
    """Q13: of spatial.aligned's rows."""
    bad = F.count_if(~F.col("aligned"))
    return _row(layers, "same_grid", bad == 0, bad, "0")


def all_classed(df: DataFrame, score: str, code: str) -> DataFrame:
    """Q14: every valid cell has a class."""
    bad = F.count_if(F.col(score).isNotNull() & F.col(code).isNull())
    return _row(df, "all_classed", bad == 0, bad, "0")


def at_least(df: DataFrame, column: str, least: float) -> DataFrame:
    """Q16: the mapping unit is respected."""
    low = F.min(column)
    return _row(df, "at_least", low >= least, low, f">= {least:g}")


def none_of(df: DataFrame, condition: Column, name: str = "none_of") -> DataFrame:
    """Q16, Q20: no row has the condition (excluded classes are absent, fields constant)."""
    bad = F.count_if(condition)
    return _row(df, name, bad == 0, bad, "0")


def within_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Q17: all points lie in the area of interest."""
    bad = F.count_if(~(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])))
    return _row(df, "within_box", bad == 0, bad, "0")


def ranks_in_order(df: DataFrame, rank: str, score: str) -> DataFrame:
    """Ranks are 1 to n, and the score never rises with the rank."""
    n, low, high, some = F.count("*"), F.min(rank), F.max(rank), F.count_if(F.col(rank).isNull())
    ranks = df.agg((F.coalesce(low == 1, F.lit(True)) & F.coalesce(high == n, F.lit(True)) & (some == 0)).alias("a"), n.alias("n"))
    once = df.groupBy(rank).count().agg(F.coalesce(F.max("count") == 1, F.lit(True)).alias("b"))
    falls = monotone(df.withColumn(score, -F.col(score)), rank, score, 0.0).select(F.col("passed").alias("c"))
    return ranks.join(once).join(falls).select(F.lit("ranks_in_order").alias("check"), (F.col("a") & F.col("b") & F.col("c")).alias("passed"), F.col("n").cast("string").alias("observed"), F.lit("1 to n").alias("expected"))


def record_errors(df: DataFrame, key: str, required: list[str], enums: dict[str, list[str]]) -> DataFrame:
    """Q19: (key, errors) of the records that miss a required field or hold a value outside its list."""
    says = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing required field: {c}")) for c in required]
    says += [F.when(~F.col(c).isin(v), F.concat(F.lit(f"invalid {c}: "), F.col(c).cast("string"))) for c, v in enums.items()]
    return df.select(key, F.array_compact(F.array(*says)).alias("errors")).where(F.size("errors") > 0)


def duplicates_documented(merged: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Q20: every event that was merged (pairs: key and its leader) is told by its leader's row of merged, once and with its offset."""
    told = merged.select(F.col(key).alias("leader"), F.explode("duplicates").alias("d")).select("leader", F.col("d.event").alias(key), F.col("d.spatial_offset_m").isNotNull().alias("_offset"))
    gone = pairs.where(F.col("leader") != F.col(key)).select("leader", key, F.lit(True).alias("_gone"))
    both = told.groupBy("leader", key).agg(F.count("*").alias("_n"), F.bool_and("_offset").alias("_offset")).join(gone, ["leader", key], "full")
    bad = F.count_if(~F.coalesce((F.col("_n") == 1) & F.col("_offset") & F.col("_gone"), F.lit(False)))
    return _row(both, "duplicates_documented", bad == 0, bad, "0")


def demographics_known(df: DataFrame, expected_population: int) -> DataFrame:
    """Q21: the population comes from an exact code join, has no nulls and sums to the census; J7 takes it along only then."""
    coded, nulls, total = F.bool_and(F.col("join_method").contains("Exact code-based join")), F.count_if(F.col("tot_p").isNull()), F.sum("tot_p")
    return _row(df, "demographics", coded & (nulls == 0) & (total == expected_population), total, str(expected_population))


def network_connected(health: DataFrame, least_pct: float = 80.0) -> DataFrame:
    """Q22: of roads.network_health's row: the largest component has most nodes."""
    return health.select(F.lit("network_connected").alias("check"), F.coalesce(F.col("largest_pct") >= least_pct, F.lit(False)).alias("passed"), F.col("largest_pct").cast("string").alias("observed"), F.lit(f">= {least_pct:g}").alias("expected"))


def aspect_valid(cells: DataFrame, slope: str = "slope", aspect: str = "aspect") -> DataFrame:
    """Q23: aspect is the flat sentinel or in [0, 360), and flat cells have the sentinel."""
    a = F.col(aspect)
    bad = F.count_if(a.isNotNull() & ~((a == -1) | (a >= 0) & (a < 360)) | (F.coalesce(F.col(slope) == 0, F.lit(False)) & a.isNotNull() & (a != -1)))
    return _row(cells, "aspect_valid", bad == 0, bad, "0")
