"""Relational operators on feature and cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.components import staged
from cellscape.functions import scores as S
from cellscape.operators.ranking import row_numbers

# Land cover legend, excluded codes, capacity parameters and statuses.
LAND_COVER = [(10, "Tree cover"), (20, "Shrubland"), (30, "Grassland"), (40, "Cropland"), (50, "Built-up"), (60, "Bare / sparse vegetation"), (70, "Snow and ice"), (80, "Permanent water bodies"), (90, "Herbaceous wetland"), (95, "Mangroves"), (100, "Moss and lichen")]
EXCLUDED_COVER = [10, 50, 70, 80, 90]
EFFICIENCY, M2_PER_HOUSEHOLD, PERSONS, MAX_M2, MIN_USABLE_M2, MIN_HOUSEHOLDS = 0.4, 25.0, 4, 1_000_000.0, 2_500.0, 10
CAPACITY_STATUS = {"none": "NOT_ESTIMATED_REQUIRES_PLANNING_STANDARD", "large": "AREA_EXCEEDS_SITE_PLANNING_SCALE", "estimate": "PRELIMINARY_DWELLING_UNIT_SCENARIO"}
JOINED, NOT_JOINED = "JOINED", "NOT_FOUND_IN_PCA"


def weighted_overlay(cells: DataFrame, layers: dict[str, tuple[str, float]]) -> DataFrame:
    """P10: layer -> (contribution column, weight); score is the clamped sum, null if a layer is. Weights must sum to 1 (1e-5)."""
    if abs(sum(w for _, w in layers.values()) - 1) > 1e-5:
        raise ValueError("weights must sum to 1")
    parts = {name: F.lit(w) * F.col(layer) for layer, (name, w) in layers.items()}
    total: Column = sum(parts.values(), F.lit(0.0))
    known = total.isNotNull()
    return cells.withColumns({n: F.when(known, c) for n, c in parts.items()} | {"score": F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))})


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Rows by value (nulls too) and their share of the total."""
    counted = df.groupBy(by).agg(F.count("*").alias("cells"))
    return counted.withColumn("pct_total", F.round(100.0 * F.col("cells") / F.sum("cells").over(W.partitionBy()), 6))


def capacity(areas: DataFrame, m2_per_household: float | None = M2_PER_HOUSEHOLD) -> DataFrame:
    """Status, usable area, households, population, density and viability of candidate areas (area_m2).

    Without a planning standard (m2_per_household None) nothing is estimated, and viability is null; over 100 ha neither, and the
    area isn't viable.
    """
    none = {"usable_area_m2": "double", "usable_area_ha": "double", "estimated_household_capacity": "long", "estimated_population_capacity": "long", "capacity_density_hh_per_ha": "double", "capacity_viable": "boolean"}
    if m2_per_household is None:
        return areas.withColumns({"capacity_status": F.lit(CAPACITY_STATUS["none"])} | {k: F.lit(None).cast(t) for k, t in none.items()})
    estimate = F.col("area_m2") <= MAX_M2
    usable = F.when(estimate, F.col("area_m2") * EFFICIENCY)
    households = (usable / m2_per_household).cast("long")
    viable = F.coalesce((usable >= MIN_USABLE_M2) & (households >= MIN_HOUSEHOLDS), F.lit(False))
    density = F.when((usable > 0) & (households > 0), F.bround(households / (usable / 10_000), 1))
    return areas.withColumns({
        "capacity_status": F.when(estimate, CAPACITY_STATUS["estimate"]).otherwise(CAPACITY_STATUS["large"]), "usable_area_m2": F.bround(usable, 1), "usable_area_ha": F.bround(usable / 10_000, 3),
        "estimated_household_capacity": households, "estimated_population_capacity": (households * PERSONS).cast("long"), "capacity_density_hh_per_ha": density, "capacity_viable": viable,
    })


def rates(census: DataFrame) -> DataFrame:
    """The five vulnerability rates of a census table."""
    return census.withColumns({k: S.safe_rate(F.col(v).cast("double"), F.col("tot_p")) for k, v in S.RATES.items()})


def vulnerability(rated: DataFrame) -> DataFrame:
    """A flag for each rate above its threshold (null is 0), their count, its text and the labels of the active ones."""
    flags = {flag: F.coalesce(F.col(rate), F.lit(0.0)) > t for rate, (t, flag, _) in S.VULNERABILITY.items()}
    count: Column = sum((c.cast("int") for c in flags.values()), F.lit(0))
    active = F.array_compact(F.array(*[F.when(flags[flag], F.lit(name)) for _, flag, name in S.VULNERABILITY.values()]))
    context = F.format_string(f"%d of {len(flags)} vulnerability factors flagged", count)
    return rated.withColumns(flags | {"vulnerability_flag_count": count, "vulnerability_context": context, "active_flags": active})


def relocation_horizon(profiles: DataFrame, tier: str = "priority_tier") -> DataFrame:
    """The horizon fields of each tier (a broadcast table of four rows); an unknown tier has those of no tier."""
    table = profiles.sparkSession.createDataFrame([(t, *v) for t, v in S.HORIZONS.items()], ", ".join(f"{c} string" for c in ("_tier", *S.HORIZON_FIELDS)))
    met = profiles.join(F.broadcast(table), F.col(tier) == F.col("_tier"), "left")
    default = {k: F.replace(F.lit(v), F.lit("{}"), F.coalesce(F.col(tier), F.lit("None"))) for k, v in zip(S.HORIZON_FIELDS, S.UNKNOWN_HORIZON, strict=True)}
    return met.withColumns({k: F.coalesce(k, default[k]) for k in S.HORIZON_FIELDS}).drop("_tier")


def ecological_mask(cover: DataFrame) -> DataFrame:
    """1 where the class is excluded or the cell protected, 0 elsewhere, null off valid terrain."""
    return cover.withColumn("excluded", F.when(F.col("valid"), (F.col("code").isin(EXCLUDED_COVER) | F.col("protected")).cast("int")))


def land_cover_summary(cover: DataFrame, hectares_a_cell: float) -> DataFrame:
    """Cells, hectares, share of valid terrain and policy of every class of the legend, zero rows kept."""
    legend = cover.sparkSession.createDataFrame(LAND_COVER, "code int, label string")
    counted = cover.groupBy("code").agg(F.count("*").alias("pixels"))
    valid = cover.agg(F.count_if("valid").alias("_valid"))
    out = F.broadcast(legend).join(counted, "code", "left").fillna(0, ["pixels"]).join(F.broadcast(valid))
    policy = F.when(F.col("code").isin(EXCLUDED_COVER), "EXCLUDED").otherwise("PERMISSIBLE")
    return out.select("code", "label", "pixels", F.bround(F.col("pixels") * hectares_a_cell, 2).alias("hectares"), F.bround(F.try_divide(F.col("pixels") * 100.0, F.col("_valid")), 2).alias("pct_of_terrain"), policy.alias("policy"))


def land_cover_name(code: Column) -> Column:
    """A code's label."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in LAND_COVER for x in (k, v)]), code)


def exclusion_mask(cells: DataFrame, predicates: dict[str, Column | None], valid: Column) -> tuple[DataFrame, DataFrame]:
    """Excluded (1, 0 or null off valid cells) and a one-row log of cells each predicate hits; None is not configured."""
    active = {k: c for k, c in predicates.items() if c is not None}
    hit: Column = F.lit(False)
    for c in active.values():
        hit = hit | F.coalesce(c, F.lit(False))
    log = cells.agg(*[(F.count_if(valid & active[k]) if k in active else F.lit(None).cast("long")).alias(k) for k in predicates], F.count_if(valid & hit).alias("all"))
    return cells.withColumn("excluded", F.when(valid, hit.cast("int"))), log


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Df, or an error naming what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Df with each name (-> type), null where it has no such column."""
    return df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in names.items() if n not in df.columns])


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Inner join that refuses a repeated key on either side, as rows are read, and (in a pass of its own) another count than expected."""
    def once(df: DataFrame) -> DataFrame:
        n = F.count("*").over(W.partitionBy(key))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {key}"))).otherwise(F.lit(True))).drop("_n")

    out = once(left).join(once(right), key)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows joined, not {expected}")
    return out


def status_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that keeps the rows and adds join_status."""
    marked = right.dropDuplicates([key]).withColumn("_hit", F.lit(True))
    return left.join(marked, key, "left").withColumn("join_status", F.when(F.col("_hit"), JOINED).otherwise(NOT_JOINED)).drop("_hit")


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first in order; the order's ties should be none."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def project(df: DataFrame, columns: dict[str, str], keep: str = "first") -> DataFrame:
    """Columns (new name -> old) in that order; of several old columns of one name the first stays (keep), or the last."""
    names = list(df.columns)
    at = {n: (names.index(n) if keep == "first" else len(names) - 1 - names[::-1].index(n)) for n in set(names)}
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"_{at[old]}").alias(new) for new, old in columns.items()])


def screening_basis(parameters: dict[str, object]) -> Column:
    """`name=value` of each parameter (None is NOT_CONFIGURED), joined by `; `."""
    return F.concat_ws("; ", *[F.lit(f"{k}={'NOT_CONFIGURED' if v is None else v}") for k, v in parameters.items()])


def layer_stats(df: DataFrame, layer: str) -> DataFrame:
    """A1: count, min, max, mean and population deviation of a layer's valid cells."""
    return df.agg(F.count(layer).alias("n"), F.min(layer).alias("lo"), F.max(layer).alias("hi"), F.round(F.avg(layer), 6).alias("mean"), F.round(F.stddev_pop(layer), 6).alias("std"))


def percentiles(df: DataFrame, layer: str, points: list[float], digits: int = 6) -> DataFrame:
    """A2: exact percentiles with linear interpolation, one row of p10, p25 ...

    Values are counted, dealt by range and summed up along it, so no task holds all values; only the values on either side
    of each point leave their ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counts = df.where(F.col(layer).isNotNull()).groupBy(F.col(layer).alias("v")).agg(F.count("*").alias("n"))
    dealt = staged(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "percentiles")
    before = dealt.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = before.agg(F.sum("n").alias("total"))
    last = F.sum("n").over(W.partitionBy("part").orderBy("v"))
    placed = dealt.withColumn("last", last).join(F.broadcast(before.select("part", "before")), "part").join(F.broadcast(total))
    placed = placed.select(F.col("v").cast("double").alias("v"), "total", (F.col("before") + F.col("last") - F.col("n")).alias("first"), (F.col("before") + F.col("last") - 1).alias("last"))
    out = []
    for i, p in enumerate(points):
        place = (F.col("total") - 1) * (p / 100)
        low, high = F.floor(place), F.ceil(place)
        here = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("v")))
        a, b, share = here(low), here(high), F.max(place - low)
        out.append(F.round(a + (b - a) * share, digits).alias(f"p{p:g}"))
    return placed.agg(*out)


def banded_totals(df: DataFrame, by: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Count and sums of each band with their shares in percent of all bands, zero rows for empty ones."""
    bands = df.sparkSession.createDataFrame([(b,) for b in order], f"{by} string")
    totals = df.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    out = F.broadcast(bands).join(totals, by, "left").fillna(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.sum(c).over(W.partitionBy())), F.lit(0.0))
    return out.withColumns({f"{c}_pct": F.bround(share(c), 2) for c in ("n", *sums)})  # one row a band


def value_counts(df: DataFrame, attributes: list[str]) -> DataFrame:
    """(attr, value, n) of several attributes in one pass, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.attr", "p.value").agg(F.count("*").alias("n"))


def incident_ids(incidents: DataFrame, prefix: str = "DIS-") -> DataFrame:
    """<prefix><year>-<counter> in order of date (missing first) and event, within the year."""
    ranked = row_numbers(incidents, [F.col("date").asc_nulls_first(), F.col("event_id")], "_n", by=["year"])
    return ranked.withColumn("incident_id", F.format_string(f"{prefix}%d-%03d", "year", "_n")).drop("_n")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of ordered rows with their ranks; only offset + limit rows leave the sort."""
    top = df.orderBy(*order).limit(offset + limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") > offset)
