"""Views that a service reads: validated filters, searches, queues, lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.functions import scores as S
from cellscape.operators import tables as T

MOST_ROWS = 500


def known_tiers(tiers: list[str] | None) -> list[str]:
    """F8: the tiers that exist; those of the action queue if none does."""
    return [t for t in tiers or [] if t in S.TIERS] or S.ACTION_TIERS


def with_tier(df: DataFrame, tier: str) -> DataFrame:
    """F8: rows of one tier; an unknown one is refused."""
    if tier not in S.TIERS:
        raise ValueError(f"tier must be one of {S.TIERS}")
    return df.where(F.col("priority_tier") == tier)


def by_keys(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """rows whose columns equal the values."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df


def located(df: DataFrame, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """rows with both coordinates."""
    return df.dropna(subset=list(columns))


def in_box(df: DataFrame, box: tuple[float, float, float, float], columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """points in a box (min x, min y, max x, max y), its sides included."""
    return df.where(F.col(columns[0]).between(box[0], box[2]) & F.col(columns[1]).between(box[1], box[3]))


def meets_box(df: DataFrame, box: str) -> DataFrame:
    """features whose envelope (xmin, ymin, xmax, ymax) meets a box "minx,miny,maxx,maxy"; a malformed one is refused."""
    parts = box.split(",")
    try:
        a, b, c, d = map(float, parts)
    except ValueError:
        raise ValueError(f"box must be minx,miny,maxx,maxy, not {box}") from None
    return df.where((F.col("xmax") >= a) & (F.col("xmin") <= c) & (F.col("ymax") >= b) & (F.col("ymin") <= d))


def name_contains(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """F9."""
    return df.where(F.lower(column).contains(text.lower()))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """rows with the text in any of the columns, whatever its case; an empty text finds all."""
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.strip().lower()), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return df.where(out) if text.strip() else df


def toggled(df: DataFrame, shown: dict[str, bool], column: str = "priority_tier") -> DataFrame:
    """rows whose value is switched on."""
    return df.where(F.col(column).isin([k for k, v in shown.items() if v]))


def high_vulnerability(df: DataFrame) -> DataFrame:
    """F12."""
    return df.where(F.col("vulnerability_flag_count") >= 2)


def same_text(df: DataFrame, column: str, value: str) -> DataFrame:
    """F13."""
    return df.where(F.upper(column) == value.upper())


def in_years(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """years from first to last, either open."""
    return df.where((F.col("year") >= first if first is not None else F.lit(True)) & (F.col("year") <= last if last is not None else F.lit(True)))


def emergency_capable(df: DataFrame) -> DataFrame:
    """F15."""
    return df.where(F.col("explicitly_evidenced_emergency_capability") | F.col("potential_emergency_receiving_facility"))


def arterial(df: DataFrame) -> DataFrame:
    """F16."""
    return df.where("is_arterial")


def sized(df: DataFrame, least_m2: float | None = None, most_m2: float | None = None, viable_only: bool = False) -> DataFrame:
    """areas of a size, and only viable ones if asked."""
    for c in ([F.col("area_m2") >= least_m2] if least_m2 is not None else []) + ([F.col("area_m2") <= most_m2] if most_m2 is not None else []) + ([F.col("capacity_viable")] if viable_only else []):
        df = df.where(c)
    return df


def in_band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Both bounds included."""
    return df.where(F.col(column).between(low, high))


def action_queue(profiles: DataFrame, tiers: list[str] | None = None, high_vulnerability_only: bool = False, limit: int = 200) -> DataFrame:
    """L1: villages of some tiers, nearest to a zone first (ties by id), shaped with defaults."""
    rows = profiles.where(F.col("priority_tier").isin(known_tiers(tiers)))
    rows = (high_vulnerability(rows) if high_vulnerability_only else rows).orderBy(F.col("distance_m").asc_nulls_last(), "village_id").limit(limit)
    or_ = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return rows.select("village_id", or_("name", "Unknown"), "priority_tier", or_("relocation_horizon", "UNKNOWN"), "distance_m", "tot_p", "no_hh", "hazard_class", or_("vulnerability_flag_count", 0), or_("vulnerability_context", "0 of 4 vulnerability factors flagged"), "active_flags", or_("recommended_action", "Field assessment recommended."), or_("priority_reason", ""), "nearest_zone")


def queue_summary(profiles: DataFrame, tiers: list[str] | None = None) -> DataFrame:
    """Villages, people and households by tier of the queue, whatever its limit and vulnerability switch."""
    rows = profiles.where(F.col("priority_tier").isin(known_tiers(tiers)))
    return rows.groupBy("priority_tier").agg(F.count("*").alias("villages"), F.sum("tot_p").alias("population"), F.sum("no_hh").alias("households"))


def attention_list(profiles: DataFrame) -> DataFrame:
    """L2: tier 1 by distance with the reason cut to 200 characters; every village of it, in order."""
    rows = profiles.where(F.col("priority_tier") == S.TIERS[0])
    return rows.select("village_id", F.coalesce("name", F.lit("N/A")).alias("name"), "tot_p", "no_hh", "distance_m", "nearest_zone", "hazard_class", F.substring("priority_reason", 1, 200).alias("reason")).orderBy("distance_m", "village_id")


def close_villages(exposure: DataFrame, metres: float = 500.0) -> DataFrame:
    """L3: villages within some metres of a zone, by distance."""
    return exposure.where(F.col("distance_m") <= metres).orderBy("distance_m", "village_id")


def area_page(areas: DataFrame, offset: int = 0, limit: int = 100, **filters) -> tuple[DataFrame, DataFrame]:
    """L4: a page of filtered areas by size (limit at most 500), and one row of total, filtered and displayed counts."""
    chosen, limit = sized(areas, **filters), max(0, min(limit, MOST_ROWS))
    rows = T.page(chosen, [F.desc("area_m2"), F.asc("area_id")], offset, limit)
    counts = areas.agg(F.count("*").alias("total")).join(chosen.agg(F.count("*").alias("filtered")))
    return rows, counts.withColumn("displayed", F.greatest(F.lit(0), F.least(F.lit(limit), F.col("filtered") - offset)))


def paged(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A page in the order of a key."""
    return df.orderBy(key).offset(offset).limit(limit)


def top_zones(ranked: DataFrame, n: int = 10) -> DataFrame:
    """L6."""
    return ranked.orderBy("rank").limit(n)


REPORT = {
    "village_id": "Village_ID", "name": "Village_Name", "priority_tier": "Priority_Tier", "priority_tier_display": "Priority_Label", "relocation_horizon_display": "Planning_Category",
    "distance_m": "Distance_to_Hazard_Zone_m", "tot_p": "Total_Population", "no_hh": "Households", "hazard_class": "MH_Class_at_Centroid", "vulnerability_flag_count": "Vulnerability_Flags",
    "vulnerability_context": "Vulnerability_Context", "recommended_action": "Recommended_Action", "priority_reason": "Classification_Reason", "nearest_zone": "Nearest_Red_Zone_ID", "subdist": "Sub_District_ID",
}


def priority_report(profiles: DataFrame, tiers: list[str] | None = None) -> DataFrame:
    """K5: the report's columns under their names (those that the profiles have), nearest first."""
    rows = profiles.where(F.col("priority_tier").isin(known_tiers(tiers))).orderBy(F.col("distance_m").asc_nulls_last(), "village_id")
    return rows.select(*[F.col(c).alias(n) for c, n in REPORT.items() if c in profiles.columns])


def write_priority_report(profiles: DataFrame, path: str, comments: list[str], tiers: list[str] | None = None) -> None:
    """K5: CSV parts in order under path/rows, and the comment lines and header in path/head."""
    report = priority_report(profiles, tiers)
    spark = profiles.sparkSession
    head = [f"# {c}" for c in comments] + [",".join(report.columns)]
    spark.createDataFrame(list(enumerate(head)), "n int, value string").coalesce(1).orderBy("n").select("value").write.text(f"{path}/head")
    report.write.csv(f"{path}/rows")


def labelled(profiles: DataFrame) -> DataFrame:
    """The tier's display label."""
    names: Column = F.create_map(*[F.lit(x) for pair in zip(S.TIERS, S.TIER_LABELS, strict=True) for x in pair])
    return profiles.withColumn("priority_tier_display", F.coalesce(F.element_at(names, F.col("priority_tier")), F.col("priority_tier")))
