"""Facilities: rule-based classes, identifiers, nearest of each kind and the way to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscape.components import staged
from cellscape.operators import roads, spatial
from cellscape.operators.ranking import row_numbers

# The rules in order: what a tag holds or is, what a name holds, type, category, evidenced, receiver, triggers by tag and name.
# A tag test is (tag, "has" | "is", values). evidenced None: whether the emergency tag says so.
RULES: list[tuple[list[tuple[str, str, list[str]]], list[str], str, str, bool | None, bool, str, str]] = [
    ([("amenity", "has", ["hospital"]), ("healthcare", "has", ["hospital"]), ("building", "is", ["hospital"])], ["hospital"], "HEALTHCARE", "HEALTHCARE_HOSPITAL", None, True, "TAG_HOSPITAL", "HEURISTIC_NAME_HOSPITAL"),
    ([], ["chc", "community health"], "HEALTHCARE", "HEALTHCARE_CHC", False, True, "", "HEURISTIC_NAME_CHC"),
    ([], ["phc", "primary health", "aphc"], "HEALTHCARE", "HEALTHCARE_PHC", False, True, "", "HEURISTIC_NAME_PHC"),
    ([], ["subcentre", "sub-centre", "sub centre"], "HEALTHCARE", "HEALTHCARE_SUBCENTRE", False, False, "", "HEURISTIC_NAME_SUBCENTRE"),
    ([("amenity", "has", ["clinic", "doctors"]), ("healthcare", "has", ["clinic"]), ("healthcare", "is", ["centre", "clinic"])], ["dispensary"], "HEALTHCARE", "HEALTHCARE_CLINIC", False, False, "TAG_CLINIC_CENTRE", "HEURISTIC_NAME_DISPENSARY"),
    ([("amenity", "has", ["pharmacy", "chemist"])], ["medical store"], "HEALTHCARE", "HEALTHCARE_PHARMACY", False, False, "TAG_OR_NAME_PHARMACY", "TAG_OR_NAME_PHARMACY"),
    ([("amenity", "is", ["school"]), ("building", "is", ["school"])], ["school", "vidyalaya", "inter college"], "EDUCATION", "EDUCATION_SCHOOL", False, False, "TAG_SCHOOL", "HEURISTIC_NAME_SCHOOL"),
    ([("amenity", "is", ["college"]), ("building", "is", ["college"])], ["college", "polytechnic", "iti"], "EDUCATION", "EDUCATION_HIGHER", False, False, "TAG_COLLEGE", "HEURISTIC_NAME_COLLEGE"),
    ([("amenity", "is", ["university"]), ("building", "is", ["university"])], ["university", "hnbgu"], "EDUCATION", "EDUCATION_UNIVERSITY", False, False, "TAG_UNIVERSITY", "HEURISTIC_NAME_UNIVERSITY"),
    ([("amenity", "is", ["kindergarten"]), ("building", "is", ["kindergarten"])], ["anganwadi"], "EDUCATION", "EDUCATION_KINDERGARTEN", False, False, "TAG_OR_NAME_KINDERGARTEN", "TAG_OR_NAME_KINDERGARTEN"),
    ([("amenity", "is", ["police"])], ["police", "thana", "chowki"], "EMERGENCY", "EMERGENCY_POLICE", True, False, "TAG_OR_NAME_POLICE", "TAG_OR_NAME_POLICE"),
    ([("amenity", "is", ["fire_station"])], ["fire"], "EMERGENCY", "EMERGENCY_FIRE_STATION", True, False, "TAG_OR_NAME_FIRE_STATION", "TAG_OR_NAME_FIRE_STATION"),
    ([("amenity", "is", ["townhall", "community_centre"])], ["panchayat", "milan kendra"], "CIVIC_ADMINISTRATIVE", "CIVIC_COMMUNITY_CENTRE", False, False, "TAG_OR_NAME_COMMUNITY_CENTRE", "TAG_OR_NAME_COMMUNITY_CENTRE"),
    ([("amenity", "is", ["post_office"])], ["post office", "dak ghar"], "CIVIC_ADMINISTRATIVE", "CIVIC_POST_OFFICE", False, False, "TAG_OR_NAME_POST_OFFICE", "TAG_OR_NAME_POST_OFFICE"),
    ([("amenity", "is", ["courthouse"])], ["court"], "CIVIC_ADMINISTRATIVE", "CIVIC_COURTHOUSE", False, False, "TAG_OR_NAME_COURTHOUSE", "TAG_OR_NAME_COURTHOUSE"),
    ([("office", "is", ["government", "administrative"])], ["office", "bhavan"], "CIVIC_ADMINISTRATIVE", "CIVIC_GOVERNMENT_OFFICE", False, False, "TAG_OR_NAME_GOVERNMENT_OFFICE", "TAG_OR_NAME_GOVERNMENT_OFFICE"),
]
OTHER = ("CIVIC_ADMINISTRATIVE", "OTHER_CIVIC_FACILITY", "OTHER_GENERIC_POI")
# The simple rules, category by tag tests and name parts.
SIMPLE_RULES: list[tuple[list[tuple[str, str, list[str]]], list[str], str]] = [
    ([("amenity", "has", ["hospital"]), ("healthcare", "has", ["hospital"])], ["hospital"], "HEALTHCARE_HOSPITAL"),
    ([], ["chc", "community health"], "HEALTHCARE_CHC"),
    ([], ["phc", "primary health", "aphc"], "HEALTHCARE_PHC"),
    ([], ["subcentre", "sub-centre", "sub centre"], "HEALTHCARE_SUBCENTRE"),
    ([("amenity", "has", ["clinic", "doctors"]), ("healthcare", "has", ["clinic"]), ("healthcare", "is", ["centre"])], ["dispensary"], "HEALTHCARE_CLINIC_OR_CENTRE"),
    ([("amenity", "has", ["pharmacy"])], [], "HEALTHCARE_PHARMACY"),
    ([("amenity", "is", ["school"])], ["school", "vidyalaya", "inter college"], "EDUCATION_SCHOOL"),
    ([("amenity", "is", ["college"])], ["college", "polytechnic", "iti"], "EDUCATION_HIGHER"),
    ([("amenity", "is", ["university"])], ["university"], "EDUCATION_UNIVERSITY"),
    ([("amenity", "is", ["kindergarten"])], ["anganwadi"], "EDUCATION_KINDERGARTEN"),
    ([("amenity", "is", ["police"])], ["police", "thana", "chowki"], "EMERGENCY_POLICE"),
    ([("amenity", "is", ["fire_station"])], ["fire"], "EMERGENCY_FIRE_STATION"),
    ([("amenity", "is", ["townhall", "community_centre"])], ["panchayat", "milan kendra"], "CIVIC_COMMUNITY_CENTRE"),
]
# The sets that distances are measured to, by type or category.
SETS = {
    "health": ("facility_broad_type", ["HEALTHCARE"]), "hospital": ("facility_category", ["HEALTHCARE_HOSPITAL", "HEALTHCARE_CHC"]), "phc": ("facility_category", ["HEALTHCARE_PHC"]),
    "school": ("facility_broad_type", ["EDUCATION"]), "emergency": ("facility_broad_type", ["EMERGENCY"]),
}
ROUTED = ["health", "hospital", "school"]
HEALTH_M, SCHOOL_M, HOSPITAL_MIN = 5000.0, 3000.0, 60.0


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _tests(text: dict[str, Column], tests: list[tuple[str, str, list[str]]]) -> Column:
    return _any([text[tag].contains(v) if how == "has" else text[tag] == v for tag, how, values in tests for v in values])


def _lowered(tags: Column | None, names: list[str]) -> dict[str, Column]:
    return {n: F.lower(F.coalesce(tags[n] if tags is not None else F.col(n), F.lit(""))) for n in names}


def classify_facility(tags: Column | None = None) -> Column:
    """Struct of type, category, evidenced emergency capability, potential receiver and trigger, by the first rule that holds.

    tags is a map of tags; without it the tags are columns. Parts of names count inside longer words.
    """
    text = _lowered(tags, ["amenity", "healthcare", "office", "building", "name", "emergency"])
    pick = lambda kind, category, evidenced, receiver, trigger: F.struct(F.lit(kind).alias("facility_broad_type"), F.lit(category).alias("facility_category"), evidenced.alias("explicitly_evidenced_emergency_capability"), F.lit(receiver).alias("potential_emergency_receiving_facility"), trigger.alias("classification_trigger"))
    out = None
    for tests, parts, kind, category, evidenced, receiver, by_tag, by_name in RULES:
        tagged, named = _tests(text, tests), _any([text["name"].contains(p) for p in parts])
        says = text["emergency"].isin("yes", "designated") if evidenced is None else F.lit(evidenced)
        value = pick(kind, category, says, receiver, F.when(tagged, by_tag).otherwise(by_name))
        out = F.when(tagged | named, value) if out is None else out.when(tagged | named, value)
    return out.otherwise(pick(OTHER[0], OTHER[1], F.lit(False), False, F.lit(OTHER[2])))


def simple_category(tags: Column | None = None) -> Column:
    """P25: the simpler rules' category."""
    text = _lowered(tags, ["amenity", "healthcare", "name"])
    out = None
    for tests, parts, category in SIMPLE_RULES:
        hit = _tests(text, tests) | _any([text["name"].contains(p) for p in parts])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(OTHER[1])


def facility_ids(facilities: DataFrame, key: str, prefix: str = "FAC-") -> DataFrame:
    """facility_id by type, category and name (ties by key)."""
    ranked = row_numbers(facilities, [F.col("facility_broad_type"), F.col("facility_category"), F.col("name"), F.col(key)], "_n")
    return ranked.withColumn("facility_id", F.format_string(f"{prefix}%03d", "_n")).drop("_n")


def in_sets(facilities: DataFrame, sets: list[str]) -> DataFrame:
    """Facilities once for each set that they belong to, with the set's name."""
    member = F.array_compact(F.array(*[F.when(F.col(SETS[s][0]).isin(SETS[s][1]), F.lit(s)) for s in sets]))
    return facilities.withColumn("set", F.explode(member))


def nearest_facilities(points: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """For each point and set of SETS the nearest facility: {set}_m, {set}_id, {set}_name, {set}_category. One join for all sets."""
    asked = points.select(key, "x", "y", F.explode(F.array(*[F.lit(s) for s in SETS])).alias("set"))
    near = spatial.nearest(asked, in_sets(facilities, list(SETS)), key, "facility_id", ["name", "facility_category"], by="set")
    by = F.map_from_entries(F.collect_list(F.struct("set", F.struct("distance_m", "facility_id", "name", "facility_category"))))
    wide = near.groupBy(key).agg(by.alias("m"))
    names = {"m": "distance_m", "id": "facility_id", "name": "name", "category": "facility_category"}
    return wide.select(key, *[F.col("m")[s][c].alias(f"{s}_{n}") for s in SETS for n, c in names.items()])


def facility_access(points: DataFrame, facilities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nearest facilities, network distance and minutes to health, hospital and school, and access flags.

    edges is the whole network (u, v, length_m, minutes). Facilities start at their nearest node; a point goes from its own, walking
    the snap. There is a way if the snap is at most 3 km and the set is reached.
    """
    starts = roads.snap(in_sets(facilities, ROUTED).select(F.concat_ws("/", "set", "facility_id").alias("start"), "x", "y"), edges, "start")
    sources = starts.select(F.substring_index("start", "/", 1).alias("set"), "node").where("node IS NOT NULL").distinct()
    paths = roads.shortest_paths(edges, sources, ["length_m", "minutes"])
    pick = lambda s, w: F.max(F.when((F.col("set") == s) & (F.col("weight") == w), F.col("dist")))
    by_node = paths.groupBy("node").agg(*[pick(s, w).alias(f"{s}_{w}") for s in ROUTED for w in ("length_m", "minutes")])
    met = roads.snap(points, edges, key).join(by_node, "node", "left")
    near = F.col("snap_m") <= roads.MAX_SNAP_M
    walk = F.col("snap_m") / 1000 / roads.WALKING_KMH * 60
    out = met.select(key, *[c for s in ROUTED for c in (
        F.bround(F.when(near, F.col(f"{s}_length_m") + F.col("snap_m")), 1).alias(f"network_{s}_m"), F.bround(F.when(near, F.col(f"{s}_minutes") + walk), 1).alias(f"network_{s}_min"),
        F.coalesce(near & F.col(f"{s}_minutes").isNotNull(), F.lit(False)).alias(f"{s}_route_exists"),
    )])
    return access_flags(nearest_facilities(points, facilities, key).join(out, key))


def access_flags(points: DataFrame) -> DataFrame:
    """Within 5 km of health, 3 km of school, 60 minutes of a hospital; null is false."""
    limits = {"has_health_within_5km": ("health_m", HEALTH_M), "has_school_within_3km": ("school_m", SCHOOL_M), "hospital_under_60min": ("network_hospital_min", HOSPITAL_MIN)}
    return points.withColumns({k: F.coalesce(F.col(c) <= most, F.lit(False)) for k, (c, most) in limits.items()})


def access_summary(access: DataFrame) -> DataFrame:
    """One row of mean distances and flag counts."""
    means = {f"mean_{s}_m": F.bround(F.avg(f"{s}_m"), 1) for s in ("health", "hospital", "school")}
    flags = {c: F.count_if(c) for c in ("has_health_within_5km", "has_school_within_3km", "hospital_under_60min")}
    return access.agg(F.count("*").alias("total"), *[v.alias(k) for k, v in (means | flags).items()])


def facility_counts(facilities: DataFrame) -> DataFrame:
    """(grouping, value, n) by type, by category and by emergency capability."""
    pairs = [F.struct(F.lit(g).alias("grouping"), F.col(c).alias("value")) for g, c in (("type", "facility_broad_type"), ("category", "facility_category"))]
    evidenced, receiver = F.col("explicitly_evidenced_emergency_capability"), F.col("potential_emergency_receiving_facility")
    capable = [F.when(evidenced, "evidenced"), F.when(receiver, "potential_receiver")]
    pairs += [F.when(c.isNotNull(), F.struct(F.lit("emergency").alias("grouping"), c.alias("value"))) for c in capable]
    return facilities.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).groupBy("p.grouping", "p.value").agg(F.count("*").alias("n"))


def classified(points: DataFrame, key: str, tags: Column | None = None) -> DataFrame:
    """Facilities with their classes (staged, as many operators read them)."""
    return staged(points.withColumn("_c", classify_facility(tags)).select(*points.columns, "_c.*"), "facilities")
