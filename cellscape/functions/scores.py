"""Column functions: scores, classes, bands and labels. Nulls stay null (NoData) unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class table (code, label, from, to), distance bands, tiers, vulnerability thresholds and their labels, horizons.
CLASSES = [(1, "Lower", 0.0, 0.35), (2, "Moderate", 0.35, 0.65), (3, "Higher", 0.65, 1.0)]
INSIDE = "Inside Candidate Hazard-Based Red Zone"
OUTSIDE = "Outside Candidate Hazard-Based Red Zone"
BANDS = [(500.0, "Within 500 m"), (1000.0, "500 m to 1 km"), (2000.0, "1 km to 2 km"), (5000.0, "2 km to 5 km"), (10000.0, "5 km to 10 km")]
BEYOND_BANDS = "Beyond 10 km"
BAND_ORDER = [INSIDE, *[name for _, name in BANDS], BEYOND_BANDS]
TIER_M = (500.0, 2000.0, 5000.0)
TIER_CLASS = 2
TIERS = ["Tier1_AttentionPriority", "Tier2_ElevatedAttention", "Tier3_Monitoring", "BeyondProximity"]
TIER_LABELS = ["Tier 1 — Attention Priority", "Tier 2 — Elevated Attention", "Tier 3 — Monitoring", "Beyond Proximity — Lower Attention"]
ACTION_TIERS = TIERS[:2]
VULNERABILITY = {"child_proportion": (0.151, "vf_high_child_pop", "High Child Population"), "sc_proportion": (0.246, "vf_high_sc", "High SC Population"), "non_worker_rate": (0.579, "vf_high_dependency", "High Dependency Ratio"), "illiteracy_rate": (0.34, "vf_high_illiteracy", "High Illiteracy Rate")}
RATES = {"illiteracy_rate": "p_ill", "child_proportion": "p_06", "non_worker_rate": "non_work_p", "sc_proportion": "p_sc", "st_proportion": "p_st"}
HORIZON_FIELDS = ["relocation_horizon", "relocation_horizon_display", "planning_horizon_years", "recommended_action", "horizon_rationale", "horizon_limitations", "horizon_disclaimer"]
HORIZONS = {
    "Tier1_AttentionPriority": [
        "IMMEDIATE_FIELD_ASSESSMENT", "Immediate Field Assessment", "0-1",
        "Recommend immediate field verification by SDMA/district team. Priority for geotechnical survey scheduling. Community consultation required before any relocation planning action.",
        "Village is within 500m of a Candidate Hazard-Based Red Zone with Moderate or Higher multi-hazard class at centroid, OR centroid directly overlaps a Candidate Red Zone polygon.",
        "Classification is based on GIS proximity and terrain screening only. Does not incorporate verified disaster history, infrastructure survey, or geotechnical assessment. Centroid-based proximity may understate actual settlement extent into hazard terrain.",
        "DECISION SUPPORT ONLY — NOT AN OFFICIAL RELOCATION ORDER OR EVACUATION NOTICE. Requires official government review and community consent before any action.",
    ],
    "Tier2_ElevatedAttention": [
        "SHORT_TERM_PLANNING_REVIEW", "Short-Term Planning Review", "1-3",
        "Recommend inclusion in 1-3 year district hazard planning cycle. Block-level vulnerability mapping and infrastructure audit advised. Monitor for changes in hazard indicators.",
        "Village is within 2000m of a Candidate Hazard-Based Red Zone. Elevated proximity warrants inclusion in near-term planning agenda.",
        "Disaster history not integrated. Vulnerability indicators available as context only. Road accessibility and infrastructure proximity not assessed.",
        "DECISION SUPPORT ONLY — NOT AN OFFICIAL RELOCATION ORDER. Requires official government review before any planning action.",
    ],
    "Tier3_Monitoring": [
        "MEDIUM_TERM_MONITORING", "Medium-Term Monitoring", "3-10",
        "Include in district hazard monitoring programme. Update assessment when new hazard data is available. No immediate field action required based on current screening.",
        "Village is within 5000m of a Candidate Hazard-Based Red Zone. Contextual monitoring proximity — warrants awareness but not immediate action.",
        "Distance-based proximity only. Disaster history not integrated. Terrain between village and hazard zone not assessed for connectivity.",
        "DECISION SUPPORT ONLY — Monitoring category does not imply absence of risk.",
    ],
    "BeyondProximity": [
        "ROUTINE_MONITORING", "Routine Monitoring", "10+",
        "Include in periodic district hazard survey update cycle. No priority action indicated by current screening.",
        "Village centroid is more than 5000m from the nearest Candidate Hazard-Based Red Zone based on current screening data.",
        "Does not imply the village is safe. Other hazard factors not captured by this screening (e.g. geological, rainfall, local terrain) may apply. Screening extent is limited by available DEM data.",
        "DECISION SUPPORT ONLY — Beyond proximity does not certify safety.",
    ],
}
UNKNOWN_HORIZON = ["UNKNOWN", "Unknown", "N/A", "Horizon not configurable — priority tier not recognized.", "Tier '{}' not found among the horizons.", "Configuration error — check the tier.", "DECISION SUPPORT ONLY."]


def linear_score(value: Column, low: float, high: float) -> Column:
    """(value - low) / (high - low), clipped to [0, 1]."""
    if high <= low:
        raise ValueError("high must be above low")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low))))


def classify(value: Column, table: list[tuple[int, str, float, float]] = CLASSES) -> Column:
    """Class code of half-open intervals, the last one closed."""
    out = None
    for k, (code, _, low, high) in enumerate(table):
        inside = (value >= low) & ((value <= high) if k == len(table) - 1 else (value < high))
        out = F.when(inside, code) if out is None else out.when(inside, code)
    return out


def label(code: Column, table: list[tuple[int, str, float, float]] = CLASSES) -> Column:
    """A class code's label."""
    return F.element_at(F.create_map(*[F.lit(x) for c, name, _, _ in table for x in (c, name)]), code)


def _steps(value: Column, unknown: str, steps: list[tuple[Column, str | Column]], last: str | Column) -> Column:
    """The text of the first condition that holds; unknown for null."""
    out = F.when(value.isNull(), unknown)
    for condition, text in steps:
        out = out.when(condition, text)
    return out.otherwise(last)


def slope_context(deg: Column) -> Column:
    """P11."""
    return _steps(deg, "Unknown", [(deg < 15, "Gentle terrain (mean slope < 15 degrees)"), (deg < 30, "Moderate terrain (mean slope 15-30 degrees)")], "Steep terrain (mean slope >= 30 degrees)")


def score_context(score: Column, what: str) -> Column:
    """P12 (what = "terrain susceptibility indicator"), P13 ("terrain-derived flood exposure")."""
    return _steps(score, "Unknown", [(score < 0.35, f"Lower {what} (score < 0.35)"), (score < 0.65, f"Moderate {what} (score 0.35-0.65)")], f"Higher {what} (score >= 0.65)")


TERRAIN, FLOOD = "terrain susceptibility indicator", "terrain-derived flood exposure"


def one_digit(value: Column) -> Column:
    """A number of 2 or more with one digit, its exact binary value rounded half to even, as C and Python print it.

    format_string rounds the shortest decimal form half up: 3.05, which is 3.04999..., would be 3.1. From 2 on a double is a multiple of 1 / 2**51.
    """
    whole = F.floor(value)
    tenths = ((value - whole) * F.lit(float(1 << 51))).cast("long") * 10
    down, rest, half = F.shiftright(tenths, 51), tenths.bitwiseAND(F.lit((1 << 51) - 1)), F.lit(1 << 50)
    n = down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    return F.when(value < float(1 << 52), F.concat((whole + F.when(n == 10, 1).otherwise(0)).cast("string"), F.lit("."), (n % 10).cast("string"))).otherwise(F.format_string("%.1f", value))


def hazard_buffer_context(metres: Column) -> Column:
    """Distances closed above."""
    far = F.concat(F.lit("Beyond 2km from nearest Candidate Red Zone ("), one_digit(metres / 1000), F.lit("km)"))
    return _steps(metres, "Unknown", [(metres <= 500, "Within 500m of Candidate Red Zone boundary"), (metres <= 2000, "500m to 2km from nearest Candidate Red Zone")], far)


# The scale texts of an area.
SCALES = [
    (10000, "VERY_LARGE_UNFILTERED_TERRAIN_SCREEN — This polygon represents a large contiguous terrain area. Configurable filters (slope threshold, minimum mapping unit) are NOT_CONFIGURED. This is NOT a discrete relocation site recommendation."),
    (100, "Large terrain cluster (> 100 ha). Minimum mapping unit filter NOT_CONFIGURED — sub-areas may vary in suitability."),
    (10, "Moderate terrain cluster (10-100 ha)."),
]
SMALL_SCALE = "Small terrain cluster (< 10 ha)."


def area_scale(hectares: Column) -> Column:
    """P15."""
    return _steps(hectares, "Unknown", [(hectares > ha, text) for ha, text in SCALES], SMALL_SCALE)


def token_count(text: Column, token: str) -> Column:
    """How often a token occurs in a text field, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(token)), F.lit(0))


def proximity_band(overlap: Column, metres: Column) -> Column:
    """Bands closed above; overlap comes first, a null distance is beyond all bands."""
    out = F.when(overlap, INSIDE)
    for most, name in BANDS:
        out = out.when(metres <= most, name)
    return out.otherwise(BEYOND_BANDS)


def safe_rate(part: Column, whole: Column) -> Column:
    """Part / whole clipped to [0, 1]; null where whole is 0."""
    rate = part / F.when(whole > 0, whole)
    return F.when(rate.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)))


def clean_class(value: Column) -> Column:
    """Rounded half to even, kept if 1, 2 or 3."""
    rounded = F.bround(value).cast("int")
    return F.when(rounded.isin(1, 2, 3), rounded)


def _tier_conditions(overlap: Column, metres: Column, hazard_class: Column) -> dict[str, Column]:
    near, known = metres <= TIER_M[0], hazard_class.isin(1, 2, 3)
    return {
        "overlap": overlap,
        "unknown": metres.isNull(),
        "near": near & F.coalesce(known & (hazard_class >= TIER_CLASS), F.lit(False)),
        "near, no class": near & ~F.coalesce(known, F.lit(False)),
        "near, low class": near,
        "second": metres <= TIER_M[1],
        "third": metres <= TIER_M[2],
    }


def _first(conditions: dict[str, Column], values: dict[str, str | Column], last: str | Column) -> Column:
    out = None
    for name, condition in conditions.items():
        out = F.when(condition, values[name]) if out is None else out.when(condition, values[name])
    return out.otherwise(last)


def priority_tier(overlap: Column, metres: Column, hazard_class: Column) -> Column:
    """Tier by overlap, distance (closed above) and class; no class within the first limit falls to tier 2."""
    one, two, three, beyond = TIERS
    return _first(_tier_conditions(overlap, metres, hazard_class), {"overlap": one, "unknown": "Unknown", "near": one, "near, no class": two, "near, low class": two, "second": two, "third": three}, beyond)


def tier_rule(overlap: Column, metres: Column, hazard_class: Column) -> Column:
    """The rule that set the tier."""
    a, b, c = (f"{m:.0f}m" for m in TIER_M)
    rules = {"overlap": "direct_zone_overlap = True (hard safety rule)", "unknown": "CLASSIFICATION_ERROR: distance field is NaN", "near": f"dist ≤ {a} AND mh_class ≥ {TIER_CLASS}", "near, no class": f"dist ≤ {a}; mh_class = NoData (conservative Tier 2)", "near, low class": f"dist ≤ {b}", "second": f"dist ≤ {b}", "third": f"dist ≤ {c}"}
    return _first(_tier_conditions(overlap, metres, hazard_class), rules, f"dist > {c}")


def tier_reason(overlap: Column, metres: Column, hazard_class: Column, zone: Column) -> Column:
    """The reason in words."""
    context = F.when(hazard_class.isin(1, 2, 3), F.format_string("MH Class %d", hazard_class)).otherwise("MH class unavailable (NoData)")
    at = F.format_string("(distance: %.0fm, nearest: %s)", F.bround(metres, 0), F.coalesce(zone.cast("string"), F.lit("N/A")))
    a, b, c = (f"{m:.0f}m" for m in TIER_M)
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    second = says(f"Centroid within {b} of Candidate Red Zone ", at, ". ", context, " at centroid.")
    reasons = {
        "overlap": says("HARD RULE: Village centroid directly overlaps Candidate Hazard-Based Red Zone polygon. Village sits within red zone boundary. (", context, " at centroid)"),
        "unknown": F.lit("nearest_hazard_distance_m is NaN — classification not possible"),
        "near": says(f"Centroid within {a} of Candidate Red Zone ", at, " AND ", context, f" at centroid (rule: MH Class ≥ {TIER_CLASS}). Close proximity with moderate-higher hazard terrain at centroid."),
        "near, no class": says(f"Centroid within {a} of Candidate Red Zone ", at, " but ", context, ". Cannot confirm Tier 1 MH class condition. Assigned Tier 2 (conservative — avoids unverified elevation)."),
        "near, low class": says(second, f" Note: within {a} threshold but ", context, f" (Lower class — below Tier 1 class threshold ≥ {TIER_CLASS})."),
        "second": second,
        "third": says(f"Centroid within {c} of Candidate Red Zone ", at, ". ", context, " at centroid. Within monitoring proximity band."),
    }
    beyond = says(f"Centroid beyond {c} from nearest Candidate Red Zone ", at, ". ", context, " at centroid. Outside monitoring proximity band.")
    return _first(_tier_conditions(overlap, metres, hazard_class), reasons, beyond)


def uncertainty_band(metres: Column) -> Column:
    """P30."""
    return F.when(metres <= 50, "HIGH_PRECISION (≤ 50 m)").when(metres <= 100, "MODERATE_PRECISION (51–100 m)").when(metres <= 200, "VILLAGE_SCALE_PRECISION (101–200 m)").otherwise("CORRIDOR_SCALE_PRECISION (> 200 m)")


DRIVERS = ["Terrain Susceptibility Dominated (Steep Flanks)", "Hydrological Convergence Dominated (Channel Corridor / Terraces)", "Dual Predisposition (Steep Gully / Convergence Flanks)"]


def dominant_driver(terrain: Column, flood: Column, score: Column, share: float = 65.0) -> Column:
    """Which mean contribution makes at least `share` percent of the mean score; a score of 0 counts as half and half."""
    part = lambda c: F.when(score > 0, c / score * 100).otherwise(50.0)
    return F.when(part(terrain) >= share, DRIVERS[0]).when(part(flood) >= share, DRIVERS[1]).otherwise(DRIVERS[2])


def metres_per_degree_lon(lat: Column) -> Column:
    """P34."""
    return F.lit(111_320.0) * F.cos(F.radians(lat))


ROAD_CATEGORIES = ["ISOLATED_GRAPH_DISCONNECTED", "SEVERELY_REMOTE", "REMOTE", "MODERATELY_ACCESSIBLE", "HIGHLY_ACCESSIBLE"]


def road_category(snap_m: Column, minutes: Column) -> Column:
    """Accessibility category; disconnected if the snap is over 3000 m or nothing is reached."""
    disconnected, severe, remote, moderate, high = ROAD_CATEGORIES
    return (
        F.when((snap_m > 3000) | minutes.isNull() | snap_m.isNull(), disconnected)
        .when((minutes > 90) | (snap_m > 1500), severe)
        .when(minutes > 45, remote)
        .when((minutes > 15) | (snap_m > 500), moderate)
        .otherwise(high)
    )


def road_isolated(category: Column) -> Column:
    """The two farthest categories are isolated."""
    return category.isin(ROAD_CATEGORIES[:2])


# Transverse Mercator on WGS 84, UTM zone 44 N: series of order 6 in the third flattening.
_A, _F, _K0, _LON0, _FE = 6378137.0, 1 / 298.257223563, 0.9996, 81.0, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in zone 44 N."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(_LON0))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + _sum([F.lit(a) * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(_ALPHA)])
    y = xi + _sum([F.lit(a) * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(_ALPHA)])
    return F.lit(_FE) + F.lit(_K0 * _RADIUS) * x, F.lit(_K0 * _RADIUS) * y


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of zone 44 N coordinates; coordinates that look geographic stay as they are."""
    xi, eta = y / F.lit(_K0 * _RADIUS), (x - F.lit(_FE)) / F.lit(_K0 * _RADIUS)
    xp = xi - _sum([F.lit(b) * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(_BETA)])
    ep = eta - _sum([F.lit(b) * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(_BETA)])
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi + _sum([F.lit(d) * F.sin(2 * (k + 1) * chi) for k, d in enumerate(_DELTA)])
    metric = (F.abs(x) > 180) | (F.abs(y) > 90)
    return F.when(metric, F.lit(_LON0) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))).otherwise(x), F.when(metric, F.degrees(lat)).otherwise(y)
