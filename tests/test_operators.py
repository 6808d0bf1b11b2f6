"""Mini inputs with known answers."""

import datetime
import functools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscape.components import components
from cellscape.functions import scores as S
from cellscape.operators import grid, parts, roads, spatial, views
from cellscape.operators import quality as Q
from cellscape.operators import tables as T
from cellscape.operators.ranking import row_numbers


def cells(spark, rows):
    return spark.createDataFrame([(r, c, float(v) if v is not None else None) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, elev double")


def test_plane_slope_and_aspect(spark):
    plane = cells(spark, [[0, 30, 60]] * 3)
    assert {round(r.slope, 9) for r in grid.slope(plane).collect()} == {45.0}
    assert {round(r.aspect, 9) for r in grid.aspect(plane).collect()} == {90.0}
    assert {round(r.aspect, 9) for r in grid.aspect(plane, downslope=True).collect()} == {270.0}


def test_flat_and_missing_centre(spark):
    assert {r.aspect for r in grid.aspect(cells(spark, [[5] * 3] * 3)).collect()} == {-1.0}
    hole = cells(spark, [[0, 30, 60], [0, None, 60], [0, 30, 60]])
    assert [round(r.slope, 6) for r in grid.slope(hole).where("row = 1 AND col = 1").collect()] == [45.0]
    assert [r.aspect for r in grid.aspect(hole).where("row = 1 AND col = 1").collect()] == [None]


def test_pit_flow(spark):
    flow = grid.flow_direction(cells(spark, [[9, 9, 9], [9, 1, 9], [9, 9, 9]]))
    ids = flow.select((F.col("row") * 3 + F.col("col")).cast("long").alias("id"), (F.col("to_row") * 3 + F.col("to_col")).cast("long").alias("to"))
    acc = {r.id: r.acc for r in grid.flow_accumulation(ids).collect()}
    assert acc[4] == 9 and acc[0] == 1
    assert [r.flow_dir for r in flow.where("row = 1 AND col = 1").collect()] == [0]


def test_corner_zones(spark):
    mask = spark.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    assert grid.zones(mask, 8).select("zone").distinct().count() == 1
    assert grid.zones(mask, 4).select("zone").distinct().count() == 2


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_snake_components(spark, local_edges):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = components(edges, local_edges=local_edges)
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 61), (100, 2)}
    assert components(edges.limit(0), local_edges=local_edges).count() == 0


def test_components_past_the_limit_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(edges, max_rounds=1, local_edges=0)


def test_a_cycle_of_pointers_is_an_error(spark):
    with pytest.raises(RuntimeError, match="cycle"):
        grid.flow_accumulation(spark.createDataFrame([(1, 2), (2, 1)], "id long, to long"), max_rounds=3)


@pytest.mark.parametrize("score,code", [(0.35, 2), (0.65, 3), (1.0, 3), (0.0, 1), (None, None)])
def test_class_edges(spark, score, code):
    assert spark.range(1).select(S.classify(F.lit(score).cast("double"))).first()[0] == code


@pytest.mark.parametrize("overlap,metres,cls,tier", [(False, 500.0, 2, S.TIERS[0]), (False, 500.0, 1, S.TIERS[1]), (False, 500.0, None, S.TIERS[1]), (False, 500.1, 3, S.TIERS[1]), (True, None, None, S.TIERS[0]), (False, None, 3, "Unknown"), (False, 5000.0, 3, S.TIERS[2]), (False, 5000.1, 3, S.TIERS[3])])
def test_tiers(spark, overlap, metres, cls, tier):
    assert spark.range(1).select(S.priority_tier(F.lit(overlap), F.lit(metres).cast("double"), F.lit(cls).cast("int"))).first()[0] == tier


def test_capacity(spark):
    got = T.capacity(spark.createDataFrame([(10_000.0,), (1_000_000.0,), (1_000_001.0,)], "area_m2 double")).collect()
    assert [r.estimated_household_capacity for r in got] == [160, 16_000, None] and got[2].capacity_status == "AREA_EXCEEDS_SITE_PLANNING_SCALE"
    none = T.capacity(spark.createDataFrame([(10_000.0,)], "area_m2 double"), None).first()
    assert none.capacity_status == "NOT_ESTIMATED_REQUIRES_PLANNING_STANDARD" and none.capacity_viable is None


def test_kilometres_are_rounded_from_their_exact_value(spark):
    rng = random.Random(9)
    metres = [3050.0, 4350.0, 2250.0, 2750.0, 2949.9999, 9950.0, 123456789.05, *[rng.randrange(200_001, 2_000_000) / 100 for _ in range(300)], *[50.0 * k for k in range(41, 400)]]
    got = spark.createDataFrame([(m,) for m in metres], "m double").select("m", S.hazard_buffer_context(F.col("m")).alias("t")).collect()
    assert {r.t for r in got if r.m == 3050.0} == {"Beyond 2km from nearest Candidate Red Zone (3.0km)"}
    assert [r.t for r in got] == [f"Beyond 2km from nearest Candidate Red Zone ({r.m / 1000:.1f}km)" for r in got]


def test_zone_means_do_not_depend_on_the_order_of_cells(spark):
    rng, rows, want = random.Random(6), [], {}
    for zone in range(300):
        parts = [(rng.randrange(650, 1001), rng.randrange(650, 1001)) for _ in range(16)]
        if sum(6 * t + 4 * f for t, f in parts) % 4 != 2:
            parts[0] = (parts[0][0] - 1, parts[0][1])  # the mean is half-way between two roundings
        rows += [(zone, k // 4, k % 4, 0.6 * (t / 1000.0) + 0.4 * (f / 1000.0)) for k, (t, f) in enumerate(parts)]
        want[zone] = float(round(Fraction(sum(6 * t + 4 * f for t, f in parts), 160_000) * 10**6) / Fraction(10**6))
    rows += [(1000, 0, 0, float("nan")), (1000, 0, 1, 1.0), (1001, 0, 0, None), (1002, 0, 0, 3e30), (1002, 0, 1, 1e30)]
    cells = spark.createDataFrame(rows, "zone long, row long, col long, score double")
    for order in ("col", -F.col("col"), F.xxhash64("row", "col")):
        got = {r.zone: r.mean_score for r in grid.zone_summary(cells.coalesce(1).sortWithinPartitions("zone", order), 900.0, {"score": "score"}).collect()}
        assert math.isnan(got.pop(1000)) and got.pop(1001) is None and got.pop(1002) == 2e30 and got == want


def test_dedup_chain(spark):
    rows = [(1, "SLIDE", 0.0, 0.0, 2013), (2, "SLIDE", 400.0, 0.0, 2013), (3, "SLIDE", 800.0, 0.0, 2013)]
    events = spark.createDataFrame(rows, "id long, kind string, x double, y double, year int").withColumn("date", F.lit("2013-06-16").cast("date"))
    for pairs in (0, 1000):
        assert {r.id: r.leader for r in spatial.dedup_events(events, "id", "kind", greedy_pairs=pairs).collect()} == {1: 1, 2: 1, 3: 3}


def greedy_leaders(rows):
    """The plain loop: in order, an event that isn't merged absorbs its later matches."""
    leader = {}
    for i, a in enumerate(rows):
        if leader.setdefault(a["id"], a["id"]) != a["id"]:
            continue
        for b in rows[i + 1 :]:
            days = abs((a["date"] - b["date"]).days) if a["date"] and b["date"] else (0 if a["year"] == b["year"] else None)
            if b["id"] not in leader and a["kind"] == b["kind"] and math.dist((a["x"], a["y"]), (b["x"], b["y"])) <= 500 and days is not None and days <= 3:
                leader[b["id"]] = a["id"]
    return leader


@pytest.mark.parametrize("pairs", [3, 50_000])
def test_dedup_is_the_plain_loop(spark, pairs):
    rng = random.Random(4)
    rows = [{"id": i, "kind": rng.choice("AB"), "x": rng.uniform(0, 4000), "y": rng.uniform(-4000, 0), "year": 2013 + rng.randrange(2), "date": datetime.date(2013, 6, rng.randrange(1, 12)) if rng.random() < 0.8 else None} for i in range(250)]
    events = spark.createDataFrame(rows, "id long, kind string, x double, y double, year int, date date")
    assert {r.id: r.leader for r in spatial.dedup_events(events, "id", "kind", greedy_pairs=pairs).collect()} == greedy_leaders(rows)


@pytest.mark.parametrize(("first", "meetings"), [(100, 10**9), (60, 1500)])
def test_dedup_by_batches_is_the_plain_loop(spark, first, meetings):
    rng = random.Random(14)
    rows = [{"id": i, "kind": rng.choice("AB"), "x": rng.uniform(-2000, 2000), "y": rng.uniform(-2000, 0), "year": 2013 + rng.randrange(2), "date": datetime.date(2013, 6, rng.randrange(1, 12)) if rng.random() < 0.8 else None} for i in range(400)]
    rows += [{"id": 400 + i, "kind": "A", "x": 9000.0, "y": 0.0, "year": 2013, "date": datetime.date(1969, 12, 30 - i % 2)} for i in range(100)]
    events = spark.createDataFrame(rows, "id long, kind string, x double, y double, year int, date date")
    assert {r.id: r.leader for r in spatial.dedup_events(events, "id", "kind", first_events=first, most_meetings=meetings).collect()} == greedy_leaders(rows)


def test_dedup_makes_few_pairs_of_a_crowded_place(spark, monkeypatch):
    made, real = [], spatial.event_matches

    def counted(*a):
        out = spatial.staged(real(*a), "counted")
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "event_matches", counted)
    events = spark.range(3000).select("id", F.lit("A").alias("kind"), (F.col("id") % 5).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(2013).alias("year"), F.lit("2013-06-16").cast("date").alias("date"))
    assert spatial.dedup_events(events, "id", "kind", first_events=100, most_meetings=5000).where("leader = 0").count() == 3000
    assert sum(made) < 20_000  # all matching pairs are 4,498,500


def broadcast_joins(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Broadcast" in line and "Join" in line]


def test_dedup_broadcasts_no_events(spark, monkeypatch):
    from cellscape import components

    made, real = [], spatial.staged

    def seen(df, *a, **k):
        made.extend(broadcast_joins(df))
        return real(df, *a, **k)

    monkeypatch.setattr(spatial, "staged", seen)
    monkeypatch.setattr(components, "staged", seen)
    events = spark.range(60).select("id", F.lit("A").alias("kind"), ((F.col("id") % 10) * 5000 + F.col("id") * 9.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2013).alias("year"), F.lit("2013-06-16").cast("date").alias("date"))
    out = spatial.dedup_events(events, "id", "kind", greedy_pairs=3, first_events=40)
    components.components(out.select(F.col("id").alias("a"), F.col("leader").alias("b")), local_edges=0)
    made += broadcast_joins(out)
    assert made and all("_bx" in line and "LeftOuter" in line or "[component" in line for line in made)  # crowded buckets and large components alone


def test_merged_events(spark):
    rows = [(1, "A", 0.0, 0.0, "p", 2, "2013-06-16"), (2, "A", 30.0, 40.0, "o", 9, "2013-06-17"), (3, "A", 9e5, 0.0, "q", None, None)]
    events = spark.createDataFrame(rows, "id long, kind string, x double, y double, provider string, fatalities long, d string").withColumns({"date": F.col("d").cast("date"), "year": F.lit(2013)})
    got = {r.id: r for r in spatial.merged_events(events, spatial.dedup_events(events, "id", "kind"), "id").collect()}
    assert set(got) == {1, 3} and got[1].fatalities == 9 and got[1].provider == "o + p" and got[1].spatial_offset_m == 50.0 and got[3].fatalities is None and got[3].duplicate_count == 0
    assert got[1].duplicates[0].temporal_offset_days == 1
    leaders = spatial.staged(events.select("id", F.lit(1).cast("long").alias("leader")), "leaders")
    assert not broadcast_joins(spatial.merged_events(events, leaders, "id"))


def test_nearest_far_and_ties(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 90_000.0, 0.0), (3, None, 1.0)], "a long, x double, y double")
    right = spark.createDataFrame([(10, 3.0, 4.0), (11, -3.0, 4.0)], "b long, x double, y double")
    got = {r.a: (r.b, r.distance_m) for r in spatial.nearest(left, right, "a", "b").collect()}
    assert got[1] == (10, 5.0) and got[2][0] == 10 and got[3] == (None, None)


def plain_distance(shape, p, r):
    if shape == "cell":
        return math.hypot(max(abs(p[0] - r[0]) - 15, 0), max(abs(p[1] - r[1]) - 15, 0))
    if shape == "segment":
        dx, dy = r[2] - r[0], r[3] - r[1]
        t = max(0, min(1, ((p[0] - r[0]) * dx + (p[1] - r[1]) * dy) / (dx * dx + dy * dy)))
        return math.dist(p, (r[0] + t * dx, r[1] + t * dy))
    return math.dist(p, r[:2])


@pytest.mark.parametrize("shape", ["point", "cell", "segment"])
def test_nearest_of_shapes_near_and_far(spark, shape):
    rng = random.Random(1)
    spots = [(rng.choice([0, 2000, 40_000]) + rng.uniform(0, 900), rng.choice([0, -70_000]) - rng.uniform(0, 900)) for _ in range(120)]
    right = [(i, x, y, x + rng.uniform(-800, 800), y + rng.uniform(-800, 800), "a" if i % 3 else "b") for i, (x, y) in enumerate(spots)]
    left = [(i, rng.uniform(-5000, 90_000), rng.uniform(-90_000, 5000), "a" if i % 2 else "b") for i in range(80)]
    got = spatial.nearest(spark.createDataFrame(left, "l long, x double, y double, s string"), spark.createDataFrame(right, "r long, x double, y double, x2 double, y2 double, s string"), "l", "r", digits=None, by="s", shape=shape)
    want = {i: min((plain_distance(shape, (x, y), r[1:5]), r[0]) for r in right if r[5] == s) for i, x, y, s in left}
    assert {r.l: (r.r, pytest.approx(r.distance_m)) for r in got.collect()} == {i: (r, d) for i, (d, r) in want.items()}


def test_nearest_meets_few_rows_in_a_cluster_with_an_outlier(monkeypatch):
    """A cluster of 100 m and one row at 10,000 km: what a point is compared with doesn't grow with the cluster."""
    import numpy as np

    rng, met = np.random.default_rng(2), []
    plain = spatial._distances
    monkeypatch.setattr(spatial, "_distances", lambda x, y, *rest: met.append(len(x) * len(rest[0][0])) or plain(x, y, *rest))
    for n in (1_000, 4_000, 16_000):
        met.clear()
        rows, points = rng.uniform(0, 100, (2, n)), rng.uniform(0, 100, (2, 500))
        rows[:, 0] = 1e7
        at, d = spatial.nearest_rows(points[0], points[1], list(rows), "point", 0.0)
        assert sum(met) <= 500 * 12 * spatial.LEAF
        want = np.hypot(points[0][:, None] - rows[0], points[1][:, None] - rows[1])
        assert np.array_equal(at, want.argmin(1)) and np.allclose(d, want.min(1))


def test_nearest_of_a_cluster_goes_to_few_boxes(spark):
    rows = spark.range(20_000).selectExpr("id AS b", "CASE WHEN id = 0 THEN 1e7D ELSE pmod(id * 7919, 10007) / 100.07D END AS x", "pmod(id * 104729, 10009) / 100.09D AS y")
    staged = rows.selectExpr("b AS _key", "x AS _x", "y AS _y", "'' AS _set")
    cuts, bounds = spatial._cuts(staged, "point", 0.0)
    assert len(bounds[""][0]) > 800 and staged.withColumn("_box", spatial._box(staged, cuts)).groupBy("_box").count().agg({"count": "max"}).first()[0] <= 120
    points = spark.range(300).selectExpr("id AS a", "pmod(id * 31, 100) + 0.3D AS x", "pmod(id * 17, 100) + 0.7D AS y", "'' AS _set")
    assert spatial._looks(points, bounds).count() <= 300 * 12
    left = points.drop("_set")
    got = {r.a: (r.b, r.distance_m) for r in spatial.nearest(left, rows, "a", "b", digits=None).collect()}
    right = [(r.x, r.y, r.b) for r in rows.collect()]
    for p in left.where("a % 30 = 0").collect():
        d, b = min((math.sqrt((p.x - x) ** 2 + (p.y - y) ** 2), b) for x, y, b in right)
        assert got[p.a] == (b, pytest.approx(d))


def test_nearest_zone_from_inside_and_outside(spark):
    cells = [(r, c, 1, 2) for r in range(9) for c in range(9)] + [(r, c, 5, 1) for r in range(9) for c in (9, 10)]
    zones = spark.createDataFrame(cells, "row long, col long, zone long, zone_rank long")
    assert spatial.zone_sides(zones).count() == 32 + 18
    points = spark.createDataFrame([(1, 130.0, -130.0), (2, 270.0, -100.0), (3, -60.0, -15.0), (4, 300.0, 40.0), (5, None, 0.0)], "k long, x double, y double")
    assert {r.k: (r.zone, r.distance_m) for r in spatial.nearest_zone(points, zones, "k").collect()} == {1: (1, 0.0), 2: (5, 0.0), 3: (1, 60.0), 4: (5, 40.0), 5: (None, None)}


def test_crowded_buckets_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    left = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500)) for i in range(40)]
    right = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500)) for i in range(300)]
    dl, dr = spark.createDataFrame(left, "l long, x double, y double"), spark.createDataFrame(right, "r long, x double, y double")
    monkeypatch.setattr(spatial, "BUCKET_ROWS", 7)
    near = {r.l: (r.r, r.n) for r in spatial.nearest(dl, dr, "l", "r").join(spatial.within_radius(dl, dr, "l", {"n": 400.0}), "l").collect()}
    assert near == {i: (min((math.dist((x, y), q[1:]), q[0]) for q in right)[1], sum(math.dist((x, y), q[1:]) <= 400 for q in right)) for i, x, y in left}


def test_radius_counts_without_pairs(spark):
    """Crowds on both sides: 4,000 points at 40 places about 60,000 points at 6,000, and no pair is a row."""
    left = spark.range(4000).selectExpr("id AS l", "100.0D * (id % 8) + 0.25D AS x", "100.0D * (id div 8 % 5) + 0.25D AS y")
    right = spark.range(60_000).selectExpr("id AS r", "(id * 7919 % 1000) + 0.25D AS x", "(id * 104729 % 6000) / 6 + 0.25D AS y", "id % 3 = 0 AS third")
    out = spatial.within_radius(left, right, "l", {"near": 100.0, "far": 300.0}, {"third": F.col("third")})
    got = {r.l: (r.near, r.far, r.near_third, r.far_third) for r in out.collect()}
    assert len(got) == 4000
    rx, ry, third = (np.array(c) for c in zip(*[(r.x, r.y, r.third) for r in right.collect()], strict=True))
    for p in left.where("l < 40").collect():
        d = np.sqrt((rx - p.x) ** 2 + (ry - p.y) ** 2)
        assert got[p.l] == got[p.l + 3960] == tuple(int(((d <= r) & t).sum()) for t in (True, third) for r in (100.0, 300.0))
    most = max(_rows_made(out))
    assert most <= 100_000


def _rows_made(df):
    """The rows that each operator of an executed query has made."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        metric = node.metrics().get("numOutputRows")
        found += [metric.get().value()] if metric.isDefined() else []
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_blocks_count_as_points_do():
    rng = np.random.default_rng(3)
    x, y, n = rng.integers(0, 60, 5000) + 0.25, rng.integers(0, 60, 5000) + 0.25, rng.integers(1, 4, (5000, 2))
    px, py = rng.integers(-20, 80, 300) + 0.25, rng.integers(-20, 80, 300) + 0.25
    d = np.sqrt((px[:, None] - x) ** 2 + (py[:, None] - y) ** 2)
    for r in (0.0, 5.0, 25.0, 200.0):  # whole distances lie on the circle
        assert (spatial.Blocks(x, y, n).within(px, py, r) == (d <= r).astype(int) @ n).all()
    one = spatial.Blocks(x[:1], y[:1], n[:1])
    assert (one.within(x[:2], y[:2], 0.0)[0] == n[0]).all()


def test_points_at_one_place_are_looked_for_once(spark, monkeypatch):
    asked = []
    looks = spatial._looks
    monkeypatch.setattr(spatial, "_looks", lambda here, *a: asked.append(here.count()) or looks(here, *a))
    left = spark.range(3000).selectExpr("id AS l", "(id % 7) * 3.0D AS x", "(id % 7) * 1.0D AS y", "cast(id % 2 as string) AS s")
    right = spark.range(50).selectExpr("id AS r", "id * 0.5D AS x", "0.0D AS y", "cast(id % 2 as string) AS s")
    got = {r.l: (r.r, r.distance_m) for r in spatial.nearest(left, right, "l", "r", by="s", digits=None).collect()}
    assert asked == [14] and len(got) == 3000
    rows = [(r.r, r.x, r.y, r.s) for r in right.collect()]
    for p in left.where("l % 100 < 14").collect():
        d, r = min((math.sqrt((p.x - x) ** 2 + (p.y - y) ** 2), r) for r, x, y, s in rows if s == p.s)
        assert got[p.l] == (r, pytest.approx(d))


def test_rings_touch_and_have_holes(spark):
    cells = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(3, 3)]
    zone = spark.createDataFrame([(7, r, c) for r, c in cells], "zone long, row long, col long")
    rings = [r.points for r in grid.rings(grid.boundary_edges(zone)).collect()]
    areas = sorted(sum((p.x + q.x) * (p.y - q.y) / 2 for p, q in zip(r, r[1:])) / 900 for r in rings)
    assert all(r[0] == r[-1] for r in rings) and areas == [-1.0, 1.0, 9.0]


def test_rasterised_ring_with_a_hole(spark):
    square = lambda a, b: [(a, -a), (b, -a), (b, -b), (a, -b), (a, -a)]
    rows = [(1, [{"x": float(x), "y": float(y)} for x, y in square(0, 150)]), (1, [{"x": float(x), "y": float(y)} for x, y in square(60, 90)])]
    got = spatial.rasterise(spark.createDataFrame(rows, "k long, ring array<struct<x: double, y: double>>"), "k")
    assert {(r.row, r.col) for r in got.collect()} == {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}


def test_resampling_skips_missing_cells(spark):
    base = cells(spark, [[0, 30], [None, 90]])
    half = {(r.row, r.col): r.elev for r in grid.resample(base, "elev", 1, 1, 60.0, 30.0).collect()}
    assert half == {(0, 0): 40.0}
    near = {(r.row, r.col): r.elev for r in grid.resample(base, "elev", 2, 2, 30.0, 30.0, "nearest").collect()}
    assert near == {(0, 0): 0.0, (0, 1): 30.0, (1, 0): None, (1, 1): 90.0}


def test_tiles_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    g = cells(spark, [[rng.uniform(0, 50) if rng.random() < 0.9 else None for _ in range(11)] for _ in range(9)])
    read = lambda: ({(r.row, r.col): r.slope for r in grid.slope(g).collect()}, {(r.row, r.col): (r.flow_dir, r.to_row, r.to_col) for r in grid.flow_direction(g).collect()})
    whole = read()
    for f in ("_tiled", "_own"):
        monkeypatch.setattr(grid, f, functools.partial(getattr(grid, f), tile=4))
    assert read() == whole and len(whole[0]) == 99


def test_row_numbers_and_percentiles(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), float(rng.randrange(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g int, v double")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r.i: r.n for r in row_numbers(df, [F.desc("v"), F.col("i")], "n").collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    seen, want = {}, {}
    for i, g, _ in order:
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert {r.i: r.n for r in row_numbers(df, [F.desc("v"), F.col("i")], "n", by=["g"]).collect()} == want
    values = sorted(r[2] for r in rows)
    for p, got in zip((10, 33, 50, 99), T.percentiles(df, "v", [10, 33, 50, 99]).first(), strict=True):
        at = p / 100 * 299
        low = values[int(at)]
        assert got == pytest.approx(low + (values[min(299, int(at) + 1)] - low) * (at - int(at)))
    assert T.percentiles(df.limit(0), "v", [50]).first()[0] is None


@pytest.mark.parametrize("falls", [False, True])
def test_monotone(spark, falls):
    df = spark.createDataFrame([(i, float(i // 3 - (5 if falls and i == 70 else 0))) for i in range(100)], "k int, v double")
    assert Q.monotone(df, "k", "v").first().passed is not falls


def test_ranks_in_order(spark):
    check = lambda rows: Q.ranks_in_order(spark.createDataFrame(rows, "rank long, score double"), "rank", "score").first().passed
    assert check([(1, 3.0), (2, 3.0), (3, 1.0)]) and not check([(1, 1.0), (2, 3.0)]) and not check([(1, 3.0), (3, 1.0)]) and not check([(1, 3.0), (1, 3.0)])


def test_view_filters_refuse_what_is_malformed(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "xmin double, xmax double, ymin double, ymax double")
    assert views.meets_box(df, "1,1,2,2").count() == 1 and views.meets_box(df, "2,2,3,3").count() == 0
    for bad in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            views.meets_box(df, bad)
    with pytest.raises(ValueError):
        views.with_tier(df, "TIER_9")
    assert views.known_tiers(["nonsense"]) == S.ACTION_TIERS


def test_priority_report_files(spark, tmp_path):
    rows = [(1, "A", S.TIERS[0], 10.0), (2, "B", S.TIERS[3], 20.0)]
    views.write_priority_report(spark.createDataFrame(rows, "village_id long, name string, priority_tier string, distance_m double"), str(tmp_path / "r"), ["one", "two"])
    assert [r.value for r in spark.read.text(str(tmp_path / "r/head")).collect()] == ["# one", "# two", "Village_ID,Village_Name,Priority_Tier,Distance_to_Hazard_Zone_m"]
    assert [r.value for r in spark.read.text(str(tmp_path / "r/rows")).collect()] == ["1,A,Tier1_AttentionPriority,10.0"]


def test_unknown_tier_has_no_horizon(spark):
    got = T.relocation_horizon(spark.createDataFrame([("Unknown",), ("BeyondProximity",)], "priority_tier string")).orderBy("priority_tier").collect()
    assert [r.relocation_horizon for r in got] == ["ROUTINE_MONITORING", "UNKNOWN"] and "'Unknown'" in got[1].horizon_rationale


def test_lines_to_edges(spark):
    rows = [(1, [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0)], "a"), (2, [(3.0, 4.0), (0.0, 0.0)], "b")]
    lines = spark.createDataFrame(rows, "seq long, points array<struct<x:double,y:double>>, name string").withColumn("speed_kmh", F.lit(30.0))
    edges = roads.lines_to_edges(lines)
    assert [(r.length_m, r.minutes, r.name) for r in edges.collect()] == [(5.0, 0.01, "b")]
    assert {(r.x, r.y) for r in roads.network_nodes(edges).collect()} == {(0.0, 0.0), (3.0, 4.0)}


@pytest.mark.parametrize(("local_edges", "part_nodes"), [(0, 7), (0, 1000), (1000, 1000)])
def test_shortest_paths(spark, local_edges, part_nodes):
    rng = random.Random(5)
    edges = [(i, i + 1, rng.uniform(1, 9), rng.uniform(1, 9)) for i in range(60) if i % 20 != 19] + [(rng.randrange(60), rng.randrange(60), rng.uniform(5, 30), rng.uniform(5, 30)) for _ in range(12)] + [(900, 901, 1.0, 1.0)]
    edges = list({(min(u, v), max(u, v)): (u, v, a, b) for u, v, a, b in edges if u != v}.values())
    starts = [("s", 0), ("s", 33), ("t", 5), ("t", 5000)]  # the last has no edge
    got = roads.shortest_paths(spark.createDataFrame(edges, "u long, v long, length_m double, minutes double"), spark.createDataFrame(starts, "set string, node long"), ["length_m", "minutes"], local_edges=local_edges, part_nodes=part_nodes)
    want = {}
    for s in "st":
        for k, w in ((2, "length_m"), (3, "minutes")):
            dist = {n: 0.0 for x, n in starts if x == s}
            for _ in range(80):
                for e in edges:
                    for a, b in ((e[0], e[1]), (e[1], e[0])):
                        if a in dist and dist[a] + e[k] < dist.get(b, math.inf):
                            dist[b] = dist[a] + e[k]
            want |= {(s, w, n): pytest.approx(d) for n, d in dist.items()}
    assert {(r.set, r.weight, r.node): r.dist for r in got.collect()} == want


def test_paths_of_a_lattice_take_few_rounds(spark):
    """10,000 nodes in 9 parts: paths of over 200 edges settle in rounds that grow with the parts, at exactly one task's distances."""
    side = 100
    spot = lambda r, c: roads.node(c * 60.0, -r * 60.0)
    cells = spark.range(side * side).select(F.floor(F.col("id") / side).cast("long").alias("r"), (F.col("id") % side).alias("c"))
    steps = F.array(F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2")), F.struct(F.col("r").alias("r2"), (F.col("c") + 1).alias("c2")))
    lattice = cells.select("r", "c", F.explode(steps).alias("s")).where((F.col("s.r2") < side) & (F.col("s.c2") < side))
    edges = lattice.select(spot(F.col("r"), F.col("c")).alias("u"), spot(F.col("s.r2"), F.col("s.c2")).alias("v"), (1 + F.pmod(F.xxhash64("r", "c", "s"), F.lit(1000)) / 7).alias("length_m"))
    starts = edges.agg(F.min("u").alias("node")).select(F.lit("a").alias("set"), "node")
    far = roads.shortest_paths(edges, starts, ["length_m"], max_rounds=12, local_edges=0, part_nodes=1200).toPandas().set_index("node")["dist"]
    one = roads.shortest_paths(edges, starts, ["length_m"]).toPandas().set_index("node")["dist"]
    assert len(one) == side * side and (far.sort_index() == one.sort_index()).all()
    with pytest.raises(RuntimeError):
        roads.shortest_paths(edges, starts, ["length_m"], max_rounds=1, local_edges=0, part_nodes=1200)


def test_parts_of_a_long_network_are_cut_across(spark):
    """A network 10 m wide and 4 km long: parts are stretches of it, so that each touches two others at most."""
    nodes = spark.range(4000).selectExpr("id AS node", "(id % 10) * 1.0D AS x", "(id div 10) * 10.0D AS y")
    made = parts.node_parts(nodes.select("node"), (F.col("node") % 10).cast("double"), F.floor(F.col("node") / 10) * 10.0, 100)
    spans = nodes.join(made, "node").groupBy("part").agg(F.countDistinct("x").alias("wide"), (F.max("y") - F.min("y")).alias("high")).collect()
    assert len(spans) == 40 and all(r.wide == 10 and r.high <= 100 for r in spans)


@pytest.mark.parametrize("bundle", [40, 100_000])
def test_parts_walked_in_bundles_give_the_same_ways(spark, monkeypatch, bundle):
    rng = random.Random(5)
    edges = [(min(a, b), max(a, b), float(rng.randint(1, 30))) for a, b in {tuple(sorted(rng.sample(range(300), 2))) for _ in range(700)}]
    monkeypatch.setattr(parts, "PART_NODES", bundle)
    tables = spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame([("a", 7), ("b", 8), ("b", 250), ("c", 999)], "set string, node long")
    how = {"x": F.col("node").cast("double"), "y": F.lit(0.0)}
    got = {(r.set, r.node): r.dist for r in parts.paths_by_parts(*tables, ["w"], **how, part_nodes=20).collect()}
    whole = {(r.set, r.node): r.dist for r in roads.shortest_paths(*tables, ["w"]).collect()}
    assert got == whole and len(got) > 500


def test_paths_of_an_empty_network(spark):
    edges = spark.createDataFrame([], "u long, v long, length_m double")
    starts = spark.createDataFrame([("a", 3)], "set string, node long")
    for local_edges in (-1, 10):
        assert [tuple(r) for r in roads.shortest_paths(edges, starts, ["length_m"], local_edges=local_edges).collect()] == [("a", "length_m", 3, 0.0)]


def test_squares_from_segments():
    """Against the least distance between many places of a segment and the square."""
    rng = np.random.default_rng(2)
    x, y, sides = rng.uniform(-60, 60, 40), rng.uniform(-60, 60, 40), [rng.uniform(-60, 60, 25) for _ in range(4)]
    sides[2][:5], sides[3][5:10] = sides[0][:5], sides[1][5:10]  # upright and level ones
    sides[2][10], sides[3][10] = sides[0][10], sides[1][10]  # and one that is a point
    got = spatial._from_squares(x, y, sides, 15.0)
    t = np.linspace(0, 1, 4001)[:, None, None]
    px, py = sides[0] + t * (sides[2] - sides[0]) - x[:, None], sides[1] + t * (sides[3] - sides[1]) - y[:, None]
    want = np.hypot(np.maximum(np.abs(px) - 15, 0), np.maximum(np.abs(py) - 15, 0)).min(0)
    assert np.abs(got - want).max() < 0.05 and (got == 0).any() and (got > 10).any()


def test_roads_of_areas(spark):
    """A line inside an area, one that crosses another, one beside a third (the nearer of two), and a tie."""
    cells = [("a", r, c) for r in range(5) for c in range(5)] + [("b", 20, 20)] + [("c", 40, c) for c in (1, 2, 3)] + [("d", 60, 10)]
    line = lambda seq, *p: (seq, list(p), f"road {seq}", None, "track", None, True)
    rows = [line(1, (70.0, -70.0), (80.0, -75.0)), line(2, (550.0, -615.0), (700.0, -615.0)), line(3, (140.0, -1240.0), (140.0, -1500.0)), line(4, (200.0, -1215.0), (300.0, -1215.0)), line(6, (350.0, -1815.0), (400.0, -1815.0)), line(5, (280.0, -1815.0), (100.0, -1815.0)), (7, None, None, None, None, None, None)]
    lines = spark.createDataFrame(rows, "seq long, points array<struct<x: double, y: double>>, name string, ref string, highway string, surface string, is_vehicular boolean")
    got = roads.nearest_road_of_areas(spark.createDataFrame(cells, "area_id string, row long, col long"), lines, "area_id")
    assert {r.area_id: (r.nearest_road_name, r.dist_to_nearest_road_m, r.nearest_road_ref) for r in got.collect()} == {"a": ("road 1", 0.0, "None"), "b": ("road 2", 0.0, "None"), "c": ("road 3", 22.4, "None"), "d": ("road 5", 20.0, "None")}
    none = roads.nearest_road_of_areas(spark.createDataFrame(cells[:3], "area_id string, row long, col long"), lines.where("seq = 7"), "area_id").first()
    assert (none.dist_to_nearest_road_m, none.nearest_road_name, none.nearest_road_is_vehicular) == (None, "Unnamed Road", False)


def test_duplicates_are_documented(spark):
    merged = spark.createDataFrame([(1, [(2, 5.0), (3, 1.0)]), (4, None)], "event_id long, duplicates array<struct<event: long, spatial_offset_m: double>>")
    pairs = [(1, 1), (2, 1), (3, 1), (4, 4)]
    check = lambda m, p: Q.duplicates_documented(m, spark.createDataFrame(p, "event_id long, leader long"), "event_id").first()
    assert check(merged, pairs).passed and check(merged.where("event_id = 4"), pairs[3:]).passed
    assert (check(merged, [*pairs, (5, 4)]).observed, check(merged, pairs[:2]).observed) == ("1", "1"), "one untold, one told for nothing"
    assert not check(merged.withColumn("duplicates", F.concat("duplicates", "duplicates")), pairs).passed


def test_people_are_told_only_behind_the_gate(spark):
    from cellscape.plans import pipelines as P

    at = spark.createDataFrame([(1, 10), (2, 20)], "village_id long, tot_p long").withColumn("join_method", F.lit(P.CODED))
    assert P.population_known(at, at) and not P.population_known(at, at.where("village_id = 1"))
    assert not P.population_known(at.withColumn("join_method", F.lit("Name match")), at) and not P.population_known(at.limit(0), at.limit(0))
    told, hidden = (P.candidate_areas(spark, "/root/testdata/sf0.001", join_method=m).agg(F.count("nearest_village"), F.count("nearest_village_pop")).first() for m in (P.CODED, "Name match"))
    assert told[0] == told[1] == hidden[0] > 0 and hidden[1] == 0


def test_utm(spark):
    x, y = S.to_utm(F.lit(81.0), F.lit(0.0))
    assert [round(v, 6) for v in spark.range(1).select(x, y).first()] == [500000.0, 0.0]
    x, y = S.to_utm(F.lit(79.0), F.lit(30.0))
    lon, lat = S.from_utm(F.col("x"), F.col("y"))
    a, b = spark.range(1).select(x.alias("x"), y.alias("y")).select(lon, lat).first()
    assert math.isclose(a, 79.0, abs_tol=1e-9) and math.isclose(b, 30.0, abs_tol=1e-9)


def test_exclusion_mask(spark):
    base = spark.createDataFrame([(1, 3, None), (2, 1, 50.0), (3, 1, 1.0)], "id int, cls int, slope double")
    mask, log = T.exclusion_mask(base, {"class_3": F.col("cls") == 3, "steep": F.col("slope") > 20, "cap": None}, F.lit(True))
    assert [r.excluded for r in mask.orderBy("id").collect()] == [1, 1, 0]
    assert log.first().asDict() == {"class_3": 1, "steep": 1, "cap": None, "all": 2}


def test_repeated_key_is_refused(spark):
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated k"):
        T.join_one_to_one(twice, spark.createDataFrame([(1,)], "k int"), "k").collect()
