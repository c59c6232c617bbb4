import math
import random

import pytest
from pyspark.sql import functions as F

from atlasrun.functions import geometry as G
from atlasrun.operators import spatial
from atlasrun.operators.graph import connected_components


def table(spark, paths, *, scale=1.0, width=1440.0, threshold=20.0, seam_x=0.0):
    """One location per list of path texts."""
    rows = [(place, 100 * place + pos, pos, text) for place, texts in enumerate(paths) for pos, text in enumerate(texts)]
    raw = spark.createDataFrame(rows, "location_id bigint, component_id bigint, pos bigint, text string")
    return spatial.component_table(raw.withColumn("points", G.path_points(F.col("text"))).drop("text"),
                                   width=width, scale=scale, threshold=threshold, seam_x=seam_x)


def summaries(spark, paths, *, proximity=24.0, scale=1.0, width=1440.0, **more):
    members = spatial.cluster_members(table(spark, paths, scale=scale, width=width, **more), world=width * scale, proximity=proximity)
    chosen = {}
    for r in members.collect():
        chosen.setdefault(r.location_id, []).append(r.pos)
    rows = {r.location_id: r for r in spatial.cluster_summary(members, width=width, scale=scale).collect()}
    return {k: (sorted(v), rows[k]) for k, v in chosen.items()}


def test_cluster_cases(spark):
    got = summaries(spark, [
        ["M0,0L2,0L2,2L0,2Z", "M8,0L10,0L10,2L8,2Z", "M100,0L102,0L102,2L100,2Z"],
        ["M0,0L19.99,0L0,1Z"], ["M0,0L20,0L0,1Z"],
        ["M0,0L20,0L20,20L0,20Z", "M19,30L39,30L39,50L19,50Z"],
        ["M0,0L2,0L2,2L0,2Z", "M3,0L5,0L5,2L3,2Z"],
        ["M10,10L10,10Z", "M20,10L20,10Z"],
        ["M1438,0L1439,0L1439,1Z", "M1,0L2,0L2,1Z"],
        ["M10,10L10,10Z", "M10,10L12,10L12,12Z"]])
    assert got[0][0] == [0, 1] and got[0][1].centre_x == 5
    assert got[1][0] == [0] and 2 not in got and 3 not in got
    assert got[4][0] == [0, 1] and got[5][0] == [0, 1]
    assert got[6][0] == [0, 1] and got[6][1].max_x - got[6][1].min_x == 4
    assert got[7][0] == [1]  # a point and a ring are never neighbours; the ring is larger


def segment_gap(a, b):
    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def reach(p, s):
        (x, y), (ex, ey) = s
        dx, dy = ex - x, ey - y
        length = dx * dx + dy * dy
        t = max(0, min(1, ((p[0] - x) * dx + (p[1] - y) * dy) / length)) if length else 0
        return math.hypot(p[0] - x - t * dx, p[1] - y - t * dy)

    if turn(*a, b[0]) * turn(*a, b[1]) < 0 and turn(*b, a[0]) * turn(*b, a[1]) < 0:
        return 0.0
    return min(reach(a[0], b), reach(a[1], b), reach(b[0], a), reach(b[1], a))


def brute_pairs(boundaries, world, proximity):
    found = {}
    for a in range(len(boundaries)):
        for b in range(a + 1, len(boundaries)):
            def sides(points, shift=0.0):
                moved = [(x + shift, y) for x, y in points]
                return list(zip(moved, moved[1:] + moved[:1]))

            gap = min(segment_gap(s, o) for shift in (-world, 0, world) for s in sides(boundaries[a]) for o in sides(boundaries[b], shift))
            if gap <= proximity:
                found[a, b] = gap
    return found


@pytest.mark.parametrize("seed,proximity,spread", [(1, 3.0, 60), (2, 1.0, 25), (3, 8.0, 100), (4, 0.0, 12)])
def test_pairs_and_clusters_equal_brute_force(spark, seed, proximity, spread):
    pick, world = random.Random(seed), 200.0
    boundaries = []
    for _ in range(26):
        x, y = pick.choice([pick.uniform(0, spread), pick.uniform(world - 8, world)]), pick.uniform(0, spread)
        boundaries.append([(round(x + pick.uniform(0, 6), 2), round(y + pick.uniform(0, 6), 2)) for _ in range(pick.randrange(3, 6))])
    rows = [(1, i, i, b) for i, b in enumerate(boundaries)]
    frame = spark.createDataFrame(rows, "location_id bigint, component_id bigint, pos bigint, boundary array<struct<x:double,y:double>>") \
        .withColumn("degenerate", F.lit(False))
    want = brute_pairs(boundaries, world, proximity)
    got = {(r.a, r.b): r.distance for r in spatial.near_pairs(frame, world=world, proximity=proximity).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)

    root = list(range(len(boundaries)))
    for a, b in sorted(want):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    labels = {r.component_id: r.cluster for r in spatial.clusters(frame, world=world, proximity=proximity).collect()}
    assert labels == dict(enumerate(root))


def test_crowded_location_needs_few_links(spark):
    """Hundreds of components on one spot: one link each, not one per pair."""
    rows = [(1, i, i, [(i / 1000, 0.0), (i / 1000 + 0.5, 0.3), (i / 1000, 0.4)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "location_id bigint, component_id bigint, pos bigint, boundary array<struct<x:double,y:double>>") \
        .withColumn("degenerate", F.lit(False))
    links = spatial.proximity_links(frame, world=1440.0, proximity=24.0)
    assert links.count() < 2000
    assert spatial.clusters(frame, world=1440.0, proximity=24.0).select("cluster").distinct().count() == 1


def frame_of(spark, boundaries):
    rows = [(1, i, i, b) for i, b in enumerate(boundaries)]
    return spark.createDataFrame(rows, "location_id bigint, component_id bigint, pos bigint, boundary array<struct<x:double,y:double>>") \
        .withColumn("degenerate", F.lit(False))


@pytest.mark.parametrize("seed,proximity,busy", [(5, 0.05, 6), (6, 0.4, 20), (7, 3.0, 2), (8, 0.0, 5)])
def test_pairs_in_refined_cells(spark, seed, proximity, busy):
    """A crowd in one cell of the grid, on the seam, and long sides through it."""
    pick, world = random.Random(seed), 200.0
    boundaries = [[(0.0, 0.0), (150.0, 0.3), (90.0, 2.0)], [(0.2, 0.1), (0.2, 60.0), (0.1, 0.2)]]
    for _ in range(24):
        x, y = pick.choice([pick.uniform(0, 1), pick.uniform(world - 0.5, world)]), pick.uniform(0, 1)
        boundaries.append([(x + pick.uniform(0, 0.2), y + pick.uniform(0, 0.2)) for _ in range(3)])
    boundaries += [boundaries[-1]] * 3  # no cut parts equal sides
    want = brute_pairs(boundaries, world, proximity)
    got = spatial.near_pairs(frame_of(spark, boundaries), world=world, proximity=proximity, cell=8.0, busy=busy).collect()
    assert {(r.a, r.b) for r in got} == want.keys() and all(math.isclose(r.distance, want[r.a, r.b], abs_tol=1e-9) for r in got)


def test_hot_cell_is_cut_by_load(spark):
    """20,000 short sides in one cell of the grid: no leaf is crowded; equal sides are dealt out in shares."""
    pick = random.Random(1)
    sides = [(1, False, i, (x := pick.uniform(0, 0.04)), (y := pick.uniform(0, 0.04)), x + 1e-5, y + 1e-5, False) for i in range(20_000)]
    sides += [(2, False, i, 0.5123, 0.5271, 0.5123, 0.5271, False) for i in range(1_000)]
    sides += [(3, False, i, 3.0 * i, 1.0, 3.0 * i, 2.0, False) for i in range(50)]
    sides += [(4, False, i, 0.01 + i * 1e-6, 0.01, 0.02, 0.02, False) for i in range(1_000)]  # meet in a point: cuts would only multiply them
    frame = spark.createDataFrame(sides, "location_id bigint, degenerate boolean, component_id bigint, ax double, ay double, bx double, by double, moved boolean")
    leaves = spatial.leaf_sides(frame, size=0.05, proximity=1e-6, busy=400)
    loads = leaves.groupBy(*spatial._LEAF).agg(F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("asked")).collect()
    hot = sorted(r.asking + r.asked for r in loads if r.location_id == 1)
    assert hot[-1] <= 10 * hot[len(hot) // 2] and hot[-1] <= 400 and len(hot) > 100
    assert max(r.asking + r.asked for r in loads if r.location_id == 2) <= 2.5 * 400
    met = leaves.where("asks").alias("a").join(leaves.where("not asks").alias("b"), spatial._LEAF).where("location_id = 2")
    assert met.count() == met.select("a.component_id", "b.component_id").distinct().count() == 1_000_000
    assert {r.level for r in loads if r.location_id == 3} == {0}
    assert leaves.where("location_id = 4").count() < 50_000


def test_cells_settle_most_pairs_by_their_outermost_points(spark):
    """Thousands of sides in neighbouring cells, of which few are looked at."""
    pick, world, proximity = random.Random(3), 1440.0, 24.0
    size, slack = proximity / math.sqrt(2), 1e-6
    boundaries = []
    for _ in range(1_500):
        x, y = pick.choice([(5, 5), (25, 5), (60, 60), (58, 90)])
        x, y = x + pick.uniform(0, 8), y + pick.uniform(0, 8)
        boundaries.append([(x, y), (x + 0.5, y + 0.2), (x + 0.1, y + 0.6)])
    frame = frame_of(spark, boundaries)
    unit, none = F.lit(size), F.lit(0.0)
    placed = spatial.place(spatial._sides(frame, world, proximity), unit, unit, none, none, none).select(*spatial._CELL, "component_id", *spatial.SIDES)
    pairs = spatial.cell_pairs(spatial._cell_heads(placed, size), proximity=proximity, slack=slack).cache()
    probe, other, match = spatial.open_sides(pairs, placed, proximity=proximity, slack=slack)
    still, tested = pairs.where("verdict = 'open'").count(), probe.join(other, match).count()
    assert pairs.where("verdict = 'near'").count() > 0 and tested <= 2_000 * max(still, 1) and tested < 0.02 * placed.count() ** 2
    gap = min(math.dist(p, q) for a in boundaries for b in boundaries[:200] for p in a for q in b if (a[0][0] < 40) != (b[0][0] < 40))
    labels = spatial.clusters(frame, world=world, proximity=proximity).select("cluster").distinct().count()
    assert gap > proximity and labels == 2


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 103), (200, 200)]
    vertices = spark.createDataFrame([(i,) for i in [*range(0, 61), 100, 101, 103, 200, 300]], "id bigint")
    edges = spark.createDataFrame(chain, "a bigint, b bigint")
    got = {r.id: r.cluster for r in connected_components(vertices, edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200, 300: 300}


def test_views(spark):
    items = spark.createDataFrame([(1, 12.0, 212.0), (2, 700.0, 701.0), (3, -5.0, 3.0)], "item bigint, min_x double, max_x double")
    views = spark.createDataFrame([(1, -1428.0, 212.0), (2, 0.0, 1440.0)], "view_id bigint, view_min double, view_max double")
    got = {(r.item, r.view_id, r.offset) for r in spatial.in_views(items, views, width=1440.0).collect()}
    want = {(i, v, t) for i, lo, hi in [(1, 12, 212), (2, 700, 701), (3, -5, 3)] for v, a, b in [(1, -1428, 212), (2, 0, 1440)]
            for t in (0.0, -1440.0, 1440.0) if hi + t >= a and lo + t <= b}
    assert got == want


def test_views_against_all_pairs(spark):
    """Narrow and wide items and views, on and beyond the map, with ends that touch."""
    import random

    r, width = random.Random(2), 360.0
    items, views = [], []
    for k in range(120):
        low = r.choice([r.uniform(0, 360), float(r.randrange(0, 360, 20)), -5.0, 355.0])
        items.append((k, low, low + r.choice([0.0, 1e-9, 3.0, 20.0, 340.0, 360.0])))
    for k in range(60):
        low = r.choice([r.uniform(-400, 700), float(r.randrange(-360, 720, 20)), -2000.0, 1500.0])
        views.append((k, low, low + r.choice([0.0, 5.0, 20.0, 400.0, 3000.0])))
    got = spatial.in_views(spark.createDataFrame(items, "item long, min_x double, max_x double"), spark.createDataFrame(views, "view_id long, view_min double, view_max double"), width=width)
    want = sorted((i, v, t) for i, a, b in items for v, c, d in views for t in (0.0, -width, width) if b + t >= c and a + t <= d)
    assert sorted((x.item, x.view_id, x.offset) for x in got.collect()) == want


def test_path_components(spark):
    table = spatial.path_components(spark.createDataFrame([(1, 0, "M359,1L1,1L1,3Z M10,10L12,10L12,14Z"), (1, 1, "M5,5L6,5L6,9Z"), (2, 0, "")], "location_id long, path_pos int, path string"))
    rows = {r.component_id: (r.pos, len(r.points)) for r in table.collect()}
    assert rows == {"1:0:0": (0, 3), "1:0:1": (1, 3), "1:1:0": (2, 3)}
    span = spark.sql("SELECT 'M359,1L1,1L1,3Z M10,10L12,10L12,14Z' AS path").select(G.path_span(G.path_rings(F.col("path")), F.lit(360.0)).alias("span")).first().span
    assert span == 4.0
