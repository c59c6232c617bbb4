import math
import random

import pytest
from pyspark.sql import functions as F

from atlasrun.functions import geometry as G
from atlasrun.operators import rings


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def pairs(points):
    return [(p["x"], p["y"]) for p in points]


def test_area_and_paths(spark):
    def area(text):
        return one(spark, G.signed_area(G.path_points(F.lit(text))))

    assert area("M0,0L4,0L4,3L0,3Z") == 12
    assert not one(spark, G.has_area(G.path_points(F.lit("M0,0L0,0Z"))))
    sub_paths = one(spark, G.path_rings(F.lit("M0,0L2,0L2,2Z M40,0L42,0L42,2Z")))
    assert [pairs(r) for r in sub_paths] == [[(0, 0), (2, 0), (2, 2)], [(40, 0), (42, 0), (42, 2)]]


def test_path_text_round_trip(spark, ring_of):
    points = [(0, 0), (1.25, -3), (1439.12, 154.9)]
    text = one(spark, G.path_text(ring_of(points)))
    assert text == "M0,0L1.25,-3L1439.12,154.9Z"
    assert pairs(one(spark, G.path_points(F.lit(text)))) == points


def test_unwrap(spark, ring_of):
    assert pairs(one(spark, G.unwrap(ring_of([(1, 0), (1439, 1)]), F.lit(1440.0)))) == [(1441, 0), (1439, 1)]
    assert one(spark, G.ring_span(ring_of([(1, 0), (1439, 1)]), F.lit(1440.0))) == 2
    inside = [(10, 0), (12, 5), (11, 9)]
    assert pairs(one(spark, G.unwrap(ring_of(inside), F.lit(1440.0)))) == inside


def test_wrapped_view(spark):
    width, seam = F.lit(1440.0), F.lit((152 + 180) / 360 * 1440)
    view = G.view_bounds(width, seam)
    assert tuple(one(spark, view)) == (-1428, 212)
    assert one(spark, G.visible_offsets(F.lit(12.0), F.lit(212.0), width, view)) == [0, -1440]
    assert -1440 in one(spark, G.visible_offsets(F.lit(1438.0), F.lit(1442.0), width, G.view_bounds(width, F.lit(40.0))))
    assert one(spark, G.nearest_offset(F.array(F.lit(0.0), F.lit(-1440.0)), F.lit(1400.0), F.lit(100.0))) == -1440
    assert one(spark, G.nearest_offset(F.array().cast("array<double>"), F.lit(1.0), F.lit(2.0))) == 0


def test_standard_parallel(spark):
    assert one(spark, G.standard_parallel_y(F.lit(10.0), F.lit(0), F.lit(50.0))) == 10
    assert one(spark, G.standard_parallel_y(F.lit(10.0), F.lit(60), F.lit(50.0))) == pytest.approx(-30)
    for bad in (90.0, float("nan")):
        with pytest.raises(Exception, match="standard parallel"):
            one(spark, G.standard_parallel_y(F.lit(10.0), F.lit(bad), F.lit(50.0)))


def test_clean_ring(spark, ring_of):
    assert pairs(one(spark, G.clean_ring(ring_of([(0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 0)])))) == [(0, 0), (1, 0), (1, 1)]
    assert pairs(one(spark, G.clean_ring(ring_of([(0, 0), (0, 0)])))) == [(0, 0)]


def douglas_peucker(points, tolerance):
    if len(points) < 3:
        return points
    best, index = tolerance ** 2, 0
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    for i, (x, y) in enumerate(points[1:-1], 1):
        t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        d = (x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2
        if d > best:
            best, index = d, i
    if not index:
        return [points[0], points[-1]]
    return douglas_peucker(points[:index + 1], tolerance) + douglas_peucker(points[index:], tolerance)[1:]


def random_rings(seed, count, size, spread=100):
    pick = random.Random(seed)
    out = []
    for ring in range(count):
        n = pick.randrange(3, size)
        if ring % 2:
            points = [(pick.randrange(spread), pick.randrange(spread)) for _ in range(n)]
        else:
            points = [(round(50 + (20 + pick.random() * 20) * math.cos(2 * math.pi * k / n), 3),
                       round(50 + (20 + pick.random() * 20) * math.sin(2 * math.pi * k / n), 3)) for k in range(n)]
        out.append((ring, [(float(x), float(y)) for x, y in points]))
    return out


def ring_frame(spark, data):
    return spark.createDataFrame(data, "ring_id bigint, points array<struct<x:double,y:double>>")


def test_simplify_equals_the_recursive_form(spark):
    data = [(i, p + p[:1]) for i, p in random_rings(3, 40, 60)] + [(100, [(1.0, 1.0), (2.0, 2.0)]), (101, [(0.0, 0.0)] * 5)]
    got = {r.ring_id: pairs(r.points) for r in rings.simplify(ring_frame(spark, data), 8.0, "points").collect()}
    assert got == {i: douglas_peucker(p, 8.0) for i, p in data}


def brute_crossing(points):
    n = len(points)

    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return 0 if abs(v) < G.EPSILON else math.copysign(1, v)

    for i in range(n):
        for j in range(i + 1, n):
            if (j + 1) % n == i or (i + 1) % n == j:
                continue
            a, b, c, d = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


@pytest.mark.parametrize("busy", [64, 2])
def test_self_crossing_equals_all_pairs(spark, busy):
    data = random_rings(5, 80, 24, spread=12)
    got = {r.ring_id for r in rings.self_crossing(ring_frame(spark, data), ["ring_id"], busy=busy).collect()}
    assert got == {i for i, p in data if brute_crossing(p)}


def test_crowded_ring(spark):
    """Most vertices in one corner: the crowded cell is split and the only crossing there is found."""
    saw = [(k / 1000, (k % 2) / 1000) for k in range(400)]
    calm = saw + [(100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    crossed = saw[:200] + [(0.0995, 0.5), (0.0994, -0.5)] + saw[200:] + [(100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    got = {r.ring_id for r in rings.self_crossing(ring_frame(spark, [(1, calm), (2, crossed)]), ["ring_id"]).collect()}
    assert got == ({1} if brute_crossing(calm) else set()) | ({2} if brute_crossing(crossed) else set())


def test_ring_flags_and_classes(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    bow = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]
    open_ring, flat = square[:-1], [(1, 1), (1, 1), (1, 1)]

    def shape(*polygons):
        return [[[(float(x), float(y)) for x, y in ring] for ring in polygon] for polygon in polygons]

    features = spark.createDataFrame(
        [("f1", shape([square, hole], [hole])), ("f2", shape([bow])), ("f3", shape([open_ring], [flat]))],
        "feature_id string, polygons array<array<array<struct<x:double,y:double>>>>")
    exploded = rings.explode_rings(features)
    roles = {r.ring_id: (r.role, r.parent_ring_id, r.island) for r in exploded.collect()}
    assert roles["f1:polygon:0:ring:1"] == ("interior", "f1:polygon:0:ring:0", False)
    assert roles["f1:polygon:1:ring:0"] == ("exterior", None, True)
    flags = rings.ring_flags(exploded)
    valid = {r.ring_id: (r.source_closed, r.valid) for r in flags.collect()}
    assert valid == {"f1:polygon:0:ring:0": (True, True), "f1:polygon:0:ring:1": (True, True), "f1:polygon:1:ring:0": (True, True),
                     "f2:polygon:0:ring:0": (True, False), "f3:polygon:0:ring:0": (False, False), "f3:polygon:1:ring:0": (True, False)}
    classes = rings.polygon_classes(flags)
    assert {r.polygon_id: (r.kind, round(r.area, 6)) for r in classes.where("feature_id != 'f2'").collect()} == {
        "f1:polygon:0": ("polygon", 1600.0), "f1:polygon:1": ("polygon", 64.0), "f3:polygon:0": ("artifact", 1600.0), "f3:polygon:1": ("artifact", 0.0)}
    assert tuple(rings.ring_counters(flags).first()) == (6, 3, 0)
    dots = rings.tiny_features(classes, "feature_id", 0.04).collect()
    assert [(d.feature_id, d.diameter) for d in dots] == [("f1", 2.0)]
    assert rings.tiny_features(classes, "feature_id", 0.05).count() == 0
    parts = {r.part_id for r in rings.explode_parts(features).collect()}
    assert parts == {"f1:part:0", "f1:part:1", "f1:part:2", "f2:part:0", "f3:part:0", "f3:part:1"}
