"""Geometry of single rings as column expressions.

A ring is ``array<struct<x, y>>``. Everything here works inside one row, so no vertex is ever
shuffled: projection, cleaning, area, centroid, envelope, seam handling and path text.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, rotate
from .numbers import fixed2, number_text

# Map size, seam longitude, overlap on both sides, smallest span shown as a shape,
# cluster proximity, and the smallest area and orientation that count as non-zero.
MAP_WIDTH = 1440.0
MAP_HEIGHT = 720.0
SEAM_LONGITUDE = 152.0
VIEW_OVERLAP = 100.0
SMALL_SPAN = 20.0
CLUSTER_PROXIMITY = 24.0
DOT_SIZE = 2.0
EPSILON = 2.220446049250313e-16
TOUCH_EPSILON = 1e-9

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points_from_pairs(pairs: Column) -> Column:
    """``array<array<double>>`` of coordinate pairs as points; further ordinates are ignored."""
    return F.transform(pairs, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


# --- projection ------------------------------------------------------------------------------

def map_x(longitude: Column, width: float = MAP_WIDTH) -> Column:
    return (longitude + 180.0) / 360.0 * width


def map_y(latitude: Column, height: float = MAP_HEIGHT) -> Column:
    return (90.0 - latitude) / 180.0 * height


def project(p: Column, width: float = MAP_WIDTH, height: float = MAP_HEIGHT) -> Column:
    """Equirectangular position of a longitude/latitude point."""
    return point(map_x(p["x"], width), map_y(p["y"], height))


def project_rounded(p: Column, width: float = MAP_WIDTH, height: float = MAP_HEIGHT) -> Column:
    """The same, rounded to two decimals."""
    return point(fixed2(map_x(p["x"], width)), fixed2(map_y(p["y"], height)))


def standard_parallel_y(y: Column, parallel: Column, centre_y: Column) -> Column:
    """Stretch y about ``centre_y`` for a standard parallel; parallels at or beyond a pole fail."""
    angle = parallel.cast("double")
    bad = angle.isNull() | F.isnan(angle) | (F.abs(angle) >= 90)
    scale = F.when(bad, F.raise_error(F.lit("standard parallel must be a finite latitude between -90 and 90")).cast("double")) \
        .otherwise(1.0 / F.cos(angle * math.pi / 180.0))
    return centre_y + (y - centre_y) * scale


# --- rings -----------------------------------------------------------------------------------

def same_point(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def clean_ring(ring: Column) -> Column:
    """Drop consecutive repeats and the closing vertex."""
    def open_ring(points: Column) -> Column:
        closed = (F.size(points) > 1) & same_point(F.get(points, F.lit(0)), F.get(points, F.size(points) - 1))
        return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    return let(ring, lambda r: let(
        F.filter(r, lambda p, i: (i == 0) | ~same_point(p, F.get(r, i - 1))), open_ring))


def is_closed(ring: Column) -> Column:
    return let(ring, lambda r: (F.size(r) > 1) & same_point(F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)))


def is_finite(ring: Column) -> Column:
    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    return F.forall(ring, lambda p: finite(p["x"]) & finite(p["y"]))


def signed_area(points: Column) -> Column:
    """Shoelace area; the list is closed implicitly. Fewer than three points have none."""
    def shoelace(r: Column) -> Column:
        steps = F.zip_with(r, rotate(r), lambda a, b: F.struct((a["x"] * b["y"]).alias("plus"), (b["x"] * a["y"]).alias("minus")))
        return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["plus"] - s["minus"]) / 2

    return let(points, lambda r: F.when(F.size(r) < 3, F.lit(0.0)).otherwise(shoelace(r)))


def has_area(points: Column) -> Column:
    return F.abs(signed_area(points)) > EPSILON


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def envelope(points: Column) -> Column:
    """Smallest and largest coordinates."""
    return F.struct(F.array_min(xs(points)).alias("min_x"), F.array_min(ys(points)).alias("min_y"),
                    F.array_max(xs(points)).alias("max_x"), F.array_max(ys(points)).alias("max_y"))


def centroid(points: Column) -> Column:
    """Area centroid; a ring without area gives the centre of its envelope."""
    def by_area(r: Column, area: Column) -> Column:
        steps = F.zip_with(r, rotate(r), lambda a, b: F.struct(
            (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy"), (a["x"] * b["y"] - b["x"] * a["y"]).alias("cross")))
        total = F.aggregate(steps, point(F.lit(0.0), F.lit(0.0)),
                            lambda acc, s: point(acc["x"] + s["sx"] * s["cross"], acc["y"] + s["sy"] * s["cross"]))
        return let(total, lambda t: point(t["x"] / (area * 6), t["y"] / (area * 6)))

    def of(r: Column) -> Column:
        middle = let(envelope(r), lambda e: point((e["min_x"] + e["max_x"]) / 2, (e["min_y"] + e["max_y"]) / 2))
        return let(signed_area(r), lambda area: F.when(F.abs(area) <= EPSILON, middle).otherwise(by_area(r, area)))

    return let(points, of)


def span(points: Column) -> Column:
    return let(envelope(points), lambda e: point(e["max_x"] - e["min_x"], e["max_y"] - e["min_y"]))


def mean_point(points: Column) -> Column:
    """Vertex mean, rounded to two decimals."""
    def mean(r: Column) -> Column:
        total = F.aggregate(r, point(F.lit(0.0), F.lit(0.0)), lambda acc, p: point(acc["x"] + p["x"], acc["y"] + p["y"]))
        return let(total, lambda t: point(fixed2(t["x"] / F.size(r)), fixed2(t["y"] / F.size(r))))

    return let(points, mean)


def anchor(label_x: Column, label_y: Column, bounds: Column) -> Column:
    """Projected label point, or the envelope's smallest corner when a label coordinate is missing."""
    return F.when(label_x.isNotNull() & label_y.isNotNull(),
                  point(fixed2(map_x(label_x)), fixed2(map_y(label_y)))).otherwise(point(bounds["min_x"], bounds["min_y"]))


# --- the seam of the map ----------------------------------------------------------------------

def _gaps(sorted_xs: Column, width: Column) -> Column:
    """Gap to the next distinct x, the last one wrapping round the world."""
    following = F.concat(F.slice(sorted_xs, 2, F.size(sorted_xs)), F.array(F.get(sorted_xs, F.lit(0)) + width))
    return F.zip_with(sorted_xs, following, lambda x, nxt: F.struct((nxt - x).alias("gap"), nxt.alias("next")))


def _distinct_xs(points: Column) -> Column:
    return F.array_sort(F.array_distinct(xs(points)))


def wrapped_x_span(points: Column, width: Column) -> Column:
    """Width of the world minus the largest empty arc."""
    return let(_distinct_xs(points), lambda v: width - F.array_max(F.transform(_gaps(v, width), lambda g: g["gap"])))


def ring_span(points: Column, width: Column) -> Column:
    """Larger of the seam-aware x span and the y span."""
    return F.greatest(wrapped_x_span(points, width), F.array_max(ys(points)) - F.array_min(ys(points)))


def path_span(rings: Column, width: Column) -> Column:
    """The largest seam-aware span of the sub-paths of a path (a list of vertex lists)."""
    return F.array_max(F.transform(rings, lambda ring: ring_span(ring, width)))


def unwrap_start(points: Column, width: Column) -> Column:
    """The x at which the ring begins once the world is cut at its largest empty arc."""
    def start(v: Column) -> Column:
        widest = F.array_max(F.transform(_gaps(v, width), lambda g, i: F.struct(g["gap"].alias("gap"), (-i).alias("at"), g["next"].alias("next"))))
        return let(widest["next"] % width, lambda target: F.array_min(
            F.transform(v, lambda x, i: F.struct(F.abs(x - target).alias("off"), i.alias("at"), x.alias("x"))))["x"])

    return let(_distinct_xs(points), start)


def unwrap(points: Column, width: Column) -> Column:
    """Shift the vertices left of the cut by one world width, so the ring is in one piece."""
    def moved(r: Column) -> Column:
        return let(unwrap_start(r, width), lambda start: F.transform(
            r, lambda p: point(F.when(p["x"] < start, p["x"] + width).otherwise(p["x"]), p["y"])))

    return let(points, lambda r: F.when(F.size(r) < 2, r).otherwise(moved(r)))


def view_bounds(width: Column, seam_x: Column, overlap: float = VIEW_OVERLAP) -> Column:
    """Visible x range of the wrapped world."""
    first = F.when(seam_x == 0, F.lit(0.0)).otherwise(-seam_x)
    return F.struct((first - overlap).alias("min_x"), (first + width + overlap).alias("max_x"))


def visible_offsets(min_x: Column, max_x: Column, width: Column, view: Column) -> Column:
    """World copies (0, one to the left, one to the right, in this order) that show in the view."""
    return F.filter(F.array(F.lit(0.0), -width, width.cast("double")),
                    lambda t: (max_x + t >= view["min_x"]) & (min_x + t <= view["max_x"]))


def nearest_offset(offsets: Column, x: Column, target: Column) -> Column:
    """The offset that brings x closest to the target; the first wins ties, 0 when there is none."""
    ranked = F.transform(offsets, lambda t, i: F.struct(F.abs(x + t - target).alias("off"), i.alias("at"), t.alias("t")))
    return F.coalesce(F.array_min(ranked)["t"], F.lit(0.0))


# --- path text -------------------------------------------------------------------------------

def path_text(points: Column) -> Column:
    """``M x,y L x,y ... Z`` without spaces."""
    pairs = F.transform(points, lambda p: F.concat(number_text(p["x"]), F.lit(","), number_text(p["y"])))
    return F.concat(F.lit("M"), F.array_join(pairs, "L"), F.lit("Z"))


def path_points(text: Column) -> Column:
    """All vertices of a path text, over all its sub-paths."""
    x = F.regexp_extract_all(text, F.lit(r"[ML](-?[\d.]+),(-?[\d.]+)"), F.lit(1))
    y = F.regexp_extract_all(text, F.lit(r"[ML](-?[\d.]+),(-?[\d.]+)"), F.lit(2))
    return F.zip_with(x, y, lambda a, b: point(a, b))


def path_rings(text: Column) -> Column:
    """The sub-paths of a path text, each as its own vertex list."""
    parts = F.regexp_extract_all(text, F.lit(r"M-?[\d.]+,-?[\d.]+[^M]*"), F.lit(0))
    return F.transform(parts, path_points)


# --- segments --------------------------------------------------------------------------------

def boundary_segments(points: Column) -> Column:
    """Consecutive vertex pairs; an open list also gets the closing one."""
    def segment(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    def of(r: Column) -> Column:
        pairs = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), segment)
        first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
        return F.when(same_point(first, last), pairs).otherwise(F.concat(pairs, F.array(segment(last, first))))

    empty = F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")
    return let(points, lambda r: F.when(F.size(r) < 2, empty).otherwise(of(r)))


def is_degenerate(points: Column) -> Column:
    """Are all vertices the same point?"""
    return let(points, lambda r: F.forall(r, lambda p: same_point(p, F.get(r, F.lit(0)))))


# A side is a mapping of its coordinates ax, ay, bx, by and its measures dx, dy and length (the squared
# length, 1 for a point). Measures are computed before a join, once per side, so that the tests that
# run on joined pairs stay small enough for generated code.
SIDE = ("ax", "ay", "bx", "by", "dx", "dy", "length")


def side(s: Column | dict[str, Column]) -> dict[str, Column]:
    """Coordinates and measures of a segment struct."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    squared = dx * dx + dy * dy
    return {"ax": s["ax"], "ay": s["ay"], "bx": s["bx"], "by": s["by"], "dx": dx, "dy": dy,
            "length": F.when(squared == 0, 1.0).otherwise(squared)}


def side_columns(s: Column | dict[str, Column], prefix: str) -> list[Column]:
    """The same as flat columns ``<prefix>ax`` and so on."""
    return [value.alias(prefix + name) for name, value in side(s).items()]


def side_named(prefix: str) -> dict[str, Column]:
    """The side held by flat columns."""
    return {name: F.col(prefix + name) for name in SIDE}


def turn(s: dict[str, Column], x: Column, y: Column) -> Column:
    """Twice the signed area of the triangle of a side and a point."""
    return s["dx"] * (y - s["ay"]) - s["dy"] * (x - s["ax"])


def turns(a: dict[str, Column], b: dict[str, Column]) -> list[Column]:
    """Where the ends of b lie as seen from a, and those of a as seen from b."""
    return [turn(a, b["ax"], b["ay"]), turn(a, b["bx"], b["by"]), turn(b, a["ax"], a["ay"]), turn(b, a["bx"], a["by"])]


def opposite(first: Column, second: Column, slack: float) -> Column:
    """Are the two values on different sides of zero, both beyond the slack?"""
    return (F.least(first, second) < -slack) & (F.greatest(first, second) > slack)


def crosses(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Do two sides cross properly? Touching and overlapping do not count."""
    a_c, a_d, b_a, b_b = turns(a, b)
    beyond = EPSILON * (1 - 2 ** -53)  # values of exactly epsilon count as non-zero
    return opposite(a_c, a_d, beyond) & opposite(b_a, b_b, beyond)


def _touches(x: Column, y: Column, s: dict[str, Column], side_of: Column) -> Column:
    """Is a point on a side: within the slack of its line (``side_of`` is its :func:`turn`) and inside its box?"""
    outside = (x - s["ax"]) * (x - s["bx"]) > 0
    return (F.abs(side_of) <= TOUCH_EPSILON) & ~outside & ~((y - s["ay"]) * (y - s["by"]) > 0)


def meets(a: dict[str, Column], b: dict[str, Column], seen: list[Column]) -> Column:
    """Do two sides meet: do they cross, or is an end of one on the other? ``seen`` are their :func:`turns`."""
    ends = [(b, "a", a), (b, "b", a), (a, "a", b), (a, "b", b)]
    touching = [_touches(own[f"{end}x"], own[f"{end}y"], other, t) for (own, end, other), t in zip(ends, seen)]
    return functools.reduce(lambda p, q: p | q, touching,
                            opposite(seen[0], seen[1], TOUCH_EPSILON) & opposite(seen[2], seen[3], TOUCH_EPSILON))


def squared_distance(x: Column, y: Column, s: dict[str, Column]) -> Column:
    """Squared distance of a point from a side, which may be a point itself."""
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["ax"]) * s["dx"] + (y - s["ay"]) * s["dy"]) / s["length"]))
    return F.pow(x - (s["ax"] + along * s["dx"]), F.lit(2)) + F.pow(y - (s["ay"] + along * s["dy"]), F.lit(2))


def end_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Least distance of an end of one side from the other side: their distance unless they cross."""
    return F.sqrt(F.least(squared_distance(a["ax"], a["ay"], b), squared_distance(a["bx"], a["by"], b),
                          squared_distance(b["ax"], b["ay"], a), squared_distance(b["bx"], b["by"], a)))


def with_distance(pairs: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    """Add the distance of two sides held under the prefixes ``a`` and ``b``: 0 when they meet.

    The turns become columns first: used in place they would be spelled out many times over in the
    generated code.
    """
    one, two = side_named(a), side_named(b)
    held = {f"_turn{i}": value for i, value in enumerate(turns(one, two))}
    staged = pairs.withColumns({**held, "_apart": end_distance(one, two)})
    meet = meets(one, two, [F.col(f"_turn{i}") for i in range(4)])
    return staged.withColumn(name, F.when(meet, F.lit(0.0)).otherwise(F.col("_apart"))).drop(*held, "_apart")


def envelope_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Lower bound of the distance of two sides."""
    gap_x = F.greatest(F.least(b["ax"], b["bx"]) - F.greatest(a["ax"], a["bx"]), F.least(a["ax"], a["bx"]) - F.greatest(b["ax"], b["bx"]))
    gap_y = F.greatest(F.least(b["ay"], b["by"]) - F.greatest(a["ay"], a["by"]), F.least(a["ay"], a["by"]) - F.greatest(b["ay"], b["by"]))
    return F.greatest(F.lit(0.0), gap_x, gap_y)
