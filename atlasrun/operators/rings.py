"""Feature, polygon and ring jobs.

A feature row holds its polygons as ``array<array<array<struct<x, y>>>>``: polygons, rings, vertices.
Work on a ring stays in its row; only the crossing test spreads segments over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrays import let, rotate
from .grid import place

# Simplification tolerances (general, overview map, detail map).
DEFAULT_TOLERANCE = 0.12
MAP_TOLERANCE = 0.55
DETAIL_TOLERANCE = 0.05
# Segments in a cell above which the cell is split further.
BUSY_CELL = 64


def explode_polygons(features: DataFrame) -> DataFrame:
    """One row per polygon with a stable id; every polygon after the first is an island."""
    keep = [c for c in features.columns if c != "polygons"]
    rows = features.select(*keep, F.posexplode("polygons").alias("polygon_pos", "rings"))
    return rows.withColumns({
        "polygon_id": F.concat_ws(":", "feature_id", F.lit("polygon"), F.col("polygon_pos").cast("string")),
        "island": F.col("polygon_pos") > 0})


def explode_rings(features: DataFrame) -> DataFrame:
    """One row per ring: id, role, the exterior ring an interior one lies in, and its vertices."""
    polygons = explode_polygons(features)
    keep = [c for c in polygons.columns if c != "rings"]
    rows = polygons.select(*keep, F.posexplode("rings").alias("ring_pos", "ring"))
    inner = F.col("ring_pos") > 0
    ring_id = F.concat_ws(":", "polygon_id", F.lit("ring"), F.col("ring_pos").cast("string"))
    return rows.withColumns({
        "ring_id": ring_id,
        "role": F.when(inner, "interior").otherwise("exterior"),
        "parent_ring_id": F.when(inner, F.concat(F.col("polygon_id"), F.lit(":ring:0")))})


def explode_parts(features: DataFrame) -> DataFrame:
    """Rings numbered through the whole feature, with part ids; no shuffle.

    The rings of all polygons become one list, so a ring's place in it is its number.
    """
    flat = F.flatten(F.transform("polygons", lambda polygon, i: F.transform(polygon, lambda ring, j: F.struct(
        i.alias("polygon_pos"), j.alias("ring_pos"), ring.alias("ring")))))
    keep = [c for c in features.columns if c != "polygons"]
    rings = features.select(*keep, F.posexplode(flat).alias("part_pos", "_ring")).select(
        *keep, F.concat_ws(":", "feature_id", F.lit("polygon"), F.col("_ring.polygon_pos").cast("string")).alias("polygon_id"),
        "_ring.polygon_pos", "_ring.ring_pos", "_ring.ring", "part_pos")
    return rings.withColumn("part_id", F.concat_ws(":", "feature_id", F.lit("part"), F.col("part_pos").cast("string")))


# --- simplification --------------------------------------------------------------------------

def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[bool]:
    """Which vertices Douglas-Peucker keeps; a stack of index ranges instead of recursion."""
    count = len(x)
    keep = np.zeros(count, dtype=bool)
    if count < 3:
        keep[:] = True
        return keep.tolist()
    keep[0] = keep[-1] = True
    open_ranges = [(0, count - 1)]
    while open_ranges:
        first, last = open_ranges.pop()
        if last - first < 2:
            continue
        px, py = x[first + 1:last], y[first + 1:last]
        dx, dy = x[last] - x[first], y[last] - y[first]
        if dx or dy:
            along = np.clip(((px - x[first]) * dx + (py - y[first]) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
            far = (px - (x[first] + along * dx)) ** 2 + (py - (y[first] + along * dy)) ** 2
        else:
            far = (px - x[first]) ** 2 + (py - y[first]) ** 2
        at = int(np.argmax(far))
        if far[at] > tolerance ** 2:
            middle = first + 1 + at
            keep[middle] = True
            open_ranges += [(first, middle), (middle, last)]
    return keep.tolist()


def _keep_mask(tolerance: float):
    def mask(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_kept(np.asarray(a, dtype=float), np.asarray(b, dtype=float), tolerance) for a, b in zip(x, y)])

    mask.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(mask, "array<boolean>")


def simplify(rings: DataFrame, tolerance: float = DEFAULT_TOLERANCE, column: str = "ring") -> DataFrame:
    """Replace each ring by its Douglas-Peucker simplification; first and last vertex stay."""
    masked = rings.withColumn("_keep", _keep_mask(tolerance)(G.xs(F.col(column)), G.ys(F.col(column))))
    return masked.withColumn(column, F.filter(column, lambda p, i: F.get(F.col("_keep"), i))).drop("_keep")


# --- validity --------------------------------------------------------------------------------

def _cyclic_segments(points: Column) -> Column:
    pairs = F.zip_with(points, rotate(points), lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.transform(pairs, lambda s, i: F.struct(i.alias("i"), s.alias("s")))


def self_crossing(rings: DataFrame, keys: list[str], points: str = "points", busy: int = BUSY_CELL) -> DataFrame:
    """Keys of the rings in which two non-adjacent sides cross properly.

    Each ring has its own grid of about as many cells as sides; sides meet only within a cell, and a
    cell with many sides is split again by a finer grid, so crowded stretches stay cheap. The
    semi-join stops at the first crossing of a side and emits no pairs.
    """
    usable = rings.select(*keys, F.col(points).alias("points")).where(
        (F.size("points") > 3) & G.is_finite(F.col("points")))
    box = G.envelope(F.col("points"))
    framed = usable.withColumns({"box": box, "n": F.size("points")})
    parts = F.greatest(F.lit(1.0), F.floor(F.sqrt("n")).cast("double"))

    def side(low: str, high: str) -> Column:
        length = F.col(f"box.{high}") - F.col(f"box.{low}")
        return F.when(length > 0, length / parts).otherwise(1.0)

    framed = framed.withColumns({"w": side("min_x", "max_x"), "h": side("min_y", "max_y")})
    sides = framed.select(*keys, "n", "w", "h", F.col("box.min_x").alias("ox"), F.col("box.min_y").alias("oy"),
                          F.explode(_cyclic_segments(F.col("points"))).alias("side"))
    sides = sides.select(*keys, "n", "w", "h", "ox", "oy", F.col("side.i").alias("i"), "side.s.*")
    placed = place(sides, F.col("w"), F.col("h"), F.col("ox"), F.col("oy"), F.lit(0.0))
    # Crowded cells get a finer grid of their own; the others keep one sub-cell.
    crowd = placed.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("crowd"))
    placed = placed.join(crowd, [*keys, "cx", "cy"]).withColumn(
        "split", F.when(F.col("crowd") > busy, F.ceil(F.sqrt(F.col("crowd") / 8.0)).cast("double")).otherwise(1.0))
    placed = place(placed.withColumns({"w": F.col("w") / F.col("split"), "h": F.col("h") / F.col("split"),
                                       "ox": F.col("ox") + F.col("cx") * F.col("w"), "oy": F.col("oy") + F.col("cy") * F.col("h")}),
                   F.col("w"), F.col("h"), F.col("ox"), F.col("oy"), F.lit(0.0), names=("sx", "sy"), limit=F.col("split"))
    cell = ["cx", "cy", "sx", "sy"]
    measured = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    left = placed.select(*keys, *cell, "n", "i", *G.side_columns(measured, "a_"))
    right = placed.select(*[F.col(k).alias(f"_{k}") for k in [*keys, *cell]], F.col("i").alias("j"),
                          *G.side_columns(measured, "b_"))
    condition = (F.col("i") < F.col("j") - 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 1))
    for key in [*keys, *cell]:
        condition = condition & (F.col(key) == F.col(f"_{key}"))
    condition = condition & G.crosses(G.side_named("a_"), G.side_named("b_"))
    # Sides outgrow the size Spark estimates for them, so the join must not be a broadcast one.
    return left.join(right.hint("merge"), condition, "left_semi").select(*keys).distinct()


def ring_flags(rings: DataFrame, width: float = G.MAP_WIDTH, height: float = G.MAP_HEIGHT) -> DataFrame:
    """Validity of every ring in source and in map coordinates.

    Adds ``cleaned`` and ``projected`` vertices, ``vertex_count``, ``source_closed``, ``source_valid``,
    ``projected_valid``, ``induced_degenerate`` (valid only before projection), ``area`` and ``valid``.
    """
    rows = rings.withColumn("cleaned", G.clean_ring(F.col("ring")))
    rows = rows.withColumn("projected", F.transform("cleaned", lambda p: G.project(p, width, height)))

    def base(points: str) -> tuple[Column, Column]:
        finite = G.is_finite(F.col(points))
        area = F.when(finite & (F.size(points) >= 3), G.signed_area(F.col(points))).otherwise(0.0)
        return finite & (F.size(points) >= 3), area

    spaces = F.array(F.struct(F.lit("source").alias("space"), F.col("cleaned").alias("points")),
                     F.struct(F.lit("map").alias("space"), F.col("projected").alias("points")))
    both = rows.select("ring_id", F.explode(spaces).alias("_in")).select("ring_id", "_in.*")
    crossed = self_crossing(both, ["ring_id", "space"]).groupBy("ring_id").agg(
        F.bool_or(F.col("space") == "source").alias("_source_crosses"), F.bool_or(F.col("space") == "map").alias("_map_crosses"))
    source_shape, source_area = base("cleaned")
    map_shape, map_area = base("projected")
    rows = rows.withColumns({"source_closed": G.is_closed(F.col("ring")), "_source_ok": source_shape,
                             "_source_area": source_area, "_map_ok": map_shape, "area": map_area})
    rows = rows.join(crossed, "ring_id", "left")
    no = F.lit(False)
    source_valid = (F.col("source_closed") & F.col("_source_ok") & (F.abs("_source_area") > G.EPSILON)
                    & ~F.coalesce("_source_crosses", no))
    map_valid = F.col("_map_ok") & (F.abs("area") > G.EPSILON) & ~F.coalesce("_map_crosses", no)
    rows = rows.withColumns({"vertex_count": F.size("cleaned"), "source_valid": source_valid, "projected_valid": map_valid})
    return rows.withColumns({"induced_degenerate": F.col("source_valid") & ~F.col("projected_valid"),
                             "valid": F.col("source_valid") & F.col("projected_valid")}).drop(
        "_source_crosses", "_map_crosses", "_source_ok", "_source_area", "_map_ok")


def ring_counters(flags: DataFrame) -> DataFrame:
    """Counts of rings, rings invalid in the source and rings spoilt by projection."""
    return flags.agg(F.count(F.lit(1)).alias("rings"), F.count_if(~F.col("source_valid")).alias("source_invalid"),
                     F.count_if(F.col("induced_degenerate")).alias("induced_degenerate"))


def polygon_classes(flags: DataFrame) -> DataFrame:
    """Class and shape of every polygon from its flagged rings.

    A polygon with an invalid ring is an ``artifact``; one with a valid ring of some area is a
    ``polygon``; any other is ``degenerate``. Shape measures come from the exterior ring if that is
    valid, else from the first valid ring, else from the first ring. Everything is an aggregate that
    combines on the map side; path texts go to :func:`polygon_paths`.
    """
    keep = [c for c in ("feature_id", "polygon_id", "polygon_pos") if c in flags.columns]
    shows = F.col("valid") & G.has_area(F.col("projected"))
    measured = flags.withColumns({
        "_shows": shows,
        "_rank": F.when(shows & (F.col("role") == "exterior"), 0).when(shows, 1).otherwise(2),
        "_shape": F.struct(G.centroid(F.col("projected")).alias("centre"), G.span(F.col("projected")).alias("span"),
                           F.abs(G.signed_area(F.col("projected"))).alias("area"))})
    grouped = measured.groupBy(*keep).agg(
        F.bool_or(~F.col("valid")).alias("_bad"), F.bool_or("_shows").alias("_good"),
        F.count(F.lit(1)).alias("rings"), F.count_if(F.col("_shows")).alias("shown_rings"),
        F.min_by("_shape", F.struct("_rank", "ring_pos")).alias("_shape"))
    kind = F.when(F.col("_bad"), "artifact").when(F.col("_good"), "polygon").otherwise("degenerate")
    return grouped.select(*keep, kind.alias("kind"), "rings", "shown_rings", F.col("_shape.centre").alias("centre"),
                          F.col("_shape.span").alias("span"), F.col("_shape.area").alias("area"))


def polygon_paths(flags: DataFrame) -> DataFrame:
    """Ring paths to draw for each polygon, in order: the valid ones with area, else all of them."""
    shows = F.col("valid") & G.has_area(F.col("projected"))
    rows = flags.withColumns({"_shows": shows, "path": G.path_text(F.col("projected"))})
    any_shown = rows.groupBy("polygon_id").agg(F.bool_or("_shows").alias("_any"))
    return (rows.join(any_shown, "polygon_id").where(F.col("_shows") | ~F.col("_any"))
            .select("polygon_id", "ring_pos", "ring_id", "path"))


def tiny_features(polygons: DataFrame, key: str, scale: float, threshold: float = G.DOT_SIZE) -> DataFrame:
    """Features whose largest polygon is too small to draw: centre and size of the dot to show.

    The first polygon wins among equal areas. No feature has a dot at a scale of zero or less.
    """
    if scale <= 0:
        return polygons.where(F.lit(False)).select(key, F.col("centre"), F.lit(float(threshold)).alias("diameter"))
    largest = (polygons.where(F.col("kind") == "polygon").groupBy(key)
               .agg(F.max_by(F.struct("span", "centre"), F.struct("area", -F.col("polygon_pos"))).alias("largest")))
    narrow = F.least("largest.span.x", "largest.span.y") * scale < threshold
    return largest.where(narrow).select(key, F.col("largest.centre").alias("centre"), F.lit(float(threshold)).alias("diameter"))


# --- feature build ---------------------------------------------------------------------------

def build_parts(features: DataFrame, tolerance: float = MAP_TOLERANCE) -> DataFrame:
    """Projected and simplified parts of every feature: path, mean anchor and envelope."""
    parts = explode_parts(features)
    parts = parts.withColumn("ring", F.transform("ring", lambda p: G.project_rounded(p)))
    parts = simplify(parts, tolerance)
    return parts.withColumns({"path": G.path_text(F.col("ring")), "anchor": G.mean_point(F.col("ring")),
                              "bounds": G.envelope(F.col("ring"))})


def build_features(features: DataFrame, parts: DataFrame) -> DataFrame:
    """Envelope and anchor of every feature from its parts."""
    joined = parts.groupBy("feature_id").agg(
        F.struct(F.min("bounds.min_x").alias("min_x"), F.min("bounds.min_y").alias("min_y"),
                 F.max("bounds.max_x").alias("max_x"), F.max("bounds.max_y").alias("max_y")).alias("bounds"),
        F.count(F.lit(1)).alias("parts"))
    keep = [c for c in features.columns if c not in ("polygons", "label_x", "label_y")]
    return features.select(*keep, "label_x", "label_y").join(joined, "feature_id").select(
        *keep, G.anchor(F.col("label_x"), F.col("label_y"), F.col("bounds")).alias("anchor"), "bounds", "parts")


def cyclic_next(vertices: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Next vertex of each vertex of a ring table, the last one joined to the first.

    Neighbours are found by an equi-join on the vertex number, so a ring of any length is spread
    over many tasks; ``order`` runs from 0 without holes.
    """
    sizes = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    following = vertices.select(*keys, F.col(order).alias("_next"), F.col("x").alias("next_x"), F.col("y").alias("next_y"))
    placed = vertices.join(sizes, keys).withColumn("_next", (F.col(order) + 1) % F.col("_n"))
    return placed.join(following, [*keys, "_next"]).drop("_next", "_n")


def ring_from_vertices(points: Column) -> Column:
    """Close an open vertex list."""
    return let(points, lambda r: F.concat(r, F.slice(r, 1, 1)))
