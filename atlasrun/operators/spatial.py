"""Distances, clusters and views of boundary components on a map that wraps round.

A component row has ``location_id``, ``component_id`` (unique), ``pos`` (order in its location) and
``points``. :func:`component_table` adds the unwrapped, scaled boundary all other jobs use.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrays import let
from ..session import cut_lineage
from .graph import connected_components
from .grid import place

PLACE = ["location_id", "degenerate"]


def path_components(paths: DataFrame) -> DataFrame:
    """Components from path texts (``location_id, path_pos, path``): one for each sub-path, with its place.

    ``component_id`` names location, path and ring; ``pos`` orders a location's components by path and ring. A location is
    one group here, as its paths are one document.
    """
    rings = paths.select("location_id", "path_pos", F.posexplode(G.path_rings(F.col("path"))).alias("ring_pos", "points"))
    order = Window.partitionBy("location_id").orderBy("path_pos", "ring_pos")
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in ("location_id", "path_pos", "ring_pos")))
    return rings.select("location_id", "path_pos", "ring_pos", name.alias("component_id"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "points")


def component_table(components: DataFrame, *, width: float, scale: float, seam_x: float = 0.0,
                    threshold: float = G.SMALL_SPAN) -> DataFrame:
    """Unwrap every component at its own cut, shift it to the seam and scale it.

    Adds ``boundary``, ``centre``, ``radius`` (half the larger span), ``small`` and ``degenerate``.
    """
    world = F.lit(float(width))
    rows = components.withColumn("unwrapped", G.unwrap(F.col("points"), world))
    rows = rows.withColumn("boundary", F.transform("unwrapped", lambda p: G.point((p["x"] - seam_x) * scale, p["y"] * scale)))
    rows = rows.withColumn("_box", G.envelope(F.col("boundary")))
    radius = F.greatest(F.col("_box.max_x") - F.col("_box.min_x"), F.col("_box.max_y") - F.col("_box.min_y")) / 2
    return rows.withColumns({
        "centre": G.point((F.col("_box.min_x") + F.col("_box.max_x")) / 2, (F.col("_box.min_y") + F.col("_box.max_y")) / 2),
        "radius": radius, "small": radius * 2 < threshold, "degenerate": G.is_degenerate(F.col("boundary"))}).drop("_box")


def _sides(table: DataFrame, world: float, proximity: float) -> DataFrame:
    """Boundary sides of all components, and copies one world to the right where those could matter.

    A copy matters only if it still reaches the location's own extent. Left copies are not needed:
    a moved left against b is b moved right against a.
    """
    dot = F.array(F.struct(F.get("boundary", 0)["x"].alias("ax"), F.get("boundary", 0)["y"].alias("ay"),
                           F.get("boundary", 0)["x"].alias("bx"), F.get("boundary", 0)["y"].alias("by")))
    sides = F.when(F.col("degenerate"), dot).otherwise(G.boundary_segments(F.col("boundary")))
    home = table.select(*PLACE, "component_id", F.explode(sides).alias("s")).select(*PLACE, "component_id", "s.*")
    reach = table.groupBy("location_id").agg(
        F.max(F.array_max(G.xs(F.col("boundary")))).alias("_right"), F.min(F.array_min(G.xs(F.col("boundary")))).alias("_left"))
    wide = reach.where(F.col("_right") - F.col("_left") >= world - proximity)
    moved = (home.join(wide, "location_id").where(F.least("ax", "bx") + world - proximity <= F.col("_right"))
             .select(*PLACE, "component_id", (F.col("ax") + world).alias("ax"), "ay", (F.col("bx") + world).alias("bx"), "by",
                     F.lit(True).alias("moved")))
    return home.withColumn("moved", F.lit(False)).unionByName(moved)


SIDES = ("ax", "ay", "bx", "by")


def _measured(prefix: str) -> list:
    """Coordinates and measures of the row's side under a prefix."""
    return G.side_columns({c: F.col(c) for c in SIDES}, prefix)


#: Sides that a cell of a distance join may hold before it is cut, the parts of each of its edges then, and how often that is done at most.
BUSY, FAN, CUTS = 4096, 4, 8
_CELL = [*PLACE, "cx", "cy"]
_LEAF = [*_CELL, "level", "share_a", "share_b"]


def leaf_sides(sides: DataFrame, *, size: float, proximity: float, busy: int = BUSY) -> DataFrame:
    """Sides in the leaves of quad-trees, as deep as the counted load asks for: those that look for partners (``asks``) out to the proximity.

    The cells of the coarse grid are the roots. A cell with more than ``busy`` sides, some of which ask, is cut (two levels at a time), and sides move down
    within their cell only, so a round costs what its crowded cells hold. Cells narrower than the proximity would only multiply the asking sides, and cuts
    do not part long sides but multiply them: only cells are cut in which at least half of the sides are shorter than the new cells. Others that are crowded are dealt
    out in shares: each asking share meets each share of the others.
    """
    zero, pad = F.lit(0.0), F.when(F.col("asks"), float(proximity)).otherwise(0.0)
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    roles = F.explode(F.when(F.col("moved"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False))))
    rows, settled = place(sides.withColumn("asks", roles), F.lit(size), F.lit(size), zero, zero, pad), []
    for level in range(CUTS + 1):
        size /= FAN
        loads = rows.groupBy(*_CELL).agg(F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("asked"), F.count_if(extent < size).alias("short"))
        load, may = F.col("asking") + F.col("asked"), F.lit(level < CUTS and size >= proximity)
        crowded = cut_lineage(loads.where((F.col("asking") > 0) & (F.col("asked") > 0) & (load > busy)).select(
            *_CELL, "asking", "asked", (may & (F.col("short") * 2 >= load)).alias("cut")))
        rest = rows.withColumn("level", F.lit(level))
        if crowded.isEmpty():
            settled.append(rest.withColumns({"share_a": F.lit(0).cast("bigint"), "share_b": F.lit(0).cast("bigint")}))
            break
        settled.append(_shared_out(rest.join(crowded, _CELL, "left").where(~F.coalesce("cut", F.lit(False))), busy))
        keys = crowded.where("cut").select(*_CELL)
        if keys.isEmpty():
            break
        unit = F.lit(size)
        finer = place(rows.join(keys, _CELL, "left_semi"), unit, unit, zero, zero, pad, names=("_cx", "_cy"), within=("cx", "cy"), fan=FAN)
        rows = cut_lineage(finer.drop("cx", "cy").withColumnsRenamed({"_cx": "cx", "_cy": "cy"}))
    return functools.reduce(DataFrame.unionByName, settled)


def _shared_out(rows: DataFrame, busy: int) -> DataFrame:
    """Cells with ``asking`` and ``asked`` sides dealt out: a side is in one share of its own kind and meets all shares of the other."""
    def shares(load: str) -> Column:
        return F.coalesce(F.ceil(F.col(load) / busy), F.lit(1)).cast("bigint")

    own = F.pmod(F.xxhash64("component_id", "moved", *SIDES), F.when(F.col("asks"), shares("asking")).otherwise(shares("asked")))
    met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("asks"), shares("asked")).otherwise(shares("asking")) - 1))
    dealt = rows.withColumn("_own", own).withColumn("_met", met)
    return dealt.withColumns({"share_a": F.when(F.col("asks"), F.col("_own")).otherwise(F.col("_met")),
                              "share_b": F.when(F.col("asks"), F.col("_met")).otherwise(F.col("_own"))}).drop("_own", "_met", "asking", "asked", "cut")


def near_pairs(table: DataFrame, *, world: float, proximity: float, cell: float | None = None, busy: int = BUSY) -> DataFrame:
    """Pairs of components of a location whose boundaries come within ``proximity``, with the distance.

    The distance is the least over the world copies. Points are compared with points only. Sides are
    joined by the leaves of quad-trees over a grid, and the minimum per pair is taken on the map side before any shuffle.
    """
    size = cell or max(2.0 * proximity, world / 4096)
    leaves = leaf_sides(cut_lineage(_sides(table, world, proximity)), size=size, proximity=proximity, busy=busy)
    left = leaves.where("asks").select(*_LEAF, F.col("component_id").alias("a"), *_measured("a_"))
    right = leaves.where("not asks").select(*_LEAF, F.col("component_id").alias("b"), "moved", *_measured("b_"))
    # Unmoved pairs come up once, smaller id first; moved ones in both orders, which differ.
    once = (F.col("a") < F.col("b")) | (F.col("moved") & (F.col("a") != F.col("b")))
    close = G.envelope_gap(G.side_named("a_"), G.side_named("b_")) <= proximity
    # Sides and cells outgrow the size Spark estimates for them: never broadcast them.
    joined = G.with_distance(left.join(right.hint("merge"), _LEAF).where(once & close), "a_", "b_")
    # Filter after the minimum: a filter before it would be pushed into the join, distance and all.
    return (joined.groupBy("location_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.min("distance").alias("distance")).where(F.col("distance") <= proximity))


_CORNERS = ("west", "east", "south", "north")


def _cell_heads(placed: DataFrame, size: float) -> DataFrame:
    """Per cell the least and greatest component, and the outermost points of its sides within it, which are points of these sides whatever the rounding."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def crossing(start: str, step: Column, cell: str) -> tuple[Column, Column]:
        # A side along the other axis has no step; least and greatest pass over the nulls.
        near, far = ((F.col(cell) * size + edge - F.col(start)) / F.when(step != 0, step) for edge in (0.0, size))
        return F.least(near, far), F.greatest(near, far)

    (x_in, x_out), (y_in, y_out) = crossing("ax", dx, "cx"), crossing("ay", dy, "cy")
    zero, one = F.lit(0.0), F.lit(1.0)
    spans = placed.withColumns({"_in": F.least(F.greatest(zero, x_in, y_in), one), "_out": F.greatest(F.least(one, x_out, y_out), zero)})
    spans = spans.withColumns({f"_{axis}{end}": F.col(f"a{axis}") + F.col(end) * step for axis, step in (("x", dx), ("y", dy)) for end in ("_in", "_out")})
    by_x, by_y = ([F.struct(F.col(f"_{first}{end}").alias(first), F.col(f"_{second}{end}").alias(second)) for end in ("_in", "_out")]
                  for first, second in ("xy", "yx"))
    return spans.groupBy(*_CELL).agg(
        F.min("component_id").alias("head"), F.max("component_id").alias("last"), F.min(F.least(*by_x)).alias("west"),
        F.max(F.greatest(*by_x)).alias("east"), F.min(F.least(*by_y)).alias("south"), F.max(F.greatest(*by_y)).alias("north"))


def cell_pairs(heads: DataFrame, *, proximity: float, slack: float) -> DataFrame:
    """Neighbouring cells (``from_...`` and ``to_...``) by ``verdict``: ``near`` if two of their outermost points are within the proximity, ``open`` if only a look
    at their sides can tell. Cells whose boxes are further apart are left out, so are those of one head.
    """
    # The half of the cells around a cell that lie after it, up to two steps away.
    turns = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for dx in range(0, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)])
    around = heads.select(*_CELL, "head", *_CORNERS, F.explode(turns).alias("turn")).select(
        *PLACE, F.col("cx").alias("from_cx"), F.col("cy").alias("from_cy"), F.col("head").alias("from_head"), *(F.col(c).alias(f"from_{c}") for c in _CORNERS),
        (F.col("cx") + F.col("turn.dx")).alias("cx"), (F.col("cy") + F.col("turn.dy")).alias("cy"))
    others = heads.select(*_CELL, F.col("head").alias("to_head"), *(F.col(c).alias(f"to_{c}") for c in _CORNERS))
    pairs = around.join(others.hint("merge"), _CELL).where("from_head <> to_head").withColumnsRenamed({"cx": "to_cx", "cy": "to_cy"})

    def apart(low: str, high: str, axis: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"to_{low}.{axis}") - F.col(f"from_{high}.{axis}"), F.col(f"from_{low}.{axis}") - F.col(f"to_{high}.{axis}"))

    gap = F.hypot(apart("west", "east", "x"), apart("south", "north", "y"))
    nearest = F.least(*(F.hypot(F.col(f"from_{p}.x") - F.col(f"to_{q}.x"), F.col(f"from_{p}.y") - F.col(f"to_{q}.y")) for p in _CORNERS for q in _CORNERS))
    measured = pairs.withColumn("_gap", gap).where(F.col("_gap") <= proximity + slack)
    return measured.withColumn("verdict", F.when(nearest <= proximity - slack, "near").otherwise("open")).drop("_gap")


def _box(cell: str) -> dict[str, Column]:
    """The box around what a cell of a pair holds, as the coordinates of a side."""
    return {"ax": F.col(f"{cell}_west.x"), "ay": F.col(f"{cell}_south.y"), "bx": F.col(f"{cell}_east.x"), "by": F.col(f"{cell}_north.y")}


def proximity_links(table: DataFrame, *, world: float, proximity: float) -> DataFrame:
    """Edges that connect the same components as :func:`near_pairs`, but few of them.

    Cells are so small that any two sides in one are near each other, so each component is tied only
    to the cell's smallest one: a crowded cell gives one edge per component, not one per pair. Cells further apart are
    told near or far by their outermost points and boxes; where these do not tell, it is enough to know whether any side
    of one is near any side of the other, among those near the other's box. That is a semi-join, which stops at the first such side.
    """
    if proximity <= 0:
        return near_pairs(table, world=world, proximity=0.0).select("a", "b")
    # Smaller than half the diagonal allows by more than the grid's slack, so that also a side the
    # grid lists in a cell it just misses is within the proximity of the others there.
    size = proximity / math.sqrt(2) * (1 - 1e-6)
    slack = size * 1e-6 + world * 1e-12
    unit, none = F.lit(size), F.lit(0.0)
    placed = place(_sides(table, world, proximity), unit, unit, none, none, none).select(*_CELL, "component_id", *SIDES)
    heads = cut_lineage(_cell_heads(placed, size))
    shared = heads.where("head <> last").select(*_CELL, "head")
    to_head = placed.join(shared.hint("merge"), _CELL).where("component_id <> head").select(
        F.col("component_id").alias("a"), F.col("head").alias("b")).distinct()

    pairs = cut_lineage(cell_pairs(heads, proximity=proximity, slack=slack))
    told = pairs.where("verdict = 'near'").select(F.col("from_head").alias("a"), F.col("to_head").alias("b"))
    probe, other, match = open_sides(pairs, placed, proximity=proximity, slack=slack)
    # Sides that cross share the cell they cross in, so here only their ends can be near.
    reached = match & (G.end_distance(G.side_named("a_"), G.side_named("b_")) <= proximity)
    across = probe.join(other.hint("merge"), reached, "left_semi").select(F.col("from_head").alias("a"), F.col("to_head").alias("b"))
    return to_head.unionByName(told.unionByName(across).distinct())


def open_sides(pairs: DataFrame, placed: DataFrame, *, proximity: float, slack: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of the join that settles open pairs of cells, and which of their rows are held against each other."""
    lookout = placed.select(*PLACE, F.col("cx").alias("from_cx"), F.col("cy").alias("from_cy"), *_measured("a_"))
    probe = pairs.where("verdict = 'open'").join(lookout.hint("merge"), [*PLACE, "from_cx", "from_cy"])
    probe = probe.where(G.envelope_gap(G.side_named("a_"), _box("to")) <= proximity + slack)
    other = placed.select(F.col("location_id").alias("_place"), F.col("degenerate").alias("_kind"), "cx", "cy", *_measured("b_"))
    match = ((F.col("location_id") == F.col("_place")) & (F.col("degenerate") == F.col("_kind")) & (F.col("to_cx") == F.col("cx")) & (F.col("to_cy") == F.col("cy"))
             & (G.envelope_gap(G.side_named("b_"), _box("from")) <= proximity + slack))
    return probe, other, match


def clusters(table: DataFrame, *, world: float, proximity: float) -> DataFrame:
    """Cluster of every component: those reachable over boundaries within the proximity."""
    return _clusters(cut_lineage(table), world, proximity)


def _clusters(table: DataFrame, world: float, proximity: float) -> DataFrame:
    """The same for a table that is already written."""
    edges = proximity_links(table, world=world, proximity=proximity)
    labels = connected_components(table.select(F.col("component_id").alias("id")), edges)
    return table.select("location_id", "component_id", "pos").join(
        labels.withColumnRenamed("id", "component_id"), "component_id")


def all_small(table: DataFrame) -> DataFrame:
    """Components of the locations in which every component is small."""
    large = table.where(~F.col("small")).select("location_id").distinct()
    return table.join(large, "location_id", "left_anti")


def _align(x, anchor_x, world: float):
    """Move x by whole worlds to within half a world of the anchor."""
    off = x - anchor_x
    half = world / 2
    worlds = (F.when(off > half, F.ceil((off - half) / world)).when(-off > half, -F.ceil((-off - half) / world)).otherwise(0))
    return x - worlds * world


def cluster_members(table: DataFrame, *, world: float, proximity: float) -> DataFrame:
    """Members of each small location's main cluster: the one with its largest component."""
    small = cut_lineage(all_small(table))
    labelled = small.join(_clusters(small, world, proximity).select("component_id", "cluster"), "component_id")
    main = labelled.groupBy("location_id").agg(
        F.max_by(F.struct("cluster", "centre"), F.struct("radius", -F.col("pos"))).alias("_main"))
    return (labelled.join(main, "location_id").where(F.col("cluster") == F.col("_main.cluster"))
            .withColumn("anchor", F.col("_main.centre")).drop("_main"))


def cluster_summary(members: DataFrame, *, width: float, scale: float, seam_x: float = 0.0) -> DataFrame:
    """Envelope, centre and focus of each main cluster, in map units.

    Members across the seam are moved to the world copy of the largest component first.
    """
    world = width * scale
    aligned = members.withColumn("_x", F.transform(G.xs(F.col("boundary")), lambda x: _align(x, F.col("anchor.x"), world)))
    box = aligned.groupBy("location_id").agg(
        F.min(F.array_min("_x")).alias("x0"), F.max(F.array_max("_x")).alias("x1"),
        F.min(F.array_min(G.ys(F.col("boundary")))).alias("y0"), F.max(F.array_max(G.ys(F.col("boundary")))).alias("y1"),
        F.first("anchor").alias("anchor"), F.count_distinct("pos").alias("members"))

    def back(x):
        return x / scale + seam_x

    return box.select(
        "location_id", "members",
        back((F.col("x0") + F.col("x1")) / 2).alias("centre_x"), ((F.col("y0") + F.col("y1")) / 2 / scale).alias("centre_y"),
        back(F.col("anchor.x")).alias("focus_x"), (F.col("anchor.y") / scale).alias("focus_y"),
        back(F.col("x0")).alias("min_x"), (F.col("y0") / scale).alias("min_y"),
        back(F.col("x1")).alias("max_x"), (F.col("y1") / scale).alias("max_y"))


# Levels of the halving of the x axis; its finest cells number two to this power.
LEVELS = 14


def _halved(place: Column, times: Column) -> Column:
    return F.call_function("shiftright", place, times)


def _pieces(low: Column, high: Column) -> Column:
    """The aligned pieces (level and place) that make up a range of finest cells: at most two of each level, and none overlap."""
    def at(level: Column) -> Column:
        first = _halved(low + F.call_function("shiftleft", F.lit(1), level) - 1, level)
        last = _halved(high + 1, level) - 1
        return let(F.struct(first.alias("first"), last.alias("last")), lambda r: F.array(
            F.when((r["first"] <= r["last"]) & (r["first"] % 2 == 1), F.struct(level.alias("level"), r["first"].alias("place"))),
            F.when((r["first"] <= r["last"]) & (r["last"] % 2 == 0), F.struct(level.alias("level"), r["last"].alias("place")))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def _holders(cell: Column) -> Column:
    """The pieces that hold a finest cell, one of each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), _halved(cell, level).alias("place")))


def in_views(items: DataFrame, views: DataFrame, *, width: float) -> DataFrame:
    """Which world copies of the items (``min_x, max_x``) show in which views (``view_id, view_min, view_max``).

    Two ranges overlap if one begins in the other. So the begins of each side, as the pieces of a halved axis that hold them, meet the ranges of the other, cut into
    a logarithmic number of such pieces; a begin lies in just one of a range's pieces, so a pair comes up once. Wide ranges cost no more rows than narrow ones, and a
    piece is only crowded where there are as many results.
    """
    world, cells = float(width), 1 << LEVELS

    def cell(x: Column) -> Column:
        # Five worlds, from two left of the map on; what lies beyond is in the outermost cells.
        return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((x + 2 * world) / (5 * world) * cells))).cast("int")

    copies = items.withColumn("offset", F.explode(F.array(F.lit(0.0), F.lit(-world), F.lit(world))))
    copies = copies.withColumns({"_low": F.col("min_x") + F.col("offset"), "_high": F.col("max_x") + F.col("offset")})
    windows = views.select("view_id", "view_min", "view_max")
    begins = copies.withColumn("_at", F.explode(_holders(cell(F.col("_low"))))).join(
        windows.withColumn("_at", F.explode(_pieces(cell(F.col("view_min")), cell(F.col("view_max"))))), "_at").where(
        (F.col("_low") >= F.col("view_min")) & (F.col("_low") <= F.col("view_max")))
    covers = copies.withColumn("_at", F.explode(_pieces(cell(F.col("_low")), cell(F.col("_high"))))).join(
        windows.withColumn("_at", F.explode(_holders(cell(F.col("view_min"))))), "_at").where(
        (F.col("view_min") > F.col("_low")) & (F.col("view_min") <= F.col("_high")) & (F.col("view_min") <= F.col("view_max")))
    return begins.unionByName(covers).drop("_at", "_low", "_high")
