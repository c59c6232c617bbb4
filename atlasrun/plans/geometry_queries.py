"""Registered queries over rings, polygons, components and views of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numbers import fixed2_sql, number_text
from ..operators import rings, spatial
from ..sources import boundaries
from .registry import query, with_views
from .views import BOUNDARY_VERTICES, COMPONENT_VERTICES, POINTS, RAW_VERTICES, STAR_VERTICES, Tables

WIDTH = 360.0
SCALE = 4.0
PROXIMITY = 4.0
WORLD = WIDTH * SCALE


def _r(value, places: int = 6):
    return F.round(value, places)


_X, _Y = "((lon + 180.0::DOUBLE) / 360.0 * 1440.0)", "((90.0::DOUBLE - lat) / 180.0 * 720.0)"


@query("project_points", with_views(POINTS, body=f"""
SELECT point_id, {_X} AS x, {_Y} AS y, {fixed2_sql(_X)} AS x2, {fixed2_sql(_Y)} AS y2 FROM points"""))
def project_points(t: Tables) -> DataFrame:
    place = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    exact, rounded = G.project(place), G.project_rounded(place)
    return t.points.select("point_id", exact["x"].alias("x"), exact["y"].alias("y"), rounded["x"].alias("x2"), rounded["y"].alias("y2"))


@query("project_parallel", with_views(POINTS, body=f"""
SELECT point_id, round(182.5::DOUBLE + ({_Y} - 182.5::DOUBLE) * (1.0 / cos((point_id % 80) * pi() / 180.0)), 6) AS y FROM points"""))
def project_parallel(t: Tables) -> DataFrame:
    return t.points.select("point_id", _r(G.standard_parallel_y(
        G.map_y(F.col("lat")), F.col("point_id") % 80, F.lit(182.5))).alias("y"))


@query("ring_envelope", with_views(RAW_VERTICES, body="""
SELECT label, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(DISTINCT ring_id) AS rings FROM raw_vertices GROUP BY label"""))
def ring_envelope(t: Tables) -> DataFrame:
    """Union of ring envelopes per group."""
    boxed = t.rings.select("label", G.envelope(F.col("ring")).alias("b"))
    return boxed.groupBy("label").agg(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"),
                                      F.max("b.max_y").alias("max_y"), F.count(F.lit(1)).alias("rings"))


def _shapes_sql(vertices: str, key: str = "ring_id") -> str:
    """Area, centroid and span of open vertex lists."""
    return f"""stepped AS (
  SELECT {key}, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
  FROM {vertices} WINDOW w AS (PARTITION BY {key} ORDER BY i)),
shapes AS (
  SELECT {key}, sum(x * ny - nx * y) / 2 AS area, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my,
         min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM stepped GROUP BY {key})"""


@query("ring_shape", with_views(RAW_VERTICES, STAR_VERTICES, _shapes_sql("star_vertices"), body="""
SELECT ring_id, round(area, 6) AS area, abs(area) > 2.220446049250313e-16 AS has_area, round(mx / (6 * area), 6) AS centre_x,
       round(my / (6 * area), 6) AS centre_y, round(max_x - min_x, 6) AS span_x, round(max_y - min_y, 6) AS span_y FROM shapes"""))
def ring_shape(t: Tables) -> DataFrame:
    """Signed area, centroid and span of every ring."""
    rows = t.star_rings.select("ring_id", G.clean_ring(F.col("ring")).alias("p"))
    rows = rows.select("ring_id", G.signed_area(F.col("p")).alias("area"), G.centroid(F.col("p")).alias("c"), G.span(F.col("p")).alias("s"))
    return rows.select("ring_id", _r("area").alias("area"), (F.abs("area") > G.EPSILON).alias("has_area"), _r("c.x").alias("centre_x"),
                       _r("c.y").alias("centre_y"), _r("s.x").alias("span_x"), _r("s.y").alias("span_y"))


@query("ring_anchor", with_views(RAW_VERTICES, body=f"""
SELECT ring_id, {fixed2_sql('mx')} AS x, {fixed2_sql('my')} AS y FROM (
  SELECT ring_id, list_reduce(list(x ORDER BY i), lambda a, b: a + b) / 32 AS mx, list_reduce(list(y ORDER BY i), lambda a, b: a + b) / 32 AS my
  FROM raw_vertices GROUP BY ring_id)"""))
def ring_anchor(t: Tables) -> DataFrame:
    """Rounded vertex mean of every ring."""
    return t.raw_rings.select("ring_id", G.mean_point(F.col("points")).alias("m")).select("ring_id", "m.x", "m.y")


@query("ring_clean", with_views(RAW_VERTICES, """snapped AS (
  SELECT ring_id, i, floor(x / 45) * 45 AS x, floor(y / 45) * 45 AS y FROM raw_vertices
  UNION ALL SELECT ring_id, 32, floor(x / 45) * 45, floor(y / 45) * 45 FROM raw_vertices WHERE i = 0),
kept AS (SELECT ring_id, i, x, y FROM (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM snapped WINDOW w AS (PARTITION BY ring_id ORDER BY i))
  WHERE px IS NULL OR px <> x OR py <> y)""", body="""
SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY i) - 1 AS i, x, y FROM (
  SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ring_id) AS n
  FROM kept WINDOW w AS (PARTITION BY ring_id ORDER BY i)) WHERE NOT (n > 1 AND rn = n AND fx = x AND fy = y)"""))
def ring_clean(t: Tables) -> DataFrame:
    """Rings snapped to a coarse grid, without repeated and closing vertices."""
    snapped = t.rings.select("ring_id", F.transform("ring", lambda p: F.struct(
        (F.floor(p["x"] / 45) * 45).cast("double").alias("x"), (F.floor(p["y"] / 45) * 45).cast("double").alias("y"))).alias("ring"))
    return snapped.select("ring_id", F.posexplode(G.clean_ring(F.col("ring"))).alias("i", "p")).select(
        "ring_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y")


@query("ring_segments", with_views(RAW_VERTICES, body="""
SELECT ring_id, i, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS next_x, coalesce(lead(y) OVER w, first_value(y) OVER w) AS next_y
FROM raw_vertices WINDOW w AS (PARTITION BY ring_id ORDER BY i)"""))
def ring_segments(t: Tables) -> DataFrame:
    """Cyclic neighbour of every vertex of a vertex table."""
    vertices = t.raw_rings.select("ring_id", F.posexplode("points").alias("i", "p")).select(
        "ring_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y")
    return rings.cyclic_next(vertices, ["ring_id"], "i")


_TEXT = "regexp_replace(({})::VARCHAR, '\\.0$', '')"


_POWERS = ", ".join(f"1e{k}" for k in range(-30, 19))


@query("number_texts", f"""
SELECT l_orderkey, l_linenumber, v AS value, v AS read_back, true AS plain, true AS short FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END
         * (l_extendedprice::DOUBLE * ([{_POWERS}])[(l_orderkey * 7 + l_linenumber) % 49 + 1]::DOUBLE) AS v FROM lineitem)""")
def number_texts(t: Tables) -> DataFrame:
    """Texts of numbers from 1e-28 to 1e23, read back: plain notation without loss or idle zeros."""
    power = F.element_at(F.array(*(F.lit(float(p)) for p in _POWERS.split(", "))), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 49 + 1).cast("int"))
    value = F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0) * (F.col("l_extendedprice").cast("double") * power)
    texts = t.read("lineitem").select("l_orderkey", "l_linenumber", value.alias("value")).withColumn("text", number_text(F.col("value")))
    return texts.select("l_orderkey", "l_linenumber", "value", F.col("text").cast("double").alias("read_back"),
                        F.col("text").rlike(r"^-?\d+(\.\d*[1-9])?$").alias("plain"), (~F.col("text").rlike(r"^-?0\d")).alias("short"))


@query("project_faulty", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'nan' WHEN l_orderkey % 11 = 0 THEN 'inf' WHEN l_orderkey % 13 = 0 THEN 'large' ELSE 'rounded' END AS kind,
       true AS near, true AS hundredths FROM lineitem""")
def project_faulty(t: Tables) -> DataFrame:
    """Projected and rounded longitudes with faults worked in: faults stay faults, the rest is at most half a hundredth off."""
    key = F.col("l_orderkey")
    x = (F.when(key % 7 == 0, float("nan")).when(key % 11 == 0, float("inf")).when(key % 13 == 0, 1e22 + F.col("l_extendedprice").cast("double") * 1e15)
         .otherwise(F.col("l_extendedprice").cast("double") / (F.col("l_quantity").cast("double") * 17)))
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", G.map_x(x).alias("x"), G.project_rounded(G.point(x, F.lit(0.0)))["x"].alias("r"))
    whole = F.abs(F.col("x")) < 1e15
    kind = F.when(F.isnan("r"), "nan").when(F.abs(F.col("r")) == float("inf"), "inf").when(~whole, "large").otherwise("rounded")
    near = F.when(whole, F.abs(F.col("r") - F.col("x")) <= 0.005 + 1e-9).otherwise(F.col("r") == F.col("x"))
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind"), near.alias("near"),
                       F.when(whole, F.abs(F.col("r") * 100 - F.rint(F.col("r") * 100)) < 1e-6).otherwise(F.lit(True)).alias("hundredths"))


@query("path_text", with_views(RAW_VERTICES, body=f"""
SELECT ring_id, 'M' || string_agg({_TEXT.format(fixed2_sql('((x + 180.0::DOUBLE) / 360.0 * 1440.0)'))} || ',' ||
       {_TEXT.format(fixed2_sql('((90.0::DOUBLE - y) / 180.0 * 720.0)'))}, 'L' ORDER BY i) || 'Z' AS path
FROM raw_vertices GROUP BY ring_id"""))
def path_text(t: Tables) -> DataFrame:
    projected = F.transform("points", lambda p: G.project_rounded(p))
    return t.raw_rings.select("ring_id", G.path_text(projected).alias("path"))


@query("path_parse", with_views(RAW_VERTICES, body=f"""
SELECT ring_id, c AS sub_path, i, {fixed2_sql('(((x + 180.0::DOUBLE) / 360.0 * 1440.0) + c * 40)')} AS x,
       {fixed2_sql('((90.0::DOUBLE - y) / 180.0 * 720.0)')} AS y
FROM raw_vertices, (SELECT unnest(range(2)) AS c)"""))
def path_parse(t: Tables) -> DataFrame:
    """Vertices read back from path texts of two sub-paths each."""
    def path(shift: int):
        return G.path_text(F.transform("points", lambda p: G.point(
            G.fixed2(G.map_x(p["x"]) + shift * 40), G.fixed2(G.map_y(p["y"])))))

    texts = t.raw_rings.select("ring_id", F.concat(path(0), F.lit(" "), path(1)).alias("text"))
    return (texts.select("ring_id", F.posexplode(G.path_rings(F.col("text"))).alias("sub_path", "points"))
            .select("ring_id", F.col("sub_path").cast("bigint").alias("sub_path"), F.posexplode("points").alias("i", "p"))
            .select("ring_id", "sub_path", F.col("i").cast("bigint").alias("i"), "p.x", "p.y"))


@query("geojson_vertices", with_views(RAW_VERTICES, BOUNDARY_VERTICES, body="""
SELECT ring_id, i, x, y FROM boundary_vertices WHERE split_part(feature_id, ':', 2)::BIGINT % 2 = 0 OR polygon_pos = 0"""))
def geojson_vertices(t: Tables) -> DataFrame:
    """Boundary documents parsed from text: every other feature has one polygon, the rest are multipolygons."""
    pairs = F.transform("polygons", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    single = F.col("feature_pos") % 2 == 1
    texts = t.boundary_features.select(
        "feature_id", F.when(single, "Polygon").otherwise("MultiPolygon").alias("type"),
        F.when(single, F.to_json(pairs[0])).otherwise(F.to_json(pairs)).alias("coordinates"))
    parsed = texts.select("feature_id", boundaries.polygons_from(F.col("type"), F.col("coordinates")).alias("polygons"))
    return (rings.explode_rings(parsed).select("ring_id", F.posexplode("ring").alias("i", "p"))
            .select("ring_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y"))


@query("ring_roles", with_views(RAW_VERTICES, BOUNDARY_VERTICES, body="""
SELECT feature_id, polygon_id, ring_id, polygon_pos > 0 AS island, CASE WHEN ring_pos = 0 THEN 'exterior' ELSE 'interior' END AS role,
       CASE WHEN ring_pos > 0 THEN polygon_id || ':ring:0' END AS parent_ring_id, count(*) AS vertices
FROM boundary_vertices GROUP BY ALL"""))
def ring_roles(t: Tables) -> DataFrame:
    """Nested features as one row per ring."""
    return rings.explode_rings(t.boundary_features).select(
        "feature_id", "polygon_id", "ring_id", "island", "role", "parent_ring_id", F.size("ring").cast("bigint").alias("vertices"))


@query("part_vertices", with_views(RAW_VERTICES, BOUNDARY_VERTICES, body="""
SELECT feature_id, feature_id || ':part:' || part_pos AS part_id, i, x, y FROM boundary_vertices"""))
def part_vertices(t: Tables) -> DataFrame:
    """Nested features as one row per vertex, with part ids."""
    return (rings.explode_parts(t.boundary_features).select("feature_id", "part_id", F.posexplode("ring").alias("i", "p"))
            .select("feature_id", "part_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y"))


# --- segments --------------------------------------------------------------------------------

def _turn(a: str, b: str, c: str) -> str:
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _on(p: str, a: str, b: str) -> str:
    """Is p on the side a-b: no farther from the ends than they are from each other, along either axis, and on its line?"""
    spread = " AND ".join(f"abs({p}{k} - {a}{k}) + abs({p}{k} - {b}{k}) <= abs({a}{k} - {b}{k}) + 1e-12::DOUBLE" for k in "xy")
    return f"(abs({_turn(a, b, p)}) <= 1e-9::DOUBLE AND {spread})"


def _apart(p: str, a: str, b: str) -> str:
    dx, dy = f"({b}x - {a}x)", f"({b}y - {a}y)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    k = f"(CASE WHEN {length} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({p}x - {a}x) * {dx} + ({p}y - {a}y) * {dy}) / {length})) END)"
    return f"sqrt(({p}x - ({a}x + {k} * {dx})) ** 2 + ({p}y - ({a}y + {k} * {dy})) ** 2)"


def segment_distance_sql() -> str:
    """Distance of the segments a-b and c-d given as columns ax, ay, ex, ey, cx, cy, dx, dy."""
    def apart(a: str, b: str, p: str, q: str) -> str:
        """Are p and q on two sides of the line a-b, both beyond the slack?"""
        one, two = _turn(a, b, p), _turn(a, b, q)
        return f"(least({one}, {two}) < -1e-9::DOUBLE AND greatest({one}, {two}) > 1e-9::DOUBLE)"

    meets = (f"(({apart('a', 'e', 'c', 'd')} AND {apart('c', 'd', 'a', 'e')}) OR {_on('c', 'a', 'e')} OR {_on('d', 'a', 'e')}"
             f" OR {_on('a', 'c', 'd')} OR {_on('e', 'c', 'd')})")
    return (f"(CASE WHEN {meets} THEN 0.0::DOUBLE ELSE least({_apart('a', 'c', 'd')}, {_apart('e', 'c', 'd')}, "
            f"{_apart('c', 'a', 'e')}, {_apart('d', 'a', 'e')}) END)")


_SIDES = """sides AS (
  SELECT ring_id, i, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey
  FROM {vertices} WINDOW w AS (PARTITION BY ring_id ORDER BY i))"""


@query("seg_distance", with_views(RAW_VERTICES, _SIDES.format(vertices="raw_vertices"), body=f"""
SELECT ring_id, i, round({segment_distance_sql()}, 6) AS distance
FROM (SELECT s.ring_id, s.i, s.ax, s.ay, s.ex, s.ey, o.ax AS cx, o.ay AS cy, o.ex AS dx, o.ey AS dy
      FROM sides s JOIN sides o ON o.ring_id = s.ring_id + 1 AND o.i = s.i)"""))
def seg_distance(t: Tables) -> DataFrame:
    """Distance of each ring side from the matching side of the next ring."""
    sides = t.raw_rings.select("ring_id", F.posexplode(G.boundary_segments(F.col("points"))).alias("i", "s"))
    mine = sides.select("ring_id", "i", *G.side_columns(F.col("s"), "a_"))
    other = sides.select((F.col("ring_id") - 1).alias("ring_id"), "i", *G.side_columns(F.col("s"), "b_"))
    return G.with_distance(mine.join(other, ["ring_id", "i"]), "a_", "b_").select(
        "ring_id", F.col("i").cast("bigint").alias("i"), _r("distance").alias("distance"))


def _side_sign(turn: str) -> str:
    return f"(CASE WHEN abs({turn}) < 2.220446049250313e-16 THEN 0 WHEN {turn} > 0 THEN 1 ELSE -1 END)"


def _crossing_sql(sides: str, key: str = "ring_id") -> str:
    """Rings of a table of sides (key, i, n, ax, ay, ex, ey) with a proper crossing."""
    return f"""SELECT DISTINCT {key} FROM (
  SELECT s.{key}, s.ax, s.ay, s.ex, s.ey, o.ax AS cx, o.ay AS cy, o.ex AS dx, o.ey AS dy
  FROM {sides} s JOIN {sides} o ON s.{key} = o.{key} AND s.i < o.i - 1 AND NOT (s.i = 0 AND o.i = s.n - 1))
WHERE {_side_sign(_turn('a', 'e', 'c'))} * {_side_sign(_turn('a', 'e', 'd'))} < 0
  AND {_side_sign(_turn('c', 'd', 'a'))} * {_side_sign(_turn('c', 'd', 'e'))} < 0"""


@query("self_crossing", with_views(RAW_VERTICES, STAR_VERTICES, """both_rings AS (
  SELECT 'r' || ring_id AS ring_id, i, x, y FROM raw_vertices UNION ALL SELECT 's' || ring_id, i, x, y FROM star_vertices)""",
    _SIDES.format(vertices="both_rings"), "counted AS (SELECT *, 32 AS n FROM sides)", body=_crossing_sql("counted")))
def self_crossing(t: Tables) -> DataFrame:
    """Rings with properly crossing sides, in vertex order and in angle order."""
    both = (t.rings.select(F.concat(F.lit("r"), "ring_id").alias("ring_id"), "ring")
            .unionByName(t.star_rings.select(F.concat(F.lit("s"), "ring_id").alias("ring_id"), "ring")))
    return rings.self_crossing(both.select("ring_id", G.clean_ring(F.col("ring")).alias("points")), ["ring_id"])


# Rings of the nested features with their validity. Every 5th ring is left open, every 7th has no area.
_FAULTY = """faulty AS (
  SELECT feature_id, polygon_id, ring_id, polygon_pos, ring_pos, n, i, CASE WHEN h % 7 = 0 THEN 1.0::DOUBLE ELSE x END AS x,
         CASE WHEN h % 7 = 0 THEN 2.0::DOUBLE ELSE y END AS y, h % 5 = 0 AS opened
  FROM (SELECT *, split_part(feature_id, ':', 2)::BIGINT + part_pos AS h FROM boundary_vertices)
  WHERE NOT (h % 5 = 0 AND i = n)),
cleaned AS (
  SELECT feature_id, polygon_id, ring_id, polygon_pos, ring_pos, x, y, row_number() OVER (PARTITION BY ring_id ORDER BY i) - 1 AS i
  FROM (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM faulty WINDOW w AS (PARTITION BY ring_id ORDER BY i))
        WHERE px IS NULL OR px <> x OR py <> y) WHERE i < n),
projected AS (SELECT * REPLACE ((x + 180.0::DOUBLE) / 360.0 * 1440.0 AS x, (90.0::DOUBLE - y) / 180.0 * 720.0 AS y) FROM cleaned),
sides AS (
  SELECT ring_id, i, count(*) OVER (PARTITION BY ring_id) AS n, x AS ax, y AS ay,
         coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey
  FROM projected WINDOW w AS (PARTITION BY ring_id ORDER BY i)),
crossing AS (""" + _crossing_sql("sides") + """),
areas AS (SELECT ring_id, max(n) AS n, CASE WHEN max(n) < 3 THEN 0 ELSE sum(ax * ey - ex * ay) / 2 END AS area,
                 sum((ax + ex) * (ax * ey - ex * ay)) AS mx, sum((ay + ey) * (ax * ey - ex * ay)) AS my,
                 min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM sides GROUP BY ring_id),
ids AS (SELECT ring_id, any_value(feature_id) AS feature_id, any_value(polygon_id) AS polygon_id, any_value(polygon_pos) AS polygon_pos,
               any_value(ring_pos) AS ring_pos, any_value(opened) AND max(i) > 0 AND count(DISTINCT (x, y)) > 1 AS open_ring FROM faulty GROUP BY ring_id),
flags AS (
  SELECT i.*, n AS vertex_count, NOT open_ring AS source_closed, area, mx, my, x0, x1, y0, y1,
         NOT open_ring AND n >= 3 AND abs(area) > 2.220446049250313e-16 AND c.ring_id IS NULL AS source_valid,
         n >= 3 AND abs(area) > 2.220446049250313e-16 AND c.ring_id IS NULL AS projected_valid
  FROM ids i JOIN areas USING (ring_id) LEFT JOIN crossing c USING (ring_id))"""


def faulty_rings(t: Tables) -> DataFrame:
    """Rings of the nested features, some opened and some reduced to a point."""
    exploded = rings.explode_rings(t.boundary_features)
    part = F.when(F.col("polygon_pos") > 0, 2).otherwise(F.col("ring_pos"))
    turn = F.col("feature_pos") + part
    point = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    ring = F.when(turn % 7 == 0, F.transform("ring", lambda p: point)).otherwise(F.col("ring"))
    return exploded.withColumn("ring", F.when(turn % 5 == 0, F.slice(ring, 1, F.size("ring") - 1)).otherwise(ring))


@query("ring_flags", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _FAULTY, body="""
SELECT ring_id, vertex_count, source_closed, source_valid, projected_valid, source_valid AND NOT projected_valid AS induced_degenerate,
       source_valid AND projected_valid AS valid, round(area, 5) AS area FROM flags"""))
def ring_flags(t: Tables) -> DataFrame:
    return rings.ring_flags(faulty_rings(t)).select(
        "ring_id", F.col("vertex_count").cast("bigint").alias("vertex_count"), "source_closed", "source_valid", "projected_valid",
        "induced_degenerate", "valid", _r("area", 5).alias("area"))


@query("ring_counters", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _FAULTY, body="""
SELECT count(*) AS rings, count(*) FILTER (WHERE NOT source_valid) AS source_invalid,
       count(*) FILTER (WHERE source_valid AND NOT projected_valid) AS induced_degenerate FROM flags"""))
def ring_counters(t: Tables) -> DataFrame:
    return rings.ring_counters(rings.ring_flags(faulty_rings(t)))


_CLASSES = _FAULTY + """,
ranked AS (
  SELECT *, source_valid AND projected_valid AS valid, row_number() OVER (PARTITION BY polygon_id ORDER BY
           CASE WHEN source_valid AND projected_valid THEN CASE WHEN ring_pos = 0 THEN 0 ELSE 1 END ELSE 2 END, ring_pos) AS rn FROM flags),
classes AS (
  SELECT feature_id, polygon_id, any_value(polygon_pos) AS polygon_pos, count(*) AS rings, count(*) FILTER (WHERE valid) AS shown_rings,
         CASE WHEN bool_or(NOT valid) THEN 'artifact' WHEN bool_or(valid) THEN 'polygon' ELSE 'degenerate' END AS kind,
         max(CASE WHEN rn = 1 THEN abs(area) END) AS area,
         max(CASE WHEN rn = 1 THEN CASE WHEN abs(area) <= 2.220446049250313e-16 THEN (x0 + x1) / 2 ELSE mx / (6 * area) END END) AS centre_x,
         max(CASE WHEN rn = 1 THEN CASE WHEN abs(area) <= 2.220446049250313e-16 THEN (y0 + y1) / 2 ELSE my / (6 * area) END END) AS centre_y,
         max(CASE WHEN rn = 1 THEN x1 - x0 END) AS span_x, max(CASE WHEN rn = 1 THEN y1 - y0 END) AS span_y
  FROM ranked GROUP BY feature_id, polygon_id)"""


@query("polygon_class", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _CLASSES, body="""
SELECT feature_id, polygon_id, kind, rings, shown_rings, round(area, 5) AS area, round(span_x, 5) AS span_x, round(span_y, 5) AS span_y FROM classes"""))
def polygon_class(t: Tables) -> DataFrame:
    return rings.polygon_classes(rings.ring_flags(faulty_rings(t))).select(
        "feature_id", "polygon_id", "kind", "rings", "shown_rings", _r("area", 5).alias("area"),
        _r("span.x", 5).alias("span_x"), _r("span.y", 5).alias("span_y"))


@query("polygon_paths", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _CLASSES, body=f"""
SELECT polygon_id, ring_pos, ring_id, path FROM ranked JOIN (
  SELECT ring_id, 'M' || string_agg({_TEXT.format('x')} || ',' || {_TEXT.format('y')}, 'L' ORDER BY i) || 'Z' AS path FROM projected GROUP BY ring_id) USING (ring_id)
WHERE valid OR polygon_id NOT IN (SELECT polygon_id FROM ranked WHERE valid)"""))
def polygon_paths(t: Tables) -> DataFrame:
    """Rings that are drawn for each polygon, and their paths."""
    return rings.polygon_paths(rings.ring_flags(faulty_rings(t))).select("polygon_id", "ring_pos", "ring_id", "path")


@query("tiny_flag", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _CLASSES, body="""
SELECT feature_id, round(centre_x, 4) AS centre_x, round(centre_y, 4) AS centre_y, 20.0::DOUBLE AS diameter FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY area DESC, polygon_pos) AS rn FROM classes WHERE kind = 'polygon')
WHERE rn = 1 AND least(span_x, span_y) * 0.25 < 20"""))
def tiny_flag(t: Tables) -> DataFrame:
    """Features whose largest polygon is below the drawing size."""
    tiny = rings.tiny_features(rings.polygon_classes(rings.ring_flags(faulty_rings(t))), "feature_id", 0.25, 20.0)
    return tiny.select("feature_id", _r("centre.x", 4).alias("centre_x"), _r("centre.y", 4).alias("centre_y"), "diameter")


def _simplified_sql(vertices: str, last: str, tolerance: float) -> str:
    """Douglas-Peucker over a vertex table (key, i, n, x, y), from 0 to ``last``, as a work list of ranges."""
    dx, dy = "(b.x - a.x)", "(b.y - a.y)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    k = f"(CASE WHEN {length} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((v.x - a.x) * {dx} + (v.y - a.y) * {dy}) / {length})) END)"
    far = f"((v.x - (a.x + {k} * {dx})) ** 2 + (v.y - (a.y + {k} * {dy})) ** 2)"
    return f"""work AS (
  SELECT key, 0::BIGINT AS lo, max(i)::BIGINT AS hi FROM {vertices} GROUP BY key
  UNION ALL
  SELECT key, unnest([lo, mid]), unnest([mid, hi]) FROM (
    SELECT w.key, w.lo, w.hi, arg_max(v.i, struct_pack(d := {far}, k := -v.i)) AS mid, max({far}) AS far
    FROM work w JOIN {vertices} a ON a.key = w.key AND a.i = w.lo JOIN {vertices} b ON b.key = w.key AND b.i = w.hi
         JOIN {vertices} v ON v.key = w.key AND v.i > w.lo AND v.i < w.hi GROUP BY w.key, w.lo, w.hi)
  WHERE far > {tolerance ** 2!r}::DOUBLE),
kept AS (SELECT DISTINCT key, lo AS i FROM work UNION SELECT DISTINCT key, hi FROM work)"""


@query("simplify", with_views(RAW_VERTICES, """closed AS (
  SELECT ring_id AS key, i, x, y FROM raw_vertices UNION ALL SELECT ring_id, 32, x, y FROM raw_vertices WHERE i = 0)""",
    _simplified_sql("closed", "32", 20.0), recursive=True, body="""
SELECT key AS ring_id, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS i, x, y FROM kept JOIN closed USING (key, i)"""))
def simplify(t: Tables) -> DataFrame:
    """Vertices that remain of every ring at a coarse tolerance."""
    return (rings.simplify(t.rings, 20.0).select("ring_id", F.posexplode("ring").alias("i", "p"))
            .select("ring_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y"))


_BUILD = [RAW_VERTICES, BOUNDARY_VERTICES, f"""flat AS (
  SELECT feature_id, part_pos, feature_id || ':part:' || part_pos AS key, i, {fixed2_sql('((x + 180.0::DOUBLE) / 360.0 * 1440.0)')} AS x,
         {fixed2_sql('((90.0::DOUBLE - y) / 180.0 * 720.0)')} AS y FROM boundary_vertices)""", _simplified_sql("flat", "n", 25.0), f"""
parts AS (SELECT feature_id, key AS part_id, count(*) AS vertices, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
                 'M' || string_agg({_TEXT.format('x')} || ',' || {_TEXT.format('y')}, 'L' ORDER BY i) || 'Z' AS path,
                 list_reduce(list(x ORDER BY i), lambda a, b: a + b) / count(*) AS mx, list_reduce(list(y ORDER BY i), lambda a, b: a + b) / count(*) AS my
          FROM kept JOIN flat USING (key, i) GROUP BY feature_id, key)"""]


@query("feature_parts", with_views(*_BUILD, recursive=True, body=f"""
SELECT feature_id, part_id, vertices, path, {fixed2_sql('mx')} AS anchor_x, {fixed2_sql('my')} AS anchor_y, min_x, min_y, max_x, max_y FROM parts"""))
def feature_parts(t: Tables) -> DataFrame:
    """Projected, simplified parts of the nested features."""
    return rings.build_parts(t.boundary_features, 25.0).select(
        "feature_id", "part_id", F.size("ring").cast("bigint").alias("vertices"), "path", F.col("anchor.x").alias("anchor_x"),
        F.col("anchor.y").alias("anchor_y"), "bounds.min_x", "bounds.min_y", "bounds.max_x", "bounds.max_y")


_LABEL_X, _LABEL_Y = fixed2_sql("((lx + 180.0::DOUBLE) / 360.0 * 1440.0)"), fixed2_sql("((90.0::DOUBLE - ly) / 180.0 * 720.0)")


@query("feature_build", with_views(*_BUILD, """labels_at AS (
  SELECT 'ne:' || ring_id AS feature_id, CASE WHEN ring_id % 3 > 0 THEN x END AS lx, y AS ly FROM star_vertices WHERE i = 0)""",
    recursive=True, body=f"""
SELECT feature_id, parts, min_x, min_y, max_x, max_y, CASE WHEN lx IS NULL THEN min_x ELSE {_LABEL_X} END AS anchor_x,
       CASE WHEN lx IS NULL THEN min_y ELSE {_LABEL_Y} END AS anchor_y
FROM (SELECT feature_id, count(*) AS parts, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM parts GROUP BY feature_id)
JOIN labels_at USING (feature_id)"""))
def feature_build(t: Tables) -> DataFrame:
    """Features with envelope and anchor, from their simplified parts."""
    built = rings.build_features(t.boundary_features, rings.build_parts(t.boundary_features, 25.0))
    return built.select("feature_id", "parts", "bounds.min_x", "bounds.min_y", "bounds.max_x", "bounds.max_y",
                        F.col("anchor.x").alias("anchor_x"), F.col("anchor.y").alias("anchor_y"))


# --- components ------------------------------------------------------------------------------

UNWRAPPED = """distinct_xs AS (SELECT DISTINCT component_id, x FROM component_vertices),
gaps AS (SELECT component_id, x, coalesce(lead(x) OVER w, first_value(x) OVER w + 360) AS nxt FROM distinct_xs WINDOW w AS (PARTITION BY component_id ORDER BY x)),
targets AS (SELECT component_id, nxt % 360 AS target, 360 - (nxt - x) AS wrapped_span FROM (
  SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY nxt - x DESC, x) AS rn FROM gaps) WHERE rn = 1),
cuts AS (SELECT component_id, x AS cut, wrapped_span FROM (
  SELECT component_id, x, wrapped_span, row_number() OVER (PARTITION BY component_id ORDER BY abs(x - target), x) AS rn
  FROM distinct_xs JOIN targets USING (component_id)) WHERE rn = 1),
unwrapped AS (SELECT location_id, component_id, pos, i, CASE WHEN x < cut THEN x + 360 ELSE x END AS x, y, wrapped_span
              FROM component_vertices JOIN cuts USING (component_id)),
parts AS (
  SELECT location_id, component_id, pos, (min(x) + max(x)) * 2 AS cx, (min(y) + max(y)) * 2 AS cy,
         greatest(max(x) * 4 - min(x) * 4, max(y) * 4 - min(y) * 4) / 2 AS radius FROM unwrapped GROUP BY ALL),
small_places AS (SELECT location_id FROM parts GROUP BY location_id HAVING max(radius) * 2 < 20),
segs AS (
  SELECT location_id, component_id, x * 4 AS ax, y * 4 AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) * 4 AS ex,
         coalesce(lead(y) OVER w, first_value(y) OVER w) * 4 AS ey FROM unwrapped WINDOW w AS (PARTITION BY component_id ORDER BY i))"""

NEAR = f"""near AS (
  SELECT location_id, a, b, min(distance) AS distance FROM (
    SELECT location_id, a, b, {segment_distance_sql()} AS distance FROM (
      SELECT s.location_id, s.component_id AS a, o.component_id AS b, s.ax, s.ay, s.ex, s.ey,
             o.ax + shift AS cx, o.ay AS cy, o.ex + shift AS dx, o.ey AS dy
      FROM segs s JOIN segs o ON s.location_id = o.location_id AND s.component_id < o.component_id, (VALUES (0.0::DOUBLE), (1440.0::DOUBLE), (-1440.0::DOUBLE)) AS v(shift)))
  GROUP BY ALL HAVING min(distance) <= 4)"""

# Reachability over near pairs; restricted to a set of places by the caller.
LABELLED = """links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (
  SELECT component_id AS id, component_id AS seen FROM parts
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
labelled AS (SELECT id AS component_id, min(seen) AS cluster FROM reach GROUP BY id)"""


def component_table(t: Tables) -> DataFrame:
    return spatial.component_table(t.components, width=WIDTH, scale=SCALE)


@query("unwrap", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, body="SELECT component_id, i, x, y FROM unwrapped"))
def unwrap(t: Tables) -> DataFrame:
    """Component vertices after cutting the world at the component's widest empty arc."""
    return (t.components.select("component_id", F.posexplode(G.unwrap(F.col("points"), F.lit(WIDTH))).alias("i", "p"))
            .select("component_id", F.col("i").cast("bigint").alias("i"), "p.x", "p.y"))


@query("wrap_span", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, body="""
SELECT component_id, round(greatest(max(wrapped_span), max(y) - min(y)), 6) AS span FROM unwrapped GROUP BY component_id"""))
def wrap_span(t: Tables) -> DataFrame:
    """Seam-aware span of every component."""
    return t.components.select("component_id", _r(G.ring_span(F.col("points"), F.lit(WIDTH))).alias("span"))


# Components whose coordinates have gone through path texts.
_PATH_VERTICES = COMPONENT_VERTICES.replace("component_vertices AS (", "exact_vertices AS (", 1) + f""",
component_vertices AS (SELECT location_id, component_id, pos, i, {fixed2_sql('x')} AS x, {fixed2_sql('y')} AS y FROM exact_vertices)"""


def _paths(t: Tables):
    """Two path texts for each location, of two sub-paths and of the rest."""
    text = G.path_text(F.transform("points", lambda p: G.point(G.fixed2(p["x"]), G.fixed2(p["y"]))))
    rows = t.components.select("location_id", F.when(F.col("pos") < 2, 0).otherwise(1).alias("path_pos"), "pos", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("location_id", "path_pos").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("path"))


@query("path_span", with_views(RAW_VERTICES, _PATH_VERTICES, UNWRAPPED, body="""
SELECT location_id, CASE WHEN pos < 2 THEN 0 ELSE 1 END AS path_pos, round(max(span), 6) AS span
FROM (SELECT location_id, component_id, pos, greatest(max(wrapped_span), max(y) - min(y)) AS span FROM unwrapped GROUP BY ALL) GROUP BY ALL"""))
def path_span(t: Tables) -> DataFrame:
    """The largest seam-aware span over the sub-paths of each path."""
    return _paths(t).select("location_id", "path_pos", _r(G.path_span(G.path_rings(F.col("path")), F.lit(WIDTH))).alias("span"))


@query("path_components", with_views(RAW_VERTICES, _PATH_VERTICES, UNWRAPPED, body="""
SELECT location_id, CASE WHEN pos < 2 THEN 0 ELSE 1 END AS path_pos, CASE WHEN pos < 2 THEN pos ELSE pos - 2 END AS ring_pos, pos,
       round(cx, 6) AS centre_x, round(cy, 6) AS centre_y, round(radius, 6) AS radius, radius * 2 < 20 AS small FROM parts"""))
def path_components(t: Tables) -> DataFrame:
    """Components straight from path texts, with the place of their path and ring."""
    table = spatial.component_table(spatial.path_components(_paths(t)), width=WIDTH, scale=SCALE)
    return table.select("location_id", "path_pos", "ring_pos", "pos", _r("centre.x").alias("centre_x"), _r("centre.y").alias("centre_y"), _r("radius").alias("radius"), "small")


@query("components", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, body="""
SELECT location_id, component_id, round(cx, 6) AS centre_x, round(cy, 6) AS centre_y, round(radius, 6) AS radius, radius * 2 < 20 AS small FROM parts"""))
def components(t: Tables) -> DataFrame:
    """Centre, radius and smallness of every component."""
    return component_table(t).select("location_id", "component_id", _r("centre.x").alias("centre_x"), _r("centre.y").alias("centre_y"),
                                     _r("radius").alias("radius"), "small")


@query("largest_component", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, body="""
SELECT location_id, component_id FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY radius DESC, pos) AS rn FROM parts) WHERE rn = 1"""))
def largest_component(t: Tables) -> DataFrame:
    """Largest component of every location; the first wins ties."""
    return component_table(t).groupBy("location_id").agg(
        F.max_by("component_id", F.struct("radius", -F.col("pos"))).alias("component_id"))


@query("near_pairs", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, NEAR, body="""
SELECT location_id, a, b, round(distance, 6) AS distance FROM near"""))
def near_pairs(t: Tables) -> DataFrame:
    """Component pairs of a location within the proximity, with their distance."""
    return spatial.near_pairs(component_table(t), world=WORLD, proximity=PROXIMITY).withColumn("distance", _r("distance"))


@query("clusters", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, NEAR, LABELLED, recursive=True, body="""
SELECT location_id, component_id, cluster FROM labelled JOIN parts USING (component_id)"""))
def clusters(t: Tables) -> DataFrame:
    """Proximity cluster of every component."""
    return spatial.clusters(component_table(t), world=WORLD, proximity=PROXIMITY).select("location_id", "component_id", "cluster")


MAIN = """mains AS (SELECT location_id, cluster, cx AS anchor_x, cy AS anchor_y FROM (
  SELECT location_id, component_id, cx, cy, row_number() OVER (PARTITION BY location_id ORDER BY radius DESC, pos) AS rn FROM parts
  SEMI JOIN small_places USING (location_id)) JOIN labelled USING (component_id) WHERE rn = 1),
member AS (SELECT p.location_id, p.component_id, p.pos, anchor_x, anchor_y FROM parts p JOIN labelled l USING (component_id)
           JOIN mains m ON m.location_id = p.location_id AND m.cluster = l.cluster)"""


@query("cluster_members", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, NEAR, LABELLED, MAIN, recursive=True, body="""
SELECT location_id, component_id, pos FROM member"""))
def cluster_members(t: Tables) -> DataFrame:
    return spatial.cluster_members(component_table(t), world=WORLD, proximity=PROXIMITY).select("location_id", "component_id", "pos")


@query("cluster_summary", with_views(RAW_VERTICES, COMPONENT_VERTICES, UNWRAPPED, NEAR, LABELLED, MAIN, recursive=True, body="""
SELECT location_id, members, round((x0 + x1) / 2 / 4, 5) AS centre_x, round((y0 + y1) / 2 / 4, 5) AS centre_y, round(anchor_x / 4, 5) AS focus_x,
       round(anchor_y / 4, 5) AS focus_y, round(x0 / 4, 5) AS min_x, round(y0 / 4, 5) AS min_y, round(x1 / 4, 5) AS max_x, round(y1 / 4, 5) AS max_y
FROM (SELECT location_id, count(DISTINCT pos) AS members, any_value(anchor_x) AS anchor_x, any_value(anchor_y) AS anchor_y, min(ax) AS x0, max(ax) AS x1,
             min(y) AS y0, max(y) AS y1
      FROM (SELECT m.*, u.y * 4 AS y, u.x * 4 - (CASE WHEN u.x * 4 - anchor_x > 720 THEN ceil((u.x * 4 - anchor_x - 720) / 1440)
                       WHEN anchor_x - u.x * 4 > 720 THEN -ceil((anchor_x - u.x * 4 - 720) / 1440) ELSE 0 END) * 1440 AS ax
            FROM member m JOIN unwrapped u USING (component_id)) GROUP BY location_id)"""))
def cluster_summary(t: Tables) -> DataFrame:
    """Envelope, centre and focus of the main cluster of every small location."""
    members = spatial.cluster_members(component_table(t), world=WORLD, proximity=PROXIMITY)
    summary = spatial.cluster_summary(members, width=WIDTH, scale=SCALE)
    return summary.select("location_id", "members", *[_r(c, 5).alias(c) for c in summary.columns[2:]])


# --- views -----------------------------------------------------------------------------------

_ITEMS = """items AS (SELECT component_id, min(x) AS min_x, max(x) AS max_x FROM component_vertices GROUP BY component_id),
views AS (SELECT n_nationkey AS view_id, n_nationkey * 15.0::DOUBLE - 200 AS view_min, n_nationkey * 15.0::DOUBLE - 200 + 20 + n_nationkey * 9 AS view_max FROM nation)"""


def _items(t: Tables) -> DataFrame:
    box = G.envelope(F.col("points"))
    return t.components.select("component_id", box["min_x"].alias("min_x"), box["max_x"].alias("max_x"))


@query("viewport", with_views(RAW_VERTICES, COMPONENT_VERTICES, _ITEMS, body="""
SELECT component_id, view_id, "offset" FROM items, views, (VALUES (0.0::DOUBLE), (-360.0::DOUBLE), (360.0::DOUBLE)) AS v("offset")
WHERE max_x + "offset" >= view_min AND min_x + "offset" <= view_max"""))
def viewport(t: Tables) -> DataFrame:
    """World copies of the components that show in each of several views."""
    start = F.col("n_nationkey") * 15.0 - 200
    views = t.read("nation").select(F.col("n_nationkey").alias("view_id"), start.alias("view_min"), (start + 20 + F.col("n_nationkey") * 9).alias("view_max"))
    return spatial.in_views(_items(t), views, width=WIDTH).select("component_id", "view_id", "offset")


_SEAM_X = "(152.0::DOUBLE + 180) / 360 * 360"


@query("wrapped_copies", with_views(RAW_VERTICES, COMPONENT_VERTICES, _ITEMS, body=f"""
SELECT component_id, "offset", min_x + "offset" AS shown_min, max_x + "offset" AS shown_max
FROM items, (VALUES (0.0::DOUBLE), (-360.0::DOUBLE), (360.0::DOUBLE)) AS v("offset")
WHERE max_x + "offset" >= -({_SEAM_X}) - 25 AND min_x + "offset" <= -({_SEAM_X}) + 360 + 25"""))
def wrapped_copies(t: Tables) -> DataFrame:
    """World copies of the components that show in the default view of the wrapped world."""
    view = G.view_bounds(F.lit(WIDTH), F.lit((G.SEAM_LONGITUDE + 180) / 360 * WIDTH), 25.0)
    shown = _items(t).select("component_id", "min_x", "max_x", F.explode(
        G.visible_offsets(F.col("min_x"), F.col("max_x"), F.lit(WIDTH), view)).alias("offset"))
    return shown.select("component_id", "offset", (F.col("min_x") + F.col("offset")).alias("shown_min"), (F.col("max_x") + F.col("offset")).alias("shown_max"))


@query("nearest_copy", with_views(POINTS, body=f"""
SELECT point_id, coalesce(arg_min("offset", struct_pack(d := abs(x + "offset" - 180), k := ord)) FILTER (WHERE x + "offset" >= -({_SEAM_X}) - 25
         AND x + "offset" <= -({_SEAM_X}) + 360 + 25), 0.0::DOUBLE) AS "offset"
FROM (SELECT point_id, (lon + 180) AS x FROM points), (VALUES (0, 0.0::DOUBLE), (1, -360.0::DOUBLE), (2, 360.0::DOUBLE)) AS v(ord, "offset")
GROUP BY point_id"""))
def nearest_copy(t: Tables) -> DataFrame:
    """The visible copy of each point that lies nearest to the middle of the world."""
    view = G.view_bounds(F.lit(WIDTH), F.lit((G.SEAM_LONGITUDE + 180) / 360 * WIDTH), 25.0)
    x = F.col("lon") + 180
    return t.points.select("point_id", G.nearest_offset(G.visible_offsets(x, x, F.lit(WIDTH), view), x, F.lit(180.0)).alias("offset"))
