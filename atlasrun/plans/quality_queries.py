"""Registered quality rules, each over tables with faults in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import quality, resolve, rings
from .geometry_queries import _FAULTY, faulty_rings
from .registry import query, with_views
from .resolve_queries import DETAIL, OVERRIDES, REFS, _features, _mixed, _refs
from .views import BOUNDARY_VERTICES, FEATURES, MEMBERS, PLACES, RAW_VERTICES, Tables

LINE_REFS = "line_refs AS (SELECT l_orderkey AS location_id, l_partkey AS feature_id, l_linenumber AS ref_pos FROM lineitem)"


def _line_refs(t: Tables) -> DataFrame:
    return t.read("lineitem").select(F.col("l_orderkey").alias("location_id"), F.col("l_partkey").alias("feature_id"),
                                     F.col("l_linenumber").alias("ref_pos"))


@query("dq_unique", """
SELECT 'unique' AS rule, p_name AS entity, count(*)::VARCHAR AS detail FROM part GROUP BY p_name HAVING count(*) > 1""")
def dq_unique(t: Tables) -> DataFrame:
    return quality.unique(t.read("part"), "p_name")


@query("dq_unique_refs", with_views(LINE_REFS, body="""
SELECT 'unique-refs' AS rule, location_id::VARCHAR AS entity, feature_id::VARCHAR AS detail FROM line_refs GROUP BY location_id, feature_id HAVING count(*) > 1
UNION ALL
SELECT 'unique-refs', feature_id::VARCHAR, location_id::VARCHAR FROM (SELECT DISTINCT feature_id, location_id, ref_pos FROM line_refs) GROUP BY feature_id, location_id HAVING count(*) > 1"""))
def dq_unique_refs(t: Tables) -> DataFrame:
    """Repeated references, seen from both sides."""
    refs = _line_refs(t)
    other = refs.select("feature_id", "location_id", "ref_pos").distinct()
    return quality.all_of(quality.unique_refs(refs), quality.unique_refs(other, "feature_id", "location_id"))


@query("dq_cardinality", """
SELECT 'cardinality' AS rule, n_name AS entity, count(c_custkey)::VARCHAR || '/' || (n_nationkey * 3 + 30) AS detail
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey HAVING count(c_custkey) <> n_nationkey * 3 + 30""")
def dq_cardinality(t: Tables) -> DataFrame:
    """Customers per nation against expected counts."""
    nation = t.read("nation")
    actual = t.read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "n")
    expected = nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 3 + 30).alias("n"))
    return quality.cardinality(actual, expected)


@query("dq_references", """
SELECT 'reference' AS rule, o_orderkey::VARCHAR AS entity, (o_custkey * 9 // 8)::VARCHAR AS detail FROM orders WHERE o_custkey * 9 // 8 NOT IN (SELECT c_custkey FROM customer)""")
def dq_references(t: Tables) -> DataFrame:
    """Orders whose customer number, stretched by an eighth, names no customer."""
    stretched = t.read("orders").withColumn("named", F.expr("o_custkey * 9 div 8"))
    return quality.references(stretched, t.read("customer"), "o_orderkey", "named", "c_custkey")


@query("dq_subset", with_views(MEMBERS, body="""
SELECT 'subset' AS rule, quiz_id AS entity, location_id AS detail FROM (
  SELECT r_name AS quiz_id, 'iso:' || n_name AS location_id FROM region, nation WHERE n_regionkey >= r_regionkey) a
WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.quiz_id = a.quiz_id AND m.location_id = a.location_id)"""))
def dq_subset(t: Tables) -> DataFrame:
    """Base layers that name locations outside their quiz."""
    reach = t.read("nation").select("n_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_regionkey").cast("bigint"))).alias("region"))
    layers = reach.join(t.read("region"), F.col("region") == F.col("r_regionkey")).select(
        F.col("r_name").alias("quiz_id"), F.concat(F.lit("iso:"), "n_name").alias("location_id"))
    return quality.subset_per_owner(layers, t.members, "quiz_id", "location_id")


@query("dq_not_empty", """
SELECT 'not-empty' AS rule, p_partkey::VARCHAR AS entity, 'empty' AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey - l_partkey % 3 FROM lineitem)""")
def dq_not_empty(t: Tables) -> DataFrame:
    """Parts that no line names once part numbers are rounded down to multiples of three."""
    lines = t.read("lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 3).alias("p_partkey"))
    return quality.not_empty(lines, t.read("part"), "p_partkey")


@query("dq_bounds", """
SELECT 'bounds' AS rule, c_custkey::VARCHAR AS entity, 'not finite' AS detail FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0""")
def dq_bounds(t: Tables) -> DataFrame:
    """Bounds with missing, undefined and infinite numbers worked in."""
    key = F.col("c_custkey")
    box = F.struct(F.when(key % 7 != 0, F.col("c_acctbal")).alias("min_x"), F.lit(0.0).alias("min_y"),
                   F.when(key % 11 == 0, float("nan")).otherwise(1.0).alias("max_x"),
                   F.when(key % 13 == 0, float("inf")).otherwise(1.0).alias("max_y"))
    return quality.finite_bounds(t.read("customer").withColumn("bounds", box), "c_custkey")


@query("dq_pattern", """
SELECT 'pattern' AS rule, url AS entity, html AS detail FROM pages WHERE NOT regexp_matches(html, '^<!DOCTYPE html><html lang="(en|de)"')
UNION ALL
SELECT 'path', 'ne:' || s_suppkey, coalesce(p, '') FROM (
  SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'M1,2L' || s_acctbal || ',4Q' ELSE 'M1,2L' || s_acctbal || ',4Z' END AS p FROM supplier)
WHERE p IS NULL OR NOT regexp_matches(p, '^M[-0-9.,]+(?:L[-0-9.,]+)*Z$')""")
def dq_pattern(t: Tables) -> DataFrame:
    """Whole texts and paths that break their pattern."""
    key = F.col("s_suppkey")
    path = (F.when(key % 5 == 0, None).when(key % 3 == 0, F.concat(F.lit("M1,2L"), F.col("s_acctbal").cast("string"), F.lit(",4Q")))
            .otherwise(F.concat(F.lit("M1,2L"), F.col("s_acctbal").cast("string"), F.lit(",4Z"))))
    paths = t.read("supplier").select(F.concat(F.lit("ne:"), key.cast("string")).alias("feature_id"), path.alias("path"))
    return quality.all_of(quality.pattern(t.read("pages"), "url", "html", '^<!DOCTYPE html><html lang="(en|de)"'),
                          quality.pattern(paths, "feature_id", "path", quality.PATH_PATTERN, "path"))


@query("dq_same_keys", """
SELECT 'same-keys' AS rule, coalesce(a, b)::VARCHAR AS entity, CASE WHEN a IS NULL THEN 'only right' ELSE 'only left' END AS detail
FROM (SELECT DISTINCT doc_id + doc_id // 3 AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b WHERE a IS NULL OR b IS NULL""")
def dq_same_keys(t: Tables) -> DataFrame:
    """Documents, with gaps worked into their numbers, and labels that lack each other."""
    spread = t.read("documents").select(F.expr("doc_id + doc_id div 3").alias("doc_id"))
    return quality.same_keys(spread, t.read("labels"), "doc_id")


@query("dq_disjoint", """
SELECT DISTINCT 'disjoint' AS rule, o_custkey::VARCHAR AS entity, 'on both sides' AS detail FROM orders WHERE o_custkey IN (SELECT user_id FROM events)""")
def dq_disjoint(t: Tables) -> DataFrame:
    """Customers that also occur as users."""
    return quality.disjoint(t.read("orders").select(F.col("o_custkey").alias("id")), t.read("events").select(F.col("user_id").alias("id")), "id")


@query("dq_parity", with_views(FEATURES, PLACES, OVERRIDES, REFS, DETAIL, body="""
SELECT 'parity' AS rule, coalesce(r.location_id, d.location_id) AS entity,
       coalesce(r.ref_pos, d.ref_pos) || ':' || coalesce(r.feature_id, '-') || ':' || coalesce(d.feature_id, '-') AS detail
FROM refs r FULL JOIN detail d ON r.location_id = d.location_id AND r.ref_pos = d.ref_pos WHERE r.feature_id IS DISTINCT FROM d.feature_id"""))
def dq_parity(t: Tables) -> DataFrame:
    """References that differ between the two resolutions."""
    return quality.parity(_refs(t), resolve.detail_index(_mixed(t), _refs(t), _features(t)))


@query("dq_pinned", with_views(FEATURES, PLACES, OVERRIDES, REFS, """pinned AS (
  SELECT location_id, feature_pos AS ref_pos, feature_id FROM places JOIN features ON code = iso3 WHERE pos % 5 <> 1)""", body="""
SELECT 'pinned-refs' AS rule, coalesce(r.location_id, p.location_id) AS entity,
       coalesce(r.ref_pos, p.ref_pos) || ':' || coalesce(r.feature_id, '-') || ':' || coalesce(p.feature_id, '-') AS detail
FROM (SELECT * FROM refs WHERE location_id IN (SELECT location_id FROM pinned)) r FULL JOIN pinned p ON r.location_id = p.location_id AND r.ref_pos = p.ref_pos
WHERE r.feature_id IS DISTINCT FROM p.feature_id
UNION ALL SELECT 'forbidden-refs', location_id, feature_id FROM refs SEMI JOIN (
  SELECT location_id, feature_id FROM places JOIN features ON code = iso3 WHERE feature_pos % 7 = 3) USING (location_id, feature_id)
UNION ALL SELECT 'minimum-extent', location_id, 'too small' FROM places LEFT JOIN (
  SELECT code, max(ax + 2) - min(ax - 1) AS w, max(ay + 2) - min(ay - 1) AS h FROM features GROUP BY code) ON code = iso3 WHERE NOT coalesce(w > 280 AND h > 140, false)
UNION ALL SELECT 'ref-count', location_id, count(*)::VARCHAR FROM refs GROUP BY location_id HAVING count(*) < 4
UNION ALL SELECT 'required', 'iso:' || r_name, 'missing' FROM region WHERE 'iso:' || r_name NOT IN (SELECT location_id FROM places)"""))
def dq_pinned(t: Tables) -> DataFrame:
    """Pinned and forbidden references, least extents and counts, required locations."""
    refs, features = _refs(t), _features(t)
    pinned = resolve.match_catalog(t.places.where(F.col("pos") % 5 != 1), features)
    # Every seventh feature is forbidden where its key puts it, whatever the references say.
    forbidden = resolve.match_catalog(t.places, features).where(F.col("ref_pos") % 7 == 3)
    shapes = resolve.location_shapes(resolve.match_catalog(t.places, features), features)
    least = t.places.select("location_id", F.lit(280.0).alias("width"), F.lit(140.0).alias("height"))
    wanted = t.read("region").select(F.concat(F.lit("iso:"), "r_name").alias("location_id"))
    return quality.all_of(quality.pinned_refs(refs, pinned), quality.forbidden_refs(refs, forbidden), quality.minimum_extent(shapes, least),
                          quality.ref_counts(refs, 4), quality.required(t.places, wanted, "location_id"))


@query("dq_ring_contract", with_views(RAW_VERTICES, BOUNDARY_VERTICES, _FAULTY, body="""
SELECT 'ring-contract' AS rule, ring_id AS entity,
       CASE WHEN ring_pos = 0 AND polygon_pos = 1 THEN 'exterior with parent' ELSE 'interior without parent' END AS detail
FROM flags WHERE (ring_pos = 0 AND polygon_pos = 1) OR (ring_pos = 1 AND NOT source_closed)"""))
def dq_ring_contract(t: Tables) -> DataFrame:
    """Rings with a wrong parent: islands get one, open holes lose theirs."""
    flags = rings.ring_flags(faulty_rings(t))
    parent = (F.when(F.col("island"), F.lit("someone")).when((F.col("role") == "interior") & ~F.col("source_closed"), None)
              .otherwise(F.col("parent_ring_id")))
    return quality.ring_contract(flags.withColumn("parent_ring_id", parent))


@query("dq_quiz_inputs", with_views(PLACES, MEMBERS, """faulty_catalog AS (
  SELECT location_id, CASE WHEN pos % 6 = 0 THEN '...' WHEN pos % 4 = 1 THEN 'Twin ' || (pos % 5) ELSE name END AS name FROM places
  UNION ALL SELECT location_id, name FROM places WHERE pos % 9 = 0),
faulty_members AS (SELECT quiz_id, location_id FROM members UNION ALL SELECT quiz_id, location_id FROM members WHERE pos % 8 = 0
                   UNION ALL SELECT r_name, ' ' FROM region UNION ALL SELECT r_name, 'gone:' || r_name FROM region),
keyed AS (SELECT *, regexp_replace(lower(name), '\\p{P}', '', 'g') AS key FROM faulty_catalog)""", body="""
SELECT 'catalog-unique' AS rule, location_id AS entity, count(*)::VARCHAR AS detail FROM faulty_catalog GROUP BY location_id HAVING count(*) > 1
UNION ALL SELECT 'catalog-name', location_id, 'empty name' FROM keyed WHERE key = ''
UNION ALL SELECT 'quiz-name-unique', quiz_id, key FROM (SELECT DISTINCT quiz_id, location_id FROM faulty_members) JOIN keyed USING (location_id)
          WHERE key <> '' GROUP BY quiz_id, key HAVING count(*) > 1
UNION ALL SELECT 'member-id', quiz_id, 'blank' FROM faulty_members WHERE trim(location_id) = ''
UNION ALL SELECT 'member-unique', quiz_id, location_id FROM faulty_members GROUP BY quiz_id, location_id HAVING count(*) > 1
UNION ALL SELECT 'member-known', quiz_id, location_id FROM faulty_members WHERE location_id NOT IN (SELECT location_id FROM faulty_catalog)
UNION ALL SELECT 'quiz-id', ' ', 'blank' FROM region WHERE r_regionkey = 4"""))
def dq_quiz_inputs(t: Tables) -> DataFrame:
    """Contract of quizzes, members and catalog, with faults of every kind."""
    pos = F.col("pos")
    name = (F.when(pos % 6 == 0, "...").when(pos % 4 == 1, F.concat(F.lit("Twin "), (pos % 5).cast("string"))).otherwise(F.col("name")))
    catalog = t.places.select("location_id", name.alias("name")).unionByName(t.places.where(pos % 9 == 0).select("location_id", "name"))
    region = t.read("region")
    members = (t.members.select("quiz_id", "location_id").unionByName(t.members.where(pos % 8 == 0).select("quiz_id", "location_id"))
               .unionByName(region.select(F.col("r_name").alias("quiz_id"), F.lit(" ").alias("location_id")))
               .unionByName(region.select(F.col("r_name").alias("quiz_id"), F.concat(F.lit("gone:"), "r_name").alias("location_id"))))
    quizzes = region.select(F.when(F.col("r_regionkey") == 4, " ").otherwise(F.col("r_name")).alias("quiz_id"))
    return quality.quiz_inputs(quizzes, members, catalog)


@query("dq_exactly_once", """
SELECT 'exactly-once' AS rule, coalesce(c, u)::VARCHAR AS entity, CASE WHEN u IS NULL THEN 'extra' WHEN c IS NULL THEN 'missing' ELSE 'repeated' END AS detail
FROM (SELECT o_custkey * 9 // 8 AS c, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT DISTINCT c_custkey AS u FROM customer) ON c = u
WHERE c IS NULL OR u IS NULL OR n <> 1""")
def dq_exactly_once(t: Tables) -> DataFrame:
    """Do the orders, their customer numbers stretched by an eighth, name each customer exactly once?"""
    return quality.exactly_once(t.read("orders").select(F.expr("o_custkey * 9 div 8").alias("id")),
                                t.read("customer").select(F.col("c_custkey").alias("id")), "id")


@query("dq_contained", with_views(RAW_VERTICES, """placed AS (
  SELECT 'q' || label AS quiz_id, 'v' || ring_id AS location_id, (x + 180) * 4 AS x, (90 - y) * 4 AS y FROM raw_vertices),
wrapped AS (SELECT quiz_id, location_id, CASE WHEN x > 720 THEN x - 1440 ELSE x END AS x, y FROM placed),
boxes AS (SELECT quiz_id, location_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM wrapped GROUP BY ALL),
plain AS (SELECT quiz_id, location_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM placed GROUP BY ALL)""", body="""
SELECT 'contained' AS rule, location_id AS entity, quiz_id AS detail FROM boxes WHERE NOT (x0 > -715 AND x1 < 715 AND y0 > 230 AND y1 < 500)
UNION ALL SELECT 'overlapping', location_id, quiz_id FROM plain WHERE NOT (x1 > -715 AND x0 < 540 AND y1 > 230 AND y0 < 500)"""))
def dq_contained(t: Tables) -> DataFrame:
    """Ring extents against a view per group, contained after wrapping, and overlapping as they are."""
    points = F.transform("points", lambda p: G.point((p["x"] + 180) * 4, (90 - p["y"]) * 4))
    members = t.raw_rings.select(F.concat(F.lit("q"), F.col("label").cast("string")).alias("quiz_id"),
                                 F.concat(F.lit("v"), F.col("ring_id").cast("string")).alias("location_id"), points.alias("points"))

    def views(max_x: float) -> DataFrame:
        box = F.struct(F.lit(-715.0).alias("min_x"), F.lit(230.0).alias("min_y"), F.lit(max_x).alias("max_x"), F.lit(500.0).alias("max_y"))
        return members.select("quiz_id").distinct().withColumn("view", box)

    boxes = members.select("quiz_id", F.col("location_id").alias("feature_id"), G.envelope(F.col("points")).alias("bounds"))
    return quality.all_of(quality.contained(members, views(715.0)), quality.overlapping(boxes, views(540.0)))


@query("dq_source_scope", """
SELECT 'scope' AS rule, coalesce(r_name, '-') AS entity, coalesce(want, '-') AS detail
FROM region FULL JOIN (SELECT CASE WHEN n_nationkey = 4 THEN 5 ELSE n_nationkey END AS pos, n_name AS want FROM nation WHERE n_nationkey < 5) AS v
  ON pos = r_regionkey WHERE r_name IS DISTINCT FROM want
UNION ALL SELECT 'scope', '-', n_name FROM nation WHERE n_nationkey > 4
UNION ALL SELECT 'scope-unmatched', r_name, r_name FROM region WHERE r_name NOT IN (SELECT p_type FROM part)
UNION ALL SELECT 'scope-count', 'replaced', have || '/' || want FROM (
  SELECT (SELECT count(*) FROM part) AS have, (SELECT count(*) FROM part WHERE p_type IN (SELECT r_name FROM region)) AS want) WHERE have <> want""")
def dq_source_scope(t: Tables) -> DataFrame:
    """Scope of a replacement source that has drifted from the pinned one: the nations, with one number shifted."""
    source = t.read("region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("code"))
    base = t.read("part").select(F.col("p_type").alias("code"))
    key = F.col("n_nationkey")
    pinned = t.read("nation").select(F.when(key < 4, key).otherwise(key + 1).alias("pos"), F.col("n_name").alias("code"))
    return quality.source_scope(source, base, pinned, base)


@query("dq_summary", """
SELECT rule, count(v) AS violations, count(v) = 0 AS passed FROM (
  SELECT 'unique' AS rule, p_name AS v FROM part GROUP BY p_name HAVING count(*) > 1
  UNION ALL SELECT 'reference', o_orderkey::VARCHAR FROM orders WHERE o_custkey * 9 // 8 NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT unnest(['unique', 'reference', 'required']), NULL) GROUP BY rule""")
def dq_summary(t: Tables) -> DataFrame:
    """Verdict per rule."""
    found = quality.all_of(dq_unique(t), dq_references(t), quality.required(t.places, t.places, "location_id"))
    return quality.summary(found, ["unique", "reference", "required"])
