"""Registered queries over names, features, catalog, candidates and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.numbers import fixed2_sql
from ..operators import resolve, search
from .registry import query, with_views
from .views import CANDIDATES, FEATURES, MEMBERS, PART_FEATURES, PLACES, QUIZZES, Tables

NAME_KEY = "regexp_replace(strip_accents(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))), '\\p{{P}}', '', 'g')"
LABEL_KEY = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '', 'g')"


@query("name_key", f"SELECT doc_id, {NAME_KEY.format('text')} AS name_key FROM documents")
def name_key(t: Tables) -> DataFrame:
    """Name key of whole texts."""
    return t.texts.select("doc_id", names.name_key(F.col("text")).alias("name_key"))


@query("label_key", f"SELECT doc_id, {LABEL_KEY.format('text')} AS label_key FROM documents")
def label_key(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", names.label_key(F.col("text")).alias("label_key"))


# Letters with a mark: the plain letter, then a dash; ß has no decomposition and is no ASCII letter.
_PLAIN = "regexp_replace(regexp_replace({0}, '([éèêëáàâäãåíìîïóòôöõúùûüçñýÿÉÈÊËÁÀÂÄÃÅÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ])', '\\1~', 'g'), '^', '')"


@query("slug_id", "SELECT doc_id, 'non-un:' || lower(regexp_replace(regexp_replace(strip_accents(" + _PLAIN.format("text")
       + "), '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents")
def slug_id(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", names.slug_id(F.col("text")).alias("slug"))


@query("label_split", """
SELECT doc_id, label FROM (SELECT doc_id, unnest(regexp_split_to_array(lang || '|' || source || ';' || text, '[|;]')) AS label FROM documents)
WHERE label <> ''""")
def label_split(t: Tables) -> DataFrame:
    """Labels of multi-valued texts."""
    joined = F.concat_ws(";", F.concat_ws("|", "lang", "source"), "text")
    return t.read("documents").select("doc_id", F.explode(names.split_labels(joined)).alias("label"))


@query("feature_keys", with_views(FEATURES, body="""
SELECT DISTINCT feature_id, key FROM (SELECT feature_id, unnest([code, group_code, '-99', '', code]) AS key FROM features) WHERE key NOT IN ('', '-99')"""))
def feature_keys(t: Tables) -> DataFrame:
    """Usable codes of each feature."""
    return _features(t).select("feature_id", F.explode("keys").alias("key"))


def _features(t: Tables) -> DataFrame:
    keys = names.code_keys(F.col("code"), F.col("group_code"), F.lit("-99"), F.lit(""), F.lit(None).cast("string"), F.col("code"))
    box = F.struct((F.col("anchor.x") - 1).alias("min_x"), (F.col("anchor.y") - 1).alias("min_y"),
                   (F.col("anchor.x") + 2).alias("max_x"), (F.col("anchor.y") + 2).alias("max_y"))
    return t.features.withColumns({"keys": keys, "bounds": box})


@query("feature_ids", """
SELECT s_suppkey, 'ne:admin1:' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS feature_id FROM supplier""")
def feature_ids(t: Tables) -> DataFrame:
    """Namespaced id from the first id present."""
    first = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey"))
    return t.read("supplier").select("s_suppkey", names.feature_id(F.lit("ne"), F.lit("admin1"), first, F.col("s_name")).alias("feature_id"))


@query("key_index", with_views(FEATURES, body="""
SELECT key, count(*) AS features, min(feature_pos) AS first_pos FROM (
  SELECT code AS key, feature_pos FROM features UNION ALL SELECT group_code, feature_pos FROM features) GROUP BY key"""))
def key_index(t: Tables) -> DataFrame:
    """Inverted key index, summed up per key."""
    return resolve.key_index(_features(t)).groupBy("key").agg(F.count(F.lit(1)).alias("features"), F.min("feature_pos").alias("first_pos"))


@query("resolve_catalog", with_views(FEATURES, PLACES, body="""
SELECT location_id, feature_id FROM places JOIN features ON code = iso3"""))
def resolve_catalog(t: Tables) -> DataFrame:
    """Features of every catalog location."""
    return resolve.match_catalog(t.places, _features(t)).select("location_id", "feature_id")


@query("resolve_missing", with_views(FEATURES, """codes AS (
  SELECT n_name AS iso3 FROM nation UNION ALL SELECT r_name FROM region)""", body="""
SELECT 'iso:' || iso3 AS location_id FROM codes WHERE iso3 NOT IN (SELECT code FROM features)"""))
def resolve_missing(t: Tables) -> DataFrame:
    """Catalog rows without a feature; regions stand for unknown codes."""
    catalog = t.places.select("location_id", "iso3").unionByName(
        t.read("region").select(F.concat(F.lit("iso:"), "r_name").alias("location_id"), F.col("r_name").alias("iso3")))
    return resolve.unmatched(catalog, resolve.match_catalog(catalog, _features(t))).select("location_id")


OVERRIDES = """overrides AS (
  SELECT 'iso:' || n_name AS location_id, 'ne:' || s_suppkey AS feature_id, s_suppkey AS ref_pos
  FROM supplier JOIN nation ON n_nationkey = (s_suppkey + 1) % 25 WHERE n_regionkey = 2)"""
REFS = """refs AS (
  SELECT location_id, feature_id, feature_pos AS ref_pos FROM places JOIN features ON code = iso3
  WHERE location_id NOT IN (SELECT location_id FROM overrides)
  UNION ALL SELECT location_id, feature_id, ref_pos FROM overrides SEMI JOIN places USING (location_id))"""


def _overrides(t: Tables) -> DataFrame:
    """Reviewed references: the locations of one region take their neighbour's features."""
    supplier, nation = t.read("supplier"), t.read("nation").where(F.col("n_regionkey") == 2)
    return supplier.join(nation, F.col("n_nationkey") == (F.col("s_suppkey") + 1) % 25).select(
        F.concat(F.lit("iso:"), "n_name").alias("location_id"), F.concat(F.lit("ne:"), F.col("s_suppkey").cast("string")).alias("feature_id"),
        F.col("s_suppkey").alias("ref_pos"))


def _refs(t: Tables) -> DataFrame:
    return resolve.apply_overrides(resolve.match_catalog(t.places, _features(t)), _overrides(t), t.places)


@query("resolve_overrides", with_views(FEATURES, PLACES, OVERRIDES, REFS, body="SELECT * FROM refs"))
def resolve_overrides(t: Tables) -> DataFrame:
    """References after reviewed overrides."""
    return _refs(t)


@query("packed_refs", with_views(FEATURES, PLACES, OVERRIDES, REFS, body="""
SELECT location_id, ref_pos // 4 AS pack, string_agg(feature_id, ' ' ORDER BY ref_pos) AS geometry_refs FROM refs GROUP BY location_id, ref_pos // 4"""))
def packed_refs(t: Tables) -> DataFrame:
    """References as arrays of bounded length."""
    return resolve.pack_refs(_refs(t), 4).withColumn("geometry_refs", F.array_join("geometry_refs", " "))


@query("location_shapes", with_views(FEATURES, PLACES, body=f"""
SELECT location_id, {fixed2_sql('mx')} AS x, {fixed2_sql('my')} AS y, min_x, min_y, max_x, max_y FROM (
  SELECT location_id, avg(ax) AS mx, avg(ay) AS my, min(ax - 1) AS min_x, min(ay - 1) AS min_y, max(ax + 2) AS max_x, max(ay + 2) AS max_y
  FROM places JOIN features ON code = iso3 GROUP BY location_id)"""))
def location_shapes(t: Tables) -> DataFrame:
    """Mean anchor and envelope of every location."""
    features = _features(t)
    return resolve.location_shapes(resolve.match_catalog(t.places, features), features).select(
        "location_id", "anchor.x", "anchor.y", "bounds.min_x", "bounds.min_y", "bounds.max_x", "bounds.max_y")


@query("preferred_geometry", with_views(PART_FEATURES, body="""
SELECT feature_id, coalesce(g, 'base ' || feature_pos) AS geometry, CASE WHEN g IS NULL THEN 'admin1' ELSE 'gb:preferred' END AS geometry_source
FROM part_features LEFT JOIN (SELECT p_brand AS b, 'better ' || max(p_partkey) AS g FROM part WHERE p_size % 3 > 0 AND p_brand LIKE '%1' GROUP BY p_brand) ON b = code"""))
def preferred_geometry(t: Tables) -> DataFrame:
    """Features with a preferred geometry, the last one, for some codes, and its lineage."""
    base = t.part_features.select("feature_id", "code", F.lit("admin1").alias("source"),
                                  F.concat(F.lit("base "), F.col("feature_pos").cast("string")).alias("geometry"))
    better = t.read("part").where((F.col("p_size") % 3 > 0) & F.col("p_brand").endswith("1")).select(
        F.col("p_brand").alias("code"), F.col("p_partkey").alias("feature_pos"), F.concat(F.lit("better "), F.col("p_partkey").cast("string")).alias("geometry"))
    return resolve.prefer_geometry(base, better, "gb:preferred").select("feature_id", "geometry", "geometry_source")


# Candidates: names beginning with "small" have exact references, those with "red" component keys.
TIERS = f"""exact_refs AS (SELECT label AS name, arg_min(feature_id, feature_pos) AS feature_id FROM part_features WHERE label LIKE 'small%' GROUP BY label),
part_keys AS (SELECT name, unnest([code, 'Brand#1']) AS key, unnest([0, 1])::BIGINT AS key_pos FROM candidates WHERE name LIKE 'red%' OR name LIKE 'small r%'),
matched AS (
  SELECT name, feature_id, 0::BIGINT AS key_pos, 'exact' AS tier FROM exact_refs SEMI JOIN candidates USING (name)
  UNION ALL
  SELECT name, feature_id, key_pos, 'parts' FROM part_keys JOIN part_features ON code = key WHERE name NOT IN (SELECT name FROM exact_refs)
  UNION ALL
  SELECT DISTINCT name, feature_id, 0, 'match' FROM candidates c JOIN part_features f
    ON f.code = c.code OR {LABEL_KEY.format('f.label')} IN ({LABEL_KEY.format('c.name')}, {LABEL_KEY.format('c.code')})
  WHERE name NOT IN (SELECT name FROM exact_refs) AND name NOT IN (SELECT name FROM part_keys))"""


def _supplement(t: Tables) -> DataFrame:
    return t.part_features.withColumns({
        "keys": F.array("code"), "labels": F.array("label"), "source_codes": F.array(F.concat("code", F.lit("-x")))})


def _candidates(t: Tables) -> DataFrame:
    return t.candidates.withColumns({"codes": F.array("code"), "iso2": F.lit(None).cast("string")})


def _exact(t: Tables) -> DataFrame:
    return t.part_features.where(F.col("label").startswith("small")).groupBy(F.col("label").alias("name")).agg(
        F.min_by("feature_id", "feature_pos").alias("feature_id"))


def _part_keys(t: Tables) -> DataFrame:
    chosen = t.candidates.where(F.col("name").startswith("red") | F.col("name").startswith("small r"))
    return chosen.select("name", F.posexplode(F.array("code", F.lit("Brand#1"))).alias("key_pos", "key"))


def _matched(t: Tables) -> DataFrame:
    return resolve.candidate_matches(_candidates(t), _supplement(t), _exact(t), _part_keys(t))


@query("resolve_candidates", with_views(PART_FEATURES, CANDIDATES, TIERS, body="SELECT * FROM matched"))
def resolve_candidates(t: Tables) -> DataFrame:
    """Features of every candidate, by exact reference, component keys, or code and label."""
    return _matched(t).select("name", "feature_id", "key_pos", "tier")


@query("candidate_summary", with_views(PART_FEATURES, CANDIDATES, TIERS, body="""
SELECT name, tier, count(*) AS refs, min(feature_pos) AS first_pos FROM matched JOIN part_features USING (feature_id) GROUP BY name, tier"""))
def candidate_summary(t: Tables) -> DataFrame:
    return _matched(t).groupBy("name", "tier").agg(F.count(F.lit(1)).alias("refs"), F.min("feature_pos").alias("first_pos"))


@query("resolve_ambiguous", with_views(PART_FEATURES, CANDIDATES, TIERS, body=f"""
SELECT m.name, m.feature_id FROM matched m JOIN candidates c USING (name) JOIN part_features f USING (feature_id)
WHERE m.tier = 'match' AND {LABEL_KEY.format('f.label')} IN ({LABEL_KEY.format('m.name')}, {LABEL_KEY.format('c.code')})
  AND f.code <> c.code"""))
def resolve_ambiguous(t: Tables) -> DataFrame:
    """Label matches whose country code contradicts the candidate's."""
    return resolve.ambiguous_matches(_candidates(t), _supplement(t), _matched(t))


@query("referenced_features", with_views(FEATURES, PLACES, OVERRIDES, REFS, body="""
SELECT feature_id, code FROM features WHERE feature_id IN (SELECT feature_id FROM refs)"""))
def referenced_features(t: Tables) -> DataFrame:
    return resolve.only_referenced(_features(t), _refs(t)).select("feature_id", "code")


@query("all_references", with_views(FEATURES, PLACES, OVERRIDES, REFS, PART_FEATURES, CANDIDATES, TIERS, body="""
SELECT feature_id FROM refs UNION SELECT feature_id FROM matched"""))
def all_references(t: Tables) -> DataFrame:
    """Distinct union of the references of two tables."""
    return resolve.all_references(_refs(t), _matched(t))


@query("context_layer", with_views(FEATURES, QUIZZES, MEMBERS, body="""
SELECT feature_id FROM features WHERE code NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)"""))
def context_layer(t: Tables) -> DataFrame:
    """Context features of a quiz without its exclusions."""
    excluded = t.features.join(t.read("nation").where(F.col("n_regionkey") == 1), F.col("code") == F.col("n_name")).select("feature_id")
    return resolve.without_excluded(t.features, excluded).select("feature_id")


PATHS = """paths AS (
  SELECT feature_id, k AS path_pos, feature_id || '/' || k AS path FROM features, (SELECT unnest(range(3)) AS k) WHERE k <= feature_pos % 3)"""


def _paths(t: Tables) -> DataFrame:
    """One to three paths per feature."""
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("feature_pos") % 3)).alias("path_pos")
    return t.features.select("feature_id", places).withColumn(
        "path", F.concat_ws("/", "feature_id", F.col("path_pos").cast("string")))


@query("layer_paths", with_views(FEATURES, PLACES, OVERRIDES, REFS, PATHS, body="""
SELECT location_id, ref_pos, path_pos, path FROM refs JOIN paths USING (feature_id)"""))
def layer_paths(t: Tables) -> DataFrame:
    """Paths of every location in reference order."""
    return resolve.expand_refs(_refs(t), _paths(t)).select("location_id", "ref_pos", "path_pos", "path")


@query("quiz_paths", with_views(FEATURES, PLACES, OVERRIDES, REFS, PATHS, MEMBERS, body="""
SELECT quiz_id, location_id, pos AS member_pos, ref_pos, path_pos, path FROM members JOIN refs USING (location_id) JOIN paths USING (feature_id)"""))
def quiz_paths(t: Tables) -> DataFrame:
    """Paths of every quiz over its members."""
    return resolve.quiz_paths(t.members, _refs(t), _paths(t))


@query("first_quiz", with_views(PLACES, QUIZZES, MEMBERS, body="""
SELECT location_id, coalesce(quiz_id, 'world') AS quiz_id FROM places LEFT JOIN (
  SELECT location_id, arg_min(quiz_id, quiz_pos) AS quiz_id FROM members JOIN quizzes USING (quiz_id) WHERE quiz_id <> 'world' AND quiz_id <> 'ASIA'
  GROUP BY location_id) USING (location_id)"""))
def first_quiz(t: Tables) -> DataFrame:
    """First regional quiz of every location; those of one region fall back to the world quiz."""
    members = t.members.where(~F.col("quiz_id").isin("world", "ASIA"))
    return resolve.first_quiz(t.places, members, t.quizzes)


DETAIL = """mixed AS (
  SELECT location_id, CASE WHEN pos % 2 = 0 THEN iso3 END AS iso3 FROM places),
detail AS (
  SELECT location_id, feature_id, feature_pos AS ref_pos FROM mixed JOIN features ON code = iso3
  UNION ALL SELECT location_id, feature_id, ref_pos FROM refs SEMI JOIN (SELECT location_id FROM mixed WHERE iso3 IS NULL) USING (location_id))"""


def _mixed(t: Tables) -> DataFrame:
    """Locations of which every other one has a code."""
    return t.places.withColumn("iso3", F.when(F.col("pos") % 2 == 0, F.col("iso3")))


@query("detail_index", with_views(FEATURES, PLACES, OVERRIDES, REFS, DETAIL, body="SELECT * FROM detail"))
def detail_index(t: Tables) -> DataFrame:
    """References into the detailed features, by key or own reference."""
    return resolve.detail_index(_mixed(t), _refs(t), _features(t))


@query("detail_problems", with_views(FEATURES, PLACES, OVERRIDES, REFS, DETAIL, body="""
SELECT location_id, NULL AS feature_id FROM places WHERE location_id NOT IN (SELECT location_id FROM detail)
UNION ALL SELECT location_id, feature_id FROM detail WHERE feature_id NOT IN (SELECT feature_id FROM features WHERE group_code <> 'S3')"""))
def detail_problems(t: Tables) -> DataFrame:
    """References whose detailed feature is absent; one group of features is left out."""
    index = resolve.detail_index(_mixed(t), _refs(t), _features(t))
    return resolve.detail_problems(t.places, index, t.features.where(F.col("group_code") != "S3"))


ANSWERS = """answers AS (
  SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'world' WHEN 1 THEN 'ASIA' ELSE 'EUROPE' END AS quiz_id,
         CASE WHEN event_id % 4 = 0 THEN 'iso:NATION_' || (event_id % 31) END AS selected_id,
         CASE WHEN event_id % 5 > 0 THEN ' Nation-' || (event_id % 29) || '!' END AS text FROM events)"""


def _answers(t: Tables) -> DataFrame:
    event = F.col("event_id")
    quiz = F.when(F.col("user_id") % 3 == 0, "world").when(F.col("user_id") % 3 == 1, "ASIA").otherwise("EUROPE")
    return t.read("events").select(
        "event_id", quiz.alias("quiz_id"), F.when(event % 4 == 0, F.concat(F.lit("iso:NATION_"), (event % 31).cast("string"))).alias("selected_id"),
        F.when(event % 5 > 0, F.concat(F.lit(" Nation-"), (event % 29).cast("string"), F.lit("!"))).alias("text"))


@query("resolve_answers", with_views(MEMBERS, ANSWERS, """scoped AS (
  SELECT quiz_id, location_id, replace(lower(substr(location_id, 5)), '_', '') AS key FROM members)""", body="""
SELECT event_id, CASE WHEN selected_id IS NOT NULL THEN s.location_id ELSE n.location_id END AS answer_id
FROM answers a LEFT JOIN scoped s ON s.quiz_id = a.quiz_id AND s.location_id = a.selected_id
     LEFT JOIN scoped n ON n.quiz_id = a.quiz_id AND n.key = replace(replace(lower(trim(a.text)), '-', ''), '!', '')"""))
def resolve_answers(t: Tables) -> DataFrame:
    """Answers by selected id or typed name, within the quiz."""
    scoped = resolve.member_locations(t.members, t.places)
    return resolve.resolve_answers(_answers(t), scoped).select("event_id", "answer_id")


@query("scope_members", with_views(PLACES, MEMBERS, body="""
SELECT location_id, name, pos FROM places WHERE location_id IN (SELECT location_id FROM members WHERE quiz_id = 'ASIA')"""))
def scope_members(t: Tables) -> DataFrame:
    return resolve.scope(t.places, t.members, "ASIA").select("location_id", "name", "pos")


@query("member_locations", with_views(PLACES, MEMBERS, body="""
SELECT quiz_id, location_id, m.pos AS member_pos, name FROM members m JOIN places USING (location_id)"""))
def member_locations(t: Tables) -> DataFrame:
    """Ordered members of every quiz with their names."""
    return resolve.member_locations(t.members, t.places).select("quiz_id", "location_id", "member_pos", "name")


ALL_LOCATIONS = """all_locations AS (
  SELECT location_id, name, 'catalog' AS kind FROM places
  UNION ALL SELECT 'non-un:' || replace(name, ' ', '-'), name, 'candidate' FROM candidates
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'configured' FROM supplier)"""


def _all_locations(t: Tables) -> DataFrame:
    return resolve.all_locations(
        t.places.select("location_id", "name", F.lit("catalog").alias("kind")),
        t.candidates.select(names.slug_id(F.col("name")).alias("location_id"), "name", F.lit("candidate").alias("kind")),
        t.read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("location_id"),
                                  F.col("s_name").alias("name"), F.lit("configured").alias("kind")))


@query("union_locations", with_views(PLACES, CANDIDATES, ALL_LOCATIONS, body="SELECT * FROM all_locations"))
def union_locations(t: Tables) -> DataFrame:
    return _all_locations(t)


@query("selection_counts", with_views(PLACES, CANDIDATES, ALL_LOCATIONS, body="""
SELECT count(*) FILTER (WHERE kind = 'catalog') AS standard, count(*) FILTER (WHERE kind = 'candidate') AS candidates,
       count(*) FILTER (WHERE kind = 'configured') AS configured, count(*) AS total FROM all_locations"""))
def selection_counts(t: Tables) -> DataFrame:
    return resolve.selection_counts(_all_locations(t))


@query("configured_locations", with_views(PLACES, CANDIDATES, ALL_LOCATIONS, body="""
SELECT location_id FROM all_locations WHERE location_id NOT IN (SELECT location_id FROM all_locations WHERE kind IN ('catalog', 'candidate'))"""))
def configured_locations(t: Tables) -> DataFrame:
    """All locations minus the playable ones."""
    everything = _all_locations(t)
    return resolve.difference(everything, everything.where(F.col("kind").isin("catalog", "candidate"))).select("location_id")


@query("category_split", with_views(QUIZZES, body="SELECT quiz_id, category IS NOT DISTINCT FROM 'regional' AS regional FROM quizzes"))
def category_split(t: Tables) -> DataFrame:
    return t.quizzes.select("quiz_id", resolve.is_regional(F.col("category")).alias("regional"))


@query("category_sections", with_views(QUIZZES, body="""
SELECT coalesce(category, 'global') AS category, min(quiz_pos) OVER (PARTITION BY coalesce(category, 'global')) AS section_pos, quiz_id, quiz_pos FROM quizzes"""))
def category_sections(t: Tables) -> DataFrame:
    return resolve.category_sections(t.quizzes)


@query("quiz_config", with_views(QUIZZES, body="""
SELECT quiz_id, coalesce(category, 'global') AS category, CASE WHEN category IS NULL THEN 'Global quizzes' ELSE 'Regional quizzes' END AS section,
       replace(name, ' UN Countries', '') AS title,
       CASE WHEN quiz_id = 'world' THEN 'All UN Member and UN Observer states' WHEN quiz_pos = 2 THEN 'text of AMERICA'
            ELSE 'UN Member and UN Observer states in ' || replace(name, ' UN Countries', '') END AS description,
       CASE WHEN quiz_pos = 3 THEN 0.0 ELSE 152.0 END::DOUBLE AS seam_longitude, CASE WHEN quiz_pos = 3 THEN 38.0 ELSE 0.0 END::DOUBLE AS standard_parallel,
       1440.0::DOUBLE AS wrap_width, CASE WHEN quiz_pos = 3 THEN -100.0 + 671.5 END::DOUBLE AS view_max_x, quiz_pos = 3 AS selectable
FROM quizzes"""))
def quiz_config(t: Tables) -> DataFrame:
    """Texts and map settings of every quiz, defaults filled in."""
    third, fourth = F.col("quiz_pos") == 3, F.col("quiz_pos") == 4
    settings = F.struct(
        F.when(third, "-100 35 671.5 295").when(fourth, "1 2 x 4").alias("view_box"), F.lit("xMidYMid meet").alias("preserve_aspect_ratio"),
        F.when(third, 38.0).alias("standard_parallel"), F.lit(None).cast("double").alias("wrap_width"),
        F.when(third, 0.0).alias("seam_longitude"), F.lit(None).cast("boolean").alias("wrap_active"), F.when(third, True).alias("selectable"))
    rows = t.quizzes.withColumns({"description": F.when(F.col("quiz_pos") == 2, F.concat(F.lit("text of "), "quiz_id")),
                                  "map": F.when(third | fourth, settings)})
    texts = resolve.quiz_texts(rows).select("quiz_id", "category", "section", "title", "description")
    maps = resolve.quiz_maps(rows).select("quiz_id", "seam_longitude", "standard_parallel", "wrap_width", F.col("view.max_x").alias("view_max_x"), "selectable")
    return texts.join(maps, "quiz_id")


# --- search ----------------------------------------------------------------------------------

SEARCH = f"""catalog AS (
  SELECT 's' || s_suppkey AS item_id, s_name AS name, s_suppkey AS pos FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_name, 1000000000 + c_custkey FROM customer
  UNION ALL SELECT 'p' || min(p_partkey), p_name, 2000000000 + min(p_partkey) FROM part GROUP BY p_name),
asked AS (
  SELECT 'c' || c_custkey AS query_id, right(c_name, 4) AS text FROM customer
  UNION ALL SELECT 's' || s_suppkey, ' ' || upper(s_name) || '!' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, substr('abcdefghijklmnopqrstuvwxyz', (n_nationkey + 1)::INT, (n_nationkey % 4)::INT) FROM nation
  UNION ALL SELECT 'w' || p_partkey, p_name FROM part),
keyed AS (SELECT *, {NAME_KEY.format('name')} AS name_key FROM catalog),
asked_keys AS (SELECT *, {NAME_KEY.format('text')} AS key FROM asked),
key_set AS (SELECT DISTINCT key FROM asked_keys),
best AS (
  SELECT key, item_id, row_number() OVER (PARTITION BY key ORDER BY name_key = key DESC, lower(name), pos) AS rank
  FROM key_set JOIN keyed ON contains(name_key, key) WHERE key <> ''
  UNION ALL SELECT '', item_id, row_number() OVER (ORDER BY pos) FROM keyed)"""


@query("suggest", with_views(SEARCH, body="SELECT query_id, rank, item_id FROM asked_keys JOIN best USING (key) WHERE rank <= 8"))
def suggest(t: Tables) -> DataFrame:
    """Suggestions for many queries over suppliers, customers and parts."""
    def tag(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    supplier, customer, part, nation = (t.read(n) for n in ("supplier", "customer", "part", "nation"))
    first_part = part.groupBy("p_name").agg(F.min("p_partkey").alias("key"))
    catalog = (supplier.select(tag("s", "s_suppkey").alias("item_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))
               .unionByName(customer.select(tag("c", "c_custkey").alias("item_id"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1000000000).alias("pos")))
               .unionByName(first_part.select(tag("p", "key").alias("item_id"), F.col("p_name").alias("name"), (F.col("key") + 2000000000).alias("pos"))))
    letters = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("n_nationkey") + 1, F.col("n_nationkey") % 4)
    asked = (customer.select(tag("c", "c_custkey").alias("query_id"), F.right("c_name", F.lit(4)).alias("text"))
             .unionByName(supplier.select(tag("s", "s_suppkey").alias("query_id"), F.concat(F.lit(" "), F.upper("s_name"), F.lit("!")).alias("text")))
             .unionByName(nation.select(tag("n", "n_nationkey").alias("query_id"), letters.alias("text")))
             .unionByName(part.select(tag("w", "p_partkey").alias("query_id"), F.col("p_name").alias("text"))))
    return search.suggest(asked, catalog).select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id")


@query("names_containing", f"SELECT p_partkey AS item_id, p_name AS name FROM part WHERE contains({NAME_KEY.format('p_name')}, 'in')")
def names_containing(t: Tables) -> DataFrame:
    return search.names_containing(t.read("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")), "-IN ")
