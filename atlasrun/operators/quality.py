"""Data-quality rules. Every rule is a job that returns its violations as ``rule, entity, detail``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.names import name_key

# Path grammar and the reference prefixes a candidate may use.
PATH_PATTERN = r"^M[-0-9.,]+(?:L[-0-9.,]+)*Z$"
CANDIDATE_REF_PATTERN = r"^(ne:admin1|ne:map-unit|ne:map-subunit|gb:aze-adm1):"


def violations(rows: DataFrame, rule: str, entity: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def summary(found: DataFrame, rules: list[str]) -> DataFrame:
    """Violations and verdict of each of the named rules, also of those without violations."""
    names = found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    counted = found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return names.join(counted, "rule", "left").select(
        "rule", F.coalesce("violations", F.lit(0)).alias("violations"), (F.coalesce("violations", F.lit(0)) == 0).alias("passed"))


def unique(rows: DataFrame, key: str, rule: str = "unique") -> DataFrame:
    """A key value may occur once."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return violations(repeated, rule, F.col(key), F.col("n"))


def unique_refs(refs: DataFrame, owner: str = "location_id", ref: str = "feature_id", rule: str = "unique-refs") -> DataFrame:
    """An owner may name a reference once."""
    repeated = refs.groupBy(owner, ref).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return violations(repeated, rule, F.col(owner), F.col(ref))


def cardinality(actual: DataFrame, expected: DataFrame, rule: str = "cardinality") -> DataFrame:
    """Counts (``name, n``) against expected ones; a name without rows counts as 0."""
    counted = expected.select("name", F.col("n").alias("want")).join(actual.select("name", F.col("n").alias("have")), "name", "left")
    wrong = counted.where(F.coalesce("have", F.lit(0)) != F.col("want"))
    return violations(wrong, rule, F.col("name"), F.concat_ws("/", F.coalesce("have", F.lit(0)).cast("string"), F.col("want").cast("string")))


def references(refs: DataFrame, targets: DataFrame, owner: str, ref: str, target: str, rule: str = "reference") -> DataFrame:
    """Every reference must exist among the targets."""
    lost = refs.select(F.col(owner).alias("owner"), F.col(ref).alias("ref")).join(
        targets.select(F.col(target).alias("ref")), "ref", "left_anti")
    return violations(lost, rule, F.col("owner"), F.col("ref"))


def subset_per_owner(part: DataFrame, whole: DataFrame, owner: str, item: str, rule: str = "subset") -> DataFrame:
    """Each owner's items must be among the same owner's items in ``whole``."""
    stray = part.select(owner, item).join(whole.select(owner, item), [owner, item], "left_anti")
    return violations(stray, rule, F.col(owner), F.col(item))


def not_empty(rows: DataFrame, owners: DataFrame, owner: str, rule: str = "not-empty") -> DataFrame:
    """Every owner needs at least one row."""
    bare = owners.select(owner).join(rows.select(owner), owner, "left_anti")
    return violations(bare, rule, F.col(owner), F.lit("empty"))


def finite_bounds(rows: DataFrame, key: str, bounds: str = "bounds", rule: str = "bounds") -> DataFrame:
    """Bounds must be four finite numbers."""
    def odd(name: str) -> Column:
        value = F.col(f"{bounds}.{name}")
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    bad = rows.where(odd("min_x") | odd("min_y") | odd("max_x") | odd("max_y"))
    return violations(bad, rule, F.col(key), F.lit("not finite"))


def pattern(rows: DataFrame, key: str, text: str, expression: str, rule: str = "pattern") -> DataFrame:
    """A text must match the pattern; a missing one does not."""
    bad = rows.where(~F.coalesce(F.col(text).rlike(expression), F.lit(False)))
    return violations(bad, rule, F.col(key), F.coalesce(F.col(text), F.lit("")))


def same_keys(left: DataFrame, right: DataFrame, key: str, rule: str = "same-keys") -> DataFrame:
    """Both sides must have the same keys."""
    a = left.select(key).distinct().withColumn("_left", F.lit(True))
    b = right.select(key).distinct().withColumn("_right", F.lit(True))
    odd = a.join(b, key, "full_outer").where(F.col("_left").isNull() | F.col("_right").isNull())
    return violations(odd, rule, F.col(key), F.when(F.col("_left").isNull(), "only right").otherwise("only left"))


def disjoint(left: DataFrame, right: DataFrame, key: str, rule: str = "disjoint") -> DataFrame:
    """No key may be on both sides; with a list of forbidden ids on the right, none may be present."""
    shared = left.select(key).distinct().join(right.select(key), key, "left_semi")
    return violations(shared, rule, F.col(key), F.lit("on both sides"))


def parity(left: DataFrame, right: DataFrame, rule: str = "parity") -> DataFrame:
    """Two reference tables must agree in content and order, location by location."""
    a = left.select("location_id", "ref_pos", F.col("feature_id").alias("_a"))
    b = right.select("location_id", "ref_pos", F.col("feature_id").alias("_b"))
    odd = a.join(b, ["location_id", "ref_pos"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return violations(odd, rule, F.col("location_id"), F.concat_ws(":", F.col("ref_pos").cast("string"), F.coalesce("_a", F.lit("-")), F.coalesce("_b", F.lit("-"))))


def pinned_refs(actual: DataFrame, expected: DataFrame, rule: str = "pinned-refs") -> DataFrame:
    """Pinned locations must have exactly the pinned references, in order."""
    pinned = actual.join(expected.select("location_id"), "location_id", "left_semi")
    return parity(pinned, expected, rule)


def forbidden_refs(actual: DataFrame, forbidden: DataFrame, rule: str = "forbidden-refs") -> DataFrame:
    """Listed pairs of location and feature must not occur."""
    hit = actual.join(forbidden.select("location_id", "feature_id"), ["location_id", "feature_id"], "left_semi")
    return violations(hit, rule, F.col("location_id"), F.col("feature_id"))


def minimum_extent(rows: DataFrame, least: DataFrame, rule: str = "minimum-extent") -> DataFrame:
    """Locations (``bounds``) must be larger than the least width and height; absent ones fail too."""
    joined = least.join(rows.select("location_id", "bounds"), "location_id", "left")
    wide = (F.col("bounds.max_x") - F.col("bounds.min_x") > F.col("width")) & (F.col("bounds.max_y") - F.col("bounds.min_y") > F.col("height"))
    return violations(joined.where(~F.coalesce(wide, F.lit(False))), rule, F.col("location_id"), F.lit("too small"))


def ref_counts(refs: DataFrame, least: int, rule: str = "ref-count") -> DataFrame:
    """Every location in the table needs at least so many references."""
    few = refs.groupBy("location_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return violations(few, rule, F.col("location_id"), F.col("n"))


def required(rows: DataFrame, wanted: DataFrame, key: str, rule: str = "required") -> DataFrame:
    """Listed keys must be present."""
    return violations(wanted.select(key).join(rows.select(key), key, "left_anti"), rule, F.col(key), F.lit("missing"))


def ring_contract(rings: DataFrame, rule: str = "ring-contract") -> DataFrame:
    """Role, parent, counts and flags of a ring must fit together; projection must not spoil a ring."""
    flags = ("source_closed", "source_valid", "projected_valid", "induced_degenerate", "valid")
    missing = F.lit(False)
    for name in flags:
        missing = missing | F.col(name).isNull()
    area = F.col("area")
    bad_area = area.isNull() | F.isnan(area) | (F.abs(area) == float("inf"))
    problem = (F.when(F.coalesce("ring_id", F.lit("")) == "", "no id")
               .when(~F.coalesce(F.col("role").isin("exterior", "interior"), F.lit(False)), "role")
               .when((F.col("role") == "exterior") & F.col("parent_ring_id").isNotNull(), "exterior with parent")
               .when((F.col("role") == "interior") & (F.coalesce("parent_ring_id", F.lit("")) == ""), "interior without parent")
               .when(F.col("vertex_count").isNull(), "vertex count").when(bad_area, "area").when(missing, "flags")
               .when(F.col("induced_degenerate"), "induced degenerate"))
    checked = rings.withColumn("_problem", problem).where(F.col("_problem").isNotNull())
    return violations(checked, rule, F.col("ring_id"), F.col("_problem"))


def quiz_inputs(quizzes: DataFrame, members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Contract of quiz and catalog: ids and names not blank, ids unique, members unique and known,
    and no two members of a quiz with the same name key."""
    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""

    keyed = catalog.withColumn("_key", name_key(F.coalesce("name", F.lit(""))))
    named = members.select("quiz_id", "location_id").distinct().join(keyed.select("location_id", "_key"), "location_id")
    same = named.groupBy("quiz_id", "_key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("_key") != ""))
    return all_of(
        violations(quizzes.where(blank("quiz_id")), "quiz-id", F.coalesce(F.col("quiz_id"), F.lit("")), F.lit("blank")),
        violations(catalog.where(blank("location_id")), "catalog-id", F.coalesce(F.col("location_id"), F.lit("")), F.lit("blank")),
        unique(catalog, "location_id", "catalog-unique"),
        violations(keyed.where(F.col("_key") == ""), "catalog-name", F.col("location_id"), F.lit("empty name")),
        violations(same, "quiz-name-unique", F.col("quiz_id"), F.col("_key")),
        violations(members.where(blank("location_id")), "member-id", F.col("quiz_id"), F.lit("blank")),
        unique_refs(members, "quiz_id", "location_id", "member-unique"),
        references(members, catalog, "quiz_id", "location_id", "location_id", "member-known"))


def exactly_once(parts: DataFrame, whole: DataFrame, key: str = "location_id", rule: str = "exactly-once") -> DataFrame:
    """The parts must tile the whole: each key in exactly one part, none missing, none extra."""
    counted = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(
        whole.select(key).distinct().withColumn("_whole", F.lit(True)), key, "full_outer")
    odd = counted.where(F.col("n").isNull() | (F.col("n") != 1) | F.col("_whole").isNull())
    detail = F.when(F.col("_whole").isNull(), "extra").when(F.col("n").isNull(), "missing").otherwise("repeated")
    return violations(odd, rule, F.col(key), detail)


def contained(members: DataFrame, views: DataFrame, width: float = G.MAP_WIDTH, rule: str = "contained") -> DataFrame:
    """Members (``quiz_id, location_id, points``) must lie inside their quiz's view.

    Points past the middle of the world count one world further left, as the view does not wrap.
    """
    wrapped = F.transform("points", lambda p: G.point(F.when(p["x"] > width / 2, p["x"] - width).otherwise(p["x"]), p["y"]))
    boxed = members.select("quiz_id", "location_id", G.envelope(wrapped).alias("box")).groupBy("quiz_id", "location_id").agg(
        F.min("box.min_x").alias("x0"), F.min("box.min_y").alias("y0"), F.max("box.max_x").alias("x1"), F.max("box.max_y").alias("y1"))
    joined = boxed.join(views.select("quiz_id", "view"), "quiz_id")
    inside = ((F.col("x0") > F.col("view.min_x")) & (F.col("x1") < F.col("view.max_x"))
              & (F.col("y0") > F.col("view.min_y")) & (F.col("y1") < F.col("view.max_y")))
    return violations(joined.where(~inside), rule, F.col("location_id"), F.col("quiz_id"))


def overlapping(boxes: DataFrame, views: DataFrame, rule: str = "overlapping") -> DataFrame:
    """Named context extents (``quiz_id, feature_id, bounds``) must at least overlap the quiz's view."""
    joined = boxes.join(views.select("quiz_id", "view"), "quiz_id")
    meets = ((F.col("bounds.max_x") > F.col("view.min_x")) & (F.col("bounds.min_x") < F.col("view.max_x"))
             & (F.col("bounds.max_y") > F.col("view.min_y")) & (F.col("bounds.min_y") < F.col("view.max_y")))
    return violations(joined.where(~meets), rule, F.col("feature_id"), F.col("quiz_id"))


def source_scope(source: DataFrame, base: DataFrame, pinned: DataFrame, used: DataFrame) -> DataFrame:
    """Scope of a replacement source (``code, pos``): exactly the codes of ``pinned`` (``code, pos``), in order; each
    code in the base features; and as many replaced features (``used``) as base features with such a code."""
    pinned = pinned.select(F.col("pos").cast("bigint").alias("pos"), F.col("code").alias("want"))
    drift = source.select(F.col("pos").cast("bigint").alias("pos"), "code").join(pinned, "pos", "full_outer").where(
        ~F.col("code").eqNullSafe(F.col("want")))
    expected = base.join(source.select("code"), "code", "left_semi").agg(F.count(F.lit(1)).alias("want"))
    counted = expected.join(used.agg(F.count(F.lit(1)).alias("have"))).where("want <> have")
    return all_of(
        violations(drift, "scope", F.coalesce("code", F.lit("-")), F.coalesce("want", F.lit("-"))),
        references(source, base, "code", "code", "code", "scope-unmatched"),
        violations(counted, "scope-count", F.lit("replaced"), F.concat_ws("/", F.col("have").cast("string"), F.col("want").cast("string"))))
