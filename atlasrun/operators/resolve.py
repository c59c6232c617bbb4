"""Resolving catalog rows, candidates and answers to boundary features.

Tables: features ``(feature_id, feature_pos, keys, labels, source_codes, ...)``, catalog
``(location_id, iso3, name, pos)``, references ``(location_id, feature_id, ref_pos)``. References stay
one row each; :func:`pack_refs` makes arrays of bounded length for documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.names import country_code, country_codes, label_key, name_key
from ..functions.numbers import fixed2

PACK = 1 << 16


def key_index(features: DataFrame) -> DataFrame:
    """``(key, feature_id, feature_pos)``: the features of each key, a feature once per key."""
    return features.select(F.explode(F.array_distinct("keys")).alias("key"), "feature_id", "feature_pos")


def label_index(features: DataFrame) -> DataFrame:
    """``(label_key, feature_id, feature_pos)`` from the labels of the features.

    A label without a letter or digit of the key's alphabet has an empty key. Such labels say nothing about each
    other, so they match nothing here; :func:`keyless_labels` reports them.
    """
    labels = features.select("feature_id", "feature_pos", F.explode("labels").alias("label"))
    return labels.select(label_key(F.col("label")).alias("label_key"), "feature_id", "feature_pos").where("label_key <> ''").distinct()


def keyless_labels(features: DataFrame) -> DataFrame:
    """Violations: labels of features with an empty key, which no candidate can match."""
    labels = features.select("feature_id", F.explode("labels").alias("label")).where(label_key(F.col("label")) == "")
    return labels.select(F.lit("keyless-label").alias("rule"), F.col("feature_id").cast("string").alias("entity"), F.col("label").alias("detail"))


def match_catalog(catalog: DataFrame, features: DataFrame) -> DataFrame:
    """Features of each catalog row by any of their keys."""
    return (catalog.select("location_id", F.col("iso3").alias("key")).join(key_index(features), "key")
            .select("location_id", "feature_id", F.col("feature_pos").alias("ref_pos")))


def unmatched(catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """Catalog rows that no feature matches: an error for the caller to report."""
    return catalog.join(matches.select("location_id"), "location_id", "left_anti")


def apply_overrides(matches: DataFrame, overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reviewed references (``location_id, feature_id, ref_pos``) replace the matched ones."""
    kept = matches.join(overrides.select("location_id"), "location_id", "left_anti")
    reviewed = overrides.join(catalog.select("location_id"), "location_id", "left_semi")
    return kept.select("location_id", "feature_id", "ref_pos").unionByName(reviewed.select("location_id", "feature_id", "ref_pos"))


def override_rows(overrides: DataFrame) -> DataFrame:
    """A ``MAP<location, ARRAY<feature>>`` column named ``overrides`` as reference rows."""
    pairs = overrides.select(F.explode("overrides").alias("location_id", "refs"))
    return pairs.select("location_id", F.posexplode("refs").alias("ref_pos", "feature_id")).select(
        "location_id", "feature_id", F.col("ref_pos").cast("bigint").alias("ref_pos"))


def prefer_geometry(features: DataFrame, preferred: DataFrame, lineage: str) -> DataFrame:
    """Use the preferred geometry of a code where there is one, and note where it came from.

    ``preferred`` has ``code, feature_pos, geometry``; of a repeated code the last one counts.
    """
    better = preferred.groupBy("code").agg(F.max_by("geometry", "feature_pos").alias("_geometry"), F.lit(True).alias("_found"))
    joined = features.join(better, "code", "left")
    return joined.withColumns({
        "geometry": F.coalesce("_geometry", "geometry"),
        "geometry_source": F.when(F.col("_found"), F.lit(lineage)).otherwise(F.col("source"))}).drop("_geometry", "_found")


def location_shapes(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Mean anchor and envelope of each location over its matched features."""
    joined = matches.join(features.select("feature_id", "anchor", "bounds"), "feature_id")
    return joined.groupBy("location_id").agg(
        F.struct(fixed2(F.avg("anchor.x")).alias("x"), fixed2(F.avg("anchor.y")).alias("y")).alias("anchor"),
        F.struct(F.min("bounds.min_x").alias("min_x"), F.min("bounds.min_y").alias("min_y"),
                 F.max("bounds.max_x").alias("max_x"), F.max("bounds.max_y").alias("max_y")).alias("bounds"))


def candidate_matches(candidates: DataFrame, features: DataFrame, exact: DataFrame, parts: DataFrame,
                      aliases: DataFrame | None = None) -> DataFrame:
    """Features of each candidate (``name, codes, iso2``) by the first rule that applies to it.

    1. ``exact`` (``name, feature_id``): the listed features.
    2. ``parts`` (``name, key, key_pos``): all features with a listed key.
    3. Otherwise a key equal to a declared code, or a label equal to the name, a code or an alias.

    Rule 3 is a union of two equi-joins; as one join with OR it would compare everything with
    everything. Result: ``name, feature_id, feature_pos, key_pos, tier``.
    """
    listed = candidates.select("name").join(exact, "name").join(features.select("feature_id", "feature_pos"), "feature_id").select(
        "name", "feature_id", "feature_pos", F.lit(0).cast("bigint").alias("key_pos"), F.lit("exact").alias("tier"))

    rest = candidates.join(exact.select("name"), "name", "left_anti")
    index = key_index(features)
    composed = rest.select("name").join(parts, "name").join(index, "key").select(
        "name", "feature_id", "feature_pos", F.col("key_pos").cast("bigint").alias("key_pos"), F.lit("parts").alias("tier"))

    open_ = rest.join(parts.select("name"), "name", "left_anti")
    codes = open_.select("name", F.explode(declared_codes()).alias("key"))
    by_code = codes.join(index, "key").select("name", "feature_id", "feature_pos")
    by_label = candidate_labels(open_, aliases).join(label_index(features), "label_key").select("name", "feature_id", "feature_pos")
    matched = by_code.unionByName(by_label).distinct().select(
        "name", "feature_id", "feature_pos", F.lit(0).cast("bigint").alias("key_pos"), F.lit("match").alias("tier"))
    return listed.unionByName(composed).unionByName(matched)


def declared_codes() -> Column:
    """Codes of a candidate row with the country code among them."""
    return F.array_distinct(F.filter(F.concat("codes", F.array("iso2")), lambda c: c.isNotNull() & (c != "")))


def candidate_labels(candidates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(name, label_key)``: the keys of a candidate's name, codes and aliases."""
    own = candidates.select("name", F.explode(F.concat(F.array("name"), "codes")).alias("label"))
    if aliases is not None:
        extra = aliases.join(candidates.select("name"), "name", "left_semi").select("name", F.col("alias").alias("label"))
        own = own.unionByName(extra)
    return own.select("name", label_key(F.col("label")).alias("label_key")).where("label_key <> ''").distinct()


def ambiguous_matches(candidates: DataFrame, features: DataFrame, matches: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rule-3 matches by label whose known country codes all contradict the declared ones."""
    expected = F.array_distinct(F.transform(
        F.filter(F.concat(F.array("iso2"), F.transform("codes", lambda c: F.substring_index(c, "-", 1))),
                 lambda c: c.isNotNull() & (c != "")), F.upper))
    wanted = candidates.select("name", expected.alias("expected"))
    whole = F.transform("source_codes", lambda c: F.upper(c))
    known = features.select("feature_id", country_codes(F.col("source_codes")).alias("known"),
                            F.concat(whole, F.transform("source_codes", country_code)).alias("all_codes"))
    labelled = candidate_labels(candidates, aliases).join(label_index(features), "label_key").select("name", "feature_id").distinct()
    rows = (matches.where(F.col("tier") == "match").join(labelled, ["name", "feature_id"], "left_semi")
            .join(wanted, "name").join(known, "feature_id"))
    clash = (~F.arrays_overlap("all_codes", "expected") & (F.size("known") > 0) & ~F.arrays_overlap("known", "expected"))
    return rows.where(clash).select("name", "feature_id")


def only_referenced(features: DataFrame, *references: DataFrame) -> DataFrame:
    """Features that any of the reference tables names."""
    return features.join(all_references(*references), "feature_id", "left_semi")


def all_references(*references: DataFrame) -> DataFrame:
    """Distinct union of the referenced feature ids."""
    ids = references[0].select("feature_id")
    for more in references[1:]:
        ids = ids.union(more.select("feature_id"))
    return ids.distinct()


def without_excluded(features: DataFrame, exclusions: DataFrame) -> DataFrame:
    """All features but the excluded ones."""
    return features.join(exclusions.select("feature_id"), "feature_id", "left_anti")


def expand_refs(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of each location in reference order: ``location_id, ref_pos, path_pos, path``."""
    return refs.join(paths, "feature_id").select("location_id", "ref_pos", "path_pos", "feature_id", "path")


def pack_refs(refs: DataFrame, size: int = PACK) -> DataFrame:
    """References as arrays: one row per location and run of ``size`` positions, in order.

    A location with very many references gets several rows, so no array grows without bound: the key of the result
    is ``(location_id, pack)``, and joins that need a whole location must take both.
    """
    packed = refs.groupBy("location_id", F.floor(F.col("ref_pos") / size).alias("pack")).agg(
        F.array_sort(F.collect_list(F.struct("ref_pos", "feature_id"))).alias("_refs"))
    return packed.select("location_id", "pack", F.transform("_refs", lambda r: r["feature_id"]).alias("geometry_refs"))


def quiz_paths(members: DataFrame, refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Quiz to members to references to paths; references without a feature give nothing."""
    return (members.join(refs, "location_id").join(paths, "feature_id")
            .select("quiz_id", "location_id", F.col("pos").alias("member_pos"), "ref_pos", "path_pos", "path"))


def first_quiz(locations: DataFrame, members: DataFrame, quizzes: DataFrame, default: str = "world") -> DataFrame:
    """The first quiz, by definition order, that contains each location; else the default."""
    ordered = members.join(quizzes.select("quiz_id", "quiz_pos"), "quiz_id")
    first = ordered.groupBy("location_id").agg(F.min_by("quiz_id", "quiz_pos").alias("quiz_id"))
    return locations.select("location_id").join(first, "location_id", "left").select(
        "location_id", F.coalesce("quiz_id", F.lit(default)).alias("quiz_id"))


def detail_index(locations: DataFrame, refs: DataFrame, detail_features: DataFrame) -> DataFrame:
    """References of every location into the detailed features: by key where it has one, else its own."""
    coded = locations.where(F.col("iso3").isNotNull())
    by_key = match_catalog(coded, detail_features)
    own = refs.join(locations.where(F.col("iso3").isNull()).select("location_id"), "location_id", "left_semi")
    return by_key.unionByName(own.select("location_id", "feature_id", "ref_pos"))


def detail_problems(locations: DataFrame, index: DataFrame, detail_features: DataFrame) -> DataFrame:
    """Locations without any detailed reference or with one that does not exist."""
    absent = locations.select("location_id").join(index.select("location_id"), "location_id", "left_anti").select(
        "location_id", F.lit(None).cast("string").alias("feature_id"))
    broken = index.join(detail_features.select("feature_id"), "feature_id", "left_anti").select("location_id", "feature_id")
    return absent.unionByName(broken)


def scope(catalog: DataFrame, members: DataFrame, quiz_id: str) -> DataFrame:
    """Catalog rows that are members of one quiz."""
    return catalog.join(members.where(F.col("quiz_id") == quiz_id).select("location_id"), "location_id", "left_semi")


def member_locations(members: DataFrame, locations: DataFrame) -> DataFrame:
    """Ordered members of every quiz with their location rows."""
    return members.select("quiz_id", "location_id", F.col("pos").alias("member_pos")).join(locations, "location_id")


def resolve_answers(answers: DataFrame, scoped: DataFrame) -> DataFrame:
    """Add ``answer_id`` to answers (``quiz_id, selected_id, text``) by their quiz's locations.

    A selected id counts only if it is in the quiz; without one, the text is compared by name key
    and the first location in catalog order wins. Anything else is null.
    ``scoped`` has ``quiz_id, location_id, name, pos``.
    """
    ids = scoped.select("quiz_id", F.col("location_id").alias("selected_id"), F.lit(True).alias("_in_quiz")).distinct()
    by_name = scoped.select("quiz_id", "pos", "location_id", name_key(F.col("name")).alias("_key")).groupBy("quiz_id", "_key").agg(
        F.min_by("location_id", F.struct("pos", "location_id")).alias("_named"))
    keyed = answers.withColumn("_key", F.when(F.col("selected_id").isNull(), name_key(F.col("text"))))
    joined = keyed.join(ids, ["quiz_id", "selected_id"], "left").join(by_name, ["quiz_id", "_key"], "left")
    answer = F.when(F.col("selected_id").isNotNull(), F.when(F.col("_in_quiz"), F.col("selected_id"))).otherwise(F.col("_named"))
    return joined.withColumn("answer_id", answer).select(*answers.columns, "answer_id")


def all_locations(*tables: DataFrame) -> DataFrame:
    """Union of location tables by column name."""
    union = tables[0]
    for more in tables[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    return union


def difference(everything: DataFrame, known: DataFrame, key: str = "location_id") -> DataFrame:
    """Rows whose key is not among the known ones."""
    return everything.join(known.select(key), key, "left_anti")


def selection_counts(locations: DataFrame) -> DataFrame:
    """Number of locations by origin (``kind``: catalog, candidate, configured) and in all."""
    def of(kind: str, name: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(name)

    return locations.agg(of("catalog", "standard"), of("candidate", "candidates"), of("configured", "configured"),
                         F.count(F.lit(1)).alias("total"))


# --- quiz definitions ------------------------------------------------------------------------

# Defaults of a quiz's map and texts of the two special quizzes.
MAP_DEFAULTS = {"wrap_width": 1440.0, "seam_longitude": 152.0, "standard_parallel": 0.0}
WORLD_TEXT = "All UN Member and UN Observer states"
NON_UN_TEXT = ("Non-UN Countries and regions listed in ISO 3166-1, UN M49, the List of Economies published by the "
               "World Bank Group, or under select categories in ISO 3166-2.")
NON_UN_TITLE = "Non-UN Countries, Independent Territories, and Autonomous Regions"
REGION_TEXT = "UN Member and UN Observer states in "
NAME_SUFFIX = " UN Countries"


def is_regional(category: Column) -> Column:
    return category.eqNullSafe("regional")


def view_box(text: Column) -> Column:
    """``min_x min_y width height`` text as bounds; null unless it is four finite numbers."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(good, F.struct(
        F.get(parts, 0).alias("min_x"), F.get(parts, 1).alias("min_y"), (F.get(parts, 0) + F.get(parts, 2)).alias("max_x"),
        (F.get(parts, 1) + F.get(parts, 3)).alias("max_y")))


def quiz_texts(quizzes: DataFrame) -> DataFrame:
    """Category, section label, title and description of each quiz (``quiz_id, name, category, description``)."""
    category = F.coalesce("category", F.lit("global"))
    label = F.when(category == "global", "Global quizzes").otherwise(
        F.concat(F.upper(F.substring(category, 1, 1)), F.expr("substring(coalesce(category, 'global'), 2)"), F.lit(" quizzes")))
    region = F.regexp_replace("name", NAME_SUFFIX + "$", "")
    title = F.when(F.col("quiz_id") == "non-un", NON_UN_TITLE).otherwise(F.regexp_replace("name", f"^(.*?){NAME_SUFFIX}", "$1"))
    text = (F.when(F.col("quiz_id") == "world", WORLD_TEXT).when(F.col("quiz_id") == "non-un", NON_UN_TEXT)
            .when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.concat(F.lit(REGION_TEXT), region)))
    return quizzes.withColumns({"category": category, "section": label, "title": title, "description": text})


def quiz_maps(quizzes: DataFrame) -> DataFrame:
    """Map settings of each quiz with defaults (nullable struct ``map``) and its view as bounds."""
    def setting(name: str, default) -> Column:
        return F.coalesce(F.col(f"map.{name}"), F.lit(default)).alias(name)

    return quizzes.select(
        "quiz_id", setting("wrap_active", True), setting("selectable", False), setting("view_box", ""),
        setting("standard_parallel", MAP_DEFAULTS["standard_parallel"]), setting("wrap_width", MAP_DEFAULTS["wrap_width"]),
        setting("seam_longitude", MAP_DEFAULTS["seam_longitude"]), F.col("map.preserve_aspect_ratio").alias("preserve_aspect_ratio"),
        view_box(F.coalesce("map.view_box", F.lit(""))).alias("view"))


def view_centre_y(view: Column, height: float = G.MAP_HEIGHT) -> Column:
    """Vertical centre of a view, or of the whole map without one."""
    return F.when(view.isNotNull(), (view["min_y"] + view["max_y"]) / 2).otherwise(F.lit(height / 2))


def category_sections(quizzes: DataFrame) -> DataFrame:
    """Quizzes by category in the order in which categories and quizzes first appear."""
    first = quizzes.groupBy(F.coalesce("category", F.lit("global")).alias("category")).agg(F.min("quiz_pos").alias("section_pos"))
    return (quizzes.withColumn("category", F.coalesce("category", F.lit("global"))).join(first, "category")
            .select("category", "section_pos", "quiz_id", "quiz_pos"))
