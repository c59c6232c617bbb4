"""The build job: checked sources to features, resolved locations, quality rules and published tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, resolve, rings
from ..session import cut_lineage
from ..sources import boundaries, config, publish

#: Sort columns of the published tables.
ORDER = {"features": ["feature_id"], "parts": ["feature_id", "part_id"], "locations": ["location_id"], "location_refs": ["location_id", "ref_pos", "feature_id"],
         "quizzes": ["quiz_pos"], "members": ["quiz_id", "pos"], "unmatched": ["location_id"]}


@dataclass
class Sources:
    """Where the sources of a build are. Features are files of GeoJSON lines with a digest for each file (``file, sha256``)."""

    features: str
    digests: DataFrame
    catalog: str
    quizzes: str
    supplements: dict[str, str] = field(default_factory=dict)
    supplement_digests: dict[str, DataFrame] = field(default_factory=dict)
    candidates: str | None = None
    locations: str | None = None
    overrides: str | None = None


def _candidates(spark: SparkSession, sources: Sources, supplement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate locations and their references."""
    rows = config.read_candidates(spark, sources.candidates)
    none = spark.createDataFrame([], "name string, feature_id string"), spark.createDataFrame([], "name string, key string, key_pos bigint")
    matches = resolve.candidate_matches(rows, supplement, *none)
    named = rows.select("name", F.concat(F.lit("candidate:"), F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]+", "-"))).alias("location_id"))
    refs = matches.join(named, "name").select("location_id", "feature_id", F.col("feature_pos").cast("bigint").alias("ref_pos"))
    return named.select("location_id", "name", F.lit("candidate").alias("kind")), refs


def build_tables(spark: SparkSession, sources: Sources, tolerance: float = rings.MAP_TOLERANCE) -> publish.Tables:
    """All tables of a build. Sources go through digests and the gate first, so a damaged one is an error before any table is made.

    Every location has the features that its key, its reviewed override, its own references or its name and codes lead to. Supplements stay only where something
    refers to them.
    """
    base = boundaries.country_features(boundaries.read_checked_features(spark, sources.features, sources.digests))
    base = base.select("feature_id", "feature_pos", "keys", "label_x", "label_y", "polygons", F.lit("base").alias("source"))
    catalog = config.read_catalog(spark, sources.catalog)
    matches = resolve.match_catalog(catalog, base)
    refs = resolve.apply_overrides(matches, config.read_overrides(spark, sources.overrides), catalog) if sources.overrides else matches
    locations, references = [catalog.select("location_id", "name", F.lit("catalog").alias("kind"))], [refs.select("location_id", "feature_id", F.col("ref_pos").cast("bigint").alias("ref_pos"))]
    extra = None
    for name, path in sources.supplements.items():
        read = boundaries.supplemental_features(boundaries.read_checked_features(spark, path, sources.supplement_digests[name]), name)
        extra = read if extra is None else extra.unionByName(read)
    if sources.candidates:
        if extra is None:
            raise ValueError("candidates need a supplement to be found in")
        named, found = _candidates(spark, sources, extra)
        locations.append(named)
        references.append(found)
    if sources.locations:
        places = config.read_locations(spark, sources.locations)
        locations.append(places.select("location_id", "name", F.lit("configured").alias("kind")))
        references.append(config.location_refs(places))
    all_refs = cut_lineage(references[0] if len(references) == 1 else resolve.all_locations(*references))
    features = base
    if extra is not None:
        kept = resolve.only_referenced(extra, all_refs)
        features = base.unionByName(kept.select("feature_id", "feature_pos", "keys", "label_x", "label_y", F.col("geometry").alias("polygons"), "source"))
    features = cut_lineage(features)
    parts = cut_lineage(rings.build_parts(features, tolerance))
    built = rings.build_features(features, parts)
    shapes = resolve.location_shapes(all_refs, built)
    everywhere = resolve.all_locations(*locations)
    quizzes = config.read_quizzes(spark, sources.quizzes)
    return {"features": built, "parts": parts.drop("ring"), "locations": everywhere.join(shapes, "location_id", "left"), "location_refs": all_refs,
            "quizzes": quizzes, "members": config.quiz_members(quizzes), "unmatched": resolve.unmatched(everywhere, all_refs).select("location_id", "name")}


def rules(tables: publish.Tables) -> DataFrame:
    """What must hold of the written tables."""
    features, refs, locations = (tables[n] for n in ("features", "location_refs", "locations"))
    return quality.all_of(
        quality.unique(features, "feature_id", "unique-feature"), quality.unique(locations, "location_id", "unique-location"), quality.unique_refs(refs),
        quality.references(refs, features, "location_id", "feature_id", "feature_id", "reference"),
        quality.references(tables["members"], locations, "quiz_id", "location_id", "location_id", "member"),
        quality.not_empty(refs, locations, "location_id", "no-feature"), quality.finite_bounds(features, "feature_id"),
        quality.not_empty(tables["parts"], features, "feature_id", "no-part"),
        quality.quiz_inputs(tables["quizzes"], tables["members"], locations.select("location_id", "name")))


def build(spark: SparkSession, sources: Sources, path: str, name: str, tolerance: float = rings.MAP_TOLERANCE) -> dict:
    """Build from the sources and publish under ``path`` as build ``name``; the manifest now in force.

    A damaged source, an unmatched location or a broken rule leaves the last build in force.
    """
    tables = build_tables(spark, sources, tolerance)
    order = {n: ORDER[n] for n in tables}
    counted = resolve.selection_counts(tables["locations"]).first().asDict()
    return publish.publish(spark, path, name, tables, order, rules, {"locations": counted})
