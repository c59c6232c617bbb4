"""Registered queries of the sources: files that Spark writes from the tables, faults among them, and what the gate says."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..session import ensure_checkpoint_dir
from ..sources import boundaries, config, publish
from .registry import query, with_views
from .resolve_queries import OVERRIDES, REFS, _features, _refs
from .views import FEATURES, PLACES, Tables


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/sources-{uuid.uuid4().hex}"


def _feature_lines(t: Tables) -> DataFrame:
    """A GeoJSON line for each ring, damaged by its number."""
    pairs = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    damage = F.col("ring_id") % 8
    geometry = F.when(damage != 1, F.struct(F.when(damage == 2, "Point").otherwise("Polygon").alias("type"), F.array(pairs).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("ring_id").alias("NE_ID")).alias("properties"), geometry.alias("geometry")))
    broken = F.when(damage == 0, F.substr(line, F.lit(1), F.length(line) - 3)).when(damage == 3, F.replace(line, F.lit("[["), F.lit('["[')))
    return t.rings.select("ring_id", F.coalesce(broken, line).alias("value"))


@query("source_rejects", """
SELECT CASE vec_id % 8 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no geometry' WHEN 2 THEN 'not a polygon' ELSE 'malformed' END AS detail, count(*) AS n
FROM embeddings WHERE vec_id % 8 < 4 GROUP BY 1""")
def source_rejects(t: Tables) -> DataFrame:
    """Faults of boundary files, counted by kind."""
    folder = _folder(t)
    _feature_lines(t).select("value").write.text(folder)
    return boundaries.rejected_features(t.spark, folder).groupBy("detail").agg(F.count(F.lit(1)).alias("n"))


@query("source_features", """
SELECT 'ne:' || vec_id AS feature_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS place FROM embeddings WHERE vec_id % 8 > 3""")
def source_features(t: Tables) -> DataFrame:
    """Features of sound boundary files, admitted and numbered over files and their parts."""
    folder = _folder(t)
    sound = _feature_lines(t).where("ring_id % 8 > 3")
    sound.repartitionByRange(4, "ring_id").sortWithinPartitions("ring_id").select("value").write.text(folder)
    features = boundaries.country_features(boundaries.read_features(t.spark, folder))
    return features.select("feature_id", F.col("feature_pos").cast("bigint").alias("place"))


@query("config_rejects", """
WITH docs AS (SELECT *, c_custkey // 20 AS block FROM customer)
SELECT 'malformed' AS detail, count(DISTINCT block) AS n FROM docs WHERE block % 5 = 1 HAVING count(*) > 0
UNION ALL SELECT 'no id', count(*) FROM docs WHERE block % 5 <> 1 AND c_custkey % 7 = 0 HAVING count(*) > 0""")
def config_rejects(t: Tables) -> DataFrame:
    """Faults of catalog documents of twenty places each: some are cut short, some places have no id."""
    folder = _folder(t)
    element = F.struct(F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("c:"), "c_custkey")).alias("id"), F.col("c_name").alias("name"))
    block = F.floor(F.col("c_custkey") / 20)
    whole = t.read("customer").groupBy(block.alias("block")).agg(F.to_json(F.collect_list(element)).alias("value"))
    cut = whole.select("block", F.when(F.col("block") % 5 == 1, F.substr("value", F.lit(1), F.length("value") - 9)).otherwise(F.col("value")).alias("value"))
    cut.repartition("block").write.partitionBy("block").text(folder)
    return config.rejected_documents(t.spark, folder).groupBy("detail").agg(F.count(F.lit(1)).alias("n"))


@query("built_tables", with_views(FEATURES, PLACES, OVERRIDES, REFS, body="""
SELECT 'location_refs' AS part, location_id AS entity, feature_id AS value, ref_pos FROM refs
UNION ALL SELECT 'feature_ids', feature_id, NULL, feature_pos FROM features"""))
def built_tables(t: Tables) -> DataFrame:
    """References and feature ids of the build in force, after a later build with dangling references was refused."""
    folder = _folder(t)
    features, refs = _features(t), _refs(t)
    order = {"location_refs": ["location_id", "ref_pos", "feature_id"], "feature_ids": ["feature_id"]}

    def rules(tables):
        return quality.references(tables["location_refs"], tables["feature_ids"], "location_id", "feature_id", "feature_id")

    def tables(references):
        return {"location_refs": references.select("location_id", "feature_id", F.col("ref_pos").cast("bigint").alias("ref_pos")),
                "feature_ids": features.select("feature_id", F.col("feature_pos").cast("bigint").alias("ref_pos"))}

    publish.publish(t.spark, folder, "sound", tables(refs), order, rules)
    try:
        publish.publish(t.spark, folder, "dangling", tables(refs.withColumn("feature_id", F.concat("feature_id", F.lit("x")))), order, rules)
    except publish.BuildRefused:
        pass
    kept = publish.read_published(t.spark, folder, "location_refs")
    ids = publish.read_published(t.spark, folder, "feature_ids")
    return kept.select(F.lit("location_refs").alias("part"), F.col("location_id").alias("entity"), F.col("feature_id").alias("value"), "ref_pos").unionByName(
        ids.select(F.lit("feature_ids").alias("part"), F.col("feature_id").alias("entity"), F.lit(None).cast("string").alias("value"), "ref_pos"))
