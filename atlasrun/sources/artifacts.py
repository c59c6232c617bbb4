"""Writing and describing the produced tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, order: list[str], partition: str | None = None, fmt: str = "parquet") -> None:
    """Write a table so that a rerun gives the same rows in the same order.

    Rows are range-partitioned by the order and sorted within partitions: a global order without one
    task that sees everything. With ``partition`` only the written partitions are replaced.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.format(fmt).save(path)


def source_manifest(sources: DataFrame) -> DataFrame:
    """Provenance rows of the used sources: id, url, digest, licence, attribution."""
    return sources.select("source", "url", "sha256", "license", "attribution")


def manifest_tables(sources: DataFrame, overrides: DataFrame, refs: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """Provenance of a build as tables: sources, replaced features, references, feature ids.

    Ids and references grow with the data, so they are rows and not one document.
    """
    return {
        "sources": source_manifest(sources),
        "geometry_overrides": overrides.select("geometry_source", "feature_id"),
        "location_refs": refs.select("location_id", "ref_pos", "feature_id"),
        "feature_ids": features.select("feature_id")}


def write_manifest(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        write_table(table, f"{path}/{name}", order=table.columns[:2], fmt="json")


def manifest_header(sources: DataFrame, refs: DataFrame, features: DataFrame) -> DataFrame:
    """One small row: the sources used and the counts of what was built.

    The list of sources is configuration (a handful of rows); everything else is counted.
    """
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("source", "url", "sha256", "license"))).alias("sources"))
    counts = refs.agg(F.count(F.lit(1)).alias("references"), F.count_distinct("location_id").alias("locations"))
    ids = features.agg(F.count(F.lit(1)).alias("features"))
    return listed.join(counts).join(ids).withColumn("generated_at", F.lit("deterministic"))
