"""A corpus pipeline: quality rules, near dedup, substring dedup, decontamination, packing; each stage reads what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasrun.llm import chunk_dedup, decontamination, near_dedup, packing, quality_rules, records
from atlasrun.llm.common import read
from atlasrun.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the rules learned from ``labels`` keep."""
    rules = quality_rules.learn_rules(docs, read(spark, folder, "labels"))
    return quality_rules.judge_quality(docs, rules).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows of one id stay or go together, those with a null id stay."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the passages that an earlier document has."""
    cut = chunk_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a word in a benchmark window, judged row by row; rows with a null id are not judged and stay."""
    keyed = docs.withColumn("__text", F.sha2("text", 256))
    found = decontamination.contamination(keyed, read(spark, folder, "benchmark"), doc="__text")
    dirty = found.where("contaminated").select(F.col("doc_id").alias("__text")).distinct()
    judged = keyed.where("doc_id is not null").join(dirty, "__text", "left_anti").drop("__text")
    return judged.unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents in sequences, with the digest of their ids."""
    out = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("near dedup", near_copies), ("substring dedup", passages), ("decontamination", leaks), ("packing", packed)]

#: Packing and near dedup are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    folder, docs = records.scratch_folder(spark, "pipeline"), read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
