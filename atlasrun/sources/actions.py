"""Action logs, as tables or as streams, with one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACTION_SCHEMA = ("run_id bigint, quiz_id bigint, seq bigint, type string, ts_ms double, is_correct boolean, "
                 "selected_id string, text string, total bigint")


def read_actions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(ACTION_SCHEMA).load(path)


def stream_actions(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(ACTION_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic of JSON actions; needs the Kafka connector on the cluster."""
    from pyspark.sql import functions as F

    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), ACTION_SCHEMA).alias("a")).select("a.*")
