"""Stored score envelopes: one JSON document per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leaderboard import player_name, top_scores, valid_scores

# Fixed value: the supported envelope version.
VERSION = 1


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """``device_id, envelope`` rows from line files of ``device<TAB>document``."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(parts, 0).alias("device_id"), F.get(parts, 1).alias("envelope"))


def _field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def _text(document: Column, name: str) -> Column:
    """A field that is a JSON text; null for any other type."""
    return F.when(F.schema_of_variant(_field(document, name)) == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def _number(document: Column, name: str) -> Column:
    """A field that is a JSON number; null for any other type."""
    kind = F.schema_of_variant(_field(document, name))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(document, f"$.{name}", "double"))


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """Player name and score boards of each device; unreadable or unsupported documents count as empty."""
    parsed = envelopes.withColumn("_doc", F.try_parse_json("envelope"))
    boards = F.try_variant_get("_doc", "$.scores", "map<string,variant>")
    usable = F.coalesce((_number(F.col("_doc"), "version") == VERSION) & boards.isNotNull(), F.lit(False))
    return parsed.select("device_id", player_name(F.when(usable, _text(F.col("_doc"), "playerName"))).alias("player_name"),
                         F.when(usable, boards).alias("boards"))


def stored_scores(envelopes: DataFrame) -> DataFrame:
    """Valid score records of all devices; a quiz whose entry is not an array is skipped."""
    boards = parse_envelopes(envelopes).where(F.col("boards").isNotNull())
    entries = boards.select("device_id", F.explode("boards").alias("quiz_id", "board"))
    items = entries.select("device_id", "quiz_id", F.explode(F.try_variant_get("board", "$", "array<variant>")).alias("entry"))
    entry = F.col("entry")
    records = items.select(
        "device_id", "quiz_id", _text(entry, "id").alias("id"), _text(entry, "username").alias("username"),
        _number(entry, "score").alias("score"), _number(entry, "accuracy").alias("accuracy"),
        _number(entry, "elapsedMs").alias("elapsed_ms"), _number(entry, "createdAt").alias("created_at"),
        (_field(entry, "accuracy").isNotNull() & _number(entry, "accuracy").isNull()).alias("_bad_accuracy"))
    return valid_scores(records.where(~F.col("_bad_accuracy"))).drop("_bad_accuracy")


def stored_boards(envelopes: DataFrame) -> DataFrame:
    """Boards of each device and quiz, best five."""
    scores = stored_scores(envelopes)
    per_device = scores.withColumn("quiz_id", F.struct("device_id", "quiz_id"))
    best = top_scores(per_device)
    return best.withColumn("quiz_id", F.col("quiz_id.quiz_id"))
