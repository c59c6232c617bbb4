"""Ranked score boards. A score row has ``quiz_id, id, username, score, accuracy, elapsed_ms, created_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import trim_space
from ..functions.scoring import accuracy_text, elapsed_text, tier, tier_text
from .prefix import BLOCK, running_before

# Board depth and the name used when a player gave none.
BOARD_DEPTH = 5
DEFAULT_PLAYER = "Player 1"
DAY_MS = 86_400_000


def board_order() -> list[Column]:
    """Best score first, then faster, then earlier, then by id."""
    return [F.col("score").desc(), F.col("elapsed_ms").asc(), F.col("created_at").asc(),
            F.collate(F.col("id"), "UNICODE").asc()]


def player_name(name: Column) -> Column:
    trimmed = trim_space(name)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(DEFAULT_PLAYER)).otherwise(trimmed)


def valid_scores(scores: DataFrame) -> DataFrame:
    """Keep records whose id and name are given and whose numbers are finite; accuracy may be missing."""
    def finite(name: str) -> Column:
        value = F.col(name).cast("double")
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    return scores.where(F.col("id").isNotNull() & F.col("username").isNotNull() & finite("score")
                        & finite("elapsed_ms") & finite("created_at")
                        & (F.col("accuracy").isNull() | finite("accuracy")))


def top_scores(scores: DataFrame, depth: int = BOARD_DEPTH) -> DataFrame:
    """The best ``depth`` records of every quiz with their rank.

    The limit on the rank reaches the map side, so each task sends at most ``depth`` rows per quiz
    and a quiz that holds most of the scores costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy("quiz_id").orderBy(*board_order()))
    return scores.withColumn("rank", rank).where(F.col("rank") <= depth)


def quiz_board(scores: DataFrame, quiz_id: str, depth: int = BOARD_DEPTH) -> DataFrame:
    """The board of one quiz."""
    return scores.where(F.col("quiz_id") == quiz_id).orderBy(*board_order()).limit(depth)


def qualifying(scores: DataFrame, depth: int = BOARD_DEPTH) -> DataFrame:
    """Every record with a flag whether it is on its board."""
    best = top_scores(scores, depth).select("quiz_id", "id", F.lit(True).alias("_on_board"))
    return (scores.join(best, ["quiz_id", "id"], "left")
            .withColumn("qualifies", F.coalesce(F.col("_on_board"), F.lit(False))).drop("_on_board"))


def boards_of_all_quizzes(quizzes: DataFrame, scores: DataFrame, depth: int = BOARD_DEPTH) -> DataFrame:
    """All quizzes with their boards; a quiz without scores keeps one row of nulls."""
    return quizzes.join(top_scores(scores, depth), "quiz_id", "left")


def board_report(board: DataFrame) -> DataFrame:
    """Score rows as report texts: player, score, accuracy, time and score tier."""
    keys = [c for c in ("quiz_id", "id", "rank") if c in board.columns]
    return board.select(*keys, F.col("username").alias("player"), "score",
                        accuracy_text(F.col("accuracy")).alias("accuracy"),
                        elapsed_text(F.col("elapsed_ms")).alias("time"),
                        tier(F.col("score")).alias("tier"), tier_text(F.col("score")).alias("tier_text"))


def upsert_scores(stored: DataFrame, completed: DataFrame) -> DataFrame:
    """Add completed runs to the store once each, however often they were delivered.

    A run's record has an id made of run and completion time, so a repeat has the same id.
    """
    fresh = completed.dropDuplicates(["quiz_id", "id"]).join(stored.select("quiz_id", "id"), ["quiz_id", "id"], "left_anti")
    return stored.unionByName(fresh)


def score_records(results: DataFrame) -> DataFrame:
    """Score records of run results; the player is the run's username if there is one."""
    name = F.col("username") if "username" in results.columns else F.lit(None).cast("string")
    return results.select(
        F.col("quiz_id").cast("string").alias("quiz_id"),
        F.concat_ws("-", F.col("completed_at").cast("bigint").cast("string"), F.col("run_id").cast("string"),
                    F.col("segment").cast("string")).alias("id"),
        player_name(name).alias("username"), F.col("final_score").cast("double").alias("score"), "accuracy",
        F.col("elapsed_ms").cast("double").alias("elapsed_ms"), F.col("completed_at").cast("double").alias("created_at"))


def rename_records(scores: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply the latest rename (``quiz_id, id, name, at``) of each record; blank becomes the default."""
    latest = (renames.groupBy("quiz_id", "id")
              .agg(F.max_by(F.struct("name"), F.struct("at", "name")).alias("_latest")))
    joined = scores.join(latest, ["quiz_id", "id"], "left")
    renamed = F.when(F.col("_latest").isNull(), F.col("username")).otherwise(player_name(F.col("_latest.name")))
    return joined.withColumn("username", renamed).select(*scores.columns)


def default_names(records: DataFrame, renames: DataFrame, device: str = "device_id", block_ms: int = DAY_MS) -> DataFrame:
    """Name new records after the latest rename on the same device, at or before the record's time.

    Renames and records become one log per device, and the latest name so far is a running maximum
    over blocks of time, so a device with most of the rows is spread over many tasks.
    """
    names = renames.select(device, F.col("at").cast("double").alias("_at"), F.lit(0).alias("_kind"),
                           F.struct(F.col("at").cast("double").alias("at"), player_name(F.col("name")).alias("name")).alias("_name"),
                           F.lit(None).cast(records.schema).alias("_record"))
    made = records.select(device, F.col("created_at").cast("double").alias("_at"), F.lit(1).alias("_kind"),
                          F.lit(None).cast("struct<at:double,name:string>").alias("_name"), F.struct(*records.columns).alias("_record"))
    log = names.unionByName(made).withColumns({BLOCK: F.floor(F.col("_at") / block_ms), "_order": F.struct("_at", "_kind")})
    known = running_before(log, [device], "_order", {"_latest": ("max", F.col("_name"))}).where(F.col("_kind") == 1)
    name = F.coalesce(F.col("_latest.name"), F.lit(DEFAULT_PLAYER))
    return known.select(*[name.alias(c) if c == "username" else F.col(f"_record.{c}").alias(c) for c in records.columns])
