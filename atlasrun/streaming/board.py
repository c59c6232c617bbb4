"""Streaming score board: each batch of completed runs is merged into the stored boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.leaderboard import BOARD_DEPTH, score_records, top_scores

COLUMNS = "quiz_id string, id string, username string, score double, accuracy double, elapsed_ms double, created_at double"


def read_boards(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest boards in a folder, or the latest of those written before a batch.

    Every batch writes one folder of a few rows per quiz, so a failed batch can be redone from the
    one before it. Folders are listed by name and only the latest is read, so the cost does not grow with
    the number of batches. Older folders may be removed at any time.
    """
    batches = [b for b in _batches(spark, path) if before is None or b < before]
    if not batches:
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(f"{path}/batch={max(batches)}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders that were written to the end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [int(f.getPath().getName().removeprefix("batch=")) for f in store.listStatus(folder)
            if f.getPath().getName().startswith("batch=") and store.exists(done(f.getPath(), "_SUCCESS"))]


def merge_batch(results: DataFrame, batch_id: int, path: str, depth: int = BOARD_DEPTH) -> None:
    """Best scores of the boards before this batch and its new results, written under the batch id.

    Running the same batch again reads the same earlier boards and overwrites the same folder, so a
    redelivered batch changes nothing. Only rows that can still rank are read or written.
    """
    spark = results.sparkSession
    fresh = top_scores(score_records(results).dropDuplicates(["quiz_id", "id"]), depth).drop("rank")
    merged = read_boards(spark, path, before=batch_id).unionByName(fresh).dropDuplicates(["quiz_id", "id"])
    best = top_scores(merged, depth).drop("rank")
    best.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start_board(results: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the board stream over completed runs; returns the running query."""
    return (results.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path)).start())
