"""Live status of every run, kept by a stream in update mode: one current row per run, merged batch by batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder

COLUMNS = "run_id bigint, segment bigint, seq bigint, correct bigint, completed bigint, remaining bigint, accuracy double, attempts_left bigint"
#: Batches after which changes are merged into a new base table.
MERGE_EVERY = 16


def _latest(rows: DataFrame) -> DataFrame:
    """The last status of each run."""
    names = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max(F.struct(*names)).alias("last")).select("run_id", "last.*")


def _written(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the base tables and of the changes that were written to the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    folder = place(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "change": []}
    if store.exists(folder):
        for entry in store.listStatus(folder):
            named = re.fullmatch(r"(base|change)=(\d+)", entry.getPath().getName())
            if named and store.exists(place(entry.getPath(), "_SUCCESS")):
                found[named[1]].append(int(named[2]))
    return found["base"], found["change"]


def read_live(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The current row of each run: the latest base table with the changes after it, or as it stood before a batch merged."""
    bases, changes = _written(spark, path)
    base = max((b for b in bases if before is None or b < before), default=-1)
    folders = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/change={c}" for c in changes if c > base and (before is None or c <= before)]
    if not folders:
        return spark.createDataFrame([], COLUMNS)
    return _latest(spark.read.schema(COLUMNS).parquet(*folders))


def merge_live(rows: DataFrame, batch_id: int, path: str, merge_every: int = MERGE_EVERY) -> None:
    """Upsert the status rows of a batch by run.

    A batch writes one row per run that it changed, to a folder of its number; every so often all is merged into a new base table, and
    what the base before it had made obsolete is removed. So a batch costs what it changes and a reader a bounded number of folders. A batch that comes
    again writes the same folders anew from the same earlier ones.
    """
    spark = rows.sparkSession
    _latest(rows.select(*(f.split()[0] for f in COLUMNS.split(", ")))).write.mode("overwrite").parquet(f"{path}/change={batch_id}")
    if (batch_id + 1) % merge_every == 0:
        read_live(spark, path, before=batch_id).write.mode("overwrite").parquet(f"{path}/base={batch_id}")
        bases, changes = _written(spark, path)
        kept = max((b for b in bases if b < batch_id), default=-1)  # the batch may come again, and readers may still be on it
        for kind, numbers in (("base", [b for b in bases if b < kept]), ("change", [c for c in changes if c <= kept])):
            for number in numbers:
                remove_folder(spark, f"{path}/{kind}={number}")


def start_live(status: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY, **trigger):
    """Start the stream of :func:`.scorer.live` rows; returns the running query."""
    return (status.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda batch, batch_id: merge_live(batch, batch_id, path, merge_every)).start())
