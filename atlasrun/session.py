"""Session helpers shared by every job."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Narrow rows that a task of a contraction or of a comparison of pairs takes.
TASK_ROWS = 100_000


def build_session(app: str = "atlasrun", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster defaults win when not given.

    AQE does the run-time work: it sizes shuffle partitions, turns joins into broadcast
    joins once a side is known to be small, and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Lets a join reuse rows that are already partitioned by some of its keys.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would not survive executor loss.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    current = context.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not re.match(r"local(\[|$)", context.master):  # local-cluster has executors of its own
            raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder before running iterative jobs")
        configured = tempfile.mkdtemp(prefix="atlasrun-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The rows in as many partitions as ``rows`` of them need, one for each core at least; never in more than they come in.

    A shuffle leaves files for each of its tasks and a checkpoint leaves two, so few rows in many partitions are mostly empty blocks on disk.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def cut_packed(df: DataFrame, width: int = 1) -> DataFrame:
    """:func:`cut_lineage`, read back in as many partitions as the rows need; a row is as wide as ``width`` narrow ones."""
    stored = cut_lineage(df)
    return packed_tasks(stored, width * stored.count())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a run that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
