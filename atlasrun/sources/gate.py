"""The gate that parsed sources go through before any row is handed out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_folder

#: Faults that an error names; all of them are in the quarantine.
NAMED_FAULTS = 5


class SourceFault(ValueError):
    """A source has rows that cannot be used; ``quarantine`` is the folder of the table that lists them all."""

    def __init__(self, message: str, quarantine: str):
        super().__init__(message)
        self.quarantine = quarantine


def violations(parsed: DataFrame, rule: str = "source") -> DataFrame:
    """The rows of a parsed table (``file, problem, ...``) that have a problem, as violations."""
    return parsed.where("problem is not null").select(F.lit(rule).alias("rule"), F.col("file").alias("entity"), F.col("problem").alias("detail"))


def admitted(parsed: DataFrame, name: str) -> DataFrame:
    """The rows of a parsed table without ``problem``, if none has one; else :class:`SourceFault`.

    The table is parsed once and written as Parquet to the shared checkpoint folder, and problems are counted on the way, so no later
    read can be narrow enough to miss them. With a problem, nothing of the source is handed out: its
    faults go to a quarantine table, and the parsed rows are removed.
    """
    spark = parsed.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/source-{name}-{uuid.uuid4().hex}"
    counted = Observation()
    parsed.observe(counted, F.count_if(F.col("problem").isNotNull()).alias("faults")).write.parquet(f"{root}/rows")
    rows = spark.read.schema(parsed.schema).parquet(f"{root}/rows")
    if not counted.get["faults"]:
        return rows.drop("problem")
    faults = f"{root}/quarantine"
    violations(rows).write.parquet(faults)
    remove_folder(spark, f"{root}/rows")
    told = spark.read.parquet(faults)
    first = "; ".join(f"{r.entity}: {r.detail}" for r in told.orderBy("entity", "detail").limit(NAMED_FAULTS).collect())
    raise SourceFault(f"unusable {name}: {told.count()} faults, listed in {faults}, among them {first}", faults)


def quarantined(spark: SparkSession, fault: SourceFault) -> DataFrame:
    """The violations that a gate has set aside."""
    return spark.read.parquet(fault.quarantine)
