"""Rounds of connected components leave files for the links they have, however many partitions a shuffle has."""

import glob

from atlasrun.operators.graph import connected_components
from atlasrun.session import ensure_checkpoint_dir


def test_few_links_leave_few_files(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = set(glob.glob(f"{root}/**/rdd-*", recursive=True))
        links = spark.createDataFrame([(k, k + 1) for k in range(100) if k % 10 != 9], "a bigint, b bigint")
        found = {r.id: r.cluster for r in connected_components(spark.range(100), links).collect()}
        folders = [f for f in glob.glob(f"{root}/**/rdd-*", recursive=True) if f not in before]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == {k: k // 10 * 10 for k in range(100)}
    most = sorted(len(glob.glob(f"{f}/part-*")) for f in folders)
    # Only the first table of links, whose rows are not counted yet, has a file for each partition.
    assert len(most) > 2 and most[-2] <= spark.sparkContext.defaultParallelism
