"""Connected components of an edge table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, packed_tasks

log = logging.getLogger(__name__)


def _links(pairs: DataFrame) -> DataFrame:
    """Distinct edges with the larger id first, no loops."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Tie every larger neighbour of a vertex to the smallest vertex around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return packed_tasks(_links(packed_tasks(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")), rows)), rows)


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Tie a vertex and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    ties = links.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return packed_tasks(_links(packed_tasks(ties.unionByName(least.select("a", F.col("root").alias("b"))), 2 * rows)), rows)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, cluster)`` for all vertices; the cluster is its smallest id.

    ``edges`` has columns ``a`` and ``b``. Alternates two contraction steps until nothing changes,
    which takes a number of rounds logarithmic in the size of a component, not its diameter. Each
    round is written to the shared checkpoint folder; the driver sees one count and one sum. Rounds
    have as many tasks as their links need, so few links leave few files.
    """
    links, seen, rounds = cut_lineage(_links(edges)), None, 0
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        log.info("component round %d: %s links", rounds, mark[0])
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen, rounds = tuple(mark), rounds + 1
        links = packed_tasks(links, mark[0])
        links = cut_lineage(_small_star(_large_star(links, mark[0]), mark[0]))
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("cluster"))
    return vertices.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
