"""Batch name search: a table of queries against a table of names, by substring of the name key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import contains_key, name_key
from ..session import cut_lineage

# Fixed value: how many suggestions a query gets.
SUGGESTIONS = 8
GRAM = 3
# Lengths of the grams that longer queries are looked up by: the largest that fits.
LONG_GRAMS = (3, 6, 12, 24, 48)


def grams(key: Column, length: int | Column) -> Column:
    """Distinct substrings of the given length."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.sequence(F.lit(1), F.length(key) - (length - 1))
    return F.when(F.length(key) >= length, F.array_distinct(F.transform(starts, lambda i: F.substr(key, i, length)))) \
        .otherwise(F.array().cast("array<string>"))


def _best(rows: DataFrame, per: str, exact: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group: exact names first, then by name in English order."""
    order = Window.partitionBy(per).orderBy(exact.desc(), F.collate(F.col("name"), "en"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def suggest(queries: DataFrame, catalog: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """Up to ``limit`` names of ``catalog`` (``item_id, name, pos``) for each query (``query_id, text``).

    Matching is by grams instead of comparing all queries with all names. A query of up to three
    characters is itself a gram, so its answer is the best few names of that gram, found once
    whoever asks. A longer one is looked up under the rarest of its grams and then checked in full; grams grow
    with the query, so a longer query stays selective as the catalog grows. An empty query gets the first
    names in catalog order. Equal queries are answered once. Keys are computed once and written.
    """
    asked = cut_lineage(queries.select("query_id", name_key(F.col("text")).alias("key")))
    keys = asked.select("key").distinct()
    names = cut_lineage(catalog.select("item_id", "name", "pos", name_key(F.col("name")).alias("name_key")))
    size = F.length("key")

    empty = keys.where(size == 0)
    first = names.orderBy("pos").limit(limit).select(
        F.lit("").alias("key"), "item_id", "name", "pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")).alias("rank"))
    for_empty = empty.join(first, "key").select("key", "item_id", "rank")

    short = keys.where((size >= 1) & (size <= GRAM))
    every = F.flatten(F.array(*[grams(F.col("name_key"), n) for n in range(1, GRAM + 1)]))
    listed = names.select("item_id", "name", "pos", "name_key", F.explode(every).alias("gram"))
    of_short = listed.join(short.select(F.col("key").alias("gram")), "gram", "left_semi")
    for_short = _best(of_short, "gram", F.col("name_key") == F.col("gram"), limit).select(
        F.col("gram").alias("key"), "item_id", "rank")

    fitting = F.greatest(*(F.when(size >= n, n).otherwise(LONG_GRAMS[0]) for n in LONG_GRAMS))
    long = keys.where(size > GRAM).select("key", F.explode(grams(F.col("key"), fitting)).alias("gram"))
    every_long = F.flatten(F.array(*[grams(F.col("name_key"), n) for n in LONG_GRAMS]))
    listed_long = names.select("item_id", "name", "pos", "name_key", F.explode(every_long).alias("gram"))
    # Only grams that are asked for go further.
    asked_for = listed_long.join(long.select("gram").distinct(), "gram", "left_semi")
    counts = asked_for.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    pivots = (long.join(counts, "gram", "left").groupBy("key")
              .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"),
                   F.min(F.coalesce("names", F.lit(0))).alias("least")).where(F.col("least") > 0).select("key", "gram"))
    matches = asked_for.join(pivots, "gram").where(contains_key(F.col("name_key"), F.col("key")))
    for_long = _best(matches, "key", F.col("name_key") == F.col("key"), limit).select("key", "item_id", "rank")

    found = for_empty.unionByName(for_short).unionByName(for_long)
    return asked.join(found, "key").select("query_id", "rank", "item_id")


def names_containing(catalog: DataFrame, query: str) -> DataFrame:
    """Names that contain one given query; a plain filter that keeps the catalog's partitioning."""
    keyed = catalog.withColumns({"_name": name_key(F.col("name")), "_query": name_key(F.lit(query))})
    return keyed.where(contains_key(F.col("_name"), F.col("_query"))).drop("_name", "_query")
