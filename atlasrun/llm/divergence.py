"""Source divergence audit: terms of each source against the other sources of its language, by chunk factorization.

A text is white-space chunks, and white space never cuts a term. So chunks are counted for each document, each globally
distinct chunk is cut into terms once, and its terms are joined back to the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_folder, slices, written
from .records import scratch_folder

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Bytes of text whose chunks are counted at a time.
COUNT_BYTES = 16 << 20
#: Pairs of sources that a task weighs at a time.
PAIRS = 1 << 20
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GROUP = ["lang", "source"]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal (sorted) keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The chunks of each group of a batch: occurrences, documents, and the least and greatest of these."""
    lang, source = (batch[c].dictionary_encode() for c in _GROUP)
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    order = np.argsort(group, kind="stable")  # documents of one group stand together
    batch, group = batch.take(pa.array(order)), group[order]
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(batch["text"].cast(pa.string())))
    holder = np.repeat(np.arange(batch.num_rows), pc.list_value_length(chunks).to_numpy())
    coded = chunks.flatten().dictionary_encode()
    both = coded.indices.to_numpy().astype(np.int64) * batch.num_rows + holder
    both.sort()
    once = _runs(both)
    times, both = np.diff(np.append(once, len(both))), both[once]
    word, holder = np.divmod(both, max(1, batch.num_rows))
    keep = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[word]
    times, word, holder = times[keep], word[keep], holder[keep]
    begins = _runs(word, group[holder])
    rows = batch["row"].to_numpy()[holder]
    first = pa.array(holder[begins])
    reduced = ([f.reduceat(x, begins) if len(begins) else np.empty(0, np.int64) for f, x in ((np.add, times), (np.minimum, rows), (np.maximum, rows))])
    return pa.RecordBatch.from_arrays(
        [batch["lang"].take(first), batch["source"].take(first), coded.dictionary.take(pa.array(word[begins])), pa.array(reduced[0], pa.int64()),
         pa.array(np.diff(np.append(begins, len(word))), pa.int64()), pa.array(reduced[1], pa.int64()), pa.array(reduced[2], pa.int64())],
        names=["lang", "source", "chunk", "times", "docs", "low", "high"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", COUNT_BYTES):
        yield _counted(batch)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each chunk and how often it has them."""
    for batch in batches:
        chunks, terms, times = [], [], []
        for k, chunk in enumerate(batch["chunk"].cast(pa.binary()).to_pylist()):
            found = _TERM.findall(chunk)
            for term, n in (Counter(found) if len(found) > 1 else dict.fromkeys(found, 1)).items():
                chunks.append(k)
                terms.append(term)
                times.append(n)
        yield pa.RecordBatch.from_arrays([batch["chunk"].take(pa.array(chunks, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                                         names=["chunk", "term", "times"])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to their value, beyond what each of them adds alone: sums by pair of sources."""
    for batch in batches:
        parts = batch["parts"]
        flat, ends = parts.values, parts.offsets.to_numpy()
        names, p, z = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("z").to_numpy()
        langs = batch["lang"].dictionary_encode()
        lang, source, size = langs.indices.to_numpy().astype(np.int64), names.indices.to_numpy().astype(np.int64), np.diff(ends).astype(np.int64)
        sources, row = max(1, len(names.dictionary)), np.repeat(np.arange(batch.num_rows), size)
        held: list[tuple] = []
        for ours in np.split(np.arange(ends[0], ends[-1]), np.flatnonzero(np.diff(np.cumsum(size[row]) // PAIRS)) + 1):
            n = size[row[ours - ends[0]]]  # one source of a term with each of its sources
            left, which = np.repeat(ours, n), np.repeat(row[ours - ends[0]], n)
            right = ends[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            two = left != right
            left, right, which = left[two], right[two], which[two]
            more = divergence(p[left], p[right]) - divergence(p[left], z[right]) - divergence(z[left], p[right]) + divergence(z[left], z[right])
            key = (lang[which] * sources + source[left]) * sources + source[right]
            order = np.argsort(key, kind="stable")
            begins = _runs(key[order])
            if len(begins):
                held.append((key[order][begins], np.add.reduceat(more[order], begins)))
        keys, sums = (np.concatenate([h[k] for h in held]) if held else np.empty(0, np.int64) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        begins = _runs(keys[order])
        keys, sums = keys[order][begins], np.add.reduceat(sums[order], begins) if len(begins) else sums
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(keys // sources ** 2)), names.dictionary.take(pa.array(keys // sources % sources)), names.dictionary.take(pa.array(keys % sources)), pa.array(sums)],
            names=["lang", "source", "item", "more"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``, exactly at any size."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _kept(counts: DataFrame, chunks: DataFrame, cut: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, total`` of the terms in enough documents.

    A chunk in fewer than three documents is known with all of them, its least and its greatest. A term that has a chunk in enough documents
    is in enough; one whose chunks have too few together is not. For the others the documents of their chunks are told apart.
    """
    spread = written(counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.max("most").alias("most"), F.sum("docs").alias("docs")))
    sure = spread.where(F.col("most") >= min_docs)
    doubt = spread.where((F.col("most") < min_docs) & (F.col("docs") >= min_docs))
    some = cut.join(doubt.select("term").distinct(), "term", "left_semi").select("chunk", "term")
    rare = chunks.where(F.col("docs") < min_docs).join(some, "chunk").join(doubt.select("lang", "term"), ["lang", "term"], "left_semi")
    holders = rare.select("lang", "term", F.explode(F.array("low", "high")).alias("row")).distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    told = doubt.join(holders.where(F.col("n") >= min_docs).drop("n"), ["lang", "term"], "left_semi")
    return sure.unionByName(told).select("lang", "term", "total")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and its most telling terms.

    Null text, lang and source are empty strings. Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms
    in at least ``min_docs`` (1 to 3) of its rows; every row is a document, whatever its id. Each group (a language's source, also one without terms) and
    each language gives every kept term the share :func:`share`, and ``value`` is :func:`gap` of two shares, in whole numbers throughout.
    Part ``pair`` has the other sources of the language by the gap summed over all kept terms; part ``term`` the kept terms that a group has more of
    than its language, up to rank ``top_terms``. Ranks go by value, then by the item's bytes. An empty table gives no rows; other columns are ignored.

    Counts are summed for each task before they are shuffled, by group and chunk, so a hot source or chunk is a few rows of each task. Sums over pairs take
    every kept term of both: what a source's terms add against a source without them comes from a histogram of its shares, and what shared terms add beyond that is summed
    in arrays over the sources of each term. So no rows are made for terms that a source lacks. The result has a row for each pair of sources of a language, by contract.
    """
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs must be 1, 2 or 3: rare chunks are known by two of their documents")
    spark = docs.sparkSession
    root = scratch_folder(spark, "divergence")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{root}/{name}")

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _chunks, "lang string, source string, chunk string, times bigint, docs bigint, low bigint, high bigint")
    # Tasks have summed their own texts, so rows are dealt out as they are.
    chunks = stored(counted.repartition(*_GROUP, "chunk").groupBy(*_GROUP, "chunk").agg(
        F.sum("times").alias("times"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high")), "chunks")
    cut = stored(chunks.select("chunk").distinct().mapInArrow(_terms, "chunk string, term string, times bigint"), "terms")
    counts = stored(chunks.withColumnRenamed("times", "n").join(cut, "chunk").groupBy(*_GROUP, "term").agg(
        F.sum(F.col("n") * F.col("times")).alias("count"), F.max("docs").alias("most"), F.sum("docs").alias("docs")), "counts")
    kept = stored(_kept(counts, chunks, cut, min_docs), "kept")

    ours = stored(counts.select(*_GROUP, "term", "count").join(kept, ["lang", "term"]), "ours")
    whole = kept.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("terms"))
    sizes = ours.groupBy(*_GROUP).agg(F.sum("count").alias("size"))
    zero = F.lit(0).cast("bigint")
    groups = (named.select(*_GROUP).distinct().join(sizes, _GROUP, "left").join(whole, "lang", "left")
              .select(*_GROUP, F.coalesce("size", zero).alias("size"), F.coalesce("all", zero).alias("all"), F.coalesce("terms", zero).alias("terms")))
    groups = stored(groups.withColumn("z", F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms")))), "groups")
    shares = stored(ours.join(groups, _GROUP).select(
        *_GROUP, "term", share(F.col("count"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("all"), F.col("terms")).alias("q"), "z"), "shares")
    for name in ("chunks", "terms", "counts", "ours"):
        drop_folder(spark, f"{root}/{name}")

    telling = shares.where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    by_value = W.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    telling = telling.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    vectors = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("parts")).where(F.size("parts") > 1)
    shared = vectors.select("lang", "parts").mapInArrow(_shared, "lang string, source string, item string, more bigint").groupBy(*_GROUP, "item").agg(F.sum("more").alias("more"))
    histogram = shares.groupBy(*_GROUP, "p", "z").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), "terms")
    alone = histogram.join(other.drop("terms"), "lang").where("source <> item").groupBy(*_GROUP, "item").agg(
        F.sum(F.col("n") * (gap(F.col("p"), F.col("y")) - gap(F.col("z"), F.col("y")))).alias("out"),
        F.sum(F.col("n") * (gap(F.col("y"), F.col("p")) - gap(F.col("y"), F.col("z")))).alias("back"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "back")
    pairs = groups.select(*_GROUP, "z").join(other, "lang").where("source <> item").join(shared, [*_GROUP, "item"], "left") \
        .join(alone.drop("back"), [*_GROUP, "item"], "left").join(back, [*_GROUP, "item"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("z"), F.col("y"))).otherwise(zero) + sum((F.coalesce(c, zero) for c in ("more", "out", "back")), zero)
    pairs = pairs.select(*_GROUP, F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(telling)
