"""N-gram Jaccard join by a token-group matrix: similar documents are one group, and only groups that may hold a partner are opened.

A group is documents that share one of a few pairs of least token hashes, each going with the pair that most documents have; its size is bounded. The matrix has two forms.
By column, it lists the groups whose members have just these tokens in one part of the token space: linked documents differ in fewer tokens than there are parts, so
they agree on a part, and their groups meet in its column. By group, it has the union of the members' tokens as a row of bits (a bit stands for all tokens
that hash to it); a query's bits outside the union are tokens that no member can share, so what is left bounds the overlap. Only groups whose bound
reaches the least overlap are opened, and their members compared with the query on whole sets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import MIX, byte_texts, drop_folder, hashed, slices, windows, written
from .records import scratch_folder

WORDS = 3
#: Least similarity in percent.
LEAST = 90
#: Sizes of sets are cut into classes, each this much wider than the last one.
STEP = 1.5
#: Pairs of least hashes, of which a document has one in common with most documents like it.
LEADS = 8
#: Members and tokens (over all its members) of a group, about; queries that one task compares with a group.
GROUP_DOCS, GROUP_TOKENS, CELL_QUERIES = 2048, 1 << 20, 2048
#: Sets that a task remembers, so that their copies in the task have no columns.
SEEN = 100_000
#: Tokens (columns) and queries that are compared at a time.
COLUMNS, ROWS = 4096, 256
#: Ids up to which the documents of opened groups are looked up by broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000

FEATURES = "row bigint, doc_id bigint, n bigint, digest binary, columns array<bigint>, leads array<bigint>, bits binary"
_CELL = ["gid", "part"]

_BOUNDS = [10]  # sets of fewer tokens are only linked with equal ones or with some of ten
while _BOUNDS[-1] < 1 << 32:
    _BOUNDS.append(int(_BOUNDS[-1] * STEP))
_SEEDS = np.frombuffer(b"".join(xxhash.xxh3_64_digest(f"lead {k}") for k in range(2 * LEADS)), np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of three words, A-Z in lower case; fewer words are one run."""
    words = hashed(text.lower().split())
    return np.unique(windows(words, min(WORDS, max(len(words), 1))))


def least_overlap(n: int, percent: int = LEAST) -> int:
    """The least tokens that a set of ``n`` shares with any set it is linked with."""
    return -(-n * percent // 100)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX
    return x ^ x >> np.uint64(29)


def parts_of(size_class: int) -> tuple[int, int]:
    """Parts of the token space for a class of sizes, and how many more these are than linked sets have to agree on one."""
    differing = 2 * (_BOUNDS[size_class + 1] - 1) * (100 - LEAST) // (100 + LEAST)
    spare = 1 + differing // 16
    return differing + 1 + spare, spare


def columns_of(tokens: np.ndarray) -> np.ndarray:
    """A key for the tokens of a set in each part of the token space, in the class of its size and in the next one if partners may be there.

    Linked sets differ in ``parts - spare - 1`` tokens at most, so they agree on ``spare + 1`` parts. One of these has tokens, unless both sets have more than ``spare`` empty ones:
    then empty parts have keys too. So linked sets share a key in the class of the larger one.
    """
    n, out = len(tokens), []
    own = max(0, bisect.bisect_right(_BOUNDS, n) - 1)
    for size_class in (own, own + 1):
        if n < least_overlap(_BOUNDS[size_class]):
            continue
        parts, spare = parts_of(size_class)
        part = ((tokens >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        sums, named = np.add.reduceat(mixed(tokens)[order], begins), part[begins]
        if parts - len(named) > spare:
            empty = np.setdiff1d(np.arange(parts), named)
            sums, named = np.append(sums, np.zeros(len(empty), np.uint64)), np.append(named, empty)
        out.append(mixed(sums + (named.astype(np.uint64) + np.uint64(size_class << 40)) * MIX))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def leads_of(tokens: np.ndarray) -> np.ndarray:
    """Keys of pairs of tokens, each the one with the least value of a hash function."""
    least = np.array([(tokens * seed).min() for seed in _SEEDS]).reshape(LEADS, 2)
    return mixed(mixed(least[:, 0]) + least[:, 1])


def bits_of(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token, in a power of two of 8 bits or more that is at least twice their number."""
    size = 1 << max(3, (2 * len(tokens) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[((tokens >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same bits in fewer bytes."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def may_overlap(query: np.ndarray, n: int, union: np.ndarray) -> int:
    """At most this many of the ``n`` tokens of a query are in a group."""
    size = min(len(query), len(union))
    outside = folded(query, size) & ~folded(union, size)
    return n - int(np.bitwise_count(outside).sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for whole in batches:
        for batch in slices([whole], "text"):
            sets = [shingles(text) for text in byte_texts(batch["text"])]
            digests, columns = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], []
            for s, digest, doc in zip(sets, digests, batch["doc_id"].to_pylist()):
                columns.append(columns_of(s).view(np.int64) if len(s) and digest not in seen else None)
                if doc is not None and len(seen) < SEEN:  # a copy without an id does not stand for others
                    seen.add(digest)
            leads = [leads_of(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 *(pa.array(k, pa.list_(pa.int64())) for k in (columns, leads)), pa.array([bits_of(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["row", "doc_id", "n", "digest", "columns", "leads", "bits"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of the members' bits of each group; its rows come one after the other, the longest first."""
    gid, union = None, None
    for batch in batches:
        gids, unions = [], []
        for g, bits in zip(batch["gid"].to_pylist(), batch["bits"].to_pylist()):
            bits = np.frombuffer(bits, np.uint8)
            if g == gid:
                union = union | np.tile(bits, len(union) // len(bits))
                continue
            if gid is not None:
                gids.append(gid)
                unions.append(union.tobytes())
            gid, union = g, bits
        yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(unions, pa.binary())], names=["gid", "union"])
    if gid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), pa.array([union.tobytes()], pa.binary())], names=["gid", "union"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries and groups whose overlap may be enough."""
    for batch in batches:
        keep = [may_overlap(np.frombuffer(bits, np.uint8), n, np.frombuffer(union, np.uint8)) >= least_overlap(n)
                for n, bits, union in zip(*(batch[c].to_pylist() for c in ("n", "bits", "union")))]
        yield batch.select(["key", "gid"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices([whole], "text"):
            sets = [shingles(text) for text in byte_texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["digest", "items"])


class _Group:
    """The members of an opened group, what they are tied to, and the copies they are linked with."""

    def __init__(self, members: list[tuple]):
        self.keys, self.sizes, self.rows = (np.array([m[k] for m in members], np.int64) for k in range(3))
        sets = [np.frombuffer(m[3], np.uint64) for m in members]
        self.columns, column = np.unique(np.concatenate(sets), return_inverse=True)
        self.holder, self.column = np.repeat(np.arange(len(sets)), self.sizes), column
        self.tie, self.links, self.found = np.arange(len(sets)), np.zeros(len(sets), np.int64), []

    def _block(self, holder: np.ndarray, column: np.ndarray, rows: int, low: int, high: int) -> np.ndarray:
        out, here = np.zeros((rows, high - low), np.float32), (column >= low) & (column < high)
        out[holder[here], column[here] - low] = 1
        return out

    def common(self, holder: np.ndarray, column: np.ndarray, rows: int) -> np.ndarray:
        """Tokens that each of the rows shares with each member: products of matrices over a few columns at a time."""
        out = np.zeros((rows, len(self.keys)), np.int64)
        for low in range(0, len(self.columns), COLUMNS):
            high = min(low + COLUMNS, len(self.columns))
            out += (self._block(holder, column, rows, low, high) @ self._block(self.holder, self.column, len(self.keys), low, high).T).astype(np.int64)
        return out

    def linked(self, common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return common * 100 >= LEAST * (sizes[:, None] + self.sizes[None, :] - common)

    def _tied(self, key: int, partners: np.ndarray) -> None:
        """Ties a document and its partners by as few links as can be."""
        _, first = np.unique(self.tie[partners], return_index=True)
        for k in partners[first].tolist():
            if key != self.keys[k]:
                self.found.append((key, int(self.keys[k])))
        self.tie[np.isin(self.tie, self.tie[partners])] = self.tie[partners[0]]

    def among(self) -> None:
        """Links between members."""
        for low in range(0, len(self.keys), ROWS):
            rows = np.arange(low, min(low + ROWS, len(self.keys)))
            mine = (self.holder >= low) & (self.holder < low + ROWS)
            hit = self.linked(self.common(self.holder[mine] - low, self.column[mine], len(rows)), self.sizes[rows])
            hit[np.arange(len(rows)), rows] = False
            self.links[rows] += hit @ self.rows
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                self._tied(int(self.keys[rows[k]]), np.append(np.flatnonzero(hit[k]), rows[k]))

    def ask(self, queries: list[tuple]) -> list[tuple[int, int]]:
        """Links between members and queries that are larger, or as large with a larger key; the queries' own links."""
        keys, sizes, rows = (np.array([q[k] for q in queries], np.int64) for k in range(3))
        flat = np.concatenate([np.frombuffer(q[3], np.uint64) for q in queries])
        place = np.minimum(np.searchsorted(self.columns, flat), len(self.columns) - 1)
        known = self.columns[place] == flat
        hit = self.linked(self.common(np.repeat(np.arange(len(queries)), sizes)[known], place[known], len(queries)), sizes)
        hit &= (sizes[:, None] > self.sizes) | ((sizes[:, None] == self.sizes) & (keys[:, None] > self.keys))
        self.links += rows @ hit
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            self._tied(int(keys[k]), np.flatnonzero(hit[k]))
        return [(int(k), int(n)) for k, n in zip(keys, hit @ self.rows) if n]

    def told(self, links: list[tuple[int, int]]) -> pa.RecordBatch:
        links = links + [(int(k), int(n)) for k, n in zip(self.keys, self.links) if n]
        found, self.links, self.found = self.found, np.zeros_like(self.links), []
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found + links], pa.int64()), pa.array([x[1] for x in found] + [None] * len(links), pa.int64()),
             pa.array([None] * len(found) + [x[1] for x in links], pa.int64())], names=["a", "b", "n"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each opened group. Its members come first, then its queries, a bounded number of which is held at a time."""
    cell, members, group, queries = None, [], None, []

    def ended() -> Iterator[pa.RecordBatch]:
        if members:
            now = group or _Group(members)
            if group is None and cell[1] == 0:
                now.among()
            yield now.told(now.ask(queries) if queries else [])

    for batch in batches:
        for gid, part, asks, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (gid, part) != cell:
                yield from ended()
                cell, members, group, queries = (gid, part), [], None, []
            if not asks:
                members.append(row)
                continue
            if group is None:
                group = _Group(members)
                if part == 0:
                    group.among()
            queries.append(row)
            if len(queries) == ROWS:
                yield group.told(group.ask(queries))
                queries = []
    yield from ended()


def _groups(sets: DataFrame) -> DataFrame:
    """``key, gid, shared``: the group of each class, from its ``leads``; ``shared`` tells groups that may have several members."""
    leads = sets.select("key", "n", F.explode("leads").alias("lead"))
    common = leads.groupBy("lead").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    best = leads.join(common, "lead").groupBy("key").agg(F.max(F.struct("docs", "lead")).alias("best"), F.first("n").alias("n")).select("key", "n", "best.lead")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_DOCS, F.sum("n") / GROUP_TOKENS)).cast("bigint")
    crowds = best.groupBy("lead").agg(blocks.alias("blocks"))
    chosen = best.join(crowds, "lead").select("key", F.xxhash64("lead", F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("gid"))
    return sets.select("key").join(chosen, "key", "left").select("key", F.coalesce("gid", F.xxhash64("key")).alias("gid"), F.col("gid").isNotNull().alias("shared"))


def _entries(features: DataFrame, groups: DataFrame) -> DataFrame:
    """``column, key, gid`` of the columns that several classes have.

    Columns go by a 64-bit ``mark`` of the set, so they are dealt out once, without a look at which row stands for its class; two sets of one mark would
    have to be alike themselves for a link to be missed.
    """
    columns = features.where("doc_id is not null and n > 0").select(F.xxhash64("digest").alias("mark"), F.explode("columns").alias("column")).repartition("column")
    shared = columns.groupBy("column").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("column")
    return columns.join(shared, "column", "left_semi").distinct().join(groups.select("mark", "key", "gid"), "mark").select("column", "key", "gid")


def _met(entries: DataFrame) -> DataFrame:
    """``column, gid, held, other``: groups with this column in common, both ways round, and how many classes of the first one have it."""
    listed = entries.groupBy("column", "gid").agg(F.count(F.lit(1)).alias("held"))
    torn = listed.groupBy("column").agg(F.min("gid").alias("x"), F.max("gid").alias("y")).where("x <> y").select("column")
    rest = listed.join(torn, "column", "left_semi")
    return rest.join(rest.select("column", F.col("gid").alias("other")), "column").where("gid <> other")


def _asks(entries: DataFrame, narrow: DataFrame, met: DataFrame) -> DataFrame:
    """``key, gid``: classes and the other groups that may hold a partner.

    A class asks the groups that it shares a column with. Where the classes of its group have more columns in common with the other group than there are
    classes, all of them ask it instead, so many common columns of many classes are not listed.
    """
    docs = narrow.groupBy("gid").agg(F.count(F.lit(1)).alias("docs"))
    pairs = met.join(docs, "gid")
    few = pairs.where("held < docs").select("gid", "other")
    listed = _met(entries).join(few, ["gid", "other"], "left_semi").join(entries, ["column", "gid"]).select("key", "other").distinct()
    every = narrow.join(pairs.where("held >= docs"), "gid").select("key", "other")
    return listed.unionByName(every).withColumnRenamed("other", "gid")


def set_join(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    Documents are linked if the common part of their sets of distinct three-word runs is nine tenths of the union or more; ``n_links`` counts the linked rows, copies included, and
    ``component_id`` is the least id that links lead to. A text with fewer words is one run; null, empty and blank texts are linked with nothing, and so are rows with a null id.
    Rows with one id are judged each by its own text, and an id alone ties nothing. Other columns are ignored; an empty table gives no rows.

    Equal sets are one class, so copies cost a row each. No pair is missed: linked documents share a column by counting, and every bound holds for all
    members. A group has a bounded size, and a task compares it with a bounded number of queries, by products of matrices; what comes out is the links that tie a group and sums. Where
    very many *different* texts are alike, each of them is compared with all groups of the others, since all links are counted.
    """
    spark = docs.sparkSession
    root = scratch_folder(spark, "set-join")
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = written(named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_features, FEATURES), f"{root}/features")
    alike = written(features.where("doc_id is not null and n > 0").groupBy("digest").agg(
        F.min("row").alias("key"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")), f"{root}/alike")
    leads = features.select(F.col("row").alias("key"), "n", "leads").join(alike.select("key"), "key", "left_semi")
    groups = written(_groups(leads), f"{root}/groups")
    entries = written(_entries(features, groups.join(alike.select("key", F.xxhash64("digest").alias("mark")), "key")), f"{root}/entries")
    met = written(_met(entries).groupBy("gid", "other").agg(F.sum("held").alias("held")), f"{root}/met")
    others = met.select(F.col("other").alias("gid")).distinct()
    # Only classes that share a column can have a partner.
    narrow = written(groups.join(entries.select("key").distinct(), "key", "left_semi").join(alike.select("key", "n", "rows"), "key"), f"{root}/narrow")
    sizes = narrow.groupBy("gid").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    asks = _asks(entries, narrow, met).join(narrow.select("key", "n"), "key").join(sizes, "gid")
    asks = asks.where((F.col("low") <= F.col("n")) & (F.col("high") * 100 >= F.col("n") * LEAST)).select("key", "n", "gid")
    bits = features.select(F.col("row").alias("key"), "bits")
    of_groups = narrow.join(others, "gid", "left_semi").join(bits, "key")
    many = of_groups.where("shared").select("gid", "bits").repartition("gid").sortWithinPartitions("gid", F.octet_length("bits").desc()).mapInArrow(_unions, "gid bigint, union binary")
    unions = many.unionByName(of_groups.where("not shared").select("gid", F.col("bits").alias("union")))
    weighed = asks.join(bits, "key").join(unions, "gid").select("key", "gid", "n", "bits", "union")
    opened = written(weighed.mapInArrow(_bounded, "key bigint, gid bigint"), f"{root}/opened")
    members = written(features.select("doc_id", "n", "digest"), f"{root}/members")
    for name in ("features", "groups", "entries", "met"):
        drop_folder(spark, f"{root}/{name}")

    asked = opened.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("bigint").alias("parts"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    inside = narrow.join(asked, "gid", "left").where("shared or parts is not null").select("gid", parts, F.lit(False).alias("asks"), "key", "n", "rows")
    outside = opened.join(asked, "gid").join(narrow.drop("gid", "shared"), "key").select(
        "gid", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), F.lit(True).alias("asks"), "key", "n", "rows")
    rows = written(inside.unionByName(outside), f"{root}/rows")
    wanted = alike.join(rows.select("key").distinct(), "key", "left_semi").select("key", "digest", "least")
    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    texts = named.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "digest binary, items binary").dropDuplicates(["digest"])
    filled = rows.join(wanted.select("key", "digest"), "key").join(sets, "digest").select(*_CELL, "asks", "key", "n", "rows", "items")
    found = written(filled.repartition(*_CELL).sortWithinPartitions(*_CELL, "asks").mapInArrow(_opened, "a bigint, b bigint, n bigint"), f"{root}/found")

    clusters = connected_components(alike.select(F.col("key").alias("id")), found.where("b is not null").select("a", "b"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    named_class = alike.withColumnRenamed("key", "id").join(clusters, "id")
    least = named_class.groupBy("cluster").agg(F.min("least").alias("component_id"))
    told = named_class.join(least, "cluster").join(counts, "id", "left").select(
        "digest", "component_id", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    linked = members.where("doc_id is not null and n > 0").join(told, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    apart = members.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(apart)
