"""Near duplicates: banded MinHash finds candidates, odd sketches weigh them, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage, cut_packed
from .common import MIX, byte_texts, hashed, slices, windows

WORDS = 5
#: A pair at the least similarity of 0.75 shares no band with probability (1 - 0.75 ** 6) ** 48 = 8e-5.
BANDS, ROWS = 48, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Pairs whose sketches estimate less than this are not compared in full; a pair at 0.75 is over five deviations above.
LEAST_ESTIMATE = 0.55
#: Runs of words, over all its members, that a block of a crowded bucket has, about; a task compares two blocks at a time.
BLOCK = 500_000

_seeds = np.frombuffer(b"".join(xxhash.xxh3_64_digest(f"minhash {k}") for k in range(SAMPLES)), np.uint64)
_FACTOR, _SHIFT = (_seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _seeds.astype(np.uint32)
_SALT = np.arange(1, SAMPLES + 1, dtype=np.uint64) * MIX

#: Ids up to which the documents to compare are looked up by broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000

#: Narrow rows that the features of a class are as wide as.
NODE_WIDTH = 16

FEATURES = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"


def most_apart(similarity: float = LEAST_ESTIMATE) -> int:
    """Bits in which sketches of sets with this similarity differ on average."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity))))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, A-Z in lower case; fewer words are one run."""
    words = hashed(text.lower().split())
    return np.unique(windows(words, WORDS if len(words) >= WORDS else max(len(words), 1)))


def minhashes(found: np.ndarray) -> np.ndarray:
    """For each of the samples the least value over the set."""
    x, least = (found >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k:k + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its samples and its number."""
    keyed = least.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for k in range(ROWS):
        out = (out ^ keyed[:, k]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch_of(least: np.ndarray) -> np.ndarray:
    """The parity of how many samples fall on each bit."""
    mixed = (least.astype(np.uint64) ^ _SALT) * MIX
    mixed ^= mixed >> np.uint64(32)
    odd = np.bincount((mixed % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n, digest, bands, sketch = [], [], [], []
        for text in byte_texts(batch["text"]):
            found = shingles(text)
            n.append(len(found))
            least = minhashes(found) if len(found) else None
            digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(bands_of(least) if len(found) else None)
            sketch.append(sketch_of(least) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingles(text).view(np.int64) for text in byte_texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "items"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each cell; they come sorted by cell, ``(key, low, high)`` first."""
    def values(column: pa.Array) -> list:
        if not pa.types.is_list(column.type):
            return column.to_pylist()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*map(values, batch.columns)):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class _Members:
    """Members of a cell as arrays: ``key, low, high, rep, comp, block, size, sketch`` and whatever follows.

    A cell of two blocks pairs members of one with those of the other.
    """

    def __init__(self, rows: list[tuple]):
        self.ids, self.comp, self.block, self.sizes = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        self.bits, self.two = np.array([r[7] for r in rows], np.int64).view(np.uint64), rows[0][1] != rows[0][2]
        self.most = most_apart()

    def close(self, k: int) -> np.ndarray:
        """Later members in other components that are close to the k-th in size and sketch."""
        rest = slice(k + 1, None)
        fit = (self.comp[rest] != self.comp[k]) & (np.minimum(self.sizes[rest], self.sizes[k]) * 100 >= 75 * np.maximum(self.sizes[rest], self.sizes[k]))
        if self.two:
            fit &= self.block[rest] != self.block[k]
        near = np.flatnonzero(fit) + k + 1
        return near[np.bitwise_count(self.bits[near] ^ self.bits[k]).sum(axis=1, dtype=np.int64) <= self.most]


def _close_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that have a close one in another component."""
    for rows in _cells(batches):
        members, found = _Members(rows), np.zeros(len(rows), bool)
        for k in range(len(rows) - 1):
            near = members.close(k)
            found[near] = True
            found[k] |= len(near) > 0
        kept = [r[:4] for r, f in zip(rows, found) if f]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], pa.int64()) for k in range(4)], names=["key", "low", "high", "rep"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sets share, each in the order of :func:`shingles`."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within a cell that tie what its pairs tie, confirmed on whole sets: at most one less than it has members.

    Members that a link has tied are not compared again. A pair that shares several bands is compared in the
    cell of the first one only.
    """
    for rows in _cells(batches):
        members, bands, key = _Members(rows), np.array([r[8] for r in rows], np.int64), rows[0][0]
        sets, out = [r[9] for r in rows], []
        for k in range(len(rows) - 1):
            near = members.close(k)
            first = (bands[near] == bands[k]).argmax(axis=1)
            for j in near[bands[k][first] == key].tolist():
                if members.comp[j] != members.comp[k]:
                    common = _common(sets[j], sets[k])
                    if common * 100 >= (len(sets[j]) + len(sets[k]) - common) * 75:
                        out.append((int(members.ids[k]), int(members.ids[j])))
                        members.comp[members.comp == members.comp[j]] = members.comp[k]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, items`` of the documents with the given (distinct) ``doc_id``, written once."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return cut_lineage(texts.mapInArrow(_sets, "doc_id bigint, items array<bigint>"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs close in size and sketch whose whole sets have 100 * common >= 75 * union."""
    a, b = (nodes.select(F.col("rep").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    apart = sum((F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 75
    close = cut_packed(pairs.join(a, "a").join(b, "b").where(fit & (apart <= most_apart())).select("a", "b"))
    sets = _sets_of(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), docs)
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"i{x}")) for x in "ab")
    both = close.join(a, "a").join(b, "b").select("a", "b", (F.size("ia") + F.size("ib")).alias("all"), F.size(F.array_intersect("ia", "ib")).alias("common"))
    return both.where("common * 100 >= (all - common) * 75").select("a", "b").distinct()


def _torn(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are not all connected, with their component as ``comp``."""
    tied = shared.join(components.select(F.col("id").alias("rep"), F.col("cluster").alias("comp")), "rep")
    torn = tied.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return tied.join(torn, "key", "left_semi")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of ``rep`` and ``lead``, smaller id first."""
    return rows.where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _led(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Members of torn buckets with the two leaders of the bucket that they are not connected to."""
    stars = _torn(shared, components).select("rep", "comp", F.explode(F.array("first", "second")).alias("lead"))
    led = components.select(F.col("id").alias("lead"), F.col("cluster").alias("led"))
    return _pairs(stars.distinct().join(led, "lead").where("comp <> led"))


def _untied(shared: DataFrame, nodes: DataFrame, components: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, confirmed on whole sets.

    Crowded buckets are cut into blocks at random, by the size of all sets in them, and each pair of blocks is a
    cell, so no task holds more than about two blocks of a bucket at once. A first pass over sketches finds the members that have a close
    one in another component; only those come back with their sets. No pairs are listed but links.
    """
    cell = ["key", "low", "high"]
    rest = _torn(shared, components).withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    cells = rest.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "comp", "block")
    known = nodes.select("rep", F.struct("size", "sketch", "bands").alias("of"))
    columns = [*cell, "rep", "comp", "block", F.col("of.size").alias("size"), F.col("of.sketch").alias("sketch")]
    members = cells.join(known, "rep").select(*columns)
    near = cut_packed(members.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_close_members, "key bigint, low bigint, high bigint, rep bigint"))
    sets = _sets_of(near.select(F.col("rep").alias("doc_id")).distinct(), docs).withColumnRenamed("doc_id", "rep")
    whole = cells.join(near, [*cell, "rep"], "left_semi").join(known, "rep").join(sets, "rep").select(*columns, "of.bands", "items")
    return whole.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cell_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets of distinct five-word runs have at least three quarters of their union in
    common; a component is what links connect, named after its smallest id. A text with fewer words is one
    run; null, empty and blank texts are linked with nothing. Rows with one id are one vertex: they share links and are
    kept or dropped together. Rows with a null id are linked with nothing and kept, with a null component.
    Other columns are ignored; an empty table gives no rows.

    Equal sets are one class, found by digest, so copies cost one row each. Classes meet in buckets, one for each
    value of a band of MinHash samples. First each class is compared with the smallest id it meets, then with two
    leaders of each bucket it is not yet connected to, both linear in the rows; what is then still in different
    components within a bucket is compared in blocks of bounded size by odd sketch, the parities of the
    folded samples. Sketches discard pairs far below the threshold and all others are confirmed on whole
    sets. Leaders only save work: every pair that shares a bucket is confirmed, rejected, or already connected.
    """
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = cut_lineage(named.mapInArrow(_features, FEATURES))
    sets = features.where("doc_id is not null and n_shingles > 0")
    nodes = cut_packed(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("of"))
                        .select("digest", "rep", F.col("of.n_shingles").alias("size"), "of.bands", "of.sketch"), NODE_WIDTH)
    buckets = nodes.select("rep", F.col("size").cast("int").alias("size"), F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("rep").alias("first"), F.max_by("rep", F.xxhash64("rep")).alias("second"))
    shared = cut_packed(buckets.drop("size").join(leaders.where("n > 1").drop("n"), "key"))
    texts, vertices = named.where("doc_id is not null"), nodes.select(F.col("rep").alias("id"))
    first = _pairs(shared.groupBy("rep").agg(F.min("first").alias("lead")))
    links = cut_packed(_confirmed(first, nodes, texts))
    components = cut_packed(connected_components(vertices, links))
    for step in (lambda: _confirmed(_led(shared, components), nodes, texts), lambda: _untied(shared, nodes, components, texts)):
        more = cut_packed(step())
        if not more.isEmpty():
            links = links.union(more)
            components = cut_packed(connected_components(vertices, links))
    named_class = nodes.select("digest", F.col("rep").alias("id")).join(components, "id").select("digest", "cluster")
    member = F.coalesce("cluster", "doc_id")
    return features.select("doc_id", "n_shingles", "digest").join(named_class, "digest", "left").select(
        "doc_id", "n_shingles", member.alias("component_id"), F.coalesce(F.col("doc_id") == member, F.lit(True)).alias("kept"))
