"""Packing: first-fit decreasing by a tournament tree of free room, in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices
from .tokens import encoder, LOWER_WORDS

LENGTH = 2048
END_ID = 1
#: Documents of a group, about. A group's rests, each under one sequence, are in one task.
GROUP_DOCS = 1024
#: Numbers of sequences that a group has; the upper half is for whole pieces.
GROUP_IDS = 1 << 32


class Rooms:
    """A tournament tree over bins: each inner node has the largest free room below it, so the first fitting bin is one descent."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first bin with room for it; the bin and the room it had."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.tree[node] < size:
                node += 1
        had = self.tree[node]
        bin_ = node - self.leaves
        self.tree[node] = had - size
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin of each size and its offset there; larger sizes first, ties in the given order."""
    rooms, bins, offsets = Rooms(len(sizes), room), [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bins[k], had = rooms.place(sizes[k])
        offsets[k] = room - had
    return bins, offsets


PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path, LOWER_WORDS).encode, np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(list(byte_texts(batch["text"])))):
                data = ids + last
                n = len(data) // 4
                rows.extend((doc, k, min(length, n - k), n, data[4 * k:4 * (k + length)]) for k in range(0, n, length))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 4 else pa.int64()) for k in range(5)],
                                             names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def _packed(length: int):
    """Numbers the sequences of each group; rows come by group, whole pieces first, and only rests are held."""
    def placed(group: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), length)
        yield from told(rows, np.array(bins, np.int64) + group * GROUP_IDS, np.array(offsets, np.int64))

    def told(rows: pa.Table, sequences: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = rows.drop_columns(["group"]).append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))
        yield from out.to_batches(max_chunksize=1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, held = None, 0, []
        for batch in batches:
            groups = batch["group"].to_numpy()
            edges = np.flatnonzero(np.diff(groups)) + 1
            for begin, end in zip([0, *edges], [*edges, len(groups)]):
                if begin == end:
                    continue
                if groups[begin] != at:
                    if held:
                        yield from placed(at, held)
                    at, seen, held = int(groups[begin]), 0, []
                part = batch.slice(int(begin), int(end - begin))
                n = int((part["length"].to_numpy() == length).sum())
                if n:
                    yield from told(pa.Table.from_batches([part.slice(0, n)]), at * GROUP_IDS + GROUP_IDS // 2 + seen + np.arange(n), np.zeros(n, np.int64))
                    seen += n
                if n < part.num_rows:
                    held.append(part.slice(n))
        if held:
            yield from placed(at, held)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID, doc: str = "doc_id", text: str = "text",
                   group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    A document is the ids of its whole text by the tokenizer file (null is empty) and then ``end``. It is cut at
    multiples of ``length``; each whole piece is a sequence of its own. Pieces are dealt at random, by a hash of the
    id, place and ids, to groups, and the rests of a group, about ``group_docs`` of them, are packed by first-fit
    decreasing. Offsets are gapless from 0 in each sequence; what is left of it is padding. ``ids`` are
    little-endian 32-bit.

    Null and repeated ids are documents like any other. Other columns are ignored; an empty table gives no rows.
    Texts are encoded once and pieces shuffled once. A document has one rest, so a task holds about
    ``group_docs`` times ``length`` ids, however long documents are.
    """
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, round(named.count() / group_docs))
    pieces = named.mapInArrow(_pieces(tokenizer, length, end), PIECE)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids")), F.lit(groups)))
    sorted_ = dealt.repartition("group").sortWithinPartitions("group", F.col("length") < length, "doc_id", "start", "doc_tokens", "ids")
    return sorted_.mapInArrow(_packed(length), f"{PIECE}, sequence_id bigint, offset bigint")
