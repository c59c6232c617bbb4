"""Benchmark decontamination by winnowing: shared fingerprints are extended to every shared run of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import byte_texts, hashed, slices, windows

#: Words of a window; a run of them in a benchmark item counts as a leak.
WINDOW = 10
#: Words of a hashed gram, and of consecutive grams of which the least is a fingerprint: every run of GRAM + SPAN - 1 = WINDOW words has one.
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Bytes of benchmark text up to which its index is sent to every executor; beyond, fingerprints are joined.
BROADCAST_BYTES = 32 << 20

#: Lower case for A-Z, a blank for every other ASCII character but digits and a-z; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COLUMNS = "n_words bigint, n_hit bigint, n_items bigint, items array<bigint>, spans array<struct<start:int,length:int>>, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the least gram of each span of grams, the leftmost among equals; each place once."""
    grams = windows(hashes, GRAM)
    if len(grams) < SPAN:
        return np.empty(0, np.int64), grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(axis=1)
    places = np.unique(least + np.arange(len(least)))
    return places, grams[places]


@dataclass
class Index:
    """The word hashes of items, and where each fingerprint (or short item as a whole) is found in them."""

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    where: list[list[tuple[int, int]]] = field(default_factory=list)
    short: dict[int, np.ndarray] = field(default_factory=dict)
    short_items: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[int, bytes]]) -> Index:
        index, found = Index(), {}
        for item, text in items:
            hashes = hashed(words_of(text))
            k = len(index.ids)
            index.ids.append(item)
            index.words.append(hashes)
            if 0 < len(hashes) < WINDOW:
                index.short_items.setdefault((len(hashes), int(windows(hashes, len(hashes))[0])), []).append(k)
            else:
                for place, value in zip(*fingerprints(hashes)):
                    found.setdefault(int(value), []).append((k, int(place)))
        index.values = np.array(sorted(found), np.uint64)
        index.where = [found[int(v)] for v in index.values]
        for n in {n for n, _ in index.short_items}:
            index.short[n] = np.array(sorted(v for m, v in index.short_items if m == n), np.uint64)
        return index


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _same_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(at + step, n)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, 2 * step
    return n


def search(hashes: np.ndarray, index: Index) -> tuple[np.ndarray, set[int]]:
    """Which words of a document are hit, and the places in the index of items with occurring windows.

    Each fingerprint that the document shares with an item is extended to both sides while words are equal; a
    run of ten words or more is a hit in full, since all of its windows are the item's. Fingerprints inside a run
    found for the same item and offset are passed over.
    """
    hit, items = np.zeros(len(hashes) + 1, np.int64), set()
    places, values = fingerprints(hashes)
    reached: dict[tuple[int, int], int] = {}
    for p, v in zip(*(x[_among(values, index.values)] for x in (places, values))):
        for item, q in index.where[int(np.searchsorted(index.values, v))]:
            if reached.get((item, p - q), -1) > p:
                continue
            known = index.words[item]
            before = _same_run(hashes[:p][::-1], known[:q][::-1])
            after = _same_run(hashes[p:], known[q:])
            reached[item, p - q] = p + after
            if before + after >= WINDOW:
                items.add(item)
                hit[p - before] += 1
                hit[p + after] -= 1
    for n, known in index.short.items():
        runs = windows(hashes, n)
        for p in np.flatnonzero(_among(runs, known)):
            items.update(index.short_items[n, int(runs[p])])
            hit[p] += 1
            hit[p + n] -= 1
    return np.cumsum(hit[:-1]) > 0, items


def spans_of(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as first word and length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]


def _judged(batch: pa.RecordBatch, text: str, found: Callable[[int, np.ndarray], tuple[np.ndarray, set[int]]]) -> list[pa.Array]:
    rows = []
    for k, data in enumerate(byte_texts(batch[text])):
        hashes = hashed(words_of(data))
        hit, items = found(k, hashes)
        listed = sorted(items)
        rows.append((len(hashes), int(hit.sum()), len(listed), listed, spans_of(hit),
                     hashlib.sha256(",".join(sorted(map(str, listed))).encode()).hexdigest(), bool(hit.any())))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
             pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), pa.string(), pa.bool_())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans, items_sha256, contaminated``.

    Words are runs of letters and digits, A-Z in lower case, and of any characters beyond ASCII. A window is ten
    consecutive words of an item; an item with one to nine words is one window. A word is hit if it lies in an
    occurrence of a window; ``spans`` are the runs of hit words, ``items`` the ids whose windows occur. Null and
    empty texts have no words. Items without words or with a null id are left out, and texts of one repeated id
    belong to the same item. Rows with null or repeated document ids are rows like any other; other columns are ignored.

    A benchmark of up to ``broadcast_bytes`` of text is indexed once and sent to the executors, and documents are
    read in one pass without a shuffle. For a larger one, fingerprints of both sides are joined and each
    document meets only the items it shares one with.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("said")).where("item is not null and said is not null")
    named = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(named, items, kind)
    index = docs.sparkSession.sparkContext.broadcast(Index.of([(r.item, r.said.encode()) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(_: int, hashes: np.ndarray) -> tuple[np.ndarray, set[int]]:
            hit, places = search(hashes, index.value)
            return hit, {index.value.ids[k] for k in places}

        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_judged(batch, "text", found)],
                                             names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return named.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def _prints(short: tuple[int, ...], name: str, text: str) -> Callable:
    """Distinct fingerprints of each row as ``(row, value)``; runs of ``short`` lengths stand for short items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows, values = [], []
            for row, data in zip(batch[name].to_pylist(), byte_texts(batch[text])):
                hashes = hashed(words_of(data))
                if name == "item" and 0 < len(hashes) < WINDOW:
                    found = windows(hashes, len(hashes))
                else:
                    found = np.unique(np.concatenate([fingerprints(hashes)[1], *(windows(hashes, n) for n in short)]))
                rows.append(np.full(len(found), row, np.int64))
                values.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(values))], names=[name, "value"])

    return run


def _joined(named: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """The same for a benchmark of any size: documents meet the items they share a fingerprint with."""
    rows = cut_lineage(named.withColumn("row", F.monotonically_increasing_id()))
    count = F.size(F.split(F.trim(F.regexp_replace("said", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "))
    short = tuple(r[0] for r in items.select(count.alias("n")).where(f"n < {WINDOW}").distinct().collect())
    known = items.mapInArrow(_prints((), "item", "said"), "item bigint, value bigint").distinct()
    pairs = rows.select("row", "text").mapInArrow(_prints(short, "row", "text"), "row bigint, value bigint").join(known, "value").select("row", "item").distinct()
    # Items of a document travel with it one by one, so a document that meets many is many small rows.
    met = pairs.join(items, "item").join(rows.select("row", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, hits = [], []
            for row, item, said, data in zip(batch["row"].to_pylist(), batch["item"].to_pylist(), byte_texts(batch["said"]), byte_texts(batch["text"])):
                hit, places = search(hashed(words_of(data)), Index.of([(item, said)]))
                if places:
                    out.append((row, item))
                    hits.append(spans_of(hit))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(
                hits, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["row", "item", "spans"])

    found = met.select("row", "item", "said", "text").mapInArrow(run, "row bigint, item bigint, spans array<struct<start:int,length:int>>")
    told = found.groupBy("row").agg(F.collect_set("item").alias("__items"), F.flatten(F.collect_set("spans")).alias("__spans"))
    both = rows.join(told, "row", "left").select("doc_id", "text", "__items", "__spans")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            met_items, met_spans = batch["__items"].to_pylist(), batch["__spans"].to_pylist()

            def of(k: int, hashes: np.ndarray) -> tuple[np.ndarray, set[int]]:
                hit = np.zeros(len(hashes), bool)
                for span in met_spans[k] or ():
                    hit[span["start"]:span["start"] + span["length"]] = True
                return hit, set(met_items[k] or ())

            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_judged(batch, "text", of)],
                                             names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return both.mapInArrow(merge, f"doc_id {kind}, {COLUMNS}")
