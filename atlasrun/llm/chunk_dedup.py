"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest; only at the ends of what is common are runs compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, MIX, slices

#: Words of a run from which it counts as repeated.
PASSAGE_WORDS = 20
#: Words that the gear hash at a word end sees, and bits by which it moves on with each word.
GEAR_WORDS, GEAR_SHIFT = 5, 4
#: Words of a chunk, at least and at most.
LEAST_WORDS, MOST_WORDS = 1, 4
#: Bytes of text that are hashed together.
TOGETHER = 1 << 20

#: A random value for each byte.
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

PART = "doc_id bigint, version bigint, start int, length int, n_words bigint, first_doc_id bigint, removed boolean"


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a UTF-8 text, and the byte after it."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(1 << bits, base, np.uint64))) for base in (int(MIX), pow(int(MIX), -1, 1 << 64)))


def stretch_digests(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch of a sequence of hashes, from running sums of their products with powers of an odd number."""
    powers, inverse = _powers(max(20, len(values).bit_length()))
    sums = np.append(np.uint64(0), np.cumsum(values * powers[:len(values)], dtype=np.uint64))
    out = ((sums[ends] - sums[begins]) * inverse[begins] ^ (ends - begins).astype(np.uint64)) * MIX
    out = (out ^ out >> np.uint64(32)) * MIX
    return out ^ out >> np.uint64(29)


def word_hashes(data: bytes, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text, from its bytes; a stretch of the text at a time."""
    codes, out, at = np.frombuffer(data, np.uint8), np.empty(len(first), np.uint64), 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(after, first[at] + TOGETHER, "right")))
        begin, end = first[at], after[stop - 1]
        out[at:stop] = stretch_digests(_BYTES[codes[begin:end]], first[at:stop] - begin, after[at:stop] - begin)
        at = stop
    return out


def reach(width: int) -> tuple[int, int]:
    """Words that the gear hash sees, and word ends of a window; two windows that do not overlap fit into a run of ``width`` words."""
    look = max(1, min(GEAR_WORDS, width // 4))
    return look, min(MOST_WORDS, (width + 1 - look) // 2)


def gear_ends(hashes: np.ndarray, look: int = GEAR_WORDS) -> np.ndarray:
    """The rolling hash at the end of each word: of the last ``look`` words, each shifted by its distance."""
    values = (hashes >> np.uint64(64 - GEAR_SHIFT * GEAR_WORDS)).astype(np.uint32)
    out = values.copy()
    for k in range(1, min(look, len(values))):
        out[k:] += values[:-k] << np.uint32(GEAR_SHIFT * k)
    return out & np.uint32((1 << GEAR_SHIFT * GEAR_WORDS) - 1)


def chosen_ends(hashes: np.ndarray, look: int, span: int) -> np.ndarray:
    """The word end that each window of ``span`` word ends chooses: the one with the least gear hash, the first among equals.

    Chosen word ends are the boundaries of chunks. They depend on nearby words only, and no chunk has more than ``span`` words.
    """
    out = gear_ends(hashes, look).astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    left, step = span - 1, 1
    while left and len(out):
        step = min(step, left)
        out = np.minimum(out[:-step], out[step:])
        left, step = left - step, 2 * step
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunk_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last word, and word count of each chunk of a UTF-8 text, however its words are set."""
    first, after = word_bounds(data)
    chosen = chosen_ends(word_hashes(data, first, after), *reach(PASSAGE_WORDS))
    ends = np.unique(np.append(chosen + 1, len(first))) if len(first) else np.empty(0, np.int64)
    begins = np.concatenate([ends[:0], [0] if len(ends) else [], ends[:-1]]).astype(np.int64)
    return first[begins], after[ends - 1], ends - begins


def seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    """The seed of each run of ``width`` words: the least digest of its chunks, each taken with the words that set its first boundary.

    Only boundaries chosen by windows inside the run count. As two windows that do not overlap are inside, there is such a chunk, and
    as it depends on the words of the run alone, equal runs have equal seeds. Neighbouring runs mostly share theirs.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    look, span = reach(width)
    chosen = chosen_ends(hashes, look, span)
    turn = np.append(True, chosen[1:] != chosen[:-1])
    ends, rank = chosen[turn], np.cumsum(turn) - 1
    digests = stretch_digests(hashes, np.maximum(ends[:-1] + 1 - look, 0), ends[1:] + 1)
    low, high = rank[look - 1:look - 1 + n], rank[width - span:width - span + n]
    out = digests[low]
    for k in range(1, int((high - low).max())):
        np.minimum(out, digests[np.minimum(low + k, high - 1)], out=out)
    return out


class Texts:
    """The words of some texts one after the other, so that they are hashed together; runs over the end of a text are left out."""

    def __init__(self, texts: list[bytes], width: int):
        data, self.width = b"\n".join(texts), width
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.bytes = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.first, after = word_bounds(data)
        self.hashes = word_hashes(data, self.first, after)
        self.places = np.searchsorted(self.first, np.append(self.bytes, len(data) + 1))
        which = np.repeat(np.arange(len(texts)), np.diff(self.places))
        n = max(0, len(which) - width + 1)
        #: Places of the runs, and which text each is in.
        self.runs = np.flatnonzero(which[:n] == which[len(which) - n:])
        self.text = which[self.runs]

    def seeds(self) -> np.ndarray:
        """The seed of each run."""
        return seeds(self.hashes, self.width)[self.runs]

    def run_hashes(self, second: bool = False) -> np.ndarray:
        """A hash of each run, or another one."""
        return run_hashes((self.hashes ^ self.hashes >> np.uint64(31)) * MIX if second else self.hashes, self.width)[self.runs]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, seed and digest of each block, once a text: neighbouring runs with one seed, with all their words."""
        found = self.seeds()
        turn = np.flatnonzero((found[1:] != found[:-1]) | (self.text[1:] != self.text[:-1])) + 1
        begin, end = (np.append(0, turn), np.append(turn, len(found)) - 1) if len(found) else (turn, turn)
        digests = stretch_digests(self.hashes, self.runs[begin], self.runs[end] + self.width)
        return once(self.text[begin], found[begin], digests)


def once(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of some columns, sorted by the first ones, each once."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows])
    return tuple(c[new] for c in rows)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (of their hashes), by runs of doubled length."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = ((a ^ a >> np.uint64(29)) * MIX + b) * MIX
        return out ^ out >> np.uint64(32)

    out, done, power, size = None, 0, hashes, 1
    while done < width:
        if width & size:
            out = power[:n] if out is None else joined(out, power[done:done + n])
            done += size
        power, size = joined(power[:-size], power[size:]) if 2 * size <= width else power, 2 * size
    return out


def _blocks(passage_words: int):
    """A row for each block of a text, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TOGETHER):
            which, *found = Texts(list(byte_texts(batch["text"])), passage_words).blocks()
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(which)), *(pa.array(x.view(np.int64)) for x in found)], names=["doc_id", "seed", "block"])

    return run


def _told(shared: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of some texts that stand elsewhere, the least ids with them, and whether all their blocks are equal. This holds for a seed in any text."""
    seed, first, equal = shared.flatten().flatten()
    return seed.to_numpy().view(np.uint64), first.to_numpy(), equal.to_numpy(zero_copy_only=False)


def _runs(passage_words: int):
    """A row for each run of a text whose seed stands elsewhere in another block, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TOGETHER):
            batch = batch.filter(batch["shared"].is_valid())
            seed, _, equal = _told(batch["shared"])
            if equal.all():
                continue
            texts = Texts(list(byte_texts(batch["text"])), passage_words)
            may = np.isin(texts.seeds(), seed[~equal])
            # Two hashes, so that different runs are told apart in the largest tables.
            low = (texts.run_hashes(second=True)[may] >> np.uint64(32)).astype(np.uint32)
            which, hi, lo = once(texts.text[may], texts.run_hashes()[may], low)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(which)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int32))], names=["doc_id", "hi", "lo"])

    return run


def text_parts(doc: int, runs: np.ndarray, known: np.ndarray, sources: np.ndarray, width: int) -> list[tuple[int, int, int, bool]]:
    """First word, word after the last, source and fate of each part of a text, from the hashes of its runs of ``width`` words.

    ``known`` are hashes of runs that other texts have, ``sources`` the least ids with them. A run is removed if a lesser id has it,
    or if it stands before in the text without a word in common. A word is removed with any run that holds it.
    """
    n = len(runs)
    values, at, which = np.unique(runs, return_index=True, return_inverse=True)
    place, begin = np.arange(n), at[which]
    again = place - begin >= width
    if not len(known) and not again.any():
        return []
    repeated = np.zeros(len(values), bool)
    repeated[which[again]] = True
    source_of = np.full(len(values), doc, np.int64)
    slot = np.minimum(np.searchsorted(values, known), n - 1)
    right = values[slot] == known
    repeated[slot[right]] = True
    source_of[slot[right]] = np.minimum(sources[right], doc)
    source = source_of[which]
    removed = (source < doc) | again
    told = repeated[which] & (again | (source < doc) | (begin == place))

    parts, reach = [], 0
    turn = np.flatnonzero(removed & ~(np.concatenate([[False], removed[:-1]]) & np.concatenate([[True], source[1:] == source[:-1]])))
    stop = np.flatnonzero(~removed)
    ends = np.minimum(np.append(turn[1:], n), np.append(stop, n)[np.searchsorted(stop, turn)]) + width - 1
    for a, b, s in zip(turn.tolist(), ends.tolist(), source[turn].tolist()):
        a = max(a, reach)
        if b > a:
            together = parts and parts[-1][1:3] == (a, s)
            parts[len(parts) - bool(together):] = [(parts[-1][0] if together else a, b, s, True)]
            reach = b
    held = np.zeros(n + width, np.int64)
    np.add.at(held, np.flatnonzero(told), 1)
    np.add.at(held, np.flatnonzero(told) + width, -1)
    kept = np.cumsum(held)[:-1] > 0
    for a, b, _, _ in parts:
        kept[a:b] = False
    edge = np.diff(np.concatenate([[0], kept.astype(np.int8), [0]]))
    parts += [(a, b, doc, False) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    return sorted(parts)


def _parts(passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TOGETHER):
            texts, rows = Texts(list(byte_texts(batch["text"])), passage_words), []
            runs, (seed, first, equal) = texts.run_hashes(), _told(batch["shared"])
            right, source = np.zeros(len(runs), bool), np.empty(0, np.int64)
            if equal.any():
                seed, at = np.unique(seed[equal], return_index=True)
                own = texts.seeds()
                slot = np.minimum(np.searchsorted(seed, own), len(seed) - 1)
                right, source = seed[slot] == own, first[equal][at][slot]
            bounds = np.searchsorted(texts.text, np.arange(batch.num_rows + 1)).tolist()
            for k, (doc, version, hits) in enumerate(zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["hits"])):
                a, b = bounds[k:k + 2]
                if a == b:
                    continue
                known, sources = (hits.values.field(k).to_numpy() for k in (0, 1)) if hits.is_valid else (np.empty(0, np.int64),) * 2
                alike = right[a:b]
                if alike.any():
                    known, sources = np.append(known, runs[a:b][alike].view(np.int64)), np.append(sources, source[a:b][alike])
                parts = text_parts(doc, runs[a:b], known.view(np.uint64), sources, passage_words)
                if parts:
                    begin = np.append(texts.first[texts.places[k]:texts.places[k + 1]] - texts.bytes[k], texts.sizes[k]).tolist()
                    rows += [(doc, version, begin[a], begin[b] - begin[a], b - a, source_id, gone) for a, b, source_id, gone in parts]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PART.split(", ")])

    return run


def _passages(docs: DataFrame, doc: str, text: str, passage_words: int) -> DataFrame:
    """As :func:`repeated_passages`, with the hash of the text the places are in as ``version``."""
    if passage_words < 2:
        raise ValueError("a passage has two words or more")
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).where("doc_id is not null")
    found = named.select("doc_id", "text").mapInArrow(_blocks(passage_words), "doc_id bigint, seed bigint, block bigint")
    common = (found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.min("block").alias("low"), F.max("block").alias("high"))
              .where("n > 1").select("seed", "first", F.expr("low = high").alias("equal")))
    shared = found.select("doc_id", "seed").join(common, "seed").groupBy("doc_id").agg(F.collect_set(F.struct("seed", "first", "equal")).alias("shared"))
    marked = named.join(shared, "doc_id", "left")
    runs = marked.mapInArrow(_runs(passage_words), "doc_id bigint, hi bigint, lo int")
    first = runs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").drop("n")
    hits = runs.join(first, ["hi", "lo"]).groupBy("doc_id").agg(F.collect_set(F.struct("hi", "first_doc_id")).alias("hits"))
    return marked.join(hits, "doc_id", "left").mapInArrow(_parts(passage_words), PART)


def repeated_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Every occurrence of a repeated passage: ``doc_id, start, length, n_words, first_doc_id, removed``.

    ``start`` and ``length`` are UTF-8 bytes. A run of ``passage_words`` consecutive words is repeated if it stands in
    two rows, or twice in one without a word in common. A word is removed if a run that holds it stands in a document
    with a lesser id, or before in its own text; other words of repeated runs are told with ``removed`` false and their own id.
    Consecutive words with one source (``first_doc_id``, the least id that has the run) and fate are one row. Case
    counts; white space between words does not.

    Texts with fewer words have no runs, and rows with a null id are left alone. Rows with one id are
    taken as one document, so nothing is removed between them. Other columns are ignored.

    Texts are cut into chunks at content-defined boundaries. Each run has a seed, the least digest of its chunks; neighbouring runs
    with one seed are a block. Blocks are deduplicated by digest with map-side sums: where all blocks of a seed are equal, all their
    runs stand in the same rows. Only where they differ, mostly at the ends of passages, are runs counted one by one, so no
    repeated run is missed. One that a third of all documents share is left to the split of
    skewed joins. What a document gets back is bounded by its own words. ``passage_words`` is 2 or more.
    """
    return _passages(docs, doc, text, passage_words).drop("version")


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs``, every row and column, with the removed passages of :func:`repeated_passages` cut out of the text.

    A text of which nothing is left is empty, not null. Other columns are as they were.
    """
    cuts = (_passages(docs, doc, text, passage_words).where("removed").groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
            .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__cuts")))
    both = docs.join(cuts, (docs[doc].cast("long") == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__version")), "left")
    data = F.col(text).cast("binary")

    def piece(k):
        """What stands between cut k - 1 and cut k, counted from 0; after the last cut, the rest."""
        last, following = F.get("__cuts", k - 1), F.get("__cuts", k)
        begin = F.coalesce(last["start"] + last["length"], F.lit(0))
        end = F.coalesce(following["start"], F.octet_length(data))
        return F.substr(data, begin + 1, end - begin).cast("string")

    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size("__cuts")), piece), "")
    return both.select(*(F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else docs[c] for c in docs.columns))
