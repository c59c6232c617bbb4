"""Sharding: ordered atomic groups cut into contiguous shards so that the largest shard is as small as possible."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage

#: Leading bits of the ordering key by which pieces are summed at first, and by how many they are split in a round.
FIRST_BITS, ROUND_BITS = 12, 6
#: Rows that one task numbers, about, and the least number of such cells per shard.
CELL_ROWS, LEAST_CELLS = 50_000, 64

Piece = tuple[int, int, int]  # first key, last key, size; a single group if the keys are equal


def greedy_ends(total: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard ends (exclusive) if filled in turn up to ``capacity``; None if the shards do not suffice.

    ``total`` has the sums of the sizes before each place, from 0 to the sum of all.
    """
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(total, total[at] + capacity) - 1
        ends.append(at)
    return ends if at == len(total) - 1 else None


def least_capacity(total: list[int], shards: int) -> int:
    """The smallest capacity for which :func:`greedy_ends` finds room, by binary search."""
    low, high = -(-total[-1] // shards), total[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if greedy_ends(total, middle, shards) is None else (low, middle)
    return low


def even_ends(total: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of shards of at most ``capacity``, each as near as possible to an equal share of what is left.

    An end lies no farther than the capacity allows, and no nearer than the rest needs to fit in the shards left.
    """
    least = [len(total) - 1]
    for _ in range(shards - 1):
        least.append(bisect_left(total, total[least[-1]] - capacity))
    ends, at = [], 0
    for left, floor in zip(range(shards, 0, -1), [*least[-2::-1], len(total) - 1] if shards > 1 else least):
        goal = total[at] + (total[-1] - total[at]) / left
        near = min(max(bisect_left(total, goal), 1), len(total) - 1)
        near -= total[near] - goal > goal - total[near - 1]
        at = min(max(near, floor, at), bisect_right(total, total[at] + capacity) - 1)
        ends.append(at)
    return ends


def _undecided(pieces: list[Piece], shards: int) -> set[int]:
    """Which pieces may hold a cut of the best partition inside.

    The best capacity is at least ``low``, which divides pieces at will but no single group, and at most
    ``high``, which divides no piece. Cuts move right with the capacity, so each lies between the place
    that a filling with ``low`` surely reaches and the one that a filling with ``high`` cannot pass.
    """
    total = [0, *accumulate(size for _, _, size in pieces)]
    low = max([-(-total[-1] // shards), *(size for first, last, size in pieces if first == last)])
    high, held, left, right = least_capacity(total, shards), set(), 0, 0
    for _ in range(shards - 1):
        left = bisect_right(total, total[left] + low) - 1
        right = min(bisect_left(total, total[right] + high), len(pieces))
        held.update(range(left, right))
    return {k for k in held if pieces[k][0] != pieces[k][1]}


def minimax_cuts(rows: DataFrame, shards: int, key: str, size: str) -> list[int]:
    """The last key of each shard but the last one, for the least possible size of the largest shard.

    With that size as the limit, cuts are placed evenly.

    Rows with one ``key`` (bigint, never null) are an atomic group; keys give the order. The key range is summed
    in pieces by leading bits, and pieces that may hold a cut are split further until all of those are single
    groups. The driver sees sums of pieces: 4,096 at first and about ``shards ** 2`` times 64 for each further
    round, of which there are nine at most, whatever the number of rows. An empty table has no cuts.
    """
    def summed(some: DataFrame, bits: int) -> list[Piece]:
        found = some.groupBy(F.shiftright(key, 64 - bits).alias("piece")).agg(F.min(key), F.max(key), F.sum(F.col(size).cast("long")))
        return [tuple(row[1:]) for row in found.collect()]

    bits = FIRST_BITS
    pieces = sorted(summed(rows, bits))
    while pieces and (held := _undecided(pieces, shards)):
        prefixes = [pieces[k][0] >> (64 - bits) for k in sorted(held)]
        within = rows.where(F.shiftright(key, 64 - bits).isin(prefixes))
        bits = min(64, bits + ROUND_BITS)
        pieces = sorted([p for k, p in enumerate(pieces) if k not in held] + summed(within, bits))
    if not pieces:
        return []
    total = [0, *accumulate(size for _, _, size in pieces)]
    ends = even_ends(total, least_capacity(total, shards), shards)
    return [pieces[end - 1][1] if end else pieces[0][0] - 1 for end in ends[:-1]]


def shard_documents(docs: DataFrame, shards: int = 16, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    The size is the UTF-8 bytes of the text plus 1; a null text is empty. Equal texts are one atomic group and share a
    shard. Groups are ordered by a 64-bit hash of the text (texts with one hash count as one group). The largest
    shard is as small as that order allows. Slots number the rows of a shard without gaps. Null and repeated
    ids are rows like any other; other columns are ignored; an empty table gives no rows.

    Texts are read once: only ids, sizes and hashes are kept in the shared checkpoint folder. For slots,
    rows are dealt evenly to numbered cells, so a group of any size is numbered by many tasks.
    """
    sized = cut_lineage(docs.select(F.col(doc).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t")).select(
        "doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("text_crc32"),
        F.xxhash64("t").alias("key"), F.monotonically_increasing_id().alias("row")))
    cuts = minimax_cuts(sized, shards, "key", "size")
    shard = sum(((F.col("key") > cut).cast("int") for cut in cuts), F.lit(0))
    cells = max(LEAST_CELLS, sized.count() // (shards * CELL_ROWS))
    placed = sized.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod("row", F.lit(cells)).cast("int").alias("cell"), "row")
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = placed.withColumn("place", F.row_number().over(W.partitionBy("shard", "cell").orderBy("row")) - 1)
    return ranked.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
