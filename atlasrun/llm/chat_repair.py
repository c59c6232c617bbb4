"""Conversation structure repair: cheapest edits to a role pattern, by Four-Russians block tables.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. A conversation is a string over the
nine kinds of rows (an initial or another one, truncated or not; or a row that has to go). What the rest of a conversation still
costs is a vector over the four states of the pattern. Vectors less their least entry are few, so their changes over every
block of ``BLOCK_ROWS`` kinds are tabled once: a conversation is walked from its last block to its first, a look-up each, and its
edits are then read from the first block to the last, each block opened against the vector behind it. At every place the
least letter that keeps to the least cost is taken, so ties fall to the least string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import slices

#: Rows of a tabled block.
BLOCK_ROWS = 4
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: The pattern: after nothing, after the system row, after a user, after an assistant (where a conversation may end, or before its begin).
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that a new or renamed turn leads to: there is one choice in each.
_GIVEN = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows; 2 * place of the initial, and one more if truncated; the last has to go.
_INITIALS = "sua"
GONE = 8
KINDS = 9
_FAR = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"

FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _with_inserts(own: list[int]) -> tuple[int, ...]:
    """Costs by state if turns may be put in first."""
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return min(own[BEGIN], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant


def _takes(kind: int, state: int) -> dict[str, tuple[int, int]]:
    """What may be done with a row: letter to cost and next state."""
    out = {"D": (DELETE, state)}
    if kind != GONE:
        late, initial = kind % 2 * CUT_OFF, _INITIALS[kind // 2:kind // 2 + 1]
        if initial in _NEXT[state]:
            out["K"] = (late, _NEXT[state][initial])
        out["R"] = (REROLE + late, _GIVEN[state])
    return out


def costs_before(kind: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs by state before a row, from those after it."""
    return _with_inserts([min(cost + after[to] for cost, to in _takes(kind, state).values()) for state in range(4)])


#: Costs by state when no row is left.
END = _with_inserts([0, _FAR, _FAR, 0])


class Blocks:
    """Normalised vectors by number, and for each vector and block of kinds the vector before the block and the cost that left it."""

    def __init__(self, size: int = BLOCK_ROWS):
        self.size, self.vectors, self.single, self._opened = size, [END], [], {}
        numbers = {END: 0}
        for vector in self.vectors:  # grows as new vectors turn up
            row = []
            for kind in range(KINDS):
                before = costs_before(kind, vector)
                low = min(before)
                plain = tuple(x - low for x in before)
                if plain not in numbers:
                    numbers[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((numbers[plain], low))
            self.single.append(row)
        self.table = [{bytes(block): self._walk(number, block) for block in product(range(KINDS), repeat=size)} for number in range(len(self.vectors))]

    def _walk(self, number: int, block: Iterable[int]) -> tuple[int, int]:
        total = 0
        for kind in reversed(tuple(block)):
            number, low = self.single[number][kind]
            total += low
        return number, total

    def _open(self, block: bytes, number: int, state: int) -> tuple[str, int]:
        """The edits of a block, entered in a state, with the vector of this number behind it; and the state after it."""
        key = block, number, state
        if key not in self._opened:
            behind = [number]
            for kind in reversed(block[1:]):
                behind.append(self.single[behind[-1]][kind][0])
            letters = []
            for kind in block:
                after = self.vectors[behind.pop()]
                here = costs_before(kind, after)
                while True:
                    takes = _takes(kind, state)
                    fits = {x: to for x, (cost, to) in takes.items() if cost + after[to] == here[state]}
                    if INSERT + here[_GIVEN[state]] == here[state]:
                        fits["I"] = _GIVEN[state]
                    letter = min(fits)
                    letters.append(letter)
                    state = fits[letter]
                    if letter != "I":
                        break
            self._opened[key] = "".join(letters), state
        return self._opened[key]

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """Least cost, and the least string of edits that has it. No kinds cost nothing."""
        head = len(kinds) % self.size
        pieces = [kinds[k:k + self.size] for k in range(head, len(kinds), self.size)]
        behind, cost, number = [], 0, 0
        for piece in reversed(pieces):
            behind.append(number)
            number, low = self.table[number][piece]
            cost += low
        if head:
            pieces.insert(0, kinds[:head])
            behind.append(number)
            number, low = self._walk(number, kinds[:head])
            cost += low
        cost, state, edits = cost + self.vectors[number][BEGIN], BEGIN, []
        for piece, number in zip(pieces, reversed(behind)):
            letters, state = self._open(piece, number, state)
            edits.append(letters)
        while state not in (BEGIN, ASSISTANT):
            edits.append("I")
            state = _GIVEN[state]
        return cost, "".join(edits)


@cache
def blocks() -> Blocks:
    """The tables, once for each Python worker."""
    return Blocks()


class _Conversation:
    """What is gathered of one conversation, a few bytes for each row."""

    def __init__(self, conv):
        self.conv, self.kinds, self.faults = conv, bytearray(), [0, 0, 0, 0]
        self.last, self.illegal, self.turns, self.low, self.high = None, 0, 0, None, None

    def add(self, turn, initial: str, kind: int, fault: int) -> None:
        self.kinds.append(kind)
        self.faults[fault] += 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:  # turns come in order
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self) -> tuple:
        cost, audit = blocks().repair(bytes(self.kinds))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, audit)


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least edits of each conversation; its rows come one after the other."""
    now = None
    for batch in batches:
        out = []
        for conv, place, turn, initial, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            if place:
                now.add(turn, initial, kind, fault)
        yield _rows(FOUND, out)
    if now is not None:
        yield _rows(FOUND, [now.row()])


class _Told:
    """The repaired text of one conversation, hashed turn by turn."""

    def __init__(self, found: tuple):
        self.found, self.at, self.state, self.digest, self.any = found, 0, BEGIN, hashlib.sha256(), False

    def _say(self, role: bytes, text: bytes) -> None:
        self.digest.update((b"\n" if self.any else b"") + role + b":" + text)
        self.any = True

    def _insert(self) -> None:
        audit = self.found[-1]
        while audit[self.at:self.at + 1] == "I":
            self.state = _GIVEN[self.state]
            self._say(_ROLES[self.state].encode(), b"")
            self.at += 1

    def add(self, role: bytes, text: bytes) -> None:
        self._insert()
        letter = self.found[-1][self.at]
        self.at += 1
        if letter == "K":
            self.state = _NEXT[self.state][role[:1].decode()]
            self._say(role, text)
        elif letter == "R":
            self.state = _GIVEN[self.state]
            self._say(_ROLES[self.state].encode(), text)

    def row(self) -> tuple:
        self._insert()
        return (*self.found, self.digest.hexdigest())


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits, which come first, carried out on its rows."""
    now, fields = None, [f.split()[0] for f in FOUND.split(", ")]
    for whole in batches:
        for batch in slices([whole], "text"):
            out, found = [], [batch[f].to_pylist() for f in fields]
            texts, roles = (batch[c].cast(pa.binary()) for c in ("text", "role"))
            for k, place in enumerate(batch["place"].to_pylist()):
                if place == 0:
                    if now is not None:
                        out.append(now.row())
                    now = _Told(tuple(f[k] for f in found))
                else:
                    now.add(roles[k].as_py(), texts[k].as_py())
            yield _rows(f"{FOUND}, repaired_sha256 string", out)
    if now is not None:
        yield _rows(f"{FOUND}, repaired_sha256 string", [now.row()])


def repair_conversations(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: :data:`FOUND` and ``repaired_sha256``, from ``conv_id, turn, role, text``.

    Rows are taken by turn (nulls first), then role and text. A null role or text is one blank; rows with a null ``conv_id``
    are one conversation. Each row has at most one fault: *blank*, *duplicate* (role and text stood earlier in the
    conversation) or *truncated* (the last character that is no white space is none of ``.!?``). ``illegal`` counts neighbouring rows
    whose initials are none of ``su ua au``; ``gaps`` the turns missing between the first and the last.

    Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert a user or assistant turn
    without text (2); a truncated row that stays costs one more. ``audit`` has their initials in order; ties go to the least string. The
    digest is that of ``role:text`` of the repaired turns, joined by line ends. ``conversations`` names those that
    are to have a row even without turns: zeros, an empty audit and the digest of nothing. Empty tables give no rows; other columns are ignored.

    A conversation goes through one task, as its digest is one value over its whole text; the task holds a byte for each of its
    rows and its edits, never its texts.
    """
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    earlier = W.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    seen = said.withColumn("seen", F.row_number().over(earlier))
    core = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (F.when(core == "", 1).when(F.col("seen") > 1, 2).when(~F.substring(core, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin(1, 2), GONE).otherwise(
        2 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("fault") == 3, 1).otherwise(0))
    judged = seen.withColumn("fault", fault).select("*", initial.alias("initial"), kind.alias("kind"), F.lit(1).alias("place"))
    every = said.select("conv_id") if conversations is None else conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    heads = every.distinct().withColumn("place", F.lit(0))

    def in_order(rows: DataFrame) -> DataFrame:
        both = rows.unionByName(judged, allowMissingColumns=True)
        return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place", F.col("turn").asc_nulls_first(), "role", "text", "seen")

    found = in_order(heads).select("conv_id", "place", "turn", "initial", "kind", "fault").mapInArrow(_find, FOUND)
    carried = in_order(found.withColumn("place", F.lit(0))).select(*(f.split()[0] for f in FOUND.split(", ")), "place", "role", "text")
    return carried.mapInArrow(_tell, f"{FOUND}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations damaged by the CRC-32 of ``conv_id:turn``, modulo 20: 0 drops the row, 1 empties
    its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's; null is one blank."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    harm = F.col("harm")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("harm")).where("harm <> 0")
    mended = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), mended.alias("text"), copies).drop("copy")
