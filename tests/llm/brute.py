"""Plain versions of the text operators, one document or pair at a time, to compare results with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def leak_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def leaks(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, int, str, bool]:
    w, hit, found = leak_words(text), set(), set()
    for item, said in items:
        x = leak_words(said)
        n = min(len(x), 10)
        asked = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in asked:
                hit.update(range(k, k + n))
                found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, run in enumerate(zip(w, w[1:], w[2:])) if runs[run] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def shingles(text: str | None) -> set:
    w = words((text or "").translate(FOLD))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Of each id its set's size and component, by comparing pairs that have a run in common."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter()
    for some in holders.values():
        for k, a in enumerate(some):
            for b in some[k + 1:]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def largest_shard(sizes: list[int], shards: int) -> int:
    """The least possible size of the largest of contiguous shards, by dynamic programming."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = total.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], total[k] - total[j]) for j in range(k + 1)) for k in range(len(total))])
    return int(best[-1])


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
