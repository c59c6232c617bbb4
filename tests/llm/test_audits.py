"""Source divergence, conversation repair and the set join against plain versions, on small and odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from test_edges import LONG, ROWS, prose

from atlasrun.llm import chat_repair, divergence, set_join
from atlasrun.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(docs, min_docs=3, top=200):
    """Rows of the audit over ``(lang, source, text)``, with every term of every group."""
    said = [(a or "", b or "", TERM.findall((t or "").translate(brute.FOLD))) for a, b, t in docs]
    out = []
    for lang in {a for a, _, _ in said}:
        holders, sources = Counter(), {b for a, b, _ in said if a == lang}
        counts = defaultdict(Counter)
        for a, b, terms in said:
            if a == lang:
                holders.update(set(terms))
                counts[b].update(terms)
        kept = [t for t, n in holders.items() if n >= min_docs]
        whole = Counter({t: sum(c[t] for c in counts.values()) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {b: shares(counts[b]) for b in sources}, shares(whole)
        for b in sources:
            pairs = [(sum((p[b][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != b]
            terms = [((p[b][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[b][t] and p[b][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, b, part, item, value, k + 1) for k, (value, item) in enumerate(rows) if part == "pair" or k < top]
    return sorted(out)


def audited(docs, **options):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit_sources(docs, **options).collect())


def mixed(spark, rows):
    """Texts in ``(lang, source, text)`` with repeated ids and columns that the operator names its own."""
    schema = "doc_id long, lang string, source string, text string, term string, count long, p string, row long"
    return spark.createDataFrame([(k % 5 or None, *r, "t", 7, None, 3) for k, r in enumerate(rows)], schema)


def test_divergence_of_mixed_texts(spark):
    r, words = random.Random(4), [f"{a}{b}" for a in ("al", "be", "Ça", "né", "zu") for b in ("x", "Y", "on", "é")]
    rows = []
    for k in range(150):
        text = " ".join(r.choice(words) + r.choice(["", ",", "-" + r.choice(words), "7", ".x.x", "\t"]) for _ in range(r.randint(0, 30)))
        rows.append((r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", "hot", "hot", None]), text))
    rows += [("de", "one", None), ("de", "two", " 12 34 "), ("it", "long", LONG), ("it", "long", LONG), ("it", "long", LONG + " più"), ("it", "none", ""), ("xx", "alone", "solo solo solo")]
    rows += [("en", "hot", f"rare{k // 2} {'rare' + str(k // 2) + '!' if k % 2 else ''} pair{k}x, pair{k}x") for k in range(12)]  # in several chunks of the same few documents
    rows += [("en", "a", x) for x in ("odd", "odd.", "odd? odd", "even", "even. even,")]
    for least in (3, 2, 1):
        got = audited(mixed(spark, rows), min_docs=least, top_terms=5)
        assert got == audit(rows, least, 5) and got
    assert audited(mixed(spark, rows).limit(0)) == []
    assert audited(mixed(spark, [(None, None, None)] * 4)) == []
    with pytest.raises(ValueError):
        divergence.audit_sources(mixed(spark, rows), min_docs=4)


def test_divergence_query(spark, small):
    docs = [(r.lang, r.source, r.text) for r in small("documents").select("lang", "source", "text").collect()]
    got = QUERIES["op11_source_divergence"](spark, SMALL).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == audit(docs)


def test_shared_terms_in_small_steps(monkeypatch, spark):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = [("en", f"s{k % 7}", f"{prose(40, k)} every one") for k in range(40)]
    schema = "lang string, source string, text string"
    docs = spark.createDataFrame(rows, schema)
    vectors = [{"lang": "en", "parts": [{"source": f"s{k}", "p": 1000 * k + j + 5, "z": 5 + k} for k in range(3 + j)]} for j in range(4)]
    batch = pa.RecordBatch.from_pylist(vectors)
    got = Counter()
    for out in divergence._shared(iter([batch])):
        for r in out.to_pylist():
            got[r["source"], r["item"]] += r["more"]

    def f(p, q):
        return (p - q) ** 2 // q

    want = Counter()
    for v in vectors:
        for a, b in itertools.permutations(v["parts"], 2):
            want[a["source"], b["source"]] += f(a["p"], b["p"]) - f(a["p"], b["z"]) - f(a["z"], b["p"]) + f(a["z"], b["z"])
    assert got == want and audited(docs) == audit(rows)


def cheapest(kinds):
    """Least cost and least string of edits, over all repairs, from the last row to the first."""
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for kind in reversed(kinds):
        own = []
        for state in range(4):
            own.append(min((cost + best[to][0], letter + best[to][1]) for letter, (cost, to) in chat_repair._takes(kind, state).items()))
        more = list(own)
        for _ in range(3):
            more = [min(own[s], (2 + more[t][0], "I" + more[t][1])) for s, t in enumerate((2, 2, 3, 2))]
        best = more
    return best[0]


def test_block_tables():
    r = random.Random(5)
    for size in (1, 3, 4):
        tables = chat_repair.Blocks(size)
        for _ in range(2000):
            kinds = bytes(r.choice([0, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8]) for _ in range(r.randint(0, 14)))
            assert tables.repair(kinds) == cheapest(kinds)
        assert len(tables.vectors) < 40
    long = bytes(r.choice([2, 4, 3, 5, 6, 8]) for _ in range(100_001))
    cost, audit_of = chat_repair.blocks().repair(long)
    assert audit_of.count("I") + len(long) == len(audit_of) and cost > 0


def repaired(turns):
    """A row as the operator gives it, of ``(turn, role, text)`` in order."""
    seen, kinds, faults = set(), [], Counter()
    for _, role, text in turns:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kinds.append(8 if fault in ("blank", "duplicate") else 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (fault == "truncated"))
    cost, edits = cheapest(kinds)
    out, rows = [], iter(turns)
    for letter in edits:
        _, role, text = next(rows) if letter != "I" else (None, None, "")
        if letter == "K":
            out.append((role[0], f"{role}:{text}"))
        elif letter != "D":
            role = "assistant" if out and out[-1][0] == "u" else "user"
            out.append((role[0], f"{role}:{text}"))
    assert re.fullmatch("(s?(ua)+)?", "".join(x for x, _ in out))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(x for _, x in out).encode()).hexdigest()


def in_order(turns):
    return sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repairs(spark):
    r, rows = random.Random(8), []
    texts = ["Yes.", "No!", "So?", "open", "", " \t\n", "Yes. ", "é?\n", "." , "x" * 50_000]
    for conv in [*range(60), None]:
        for turn in range(r.randint(0, 9)):
            rows.append((conv, r.choice([turn, turn, turn * 3, 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher", None]), r.choice([*texts, None])))
    rows += [(77, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(3000)]
    schema = "conv_id long, turn long, role string, text string, place string, kind string, seen long, audit string"
    turns = spark.createDataFrame([(*x, "p", "k", 0, "a") for x in rows], schema)
    got = {x.conv_id: tuple(x[1:]) for x in chat_repair.repair_conversations(turns).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: repaired(in_order(some)) for conv, some in want.items()}
    ids = spark.createDataFrame([(900,), (901,), (900,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {x.conv_id: tuple(x[1:]) for x in chat_repair.repair_conversations(turns.limit(0), ids).collect()} == {900: nothing, 901: nothing}
    assert chat_repair.repair_conversations(turns.limit(0)).count() == 0


def test_repair_query(spark, small):
    harmed, every = defaultdict(list), set()
    for x in small("conversations").collect():
        every.add(x.conv_id)
        role, text = (" " if v is None else v for v in (x.role, x.text))
        harm = zlib.crc32(f"{' ' if x.conv_id is None else x.conv_id}:{' ' if x.turn is None else x.turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        harmed[x.conv_id] += [(x.turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    got = {x.conv_id: tuple(x[1:]) for x in QUERIES["op12_chat_repair"](spark, SMALL).collect()}
    assert got == {conv: repaired(in_order(harmed[conv])) for conv in every}


def linked(rows):
    """``doc_id, n_shingles, component_id, n_links`` by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = brute.words((text or "").translate(brute.FOLD))
        sets.append({tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
            links[a] += 1
            links[b] += 1
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(doc, least.get(top(k), doc))
    return sorted(((doc, len(s), least.get(top(k)), n) for k, ((doc, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def joined(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in set_join.set_join(docs).collect()), key=str)


def near_texts(count, seed):
    """Chains of texts that differ by few words from the last one, with copies, and short ones."""
    r, rows = random.Random(seed), []
    for _ in range(count):
        words = prose(r.choice([1, 2, 3, 4, 5, 12, 13, 40, 80, 200]), r.randrange(10 ** 6)).split()
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(words))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(words))
                words[k:k + r.choice([0, 1])] = [r.choice(["more", "less", prose(1, r.randrange(99))])]
    r.shuffle(rows)
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("small_cells", [False, True])
def test_links(docs_of, monkeypatch, small_cells):
    rows = [*ROWS, *near_texts(60, 3), *((5000 + k, f"{prose(30, k)} {prose(25, 77)}") for k in range(30))]
    rows += [(6000 + k, f"{prose(120, 9)} {prose(1, k)}") for k in range(40)]
    if small_cells:  # groups of several blocks, cells of several parts and rounds
        for name, value in (("GROUP_DOCS", 4), ("GROUP_TOKENS", 300), ("CELL_QUERIES", 3), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(set_join, name, value)
    assert joined(docs_of(rows)) == linked(rows)
    assert joined(docs_of(rows).limit(0)) == []
    assert joined(docs_of([(None, "a b c d"), (None, "a b c d"), (3, None)])) == sorted([(None, 2, None, 0), (None, 2, None, 0), (3, 0, 3, 0)], key=str)


def test_group_products(monkeypatch):
    monkeypatch.setattr(set_join, "COLUMNS", 7)
    monkeypatch.setattr(set_join, "ROWS", 3)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    members = [(k, len(s), 1, s.tobytes()) for k, s in enumerate(sets)]
    group = set_join._Group(members)
    got = group.common(np.repeat(np.arange(20), [len(s) for s in sets]), np.searchsorted(group.columns, np.concatenate(sets)), 20)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_bounds_hold():
    r = np.random.default_rng(2)
    for _ in range(300):
        pool = r.integers(0, 2 ** 63, 400).astype(np.uint64)
        sets = [np.unique(r.choice(pool, r.integers(1, 300))) for _ in range(4)]
        query, members = sets[0], sets[1:]
        size = max(len(set_join.bits_of(m)) for m in members)
        union = np.zeros(size, np.uint8)
        for m in members:
            bits = set_join.bits_of(m)
            union |= np.tile(bits, size // len(bits))
        bound = set_join.may_overlap(set_join.bits_of(query), len(query), union)
        assert len(np.intersect1d(query, np.concatenate(members))) <= bound <= len(query)


def test_join_query(spark, small):
    rows = [(r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect()]
    got = QUERIES["op13_set_join"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == linked(rows)


def test_linked_sets_share_a_column():
    r = random.Random(6)
    for _ in range(3000):
        n = r.choice([9, 10, 11, 14, 15, 18, 20, 22, 33, 60, 170, 400])
        query = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        drop = r.randint(0, n // 10)
        other = r.randint(0, max(0, n // 10 - drop))
        member = np.unique(np.append(query[drop:], np.array([r.getrandbits(64) for _ in range(other)], np.uint64)))
        r_common = len(np.intersect1d(query, member))
        if 100 * r_common >= 90 * (len(query) + len(member) - r_common):
            assert np.intersect1d(set_join.columns_of(query), set_join.columns_of(member)).size
    assert not len(set_join.columns_of(query[:8]))


def test_classes_ask_what_they_meet(spark):
    """Few common columns: only the classes that have them ask. Many: all classes of the group ask once, not once for each column."""
    few = [(100 + other, key, gid) for other in range(30) for key, gid in ((other, 1), (1000 + other, 50 + other))]
    many = [(500 + column, key, gid) for column in range(20) for key, gid in ((200, 2), (201, 2), (300, 3), (301, 3))]
    narrow = spark.createDataFrame([*((k, 1) for k in range(100)), *((1000 + k, 50 + k) for k in range(30)), (200, 2), (201, 2), (300, 3), (301, 3)], "key long, gid long")
    entries = spark.createDataFrame([*few, *many], "column long, key long, gid long")
    met = set_join._met(entries).groupBy("gid", "other").agg({"held": "sum"}).withColumnRenamed("sum(held)", "held")
    assert {(r.gid, r.other): r.held for r in met.collect() if r.gid in (1, 2)} == {**{(1, 50 + k): 1 for k in range(30)}, (2, 3): 40}
    got = sorted(tuple(r) for r in set_join._asks(entries, narrow, met).select("key", "gid").collect())
    assert got == sorted([*((k, 50 + k) for k in range(30)), *((1000 + k, 1) for k in range(30)), (200, 3), (201, 3), (300, 2), (301, 2)])


def test_columns_of_copies():
    """Copies within a task have no columns, but the first row with an id has them."""
    texts = [(None, "a b c d e f g h i j k l m"), (1, "a b c d e f g h i j k l m"), (2, "A b c d e f g h i j k l m"), (3, "n b c d e f g h i j k l m")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts])], names=["row", "doc_id", "text"])
    out = pa.Table.from_batches(set_join._features(iter([batch])))
    assert [bool(c) for c in out["columns"].to_pylist()] == [True, True, False, True]
    assert all(out["leads"].to_pylist()) and len(set(out["digest"].to_pylist())) == 2
