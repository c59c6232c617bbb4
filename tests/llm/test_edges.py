"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import random
import re

import brute
import numpy as np
import pytest

from atlasrun.llm import chat, chunk_dedup, decontamination, near_dedup, packing, quality_rules, records, sharding, tokens, toxicity, url_filter
from atlasrun.llm.queries import vocabulary

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "elo", "iru", "oma", "une", "ay")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 1)
LONG = prose(40_000, 2)
ROWS = [(1, prose(80, 3)), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, prose(30, 4) + " " + PASSAGE + " " + prose(30, 5)),
        (7, prose(35, 6) + "\n" + PASSAGE + " " + prose(20, 7)), (8, prose(80, 3)), (8, prose(80, 3)), (9, prose(3, 8)), (10, prose(3, 8)),
        (11, prose(80, 9)), (11, prose(80, 10)), (None, prose(80, 11)), (None, None)]


def test_url_rules(spark):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("org", "block"),
                                   ("org/ok", "allow"), (None, "block"), ("x/", None), ("/only/path", "block"), ("net/", "block")], "rule string, verdict string")
    urls = {"http://A.Example.NET/en/xyz?q": ("a.example.net/en/x", "block"), "http://a.example.net/en/": ("example.net/en/", "allow"),
            "https://net/": ("net/", "block"), "https://net": (None, "allow"), "https://q.org#x": ("org", "block"), "https://org/okay": ("org/ok", "allow"),
            "https://borg/okay": (None, "allow"), "no scheme/x.net/": (None, "allow"), "": (None, "allow"), None: (None, "allow"),
            "http://example.net/enx": ("net/", "block"), "http://" + "a." * 5000 + "net/" + "b/" * 5000: ("net/", "block")}
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    for limit in (1 << 20, 0):  # by trie and by join
        out = url_filter.judge_urls(pages, rules, broadcast_bytes=limit).collect()
        assert len(out) == 2 * len(urls) and {r.url: (r.rule, r.verdict) for r in out} == urls
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_chunks_do_not_depend_on_place():
    def cuts(text):
        data = text.encode()
        return {data[a:b] for a, b, _ in zip(*chunk_dedup.chunk_bounds(data))}

    for seed in range(30):
        shared = prose(60, seed)
        both = cuts(prose(seed, 100 + seed) + " " + shared + " end") & cuts(prose(7, 200 + seed) + "\n" + shared)
        assert sum(len(c.split()) for c in both) >= chunk_dedup.PASSAGE_WORDS
    begin, end, count = chunk_dedup.chunk_bounds(LONG.encode())
    assert count.sum() == 40_000 and count[:-1].min() >= chunk_dedup.LEAST_WORDS and count.max() <= chunk_dedup.MOST_WORDS
    assert all(len(x) == 0 for x in chunk_dedup.chunk_bounds(b" \n "))


def test_repeats(docs_of):
    docs = docs_of(ROWS)
    told = chunk_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in told} == {1, 8, 6, 7}
    assert {r.doc_id for r in told if r.removed} == {8, 7}
    out = chunk_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[8] == ["", ""] and texts[2] == [None] and texts[5] == [LONG] and texts[1] == [prose(80, 3)]
    assert sorted(texts[11]) == sorted([prose(80, 9), prose(80, 10)]) and None in texts[None]
    left = brute.words(texts[7][0])
    assert left[:30] == prose(35, 6).split()[:30] and len(left) < 35 + 20 + 30
    assert chunk_dedup.repeated_passages(docs.limit(0)).count() == 0 and chunk_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_near_copies(docs_of):
    near = ROWS[0][1].replace(" ", "  ").upper().split(" ")
    out = near_dedup.near_duplicates(docs_of([*ROWS, (0, " ".join(near) + " more")])).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert len(out) == len(ROWS) + 1
    assert got[0] == {(0, True)} and got[1] == got[8] == {(0, False)} and got[9] == {(9, True)} and got[10] == {(9, False)}
    assert got[2] == {(2, True)} and got[3] == {(3, True)} and got[4] == {(4, True)} and got[None] == {(None, True)} and got[11] == {(11, True)}
    assert near_dedup.near_duplicates(docs_of(ROWS).limit(0)).count() == 0


def test_near_chains_against_all_pairs(docs_of, monkeypatch):
    """Long chains of edits, where no leader is near to all, and blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", 400)
    r, rows, text = random.Random(5), [], prose(120, 50).split()
    for k in range(90):
        if k % 30 == 0:
            text = prose(120, 50 + k).split()
        text = list(text)
        for _ in range(2):
            text[r.randrange(len(text))] = f"w{r.random()}"
        rows.append((k * 7 % 97, " ".join(text)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.components(rows)


def test_sketches_estimate_similarity():
    """Sketches of pairs at the threshold stay inside the limit, those far below mostly outside."""
    random_ = np.random.default_rng(3)

    def apart(common, own):
        x = random_.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        a, b = (near_dedup.sketch_of(near_dedup.minhashes(np.concatenate([x[:common], y]))) for y in (x[common:common + own], x[common + own:]))
        return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())

    assert max(apart(300, 50) for _ in range(200)) <= near_dedup.most_apart()
    assert min(apart(100, 200) for _ in range(50)) > near_dedup.most_apart()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks(docs_of, spark, limit):
    items = [(1, PASSAGE), (2, "Short ITEM, here"), (3, None), (4, "..."), (None, PASSAGE), (5, prose(9, 70)), (6, prose(10, 71)), (7, " ".join(PASSAGE.split()[20:35])), (8, "one")]
    rows = [*ROWS, (20, "a short item: HERE again, short-item.here"), (21, "x " + prose(9, 70).upper() + " y"), (22, prose(10, 71)), (23, prose(9, 70)[:-1]),
            (24, " ".join(PASSAGE.split()[3:12])), (25, "One"), (26, "x " + " ".join(PASSAGE.split()[10:30]) + " y " + " ".join(PASSAGE.split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "text")
    out = decontamination.contamination(docs_of(rows), bench, broadcast_bytes=limit).collect()
    plain = [(i, t) for i, t in items if i is not None]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=repr)
    assert got == sorted(((d, *brute.leaks(t, plain)) for d, t in rows), key=repr)
    assert decontamination.contamination(docs_of(ROWS).limit(0), bench, broadcast_bytes=limit).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs_of(ROWS), bench.limit(0), broadcast_bytes=limit).collect())


def test_quality_counts(docs_of):
    odd = [(30, "a b c a b c\n\nx y\nx y\n \nx  y"), (31, "x " * 200), (32, "É# $é\x0b|\x1c <>&*%"), (33, "    z"), (34, prose(60, 90) + "\n" + prose(60, 90)), (35, "a b c d a b c")]
    rows = [*ROWS, *odd]
    out = quality_rules.judge_quality(docs_of(rows), []).collect()
    got = sorted(((r.doc_id, *(r.stats[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r.base_failed) for r in out), key=repr)
    assert got == sorted(((d, *brute.quality(t)) for d, t in rows), key=repr)
    assert all(r.kept != r.base_failed for r in out)


def test_quality_learning(docs_of, spark):
    rows = [(k, prose(60, k) + (" ###" * 9 if k % 4 == 0 else "")) for k in range(120)]
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k, _ in rows] + [(None, 0), (1, None), (7777, 0)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs_of(rows), labels)
    assert rules and all(isinstance(c, quality_rules.Condition) for r in rules for c in r)
    out = quality_rules.judge_quality(docs_of(rows), rules).collect()
    assert {r.doc_id for r in out if not r.kept} == {k for k, _ in rows if k % 4 == 0} and all((r.rule is None) == r.kept for r in out)
    assert quality_rules.learn_rules(docs_of(rows), labels.limit(0)) == [] == quality_rules.learn_rules(docs_of(rows).limit(0), labels)
    assert quality_rules.judge_quality(docs_of(rows).limit(0), rules).count() == 0


def test_packing(docs_of):
    docs = docs_of(ROWS)
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), group_docs=3).collect()
    seqs = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= 2048
    assert sum(r.start == 0 for r in rows) == len(ROWS) and sum(r.length for r in rows if r.doc_id == 5) == next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_even_cuts_within_the_least_capacity():
    r = random.Random(2)
    for _ in range(60):
        sizes, shards = [r.choice([1, 2, 7, 40]) for _ in range(r.randint(1, 60))], r.randint(1, 9)
        total = [0, *np.cumsum(sizes).tolist()]
        capacity = sharding.least_capacity(total, shards)
        ends = sharding.even_ends(total, capacity, shards)
        assert ends == sorted(ends) and len(ends) == shards and ends[-1] == len(sizes)
        assert max(total[b] - total[a] for a, b in zip([0, *ends], ends)) == capacity == brute.largest_shard(sizes, shards)
    assert sharding.even_ends(list(range(161)), 10, 16) == list(range(10, 161, 10))


def test_first_fit_decreasing_against_a_scan():
    r = random.Random(1)
    for n in (1, 2, 3, 7, 50, 200):
        sizes, rooms, want = [r.randint(1, 100) for _ in range(n)], [], {}
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            b = next((b for b, room in enumerate(rooms) if room >= sizes[k]), len(rooms))
            rooms[b:b + 1] = [(rooms[b] if b < len(rooms) else 100) - sizes[k]]
            want[k] = b
        assert packing.first_fit_decreasing(sizes, 100)[0] == [want[k] for k in range(n)]


def test_encoders_equal_the_library():
    from tokenizers import Tokenizer

    odd = ["", " ", "it's  we'll\n\n\tDON'T", "a   b c", "x<|endoftext|> <|ENDOFTEXT|>", "É é ﬁ ΑΣ ς", "日本 語。 12345", "tab\t\tend \n", "a\x1cb\x85c", "👩‍👩‍👧 !?…,", prose(300, 1),
           "Été, œuvre. ÀÉ÷× ßtraße.,. \n\nÜber e\u0301t. \n Mot,\nmot ,x .y a.b don't, É. ÿŸ", "l'eau s'il 's 'tis x'ré. ÇA,"]
    for name, pieces in (("word_bpe_49k.json", tokens.LOWER_WORDS), ("byte_bpe_50k.json", tokens.SPACED_WORDS)):
        plain, own = Tokenizer.from_file(vocabulary(name)), tokens.Encoder(vocabulary(name), pieces)
        for _ in range(2):
            got = own.encode([t.encode() for t in odd])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_encoder_without_room(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    own, free = (tokens.Encoder(vocabulary("byte_bpe_50k.json"), tokens.SPACED_WORDS) for _ in range(2))
    for k in range(3):
        texts = [prose(20, k).encode(), prose(20, k + 1).encode()]
        assert own.encode(texts) == free.encode(texts)
    assert len(own.known) == 3


def test_records(docs_of, spark, tmp_path):
    folder, docs = f"file://{tmp_path}/r", docs_of(ROWS)
    files = records.write_records(docs, folder, vocabulary("byte_bpe_50k.json"), file_docs=4)
    rows = records.read_records(files).orderBy("start").collect()
    kept = [(d, t) for d, t in ROWS if d is not None]
    assert [r.doc_id for r in rows] == sorted(d for d, _ in kept)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert records.read_records(files, seed=3).orderBy("start").collect() == rows
    own = tokens.Encoder(vocabulary("byte_bpe_50k.json"), tokens.SPACED_WORDS)
    assert sorted(bytes(r.ids[:-4]) for r in rows) == sorted(own.encode([(t or "").encode() for _, t in kept]))
    empty = records.write_records(docs.limit(0), folder, vocabulary("byte_bpe_50k.json"))
    assert records.read_records(empty).count() == 0
    largest = max(files.collect(), key=lambda f: f.bytes)
    path = largest.path.removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(files).collect()


def test_sharding(docs_of):
    docs = docs_of([*ROWS, *((100 + k, prose(k % 40, k % 23)) for k in range(120))])
    for shards in (1, 4, 16):
        rows = sharding.shard_documents(docs, shards).collect()
        assert len(rows) == docs.count()
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_minimax_against_dynamic_programming(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "ROUND_BITS", 2)
    r = random.Random(seed)
    rows = [(r.getrandbits(64) - (1 << 63), r.choice([1, 5, 9, 200 if seed else 3])) for _ in range(90)]
    rows += rows[:20]
    sizes = {}
    for key, size in rows:
        sizes[key] = sizes.get(key, 0) + size
    keys = sorted(sizes)
    cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "key long, size long"), 7, "key", "size")
    shard = {k: sum(k > c for c in cuts) for k in keys}
    assert max(sum(sizes[k] for k in keys if shard[k] == s) for s in range(7)) == brute.largest_shard([sizes[k] for k in keys], 7)


def test_chat(spark):
    part = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    tricky = ["", "<|done|>", "<␛|done|>", "<|do", "ne|>", "[INST[INST]]</s><s>", "␛<␛␛/s>", "a\nb", "<|image|>", "<<|turn|>"]
    rows = [(1, k, "assistant" if k % 2 else "user", [("text", t, None, None, None, None, None)]) for k, t in enumerate(tricky)]
    rows += [(2, 0, "user", [("text", "<|do", None, None, None, None, None), ("text", "ne|>", None, None, None, None, None), ("image", None, "i1", 28, 15, None, None),
                             ("audio", None, "a1", None, None, 1.5, None), (None, "end", None, None, None, None, None), ("image", None, None, None, None, None, None)]),
             (2, 1, None, None), (2, 2, "assistant", []), (3, None, "assistant", [("document", None, "d", None, None, None, 3)]),
             (None, 1, "user", [("text", None, None, None, None, None, None)]), (4, 0, "<|says|>", [("text", "x", None, None, None, None, None)]), (4, 0, "<|says|>", [("text", "x", None, None, None, None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}").withColumn("text", chat.F.lit("clash")).withColumn("a", chat.F.lit(1))
    out = chat.format_chats(turns)
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(out.formatted).alias("turns"), chat.read_loss(out.formatted, out.loss).alias("learned")).collect()}
    assert [t.text for t in got[1].turns] == tricky and got[1].learned == tricky[1::2]
    assert len(re.findall(r"<\|done\|>", got[1].formatted)) == len(tricky) and "</s>" not in got[1].formatted
    assert got[2].turns[0].text == "<|done|><|image|><|audio|>end<|image|>" and [t.role for t in got[2].turns] == ["user", "", "assistant"]
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in got[2].attachments] == [(0, "image", "i1", 4), (1, "audio", "a1", 38), (2, "image", None, 0)]
    assert got[2].expanded_tokens == 42 and got[2].learned == [""] and got[3].expanded_tokens == 768
    assert [t.role for t in got[4].turns] == ["<|says|>"] * 2 and len(got) == 5
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_toxicity(docs_of, spark):
    r = random.Random(4)
    rows = [(k, prose(r.randint(20, 80), k) + (" grobian" + r.choice(["a", "o", "eth"]) + " tail" if k % 3 == 0 else "")) for k in range(240)] + ROWS[1:5] + ROWS[-2:]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model, limits = toxicity.learn(docs_of(rows), labels)
    out = toxicity.score_documents(docs_of(rows), model, limits).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.held_out and x.doc_id < 240]
    assert len(held) > 30 and np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.9
    assert toxicity.score_documents(docs_of(rows).limit(0), model).count() == 0
    constant, none = toxicity.learn(docs_of(rows), labels.limit(0))
    assert none == {} and len({x.score for x in toxicity.score_documents(docs_of(rows), constant).collect()}) == 1


def test_toxicity_looks_at_whole_texts():
    model = toxicity._start([np.array([[1, 2, 3]])], np.array([True]))
    model.table[9] = 5
    far = np.concatenate([np.zeros((3 * toxicity.STEP + 5, toxicity.DIM), np.float32), model.table[[9]]])
    assert (model.pooled(far)[0][:4] > 2).all()
