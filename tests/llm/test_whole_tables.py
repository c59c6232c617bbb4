"""Each registered query over the smallest tables against a plain version."""

import math
import zlib

import brute
import numpy as np
import pytest
from conftest import SMALL

from atlasrun.llm import queries, toxicity
from atlasrun.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def result(spark, small):
    done = {}

    def of(name):
        if name not in done:
            done[name] = QUERIES[name](spark, SMALL).collect()
        return done[name]

    return of


@pytest.fixture(scope="module")
def documents(small):
    return [(r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect()]


def test_packing(result, documents):
    from tokenizers import Tokenizer

    encode, pieces, seqs = Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode, {}, {}
    for r in result("op3_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(pieces) == len(documents)
    for doc, text in documents:
        ids, at = [*encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == brute.crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for parts in seqs.values() for _, n in parts)
    assert len(seqs) <= math.ceil(total / 2048 * 1.02) + 1


def test_toxicity(result, small):
    labels = {r.doc_id: r.toxic for r in small("labels").collect()}
    rows = result("op4_toxicity")
    known = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic, clean = ([s for s, t in known if t == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


def test_toxicity_of_rows_never_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    toxic, clean = ([s for s, t in unseen if t == k] for k in (1, 0))
    assert len(toxic) > 100 and np.mean([a > b for a in toxic for b in clean]) > 0.95


def test_toxicity_is_one_pass(spark):
    """Scores of the query are those of the model and limits learned apart from it."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model, limits = toxicity.learn(docs, labels)
    apart = {r.doc_id: tuple(r) for r in toxicity.score_documents(docs, model, limits).collect()}
    assert {r.doc_id: tuple(r) for r in toxicity.learn_and_score(docs, labels).collect()} == apart


def test_sharding(result, documents):
    rows = result("op5_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents)
    slots, shard_of, texts = {}, {}, dict(documents)
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_records(result, documents):
    from tokenizers import Tokenizer

    encode, at, rows = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode, 0, {r.doc_id: r for r in result("op6_records")}
    for doc, text in sorted(documents):
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        assert rows[doc][1:] == (at, len(ids), brute.crc(ids))
        at += len(ids)


def test_leaks(result, documents, small):
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    rows = {r.doc_id: tuple(r[1:]) for r in result("op8_decontamination")}
    assert rows == {doc: brute.leaks(text, items) for doc, text in documents}


def test_quality(result, documents, small):
    rows = {r.doc_id: r for r in result("op9_quality_rules")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {d: tuple(r[n] for n in names) for d, r in rows.items()} == {d: brute.quality(t) for d, t in documents}
    good = [r.doc_id for r in small("labels").where("quality = 1").collect()]
    judged = [rows[d].kept for d in good if not rows[d].base_failed]
    assert sum(judged) >= 0.97 * len(judged)


def test_near(result, documents):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result("op10_near_dedup")} == brute.components(documents)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result("op10_near_dedup"))


def test_passages(result, documents):
    """Wherever 51 consecutive words stand in two documents, both are told, and all but one are cut."""
    told, first = {r.doc_id for r in result("op2_substring_dedup")}, {}
    for doc, text in sorted(documents):
        w = brute.words(text)
        for k in range(len(w) - 50):
            first.setdefault(tuple(w[k:k + 51]), set()).add(doc)
    repeated = {d for docs in first.values() if len(docs) > 1 for d in docs}
    assert repeated <= told
    texts, shared = dict(documents), {}
    for r in result("op2_substring_dedup"):
        assert r.n_words > 0 and r.first_doc_id <= r.doc_id
        piece = texts[r.doc_id].encode()[r.start:r.start + r.length].decode()
        assert len(brute.words(piece)) == r.n_words
        if r.removed:
            assert " ".join(brute.words(piece)[:3]) in " ".join(brute.words(texts[r.first_doc_id]))
            shared.setdefault(r.doc_id, 0)


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
