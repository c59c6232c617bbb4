"""The pipeline on the smallest tables: each stage against a plain version on its own input, and the run as a whole."""

import brute
from conftest import SMALL

import corpus_pipeline
from atlasrun.llm.queries import vocabulary


def sharing(rows, n):
    """Documents that have a run of ``n`` words that comes twice or more."""
    seen = {}
    for doc, text in rows:
        w = brute.words(text)
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k:k + n]), []).append(doc)
    return {doc for docs in seen.values() if len(docs) > 1 for doc in docs}


def test_stages(spark, small, tmp_path):
    from tokenizers import Tokenizer

    docs, items = small("documents"), [(r.item_id, r.text) for r in small("benchmark").collect()]
    good = {r.doc_id for r in small("labels").where("quality = 1").collect()}
    columns, seen = docs.dtypes, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SMALL).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    raw, judged, single, cut, clean = ({r.doc_id: r for r in d.collect()} for d in seen[:5])
    assert all(d.dtypes == columns for d in seen[:5])

    passed = {i for i, r in raw.items() if not brute.quality(r.text)[5]}
    assert set(judged) <= passed and len(passed & good - set(judged)) <= 0.03 * len(passed & good) and all(judged[i] == raw[i] for i in judged)

    parts = brute.components([(i, r.text) for i, r in judged.items()])
    assert set(single) == {i for i, (_, top) in parts.items() if i == top}

    assert set(cut) == set(single) and not sharing([(i, r.text) for i, r in cut.items()], 51)
    for i, r in cut.items():
        assert r.n_chars == len(r.text) and len(r.text) <= len(single[i].text)
    # Passages count from 20 words on; whoever has none that repeats is left as it was.
    assert {i for i in cut if cut[i].text != single[i].text} <= sharing([(i, r.text) for i, r in single.items()], 20)

    assert set(clean) == {i for i, r in cut.items() if not brute.leaks(r.text, items)[4]}

    encode, pieces = Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode, {}
    packed = seen[5].collect()
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(clean)
    for i, rows in pieces.items():
        ids = [*encode(clean[i].text, add_special_tokens=False).ids, 1]
        assert [(s, n, brute.crc(ids[s:s + n]), len(ids)) for s, n, _, _ in rows] == rows and sum(n for _, n, _, _ in rows) == len(ids)

    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, packed))


def test_empty_corpus(spark, small, tmp_path):
    docs = small("documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


def test_null_ids_stay(spark, small, tmp_path):
    docs = small("documents").selectExpr("CASE WHEN doc_id % 5 > 0 THEN doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()
    docs, out = out, corpus_pipeline.leaks(spark, corpus_pipeline.passages(spark, out, SMALL), SMALL)
    assert out.where("doc_id is null").count() == docs.where("doc_id is null").count() and out.columns == docs.columns
