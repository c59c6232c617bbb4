"""Rows that operators once left out: ids that are null or repeated, labelled texts beyond the training draw."""

import random

from conftest import SMALL
from test_edges import prose, ROWS

import corpus_pipeline
from atlasrun.llm import records, toxicity
from atlasrun.llm.queries import vocabulary


def test_records_without_id_are_written(docs_of, tmp_path):
    files = records.write_records(docs_of([*ROWS, (0, "zero"), (-5, "less")]), f"file://{tmp_path}/r", vocabulary("byte_bpe_50k.json"), file_docs=4, without_id=True)
    rows = records.read_records(files).orderBy("start").collect()
    ids = [d for d, _ in ROWS]
    assert [r.doc_id for r in rows] == [None] * ids.count(None) + sorted([*(d for d in ids if d is not None), 0, -5])
    assert records.read_records(files, seed=2).orderBy("start").collect() == rows


def test_a_leak_takes_no_namesake_along(docs_of, small, spark):
    item = max((r.text for r in small("benchmark").collect() if r.text), key=len)
    docs = docs_of([(1, prose(40, 1)), (1, f"{prose(9, 2)} {item}"), (2, item), (3, None), (4, prose(40, 3)), (4, prose(40, 3))])
    out = corpus_pipeline.leaks(spark, docs, SMALL)
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, prose(40, 1)), (3, ""), (4, prose(40, 3)), (4, prose(40, 3))] and out.columns == docs.columns


def test_limits_come_from_all_labelled_texts(spark):
    """A language whose few toxic texts are not drawn has a limit, and one without them has none."""
    r = random.Random(6)
    rows = [(k, prose(r.randint(20, 60), k) + (" grobiano" if k % 3 == 0 else ""), "rare" if k % 24 == 0 else "none" if k % 24 == 1 else "most") for k in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _, _ in rows], "doc_id long, toxic int")
    _, limits = toxicity.learn(docs, labels, class_rows=30)
    assert set(limits) == {"rare", "most"} and all(0 <= x <= 1 for x in limits.values())
    assert toxicity.language_limits([("a", 4000, 6, 6), ("a", 100, 90, 1)]) == {"a": (4000 + 101) / 2 / toxicity.SCORE_STEPS}


def test_rows_of_one_id_are_dealt_out(docs_of, tmp_path):
    """Half of all rows without an id, many with one: no file gets them all, and order and counts hold."""
    rows = [(None if k % 2 else 7 if k % 4 else k, f"{prose(5, k)}") for k in range(800)]
    files = records.write_records(docs_of(rows), f"file://{tmp_path}/r", vocabulary("byte_bpe_50k.json"), file_docs=100, without_id=True)
    sizes = [r.records for r in files.orderBy("shard").collect()]
    back = records.read_records(files).orderBy("start").collect()
    assert sum(sizes) == 800 and max(sizes) < 300
    assert [r.doc_id for r in back] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
