from pathlib import Path

import pytest

from atlasrun.operators import leaderboard, runs
from atlasrun.sources.actions import ACTION_SCHEMA, read_actions, stream_actions
from atlasrun.streaming import board, live, scorer
from test_runs import random_log


def written(spark, folder, rows, batches):
    """The log as several files, cut in arrival order."""
    full = [(r[0], r[1], r[2], r[3], r[4], r[5], None, None, r[6]) for r in rows]
    size = max(r[2] for r in rows) // batches + 1
    for batch in range(batches):
        part = [r for r in full if r[2] // size == batch]
        spark.createDataFrame(part, ACTION_SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{batch}")
    return f"{folder}/in/*"


def drained(events, folder):
    query = (events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
             .option("path", f"{folder}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("seed", [21])
def test_stream_equals_batch(spark, tmp_path, seed):
    rows = random_log(seed, run_count=8, length=60)
    path = written(spark, tmp_path, rows, 3)
    events = drained(scorer.score_stream(stream_actions(spark, path, max_files=1)), tmp_path).cache()
    replayed = runs.replay(read_actions(spark, path)).cache()

    def keyed(df):
        return {(r.run_id, r.seq): (r.segment, r.event, r.reason, r.result, r.attempt, r.credit) for r in df.collect()}

    assert keyed(events) == keyed(replayed)
    columns = ["run_id", "segment", "total", "score", "accuracy", "missed", "perfect", "eventually_correct", "elapsed_ms", "completed_at", "final_score"]
    want = sorted(tuple(r[c] for c in columns) for r in runs.run_results(replayed).collect())
    assert want and sorted(tuple(r[c] for c in columns) for r in scorer.completed(events).collect()) == want
    assert scorer.rejected(events).count() == replayed.where("event = 'rejected'").count()
    assert sorted(map(tuple, scorer.status(events).collect())) == sorted(map(tuple, runs.live_status(replayed).collect()))


def test_board_batches_are_idempotent(spark, tmp_path):
    schema = "run_id bigint, segment bigint, quiz_id bigint, accuracy double, final_score bigint, elapsed_ms double, completed_at double"
    first = spark.createDataFrame([(i, 0, 1, 0.5, 100 + i, 10.0, 50.0) for i in range(7)], schema)
    second = spark.createDataFrame([(6, 0, 1, 0.5, 106, 10.0, 50.0), (9, 0, 1, 0.5, 500, 1.0, 60.0), (10, 0, 2, None, 3, 1.0, 60.0)], schema)
    path = str(tmp_path / "boards")
    for batch_id, batch in [(0, first), (1, second), (1, second)]:
        board.merge_batch(batch, batch_id, path)
    got = leaderboard.top_scores(board.read_boards(spark, path)).orderBy("quiz_id", "rank").collect()
    assert [(r.quiz_id, r.score) for r in got] == [("1", 500.0), ("1", 106.0), ("1", 105.0), ("1", 104.0), ("1", 103.0), ("2", 3.0)]
    assert {r.username for r in got} == {"Player 1"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables here")
def test_streams_run_under_any_session(spark):
    """Keyed state needs a store that the caller's session need not name; its settings stay as they were."""
    from atlasrun.plans import all_queries
    from atlasrun.plans.stream_queries import STATE_STORE

    plain = spark.newSession()
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain.conf.set(STATE_STORE, default)
    assert all_queries()["stream_status"](plain, "/root/testdata/sf0.001").count() > 0
    assert plain.conf.get(STATE_STORE) == default


def test_live_batches_are_upserts(spark, tmp_path):
    def rows(*some):
        return spark.createDataFrame([(run, 0, seq, seq, seq, 9 - seq, 0.5, 3) for run, seq in some], live.COLUMNS)

    path = str(tmp_path / "live")
    batches = [[(1, 1), (2, 1)], [(1, 2), (1, 3)], [(3, 1)], [(2, 4)], [(1, 5)], [(3, 2), (4, 7)], [(5, 1)]]
    want = {}
    for batch_id, some in enumerate(batches):
        for turn in range(2 if batch_id in (1, 3, 5) else 1):  # some come again, merges included
            live.merge_live(rows(*some), batch_id, path, merge_every=2)
        for run, seq in some:
            want[run] = seq
        assert {r.run_id: r.seq for r in live.read_live(spark, path).collect()} == want
    bases, changes = live._written(spark, path)
    assert sorted(bases) == [3, 5] and sorted(changes) == [4, 5, 6]
    assert live.read_live(spark, str(tmp_path / "none")).count() == 0


def test_live_stream_keeps_one_row_per_run(spark, tmp_path):
    rows = random_log(5, run_count=6, length=50)
    path = written(spark, tmp_path, rows, 4)
    live.start_live(scorer.live(stream_actions(spark, path, max_files=1)), f"{tmp_path}/live", f"{tmp_path}/state", merge_every=2).awaitTermination()
    last = {}
    for r in runs.live_status(runs.replay(read_actions(spark, path))).orderBy("seq").collect():
        last[r.run_id] = tuple(r)
    assert last and {r.run_id: tuple(r) for r in live.read_live(spark, f"{tmp_path}/live").select(*runs.live_status(runs.replay(read_actions(spark, path))).columns).collect()} == last


def test_a_hot_run_is_held_in_arrays():
    """700,000 actions of one run in one trigger: small arrays in any order of arrival, events in frames, the same as in order."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    count, r = 700_000, np.random.default_rng(3)
    order = r.permutation(count)
    right = r.random(count) < 0.3

    def chunk(some):
        return pd.DataFrame({"run_id": 1, "quiz_id": 7, "seq": some, "type": np.where(some % 5 == 0, "read-elapsed", "submit"), "ts_ms": some.astype(float),
                             "is_correct": [bool(x) for x in right[some]], "total": 400_000, "answer_id": None, "targets": None})

    tracemalloc.start()
    actions = scorer.Actions()
    for low in range(0, count, 10_000):
        actions.add(chunk(order[low:low + 10_000]))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60 * count
    run, seen, score = scorer.Run(None, 0.0), 0, 0
    for action in actions.in_order():
        assert action.seq == seen and action.is_correct == right[seen]
        seen += 1
        if seen <= 3000:
            score = run.apply(action)["completed"]
    assert seen == count and 0 < score < 3000
