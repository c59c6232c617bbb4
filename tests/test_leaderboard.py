import json
import random

from atlasrun.operators import leaderboard
from atlasrun.sources import score_store

SCHEMA = "quiz_id string, id string, username string, score double, accuracy double, elapsed_ms double, created_at double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def board(df):
    return {(r.quiz_id, r["rank"]): r.id for r in df.collect()}


def test_top_five_and_ties(spark):
    rows = [("world", f"a{i}", "P", float(i), None, 10_000.0, float(i)) for i in range(6)]
    rows += [("tie", "x", "P", 100.0, None, 2000.0, 2.0), ("tie", "y", "P", 100.0, None, 1000.0, 1.0), ("tie", "z", "P", 100.0, None, 1000.0, 3.0),
             ("tie", "b", "P", 100.0, None, 1000.0, 1.0)]
    got = board(leaderboard.top_scores(frame(spark, rows)))
    assert [got["world", k] for k in range(1, 6)] == ["a5", "a4", "a3", "a2", "a1"] and ("world", 6) not in got
    assert [got["tie", k] for k in range(1, 5)] == ["b", "y", "z", "x"]


def test_qualifying(spark):
    rows = [("w", f"a{i}", "P", 100.0, None, 1000.0, float(i)) for i in range(5)]
    rows += [("w", "slow", "P", 100.0, None, 2000.0, 10.0), ("w", "fast", "P", 100.0, None, 500.0, 11.0)]
    flags = {r.id: r.qualifies for r in leaderboard.qualifying(frame(spark, rows)).collect()}
    assert flags["fast"] and not flags["slow"] and not flags["a4"] and sum(flags.values()) == 5


def test_hot_quiz_ranks_exactly(spark):
    pick = random.Random(3)
    rows = [("hot" if i % 3 else f"q{i}", f"id{i}", "P", float(pick.randrange(50)), None, float(pick.randrange(9)), float(i)) for i in range(3000)]
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[3], r[5], r[6], r[1]))[:5]
    got = board(leaderboard.top_scores(frame(spark, rows).repartition(4)))
    assert [got["hot", k] for k in range(1, 6)] == [r[1] for r in want]


def test_rename_and_defaults(spark):
    scores = frame(spark, [("w", "a", "P", 1.0, None, 1.0, 1.0), ("w", "b", "P", 1.0, None, 1.0, 1.0), ("w", "c", "P", 1.0, None, 1.0, 1.0)])
    renames = spark.createDataFrame([("w", "a", "Old", 1.0), ("w", "a", " Explorer ", 2.0), ("w", "b", "  ", 3.0)],
                                    "quiz_id string, id string, name string, at double")
    assert {r.id: r.username for r in leaderboard.rename_records(scores, renames).collect()} == {"a": "Explorer", "b": "Player 1", "c": "P"}
    records = spark.createDataFrame([("d", 5.0, "?"), ("d", 1.5, "?"), ("d", 0.5, "?"), ("e", 9.0, "?")], "device_id string, created_at double, username string")
    devices = spark.createDataFrame([("d", 1.0, "First"), ("d", 2.0, "Second")], "device_id string, at double, name string")
    named = {(r.device_id, r.created_at): r.username for r in leaderboard.default_names(records, devices).collect()}
    assert named == {("d", 5.0): "Second", ("d", 1.5): "First", ("d", 0.5): "Player 1", ("e", 9.0): "Player 1"}


def test_upsert_is_idempotent(spark):
    stored = frame(spark, [("w", "a", "P", 1.0, None, 1.0, 1.0)])
    fresh = frame(spark, [("w", "a", "P", 1.0, None, 1.0, 1.0), ("w", "b", "P", 2.0, None, 1.0, 1.0), ("w", "b", "P", 2.0, None, 1.0, 1.0)])
    once = leaderboard.upsert_scores(stored, fresh)
    assert sorted(r.id for r in leaderboard.upsert_scores(once, fresh).collect()) == ["a", "b"]


def test_envelopes(spark, tmp_path):
    good = {"id": "a", "username": "U", "score": 10, "elapsedMs": 5, "createdAt": 1}
    entries = [good, {**good, "id": "b", "accuracy": 0.875}, {**good, "id": 7}, {**good, "id": "c", "score": "10"}, {**good, "id": "d", "accuracy": None},
               {**good, "id": "e", "accuracy": "x"}, None, 5, "text", {**good, "id": "f", "elapsedMs": None}, {**good, "id": "g", "score": True}]
    documents = {
        "ok": json.dumps({"version": 1, "playerName": "  Ann ", "scores": {"world": entries, "asia": {"no": "array"}, "full": [
            {**good, "id": f"r{i}", "score": i} for i in range(7)]}}),
        "bad": "{not-json", "v99": json.dumps({"version": 99, "scores": {"world": [good]}}), "text": json.dumps({"version": "1", "scores": {"world": [good]}}),
        "none": "null", "list": json.dumps({"version": 1, "scores": [good]}), "blank": json.dumps({"version": 1, "playerName": " ", "scores": {}})}
    path = tmp_path / "store.txt"
    path.write_text("\n".join(f"{k}\t{v}" for k, v in documents.items()))
    envelopes = score_store.read_envelopes(spark, str(path))
    players = {r.device_id: r.player_name for r in score_store.parse_envelopes(envelopes).collect()}
    assert players == {**{k: "Player 1" for k in documents}, "ok": "Ann"}
    scores = score_store.stored_scores(envelopes)
    assert sorted((r.device_id, r.id, r.accuracy) for r in scores.where("quiz_id = 'world'").collect()) == [("ok", "a", None), ("ok", "b", 0.875)]
    boards = score_store.stored_boards(envelopes)
    assert [r.id for r in boards.where("quiz_id = 'full'").orderBy("rank").collect()] == ["r6", "r5", "r4", "r3", "r2"]
