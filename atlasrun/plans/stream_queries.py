"""Registered streaming jobs, run to the end of the data at hand; results equal the batch rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir
from ..streaming import board, live, scorer
from .registry import query, with_views
from .run_queries import ANSWER_CHECK, ANSWER_COLUMNS, PLAY, RESULTS, SEGMENTS, _exact_credit, answer_log, answer_scope, target_orders
from .views import ACTIONS, ATTEMPTS, Tables

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Settings that a stream's own session takes over.
CARRIED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.files.maxPartitionBytes")
# Files of a trigger; it bounds how many actions of one run are sorted together.
FILES = 16


def _folder(t: Tables) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _streaming(t: Tables) -> Tables:
    """The same tables in a session of their own, with the state store that keyed state needs and the caller's other settings."""
    own = t.spark.newSession()
    for key in CARRIED:
        value = t.spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    own.conf.set(STATE_STORE, ROCKSDB)
    return Tables(own, t.folder)


def _events(t: Tables) -> DataFrame:
    """The event table as a stream of rows, a few files at a time."""
    return (t.spark.readStream.schema(t.read("events").schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", FILES)
            .parquet(t.folder))


def _stream(t: Tables, view: str = "attempts") -> DataFrame:
    """The event table as a stream of actions, in a session of its own."""
    streamed = _streaming(t)
    source, table = _events(streamed), streamed.read
    streamed.read = lambda name: source if name == "events" else table(name)
    return getattr(streamed, view)


def _finish(events: DataFrame, t: Tables) -> DataFrame:
    """Run the stream over all data into a table and read that."""
    folder = _folder(t)
    run = (events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
           .option("path", f"{folder}/out").trigger(availableNow=True).start())
    run.awaitTermination()
    return t.spark.read.schema(events.schema).parquet(f"{folder}/out")


@query("stream_run_results", with_views(ATTEMPTS, RESULTS, body="SELECT * FROM results"))
def stream_run_results(t: Tables) -> DataFrame:
    done = scorer.completed(scorer.score_stream(_stream(t), implicit_start=0.0))
    return _finish(done, t).select("run_id", "quiz_id", "accuracy", "score", "missed", "perfect", "eventually_correct", "elapsed_ms", "final_score")


@query("stream_rejections", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, seq, CASE WHEN end_seq IS NOT NULL AND seq > end_seq THEN 'already-completed' ELSE gate_reason END AS reason
FROM gate LEFT JOIN ends USING (run_id) WHERE (end_seq IS NOT NULL AND seq > end_seq) OR gate_reason IS NOT NULL"""))
def stream_rejections(t: Tables) -> DataFrame:
    """Side output of rejected actions."""
    return _finish(scorer.rejected(scorer.score_stream(_stream(t), implicit_start=0.0)), t).drop("segment")


@query("stream_status", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, seq, correct::BIGINT AS correct, completed::BIGINT AS completed, (total - completed)::BIGINT AS remaining,
       CASE WHEN completed > 0 THEN score / completed ELSE 0 END::DOUBLE AS accuracy, (CASE WHEN closes THEN 3 ELSE 3 - attempt END)::BIGINT AS attempts_left
FROM (SELECT *, sum(is_correct::INT) OVER w AS correct, sum(closes::INT) OVER w AS completed, sum(credit) OVER w AS score
      FROM answers WINDOW w AS (PARTITION BY run_id ORDER BY seq))"""))
def stream_status(t: Tables) -> DataFrame:
    """Live status of every run after each answer."""
    return _finish(scorer.status(scorer.score_stream(_stream(t), implicit_start=0.0)), t).drop("segment")


@query("stream_answers", ANSWER_CHECK)
def stream_answers(t: Tables) -> DataFrame:
    """From a stream of raw answers to the results of the completed runs."""
    own = _streaming(t)
    events = scorer.score_answers(answer_log(own, _events(own)), answer_scope(own), target_orders(own), implicit_start=0.0)
    return _finish(scorer.completed(events), t).select(*ANSWER_COLUMNS)


@query("stream_board", with_views(ATTEMPTS, RESULTS, body="""
SELECT quiz_id::VARCHAR AS quiz_id, final_score::DOUBLE AS score, elapsed_ms, username FROM (
  SELECT *, 'Player 1' AS username, row_number() OVER (PARTITION BY quiz_id ORDER BY final_score DESC, elapsed_ms, elapsed_ms::BIGINT || '-' || run_id || '-0') AS rank FROM results)
WHERE rank <= 5"""))
def stream_board(t: Tables) -> DataFrame:
    """Boards kept by a stream of completed runs."""
    folder = _folder(t)
    done = scorer.completed(scorer.score_stream(_stream(t), implicit_start=0.0))
    board.start_board(done, f"{folder}/boards", f"{folder}/state").awaitTermination()
    return board.read_boards(t.spark, f"{folder}/boards").select("quiz_id", "score", "elapsed_ms", "username")


@query("stream_live", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, max(seq) AS seq, max(correct)::BIGINT AS correct, max(completed)::BIGINT AS completed, min(total - completed)::BIGINT AS remaining,
       arg_max(CASE WHEN completed > 0 THEN score / completed ELSE 0 END, seq)::DOUBLE AS accuracy, arg_max(CASE WHEN closes THEN 3 ELSE 3 - attempt END, seq)::BIGINT AS attempts_left
FROM (SELECT *, sum(is_correct::INT) OVER w AS correct, sum(closes::INT) OVER w AS completed, sum(credit) OVER w AS score
      FROM answers WINDOW w AS (PARTITION BY run_id ORDER BY seq)) GROUP BY run_id"""))
def stream_live(t: Tables) -> DataFrame:
    """The current status of every run, kept in update mode."""
    folder = _folder(t)
    live.start_live(scorer.live(_stream(t), implicit_start=0.0), f"{folder}/live", f"{folder}/state").awaitTermination()
    return live.read_live(t.spark, f"{folder}/live").drop("segment")


@query("stream_segments", with_views(ACTIONS, SEGMENTS, body="""
SELECT run_id, seq, segment, reason,
       CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN type = 'reset' THEN 'reset' WHEN type = 'start' THEN 'started'
            WHEN seq = end_seq THEN 'completed' WHEN type = 'read-elapsed' THEN 'elapsed' ELSE 'accepted' END AS event FROM evt"""))
def stream_segments(t: Tables) -> DataFrame:
    """Every action of the full log, with starts, resets and forced ends, as the stream takes it."""
    return _finish(scorer.score_stream(_stream(t, "actions")), t).select("run_id", "seq", "segment", "reason", "event")


@query("stream_force_complete", with_views(ACTIONS, SEGMENTS, body=f"""
SELECT run_id, segment, quiz_id, total, score, missed, elapsed_ms, {_exact_credit('score', 'total', 'elapsed_ms')} AS final_score
FROM (SELECT run_id, segment, max(quiz_id) AS quiz_id, max(total)::BIGINT AS total,
        coalesce(sum(CASE WHEN reason IS NULL AND closes AND is_correct THEN CASE attempt WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END END), 0)::DOUBLE AS score,
        max(total)::BIGINT - count(*) FILTER (WHERE reason IS NULL AND closes AND is_correct) AS missed,
        (max(CASE WHEN seq = end_seq THEN ts_ms END) - max(started_at))::DOUBLE AS elapsed_ms
      FROM evt WHERE start_seq IS NOT NULL GROUP BY run_id, segment HAVING bool_or(seq = end_seq AND type = 'complete-debug'))"""))
def stream_force_complete(t: Tables) -> DataFrame:
    """Results of the runs that an action has ended before their last target."""
    events = scorer.score_stream(_stream(t, "actions"))
    forced = _finish(events.where("event = 'completed' and attempt is null"), t)
    return scorer.completed(forced).select("run_id", "segment", "quiz_id", "total", "score", "missed", "elapsed_ms", "final_score")
