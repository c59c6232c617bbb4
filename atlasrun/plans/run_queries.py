"""Registered queries over attempt logs and score boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import leaderboard, resolve, runs
from ..session import cut_lineage
from ..sources import score_store
from .registry import query, with_views
from .views import _SECONDS, ACTIONS, ATTEMPTS, EPOCH_MS, MEMBERS, QUIZZES, SCORES, Tables, epoch_millis

# Running rules as plain windows per run: every run starts at 0.
GATE = """gate AS (
  SELECT *, CASE WHEN ts_ms < 0 THEN 'invalid-timestamp' WHEN ts_ms < clock THEN 'non-monotonic-time'
                 WHEN type = 'submit' AND is_correct IS NULL THEN 'invalid-answer' END AS gate_reason
  FROM (SELECT *, greatest(0, coalesce(max(CASE WHEN ts_ms >= 0 AND (type <> 'submit' OR is_correct IS NOT NULL) THEN ts_ms END)
          OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS clock FROM attempts))"""
PLAY = GATE + """,
counted AS (
  SELECT *, coalesce(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM gate WHERE type = 'submit' AND gate_reason IS NULL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY run_id, island ORDER BY seq) - 1) % 3 + 1 AS attempt FROM counted),
closing AS (SELECT *, is_correct OR attempt = 3 AS closes,
                   CASE WHEN NOT is_correct THEN 0.0 WHEN attempt = 1 THEN 1.0 WHEN attempt = 2 THEN 0.5 ELSE 0.25 END::DOUBLE AS credit
            FROM numbered),
pointed AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY run_id ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS closed_before FROM closing),
answers AS (SELECT * FROM pointed WHERE closed_before < total),
ends AS (SELECT run_id, max(CASE WHEN closes AND closed_before = total - 1 THEN seq END) AS end_seq FROM answers GROUP BY run_id)"""
EXACT_CREDIT = """(CASE WHEN {n} <= 0 THEN 0 ELSE (2 * {n} + {d}) // (2 * {d}) END)::BIGINT"""


def _exact_credit(credit: str, total: str, elapsed: str) -> str:
    n = f"(floor({credit} * 4 + 0.5)::HUGEINT * 22500 - (floor({elapsed} / 1000.0))::HUGEINT * 25 * {total})"
    return EXACT_CREDIT.format(n=n, d=f"(9 * {total})")


RESULTS = PLAY + f""",
results AS (
  SELECT run_id, quiz_id, score / total AS accuracy, score, missed, perfect, eventually_correct, elapsed_ms,
         {_exact_credit('score', 'total', 'elapsed_ms')} AS final_score
  FROM (SELECT run_id, quiz_id, max(total) AS total, sum(credit) AS score,
               count(*) FILTER (WHERE closes AND NOT is_correct) AS missed, count(*) FILTER (WHERE credit = 1) AS perfect,
               count(*) FILTER (WHERE credit > 0 AND credit < 1) AS eventually_correct,
               max(CASE WHEN seq = end_seq THEN ts_ms END)::DOUBLE AS elapsed_ms
        FROM answers JOIN ends USING (run_id) WHERE end_seq IS NOT NULL GROUP BY run_id, quiz_id))"""


def _attempt_log(t: Tables) -> DataFrame:
    return runs.replay(t.attempts, resets=False, implicit_start_ms=0)


@query("run_results", with_views(ATTEMPTS, RESULTS, body="SELECT * FROM results"))
def run_results(t: Tables) -> DataFrame:
    return runs.run_results(_attempt_log(t)).select(
        "run_id", "quiz_id", "accuracy", "score", "missed", "perfect", "eventually_correct", "elapsed_ms", "final_score")


@query("attempt_credits", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, seq, attempt::BIGINT AS attempt, credit, closed_before AS target_pos,
       CASE WHEN is_correct THEN 'correct' WHEN closes THEN 'missed' ELSE 'wrong' END AS result FROM answers"""))
def attempt_credits(t: Tables) -> DataFrame:
    return _attempt_log(t).where(F.col("attempt").isNotNull()).select(
        "run_id", "seq", F.col("attempt").cast("bigint").alias("attempt"), "credit", "target_pos", "result")


@query("leaderboard_top5", with_views(ATTEMPTS, RESULTS, body="""
SELECT quiz_id, rank, run_id, final_score, elapsed_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY final_score DESC, elapsed_ms, run_id) AS rank FROM results)
WHERE rank <= 5"""))
def leaderboard_top5(t: Tables) -> DataFrame:
    """Flagship: action log to attempts, results, exact scores and the best five of each quiz."""
    results = runs.run_results(_attempt_log(t))
    scores = results.select("quiz_id", "run_id", F.col("final_score").alias("score"), "elapsed_ms",
                            F.lit(0).alias("created_at"), F.lpad(F.col("run_id").cast("string"), 20, "0").alias("id"))
    return leaderboard.top_scores(scores).select(
        "quiz_id", F.col("rank").cast("bigint").alias("rank"), "run_id", F.col("score").alias("final_score"), "elapsed_ms")


@query("monotonic_gate", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, seq, CASE WHEN end_seq IS NOT NULL AND seq > end_seq THEN 'already-completed' ELSE gate_reason END AS reason
FROM gate LEFT JOIN ends USING (run_id)
WHERE (end_seq IS NOT NULL AND seq > end_seq) OR gate_reason IS NOT NULL"""))
def monotonic_gate(t: Tables) -> DataFrame:
    """Rejected rows with their reason."""
    return _attempt_log(t).where(F.col("event") == "rejected").select("run_id", "seq", "reason")


@query("time_validity", with_views(ATTEMPTS, body="SELECT run_id, seq, ts_ms >= 0 AS time_ok FROM attempts"))
def time_validity(t: Tables) -> DataFrame:
    return t.attempts.select("run_id", "seq", runs.valid_time(F.col("ts_ms")).alias("time_ok"))


@query("run_pointer", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, count(*) FILTER (WHERE closes) AS closed, max(total)::BIGINT AS total,
       count(*) FILTER (WHERE closes) = max(total) AS completed FROM answers GROUP BY run_id"""))
def run_pointer(t: Tables) -> DataFrame:
    """Target pointer of every run with answers."""
    return (_attempt_log(t).where(F.col("attempt").isNotNull()).groupBy("run_id")
            .agg(F.count(F.when(F.col("closes"), 1)).alias("closed"), F.max("total").alias("total"))
            .withColumn("completed", F.col("closed") == F.col("total")))


@query("run_status", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, seq, correct::BIGINT AS correct, completed::BIGINT AS completed, (total - completed)::BIGINT AS remaining,
       CASE WHEN completed > 0 THEN score / completed ELSE 0 END::DOUBLE AS accuracy,
       (CASE WHEN closes THEN 3 ELSE 3 - attempt END)::BIGINT AS attempts_left
FROM (SELECT *, sum(is_correct::INT) OVER w AS correct, sum(closes::INT) OVER w AS completed, sum(credit) OVER w AS score
      FROM answers WINDOW w AS (PARTITION BY run_id ORDER BY seq))"""))
def run_status(t: Tables) -> DataFrame:
    return runs.live_status(_attempt_log(t)).drop("segment")


@query("outcomes", with_views(ATTEMPTS, PLAY, body="""
SELECT run_id, closed_before AS target_pos, attempt::BIGINT AS attempts,
       CASE WHEN is_correct THEN 'correct' ELSE 'missed' END AS status, credit FROM answers WHERE closes"""))
def outcomes(t: Tables) -> DataFrame:
    return runs.outcomes(_attempt_log(t)).drop("segment")


# Rules over segments: full action log with starts, resets and forced completions.
SEGMENTS = """seg AS (
  SELECT *, sum(CASE WHEN type = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq)::BIGINT AS segment FROM actions),
starts AS (SELECT run_id, segment, min(seq) AS start_seq, arg_min(ts_ms, seq) AS started_at
           FROM seg WHERE type = 'start' AND ts_ms >= 0 AND total > 0 GROUP BY ALL),
timed AS (
  SELECT s.*, start_seq, started_at, greatest(started_at, coalesce(max(CASE WHEN s.seq > start_seq AND ts_ms >= 0
           AND (type IN ('read-elapsed', 'complete-debug') OR (type = 'submit' AND is_correct IS NOT NULL)) THEN ts_ms END)
           OVER (PARTITION BY s.run_id, s.segment ORDER BY s.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), started_at)) AS clock
  FROM seg s LEFT JOIN starts USING (run_id, segment)),
gated AS (
  SELECT *, CASE WHEN type = 'reset' THEN NULL
       WHEN type = 'start' THEN CASE WHEN ts_ms < 0 THEN 'invalid-timestamp' WHEN seq > start_seq THEN 'already-active'
                                     WHEN total <= 0 THEN 'empty-quiz' END
       WHEN start_seq IS NULL OR seq < start_seq THEN 'not-started' WHEN ts_ms < 0 THEN 'invalid-timestamp'
       WHEN ts_ms < clock THEN 'non-monotonic-time' WHEN type = 'submit' AND is_correct IS NULL THEN 'invalid-answer' END AS gate_reason
  FROM timed),
isl AS (
  SELECT *, coalesce(sum(is_correct::INT) OVER (PARTITION BY run_id, segment ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM gated WHERE type = 'submit' AND gate_reason IS NULL),
num AS (SELECT *, (row_number() OVER (PARTITION BY run_id, segment, island ORDER BY seq) - 1) % 3 + 1 AS attempt FROM isl),
cls AS (SELECT *, is_correct OR attempt = 3 AS closes FROM num),
cnt AS (SELECT *, sum(closes::INT) OVER (PARTITION BY run_id, segment ORDER BY seq) AS closed FROM cls),
fin AS (SELECT run_id, segment, min(seq) AS end_seq FROM (
          SELECT run_id, segment, seq FROM cnt WHERE closes AND closed = total
          UNION ALL SELECT run_id, segment, seq FROM gated WHERE type = 'complete-debug' AND gate_reason IS NULL) GROUP BY ALL),
evt AS (
  SELECT g.*, f.end_seq, c.attempt, c.closes,
         CASE WHEN f.end_seq IS NOT NULL AND g.seq > f.end_seq AND g.type <> 'reset'
                   AND NOT (g.type = 'start' AND g.gate_reason = 'invalid-timestamp') THEN 'already-completed'
              ELSE g.gate_reason END AS reason
  FROM gated g LEFT JOIN fin f USING (run_id, segment) LEFT JOIN cnt c USING (run_id, segment, seq))"""


def _play_log(t: Tables) -> DataFrame:
    return runs.replay(t.actions)


@query("run_segments", with_views(ACTIONS, SEGMENTS, body="""
SELECT run_id, seq, segment, reason,
       CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN type = 'reset' THEN 'reset' WHEN type = 'start' THEN 'started'
            WHEN seq = end_seq THEN 'completed' WHEN type = 'read-elapsed' THEN 'elapsed' ELSE 'accepted' END AS event FROM evt"""))
def run_segments(t: Tables) -> DataFrame:
    """Every action of the full log with its segment, event and rejection reason."""
    return _play_log(t).select("run_id", "seq", "segment", "reason", "event")


@query("force_complete", with_views(ACTIONS, SEGMENTS, body=f"""
SELECT run_id, segment, quiz_id, total, score, missed, elapsed_ms, {_exact_credit('score', 'total', 'elapsed_ms')} AS final_score
FROM (SELECT run_id, segment, quiz_id, total, score, total - closed + missed_closed AS missed, (end_at - started_at)::DOUBLE AS elapsed_ms
  FROM (SELECT run_id, segment, max(quiz_id) AS quiz_id, max(total)::BIGINT AS total, max(started_at) AS started_at,
         coalesce(sum(CASE WHEN reason IS NULL AND closes AND is_correct THEN CASE attempt WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END END), 0)::DOUBLE AS score,
         count(*) FILTER (WHERE reason IS NULL AND closes) AS closed,
         count(*) FILTER (WHERE reason IS NULL AND closes AND NOT is_correct) AS missed_closed,
         coalesce(max(CASE WHEN seq = end_seq THEN ts_ms END),
                  max(CASE WHEN reason IS NULL AND seq > start_seq THEN ts_ms END) + 600000, max(started_at) + 600000) AS end_at
    FROM evt WHERE start_seq IS NOT NULL GROUP BY run_id, segment))"""))
def force_complete(t: Tables) -> DataFrame:
    """Results of all started runs; open ones are closed ten minutes after their last action."""
    return runs.force_complete(_play_log(t), extra_ms=600000).select(
        "run_id", "segment", "quiz_id", "total", "score", "missed", "elapsed_ms", "final_score")


@query("remaining_outcomes", with_views(ACTIONS, SEGMENTS, body="""
SELECT run_id, segment, unnest(range(closed, total)) AS target_pos, 3::BIGINT AS attempts, 'missed' AS status, 0.0::DOUBLE AS credit
FROM (SELECT run_id, segment, max(total)::BIGINT AS total, count(*) FILTER (WHERE reason IS NULL AND closes) AS closed
      FROM evt WHERE start_seq IS NOT NULL GROUP BY run_id, segment) WHERE closed < total"""))
def remaining_outcomes(t: Tables) -> DataFrame:
    return runs.remaining_outcomes(_play_log(t))


@query("seeded_order", with_views(MEMBERS, """runs AS (SELECT DISTINCT user_id AS run_id, CASE user_id % 5 WHEN 0 THEN 'world' WHEN 1 THEN 'AFRICA' WHEN 2 THEN 'AMERICA'
             WHEN 3 THEN 'ASIA' ELSE 'EUROPE' END AS quiz_id FROM events),
lists AS (SELECT quiz_id, list(location_id ORDER BY pos) AS ids, count(*)::INT AS n FROM members GROUP BY quiz_id),
walk AS (
  SELECT run_id, ids, n, n - 1 AS last FROM runs JOIN lists USING (quiz_id)
  UNION ALL
  SELECT run_id, list_transform(ids, lambda v, k: CASE WHEN k = last + 1 THEN ids[pick + 1] WHEN k = pick + 1 THEN ids[last + 1] ELSE v END), n, last - 1
  FROM (SELECT *, floor((('0x' || substr(md5('7:' || run_id || ':' || (n - 1 - last)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (last + 1))::INT AS pick
        FROM walk WHERE last > 0))""", recursive=True, body="""
SELECT run_id, unnest(range(n))::BIGINT AS pos, unnest(ids) AS location_id FROM walk WHERE last <= 0"""))
def seeded_order(t: Tables) -> DataFrame:
    """A repeatable target order for every run, with each member once."""
    quiz = (F.when(F.col("run_id") % 5 == 0, "world").when(F.col("run_id") % 5 == 1, "AFRICA")
            .when(F.col("run_id") % 5 == 2, "AMERICA").when(F.col("run_id") % 5 == 3, "ASIA").otherwise("EUROPE"))
    run_ids = t.read("events").select(F.col("user_id").alias("run_id")).distinct().withColumn("quiz_id", quiz)
    # One array per quiz definition, as quiz documents hold it; a quiz lists each location once.
    lists = t.members.groupBy("quiz_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "location_id"))), lambda m: m["location_id"]).alias("ids"))
    draws = runs.seeded_draws(7, F.col("run_id"), F.size("ids") - 1)
    ordered = run_ids.join(lists, "quiz_id").withColumn("draws", draws)
    return ordered.select("run_id", F.posexplode(runs.shuffle_ids(F.col("ids"), F.col("draws"))).alias("pos", "location_id")) \
        .select("run_id", F.col("pos").cast("bigint").alias("pos"), "location_id")


# Score boards.
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY score DESC, elapsed_ms, created_at, id) AS rank FROM scores)"""


@query("score_exact", with_views(SCORES, body="""
SELECT quiz_id, id, accuracy_hundredths, seconds,
       (CASE WHEN n <= 0 THEN 0 ELSE (2 * n + 900) // 1800 END)::BIGINT AS final_score
FROM (SELECT *, (round(accuracy_hundredths * 100)::HUGEINT * 9 - seconds::HUGEINT * 2500) AS n
      FROM (SELECT quiz_id, id, round(coalesce(accuracy, 0) * 10000, 2) AS accuracy_hundredths, floor(elapsed_ms / 1000)::BIGINT AS seconds FROM scores))"""))
def score_exact(t: Tables) -> DataFrame:
    rows = t.scores.select("quiz_id", "id", F.round(F.coalesce("accuracy", F.lit(0.0)) * 10000, 2).alias("accuracy_hundredths"),
                           F.floor(F.col("elapsed_ms") / 1000).alias("seconds"))
    return rows.withColumn("final_score", scoring.final_score(F.col("accuracy_hundredths"), F.col("seconds")))


@query("final_scores", with_views(SCORES, body=f"""
SELECT id, credit, total, {_exact_credit('credit', 'total', 'elapsed_ms')} AS final_score
FROM (SELECT id, elapsed_ms, (o % 41)::DOUBLE / 4 AS credit, 10 + o % 3 AS total FROM (SELECT *, id::BIGINT AS o FROM scores))"""))
def final_scores(t: Tables) -> DataFrame:
    order = F.col("id").cast("bigint")
    rows = t.scores.select("id", "elapsed_ms", ((order % 41).cast("double") / 4).alias("credit"), (10 + order % 3).alias("total"))
    return rows.select("id", "credit", "total", scoring.final_score_from_credit(
        F.col("credit"), F.col("total"), F.col("elapsed_ms")).alias("final_score"))


@query("score_board", with_views(SCORES, RANKED, body="""
SELECT quiz_id, rank, id, username, score, elapsed_ms, created_at FROM ranked WHERE rank <= 5"""))
def score_board(t: Tables) -> DataFrame:
    return leaderboard.top_scores(t.scores).select(
        "quiz_id", F.col("rank").cast("bigint").alias("rank"), "id", "username", "score", "elapsed_ms", "created_at")


@query("quiz_board", with_views(SCORES, body="""
SELECT quiz_id, id, username, score, elapsed_ms, created_at FROM scores WHERE quiz_id = '1-URGENT'
ORDER BY score DESC, elapsed_ms, created_at, id LIMIT 5"""))
def quiz_board(t: Tables) -> DataFrame:
    return leaderboard.quiz_board(t.scores, "1-URGENT").drop("accuracy")


@query("qualifying", with_views(SCORES, RANKED, body="SELECT quiz_id, id, rank <= 5 AS qualifies FROM ranked"))
def qualifying(t: Tables) -> DataFrame:
    return leaderboard.qualifying(t.scores).select("quiz_id", "id", "qualifies")


_REPORT = """
SELECT quiz_id, {key}, username AS player, score, CASE WHEN accuracy IS NULL THEN '—' ELSE printf('%.2f%%', accuracy * 100) END AS accuracy,
       (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS time,
       CASE WHEN score >= 7500 THEN 'Celebration' WHEN score >= 5000 THEN 'Great work' WHEN score >= 2500 THEN 'Keep going'
            ELSE 'Keep practicing' END AS tier,
       CASE WHEN score >= 7500 THEN 'Outstanding run' WHEN score >= 5000 THEN 'A strong run'
            WHEN score >= 2500 THEN 'You are building momentum' ELSE 'Every run is progress' END AS tier_text
FROM (SELECT *, floor(elapsed_ms / 1000)::BIGINT AS s FROM {rows})"""


@query("board_report", with_views(SCORES, RANKED, body=_REPORT.format(key="id, rank", rows="ranked WHERE rank <= 5")))
def board_report(t: Tables) -> DataFrame:
    """The boards of all quizzes as report texts."""
    return leaderboard.board_report(leaderboard.top_scores(t.scores)).withColumn("rank", F.col("rank").cast("bigint"))


@query("score_texts", with_views(SCORES, body=_REPORT.format(key="id", rows="scores")))
def score_texts(t: Tables) -> DataFrame:
    """Report texts of every score record."""
    return leaderboard.board_report(t.scores)


@query("boards_of_all", with_views(SCORES, QUIZZES, RANKED, """named AS (SELECT quiz_id FROM quizzes UNION SELECT DISTINCT quiz_id FROM scores)""", body="""
SELECT quiz_id, rank, id, score FROM named LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) USING (quiz_id)"""))
def boards_of_all(t: Tables) -> DataFrame:
    """Every quiz with its board, also the quizzes nobody has a score in."""
    named = t.quizzes.select("quiz_id").union(t.scores.select("quiz_id")).distinct()
    return leaderboard.boards_of_all_quizzes(named, t.scores).select(
        "quiz_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


@query("valid_scores", with_views(SCORES, body="""
SELECT quiz_id, id, score FROM (
  SELECT quiz_id, id, username, CASE WHEN id::BIGINT % 11 = 0 THEN NULL WHEN id::BIGINT % 13 = 0 THEN 'NaN'::DOUBLE ELSE score END AS score,
         CASE WHEN id::BIGINT % 17 = 0 THEN 'Infinity'::DOUBLE ELSE accuracy END AS accuracy FROM scores)
WHERE score IS NOT NULL AND isfinite(score) AND (accuracy IS NULL OR isfinite(accuracy))"""))
def valid_scores(t: Tables) -> DataFrame:
    """Validity rule over all records, with missing, undefined and infinite numbers worked in."""
    order = F.col("id").cast("bigint")
    faulty = t.scores.withColumns({
        "score": F.when(order % 11 == 0, None).when(order % 13 == 0, float("nan")).otherwise(F.col("score")),
        "accuracy": F.when(order % 17 == 0, float("inf")).otherwise(F.col("accuracy"))})
    return leaderboard.valid_scores(faulty).select("quiz_id", "id", "score")


@query("score_upsert", with_views(SCORES, body="""
SELECT quiz_id, id, score FROM scores UNION ALL
SELECT quiz_id, id || '-again', score FROM scores"""))
def score_upsert(t: Tables) -> DataFrame:
    """Redelivery: all records and a second run of each, delivered twice."""
    again = t.scores.withColumn("id", F.concat("id", F.lit("-again")))
    delivered = t.scores.unionByName(again).unionByName(again)
    return leaderboard.upsert_scores(t.scores, delivered).select("quiz_id", "id", "score")


@query("score_rename", with_views(SCORES, """renames AS (SELECT o_orderpriority AS quiz_id, l_orderkey::VARCHAR AS id, l_linenumber AS moment,
                     CASE WHEN l_returnflag = 'R' THEN ' ' ELSE ' ' || l_returnflag || l_suppkey || ' ' END AS name
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
latest AS (SELECT quiz_id, id, arg_max(name, struct_pack(m := moment, n := name)) AS name FROM renames GROUP BY ALL)""", body="""
SELECT quiz_id, id, CASE WHEN l.id IS NULL THEN username WHEN trim(l.name) = '' THEN 'Player 1' ELSE trim(l.name) END AS username
FROM scores s LEFT JOIN latest l USING (quiz_id, id)"""))
def score_rename(t: Tables) -> DataFrame:
    """Latest rename of each record; every order line renames its order's record."""
    lines, orders = t.read("lineitem"), t.read("orders").select("o_orderkey", "o_orderpriority")
    renames = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("quiz_id"), F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("at"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise(
            F.concat(F.lit(" "), "l_returnflag", F.col("l_suppkey").cast("string"), F.lit(" "))).alias("name"))
    return leaderboard.rename_records(t.scores, renames).select("quiz_id", "id", "username")


@query("default_names", with_views(SCORES, """renames AS (
  SELECT o_custkey % 7 AS device_id, epoch_ms(o_orderdate)::DOUBLE AS moment, max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END) AS name
  FROM orders GROUP BY ALL)""", body="""
SELECT id, CASE WHEN name IS NULL OR name = '' THEN 'Player 1' ELSE name END AS username
FROM (SELECT id, username::BIGINT % 7 AS device_id, created_at FROM scores) s ASOF LEFT JOIN renames r ON s.device_id = r.device_id AND s.created_at >= r.moment"""))
def default_names(t: Tables) -> DataFrame:
    """Player name of every record after the renames on its device; every order renames its own."""
    millis = epoch_millis("o_orderdate").cast("double")
    renames = (t.read("orders")
               .groupBy((F.col("o_custkey") % 7).alias("device_id"), millis.alias("at"))
               .agg(F.max(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))).alias("name")))
    records = t.scores.select((F.col("username").cast("bigint") % 7).alias("device_id"), "id", "created_at", "username")
    return leaderboard.default_names(records, renames).select("id", "username")


def _envelopes(t: Tables) -> DataFrame:
    """One document per order: its record, twice, in a quiz of its own priority; some are broken."""
    key = F.col("o_orderkey")
    entry = F.to_json(F.struct(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("username"),
        F.when(key % 5 > 0, F.col("o_totalprice")).alias("score"), F.when(key % 3 == 0, F.lit(0.5)).alias("accuracy"),
        (key % 600).alias("elapsedMs"), F.when(key % 7 > 0, key).alias("createdAt")))
    version = F.when(key % 11 == 0, "99").otherwise("1")
    whole = F.concat(F.lit('{"version":'), version, F.lit(',"playerName":" '), F.col("o_orderstatus"), F.lit(' ","scores":{"'),
                     F.col("o_orderpriority"), F.lit('":['), entry, F.lit(",null,"), entry, F.lit('],"other":7}}'))
    return t.read("orders").select(key.alias("device_id"), F.when(key % 13 == 0, F.expr("'{not-json'")).otherwise(whole).alias("envelope"))


@query("stored_scores", """
SELECT o_orderkey AS device_id, o_orderpriority AS quiz_id, o_orderkey::VARCHAR AS id, o_totalprice AS score, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS accuracy
FROM orders, range(2) WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0""")
def stored_scores(t: Tables) -> DataFrame:
    """Records of one score document per order, broken documents and records left out."""
    return score_store.stored_scores(_envelopes(t)).select("device_id", "quiz_id", "id", "score", "accuracy")


@query("stored_players", """
SELECT o_orderkey AS device_id, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 THEN o_orderstatus ELSE 'Player 1' END AS player_name FROM orders""")
def stored_players(t: Tables) -> DataFrame:
    """Player name of every score document."""
    return score_store.parse_envelopes(_envelopes(t)).select("device_id", "player_name")


# Answers by location: the target order decides which are right, so the check walks them one by one.
JUDGED = f"""answers AS (
  SELECT user_id AS run_id, event_id AS seq, {_SECONDS} AS ts_ms, CASE WHEN n_regionkey = user_id % 5 THEN n_name END AS answer_id, event_type = 'view' AS looks
  FROM events JOIN nation ON n_nationkey = (event_id * 3) % 25),
targets AS (SELECT run_id, list(n_name ORDER BY (n_nationkey * 7 + run_id) % 25) AS targets, count(*) AS total
            FROM (SELECT DISTINCT user_id AS run_id FROM events) JOIN nation ON n_regionkey = run_id % 5 GROUP BY run_id),
timed AS (SELECT *, coalesce(max(CASE WHEN ts_ms >= 0 AND (looks OR answer_id IS NOT NULL) THEN ts_ms END) OVER (PARTITION BY run_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM answers),
taken AS (SELECT run_id, seq, answer_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM timed
          WHERE NOT looks AND answer_id IS NOT NULL AND ts_ms >= 0 AND ts_ms >= clock),
walk AS (
  SELECT run_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS place, 0 AS spent, false AS is_right, total FROM targets
  UNION ALL
  SELECT run_id, rn, seq, CASE WHEN is_right OR spent = 3 THEN place + 1 ELSE place END, CASE WHEN is_right OR spent = 3 THEN 0 ELSE spent END, is_right, total
  FROM (SELECT w.run_id, k.rn, k.seq, w.place, w.spent + 1 AS spent, g.targets[w.place + 1] = k.answer_id AS is_right, w.total
        FROM walk w JOIN taken k ON k.run_id = w.run_id AND k.rn = w.rn + 1 JOIN targets g ON g.run_id = w.run_id WHERE w.place < w.total))"""


def answer_log(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """Raw answers: an event names a nation, by id or as text; views only read the clock."""
    nation, events = t.read("nation"), t.read("events") if events is None else events
    moment = F.floor((epoch_millis("ts") - EPOCH_MS) / 1000) - F.when(F.col("event_id") % 17 == 0, 60000).otherwise(0)
    by_id = F.col("event_id") % 2 == 0
    return events.join(nation, F.col("n_nationkey") == (F.col("event_id") * 3) % 25).select(
        F.col("user_id").alias("run_id"), (F.col("user_id") % 5).alias("quiz_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "read-elapsed").otherwise("submit").alias("type"), moment.cast("double").alias("ts_ms"),
        F.when(by_id, F.col("n_name")).alias("selected_id"), F.when(~by_id, F.lower("n_name")).alias("text"))


def answer_scope(t: Tables) -> DataFrame:
    """The nations of each region, as the quiz of the region's number."""
    return t.read("nation").select(F.col("n_regionkey").alias("quiz_id"), F.col("n_name").alias("location_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))


def target_orders(t: Tables) -> DataFrame:
    """Each run's targets: the nations of its region, turned by the run's number."""
    place = (F.col("n_nationkey") * 7 + F.col("run_id")) % 25
    joined = t.read("events").select(F.col("user_id").alias("run_id")).distinct().join(t.read("nation"), F.col("n_regionkey") == F.col("run_id") % 5)
    return joined.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "n_name"))), lambda m: m["n_name"]).alias("targets"))


PLAYED = """tried AS (SELECT *, spent = 0 AS closes, lag(spent) OVER (PARTITION BY run_id ORDER BY rn) + 1 AS attempt FROM walk),
played AS (
  SELECT run_id, run_id % 5 AS quiz_id, max(total)::BIGINT AS total, count(*) FILTER (WHERE closes AND NOT is_right) AS missed,
         count(*) FILTER (WHERE is_right AND attempt = 1) AS perfect, max(ts_ms) FILTER (WHERE closes)::DOUBLE AS elapsed_ms,
         coalesce(sum(CASE attempt WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END) FILTER (WHERE is_right), 0)::DOUBLE AS score
  FROM tried JOIN timed USING (run_id, seq) WHERE rn > 0 GROUP BY run_id HAVING count(*) FILTER (WHERE closes) = max(total))"""
_PLAYED_ROWS = f"SELECT run_id, quiz_id, total, score, missed, perfect, elapsed_ms, {_exact_credit('score', 'total', 'elapsed_ms')} AS final_score FROM played"
ANSWER_CHECK = with_views(JUDGED, PLAYED, recursive=True, body=_PLAYED_ROWS)
ANSWER_COLUMNS = ("run_id", "quiz_id", "total", "score", "missed", "perfect", "elapsed_ms", "final_score")


@query("answers_to_results", ANSWER_CHECK)
def answers_to_results(t: Tables) -> DataFrame:
    """From raw answers to the results of the completed runs."""
    return runs.answers_to_results(answer_log(t), answer_scope(t), target_orders(t), resets=False, implicit_start_ms=0).select(*ANSWER_COLUMNS)


@query("answers_to_board", with_views(JUDGED, PLAYED, recursive=True, body=f"""
SELECT quiz_id::VARCHAR AS quiz_id, rank::BIGINT AS rank, final_score::DOUBLE AS score, elapsed_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY final_score DESC, elapsed_ms, elapsed_ms::BIGINT || '-' || run_id || '-0') AS rank FROM ({_PLAYED_ROWS}))
WHERE rank <= 5"""))
def answers_to_board(t: Tables) -> DataFrame:
    """From raw answers to the boards."""
    results = runs.answers_to_results(answer_log(t), answer_scope(t), target_orders(t), resets=False, implicit_start_ms=0)
    return leaderboard.top_scores(leaderboard.score_records(results)).select("quiz_id", F.col("rank").cast("bigint").alias("rank"), "score", "elapsed_ms")


@query("judged_answers", with_views(JUDGED, recursive=True, body="SELECT run_id, seq, is_right FROM walk WHERE rn > 0"))
def judged_answers(t: Tables) -> DataFrame:
    """Which answers are right, when that depends on the target open at the time."""
    orders = target_orders(t)
    resolved = resolve.resolve_answers(answer_log(t), answer_scope(t)).join(
        orders.select("run_id", F.size("targets").cast("bigint").alias("total")), "run_id", "left")
    judged = cut_lineage(runs.judge_answers(resolved, orders, implicit_start_ms=0, resets=False))
    taken = runs.replay(judged, resets=False, implicit_start_ms=0).where(F.col("attempt").isNotNull())
    return taken.select("run_id", "seq", (F.col("result") == "correct").alias("is_right"))
