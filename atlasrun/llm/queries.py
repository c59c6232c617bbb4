"""Registered queries of the text operators: one for each, over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chat_repair, chunk_dedup, decontamination, divergence, near_dedup, packing, quality_rules, records, set_join, sharding, toxicity, url_filter
from .common import read
from .repair_sql import REPAIR_SQL

#: Host and path rules of the URL query: fixed values of its contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SHARDS = 16


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return url_filter.judge_urls(read(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.repeated_passages(read(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.learn_and_score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, folder, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_records(spark: SparkSession, folder: str) -> DataFrame:
    files = records.write_records(read(spark, folder, "documents"), records.scratch_folder(spark, "records"), vocabulary("byte_bpe_50k.json"), without_id=True)
    return records.read_records(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    mimic = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(mimic).alias("text"))
    turns = said.unionByName(more).withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chats(turns)
    read_back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                           F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"), "expanded_tokens")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    judged = quality_rules.judge_quality(docs.select("doc_id", "text"), quality_rules.learn_rules(docs, read(spark, folder, "labels")))
    counts = (F.col("stats")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return judged.select("doc_id", *counts, "base_failed", "kept", "rule")


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit_sources(read(spark, folder, "documents"))


def op12_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    said = read(spark, folder, "conversations")
    return chat_repair.repair_conversations(chat_repair.damaged(said), said)


def op13_set_join(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.set_join(read(spark, folder, "documents"))


_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
said AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, sum(n) AS size, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(c.size, 0) AS size, l.v, l.size AS whole
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS size FROM counted GROUP BY lang, source) c USING (lang, source)
  LEFT JOIN langs l USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.size + g.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (g.whole + g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
telling AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling))
WHERE part = 'pair' OR rank <= 200
"""

_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tokens AS (
  SELECT DISTINCT row, doc_id, w[k:k + 2] AS token FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT row, doc_id, count(*) AS n FROM tokens GROUP BY ALL),
common AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.token = b.token AND a.row <> b.row WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY ALL),
links AS (SELECT a, b, y.doc_id AS id FROM common JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reached(row, goal) AS (SELECT a, b FROM links UNION SELECT r.row, l.b FROM reached r JOIN links l ON l.a = r.goal),
least AS (SELECT r.row, min(s.doc_id) AS id FROM reached r JOIN sizes s ON s.row = r.goal GROUP BY r.row),
counts AS (SELECT a AS row, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, m.id) AS component_id, coalesce(c.n_links, 0)::BIGINT AS n_links
FROM words w LEFT JOIN sizes s USING (row) LEFT JOIN least m USING (row) LEFT JOIN counts c USING (row)
"""

_URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, first(r.rule ORDER BY length(h) DESC, length(p) DESC) AS rule, first(r.verdict ORDER BY length(h) DESC, length(p) DESC) AS verdict
  FROM parts JOIN rules r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""

_CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length(role) + length(text) + 24) AS marked,
         -- one guard for each control string in the texts
         sum(len(regexp_extract_all(text, '</?s>|\[/?INST\]|<\|(turn|says|done|image|audio|document|im_start|im_end|endoftext|startoftext)\|>'))) AS guards
  FROM plain GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(marked + guards AS BIGINT) AS formatted_chars
FROM whole
"""

_LEAK_SQL = r"""
WITH folded(kind, id, w) AS (
  SELECT 'doc', doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id AS item_id, w, least(len(w), 10) AS n FROM folded WHERE kind = 'item' AND len(w) > 0),
asked AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
docs AS (SELECT id AS doc_id, w FROM folded WHERE kind = 'doc'),
runs AS (
  SELECT doc_id, k, s.n, array_to_string(w[k:k + s.n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n) s),
hits AS (SELECT doc_id, k, n, item_id FROM runs JOIN asked USING (n, run)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_packing, op4_toxicity, op5_sharding, op6_records, op7_chat_format,
                            op8_decontamination, op9_quality_rules, op10_near_dedup, op11_source_divergence, op12_chat_repair,
                            op13_set_join)}

CHECKS: dict[str, str] = {"op1_url_filter": _URL_SQL, "op7_chat_format": _CHAT_SQL, "op8_decontamination": _LEAK_SQL,
                           "op11_source_divergence": _DIVERGENCE_SQL, "op12_chat_repair": REPAIR_SQL, "op13_set_join": _JOIN_SQL}
