"""URL filter: a trie over reversed host labels and path segments; the longest matching rule decides."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered_ascii

#: Bytes of rule texts up to which the trie is sent to every executor; beyond, rules are joined.
BROADCAST_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(lowered_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rules(rules: DataFrame) -> DataFrame:
    """``(rule, verdict)`` texts as ``(rule, verdict, host, path)``; the path begins at the first slash.

    Rules without a host or with a null are left out. Of equal rules the smaller verdict (allow) holds.
    """
    host = lowered_ascii(F.regexp_extract("rule", r"(?s)^([^/]*)", 1))
    return (rules.select("rule", "verdict", host.alias("host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"))
            .where("host <> '' and verdict is not null")
            .groupBy("host", "path").agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict")))


def segments(path: str) -> tuple[list[str], str]:
    """Whole segments of a path, each with its closing slash, and the rest after the last slash."""
    *whole, rest = path.split("/")
    return [s + "/" for s in whole], rest


class Trie:
    """Nodes are dictionaries. A step is a host label (from the last one) or ``/`` and then a path segment.

    The rule of a node is under the key ``None``; rules that end inside a segment hang at the node
    before it in ``""``, by the text with which the segment must begin. Labels of a host are never empty
    keys in the host part, because they are prefixed with a dot.
    """

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.root: dict = {}
        for host, path, rule, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            whole, rest = segments(path)
            for segment in whole:
                node = node.setdefault(segment, {})
            if rest:
                node = node.setdefault("", {})
                node[rest] = (rule, verdict)
            else:
                node[None] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule with most host labels, then the longest path, that fits; None if none does."""
        best, node = None, self.root
        whole, rest = segments(path)
        steps = [*whole, rest]
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            best = self._below(node, steps) or best
        return best

    @staticmethod
    def _below(node: dict, steps: list[str]) -> tuple[str, str] | None:
        best = node.get(None)
        for step in steps:
            tails = node.get("")
            if tails:
                best = next((tails[step[:n]] for n in range(len(step), 0, -1) if step[:n] in tails), best)
            node = node.get(step) if step else None
            if node is None:
                break
            best = node.get(None, best)
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule is a host with an optional path (``example.net/en/``). It fits its host and all subdomains if
    the path of the url starts with its path. Most host labels win, then the longest path; without a
    fitting rule ``rule`` is null and the verdict is ``default``. Null or malformed urls have no host, so no
    rule fits. Columns of ``pages`` with one of the four names are replaced. Repeated rows stay.

    The trie is built once and sent to the executors if all rules together take at most
    ``broadcast_bytes``; a larger rule table stays distributed and is joined on (host, whole segments).
    """
    plain = split_rules(rules)
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    size = plain.agg(F.sum(F.octet_length("rule") + F.octet_length("verdict") + 64)).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(parts, plain, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie([(r.host, r.path, r.rule, r.verdict) for r in plain.collect()]))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judged(hosts, paths):
        import pandas as pd

        found = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return (parts.withColumn("__judged", judged("host", "path"))
            .withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged"))


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins: a url asks for its host suffixes, and under each rule host for its runs of leading segments.

    Neither goes deeper than the rules do, so a very long url asks for few keys.
    """
    keyed = rules.select(F.col("host").alias("__at"), F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("__under"),
                         F.col("path").alias("__path"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"))
    labels = F.split("host", r"\.")
    deepest = rules.agg(F.max(F.size(labels))).first()[0] or 0
    hosts = keyed.groupBy("__at").agg(F.max(F.size(F.split("__under", "/")) - 1).alias("__depth"))
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    asked = (parts.select("host", "path").where("host <> ''").distinct()
             .withColumn("__at", F.explode(F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
             .join(hosts, "__at").withColumn("__cut", F.split("path", "/"))
             .withColumn("__under", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.size("__cut") - 1, "__depth")), lambda i: F.concat(
                 F.array_join(F.slice("__cut", 1, i), "/"), F.when(i > 0, "/").otherwise(""))))))
    best = (asked.join(keyed, ["__at", "__under"]).where(F.col("path").startswith(F.col("__path")))
            .groupBy("host", "path").agg(F.max_by(F.struct("__rule", "__verdict"), F.struct(
                F.size(F.split("__at", r"\.")), F.length("__path"))).alias("__best")))
    return (parts.drop("rule", "verdict").join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("__best.__rule"), "verdict": F.coalesce("__best.__verdict", F.lit(default))}).drop("__best"))
