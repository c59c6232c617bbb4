"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..session import cut_lineage

#: Labelled documents that rules are learned from, at most.
SAMPLE_ROWS = 20_000
#: Thresholds are quantiles of the sample, of all rows and of the bad ones, at these shares.
SHARES = tuple(k / 20 for k in range(21))
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a packed value that hold a word's place; a string of 2 GB has fewer words.
PLACE_BITS = 30
LEARNED = ("n_words", "mean_word", "symbol_share", "dup_share", "repeat_share", "upper_share", "mark_share")


def _repeated(words: Column) -> Column:
    """How many words lie in a run of three words that the text has at least twice.

    Runs are sorted by a hash that is packed with their place; equal neighbours are then compared as texts.
    """
    def alike(values: Column, of: Callable[[Column], Column]) -> Column:
        def kept(v: Column, i: Column) -> Column:
            return (of(v).eqNullSafe(of(F.get(values, i - 1))) & (i > 0)) | of(v).eqNullSafe(of(F.get(values, i + 1)))

        return F.filter(values, kept)

    def run(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    packed = F.slice(F.transform(words, lambda w, i: F.shiftleft(F.shiftright(F.xxhash64(w, *run(i)[1:]), PLACE_BITS), PLACE_BITS)
                                 .bitwiseOR(i.cast("long"))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    close = let(F.sort_array(packed), lambda s: alike(s, lambda v: F.shiftright(v, PLACE_BITS)))
    places = F.transform(close, lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    exact = let(F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", *run(p)).alias("run"), p.alias("place")))),
                lambda s: alike(s, lambda v: v["run"]))
    return F.size(F.array_distinct(F.flatten(F.transform(exact, lambda x: F.array(x["place"], x["place"] + 1, x["place"] + 2)))))


def text_stats(text: Column) -> Column:
    """A struct of counts and shares of one whole text; null counts as empty. Words are runs without ASCII space.

    Counts (bigint): ``n_words``, ``word_chars``, ``n_symbols`` of ``#*$%&|<>``, ``n_dup_lines`` (lines with a word, equal to an earlier
    line), ``n_repeat_words`` (in runs of three words found twice or more). Shares (double, 0 without words) are the
    inputs of learned rules.
    """
    def shares(w: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).alias("n_lines"), _repeated(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count(t, F.lit(r"[!?]")).alias("n_marks"))

        def share(a: Column, b: Column) -> Column:
            return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

        return let(counts, lambda c: F.struct(
            *(c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            share(c["word_chars"], c["n_words"]).alias("mean_word"), share(c["n_symbols"], c["n_words"]).alias("symbol_share"),
            share(c["n_dup_lines"], c["n_lines"]).alias("dup_share"), share(c["n_repeat_words"], c["n_words"]).alias("repeat_share"),
            share(c["n_upper"], c["word_chars"]).alias("upper_share"), share(c["n_marks"], c["n_words"]).alias("mark_share")))

    whole = F.coalesce(text, F.lit(""))
    return let(whole, lambda t: let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: shares(w, t)))


def base_failed(stats: Column) -> Column:
    """The fixed rules: under 50 words, or more than half of the words in repeated runs."""
    return (stats["n_words"] < 50) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 50)


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or, if not ``above``, ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > self.threshold if self.above else stats[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def first_rule(stats: Column, rules: list[Rule]) -> Column:
    """The number of the first rule, from 1, whose conditions all hold; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column(stats)
        for condition in rule[1:]:
            holds = holds & condition.column(stats)
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def with_stats(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with the struct of :func:`text_stats`, computed once per row whatever refers to it."""
    return docs.select("*", F.inline(F.array(F.struct(text_stats(F.col(text)).alias(name)))))


@dataclass
class _Cell:
    """Labelled rows that agree on every threshold: their place on each feature's scale and how many are bad and good."""

    places: tuple[int, ...]
    bad: int
    good: int


def _counts(cells: list[_Cell]) -> tuple[int, int]:
    return sum(c.bad for c in cells), sum(c.good for c in cells)


def _holds(cell: _Cell, test: tuple[int, bool, int]) -> bool:
    feature, above, place = test
    return cell.places[feature] > place if above else cell.places[feature] <= place


def _best_test(cells: list[_Cell], widths: list[int]) -> tuple[float, tuple[int, bool, int]]:
    """The single test with the most information gain over the bad rows it keeps."""
    bad, good = _counts(cells)
    best = (0.0, (0, True, 0))
    before = log2(bad / (bad + good))
    for feature, width in enumerate(widths):
        b, g = [0] * (width + 1), [0] * (width + 1)
        for cell in cells:
            b[cell.places[feature]] += cell.bad
            g[cell.places[feature]] += cell.good
        low_b = low_g = 0
        for place in range(width):
            low_b, low_g = low_b + b[place], low_g + g[place]
            for above, p, n in ((False, low_b, low_g), (True, bad - low_b, good - low_g)):
                if p and p + n < bad + good:
                    best = max(best, (p * (log2(p / (p + n)) - before), (feature, above, place)))
    return best


def cover(grow: list[_Cell], prune: list[_Cell], widths: list[int], precision: float, least: int, most_rules: int,
          most_tests: int = 4) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering: grow a rule, prune it on other rows, take away what it covers, and go on.

    A rule is grown test by test until it covers no good row or no test gains. Its last tests are dropped as long as
    (bad - good) / (bad + good) on ``prune`` does not fall. It must reach ``precision`` and cover ``least`` bad rows on
    both sets together, else learning ends.
    """
    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < most_rules and _counts(grow)[0]:
        tests, left = [], grow
        while len(tests) < most_tests and _counts(left)[1]:
            gain, test = _best_test(left, widths)
            if gain <= 1e-9:
                break
            tests, left = [*tests, test], [c for c in left if _holds(c, test)]

        def covered(some: list[_Cell], n: int) -> list[_Cell]:
            return [c for c in some if all(_holds(c, t) for t in tests[:n])]

        def worth(n: int) -> tuple[float, int]:
            bad, good = _counts(covered(prune, n))
            return ((bad - good) / (bad + good) if bad + good else 0.0, -n)

        if not tests:
            break
        tests = tests[:max(range(1, len(tests) + 1), key=worth)] if _counts(prune)[0] else tests
        bad, good = (a + b for a, b in zip(_counts(covered(grow, len(tests))), _counts(covered(prune, len(tests)))))
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(tests)
        grow, prune = ([c for c in some if not all(_holds(c, t) for t in tests)] for some in (grow, prune))
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = SAMPLE_ROWS, precision: float = 0.95, least: int = 3, most_rules: int = 16) -> list[Rule]:
    """An ordered list of rules for bad documents (``label`` 0) among those that the base rules pass.

    At most ``sample_rows`` labelled ids are drawn, by a hash of the id. Their counts per cell of the threshold grid, at most
    as many rows as the sample, are what the driver learns from. Rows with null ids or labels are not used; an id
    labelled both ways counts for both. No labels or no bad documents: no rules.
    """
    drawn = (labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("good")).where("id is not null and good in (0, 1)").distinct()
             .orderBy(F.xxhash64("id"), "id", "good").limit(sample_rows))
    texts = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    # The sample has a fixed bound, so it may go to every executor, and texts are not shuffled.
    rows = with_stats(texts.join(F.broadcast(drawn), "id"), "text").where(~base_failed(F.col("stats")))
    rows = cut_lineage(rows.select("id", "good", *(F.col("stats")[n].cast("double").alias(n) for n in LEARNED)))
    grid = rows.agg(*(F.percentile_approx(n, list(SHARES), 10_000).alias(n) for n in LEARNED),
                    *(F.percentile_approx(F.when(F.col("good") == 0, F.col(n)), list(SHARES), 10_000).alias(f"bad_{n}") for n in LEARNED)).first()
    scale = {n: sorted({*(grid[n] or []), *(grid[f"bad_{n}"] or [])}) for n in LEARNED}
    place = [sum(((F.col(n) > t).cast("int") for t in scale[n]), F.lit(0)).alias(n) for n in LEARNED]
    counted = rows.select(*place, (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)) == 0).alias("prune"), "good").groupBy(*LEARNED, "prune").agg(
        F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).collect()
    cells = sorted((r["prune"], tuple(r[n] for n in LEARNED), r["bad"], r["good"]) for r in counted)
    grow, prune = ([_Cell(p, b, g) for held, p, b, g in cells if held == which] for which in (False, True))
    # Place k is above the first k thresholds, so "place > k" says "value > threshold k".
    found = cover(grow, prune, [len(scale[n]) for n in LEARNED], precision, least, most_rules)
    return [tuple(Condition(LEARNED[f], above, float(scale[LEARNED[f]][k])) for f, above, k in rule) for rule in found]


def judge_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``rule`` (the number of the learned rule that rejects it, or null) and ``kept``.

    Columns of these names are replaced. Null and empty texts have no words and fail the base rules.
    """
    plain = docs.drop(*({"stats", "base_failed", "rule", "kept"} - {text}))
    judged = with_stats(plain, text).withColumns({"base_failed": base_failed(F.col("stats")), "rule": first_rule(F.col("stats"), rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
