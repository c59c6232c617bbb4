"""Toxicity: a convolutional classifier over hashed word embeddings with max pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT_WORDS, byte_texts, slices, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: Characters from a word's begin that have a bucket of their own, beside the whole word.
BEGINS = (4, 5)
#: Labelled documents of each class that are drawn for training, at most, and the longest that are drawn.
CLASS_ROWS, TRAIN_BYTES = 3000, 64 << 10
EPOCHS, BATCH, RATE = 6, 32, 0.05
#: Rows with this remainder of crc32(id as text) by HELD_OF are never learned from.
HELD_OUT, HELD_OF = 2, 4
SCORE_LIMIT = 0.3
#: Steps of the score in which labelled texts are counted for the limits by language, and the toxic texts that a limit needs.
SCORE_STEPS, LEAST_TOXIC = 4096, 5
#: Words of a text that are convolved at a time.
STEP = 8192

#: Blanks for all ASCII but letters and digits.
_FOLD = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, in lower case."""
    return text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()


def buckets_of(word: bytes) -> tuple[int, ...]:
    """The buckets of the whole word and of its begins."""
    text = word.decode("utf-8", "replace")
    begins = (xxhash.xxh3_64_intdigest(f"{n} {text[:n]}") % BUCKETS for n in BEGINS)
    return xxhash.xxh3_64_intdigest(word) % BUCKETS, *begins


@dataclass
class Model:
    """Embeddings by bucket, filters by width (width x dimension x filter), output weights, and the calibration."""

    table: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def pooled(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each filter the largest response over the text, and the word where it begins."""
        most, where = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
        edge = max(WIDTHS) - 1
        padded = np.concatenate([vectors, np.zeros((max(edge + 1 - len(vectors), edge), DIM), np.float32)])
        joined = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        for begin in range(0, max(len(vectors), 1), STEP):
            response = padded[begin:begin + STEP + edge] @ joined
            n, column = len(response) - edge, 0
            for k, width in enumerate(WIDTHS):
                total = response[:n, column:column + FILTERS].copy()
                for j in range(1, width):
                    total += response[j:n + j, column + j * FILTERS:column + (j + 1) * FILTERS]
                column += width * FILTERS
                part, at = slice(k * FILTERS, (k + 1) * FILTERS), total.argmax(axis=0)
                value = total[at, np.arange(FILTERS)] + self.shift[k]
                better = value > most[part]
                most[part] = np.where(better, value, most[part])
                where[part] = np.where(better, at + begin, where[part])
        return np.maximum(most, 0), where

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weight + self.bias

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(pooled) + self.offset, -30, 30)))


def _start(texts: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The first dimension of a bucket is how much more often toxic texts have it, less two standard errors."""
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, toxic):
        seen[int(label), np.unique(ids)] += 1
    with_, without = seen[1] + 0.5, seen[0] + 0.5
    ratio = np.log(with_ / (toxic.sum() + 1)) - np.log(without / ((~toxic).sum() + 1))
    sure = np.sign(ratio) * np.maximum(np.abs(ratio) - 2 * np.sqrt(1 / with_ + 1 / without), 0)
    random = np.random.default_rng(7)
    table = random.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = sure
    filters = [random.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f, width in zip(filters, WIDTHS):
        f[:, 0, :FILTERS // 2] += 1 / width
    weight = np.full(len(WIDTHS) * FILTERS, 0.02, np.float32)
    weight[:FILTERS // 2] = 0.3
    return Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weight, -2.0)


def train(texts: list[np.ndarray], toxic: np.ndarray, share: float) -> Model:
    """Fits the classifier by Adagrad on four of five texts, and the calibration on the fifth.

    ``texts`` are (words x buckets) arrays. ``share`` is the share of toxic texts among all labelled ones: the drawn sample
    may be balanced, so calibration weighs the classes back to it. Without both classes the score is constant.
    """
    fit = np.arange(len(texts)) % 5 != 4
    model = _start([t for t, f in zip(texts, fit) if f], toxic[fit])
    if toxic.all() or not toxic.any():
        model.weight[:] = 0
        model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    params = [model.table, *model.filters, *model.shift, model.weight]
    power = [np.full(p.shape, 1e-3, np.float32) for p in params]
    bias_power, order, random = 1e-3, np.flatnonzero(fit), np.random.default_rng(11)
    wide = len(WIDTHS)
    for _ in range(EPOCHS):
        random.shuffle(order)
        for k in range(0, len(order), BATCH):
            chosen = order[k:k + BATCH]
            vectors = [model.table[texts[i]].sum(axis=1) for i in chosen]
            found = [model.pooled(v) for v in vectors]
            pooled = np.stack([p for p, _ in found])
            error = (1 / (1 + np.exp(-np.clip(model.logit(pooled), -30, 30))) - toxic[chosen]).astype(np.float32) / len(chosen)
            back = error[:, None] * model.weight * (pooled > 0)
            grads = [None, *(np.zeros_like(f) for f in model.filters), *(back[:, j * FILTERS:(j + 1) * FILTERS].sum(axis=0) for j in range(wide)),
                     pooled.T @ error + 1e-4 * model.weight]
            rows, steps = [], []
            for d, (i, v, (_, where)) in enumerate(zip(chosen, vectors, found)):
                for c in np.flatnonzero(back[d]):
                    j, f = divmod(int(c), FILTERS)
                    for s in range(min(WIDTHS[j], len(v) - int(where[c]))):
                        at = int(where[c]) + s
                        grads[1 + j][s, :, f] += back[d, c] * v[at]
                        rows.extend(texts[i][at])
                        steps.extend([back[d, c] * model.filters[j][s, :, f]] * texts[i].shape[1])
            for p, grad, q in zip(params[1:], grads[1:], power[1:]):
                q += grad ** 2
                p -= RATE * grad / np.sqrt(q)
            bias_power += float(error.sum()) ** 2
            model.bias -= RATE * float(error.sum()) / bias_power ** 0.5
            if rows:
                which, back_to = np.unique(rows, return_inverse=True)
                grad = np.zeros((len(which), DIM), np.float32)
                np.add.at(grad, back_to, np.stack(steps))
                power[0][which] += grad ** 2
                model.table[which] -= RATE * grad / np.sqrt(power[0][which])
    _calibrate(model, [t for t, f in zip(texts, fit) if not f], toxic[~fit], share, float(toxic.mean()))
    return model


def _calibrate(model: Model, texts: list[np.ndarray], toxic: np.ndarray, share: float, drawn: float) -> None:
    """Slope and offset for scores that are shares of toxic texts, by Newton steps with a pull to no change."""
    prior = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    slope, offset = 1.0, prior
    if len(texts):
        x = np.array([model.logit(model.pooled(model.table[t].sum(axis=1))[0]) for t in texts])
        weight = np.where(toxic, share / drawn, (1 - share) / (1 - drawn))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            g = np.array([(weight * (p - toxic) * x).sum() + (slope - 1), (weight * (p - toxic)).sum() + 0.1 * (offset - prior)])
            c = weight * p * (1 - p)
            h = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            slope, offset = max(0.1, slope - float(step[0])), offset - float(step[1])
    model.slope, model.offset = slope, offset


class _Vectors(dict):
    """A row number for each word, and the rows: sums of the embeddings of a word's buckets."""

    def __init__(self, table: np.ndarray):
        self.table, self.new, self.rows = table, [], np.zeros((0, DIM), np.float32)

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        ids = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new:
            self.rows = np.concatenate([self.rows, self.table[[buckets_of(w) for w in self.new]].sum(axis=1)])
        out = [self.rows[i] for i in ids]
        if len(self) > KEPT_WORDS:  # the words of this batch that found no room are forgotten
            room = max(0, KEPT_WORDS - (len(self) - len(self.new)))
            for word in self.new[room:]:
                del self[word]
            self.rows = self.rows[:len(self)].copy()
        self.new = []
        return out


def held_out(doc: Column) -> Column:
    """Whether a row is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % HELD_OF == HELD_OUT, F.lit(False))


def language_limits(counts: list[tuple[str, int, int, int]], least: int = LEAST_TOXIC) -> dict[str, float]:
    """For each language the score limit with the best F1, from ``language, step of the score, texts, toxic texts``.

    Languages with under ``least`` toxic texts have none.
    """
    limits = {}
    for lang in sorted({r[0] for r in counts}):
        step, n, toxic = np.array(sorted((r[1:] for r in counts if r[0] == lang), reverse=True)).T
        if toxic.sum() < least:
            continue
        best = int((2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())).argmax())
        limits[lang] = float((step[best] + (step[best + 1] + 1 if best + 1 < len(step) else 0)) / 2 / SCORE_STEPS)
    return limits


def _fitted(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, class_rows: int) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model, the labels ``doc_id, toxic`` that may be learned from, and the ids that the classifier was fitted on (none without both classes)."""
    known = labels.select(F.col(doc).cast("long").alias("id"), F.col(label).cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = (F.xxhash64("id"), "id")
    drawn = known.where("toxic = 1").orderBy(*order).limit(class_rows).union(known.where("toxic = 0").orderBy(*order).limit(class_rows))
    texts = docs.select(F.col(doc).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(drawn), "id").orderBy(*order, "text").collect()
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    ids = [np.array([buckets_of(w) for w in words_of(r.text.encode())], np.int64).reshape(-1, 1 + len(BEGINS)) for r in rows]
    share = min(max(share if share is not None else 0.0, 1e-4), 1 - 1e-4)
    model, known = train(ids, toxic, share), known.withColumnRenamed("id", "doc_id")
    if toxic.all() or not toxic.any():
        return model, known, None
    used = docs.sparkSession.createDataFrame([(r.id,) for k, r in enumerate(rows) if k % 5 != 4], "doc_id long").distinct().withColumn("fitted", F.lit(True))
    return model, known, used


def _limits(scored: DataFrame, known: DataFrame, used: DataFrame | None) -> dict[str, float]:
    """Score limits by language from scores (``doc_id, lang, score``) of all labelled documents; a count for each step of the score comes to the driver."""
    if used is None:
        return {}
    judged = scored.where("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "score").join(known, "doc_id").join(used, "doc_id", "left")
    step = F.least(F.floor(F.col("score") * SCORE_STEPS), F.lit(SCORE_STEPS - 1)).cast("int").alias("step")
    counts = judged.groupBy("lang", step).agg(
        F.count("fitted").alias("n_fitted"), F.sum(F.when(F.col("fitted"), F.col("toxic")).otherwise(0)).alias("t_fitted"),
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()
    limits = language_limits([(r.lang, r.step, r.n, r.t) for r in counts])
    return limits | language_limits([(r.lang, r.step, r.n - r.n_fitted, r.t - r.t_fitted) for r in counts if r.n > r.n_fitted])


def learn(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang",
          class_rows: int = CLASS_ROWS) -> tuple[Model, dict[str, float]]:
    """A model from at most ``class_rows`` labelled documents of each class, and score limits by language from all labelled ones.

    Documents are drawn by a hash of the id among those that are not :func:`held_out`; texts longer than
    ``TRAIN_BYTES`` are not drawn. The two samples have a fixed bound, so their ids go to every executor and their
    texts to the driver. Rows with null ids or labels are not used.

    For the limits all labelled documents that are not held out are scored, of any length, and counted by language and
    step of the score. Those that the classifier was fitted on count only for languages with under ``LEAST_TOXIC``
    toxic ones besides; a language with fewer in all has no limit, so ``SCORE_LIMIT`` holds for it.
    """
    model, known, used = _fitted(docs, labels, doc, text, label, class_rows)
    if used is None:
        return model, {}
    labelled = _named(docs, doc, text, lang).withColumn("doc_id", F.col("doc_id").cast("long")).join(known, "doc_id", "left_semi")
    return model, _limits(_scored(labelled, model), known, used)


def learn_and_score(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", class_rows: int = CLASS_ROWS) -> DataFrame:
    """:func:`score_documents` by what :func:`learn` learns from the same documents, with every text scored once.

    The scores are written to the shared checkpoint folder without the texts, and the limits come from those of the labelled rows.
    """
    model, known, used = _fitted(docs, labels, doc, text, label, class_rows)
    scored = written(_scored(_named(docs, doc, text, lang), model))
    return _judged(scored, _limits(scored.where("not held_out"), known, used))


def _named(docs: DataFrame, doc: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), held_out(F.col(doc)).alias("held_out"), F.col(text).alias("text"),
                       (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang"))


def _scored(named: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang, score`` of ``doc_id, held_out, text, lang``."""
    sent = named.sparkSession.sparkContext.broadcast(model)
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(sent.value.table)
        for batch in slices(batches, "text"):
            found = vectors.of([words_of(t) for t in byte_texts(batch["text"])])
            scores = sent.value.score(np.stack([sent.value.pooled(v)[0] for v in found]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["lang"], pa.array(scores.astype(np.float64))],
                                             names=["doc_id", "held_out", "lang", "score"])

    return named.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang string, score double")


def score_documents(docs: DataFrame, model: Model, limits: dict[str, float] | None = None, doc: str = "doc_id", text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, flagged``.

    The score is of the whole text alone: null and empty texts have that of a text without known words.
    ``predicted`` compares it with ``SCORE_LIMIT``, ``flagged`` with the limit of the row's language, if it has one. Rows
    with null or repeated ids are scored like any other; other columns are ignored.
    """
    return _judged(_scored(_named(docs, doc, text, lang), model), limits or {})


def _judged(scored: DataFrame, limits: dict[str, float]) -> DataFrame:
    limit = F.lit(SCORE_LIMIT)
    for name, value in limits.items():
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= SCORE_LIMIT).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
