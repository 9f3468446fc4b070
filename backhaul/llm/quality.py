"""Quality of texts, learnt from positives and unlabelled text alone.

Trusted positives are texts labelled 1; everything else, labelled or not, is unlabelled web
text, a mixture of positives (their share is the class prior) and negatives. The classifier
minimises the non-negative unbiased risk

    prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]),   l(z) = log(1 + exp(-z))

by Newton steps, each from one pass over all texts' features; a step that does not lower the
risk (past the point where the second part would become negative, it cannot) is halved. With this
loss the score is an estimate of the probability of being a positive.

The class prior is estimated before that: a classifier of positives against unlabelled text
orders texts; wherever the upper end of that order is pure, the share of unlabelled texts in
it divided by the share of positives in it is the prior, and anywhere else it is larger. So
the least such ratio is taken, over positives kept apart, with an allowance for the chance
in small numbers.

g is a sum of piecewise linear functions of ``text_stats``, with knots at quantiles of all
texts, so it bends where the texts are. All texts enter everything, copies of a text once;
the largest label of its copies counts. What comes to the driver has a size fixed by the number
of knots. Texts are read once; the passes read their features, about 100 bytes a text.

Defined cases: a null text is empty; all empty texts have one score. Without any positive
every score is 0.5. A label counts if its id is not null, all non-null labels of the id are 1 and
the id is not held out; a null id is not held out. Ties need no rule. Repeated rows and ids are
scored one by one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_tasks, small_batches, table, written
from .text_stats import NAMES, text_stats

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
APART = 4  # one positive in so many is kept for estimating the prior
QUANTILES = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
STRENGTH = 25.0  # of the ridge, in positives
STEPS = 25
HALVINGS = 6
BINS = 1000  # places where the order of texts may be cut
CHANCE = 0.1  # of the allowance for small numbers


def held_out() -> Column:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, hash, stats) of every row: the stats of its whole text and a hash of it."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            stats = text_stats([t or "" for t in batch.column(0).to_pylist()])
            bounds = pa.array(np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32))
            columns = [*batch.columns[1:], pa.ListArray.from_arrays(bounds, pa.array(stats.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "hash", "stats"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text, F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.xxhash64(text).alias("hash"))
    return small_batches(rows).mapInArrow(work, "doc_id long, held_out boolean, hash long, stats array<float>")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of trusted positives."""
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return by_id.agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id", F.lit(True).alias("positive"))


def different_texts(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """(stats, positive, apart): every different text once."""
    marked = rows.select("doc_id", "hash", "stats").join(positives, "doc_id", "left")
    once = marked.groupBy("hash").agg(F.any_value("stats").alias("stats"), F.coalesce(F.bool_or("positive"), F.lit(False)).alias("positive"))
    apart = F.col("positive") & (F.pmod(F.xxhash64("hash"), F.lit(APART)) == 0)
    return once.select("stats", "positive", apart.alias("apart"))


class Bends:
    """Piecewise linear functions: a text's weights on two neighbouring knots of every number."""

    def __init__(self, knots: list[np.ndarray]):
        self.knots = knots
        self.size = 1 + sum(max(0, len(k) - 1) for k in knots)  # the first knot of each is nought

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(stats), self.size))
        out[:, 0] = 1
        used, rows = 1, np.arange(len(stats))
        for i, knots in enumerate(self.knots):
            if len(knots) < 2:
                continue
            x = np.clip(stats[:, i], knots[0], knots[-1])
            at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 2)
            share = (x - knots[at]) / (knots[at + 1] - knots[at])
            own = out[:, used - 1 : used + len(knots) - 1]  # its first column is the last one's; it is put back
            before = own[:, 0].copy()
            own[rows, at] = 1 - share
            own[:, 0] = before
            own[rows, at + 1] = share
            used += len(knots) - 1
        return out


def bends(rows: DataFrame) -> Bends:
    """Knots at quantiles of all texts' numbers."""
    wanted = F.array(*map(F.lit, QUANTILES))
    found = rows.agg(*[F.percentile_approx(F.col("stats")[i].cast("double"), wanted, 1000).alias(n) for i, n in enumerate(NAMES)]).first()
    return Bends([np.unique(np.array(q or [0.0])) for q in found])


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class Part:
    """Means over one kind of texts at some weights: loss if they are positives, if negatives, their gradients,
    and the curvature, which both have."""

    n: float
    as_positive: float
    as_negative: float
    down: np.ndarray
    up: np.ndarray
    curve: np.ndarray


def passed(rows: DataFrame, model: Bends, weights: np.ndarray) -> tuple[Part, Part]:
    """(positives, unlabelled), from one pass. Positives kept apart are left to the unlabelled texts."""
    d = model.size

    def work(frames: Iterator[pa.RecordBatch]) -> bytes:
        total = np.zeros((2, 3 + 2 * d + d * d))
        for batch in frames:
            positive = batch.column(1).to_numpy(zero_copy_only=False) & ~batch.column(2).to_numpy(zero_copy_only=False)
            everything = model(_stats(batch.column(0)))
            for kind, x in ((0, everything[positive]), (1, everything)):
                z = x @ weights
                p = _sigmoid(z)
                curve = x.T @ (x * (p * (1 - p))[:, None])
                total[kind] += np.concatenate([[len(x), _softplus(-z).sum(), _softplus(z).sum()], -(1 - p) @ x, p @ x, curve.ravel()])
        return total.tobytes()

    def fold(parts: list[bytes]) -> bytes:
        return sum((np.frombuffer(p) for p in parts), np.zeros(2 * (3 + 2 * d + d * d))).tobytes()

    total = np.frombuffer(of_tasks(rows.select("stats", "positive", "apart"), work, fold)).reshape(2, -1)
    found = []
    for own in total:
        mean = own[1:] / max(own[0], 1)
        found.append(Part(own[0], mean[0], mean[1], mean[2 : 2 + d], mean[2 + d : 2 + 2 * d], mean[2 + 2 * d :].reshape(d, d)))
    return found[0], found[1]


def against(p: Part, u: Part) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk, gradient and curvature of telling positives from unlabelled texts."""
    return p.as_positive + u.as_negative, p.down + u.up, p.curve + u.curve


def non_negative(prior: float):
    """The same of the non-negative unbiased risk."""

    def risk(p: Part, u: Part) -> tuple[float, np.ndarray, np.ndarray]:
        rest = u.as_negative - prior * p.as_negative
        if rest < 0:
            return prior * p.as_positive, prior * p.down, prior * p.curve
        return prior * p.as_positive + rest, prior * (p.down - p.up) + u.up, u.curve

    return risk


def ridge(positives: float, size: int) -> np.ndarray:
    out = np.full(size, STRENGTH / max(positives, 1))
    out[0] = 1e-6
    return out


def minimised(rows: DataFrame, model: Bends, risk) -> np.ndarray:
    """Weights of the least risk, with a ridge that fades with the number of positives: Newton
    steps, halved where they do not help."""
    weights, best, step = np.zeros(model.size), np.inf, np.zeros(model.size)
    left = HALVINGS
    for _ in range(STEPS):
        tried = weights + step
        parts = passed(rows, model, tried)
        penalty = ridge(parts[0].n, model.size)
        value, slope, curve = risk(*parts)
        value += float(penalty @ (tried * tried)) / 2
        if value < best:
            gained, weights, best, left = best - value, tried, value, HALVINGS
            if gained < 1e-7:
                break
            step = -np.linalg.solve(curve + np.diag(penalty), slope + penalty * weights)
        else:
            left -= 1
            step = step / 2
            if not left:
                break
    return weights


def class_prior(rows: DataFrame, model: Bends, weights: np.ndarray) -> float:
    """Share of positives among unlabelled texts: the least ratio of upper ends of the order."""

    def work(frames: Iterator[pa.RecordBatch]) -> bytes:
        total = np.zeros((2, BINS))
        for batch in frames:
            at = np.minimum((_sigmoid(model(_stats(batch.column(0))) @ weights) * BINS).astype(np.int64), BINS - 1)
            apart = batch.column(2).to_numpy(zero_copy_only=False)
            total[0] += np.bincount(at[apart], minlength=BINS)
            total[1] += np.bincount(at, minlength=BINS)
        return total.tobytes()

    def fold(parts: list[bytes]) -> bytes:
        return sum((np.frombuffer(p) for p in parts), np.zeros(2 * BINS)).tobytes()

    total = np.frombuffer(of_tasks(rows.select("stats", "positive", "apart"), work, fold)).reshape(2, BINS)
    n = total.sum(axis=1)
    if not n.all():
        return 0.5
    upper = total[:, ::-1].cumsum(axis=1) / n[:, None]
    allowance = sum(np.sqrt(np.log(4 / CHANCE) / (2 * k)) for k in n)
    p, u = upper[:, upper[0] > 0]
    return float(np.clip((u / p)[np.argmin((u + allowance) / p)], 0.01, 0.99))


@dataclass
class Model:
    bends: Bends
    weights: np.ndarray
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bends(stats) @ self.weights)


def fit(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The classifier of ``features`` rows and labels (doc_id, quality); None without positives."""
    texts = written(different_texts(rows, trusted(labels)), "texts")
    if texts.where("positive").isEmpty():
        return None
    model = bends(texts)
    prior = class_prior(texts, model, minimised(texts, model, against))
    whole = texts.withColumn("apart", F.lit(False))  # from here on all positives teach
    return Model(model, minimised(whole, model, non_negative(prior)), prior)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    rows = written(features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            n = batch.num_rows
            score = np.full(n, 0.5) if model.value is None or not n else model.value.score(_stats(batch.column(2)))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "stats").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
