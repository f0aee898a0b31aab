"""Quality classifier: regularised quadratic discriminant over transformed
document statistics.

Each text gives a vector of statistics, transformed to be near normal. Each class
has a mean and a covariance, shrunk towards the pooled covariance and a multiple
of the identity; the score is the logistic of the difference of log densities
(Mahalanobis terms by cached Cholesky factors) and log class shares, calibrated
by a scale and a shift on the rows learned from. All labels are learned from: sums and
products of the statistics, in whole units of 2^-20, are added up on the executors and
so don't depend on the order of arrival; calibration sees how many rows of each class
have which margin, in steps of 2^-10.

Null and empty texts have the statistics of a text without characters and are
scored like any other. Where a class has no labelled text, every score is the
share of label 1 (0.5 without any label). Labels with nulls are not learned from; of several for an id the larger counts,
and of several documents with an id one is learned from.
Repeated rows stay repeated; an empty table gives an empty table; further
columns, whatever their names, are kept by `keep_quality`, never used as inputs.
"""

from __future__ import annotations

import dataclasses
import math
import operator
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_udf, id_remainder, map_rows, materialize, sum_vectors

LEAST_SCORE = 0.3
#: Statistics are added up in units of one part of UNIT, margins counted in steps of one part of STEPS.
UNIT, STEPS = 1 << 20, 1 << 10
#: Weights of the pooled covariance and of the identity in a class's covariance.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
_UPPER, _LOWER, _DIGIT, _SPACE, _COMMON, _ODD = range(6)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, _LOWER)
    for b in range(128):
        c = chr(b)
        kind[b] = _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _COMMON if c in ".,;:'\"-()?!" else _ODD
    return kind


_KIND = _byte_kinds()


def _share(part: float, whole: float, usual: float, weight: float = 20) -> float:
    """The log odds of a share; the shorter the text, the nearer the usual share."""
    p = (part + usual * weight) / (whole + weight)
    return math.log(p / (1 - p)) if p < 0.999 else 7.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 6).tolist()
    words = text.split()
    n, size, letters = len(words), len(raw), kinds[_UPPER] + kinds[_LOWER]
    counts = Counter(words)
    top = max(counts.values(), default=0)
    doubled = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    sizes = list(map(len, words))
    mean = (sum(sizes) + 50) / (n + 10)
    spread = (sum(map(operator.mul, sizes, sizes)) + 350) / (n + 10) - mean * mean
    lines = text.split("\n")
    return [
        math.log(mean),
        math.log1p(max(0.0, spread)),
        math.log((n + 90) / (len(lines) + 3)),
        math.log((len(counts) + 20) / (n + 20) ** 0.9),
        _share(top, n, 0.06),
        _share(doubled, n, 0.01),
        _share(max(0, n - 1 - pairs), n, 0.02),
        _share(len(lines) - len(set(lines)), len(lines), 0.02),
        _share(kinds[_UPPER], letters, 0.03, 100),
        _share(kinds[_DIGIT], size, 0.004, 100),
        _share(kinds[_COMMON], size, 0.03, 100),
        _share(kinds[_ODD], size, 0.001, 100),
        _share(text.count("!") + text.count("?"), size, 0.001, 100),
        _share(text.count(". ") + text.count(".\n"), n, 0.08),
    ]


@dataclasses.dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the classes 0 and 1."""

    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    constant: list[float]
    share: float
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant:
        of = {c: x[y == c] for c in sorted(set(y.astype(int).tolist()))}
        out = cls.of_moments({c: (len(r), r.mean(0), (r - r.mean(0)).T @ (r - r.mean(0))) for c, r in of.items()})
        if out.mean:
            pairs, count = np.unique(np.stack([out.steps(x), y.astype(np.int64)]), axis=1, return_counts=True)
            out.calibrate(pairs[0], pairs[1], count)
        return out

    @classmethod
    def of_moments(cls, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
        """Not yet calibrated. moments: of each class the number of rows, their mean, and the sum of the products of what they differ from it."""
        total = sum(n for n, _, _ in moments.values())
        share = (moments[1][0] if 1 in moments else 0) / total if total else 0.5
        out = cls([], [], [], share)
        if len(moments) < 2:
            return out
        pooled = sum(moments[c][2] for c in (0, 1)) / total
        size = np.diag(np.maximum(np.diag(pooled), 1e-6))
        for n, mean, scatter in (moments[0], moments[1]):
            own = (scatter + 10 * pooled) / (n + 10)
            factor = np.linalg.cholesky((1 - TO_POOLED - TO_IDENTITY) * own + TO_POOLED * pooled + TO_IDENTITY * size + 1e-9 * np.eye(len(mean)))
            out.mean.append(mean)
            out.whiten.append(np.linalg.inv(factor))
            out.constant.append(math.log(n / total) - float(np.log(np.diag(factor)).sum()))
        return out

    def steps(self, x: np.ndarray) -> np.ndarray:
        """A tenth of the difference, in whole steps: no more than about twelve times STEPS different ones."""
        return np.rint(self.difference(x) / 10 * STEPS).astype(np.int64)

    def calibrate(self, steps: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        """Scale and shift by gradient steps on the mean log loss of rows that are counted by
        step and class, kept near the plain logistic of a tenth."""
        z, beta, weight = steps / STEPS, np.array([1.0, 0.0]), count / count.sum()
        design = np.stack([z, np.ones_like(z)], 1)
        for _ in range(300):
            p = 1 / (1 + np.exp(-(design @ beta)))
            beta = beta - 0.3 * (design.T @ (weight * (p - y)) + 0.01 * (beta - [1.0, 0.0]))
        self.scale, self.shift = float(max(beta[0], 0.1)) / 10, float(beta[1])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and share of class 1 against class 0, within bounds."""
        both = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.mean, self.whiten, self.constant)]
        return np.clip(both[1] - both[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.shift, -40, 40)))

    def of_texts(self, texts: list[str | None]) -> list[float]:
        return self.score(np.array([statistics(t) for t in texts])).tolist() if texts else []


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each quality in rows (quality, x) the number, the mean and the summed products of what x differs from it, from exact sums."""

    def make():
        def step(rows):
            x, quality = np.rint(np.array(rows["x"]) * UNIT).astype(np.int64), np.array(rows["quality"])
            found, vector = sorted(set(rows["quality"])), []
            for c in found:  # a slice has 512 rows at most and statistics are below 100: no sum overflows
                own = x[quality == c]
                vector.append(np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()]))
            return {"quality": found, "vector": vector}

        return step

    parts = map_rows(rows, "quality int, vector array<long>", make)
    out, d = {}, len(statistics(""))
    for c, sums in sum_vectors(parts.withColumn("vector", F.col("vector").cast("array<decimal(38,0)>")), "quality", "vector").items():
        n, *rest = map(int, sums)
        one, two = rest[:d], rest[d:]
        scatter = [(n * two[i * d + j] - one[i] * one[j]) / (n * UNIT * UNIT) for i in range(d) for j in range(d)]
        out[c] = n, np.array([v / (n * UNIT) for v in one]), np.array(scatter).reshape(d, d)
    return out


def learn_quality(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Discriminant:
    """Learns `quality` from all labels of ids where may_learn (over doc_id) holds."""
    usable = may_learn & F.col("doc_id").isNotNull()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(usable & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "x": [statistics(t) for t in rows["text"]]}

    # statistics are far smaller than texts: they are what moves, one for each id, however many documents repeat it
    each = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(usable), "doc_id long, x array<double>", make)
    one = each.groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = materialize(one.join(known, "doc_id").select("quality", "x"), "statistics")
    model = Discriminant.of_moments(_moments(rows))
    if model.mean:

        def measure():
            return lambda rows: {"step": model.steps(np.array(rows["x"])), "quality": rows["quality"]}

        counted = map_rows(rows, "step long, quality int", measure).groupBy("step", "quality").count().toPandas()  # bounded by the steps
        model.calibrate(counted["step"].to_numpy(), counted["quality"].to_numpy(), counted["count"].to_numpy())
    return model


def score_quality(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "score": model.of_texts(rows["text"])}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", make)


def keep_quality(docs: DataFrame, model: Discriminant, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all columns, that have the least score or more."""

    def make():
        return lambda texts: [s >= least for s in model.of_texts(texts.to_pylist())]

    return docs.where(column_udf("boolean", make)(F.col("text")))


def quality_of_held_out(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> DataFrame:
    """Learns from labels whose id's remainder isn't held, and scores all documents."""
    model = learn_quality(docs, labels, id_remainder(F.col("doc_id"), divisor) != held)
    return score_quality(docs, model).select(
        "doc_id", (id_remainder(F.col("doc_id"), divisor) == held).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted")
    )
