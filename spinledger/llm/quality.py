"""Quality scores from two views of a document that teach each other.

The text view sees which pairs of bytes the lower-cased text is made of; the metadata view
sees language, source, size and layout. Each is a logistic model. In each round a view
labels the unlabelled documents that it is surest about for the other view's training.
Afterwards both are calibrated on labelled documents that neither learned from, and their
calibrated log odds are averaged.

Models are fitted on the driver on a sample whose size is a parameter; scoring reads every
document in whole, on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SIZE = 1024
_HASHED = {"lang": 8, "source": 16}
_LAYOUT = 10
META_SIZE = _LAYOUT + sum(_HASHED.values())
_BUCKET = np.random.default_rng(17).integers(0, TEXT_SIZE, 1 << 16).astype(np.int64)
_UPPER, _DIGIT, _SPACE, _HIGH = slice(65, 91), slice(48, 58), [9, 10, 11, 12, 13, 32], slice(128, 256)
_SIGN = [b for b in range(33, 127) if not chr(b).isalnum()]


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed byte-pair counts, scaled to length one; zeros for a text of less than two bytes."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.int64)
    counts = np.bincount(_BUCKET[data[:-1] << 8 | data[1:]], minlength=TEXT_SIZE) if len(data) > 1 else np.zeros(TEXT_SIZE)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def meta_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    data = (text or "").encode()
    counts, words, lines = np.bincount(np.frombuffer(data, np.uint8), minlength=256), data.split(), data.count(b"\n") + 1
    n = max(1, len(data))
    letters = max(1, n - counts[_SPACE].sum() - counts[_SIGN].sum() - counts[_DIGIT].sum())
    signed = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    layout = [
        np.log1p(len(data)),
        np.log1p(lines),
        np.log1p(len(data) / lines),
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_SIGN].sum() / n,
        counts[_HIGH].sum() / n,
        len(set(words)) / max(1, len(words)),
        len(data) / (1 + len(words)) / 10,
        signed / max(1, len(words)),
    ]
    hashed = []
    for name, value in (("lang", lang), ("source", source)):
        one = np.zeros(_HASHED[name])
        if value is not None:
            one[zlib.crc32(value.encode()) % _HASHED[name]] = 1
        hashed.append(one)
    return np.concatenate((layout, *hashed)).astype(np.float32)


@dataclass
class Logistic:
    """A logistic model over standardised columns."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> Logistic:
        """Accelerated gradient steps; both classes weigh alike."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack(((x - mean) / scale, np.ones(len(x)))).astype(np.float64)
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        v = np.ones(z.shape[1])
        for _ in range(20):  # largest curvature, by powers
            v = z.T @ (weight * (z @ v))
            size = np.linalg.norm(v)
            v /= size
        rate = 1 / (0.25 * size * 1.1 + ridge)
        w, ahead = np.zeros(z.shape[1]), np.zeros(z.shape[1])
        for step in range(steps):
            grade = z.T @ (weight * (sigmoid(z @ ahead) - y)) + ridge * ahead
            new = ahead - rate * grade
            ahead, w = new + step / (step + 3) * (new - w), new
        return cls(w[:-1], float(w[-1]), mean, scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibration(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log odds fit the labels, by Newton steps with targets drawn a little inwards."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.column_stack((odds, np.ones(len(odds)))), np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - target)), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


@dataclass
class CoTrained:
    """Two calibrated views; without views the constant log odds of what was labelled."""

    views: tuple[Logistic, Logistic] | None
    calibrations: tuple[tuple[float, float], ...] = ()
    constant: float = 0.0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, the metadata view and both."""
        if self.views is None:
            same = np.full(len(text), sigmoid(np.array(self.constant)))
            return same, same, same
        own = [a * view.odds(x) + b for view, x, (a, b) in zip(self.views, (text, meta), self.calibrations, strict=True)]
        return sigmoid(own[0]), sigmoid(own[1]), sigmoid((own[0] + own[1]) / 2)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = 4, sure: float = 0.95) -> CoTrained:
    """``label`` is 1, 0 or -1 for unlabelled; labelled rows with ``held`` only calibrate.

    A round's pseudo-labels are all unlabelled rows that a view puts beyond ``sure``; they
    are made anew each round, so early mistakes do not stay.
    """
    known = label >= 0
    learn, check, pool = known & ~held, known & held, ~known
    if len(set(label[learn])) < 2 or len(set(label[check])) < 2:
        learn = check = known
    if len(set(label[known])) < 2:
        return CoTrained(None, constant=0.0 if not known.any() else 40.0 if label[known][0] else -40.0)
    views = [Logistic.fit(x[learn], label[learn]) for x in (text, meta)]
    for _ in range(rounds):
        found = []
        for view, x in zip(views, (text, meta), strict=True):
            a, b = calibration(view.odds(x[check]), label[check])
            p = sigmoid(a * view.odds(x[pool]) + b)
            found.append((np.flatnonzero(pool)[(p >= sure) | (p <= 1 - sure)], (p >= sure)[(p >= sure) | (p <= 1 - sure)]))
        views = []
        for x, (rows, guess) in zip((text, meta), reversed(found), strict=True):  # each learns from the other's
            at = np.concatenate((np.flatnonzero(learn), rows))
            views.append(Logistic.fit(x[at], np.concatenate((label[learn], guess.astype(label.dtype)))))
    return CoTrained(tuple(views), tuple(calibration(v.odds(x[check]), label[check]) for v, x in zip(views, (text, meta), strict=True)))


def sample(docs: DataFrame, labels: DataFrame, most_labelled: int, most_unlabelled: int) -> DataFrame:
    """About so many labelled and unlabelled documents, chosen by a hash of the id, with ``label`` and ``held``."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << 30))
    quality = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("__id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    n_labels, n_docs = quality.count(), docs.count()
    of_label = (1 << 30) * min(1.0, most_labelled / max(1, n_labels))
    of_rest = (1 << 30) * min(1.0, most_unlabelled / max(1, n_docs))
    some = quality.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < of_label)  # about most_labelled rows, so it may go to every executor
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source").filter(F.col("doc_id").isNotNull())
    return (
        rows.join(F.broadcast(some), F.col("doc_id") == F.col("__id"), "left")
        .filter(F.col("label").isNotNull() | (place < of_rest))
        .select("text", "lang", "source", F.coalesce("label", F.lit(-1)).alias("label"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held"))
    )


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, most_unlabelled: int = 4000) -> CoTrained:
    """Fit on a bounded sample; ``labels`` has doc_id and quality (0 or 1).

    Rows without a label or an id are ignored; of several labels of a document the more
    frequent counts, good in a tie. Sampled documents' views, not texts, reach the driver.
    """

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [
                np.concatenate((text_view(t), meta_view(t, lang, source))).tobytes()
                for t, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True)
            ]
            yield pd.DataFrame({"x": both, "label": batch["label"], "held": batch["held"]})

    rows = sample(docs, labels, most_labelled, most_unlabelled).mapInPandas(views, "x binary, label int, held boolean").toPandas()
    if not len(rows):
        return CoTrained(None)
    rows = rows.sort_values(["label", "held", "x"])  # the fit does not depend on the tasks' order
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1)
    return co_train(x[:, :TEXT_SIZE], x[:, TEXT_SIZE:], rows["label"].to_numpy(np.int64), rows["held"].to_numpy(bool))


def quality_column(spark: SparkSession, model: CoTrained) -> Callable[..., Column]:
    """A function of (text, lang, source) that gives struct (text_score, meta_score, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source in batches:
            parts = [np.zeros((0, 3))]
            for k in range(0, len(text), 1000):
                own = list(zip(text[k : k + 1000], lang[k : k + 1000], source[k : k + 1000], strict=True))
                x = np.stack([text_view(t) for t, _, _ in own]), np.stack([meta_view(*row) for row in own])
                parts.append(np.column_stack(shared.value.scores(*x)))
            yield pd.DataFrame(np.concatenate(parts), columns=["text_score", "meta_score", "score"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep): probability of good quality of each document.

    Null texts, languages and sources count as empty; repeated rows and null ids get their
    scores; where nothing is labelled every score is one half and all is kept.
    """
    score = quality_column(docs.sparkSession, train(docs, labels))
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(doc_id, score("text", "lang", "source").alias("s"))
    return rows.select("doc_id", "s.text_score", "s.meta_score", "s.score", (F.col("s.score") >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score less than ``least``."""
    score = quality_column(docs.sparkSession, train(docs, labels))
    return docs.withColumn("__s", score("text", "lang", "source")).filter(F.col("__s.score") >= least).drop("__s")
