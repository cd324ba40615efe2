"""Operator 4: quality by Bradley-Terry ranking of pairs.

Learning. From a bounded sample of labelled rows (SAMPLE_ROWS, those of the smallest hash of doc_id outside the held-out fold) come
preference pairs: a document of label 1 against one of label 0, PAIRS of them. The score is linear in standardised features of the text,
and the logistic loss of each pair's score difference is minimised by gradient steps. The scores are then cut by quantile: the
cut is the quantile of the sample's scores that parts the labels best, and a logistic curve through the cut maps scores to 0 to 1 so that the
cut is THRESHOLD.

Features are shapes of a whole text: capitals, digits, signs, bars, line lengths, word lengths, repetition of words and of word pairs, and
how far it can be compressed.

Null and empty texts are scored as empty ones. Repeated rows are scored each. If the usable labels are all alike or missing, the score is 1
for label 1, 0 for label 0, and 0.5 without any; an empty table gives an empty result; other columns are kept, columns named as output
columns are replaced. A null label is no label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fold, table, texts_of
from .toxicity import labelled_sample

#: Bounds of what is learned from; steps; the score at the cut.
SAMPLE_ROWS, PAIRS, STEPS, THRESHOLD = 20_000, 60_000, 300, 0.3
FEATURES = ("capitals", "digits", "signs", "bars", "other", "lines", "line_length", "word_length", "long_words", "distinct_words", "distinct_pairs", "top_word", "squeezed", "log_words", "stops")

_KIND = np.full(256, 5, dtype=np.intp)  # of bytes: capital, small or beyond ASCII, digit, space, sign; bars and stops have their own
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 1 if _c >= 128 or _s.islower() else 0 if _s.isupper() else 2 if _s.isdigit() else 3 if _s.isspace() else 6 if _s == "|" else 7 if _s in ".,;:'\"-" else 4 if _s.isprintable() else 5


def features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode()
    n = max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=8)
    words = text.split()
    w = max(1, len(words))
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.count("\n") + 1
    letters = sum(map(len, words))
    return [
        kinds[0] / n, kinds[2] / n, kinds[4] / n, kinds[6] / n, kinds[5] / n, lines / w, np.log1p(n / lines), letters / w,
        sum(len(x) > 20 for x in words) / w, len(tally) / w, pairs / w, max(tally.values(), default=0) / w,
        len(zlib.compress(raw, 1)) / n, np.log1p(len(words)), kinds[7] / n,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores; features are held within five deviations."""
        return np.clip((x - self.mean) / self.scale, -5, 5) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + shift, -50, 50)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Ranker:
    """A ranker from features and labels (true: preferred)."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    ranker = Ranker(mean, scale, np.zeros(len(FEATURES)))
    if not len(x) or good.all() or not good.any():
        ranker.constant = 0.5 if not len(x) else float(good.all())
        return ranker
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -5, 5)
    d = z[rng.choice(np.nonzero(good)[0], PAIRS)] - z[rng.choice(np.nonzero(~good)[0], PAIRS)]
    w, m, v = ranker.weights, np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for t in range(1, STEPS + 1):  # Adam on the logistic loss of differences, with a small ridge
        g = -(d / (1 + np.exp(np.clip(d @ w, -50, 50)))[:, None]).mean(axis=0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    ranker.weights = w
    # The score quantile that parts the labels best, by balanced accuracy.
    s = ranker.raw(x)
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(~good[order]) / (~good).sum(), np.cumsum(good[order]) / good.sum()
    k = int(np.argmax(below_bad - below_good))
    ranker.cut = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    ranker.slope = float(4 / max(1e-6, s[good].mean() - s[~good].mean()))
    return ranker


def learn(labelled: DataFrame) -> Ranker:
    """A ranker from rows of text and quality; features of at most SAMPLE_ROWS rows come to the driver."""
    bounded_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    rows = labelled.where("quality is not null").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "quality int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # whatever order rows come in
    return fit(x[order], (rows["quality"].to_numpy() == 1)[order])


def score(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """docs with score."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*{"score"} - {text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.score(matrix(texts_of(batch, text))))], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def learned(docs: DataFrame, labels: DataFrame) -> Ranker:
    """The ranker of the labelled rows outside the held-out fold."""
    return learn(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, SAMPLE_ROWS))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
