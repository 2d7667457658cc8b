"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model also sees the probabilities of
the categories before it. For training these come from models fitted on other folds, so
that a later model learns from them what it will meet on new documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, written

#: Labelled documents that the chain is fitted on at most.
TRAINING_ROWS = 8000
#: Words and beginnings whose presence the models see.
VOCABULARY = 384
PREFIXES = (5, 7)
FOLDS = 4
MIN_DOCS = 5

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def distinct_words(text: str | None) -> set[bytes]:
    """Runs of letters, A-Z in lower case, of the whole text, and how longer ones begin:
    their first 5 and 7 bytes with a mark, which joins inflected forms."""
    words = set(_LETTERS.findall((text or "").encode().lower()))
    return words | {w[:n] + b"^" for w in words for n in PREFIXES if len(w) > n}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 12) -> np.ndarray:
    """Weights, the last one the constant's, by Newton steps; the constant is not held
    down. One class alone gives its (smoothed) odds as the constant."""
    w = np.zeros(x.shape[1] + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    held = np.full(len(w), l2)
    held[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (y - p) - held * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    """Categories in order; the k-th weights are for the words, then the log odds of the
    categories before, then the constant."""

    categories: tuple[str, ...]
    words: tuple[bytes, ...]
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(documents, categories) from (documents, words)."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            z = x @ w[: x.shape[1]] + odds(out) @ w[x.shape[1] : -1] + w[-1]
            out = np.hstack([out, sigmoid(z)[:, None]])
        return out


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str], words: Sequence[bytes]) -> Chain:
    """labels: (documents, categories), nan where unknown; folds: one number each."""
    chain, before = Chain(tuple(categories), tuple(words)), np.zeros((len(x), 0))
    for k in range(len(categories)):
        y, known = labels[:, k], ~np.isnan(labels[:, k])
        seen = np.hstack([x, odds(before)])
        chain.weights.append(logistic(seen[known], y[known]))
        if k + 1 < len(categories):
            p = np.zeros(len(x))
            for f in np.unique(folds):
                w = logistic(seen[known & (folds != f)], y[known & (folds != f)])
                p[folds == f] = sigmoid(seen[folds == f] @ w[:-1] + w[-1])
            before = np.hstack([before, p[:, None]])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int = TRAINING_ROWS, vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
    """Fit on at most ``rows`` labelled documents, those with the least hash of their
    doc_id. ``labels`` has doc_id and a column of 0, 1 or null for each category; of
    several labels for a document the greatest holds. The words with the largest
    differences between the classes of any category become the vocabulary. What comes to
    the driver is bounded by ``rows`` and ``vocabulary``.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    chosen = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(f"y{k}") for k, c in enumerate(categories)])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ys = [f"y{k}" for k in range(len(categories))]
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(written(chosen, "chain-labels")), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            held = [[w.decode("latin-1") for w in sorted(distinct_words(t))] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(y) for y in ys), pa.array(held, pa.list_(pa.string()))], names=["doc_id", *ys, "words"])

    sample = written(sample.mapInArrow(words, "doc_id long, " + "".join(f"{y} double, " for y in ys) + "words array<string>"), "chain-sample")
    counts = sample.select(*ys, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col(y) == i, 1).otherwise(0)).alias(f"{y}_{i}") for y in ys for i in (0, 1)])
    totals = sample.agg(*[F.sum(F.when(F.col(y) == i, 1).otherwise(0)).alias(f"{y}_{i}") for y in ys for i in (0, 1)]).first()
    share = lambda y, i: F.col(f"{y}_{i}") / F.lit(float((totals[f"{y}_{i}"] or 0) + 1))
    # How far apart the classes are, in standard errors.
    gaps = [F.abs(share(y, 1) - share(y, 0)) / F.sqrt((F.col("n") + 1.0) * F.lit(1.0 / ((totals[f"{y}_0"] or 0) + (totals[f"{y}_1"] or 0) + 1) / ((totals[f"{y}_1"] or 0) + 1))) for y in ys]
    top = counts.filter(F.col("n") >= MIN_DOCS).orderBy(F.desc(F.greatest(*gaps) if len(gaps) > 1 else gaps[0]), "word").limit(vocabulary)
    vocab = [r["word"] for r in top.select("word").collect()]
    place = {w: i for i, w in enumerate(vocab)}
    known = F.broadcast(spark.createDataFrame([(w, i) for w, i in place.items()] or [("", 0)], "word string, at int"))
    hits = sample.select("doc_id", *ys, F.explode_outer("words").alias("word")).join(known, "word", "left").groupBy("doc_id", *ys).agg(F.collect_set("at").alias("at"))
    got = sorted(hits.collect(), key=lambda r: r["doc_id"])
    x, y = np.zeros((len(got), len(vocab))), np.full((len(got), len(ys)), np.nan)
    for i, r in enumerate(got):
        x[i, [a for a in r["at"] if a < len(vocab)]] = 1
        y[i] = [np.nan if r[c] is None else r[c] for c in ys]
    fold = np.array([(r["doc_id"] * 2654435761 >> 7) % folds for r in got], dtype=int)
    return fit_chain(x, y, fold, categories, [w.encode("latin-1") for w in vocab])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability of each category, one row per row of ``docs``.

    A null or empty text has no words and gets the constants' odds. doc_id may be null
    or repeat; other columns are ignored.
    """
    ship(docs.sparkSession)
    place = {w: i for i, w in enumerate(chain.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            x = np.zeros((b.num_rows, len(place)))
            for i, t in enumerate(b.column("text")):
                x[i, [place[w] for w in distinct_words(t.as_py()) & place.keys()]] = 1
            p = chain.probabilities(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    rated = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories))
    return written(rated, "chain-scores")
