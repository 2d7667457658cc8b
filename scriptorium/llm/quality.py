"""Quality of documents by a generalised additive model with pairwise interactions.

Every text becomes a few numbers; each number falls into a bin, and each bin (or pair of
coarser bins) has an addend. The tables are learned by boosting in cycles: one shallow tree
over one feature (or two) after the other, each adding a little to its table.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, written

#: Labelled documents that the tables are learned from at most.
TRAINING_ROWS = 20000
#: Documents whose crc32 is 0 by this modulus are held out.
HELD_OUT = 5
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 100, 30, 8
RATE, L2 = 0.15, 1.0

NAMES = (
    "words", "word_bytes", "longest", "distinct", "commonest", "repeated_pairs", "line_words", "repeated_lines", "letters", "capitals", "digits",
    "symbols", "points", "vowels", "entropy", "short", "end_points", "end_symbols", "capitalised", "no_letter", "bytes_beyond_ascii",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
_HIGH, _SYMBOL, _POINT, _END, _VOWEL, _WHITE = _mask(bytes(range(128, 256))), _mask(b"#*$%&|<>=@~^_{}[]\\/+"), _mask(b".,;:!?-'\"()"), _mask(b".!?"), _mask(b"aeiouAEIOU"), _mask(b" \t\n\r\x0b\x0c")
_LETTER = _UPPER + _LOWER + _HIGH


def features(text: bytes | None) -> np.ndarray:
    """Shares and sizes of the whole text, as in NAMES; zeros where there is no word."""
    data, out = text or b"", np.zeros(len(NAMES), dtype=np.float32)
    words = data.split()
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shown = counts.sum() - counts @ _WHITE
    letters = counts @ _LETTER
    sizes = np.fromiter(map(len, words), np.int64, n)
    firsts = np.bincount(np.frombuffer(bytes([w[0] for w in words]), np.uint8), minlength=256)
    lasts = np.bincount(np.frombuffer(bytes([w[-1] for w in words]), np.uint8), minlength=256)
    often = Counter(words)
    lines = [line for line in data.split(b"\n") if not line.isspace() and line]
    share = counts[counts > 0] / len(data)
    out[:] = (
        np.log1p(n), shown / n, np.log1p(sizes.max()), len(often) / n, max(often.values()) / n,
        1 - len(set(itertools.pairwise(words))) / (n - 1) if n > 1 else 0, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        letters / shown, (counts @ _UPPER) / max(counts @ (_UPPER + _LOWER), 1), (counts @ _DIGIT) / shown,
        (counts @ _SYMBOL) / shown, (counts @ _POINT) / shown, (counts @ _VOWEL) / max(letters, 1), -(share * np.log2(share)).sum(), (sizes <= 3).mean(),
        (lasts @ _END) / n, (lasts @ _SYMBOL) / n, (firsts @ _UPPER) / n, sum(k for w, k in often.items() if not w.isalpha() and not any(c >= 128 or chr(c).isalpha() for c in w)) / n, (counts @ _HIGH) / shown,
    )
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and f, the features, one row per row of ``docs``: texts are read once."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            f = [features(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.list_(pa.float32()))], names=["doc_id", "f"])

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f array<float>"), "quality-features")


@dataclass
class Additive:
    """An addend for each bin of each feature and for each pair of coarse bins of some
    pairs of features."""

    edges: list[np.ndarray]
    constant: float = 0.0
    mains: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.constant)
        for k, t in enumerate(self.mains):
            z += t[bins[:, k]]
        for (a, b), t in self.pairs.items():
            z += t[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return sigmoid(z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of ordered bins with sums of gradients and of curvatures: how much it
    gains, and the number of bins on its left."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a tree over one feature: the leaf that gains most is cut next."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(_cut(g[a:b], h[a:b]), (a, b)) for a, b in spans]
        (won, at), (a, b) = max(cuts, key=lambda c: c[0][0])
        if won <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over two features: one cut through each, so four leaves. Its gain over the
    single leaf, and its values by bins."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    quarters = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    gains = sum(gain(a, b) for a, b in zip(quarters(cg), quarters(ch), strict=True)) - gain(cg[-1, -1], ch[-1, -1])
    out = np.zeros(g.shape)
    if not gains.size or gains.max() <= 1e-9:
        return 0.0, out
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + L2)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Tables for features (rows, features) and labels 0 or 1. The tables of single
    features come first; then the pairs whose tree gains most on what these leave over. One
    class alone, or no row, gives its smoothed odds everywhere."""
    model = Additive([np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.constant = float(np.log(rate / (1 - rate)))
    sizes = [len(e) + 1 for e in model.edges]
    model.mains = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * min(COARSE, s) // s for s in sizes]
    if len(y) == 0 or y.min() == y.max():
        return model
    bins, z = model.bins(x), np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(z)
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, s in enumerate(sizes):
            g, h = slopes()
            step = RATE * line_tree(np.bincount(bins[:, k], g, s), np.bincount(bins[:, k], h, s))
            model.mains[k] += step
            z += step[bins[:, k]]
    cells = {(a, b): (model.coarse[a][bins[:, a]] * COARSE + model.coarse[b][bins[:, b]]) for a, b in itertools.combinations(range(len(sizes)), 2)}

    def plane(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        g, h = slopes()
        return plane_tree(*(np.bincount(cells[pair], v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h)))

    best = sorted(cells, key=lambda pair: (-plane(pair)[0], pair))[:pairs]
    model.pairs = {pair: np.zeros((COARSE, COARSE)) for pair in best}
    for _ in range(pair_rounds):
        for pair in best:
            step = RATE * plane(pair)[1]
            model.pairs[pair] += step
            z += step.ravel()[cells[pair]]
    return model


def held_out(modulus: int = HELD_OUT) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, modulus: int = HELD_OUT) -> Additive:
    """Tables from ``rows`` (doc_id, f) and ``labels`` (doc_id, quality): documents that are
    not held out, at most ``most`` of them, those whose doc_id hashes least. Of several
    labels the greatest holds, of several rows of a document the least."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), "quality")
    chosen = chosen.filter(~held_out(modulus)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "quality-labels")
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("f", "y")).alias("row"))
    got = sorted(sample.select("doc_id", "row.f", "row.y").collect(), key=lambda r: r["doc_id"])
    return fit(np.array([r["f"] for r in got], dtype=np.float32).reshape(-1, len(NAMES)), np.array([r["y"] for r in got]))


def rated(rows: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score from doc_id and f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return written(rows.mapInArrow(run, "doc_id long, score double"), "quality-scores")


def quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher where a label of 1 is likelier), one row per
    row of ``docs``.

    A null or empty text has no words and is scored as such. doc_id may be null (never held
    out) or repeat; without a label of each class all scores are the labels' smoothed odds.
    lang, source, doc_id and labels are no inputs of a score; other columns are ignored,
    whatever their names. No rows in, no rows out.
    """
    rows = featured(docs)
    return rated(rows, train(rows, labels, most)).select("doc_id", held_out().alias("held_out"), "score")
