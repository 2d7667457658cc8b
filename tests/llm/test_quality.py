import random
import zlib

import numpy as np
import pytest

from scriptorium.llm import quality as ql
from scriptorium.llm import queries


@pytest.fixture(scope="module")
def model():
    """Learned from an exclusive or of two features, which only a pair can tell."""
    r = np.random.default_rng(4)
    x = r.random((1500, len(ql.NAMES))).astype(np.float32)
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.4)).astype(float)
    return ql.fit(x, y), x, y


def test_pairs_learn_what_single_features_cannot(model):
    full, x, y = model
    assert (2, 5) in full.pairs
    alone = ql.fit(x, y, pairs=0)
    right = lambda m: ((m.score(x) >= 0.5) == (y == 1)).mean()
    assert right(full) > 0.93 > 0.85 > right(alone)


def test_score_is_the_sum_of_lookups(model):
    """Bin by bin in plain Python."""
    full, x, _ = model
    for row, got in zip(x[:200], full.score(x[:200]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, full.edges, strict=True)]
        z = full.constant + sum(t[b] for t, b in zip(full.mains, bins, strict=True))
        z += sum(t[full.coarse[a][bins[a]]][full.coarse[b][bins[b]]] for (a, b), t in full.pairs.items())
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_trees_find_the_best_cut():
    r = random.Random(9)
    g = np.array([r.uniform(-1, 1) for _ in range(12)])
    h = np.array([r.uniform(0.1, 1) for _ in range(12)])
    own = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ql.L2)
    best = max(own(0, k) + own(k, 12) for k in range(1, 12))
    values = ql.line_tree(g, h, leaves=2)
    (cut,) = np.flatnonzero(np.diff(values)) + 1
    assert own(0, cut) + own(cut, 12) == pytest.approx(best)
    g2, h2 = np.array([r.uniform(-1, 1) for _ in range(30)]).reshape(5, 6), np.full((5, 6), 0.5)
    part = lambda a, b: g2[a, b].sum() ** 2 / (h2[a, b].sum() + ql.L2)
    sides = lambda k: (slice(0, k), slice(k, None))
    whole = part(slice(None), slice(None))
    gains = {(i, j): sum(part(a, b) for a in sides(i) for b in sides(j)) - whole for i in range(1, 5) for j in range(1, 6)}
    got, table = ql.plane_tree(g2, h2)
    assert got == pytest.approx(max(gains.values())) and len(np.unique(table)) <= 4


def test_features():
    f = dict(zip(ql.NAMES, ql.features("Ab ab ab ab.\nx1 é $$$\nx1 é $$$\n".encode()).tolist(), strict=True))
    assert f["words"] == pytest.approx(np.log1p(10)) and f["distinct"] == pytest.approx(0.6) and f["repeated_lines"] == pytest.approx(1 / 3)
    assert f["commonest"] == pytest.approx(0.2) and f["end_symbols"] == pytest.approx(0.2) and f["capitals"] == pytest.approx(0.1)
    assert not ql.features(None).any() and not ql.features(b" \n\t").any()


def test_edges_and_few_labels(spark, edges, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 0, 0), (None, 1, 1), (7, None, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = ql.quality(edges, known).collect()
        assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert ql.quality(nothing, labels).count() == 0


def test_held_out_labels_are_not_learned_from(spark, edges):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "## $$ ##") for i in range(200)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(200)]
    lied = [(i, 1 - q if i in held else q) for i, q in labels]
    a, b = ({r["doc_id"]: r["score"] for r in ql.quality(docs, spark.createDataFrame(v, "doc_id long, quality int")).collect()} for v in (labels, lied))
    assert a == b and all((s > 0.5) == (i % 2 == 1) for i, s in a.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op12_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
    assert len(rows) > 50 and np.mean([r["predicted"] == known[r["doc_id"]] for r in rows]) > 0.95
