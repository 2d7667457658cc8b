import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, key string, cluster string, n int, q int, common int"


def brute(rows, clusters=ce.CLUSTERS, rounds=ce.ROUNDS, width=64, seed=2):
    """The same in Python's own integers, vector by vector."""
    kept = []
    for vec_id, e, *_ in rows:
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [max(min(math.floor(256 * float(np.float32(x))), ce.MOST), -ce.MOST) for x in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [q for _, q in order[:clusters]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((far(q, c), k) for k, c in enumerate(at))
    for _ in range(rounds):
        held = {}
        for _, q in kept:
            held.setdefault(near(q)[1], []).append(q)
        at = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else c for k, c in enumerate(at)]
    found = [(v, near(q)) for v, q in kept]
    own = Counter()
    for _, (d, k) in found:
        own[k] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return Counter((v, k, d, own[k], sum(own.values()), name[k]) for v, (d, k) in found)


def check(spark, rows, **more):
    df = spark.createDataFrame([(v, e, "x", "x", 1, 1, 1) for v, e in rows], SCHEMA).repartition(3)
    got, _ = ce.cluster_vectors(df, **more)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, width=more.get("dimensions", 64), **{k: v for k, v in more.items() if k == "clusters"})


def test_clusters_edges(spark):
    r = random.Random(5)
    some = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(70)]
    rows = [(k, v) for k, v in enumerate(some)]
    rows += [(100 + k, some[3]) for k in range(150)]  # a third and more are one vector
    rows += [(3, some[3]), (3, some[4]), (None, some[5]), (None, None), (900, None), (901, []), (902, some[0][:63]), (903, [*some[0], 0.0])]
    rows += [(904, [None, *some[0][1:]]), (905, [float("nan"), *some[0][1:]]), (906, [float("-inf"), *some[0][1:]]), (907, [-0.0] * 64), (908, [1e9] * 64)]
    check(spark, rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(k, [k / 4.0] * 64) for k in range(5)])
    check(spark, [(k, [0.5] * 64) for k in range(6)])  # all alike: one cluster, the others stay empty
    none, at = ce.cluster_vectors(spark.createDataFrame([(1, None, "", "", 1, 1, 1)], SCHEMA))
    assert none.count() == 0 and at.shape == (0, 64)


def test_other_sizes(spark):
    r = random.Random(6)
    check(spark, [(k, [r.uniform(-2, 2), r.uniform(-2, 2)]) for k in range(200)], clusters=7, dimensions=2)


def test_rare_vectors_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ce, "COMMON", 2)
    r = random.Random(7)
    some = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    check(spark, [(k, some[k % 9 if k % 3 else 0]) for k in range(60)], clusters=4)


def test_distances_are_exact_beyond_floating_point():
    x = np.array([[ce.MOST, -ce.MOST, 1], [3, 4, 5]], dtype=np.int64)
    c = np.array([[-ce.MOST, ce.MOST, 0], [3, 4, 6]], dtype=np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert ce.distances(x, c).tolist() == want and ce.distances(x[1:], c[1:]).tolist() == [[1]]


def test_sums_are_one_row_per_cluster_and_task(spark):
    df = spark.createDataFrame([([k % 5, 1], 3) for k in range(1000)], "q array<int>, n long").withColumn("key", F.lit(b"")).repartition(4)
    got = ce._sums(df, np.array([[0, 0], [4, 0]], dtype=np.int64))
    assert got == {0: (1800, [3 * 600, 1800]), 1: (1200, [3 * 1400, 1200])}
