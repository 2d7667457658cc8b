"""Clustering of vectors around centroids, over distinct vectors.

Quantised vectors are grouped with their multiplicities first; Lloyd's rounds run over the
distinct ones with weighted integer sums; then their assignments are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, sized_join, written

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
#: Components are held within this; beyond it squared distances would not fit 64 bits.
MOST = 1 << 27
#: A vector is common if more than one in so many rows has it: there are fewer of these.
COMMON = 2000


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.greatest(F.least(F.floor(F.lit(float(SCALE)) * x.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("int"))


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether it has just so many components, all of them finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dimensions) & finite, F.lit(False))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as exact integers: in floating point where no sum can lose a unit,
    in 64-bit integers beyond."""
    top = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, component sums), each distinct vector counting n times. Tasks send
    one row per cluster."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for b in batches:
            x, n = _matrix(b, width), b.column("n").to_numpy()
            near = distances(x, centroids).argmin(1)
            np.add.at(count, near, n)
            order = np.argsort(near, kind="stable")
            heads = np.flatnonzero(np.diff(near[order], prepend=-1))
            if len(heads):
                total[near[order][heads]] += np.add.reduceat((x * n[:, None])[order], heads)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, n long, sums array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    return {r["cluster"]: (r["n"], list(r["sums"])) for r in summed.collect()}


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over q, n. A centroid without vectors stays."""
    for _ in range(rounds):
        after = centroids.copy()
        for c, (n, sums) in _sums(distinct, centroids).items():
            after[c] = [s // n for s in sums]
        centroids = after
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, n, common, cluster, distance."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(_matrix(b, width), centroids)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("common"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["key", "n", "common", "cluster", "distance"])

    return written(distinct.mapInArrow(run, "key binary, n long, common boolean, cluster int, distance long"), "cluster-assigned")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """One row per usable row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256; and the centroids (at most ``clusters`` rows
    of integers, all that the driver holds).

    Rows whose embedding is null, has another length, or holds a null or non-finite
    component are left out. Components are floor(256 x), held within 2 ** 27. The
    centroids start as the vectors whose seed and vec_id hash least (a null vec_id hashes
    as an empty one; of rows with one vec_id the lesser vector first); fewer rows give
    fewer centroids, and one of two equal ones stays empty. Repeated rows are clustered
    once and all come out. Equal vectors are told by the SHA-256 of their components. Other
    columns are ignored, whatever their names. No usable rows, no rows out.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).filter(usable(F.col("embedding"), dimensions))
    rows = rows.select("vec_id", quantised(F.col("embedding")).alias("q"))
    rows = written(rows.withColumn("key", F.unhex(F.sha2(F.array_join("q", ","), 256))), "cluster-vectors")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "q").limit(clusters)
    centroids = np.array([r["q"] for r in first.select("q").collect()], dtype=np.int64).reshape(-1, dimensions)
    total = rows.count()
    distinct = rows.groupBy("key").agg(F.first("q").alias("q"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.withColumn("common", F.col("n") * COMMON > total), "cluster-distinct")
    centroids = lloyd(distinct, centroids, rounds)
    found = assigned(distinct, centroids)
    # Per cluster: at most ``clusters`` rows.
    wide = F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance").cast("decimal(20,0)"))
    sizes = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(wide.alias("inertia")).collect()}
    whole, most = sum(sizes.values()), (1 << 63) - 1
    named = [(c, min(v, most), min(whole, most), ",".join(map(str, centroids[c].tolist()))) for c, v in sizes.items()]
    named = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid string"))
    # Common vectors (fewer than COMMON) are broadcast, so no task gets all rows of one.
    ids = rows.select("vec_id", "key")
    common = found.filter("common").select("key", F.col("cluster").alias("c"), F.col("distance").alias("d"))
    ids = ids.join(F.broadcast(common), "key", "left")
    rare = written(found.filter("NOT common").drop("n", "common"), "cluster-rare")
    joined = ids.filter("c IS NOT NULL").select("vec_id", F.col("c").alias("cluster"), F.col("d").alias("distance"))
    joined = joined.unionByName(sized_join(ids.filter("c IS NULL").select("vec_id", "key"), rare, ["key"], "inner", 80).select("vec_id", "cluster", "distance"))
    out = joined.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return written(out, "cluster-rows"), centroids
