"""Exact deduplication with streaming state.

A stream of fingerprints updates keyed state that lives on disk (RocksDB) and
never expires. For each digest the state retains the digest, the identifier of
the document to keep, and where its content lies (a file and the row there). Every hit
is then checked on its full bytes, which are fetched from there.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_files, at_places, filled, free_name, located, scratch_path, sized_join, squeezed, written

#: State on disk; no space taken in advance for each store, and what a batch changed
#: rather than whole files goes to the checkpoint.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code points, digest of the text without white space, content locator (file
    and the row's place there) and row_key, a hash of the locator, one row per row of
    ``docs``, which are files'."""
    text = filled("text")
    file, at = free_name(docs, "_file"), free_name(docs, "_at")
    return located(docs, file, at).select(
        F.col("doc_id").cast("long"),
        F.length(text).cast("long").alias("n_points"),
        F.sha2(squeezed(text), 256).alias("text_sha256"),
        F.col(file).alias("file"),
        F.col(at).alias("at"),
        F.xxhash64(file, at).alias("row_key"),
    )


def _call_of(own: DataFrame) -> str:
    """A name for the call that brings these fingerprints: a digest of the rows in any
    order, so that a repeat has the same."""
    sums = own.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), "doc_id", "n_points", "text_sha256").cast("decimal(38,0)")) for k in (1, 2)]).first()
    return "c" + "_".join(str(v or 0).replace("-", "m") for v in sums)


def _logged(own: DataFrame, log: str) -> DataFrame:
    """``own`` in the log, row_key hashing the call too: as an earlier
    attempt of the same call left them if that came to its end, else written in place of
    what it left."""
    spark, call = own.sparkSession, _call_of(own)
    folder = f"{log.rstrip('/')}/call={call}"
    rows = own.withColumn("row_key", F.xxhash64(F.lit(call), "file", "at"))
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _best() -> F.Column:
    """Ordered so that the greatest has most code points, then the smallest doc_id
    (null last), then the smallest row key."""
    return F.struct("n_points", F.bitwise_not("doc_id").alias("doc"), F.bitwise_not("row_key").alias("row"), "file", "at")


def update_state(spark: SparkSession, log: str, state: str, bytes_per_batch: int = 64 << 30) -> None:
    """Bring the state up to date with the fingerprint log and return.

    Partial aggregation before the shuffle means that a digest which holds a third
    of the rows sends one row per task. New files in the log are read on the next
    call; the state of earlier calls is kept.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(spark.read.parquet(log).schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(log)
        query = (
            rows.groupBy("text_sha256")
            .agg(F.max(_best()), F.count(F.lit(1)))
            .writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """text_sha256, keep_id, keep_row, keep_file, keep_at, group_size: the state as a table."""
    return spark.read.format("statestore").load(state).select(
        F.col("key.text_sha256"),
        F.bitwise_not("value.max.doc").alias("keep_id"),
        F.bitwise_not("value.max.row").alias("keep_row"),
        F.col("value.max.file").alias("keep_file"),
        F.col("value.max.at").alias("keep_at"),
        F.col("value.count").alias("group_size"),
    )


def _contents(rows: DataFrame) -> DataFrame:
    """``rows`` (with file and at) and bytes: the text without white space that lies there."""
    spark = rows.sparkSession
    # Names as they are, not as patterns.
    files = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", unquote(r["file"])) for r in rows.select("file").distinct().collect()]
    if not files:
        return rows.withColumn("bytes", F.lit(""))
    texts = at_places(spark.read.schema("text string").parquet(*files), rows, "inner", 250)
    return texts.select(squeezed(filled("text")).alias("bytes"), *rows.columns)


def _collided(hits: DataFrame) -> DataFrame:
    """Digests of which the bytes differ. hits: text_sha256, file, at. All bytes of a digest
    are equal just when the least equals the greatest; both are combined before the
    shuffle."""
    return _contents(hits).groupBy("text_sha256").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).filter("a <> b").select("text_sha256")


def exact_dedup(docs: DataFrame, log: str | None = None, state: str | None = None, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept,
    text_sha256, and the locator (file, at).

    Texts are equal when identical without white space; of equal texts the one with
    most code points stays, then the smallest doc_id. A null text counts as empty,
    and all empty texts are equal. A null doc_id loses ties against any other. Rows
    that repeat a document are copies of it: one of them stays. Other columns are
    ignored, whatever their names. No rows in, no rows out.

    ``docs`` that are not read from files as they are get written first, so that each row
    has a locator. ``log`` and ``state`` name folders to go on with; by default both are
    new ones in the shared folder. A call that failed is repeated with the same rows and
    folders, and takes up what it left; the same rows in any later call are that call again,
    and not counted twice. Rows of earlier calls come out with those of this
    one, and their files must still be there: the bytes of each document of this call that
    hits a digest are compared with those of the digest's other documents of this call and
    of the one that stays, wherever it lies.
    """
    spark = docs.sparkSession
    log, state = log or scratch_path(spark, "fingerprints"), state or scratch_path(spark, "dedup-state")
    own = _logged(written(fingerprints(as_files(docs, "doc_id", "text")), "fingerprints-new"), log)
    update_state(spark, log, state, bytes_per_batch)
    rows = spark.read.schema(own.schema).parquet(log).select(*own.columns)
    hits = written(read_state(spark, state).filter("group_size > 1"), "dedup-hits")
    decided = sized_join(rows.drop("n_points"), hits.drop("keep_file", "keep_at"), ["text_sha256"], "left", 140)
    one = F.col("group_size").isNull()
    decided = decided.select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row_key") == F.col("keep_row"))).alias("kept"),
        "text_sha256", "file", "at",
    )
    mine = sized_join(own.select("text_sha256", "file", "at"), hits.select("text_sha256", "keep_file", "keep_at"), ["text_sha256"], "inner", 250)
    mine = written(mine, "dedup-own-hits")
    held = mine.select("text_sha256", "file", "at").unionByName(mine.select("text_sha256", F.col("keep_file").alias("file"), F.col("keep_at").alias("at")).distinct()).distinct()
    collided = written(_collided(written(held, "dedup-held")), "dedup-collided")
    if collided.isEmpty():
        return decided
    return decided.join(collided, "text_sha256", "left_anti").unionByName(_by_bytes(rows.join(collided, "text_sha256", "left_semi")))


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The same decisions with the bytes themselves as key, for fingerprints whose digest
    two different texts share."""
    rows = written(_contents(written(rows, "dedup-unclear")), "dedup-bytes")
    best = rows.groupBy("bytes").agg(F.max(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, "bytes").select(
        "doc_id",
        F.bitwise_not("best.doc").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.bitwise_not("best.row")).alias("kept"),
        "text_sha256", "file", "at",
    )
