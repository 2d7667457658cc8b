"""Pages as they arrive: a letter is held until its last page is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import pages
from ..profile import HEBREW, Profile
from ..sources.stage import ship

SCHEMA = "doc_id string, page_no int, n_pages int, raw_text string, arrived timestamp"
RELEASED = "doc_id string, page_no int, raw_text string, complete boolean"
STATE = "numbers array<int>, texts array<string>, n_pages int, last bigint, done boolean"
#: State on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def gathered(arriving: DataFrame, hold_s: int = 86400, late: str = "1 hour") -> DataFrame:
    """The pages of each letter, released together: doc_id, page_no, raw_text, complete.

    A letter is complete when as many different pages are there as n_pages says (the
    largest that came), in whatever order they come. One that gets no page for ``hold_s``
    seconds of arrival time is released as it is, with complete false, and forgotten; a
    page that comes later begins it anew. Of pages with one number the first to come
    counts. A complete letter is remembered for as long without its texts, and repeats of
    its pages release nothing. Pages that arrive more than ``late`` behind the newest are
    dropped by the watermark, and so are rows without doc_id, page_no or arrival time.
    Without n_pages a letter ends by expiry only. State grows with the letters that are
    open, and what ended within the hold.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, n_pages, last, done = state.get if state.exists else ([], [], 0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield _pages(key[0], numbers, texts, False)
            return
        held = dict(zip(numbers, texts, strict=True))
        for rows in batches:
            last = max(last, int(rows["arrived"].max().timestamp() * 1000))
            if not done:
                n_pages = max([n_pages, *rows["n_pages"].dropna().astype(int)])
                for no, text in zip(rows["page_no"].astype(int), rows["raw_text"], strict=True):
                    held.setdefault(no, None if pd.isna(text) else text)
        ends = not done and 0 < n_pages <= len(held)
        numbers, texts = ([], []) if ends else (list(held), list(held.values()))
        state.update((numbers, texts, n_pages, last, done or ends))
        state.setTimeoutTimestamp(max(last + 1000 * hold_s, state.getCurrentWatermarkMs() + 1))
        if ends:
            yield _pages(key[0], list(held), list(held.values()), True)

    ship(arriving.sparkSession)
    rows = arriving.filter("doc_id is not null and page_no is not null and arrived is not null").withWatermark("arrived", late)
    return rows.groupBy("doc_id").applyInPandasWithState(step, RELEASED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _pages(doc_id: str, numbers: list[int], texts: list[str | None], complete: bool) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [doc_id] * len(numbers), "page_no": numbers, "raw_text": pd.Series(texts, dtype=object), "complete": [complete] * len(numbers)})


def letters_of(released: DataFrame, marker: str, profile: Profile) -> DataFrame:
    """A row per released letter, by the batch operators: doc_id, complete, raw, readable,
    header_pages (how many carry the table marker), first_page (the first with ``marker``)."""
    complete = released.groupBy("doc_id").agg(F.min("complete").alias("complete"))
    headers = pages.header_pages(released, profile).groupBy("doc_id").agg(F.count(F.lit(1)).alias("header_pages"))
    first = pages.first_page_with(released, marker).select("doc_id", F.col("page_no").alias("first_page"))
    rows = complete.join(pages.document_text(released), "doc_id").join(headers, "doc_id", "left").join(first, "doc_id", "left")
    return rows.withColumn("header_pages", F.coalesce("header_pages", F.lit(0)))


def stream_letters(spark: SparkSession, source: str, sink: str, checkpoint: str, marker: str, profile: Profile = HEBREW, files_per_batch: int = 1000, **hold) -> StreamingQuery:
    """Read pages (Parquet, SCHEMA) from a folder as they come and write each letter to
    ``sink`` when it is released. A batch has a folder of its own there and replaces what a
    failed attempt of it left, so a restart on the same checkpoint writes each letter once."""

    def write(released: DataFrame, batch: int) -> None:
        released = released.persist()
        try:
            letters_of(released, marker, profile).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
        finally:
            released.unpersist()

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        return gathered(arriving, **hold).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
