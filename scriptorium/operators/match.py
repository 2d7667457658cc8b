"""Which letters touch tracked programs; the master list; the fetch cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The master list is broadcast up to this many rows of some 100 bytes.
BROADCAST_ROWS = 100_000


def _small(master: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a count that stops at the limit; a shuffle join beyond it."""
    return F.broadcast(master) if master.limit(rows + 1).count() <= rows else master


def tracked_letters(lines: DataFrame, master: DataFrame, key: str = "doc_id", code: str = "number", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Letters with a code of the master list: a left semi join, each letter once."""
    codes = _small(master.select(F.col("code").alias(code)), rows)
    return lines.select(key, code).join(codes, code, "left_semi").select(key).distinct()


def tracked_codes(lines: DataFrame, master: DataFrame, key: str = "doc_id", code: str = "number", rows: int = BROADCAST_ROWS) -> DataFrame:
    """The tracked codes of each letter, sorted. Distinct pairs are found before letters
    are grouped, so a code that fills a letter costs one row."""
    codes = _small(master.select(F.col("code").alias(code)), rows)
    pairs = lines.select(key, code).join(codes, code, "left_semi").distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list(code)).alias("codes"))


def last_wins(rows: DataFrame, key: str, value: str, order: Column | str) -> DataFrame:
    """For each key the value of its last row."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def cache_misses(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs that the cache lacks, once each."""
    from ..functions.text import url_cache_key

    wanted = urls.select("url", url_cache_key(F.col("url")).alias("key")).filter("key IS NOT NULL").distinct()
    return wanted.join(cache.select("key"), "key", "left_anti").select("url", "key")
