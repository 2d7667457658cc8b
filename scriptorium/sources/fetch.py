"""Fetching letters with a cache table."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_cache_key
from ..operators.match import cache_misses
from .stage import once, ship, waits

#: Buckets of the cache; fixed once a cache has entries.
BUCKETS = 64


def get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=30) as response:
        return response.read()


def tried(url: str, opener: Callable[[str], bytes] = get, attempts: int = 4, pause: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str | None]:
    """(content, None), or (None, what went wrong). Lost connections and timeouts are worth
    another attempt, after 1, 2 and 4 seconds; other faults are not."""
    faults: list[str] = []
    for seconds in waits(attempts):
        if seconds:
            pause(seconds)
        try:
            return opener(url), None
        except (urllib.error.URLError, TimeoutError) as fault:
            faults.append(repr(fault))
        except Exception as fault:  # one letter's failure is a row, not a failed job
            return None, str(fault)
    return None, f"{url}: {len(faults)} attempts, at last {faults[-1]}"


def answers(batches: Iterable[pd.DataFrame], opener: Callable[[str], bytes], attempts: int, pause: Callable[[float], None], bytes_at_once: int) -> Iterator[pd.DataFrame]:
    """key, url, content, error: a frame per batch, or more of at least ``bytes_at_once``
    each; one per letter would cost far more than to fetch it."""
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "url", "content", "error"], dtype=object)
    for batch in batches:
        held, size = [], 0
        for key, url in zip(batch["key"], batch["url"], strict=True):
            content, error = tried(url, opener, attempts, pause)
            held.append((key, url, content, error))
            size += len(content or b"")
            if size >= bytes_at_once:
                yield frame(held)
                held, size = [], 0
        yield frame(held)


def fetch(urls: DataFrame, opener: Callable[[str], bytes] = get, attempts: int = 4, pause: Callable[[float], None] = time.sleep, hosts: int = 64, lanes: int = 1, bytes_at_once: int = 32 << 20) -> DataFrame:
    """key, url, content, error for rows of key and url. URLs of one host go to at most
    ``lanes`` tasks, of ``hosts`` in all: this bounds what a host is asked at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answers(batches, opener, attempts, pause, bytes_at_once)

    ship(urls.sparkSession)
    dealt = urls.select("key", "url").repartition(hosts, F.try_parse_url("url", F.lit("HOST")), F.pmod(F.xxhash64("url"), F.lit(lanes)))
    return dealt.mapInPandas(run, "key string, url string, content binary, error string")


def _name(path: str) -> str:
    return "letters_cache_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    """key, url, content, added, run: the cache at ``path`` as a table bucketed by key, with
    the runs that it holds by now. Joins and groups by key move nothing of it."""
    name, folder = _name(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (key STRING, url STRING, content BINARY, added TIMESTAMP, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def add_to_cache(entries: DataFrame, path: str, run: str | None = None) -> None:
    """Add key, url, content as a run of its own: runs at the same time don't meet, and what
    one leaves unfinished is not in the way of others."""
    spark, run = entries.sparkSession, run or uuid.uuid4().hex
    name = f"{_name(path)}_{uuid.uuid4().hex}"
    entries = entries.select("key", "url", "content", F.current_timestamp().alias("added"))
    entries.repartition(BUCKETS, "key").write.format("parquet").bucketBy(BUCKETS, "key").sortBy("key").option("path", f"{path.rstrip('/')}/run={run}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay


def first_entries(cache: DataFrame) -> DataFrame:
    """key, url, content: for each key the entry that was added first, the same in every
    read, whatever later runs add. Told by key, time and run alone; contents stay where
    they lie."""
    first = cache.groupBy("key").agg(F.min(F.struct("added", "run")).alias("first"))
    # No entry is before the first; asked for as an equality, the run would become a key of
    # the join, and the cache be dealt anew.
    return cache.join(first, "key").filter(F.struct("added", "run") <= F.col("first")).select("key", "url", "content")


def fetch_missing(urls: DataFrame, cache_path: str, opener: Callable[[str], bytes] = get, **more) -> DataFrame:
    """Fetch what the cache at ``cache_path`` lacks, add it there, and give the errors.
    Entries never expire; URLs that are no http(s) are left out. Of two runs at a time each
    fetches what it misses; the first entry of a key counts."""
    cache = cache_table(urls.sparkSession, cache_path)
    got = once(fetch(cache_misses(urls, cache), opener, **more), cache_path)
    add_to_cache(got.filter("content IS NOT NULL"), cache_path)
    return got.filter("error IS NOT NULL").select("url", F.lit("fetch").alias("stage"), F.col("error").alias("message"))


def cached(urls: DataFrame, cache_path: str) -> DataFrame:
    """url, content of those in the cache, each URL once."""
    wanted = urls.select("url", url_cache_key(F.col("url")).alias("key")).distinct()
    return wanted.join(first_entries(cache_table(urls.sparkSession, cache_path)), "key").select(wanted["url"], "content")
