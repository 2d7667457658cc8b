"""Paged report listing as a data source."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: One page: (url, body) -> list of objects.
Transport = Callable[[str, dict], list[dict]]


def post_json(url: str, body: dict) -> list[dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=30) as response:
        return json.loads(response.read())


def page_body(page: int) -> dict:
    """What the listing asks for."""
    return {"FromDate": None, "ToDate": None, "requestStatus": 2, "PageNumber": page}


class PagePartition(InputPartition):
    """A page, or of a stream its items from ``start`` up to ``end``."""

    def __init__(self, page: int | None, start: int = 0, end: int | None = None) -> None:
        super().__init__((page, start, end))
        self.page, self.start, self.end = page, start, end


def last_page(transport: Transport, url: str, known: int) -> tuple[int, int]:
    """The last page with items, from ``known`` on, and how many it has: found by steps that
    double, then by halving. (known, 0) if it has none."""
    sizes: dict[int, int] = {}

    def size(page: int) -> int:
        if page not in sizes:
            sizes[page] = len(transport(url, page_body(page)))
        return sizes[page]

    if not size(known):
        return known, 0
    low, step = known, 1
    while size(low + step):
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if size(middle) else (low, middle)
    return low, size(low)


def report_source(transport: Transport = post_json) -> type[DataSource]:
    """A data source "reports" with options url and pages. With a known number of pages
    each is a partition; otherwise one partition reads until a page is empty.

    As a stream its offset is a page and how many of its items are taken, so a batch is the
    same items whenever it is read. That holds for a listing to which items are added at
    the end; pages of a batch are partitions."""

    class Reader(DataSourceReader):
        def __init__(self, url: str, pages: int | None) -> None:
            self.url, self.pages = url, pages

        def partitions(self) -> list[InputPartition]:
            return [PagePartition(k) for k in range(1, self.pages + 1)] if self.pages else [PagePartition(None)]

        def read(self, partition: PagePartition) -> Iterator[tuple]:
            page = partition.page or 1
            while items := transport(self.url, page_body(page)):
                yield from ((page, item.get("ReportUrl")) for item in items)
                if partition.page:
                    return
                page += 1

    class Stream(DataSourceStreamReader):
        def __init__(self, url: str) -> None:
            self.url, self.page = url, 1

        def initialOffset(self) -> dict:
            return {"page": 1, "items": 0}

        def latestOffset(self) -> dict:
            page, items = last_page(transport, self.url, self.page)
            return {"page": page, "items": items}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.page = max(self.page, end["page"])
            first, last = start["page"], end["page"]
            parts = [PagePartition(k, start["items"] if k == first else 0, end["items"] if k == last else None) for k in range(first, last + 1)]
            return [p for p in parts if p.end is None or p.start < p.end]

        def read(self, partition: PagePartition) -> Iterator[tuple]:
            items = transport(self.url, page_body(partition.page))
            if len(items) < (partition.end or 0):
                raise ValueError(f"page {partition.page} of {self.url} has lost items")
            yield from ((partition.page, item.get("ReportUrl")) for item in items[partition.start : partition.end])

    class Reports(DataSource):
        @classmethod
        def name(cls) -> str:
            return "reports"

        def schema(self) -> str:
            return "page_number int, ReportUrl string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["url"], int(self.options["pages"]) if self.options.get("pages") else None)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options["url"])

    return Reports


def list_reports(spark: SparkSession, url: str, pages: int | None = None, transport: Transport = post_json) -> DataFrame:
    """page_number, ReportUrl."""
    spark.dataSource.register(report_source(transport))
    reader = spark.read.format("reports").option("url", url)
    return (reader.option("pages", pages) if pages else reader).load()


def stream_reports(spark: SparkSession, url: str, transport: Transport = post_json) -> DataFrame:
    """page_number, ReportUrl of reports as they are listed."""
    spark.dataSource.register(report_source(transport))
    return spark.readStream.format("reports").option("url", url).load()
