"""Where characters and ruling lines stand on the pages of PDF content.

A parser only tells what is drawn; text and tables are made of it by ``operators.layout``.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import layout
from .stage import ship

#: x0, x1, top, bottom
Box = tuple[float, float, float, float]
#: content -> pages of (pieces of text with their boxes, ruling lines)
Parser = Callable[[bytes], Iterator[tuple[Iterable[tuple[str, *Box]], Iterable[Box]]]]
_COLUMNS = ["doc_id", "page_no", "kind", "text", "x0", "x1", "top", "bottom", "error"]


def parse_pdf(content: bytes) -> Iterator[tuple[Iterable, Iterable]]:
    """Characters and the edges of lines and rectangles. Needs pdfplumber, which is
    optional."""
    import pdfplumber

    box = lambda x: (x["x0"], x["x1"], x["top"], x["bottom"])
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            yield ((c["text"], *box(c)) for c in page.chars), (box(e) for e in page.edges)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS doc_id", "content")


def scan(files: DataFrame, parser: Parser = parse_pdf, rows_at_once: int = 20000) -> DataFrame:
    """One parse for all that follows: doc_id, page_no, kind (page, piece or rule), text,
    x0, x1, top, bottom, error. A letter that can't be parsed is one row with an error; what
    was read of it before goes."""

    def drawn(doc_id, content) -> Iterator[tuple]:
        k = -1
        for k, (pieces, ruled) in enumerate(parser(content)):
            yield doc_id, k, "page", *[None] * 6
            for text, *box in pieces:
                yield doc_id, k, "piece", text, *map(float, box), None
            for box in ruled:
                yield doc_id, k, "rule", None, *map(float, box), None
        if k < 0:
            raise ValueError("no pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=_COLUMNS).astype({"page_no": "Int32"} | dict.fromkeys(("x0", "x1", "top", "bottom"), "float64"))
        held: list[tuple] = []
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    own = list(drawn(doc_id, bytes(content)))
                except Exception as e:  # quarantined below
                    own = [(doc_id, None, "error", None, None, None, None, None, str(e))]
                held += own
                if len(held) >= rows_at_once:
                    yield frame(held)
                    held = []
        yield frame(held)

    ship(files.sparkSession)
    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_no int, kind string, text string, x0 double, x1 double, top double, bottom double, error string")


def page_text(scanned: DataFrame) -> DataFrame:
    """doc_id, page_no, raw_text; null for a page without text."""
    return layout.page_text(scanned.filter("kind = 'piece'"), scanned.filter("kind = 'page'"))


def cells(scanned: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no (through the letter), row_no, col_no, text."""
    return layout.ruled_tables(scanned.filter("kind = 'piece'"), scanned.filter("kind = 'rule'"))


def errors(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error IS NOT NULL").selectExpr("doc_id", "'scan' AS stage", "error AS message")
