"""Operators over pages: page_text(doc_id, page_no, raw_text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..profile import Profile


def header_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """Pages that carry the marker of budget tables."""
    return pages.filter(t.has_marker(F.col("raw_text"), profile.page_marker))


def narrative_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """All other pages."""
    return pages.filter(~t.has_marker(F.col("raw_text"), profile.page_marker))


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id, raw, readable: pages in order, joined by line feeds; readable has each line
    reversed. A letter's pages meet in one group, which its size bounds."""
    text = F.coalesce("raw_text", F.lit(""))
    page = F.struct("page_no", text.alias("raw"), t.reverse_lines(text).alias("readable"))
    grouped = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("p"))
    return grouped.select("doc_id", *[F.array_join(F.col(f"p.{c}"), "\n").alias(c) for c in ("raw", "readable")])


def first_page_with(pages: DataFrame, marker: str) -> DataFrame:
    """The first page of each letter whose readable text has the marker."""
    hits = pages.filter(t.reverse_lines(F.coalesce("raw_text", F.lit(""))).contains(marker))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))
    return hits.withColumn("_n", first).filter("_n = 1").drop("_n")
