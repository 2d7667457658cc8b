"""The batch over all letters as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import fields, match, model_fields, pages, tables
from ..profile import HEBREW, Profile
from ..sources import fetch, pdf
from ..sources.stage import kept
from .report import letterhead_rows, outbox, render_html, report_rows


@dataclass
class Batch:
    """What a run gives; lazy but for what is written once because several parts read it."""

    matched: DataFrame
    lines: DataFrame
    fields: DataFrame
    history: DataFrame
    report: DataFrame
    errors: DataFrame


def history_tables(page_text: DataFrame, cells: DataFrame, profile: Profile) -> DataFrame:
    """Cells of the first table of the first page that carries the history marker and has
    a table."""
    with_tables = cells.select("doc_id", "page_no").distinct()
    page = pages.first_page_with(page_text.join(with_tables, ["doc_id", "page_no"], "left_semi"), profile.history_marker)
    own = cells.join(page.select("doc_id", "page_no"), ["doc_id", "page_no"])
    first = own.groupBy("doc_id").agg(F.min("table_no").alias("table_no"))
    return own.join(first, ["doc_id", "table_no"])


def run_letters(page_text: DataFrame, cells: DataFrame, master: DataFrame, profile: Profile = HEBREW, method: str = "parse", client: model_fields.Client | None = None, answers: str | None = None) -> Batch:
    """Letters that touch the master list, with fields, lines, history and report rows.

    page_text: doc_id, page_no, raw_text; cells: doc_id, page_no, table_no, row_no, col_no,
    text; master: code, name. Narrative is read of matched letters only.
    """
    if method not in ("parse", "llm"):
        raise ValueError(f"unknown method {method!r}")
    marked = pages.header_pages(page_text, profile).select("doc_id", "page_no")
    lines, errors = tables.budget_lines(cells.join(marked, ["doc_id", "page_no"], "left_semi").select("doc_id", "table_no", "row_no", "col_no", "text"), profile)
    lines = kept(lines, "letter-lines")
    matched = kept(match.tracked_codes(lines, master), "letters-matched")
    text = pages.document_text(page_text.join(matched.select("doc_id"), "doc_id", "left_semi"))
    failed = []
    if method == "parse":
        found = fields.fields_long(fields.request_fields(text, profile), profile)
    else:
        found, more = model_fields.model_fields(text, profile, client, answers)
        found, failed = fields.with_links(found, text, profile), [more]
    own = lambda df: df.join(matched.select("doc_id"), "doc_id", "left_semi")
    history = tables.history_cells(own(history_tables(page_text, cells, profile)))
    report = report_rows(found, own(lines), history, letterhead_rows(text, profile.letters))
    return Batch(matched, own(lines), found, history, report, reduce(DataFrame.unionByName, failed, errors))


def slugs(letters: DataFrame) -> DataFrame:
    """doc_id, slug from doc_id, url."""
    return letters.select("doc_id", t.url_slug(F.col("url")).alias("slug"))


def run_batch(urls: DataFrame, master: DataFrame, cache_path: str, recipients: list[str], subject: str, profile: Profile = HEBREW, opener=fetch.get, parser: pdf.Parser = pdf.parse_pdf, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From URLs (url) to (files, messages, errors): letters are fetched into the cache,
    scanned, matched, summed up and rendered. files: doc_id, file, html; messages: the
    outbox; errors: doc_id, stage, message of every stage. A letter's doc_id is its key in
    the cache; ``more`` goes to run_letters and, as fetch_options, to fetch_missing."""
    options = more.pop("fetch_options", {})
    doc_id = t.url_cache_key(F.col("url")).alias("doc_id")
    failed = fetch.fetch_missing(urls, cache_path, opener, **options).select(doc_id, "stage", "message")
    scanned = kept(pdf.scan(fetch.cached(urls, cache_path).select(doc_id, "content"), parser), "letters-scanned")
    text, cells = kept(pdf.page_text(scanned), "letters-text"), kept(pdf.cells(scanned), "letters-cells")
    batch = run_letters(text, cells, master, profile, **more)
    names = slugs(urls.select(doc_id, "url").dropDuplicates(["doc_id"]))
    files = kept(render_html(batch.report, names, more.get("method", "parse")), "letters-rendered")
    return files, outbox(files, recipients, subject), reduce(DataFrame.unionByName, [failed, pdf.errors(scanned), batch.errors])
