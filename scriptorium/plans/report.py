"""Report-ready rows, an HTML renderer over them, and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.bidi import display_order
from ..sources.stage import kept


def letterhead_rows(text: DataFrame, letters: str) -> DataFrame:
    """doc_id, section, row_no, label, value: the first lines of each letter that have a
    letter. text: doc_id, readable."""
    lines = text.select("doc_id", F.posexplode(t.letterhead(F.col("readable"), letters)).alias("row_no", "value"))
    return lines.select("doc_id", F.lit("letterhead").alias("section"), "row_no", F.lit("").alias("label"), "value")


def report_rows(fields: DataFrame, lines: DataFrame, history: DataFrame | None = None, head: DataFrame | None = None) -> DataFrame:
    """doc_id, section, row_no, label, value: the letterhead (as of letterhead_rows), the
    fields, the budget lines with their columns from right to left, then the history, of
    which row 0 holds the headings."""
    out = fields.select("doc_id", F.lit("field").alias("section"), F.col("field_no").alias("row_no"), F.col("field").alias("label"), "value")
    money = [t.format_thousands(F.col(c)) for c in ("delta", "to", "from")]
    out = out.unionByName(lines.select("doc_id", F.lit("budget").alias("section"), F.col("line_no").alias("row_no"), F.col("number").alias("label"), F.concat_ws(" | ", "name", *money).alias("value")))
    if history is not None:
        # The first cell of each column brings its heading along, as a cell of row 0.
        first = F.row_number().over(W.partitionBy("doc_id", "col_no").orderBy("row_no")) == 1
        cell = lambda row, value: F.struct(row.cast("int").alias("row_no"), "col_no", value.alias("value"))
        own, heading = cell(F.col("row_no"), F.col("value")), cell(F.lit(0), F.col("header"))
        history = history.withColumn("_first", first).select("doc_id", F.inline(F.when(F.col("_first"), F.array(heading, own)).otherwise(F.array(own))))
        cells = F.struct((-F.col("col_no")).alias("at"), "value")
        rows = history.groupBy("doc_id", "row_no").agg(F.sort_array(F.collect_list(cells)).alias("c"))
        rows = rows.withColumn("label", F.element_at("c", -1)["value"])
        rows = rows.select("doc_id", F.lit("history").alias("section"), "row_no", "label", F.array_join(F.transform("c", lambda x: x["value"]), " | ").alias("value"))
        out = out.unionByName(rows)
    return out if head is None else head.unionByName(out)


def _page(body: Column, visual: bool) -> Column:
    """A table as a page. ``visual``: its texts are in display order already."""
    head = '<html dir="ltr" style="unicode-bidi: bidi-override"><body><table>' if visual else '<html dir="auto"><body><table>'
    return F.concat(F.lit(head + "\n"), body, F.lit("\n</table></body></html>"))


def render_html(rows: DataFrame, names: DataFrame, method: str = "parse", visual: bool = False) -> DataFrame:
    """doc_id, file, html: one page per letter. names: doc_id, slug; files are named by
    slug and doc_id, as slugs may repeat. ``visual`` puts every text into display order, for
    readers that don't arrange right-to-left text themselves."""
    if visual:
        rows = rows.withColumns({c: display_order(F.col(c)) for c in ("label", "value")})
    order = F.array_position(F.array(*map(F.lit, ("letterhead", "field", "budget", "history"))), F.col("section"))
    line = F.concat(F.lit("<tr><th>"), t.escape_lines(F.col("label")), F.lit("</th><td>"), t.escape_lines(F.col("value")), F.lit("</td></tr>"))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "row_no", line.alias("line")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    html = _page(body, visual)
    file = F.concat("slug", F.lit("_"), F.col("doc_id").cast("string"), F.lit(f"_summary_{method}.html"))
    return grouped.join(names, "doc_id").select("doc_id", file.alias("file"), html.alias("html"))


def outbox(files: DataFrame, recipients: list[str], subject: str) -> DataFrame:
    """A message per recipient with the number of its attachments (which ``attachments``
    lists); none without any. Sending is left to whoever reads the table."""
    counted = files.agg(F.count(F.lit(1)).alias("attachments")).filter("attachments > 0")
    return counted.select(F.explode(F.array(*map(F.lit, recipients))).alias("recipient"), F.lit(subject).alias("subject"), "attachments")


def attachments(files: DataFrame, recipients: list[str]) -> DataFrame:
    """recipient, file: what goes with each message, a row per file."""
    return files.select(F.explode(F.array(*map(F.lit, recipients))).alias("recipient"), "file")


def comparison_rows(comparison: DataFrame) -> DataFrame:
    """doc_id, label, value, matched: a row per field with both values from right to left,
    and the tally under an empty label. The comparison is written once for both."""
    from ..operators.compare import match_tally

    comparison = kept(comparison, "comparison")
    rows = comparison.select("doc_id", F.col("field").alias("label"), F.concat_ws(" | ", "llm", "parse").alias("value"), "matched")
    tally = match_tally(comparison).select("doc_id", F.lit("").alias("label"), F.concat_ws(" of ", F.col("matched").cast("string"), F.col("fields").cast("string")).alias("value"), (F.col("matched") == F.col("fields")).alias("matched"))
    return rows.unionByName(tally)


def render_comparison(comparison: DataFrame, names: DataFrame, visual: bool = False) -> DataFrame:
    """doc_id, file, html of each letter's comparison; ``visual`` as for summaries."""
    shown = comparison_rows(comparison)
    if visual:
        shown = shown.withColumns({c: display_order(F.col(c)) for c in ("label", "value")})
    mark = F.when(F.col("matched"), F.lit("&#10003;")).otherwise(F.lit("&#10007;"))
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), cell(mark), cell(t.escape_lines(F.col("value"))), cell(t.escape_lines(F.col("label"))), F.lit("</tr>"))
    rows = shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((F.col("label") == "").alias("last"), "label", line.alias("line")))).alias("r"))
    html = _page(F.array_join(F.col("r.line"), "\n"), visual)
    return rows.join(names, "doc_id").select("doc_id", F.concat("slug", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_comparison.html")).alias("file"), html.alias("html"))


def mirrored(df: DataFrame) -> DataFrame:
    """The columns from right to left."""
    return df.select(*reversed(df.columns))
