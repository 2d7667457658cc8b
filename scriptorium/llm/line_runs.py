"""Line deduplication by runs of lines that are repeated at any offset.

Every two neighbouring lines with a word are compared over the corpus, so a shared
passage is found wherever it starts, from two whole lines on. Longer runs follow from
pairs that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_files, at_places, columns_of, filled, free_name, let, words_of, written
from .repeats import repeated_parts


def pairs_of(text: Column) -> Column:
    """Array of struct(no, end, words, more, body): for each line with a word but the last
    such, its number, that of the next one with a word, the words of both, and all from one
    to the other."""

    def pairs(lines: Column, at: Column) -> Column:
        body = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")
        words = lambda i: F.size(words_of(F.get(lines, i)))
        following = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.transform(following, lambda b, k: let(F.get(at, k), lambda a: F.struct(a.alias("no"), b.alias("end"), words(a).alias("words"), words(b).alias("more"), body(a, b).alias("body"))))

    def worded(lines: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))

    return let(F.split(filled(text), "\n"), lambda lines: let(worded(lines), lambda at: pairs(lines, at)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """file, at, gone (numbers of lines to remove) for documents that lose some."""
    pairs = repeated_parts(docs, pairs_of).withColumn("kept", F.struct("key", "no") == F.col("first"))
    spans = pairs.groupBy("file", "at").agg(*[F.collect_set(F.when(F.col("kept") == kept, F.struct("no", "end"))).alias(name) for name, kept in (("later", False), ("stays", True))])
    numbers = lambda c: F.flatten(F.transform(c, lambda x: F.sequence(x["no"], x["end"])))
    gone = spans.select("file", "at", F.array_except(numbers("later"), numbers("stays")).alias("gone"))
    return gone.filter(F.size("gone") > 0)


def dedup_line_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the text freed of repeated runs of lines, and n_lines, removed_lines.

    A line goes if it lies in a pair of neighbouring lines with a word (blank ones
    between belong to it) that is repeated, byte by byte, and not in the first place of
    any repeated pair. So every repeated pair stays whole in its first place: the
    document with the smallest doc_id (null first), within a document the first. Rows
    that repeat both doc_id and text are one document. A null text stays null with one
    empty line. Columns of ``docs`` with these two names are replaced, all others
    stay, whatever their names. ``docs`` that are not read from Parquet files as they are
    get written first.
    """
    new = ["n_lines", "removed_lines"]
    docs = as_files(docs)
    file, at, gone = (free_name(docs, c) for c in ("_file", "_at", "_gone"))
    rows = at_places(docs, written(removed_lines(docs).toDF(file, at, gone), "runs-gone"), "left", 400, file, at)
    lines = F.split(filled("text"), "\n")
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    return rows.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "removed_lines": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left),
    }).select(*[c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name not in new], *new)
