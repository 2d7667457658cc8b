"""Line deduplication with content-defined chunks of lines.

A rolling hash over the hashes of the last few lines decides where a chunk ends, so
an insertion moves boundaries only near itself. Chunks of several lines that occur
more than once in the corpus are compared byte by byte and removed but for the first,
and extended to the lines around them that are repeated, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_files, at_places, columns_of, filled, free_name, let, written
from .line_runs import pairs_of
from .repeats import repeated_parts

#: Factors of the hashes of this line and those before it, and a prime that their sum is
#: taken modulo, so that every bit of every line counts.
ROLL = (1, 31)
PRIME = 2147483647
#: A chunk ends where the rolling hash is a multiple of this and the line before's is not.
DIVISOR = 2
#: Lines with a word that make a chunk count as multi-line.
MIN_LINES = 2
#: Words of a run of repeated lines that goes without a repeated chunk in it.
RUN_WORDS = 30


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of struct(no, start, n_lines, multi, body): the chunks of a text, which joined by
    line feeds give the text back. A line that follows one whose rolling hash is a multiple
    ends no chunk, so that blocks of equal lines, whose hashes are equal too, are not cut
    at each line."""

    def ends(h: Column) -> Column:
        rolled = lambda i: sum((F.coalesce(F.get(h, i - j), F.lit(0)) * k for j, k in enumerate(ROLL)), F.lit(0))
        at = F.sequence(F.lit(0), F.size(h) - 1)
        marks = lambda m: F.filter(at, lambda i: (F.get(m, i) & ~F.coalesce(F.get(m, i - 1), F.lit(False))) | (i == F.size(h) - 1))
        return let(F.transform(at, lambda i: rolled(i) % PRIME % divisor == 0), marks)

    def cut(lines: Column, e: Column) -> Column:
        first = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        part = lambda x, k: F.slice(lines, first(k) + 1, x - first(k) + 1)
        return F.transform(e, lambda x, k: F.struct(k.alias("no"), first(k).alias("start"), (x - first(k) + 1).alias("n_lines"), (F.size(F.filter(part(x, k), lambda y: y.rlike(WORD))) >= MIN_LINES).alias("multi"), F.array_join(part(x, k), "\n").alias("body")))

    return let(F.split(filled(text), "\n"), lambda lines: let(F.transform(lines, line_hash), lambda h: let(ends(h), lambda e: cut(lines, e))))


def lines_to_remove(docs: DataFrame, divisor: int = DIVISOR, run_words: int = RUN_WORDS) -> DataFrame:
    """file, at, chunks (numbers of the repeated chunks), lines (numbers of all lines that
    go) for documents that lose some. ``docs`` are Parquet files as they are read."""
    multi = lambda text: F.filter(chunks_of(text, divisor), lambda c: c["multi"])
    kept = F.struct("key", "no") == F.col("first")
    chunks = written(repeated_parts(docs, multi).filter(~kept).select("file", "at", "no", "start", "n_lines"), "later-chunks")
    pairs = repeated_parts(docs, pairs_of).withColumn("kept", kept)
    words = lambda i: F.when(i == F.col("no"), F.col("words")).when(i == F.col("end"), F.col("more")).otherwise(0)
    covered = pairs.select("file", "at", F.explode(F.transform(F.sequence("no", "end"), lambda i: F.struct(i.alias("i"), words(i).alias("w")))).alias("x"), "kept", F.lit(False).alias("chunk"))
    covered = covered.unionByName(chunks.select("file", "at", F.explode(F.transform(F.sequence("start", F.col("start") + F.col("n_lines") - 1), lambda i: F.struct(i.alias("i"), F.lit(0).alias("w")))).alias("x"), F.lit(False).alias("kept"), F.lit(True).alias("chunk")))
    place = ["file", "at"]
    lines = covered.repartition(*place).groupBy(*place, F.col("x.i").alias("i")).agg(F.max("x.w").alias("w"), F.max("kept").alias("kept"), F.max("chunk").alias("chunk"))
    lines = lines.filter("chunk OR NOT kept").withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*place).orderBy("i")))
    runs = lines.groupBy(*place, "run").agg(F.collect_list("i").alias("lines"), F.sum("w").alias("w"), F.max("chunk").alias("chunk"))
    runs = runs.filter(F.col("chunk") | (F.col("w") >= run_words)).groupBy(*place).agg(F.flatten(F.collect_list("lines")).alias("lines"))
    return runs.join(chunks.groupBy(*place).agg(F.collect_set("no").alias("chunks")), place, "left").select(*place, "chunks", "lines")


def dedup_line_chunks(docs: DataFrame, divisor: int = DIVISOR, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the text freed of repeated chunks and what is repeated around them,
    and n_lines, n_chunks, removed_chunks, removed_lines.

    A chunk counts as multi-line with two or more lines that hold a word; shorter ones
    are never removed. Of equal chunks the one in the document with the smallest doc_id
    stays (null first), within a document the first.

    A chunk needs two ends within what two documents share, so repeated chunks are extended
    by an exact step: pairs of neighbouring lines with a word (blank lines between belong to
    them) are compared byte by byte at all offsets, and a line is repeated if a pair that it
    is in is, but for lines in the first place of any repeated pair. Repeated lines next to
    each other or to a chunk that goes are a run; a run goes if it holds such a chunk or
    ``run_words`` words, so that a few short lines (brackets, rules) stay. Of each line that
    goes an equal one stays, as chunks and pairs go only for such in an earlier place.

    Rows that repeat both doc_id and text are one document and lose the same lines. A null
    text stays null with one empty line; an empty text likewise. Columns of ``docs`` with
    these four names are replaced, all others stay, whatever their names. ``docs`` that are
    not read from Parquet files as they are get written first.
    """
    new = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    docs = as_files(docs)
    file, at, chunks, gone = (free_name(docs, c) for c in ("_file", "_at", "_chunks", "_gone"))
    decided = written(lines_to_remove(docs, divisor, run_words).toDF(file, at, chunks, gone), "chunks-gone")
    lines = F.split(filled("text"), "\n")
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"))
    return at_places(docs, decided, "left", 400, file, at).withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_chunks": F.size(chunks_of(F.col("text"), divisor)).cast("long"),
        "removed_chunks": F.coalesce(F.size(chunks), F.lit(0)).cast("long"),
        "removed_lines": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left),
    }).select(*[c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name not in new], *new)
