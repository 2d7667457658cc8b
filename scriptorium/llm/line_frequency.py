"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents that hold a
line are counted; lines above the host's limit are removed; documents of which too
little is left are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, WORD, filled, let, sized_join, squeezed, words_of, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is removed on hosts where more distinct documents hold it than both of these.
LIMIT_DOCS = 20
LIMIT_PERCENT = 2
#: A document is depleted with fewer words left, or fewer of a hundred.
LEFT_WORDS = 10
LEFT_PERCENT = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_line(line: Column) -> Column:
    """Letters A-Z in lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), f"[{WHITE_CLASS}]+", " "))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows are compared by 64-bit hashes within the document. Texts whose hashes all
    differ stop there; for the others the sorted hashes give the positions of repeated
    windows, and the gaps between these the words covered.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        at = lambda s, i: F.get(s, i)["x"]  # noqa: E731  null outside
        again = let(pairs, lambda s: F.filter(s, lambda e, i: F.coalesce(at(s, i - 1) == e["x"], F.lit(False)) | F.coalesce(at(s, i + 1) == e["x"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """The columns given and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lines (hash and words of each line with a word)."""
    text = filled("text")
    rows = docs.withColumn("words", words_of(text)).withColumn("n_words", F.size("words").cast("long"))
    spoken = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumns({
        "word_chars": F.length(squeezed(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "spoken": spoken,
        "n_repeat_words": repeated_words(F.col("words")),
    })
    rows = rows.withColumn("n_dup_lines", (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long"))
    rows = rows.withColumn("lines", F.transform("spoken", lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("h"), F.size(words_of(x)).alias("w"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("words", "spoken")


def frequent_lines(rows: DataFrame, limit_docs: int = LIMIT_DOCS, limit_percent: int = LIMIT_PERCENT) -> DataFrame:
    """host, h: hashes of lines that more distinct documents of the host hold than both
    limits allow. Documents of a host with equal texts count once, so copies alone make
    no line frequent."""
    distinct = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    distinct = written(distinct.select("host", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("hashes")), "line-hashes")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = distinct.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit_docs)
    return counts.join(hosts, "host").filter(100 * F.col("n") > limit_percent * F.col("host_docs")).select("host", "h")


def line_verdicts(docs: DataFrame, limit_docs: int = LIMIT_DOCS, limit_percent: int = LIMIT_PERCENT) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, removed_lines,
    removed_words, kept.

    The host is the ``source``; a null source is a host of its own. A null or empty
    text has no words and fails the base rules. A line is above the limits when more
    than ``limit_docs`` distinct texts of its host hold it, and more than
    ``limit_percent`` of a hundred of them. A document of which fewer than 10 words, or
    fewer than 20 of a hundred, remain is depleted. Rows that repeat a document are
    judged alike; doc_id may be null or repeat, as rows are told apart by a number given
    when they are first written. Other columns are ignored.
    """
    own = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"))
    rows = base_rules(own).withColumn("text_hash", F.xxhash64("text", F.length("text"))).drop("text")
    rows = written(rows.withColumn("row_key", F.monotonically_increasing_id()), "line-rows")
    frequent = written(frequent_lines(rows, limit_docs, limit_percent), "frequent-lines")
    lines = rows.select("row_key", "host", F.explode("lines").alias("line")).select("row_key", "host", "line.*")
    removed = sized_join(lines, frequent, ["host", "h"], "inner", 40)
    removed = written(removed.groupBy("row_key").agg(F.sum("w").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines")), "removed-lines")
    rows = sized_join(rows.drop("lines", "host", "text_hash"), removed, ["row_key"], "left", 32)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("removed_words", "removed_lines")})
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < LEFT_WORDS) | (100 * left < LEFT_PERCENT * F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row_key")


def cleaned(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with the text freed of its host's frequent lines (as given by
    ``frequent_lines``). Texts without such lines, null ones too, stay as they are."""
    hashed = lambda x: F.xxhash64(normalised_line(x))
    rows = docs.withColumn("host", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("row_hash", F.xxhash64("host", "text"))
    held = rows.select("host", "row_hash", F.explode(F.array_distinct(F.transform(F.split(filled("text"), "\n"), hashed))).alias("h"))
    held = sized_join(held, frequent, ["host", "h"], "inner", 40).groupBy("row_hash").agg(F.collect_set("h").alias("gone"))
    rows = sized_join(rows, written(held, "cleaned-lines"), ["row_hash"], "left", 200)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", hashed(x))), "\n")
    return rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


