"""Parts of texts that occur more than once in a corpus, compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_places, filled, free_name, located, sized_join, written


def repeated_parts(docs: DataFrame, parts: Callable[[Column], Column]) -> DataFrame:
    """file, at, key, no and the other fields but body, of parts of texts (an array of
    struct(no, ..., body)) that occur more than once, byte by byte; ``first`` is the least
    (key, no) of those equal. ``docs`` are Parquet files as they are read.

    ``key`` is doc_id and a hash of the text, so that a null doc_id, or one with several
    texts, still tells documents apart. Bodies are hashed where they lie; those of hashes
    that repeat are fetched by their texts' places and compared. Nothing else moves a text."""
    file, at = free_name(docs, "_file"), free_name(docs, "_at")
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(filled("text")).alias("hash")).alias("key")

    def exploded(rows: DataFrame, file: str, at: str, array: Column) -> DataFrame:
        rows = rows.select(key, F.col(file).alias("file"), F.col(at).alias("at"), F.explode(array).alias("p"))
        return rows.select("key", "file", "at", "p.*").withColumn("h", F.unhex(F.md5("body")))

    marks = written(exploded(located(docs, file, at), file, at, parts(F.col("text"))).drop("body"), "part-marks")
    place = F.struct("key", "no")
    again = written(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "parts-again")
    hits = written(sized_join(marks, again, ["h"], "inner", 100), "part-hits")
    held = written(hits.groupBy(F.col("file").alias(file), F.col("at").alias(at)).agg(F.collect_set("no").alias("_nos")), "part-places")
    texts = at_places(docs, held, "inner", 300, file, at, ["doc_id", "text"])
    bodies = exploded(texts, file, at, F.filter(parts(F.col("text")), lambda p: F.array_contains("_nos", p["no"])))
    # All bodies of a hash are equal just when the least equals the greatest.
    compared = bodies.groupBy("h").agg((F.min("body") == F.max("body")).alias("equal"))
    unequal = written(compared.filter(~F.col("equal")).select("h"), "parts-unequal")
    if unequal.isEmpty():
        return hits
    own = bodies.join(unequal, "h", "left_semi")
    own = own.join(own.groupBy("h", "body").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), ["h", "body"])
    return hits.join(unequal, "h", "left_anti").unionByName(own.select(*hits.columns))
