"""Two extractions of the same fields side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def field_comparison(parse: DataFrame, llm: DataFrame) -> DataFrame:
    """doc_id, field, parse, llm, matched from long fields. A field that one side lacks is
    empty there; two empty values do not match."""
    left = parse.select("doc_id", "field", F.col("value").alias("parse"))
    right = llm.select("doc_id", "field", F.col("value").alias("llm"))
    rows = left.join(right, ["doc_id", "field"], "full").fillna("", ["parse", "llm"])
    # Texts that are the same but for white space need no look at their numbers.
    rows = rows.withColumns({"_a": t.collapse_ws(F.col("parse")), "_b": t.collapse_ws(F.col("llm"))})
    same = F.when(F.col("_a") == F.col("_b"), True).otherwise(t.sorted_numbers(F.col("_a")) == t.sorted_numbers(F.col("_b")))
    return rows.withColumn("matched", (F.col("parse") != "") & same).drop("_a", "_b")


def match_tally(comparison: DataFrame) -> DataFrame:
    """doc_id, matched, fields."""
    return comparison.groupBy("doc_id").agg(F.count_if("matched").alias("matched"), F.count(F.lit(1)).alias("fields"))
