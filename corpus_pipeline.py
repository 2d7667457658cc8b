"""The corpus pipeline: stages in order, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import as_files, at_places, columns_of, file_numbers, free_name, numbered_rows, sized_join, table, written
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.jaccard_join import jaccard_classes
from scriptorium.llm.mixing import mixed
from scriptorium.llm.packing import pack
from scriptorium.llm.queries import TOXIC_AT, toxicity


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs``, which are files, but for the rows with the numbers ``dropped`` (one column)."""
    file, at, no = (free_name(docs, c) for c in ("_file", "_at", "_no"))
    row = F.col(dropped.columns[0])
    places = dropped.select(F.shiftright(row, 40).alias(no), row.bitwiseAND((1 << 40) - 1).alias(at)).join(file_numbers(docs, no, file), no)
    return at_places(docs, written(places.select(file, at), name), "left_anti", 200, file, at).select(*columns_of(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    docs = as_files(docs)
    row = free_name(docs, "_row")
    rows = numbered_rows(docs, row)
    rated = toxicity(docs, table(spark, sf_dir, "labels"), rows.select(F.col(row).alias("doc_id"), "text"))
    return _without(docs, rated.filter(F.col("p_toxic") >= TOXIC_AT).select("doc_id"), "dropped-toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one stays."""
    docs = as_files(docs)
    file, at = free_name(docs, "_file"), free_name(docs, "_at")
    dropped = exact_dedup(docs).filter(~F.col("kept")).select(F.col("file").alias(file), F.col("at").alias(at))
    return at_places(docs, written(dropped, "dropped-copies"), "left_anti", 200, file, at).select(*columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose five-word shingles link at 0.8 the one with the smallest doc_id (null
    last) stays, of several with that the first."""
    docs = as_files(docs)
    row = free_name(docs, "_row")
    rows = numbered_rows(docs, row)
    classes = jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"), n=5, num=80, den=100, row="doc_id")
    linked = written(classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_row"), "component_id"), "near-copies")
    members = written(linked.unionByName(linked.select(F.col("component_id").alias("_row"), "component_id").distinct()), "near-members")
    members = written(sized_join(rows.select(F.col(row).alias("_row"), "doc_id"), members, ["_row"], "inner", 24), "near-members")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row"))["_row"].alias("stays"))
    dropped = sized_join(members, written(best, "near-best"), ["component_id"], "inner", 24).filter("_row <> stays")
    return _without(docs, dropped.select("_row"), "dropped-near-copies")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their source's rate; null texts have no words,
    a null source is one of its own, rows without a doc_id draw by their text."""
    return mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null text is its end id alone."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack_tokens),
]

#: The classifier that the first stage trains, and the packing, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents, each stage's rows written before the next. An
    empty table gives no rows; columns of any other name go with their rows up to packing."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
