"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, filled, sized_join, words_of, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources stand in code point order, null last, and weigh ``weights`` in turn.
    They share the total by weight, none beyond ``cap`` times its size; what is cut
    off is shared again among the rest. In the order of size to weight, the first k
    sources are cut; for k with room left the rest gets weight * (total - cuts) /
    (weights left), and the least k for which nobody is above the cap holds.
    One row per source is sorted in one task; documents are not.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn))
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole, before = W.partitionBy(F.lit(1)), by_room.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("cut", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # the first source that, as the least roomy of the rest, stays within its cap
        .withColumn("fits", F.col("weight") * (F.col("total") - F.col("cut")) <= F.col("source_size") * cap * F.col("left"))
        .withColumn("rank", F.row_number().over(by_room))
    )
    rows = rows.withColumn("first", F.min(F.when(F.col("fits"), F.col("rank"))).over(whole))
    at = lambda c: F.max(F.when(F.col("rank") == F.col("first"), F.col(c))).over(whole)
    rows = rows.withColumn("rest", at("total") - at("cut")).withColumn("share", at("left"))
    capped = F.col("first").isNull() | (F.col("rank") < F.col("first"))
    target = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("share").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a document's draw depends on: its doc_id, or its text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends only on the seed and the key."""
    mixed = F.md5(F.concat(F.lit(seed + ":"), key))
    return F.conv(F.substring(mixed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _source() -> Column:
    """The source as a key that null can join by."""
    return F.struct(F.col("source").isNotNull().alias("has"), filled("source").alias("name"))


def _rated(docs: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target, _mix_copies."""
    size, key = F.size(words_of(filled("text"))).cast("long"), draw_key(F.col("doc_id"), filled("text"))
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select(_source().alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), rate.alias("_mix_rate"))
    rows = docs.withColumns({"_mix_size": size, "_mix_key": key, "_mix_source": _source()})
    rows = sized_join(rows, written(rates, "mix-rates"), ["_mix_source"], "inner", 200)
    whole = F.floor("_mix_rate")
    extra = (uniform(F.col("_mix_key"), seed) < F.col("_mix_rate") - whole).cast("long")
    return rows.withColumn("_mix_copies", whole + extra)


def mix_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` and size, source_size, target, copies.

    copies is floor(rate) plus one with the probability of the rate's fraction, where
    rate = target / source_size: one draw for each document, from a hash of the seed and
    its doc_id. So a source comes the nearer to its target the more documents it has; of
    sizes s and with the fraction f, its words spread by sqrt(f (1 - f) sum of s^2). A null
    text has size 0; sources without words have
    target 0 and no copies. A document with a null doc_id draws by its text. Rows of one
    doc_id draw alike. Columns of ``docs`` with the names added here are
    replaced. Empty input gives no rows.
    """
    new = ("size", "source_size", "target", "copies")
    rows = _rated(docs, weights, cap, seed)
    return rows.select(*columns_of(docs.drop(*new)), *[F.col(f"_mix_{c}").alias(c) for c in new])


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, with all their columns: each stands as often as it is
    taken. Nulls, repeated rows and empty input are as in ``mix_rates``."""
    rows = _rated(docs, weights, cap, seed).filter("_mix_copies > 0")
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*columns_of(docs))
