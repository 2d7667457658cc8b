"""When to ask a model that takes so many tokens a minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import kept

#: Tokens a minute, and tokens for a hundred characters.
BUDGET, PER_HUNDRED = 30_000, 42


def tokens_of(prompt: Column) -> Column:
    """What a prompt is likely to cost, rounded up; 0 for null."""
    return F.floor((F.coalesce(F.length(prompt), F.lit(0)) * PER_HUNDRED + 99) / 100).cast("long")


def running_total(rows: DataFrame, amount: str, *order: str) -> DataFrame:
    """``rows`` with before: the sum of ``amount`` over all rows ahead in order, which should
    tell rows apart. Rows are dealt by ranges of the order; sums within a range are windows,
    and only the ranges' own sums are added up in one place."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt, "running-rows")
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(amount).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(kept(ranges, "running-ranges")), "_range").withColumn("before", F.col("_base") + F.col("_own")).drop("_range", "_base", "_own")


def minutes(queue: DataFrame, most: int, budget: int = BUDGET) -> DataFrame:
    """``queue`` (doc_id, attempt, tokens) with before and minute: first attempts come by
    doc_id, then second ones, and so on, so that what has to be asked again waits behind
    all that has not been asked. No minute has more than ``budget`` tokens, as long as no
    letter has more than ``most``. Each minute takes the letters that begin in a stretch of
    budget - most of all tokens in order."""
    if not 0 <= most < budget:
        raise ValueError("a letter may cost as much as a minute holds")
    return running_total(queue, "tokens", "attempt", "doc_id").withColumn("minute", F.floor(F.col("before") / (budget - most)).cast("long"))
