"""Merkle manifest of a dataset.

Leaves stand in order within trees. Fixed-size blocks of them become arrays, and a block's
levels are collapsed in place by sequence, transform, slice and aggregate; then the same is
done with the blocks' roots, until each tree has one node. On the way back each block
hands its members the siblings on their way up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, written

#: Nodes that become one.
FAN = 8
#: Levels within a block, which thus has up to FAN ** BLOCK_LEVELS members.
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon, the value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (of the lang, in its order), doc_id, node (the leaf) and tampered (the leaf if the
    text had been changed, null for rows that nobody tampers with)."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long"),
        leaf_of(F.col("text")).alias("node"),
        F.when(chosen, leaf_of(F.translate("text", UPPER, LOWER))).alias("tampered"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Written ``rows`` with at, their place from 0 in their tree, and n, its rows. Rows are
    dealt by ranges of (tree, order), so that a tree with most of the rows lies in many
    tasks; only the sizes of the runs of a tree in a range are added up by tree."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "merkle-order")
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("tree", "part", "first", before.alias("before"), F.sum("n").over(tree).alias("n")), "merkle-runs")
    return sized_join(placed, runs, ["tree", "part"], "inner", 80).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def _parents(nodes: Column) -> Column:
    """One digest for every FAN consecutive nodes, the last for what is left."""
    last = F.ceil(F.size(nodes) / FAN).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.sha2(F.array_join(F.slice(nodes, j * FAN + 1, FAN), ""), 256))


def _levels(nodes: Column, n: Column) -> Column:
    """The nodes and what becomes of them, level by level: up to the top of a tree of ``n``
    nodes, or of the block in a larger one."""
    depth = sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(BLOCK_LEVELS)), F.lit(0))
    steps = F.filter(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), lambda k: k <= depth)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))


def _way_up(levels: Column, at: Column) -> Column:
    """For each level below the block's top: the siblings before the ancestor of member
    ``at`` and those after it, joined."""

    def step(nodes: Column, k: Column) -> Column:
        own = F.call_function("shiftright", at, k * 3)
        nth = own % FAN
        return F.struct(F.array_join(F.slice(nodes, own - nth + 1, nth), "").alias("before"), F.array_join(F.slice(nodes, own + 2, FAN - 1 - nth), "").alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def blocks_of(items: DataFrame, *others: str) -> DataFrame:
    """tree, block, n, members (at, node and ``others``, in order) and levels; never more
    than BLOCK members."""
    held = items.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "node", *others))).alias("members"))
    return written(held.withColumn("levels", _levels(F.col("members.node"), F.col("n"))), "merkle-blocks")


def forest(items: DataFrame, *others: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, the leaves' first, and tree, node: the roots. Only the size of
    the largest tree comes to the driver."""
    rounds = []
    while True:
        blocks = blocks_of(items, *(others if not rounds else ()))
        rounds.append(blocks)
        items = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        if (items.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, items.select("tree", "node")


def proven(rounds: list[DataFrame], above: DataFrame, *others: str) -> DataFrame:
    """The members of the lowest round with path: the siblings on the way to the top.
    above: tree, path and further columns, which all members of the tree get."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(rounds))):
        held = sized_join(blocks, written(above, "merkle-paths"), ["tree", "block"], "inner", 6000)
        # members with their paths, one array a block: the levels are not copied for each.
        members = F.transform("members", lambda m, i: F.struct(m.alias("m"), _way_up(F.col("levels"), i).alias("own")))
        above = held.select("tree", F.explode(members).alias("x"), "path", *more)
        above = above.select("tree", F.col("x.m.at").alias("block"), F.concat("x.own", "path").alias("path"), *more, *([] if k else ["x.m.node", *(f"x.m.{c}" for c in others)]))
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]), 256))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its lang), root, proof_sha256,
    folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text, nulls marked as such.
    Leaves stand by doc_id, null first, rows of one doc_id by their leaf; repeated rows have
    equal leaves and a proof each. A null lang is a tree of its own, the first. A tree with
    one leaf has it as its root; a single lang's subroot is the root. Other columns are
    ignored, whatever their names. No rows in, no rows out.
    """
    own, root = ("doc_id", "tampered"), ("lang",)
    rounds, subroots = forest(ranked(written(leaves(docs), "merkle-leaves"), "doc_id", "node"), *own)
    langs = written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), "merkle-langs")
    tops, roots = forest(ranked(langs, "lang"), *root)
    start = roots.select("tree", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    above = proven(tops, start, *root).select(F.col("lang").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    rows = proven(rounds, above, *own)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"))
    return written(rows.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-proofs")
