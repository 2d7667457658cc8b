"""Sharding with a k-d tree over document metadata.

Each node is split at a weighted median along its widest dimension. Medians come from
distributed histograms that are refined around the wanted share until they are sharp;
all nodes of a level are refined in the same jobs. A job finds each row's node from its
keys and the tree so far, which is two arrays of numbers, so nothing is joined or
rewritten between levels; the driver holds some numbers per node only.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filled, sized_join, written

OVERHEAD = 16
#: Bins of a dimension over the whole corpus, and of a node's bin when it is refined.
COARSE, FINE = 1024, 4096
#: Share of a shard's bytes by which a split may miss its goal before it is refined.
TOLERANCE = 0.0005
#: Keys: the place along the dimension in the upper bits, a hash below, so that ties of a
#: dimension can be cut anywhere.
HASH_BITS, PLACES = 31, (1 << 31) - 1
#: Lengths are told apart by this part of their natural logarithm.
LOG_STEPS = 4096
#: Rows that are numbered together.
ROWS_PER_RUN = 250_000


def with_ranks(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with _rank_NAME for each of ``names``: the place of the value among the
    distinct ones, in the order of whole strings; null lowest. The values are sorted in
    one task, one row per value."""
    for c in names:
        value = F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_value_{c}")
        ranks = docs.select(value).distinct().withColumn(f"_rank_{c}", F.row_number().over(W.orderBy(f"_value_{c}")).cast("long"))
        docs = sized_join(docs.select("*", value), written(ranks, "kd-ranks"), [f"_value_{c}"], "inner", 100).drop(f"_value_{c}")
    return docs


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions as whole numbers: the length, the source, the language, the
    doc_id. Missing columns are left out; null lies at or below every value of 0 or more.
    ``docs`` has passed with_ranks."""
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.length(filled("text")).cast("double")
    own = {"length": F.coalesce((F.log1p(F.greatest(n, F.lit(0.0))) * LOG_STEPS).cast("long"), F.lit(-1))}
    own |= {c: F.col(f"_rank_{c}") for c in ("source", "lang") if c in docs.columns}
    return own | {"doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))}


def tie_hash() -> Column:
    """What orders documents of one place: a hash of doc_id and text."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", filled("text")), 64 - HASH_BITS)


def key(raw: Column, tie: Column, lo: int, hi: int) -> Column:
    """The place of ``raw`` between ``lo`` and ``hi``, exact if there are fewer than 2^31,
    above the tie's hash."""
    place = raw - F.lit(lo) if hi - lo <= PLACES else ((raw.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(PLACES))).cast("long")
    return F.shiftleft(place, HASH_BITS) + tie


@dataclass
class Node:
    """A part of the corpus that takes the shards ``first`` to ``first + n - 1``; if it
    is split, the dimension and the key up to which its left side reaches."""

    first: int
    n: int
    dim: int = -1
    cut: int = 0


def _lookup(values: Mapping[int, float], at: Column, kind: str = "bigint") -> Column:
    """The value of node ``at``, null where it has none; one literal array by node."""
    text = json.dumps([values.get(k) for k in range(max(values, default=0) + 1)])
    return F.get(F.from_json(F.lit(text), f"array<{kind}>"), at.cast("int"))


def node_of(tree: Mapping[int, Node], keys: Column) -> Column:
    """The number of the tree's leaf for a row; 1 is the root, 2k and 2k + 1 are k's sides."""
    split = {k: x for k, x in tree.items() if x.dim >= 0}
    if not split:
        return F.lit(1).cast("long")
    dims, cuts = {k: x.dim for k, x in split.items()}, {k: x.cut for k, x in split.items()}

    def step(node: Column, _: Column) -> Column:
        dim = _lookup(dims, node)
        return F.when(dim.isNull(), node).otherwise(2 * node + (F.get(keys, dim.cast("int")) > _lookup(cuts, node)).cast("long"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(split).bit_length())), F.lit(1).cast("long"), step)


def _crossing(bins: DataFrame, by: list[str], goal: Column) -> DataFrame:
    """Per node the first bin where the sum of sizes reaches the goal: its size, the sum up
    to and with it, its least and greatest key; and the node's own edges. bins: node, bin,
    size, least, most; a node has at most COARSE or FINE of them, whatever its rows."""
    whole = W.partitionBy(*by)
    upto = bins.withColumns({"upto": F.sum("size").over(whole.orderBy("bin")), "total": F.sum("size").over(whole)}).withColumn("goal", goal)
    hit = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "size", "upto", "least", "most")))
    return upto.groupBy(*by).agg(hit.alias("b"), F.min("least").alias("lo"), F.max("most").alias("hi"), F.first("total").alias("total"), F.first("goal").alias("goal"))


def split_level(rows: DataFrame, tree: dict[int, Node], spans: list[int], tolerance: float) -> None:
    """Set dimension and cut of the level's nodes with several shards. rows: size, keys;
    spans: the last place of each dimension."""
    widths = [((span + 1 << HASH_BITS) - 1) // COARSE + 1 for span in spans]
    level = max(tree).bit_length()
    open_ = {k: x for k, x in tree.items() if x.n > 1 and k.bit_length() == level}
    rows = rows.select("size", "keys", node_of(tree, F.col("keys")).alias("node"))
    least_most = [F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("most")]
    share = _lookup({k: (x.n // 2) / x.n for k, x in open_.items()}, F.col("node"), "double")
    each = rows.filter(share.isNotNull()).select("size", "node", F.posexplode("keys").alias("dim", "key"))
    bins = each.groupBy("node", "dim", F.expr("key div " + "CASE dim " + " ".join(f"WHEN {d} THEN {w}L" for d, w in enumerate(widths)) + " END").alias("bin")).agg(*least_most)
    found: dict[int, list] = {}
    for r in _crossing(bins, ["node", "dim"], F.col("total") * share).collect():
        found.setdefault(r["node"], []).append(r)
    at: dict[int, dict] = {}
    for k, sides in found.items():
        # The widest: the places between the node's edges as a share of the corpus's.
        r = max(sides, key=lambda r: (((r["hi"] >> HASH_BITS) - (r["lo"] >> HASH_BITS)) / max(spans[r["dim"]], 1), -r["dim"]))
        at[k] = {"dim": r["dim"], "b": r["b"], "goal": r["goal"], "below": 0, "near": tolerance * r["total"] / open_[k].n}
    while at:
        for k, x in list(at.items()):
            b = x["b"]
            over, under = x["below"] + b["upto"] - x["goal"], x["goal"] - (x["below"] + b["upto"] - b["size"])
            if min(over, under) <= x["near"] or b["least"] == b["most"]:
                tree[k].dim, tree[k].cut = x["dim"], b["most"] if over <= under else b["least"] - 1
                del at[k]
            else:
                x["below"] += b["upto"] - b["size"]
        if not at:
            break
        # A bin of the chosen dimension is cut again between its least and greatest key.
        node = F.col("node")
        of = {n: _lookup({k: f(x) for k, x in at.items()}, node) for n, f in {"dim": lambda x: x["dim"], "lo": lambda x: x["b"]["least"], "hi": lambda x: x["b"]["most"], "width": lambda x: (x["b"]["most"] - x["b"]["least"]) // FINE + 1}.items()}
        inside = rows.select("size", "node", F.get("keys", of["dim"].cast("int")).alias("key")).filter((F.col("key") >= of["lo"]) & (F.col("key") <= of["hi"]))
        bins = inside.groupBy("node", F.call_function("div", F.col("key") - of["lo"], of["width"]).alias("bin")).agg(*least_most)
        goal = _lookup({k: x["goal"] - x["below"] for k, x in at.items()}, node, "double")
        for r in _crossing(bins, ["node"], goal).collect():
            at[r["node"]]["b"] = r["b"]


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per row of ``docs``.

    The size is the text's UTF-8 bytes (null: none) plus 16. Either the number of
    shards is given or their target bytes. A node of n shards gives n // 2 of them to
    its left side and splits there by bytes, so that all leaves get near the same; only
    a document larger than a shard can prevent that. Ties along a dimension are cut by a
    hash of the document; rows that repeat a document stay together, as do rows with null
    doc_id and equal text. A split may miss its goal by ``tolerance`` of a shard; with 0 it
    is at the exact weighted median. slot numbers a shard's rows from 0 without gaps, by
    doc_id within runs. Empty input gives no rows; other columns are ignored.
    """
    wanted = docs.select(*[c for c in ("doc_id", "text", "n_chars", "source", "lang") if c in docs.columns])
    docs = with_ranks(wanted, *[c for c in ("source", "lang") if c in docs.columns])
    dims = list(dimensions(docs).values())
    rows = docs.select("doc_id", (F.octet_length(filled("text")) + OVERHEAD).cast("long").alias("size"), F.crc32(filled("text").cast("binary")).alias("text_crc32"), F.array(*dims).alias("raw"), tie_hash().alias("tie"))
    rows = written(rows, "kd-rows")
    ends = rows.agg(F.sum("size").alias("size"), *[f(F.get("raw", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(len(dims)) for f in (F.min, F.max)]).first()
    edges = [(ends[f"min{d}"] or 0, ends[f"max{d}"] or 0) for d in range(len(dims))]
    rows = rows.select("doc_id", "size", "text_crc32", F.array(*[key(F.get("raw", F.lit(d)), F.col("tie"), lo, hi) for d, (lo, hi) in enumerate(edges)]).alias("keys"))
    spans = [min(hi - lo, PLACES) for lo, hi in edges]
    tree = {1: Node(0, n_shards or max(1, -(-(ends["size"] or 0) // target_bytes)))}
    while any(x.n > 1 and x.dim < 0 for x in tree.values()):
        split_level(rows, tree, spans, tolerance)
        for k, x in list(tree.items()):
            if x.dim >= 0 and 2 * k not in tree:
                tree[2 * k], tree[2 * k + 1] = Node(x.first, x.n // 2), Node(x.first + x.n // 2, x.n - x.n // 2)
            elif x.n > 1 and x.dim < 0:  # no rows came here
                x.n = 1
    shard = _lookup({k: x.first for k, x in tree.items()}, node_of(tree, F.col("keys")), "int")
    return numbered(written(rows.select("doc_id", "size", "text_crc32", shard.alias("shard")), "kd-shards"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, shard and others) with slot. A shard is cut into hash runs of a
    bounded number of rows; runs are numbered on their own and start where those before
    them end."""
    runs = max(1, -(-rows.count() // ROWS_PER_RUN))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32")) - 1
    rows = sized_join(rows.withColumn("within", within), starts.select("shard", "run", "start"), ["shard", "run"], "inner", 24)
    return rows.withColumn("slot", (F.col("start") + F.col("within")).cast("long")).drop("run", "start", "within")
