"""Jaccard self-join of word n-gram sets with prefix filters under several token orders.

Two sets with a Jaccard similarity of t or more share a token among the first
n - ceil(t n) + 1 of either under any order of all tokens. The first order puts tokens
of a hashed part of the token space before all others and rare ones of them first; only
this part has to be counted over the corpus. Documents that share no token with another
then have no links and leave. The second order, among those that stay, takes all their
tokens, rare ones first; the positions of the first common token there also bound what a
pair can have in common. Pairs must share prefix tokens under the first two orders and
two more (by other hashes) before their whole sets are compared.

Equal sets form one class, whose first row stands for it. Links are looked for
where they can join components that are still apart: first between each document and
the most central document it shares a token with, then, where a token's documents still
lie in several components, between all of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free_name, numbered_rows, ship, sized_join, written

#: Sets below this size are compared over the whole token space instead.
SMALL = 64
#: Tokens of other documents that are compared with one document's at a time.
BLOCK = 250_000
#: Odd factors of the further orders' hashes, and of the n-gram hash.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its word n-grams. Hashes of words are kept
    up to ``most`` bytes of words."""

    def __init__(self, n: int, most: int = 1 << 19) -> None:
        self.n, self.most, self.held = n, most, 0
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know just A-Z and the six white-space characters.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if self.held > self.most:
            known.clear()
            self.held = 0
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
                self.held += len(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = _mixed(out * np.uint64(3) + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def prefix_size(n, num: int, den: int):
    """n - ceil(num / den * n) + 1."""
    return n - (num * n + den - 1) // den + 1


def _signatures(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """row, doc_id, n_shingles, digest, and for each mode the tokens that are counted and
    those that follow where the prefix reaches further."""
    shingles, share = Shingler(n), 2 * (1 - Fraction(num, den))
    edge = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))
    upper = SMALL * den // num
    none, longs = np.empty(0, dtype=np.int64), pa.list_(pa.int64())
    for batch in by_bytes(batches):
        out: dict[str, list] = {k: [] for k in ("n_shingles", "digest", "large", "beyond", "small")}
        for text in batch.column("text"):
            s = shingles(text.as_py())
            size = len(s)
            inside = int(np.searchsorted(s, edge))
            p = prefix_size(size, num, den) if size else 0
            signed = s.view(np.int64)
            out["n_shingles"].append(size)
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if size else None)
            large = size >= SMALL
            out["large"].append(signed[:inside] if large else none)
            out["beyond"].append(signed[inside:p] if large and p > inside else none)
            out["small"].append(signed if 0 < size <= upper else none)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(out["n_shingles"], pa.int64()), pa.array(out["digest"], pa.binary()), *(pa.array(out[k], longs) for k in ("large", "beyond", "small"))], names=["row", "doc_id", *out])


def _full_sets(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """doc, the whole set, and its prefixes under the further orders."""
    shingles, longs = Shingler(n), pa.list_(pa.int64())
    for batch in by_bytes(batches):
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        prefixes = [[np.sort(s * np.uint64(k))[: prefix_size(len(s), num, den)].view(np.int64) for s in sets] for k in ORDERS]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s.view(np.int64) for s in sets], longs), *(pa.array(p, longs) for p in prefixes)], names=["doc", "tokens", *(f"order{k}" for k in range(1, len(ORDERS) + 1))])


def _postings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """token, doc: prefixes under the first order, without counted tokens that just one
    document has. A document whose counted tokens are all its own, or which has none,
    still has those that follow."""
    counted = reps.filter("size(large) + size(beyond) > 0").select("doc", "n", F.lit(0).alias("mode"), F.col("large").alias("tokens"), "beyond")
    counted = counted.unionByName(reps.filter("size(small) > 0").select("doc", "n", F.lit(1).alias("mode"), F.col("small").alias("tokens"), F.expr("array()").cast("array<bigint>").alias("beyond")))
    # The lowest bit keeps the modes apart.
    token = F.col("token").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("mode"))
    each = counted.select("doc", "mode", F.explode("tokens").alias("token")).select("doc", "mode", token.alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(often, "token").groupBy("doc", "mode").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    rows = counted.select("doc", "mode", "n", F.size("tokens").alias("m"), "beyond").join(shared, ["doc", "mode"], "left")
    rows = rows.withColumn("shared", F.coalesce("shared", F.expr("array()").cast("array<struct<df:bigint,token:bigint>>")))
    p = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
    rows = rows.withColumn("left", (p - (F.col("m") - F.size("shared"))).cast("int")).filter("left > 0")
    own = F.transform(F.slice("shared", 1, F.col("left")), lambda x: x["token"])
    return rows.select("doc", F.explode(F.concat(own, "beyond")).alias("token"))


def _ranked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """token, doc, n, at, score: prefixes under the second order, where ``at`` is the
    token's position in the document's set; tokens that just one document has are counted
    but left out. The score is the share of tokens that other documents have too."""
    each = sets.select("doc", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(often, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    rows = shared.join(sets.select("doc", F.size("tokens").cast("long").alias("n")), "doc")
    rows = rows.withColumn("alone", F.col("n") - F.size("shared")).withColumn("left", F.expr(f"cast(n - ({num} * n + {den - 1}) div {den} + 1 - alone AS int)")).filter("left > 0")
    rows = rows.select("doc", "n", "alone", (F.size("shared") / F.col("n")).alias("score"), F.posexplode(F.slice("shared", 1, F.col("left"))).alias("k", "x"))
    return rows.select(F.col("x.token").alias("token"), "doc", "n", (F.col("alone") + F.col("k")).alias("at"), "score")


def _possible(num: int, den: int) -> str:
    """Whether sets of n and n2 tokens whose first common token stands at ``at`` and at2
    can have enough in common: (num + den) * common >= num * (n + n2)."""
    return f"{num + den} * least(n - at, n2 - at2) >= {num} * (n + n2)"


def connected(edges: DataFrame, label: DataFrame) -> DataFrame:
    """doc, comp: the smallest doc of each component; edges: a, b; label: doc and the comp
    to start from, at first the doc itself. Labels pass along edges and jump to their
    labels' labels until none changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    while True:
        seen = both.join(label.select(F.col("doc").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("least"))
        new = label.join(seen.withColumnRenamed("v", "doc"), "doc", "left").select("doc", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        new = written(new, "labels")
        jump = new.join(new.select(F.col("doc").alias("comp"), F.col("comp").alias("root")), "comp").select("doc", "old", F.least("comp", "root").alias("comp"))
        jump = written(jump, "labels")
        if jump.filter("comp <> old").isEmpty():
            return jump.select("doc", "comp")
        label = jump.select("doc", "comp")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that pass the further orders and then link. Pairs are dealt by a
    and block; the set of b travels once for each pair, that of a once for each block."""
    for k in range(len(ORDERS) + 1):
        at = sets.select(F.col("doc").alias("a"), F.col(f"order{k}").alias("pa"))
        bt = sets.select(F.col("doc").alias("b"), F.col(f"order{k}").alias("pb"), F.size("tokens").alias("n"))
        pairs = pairs.join(at, "a").join(bt, "b").filter(F.arrays_overlap("pa", "pb")).select("a", "b", *(["n"] if k == len(ORDERS) else []))
    pairs = written(pairs, "jaccard-pairs")
    blocks = pairs.groupBy("a").agg(F.floor((F.sum("n") - 1) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.col("b").alias("doc"), F.pmod(F.xxhash64("b"), F.col("blocks") + 1).cast("int").alias("block"))
    heads = blocks.select("a", F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("block"))
    dealt = written(dealt.unionByName(heads), "jaccard-dealt")
    rows = sized_join(sets.select("doc", "tokens"), dealt, ["doc"], "inner", 40)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf["a"].iloc[0]
        head = pdf["tokens"][pdf["doc"] == a].iloc[0].view(np.uint64)
        rest = pdf[pdf["doc"] != a]
        found = []
        for doc, raw in zip(rest["doc"], rest["tokens"], strict=True):
            other = raw.view(np.uint64)
            place = np.minimum(np.searchsorted(head, other), len(head) - 1)
            common = int((head[place] == other).sum())
            if den * common >= num * (len(head) + len(other) - common):
                found.append(doc)
        return pd.DataFrame({"a": np.full(len(found), a, dtype="int64"), "b": np.array(found, dtype="int64")})

    return rows.groupBy("a", "block").applyInPandas(link, "a long, b long")


def _headed(postings: DataFrame, head, possible: str) -> DataFrame:
    """Each posting with the most central one of its token, if the two can link."""
    heads = postings.groupBy("token").agg(F.max(head).alias("head"))
    rows = postings.join(heads, "token").filter(F.col("doc") != -F.col("head.minus"))
    return rows.withColumns({"n2": F.col("head.n2"), "at2": F.col("head.at2")}).filter(possible)


def _apart(postings: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings of tokens whose documents lie in several components."""
    rows = postings.join(comp, "doc")
    open_ = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return rows.join(open_, "token")


def _shared_ids(usable: DataFrame, copies: DataFrame) -> DataFrame:
    """a, b: classes that rows of one doc_id lie in, each with the least of them."""
    often = written(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"), "jaccard-repeated")
    rows = sized_join(usable.select("row", "doc_id"), often, ["doc_id"], "left_semi", 16)
    rows = rows.join(copies.select("row", "doc"), "row", "left").select("doc_id", F.coalesce("doc", "row").alias("b"))
    least = rows.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("most")).filter("a <> most")
    return written(rows.join(least, "doc_id").filter("a <> b").select("a", "b").distinct(), "jaccard-same-id")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Texts are lower-cased in A-Z and cut at white space; a document's set has the hashes
    of its runs of ``n`` words, or of the whole text if that is shorter. Two documents
    link if num/den of their sets' union is common to both; component_id is the smallest
    doc_id that links reach, the document's own included. A null text, or one without
    words, has no shingles and no links. Rows with null doc_id stand alone, with a null
    component_id. Rows of one doc_id are one document, which has the links of all their
    texts. ``row`` may name a column that numbers the rows; without it they are numbered by
    their place in their files. Other columns are ignored; empty input gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    place = row or free_name(docs, "_row")
    docs = docs if row else numbered_rows(docs, place)
    docs = docs.select(F.col(place).cast("long").alias("row"), F.col("doc_id").cast("long"), "text")
    schema = "row long, doc_id long, n_shingles long, digest binary, large array<long>, beyond array<long>, small array<long>"
    signed = written(docs.mapInArrow(lambda b: _signatures(b, n, num, den), schema), "jaccard-signatures")
    usable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets are one class; the least row number stands for it.
    classes = written(usable.groupBy("digest").agg(F.min("row").alias("doc"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "jaccard-classes")
    several = classes.filter("members > 1").select("digest", "doc", "least")
    copies = written(sized_join(usable.select("digest", "row"), several, ["digest"], "inner", 70).drop("digest"), "jaccard-copies")
    reps = sized_join(usable.select("row", F.col("n_shingles").alias("n"), "large", "beyond", "small"), copies.filter("row <> doc").select("row"), ["row"], "left_anti", 24)
    reps = reps.withColumnRenamed("row", "doc")
    first = written(_postings(reps, num, den), "jaccard-first")
    held = first.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    first = first.join(held, "token", "left_semi").groupBy("doc").agg(F.collect_set("token").alias("order0"))
    first = written(first, "jaccard-members")
    texts = sized_join(docs.select("row", "text"), first.select(F.col("doc").alias("row")), ["row"], "left_semi", 24)
    orders = ", ".join(f"order{k} array<long>" for k in range(1, len(ORDERS) + 1))
    whole = texts.mapInArrow(lambda b: _full_sets(b, n, num, den), f"doc long, tokens array<long>, {orders}")
    sets = written(whole.join(first, "doc"), "jaccard-sets")
    postings = written(_ranked(sets, num, den), "jaccard-postings")
    same = None if row == "doc_id" else _shared_ids(usable, copies)
    members = postings.select("doc") if same is None else postings.select("doc").unionByName(same.select(F.explode(F.array("a", "b")).alias("doc")))
    members = written(members.distinct(), "jaccard-docs")
    possible = _possible(num, den)
    head = F.struct("score", (-F.col("doc")).alias("minus"), F.col("n").alias("n2"), F.col("at").alias("at2"))

    # Each document with the most central one that it can link with by a token.
    pairs = _headed(postings, head, possible).groupBy("doc").agg(F.max("head").alias("head"))
    links = _verified(pairs.select((-F.col("head.minus")).alias("a"), F.col("doc").alias("b")), sets, num, den)
    links = written(links if same is None else links.unionByName(same), "jaccard-links")
    comp = connected(links, members.withColumn("comp", F.col("doc")))
    # The head of each token with its documents in other components. Written before it is
    # dealt by token again, so that a token that many share is summed up first.
    apart = written(_apart(postings, comp), "jaccard-apart")
    pairs = _headed(apart, F.struct("score", (-F.col("doc")).alias("minus"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("comp").alias("comp2")), possible).filter("comp <> head.comp2")
    links = written(links.unionByName(_verified(pairs.select((-F.col("head.minus")).alias("a"), F.col("doc").alias("b")).distinct(), sets, num, den)), "jaccard-links")
    comp = connected(links, comp)
    # All that are still apart.
    apart = written(_apart(postings, comp).select("token", "doc", "n", "at", "comp"), "jaccard-apart")
    other = apart.toDF("token", "b", "n2", "at2", "comp2")
    pairs = apart.join(other, "token").filter(f"doc < b AND comp <> comp2 AND {possible}").select(F.col("doc").alias("a"), "b").distinct()
    links = written(links.unionByName(_verified(pairs, sets, num, den)), "jaccard-links")
    comp = connected(links, comp)

    # The least doc_id of each component; that of a class alone is in ``copies``.
    named = comp.join(classes.select("doc", "least"), "doc")
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("doc", "component_id")
    rows = signed.select("row", "doc_id", "n_shingles").join(copies.withColumnRenamed("doc", "rep"), "row", "left").withColumn("doc", F.coalesce("rep", "row"))
    rows = rows.join(named, "doc", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "least", "doc_id").alias("component_id"))
