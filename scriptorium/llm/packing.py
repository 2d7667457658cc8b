"""Bounded-space online packing of documents into token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window that
it leaves least room in; if it fits nowhere, the fullest window is emitted and a new
one opened. What is still open at the end of the partitions is merged, where pieces are
cut to fill windows.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, ship, sized_join, written

LENGTH = 2048
#: Open windows per partition.
WINDOWS = 64
#: Partitions whose leftover windows are merged with each other.
FAN_IN = 64
#: The id that ends a document.
END = 1

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, window long, offset long"


def default_vocabulary() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: tuple[str, str]):
    """text -> ids as uint32, as the tokenizer file gives them without special tokens.

    The ranks file holds the same vocabulary, for an encoder that is several times as
    fast. It is used for texts in Latin script without the tokenizer's special string;
    others, where character tables of the two could differ, go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary[0])
    with open(vocabulary[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = re.compile("[^\x00-ɏ]|" + "|".join(map(re.escape, (x.content for x in slow.get_added_tokens_decoder().values()))))

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


class OpenWindows:
    """At most ``most`` open windows of ``length``; numbers count up from ``first``."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most, self.next = length, most, 0
        self.open: list[tuple[int, int]] = []  # (room, number), the fullest first

    def place(self, size: int) -> tuple[int, int]:
        """The window that takes a piece of ``size`` and the piece's offset there."""
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, number = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, number, self.next = self.length, self.next, self.next + 1
        if room > size:
            insort(self.open, (room - size, number))
        return number, self.length - room


def _pack_partition(batches: Iterator[pa.RecordBatch], length: int, most: int, vocabulary: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    encode, windows, part = encoder(vocabulary), OpenWindows(length, most), pyspark.TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("window", pa.int64()), ("offset", pa.int64())])
    for batch in by_bytes(batches):
        rows: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
            for start in range(0, len(ids), length):
                piece = ids[start : start + length]
                number, offset = windows.place(len(piece))
                rows.append((doc_id, start, len(piece), piece.tobytes(), len(ids), part, number, offset))
            held += len(ids)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    if windows.open:  # the leftovers: no document, the fill as length
        left = [(None, None, length - room, None, None, part, number, None) for room, number in windows.open]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left, strict=True), schema.types, strict=True)], schema=schema)


def _with_leftovers(rows: DataFrame, length: int, fan_in: int) -> DataFrame:
    """The pieces with sequence_id and final offset. The windows left open by ``fan_in``
    partitions stand one after the other, and full windows are cut from them, so that at
    most one of these is short; a piece that lies on a cut becomes two."""
    unit = F.floor(F.col("part") / fan_in).cast("long")
    before = W.partitionBy("unit").orderBy("part", "window").rowsBetween(W.unboundedPreceding, -1)
    left = rows.filter("ids IS NULL").select("part", "window", unit.alias("unit"), F.col("length").alias("fill"))
    left = written(left.select("part", "window", "unit", F.coalesce(F.sum("fill").over(before), F.lit(0)).alias("base")), "packing-leftovers")
    rows = sized_join(rows.filter("ids IS NOT NULL"), left, ["part", "window"], "left", 48)
    rows = rows.withColumn("at", F.coalesce("base", F.lit(0)) + F.col("offset"))
    rows = rows.withColumn("cut", F.explode(F.expr(f"sequence(at div {length}, (at + length - 1) div {length})")))
    rows = rows.withColumns({"from": F.expr(f"greatest(0, cut * {length} - at)"), "till": F.expr(f"least(length, (cut + 1) * {length} - at)")})
    own = F.shiftleft(F.col("part").cast("long"), 32) + F.col("window")
    merged = F.lit(1 << 62) + F.shiftleft("unit", 32) + F.col("cut")
    return rows.select(
        "doc_id",
        (F.col("start") + F.col("from")).alias("start"),
        (F.col("till") - F.col("from")).alias("length"),
        F.substring("ids", (4 * F.col("from") + 1).cast("int"), (4 * (F.col("till") - F.col("from"))).cast("int")).alias("ids"),
        "doc_tokens",
        F.when(F.col("base").isNull(), own).otherwise(merged).alias("sequence_id"),
        F.expr(f"(at + from) % {length}").alias("offset"),
    )


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, vocabulary: tuple[str, str] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    A document is its text's ids and an end id; a null or empty text is the end id
    alone. A document longer than a window fills whole windows and packs its rest. Rows
    that repeat a document are packed each; doc_id may be null. Other columns are
    ignored; empty input gives no rows.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _pack_partition(b, length, windows, vocabulary), _PIECES)
    rows = written(rows, "packing-pieces")
    return _with_leftovers(rows, length, fan_in)
