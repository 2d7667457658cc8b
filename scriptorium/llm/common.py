"""Shared helpers: scratch tables, joins behind a size check, text expressions."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_folder, ship  # noqa: F401  ship is for the operators

#: The six characters of [\x20\x09-\x0D], in code point order.
WHITE = "\t\n\x0b\x0c\r "
#: The same as a Java pattern class body.
WHITE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE_CLASS}]+"
#: A side of a join is broadcast up to this many bytes (rows times a row width).
BROADCAST_BYTES = 16 << 20
#: Rows that a Python worker is sent at once. Texts of some kilobytes make megabytes of
#: these, on the executor's side (outside its heap) and on the worker's.
ARROW_ROWS = 500


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder (or added to the one at ``path``): lineage ends there, and a lost
    executor costs no recomputation of what stands before it. Python workers that take
    part are sent small batches."""
    spark = df.sparkSession
    path, key = path or scratch_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written, small-or-large right side: broadcast if its counted
    rows times ``width`` bytes stay within ``limit``, a shuffle join (which AQE
    splits where a key is skewed) beyond it."""
    if right.count() * width <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (or bytes) have ``most`` bytes or a row more."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if a < b:
                yield batch.slice(a, b - a)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def as_files(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` as rows of Parquet files: as they are read if they are, written first
    otherwise (just ``columns``, if given)."""
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    if kind(plan) == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation" and kind(plan.relation().fileFormat()) == "ParquetFileFormat":
        return docs
    return written(docs.select(*columns) if columns else docs, "rows")


def located(docs: DataFrame, file: str = "_file", at: str = "_at") -> DataFrame:
    """Rows of Parquet files with their file, and their place there: the same whenever they
    are evaluated, and different for any two rows. The two names must be free."""
    place = docs.metadataColumn("_metadata")
    return docs.select(*columns_of(docs), place["file_path"].alias(file), place["row_index"].alias(at))


def file_numbers(docs: DataFrame, no: str, file: str) -> DataFrame:
    """The names of the files that ``docs`` is read from, numbered in their order; to be
    broadcast, as a file listing is held whole by any reader."""
    paths = sorted(r[0] for r in docs.select(docs.metadataColumn("_metadata")["file_path"].alias(file)).distinct().collect())
    return F.broadcast(docs.sparkSession.createDataFrame(pa.table({no: pa.array(range(len(paths)), pa.int64()), file: pa.array(paths, pa.string())})))


def numbered_rows(docs: DataFrame, row: str = "_row") -> DataFrame:
    """``docs`` with ``row``, a free name: a number for each row that no other has, from its
    place in its file. Anything but Parquet files as they are read is written first."""
    docs = as_files(docs)
    file, at, no = (free_name(docs, c) for c in ("_file", "_at", "_no"))
    rows = located(docs, file, at)
    return rows.join(file_numbers(docs, no, file), file).select(*columns_of(docs), (F.shiftleft(no, 40) + F.col(at)).alias(row))


def at_places(docs: DataFrame, decisions: DataFrame, how: str, width: int, file: str = "file", at: str = "at", only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of Parquet files, as they are read, with what a written table says of some of
    them: both joined by ``file`` and ``at``, names that ``docs`` lacks, which stay. ``only``
    names the columns of ``docs`` to read.

    Texts stay where they lie. Decisions of up to ``limit`` bytes (rows times ``width``) are
    broadcast whole. Beyond that, files are taken in rounds by the order of their names, as
    many as have decisions within the limit, and a round's rows are written before the next
    one; only a file that has more by itself is shuffled, alone."""
    limit = BROADCAST_BYTES if limit is None else limit
    rows = located(docs, file, at)
    if only is not None:
        rows = rows.select(*only, file, at)
    if decisions.count() * width <= limit:
        return rows.join(F.broadcast(decisions), [file, at], how)
    decisions = written(decisions.repartitionByRange(file).sortWithinPartitions(file), "decisions")
    ends, held = [], 0
    for name, n in sorted(decisions.groupBy(file).count().collect()):
        if held and (held + n) * width > limit:
            ends.append(before)
            held = 0
        held, before = held + n, name
    path = scratch_path(docs.sparkSession, "rounds")
    for low, high in itertools.pairwise([None, *ends, None]):
        within = F.lit(True)
        if low is not None:
            within &= F.col(file) > low
        if high is not None:
            within &= F.col(file) <= high
        out = written(sized_join(rows.filter(within), decisions.filter(within), [file, at], how, width, limit), "rounds", path)
    return out


def filled(text: Column | str) -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """Text without any of the six white-space characters."""
    return F.translate(text, WHITE, "")


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than the six white-space ones."""
    return F.array_remove(F.split(text, f"[{WHITE_CLASS}]+"), "")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once even where the body
    uses it within another lambda (the optimizer would inline a projected column
    there and evaluate it for every element)."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
