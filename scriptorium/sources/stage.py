"""Rows that cost an outside call are written once, then read; waits; shared folders."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker gets in one batch.
BATCH_ROWS = 4_000


def once(df: DataFrame, beside: str) -> DataFrame:
    """``df`` as a table beside a path: what follows, and a rerun after a lost executor,
    reads the table and doesn't call again."""
    path = f"{beside.rstrip('/')}.staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see; on one
    machine (tests) a temporary one where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for rows that several plans read."""
    return once(df, f"{shared_folder(df.sparkSession)}/{name}")


def kept_by_python(df: DataFrame, name: str) -> DataFrame:
    """``kept`` for what Python workers make of many rows with short texts. Batches for them
    are bounded by rows alone: Spark measures a batch's bytes after each row, which takes
    longer than all else that such rows cost."""
    conf = df.sparkSession.conf
    size, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: conf.get(k) for k in (size, rows)}
    conf.set(size, str(2**31 - 1))
    conf.set(rows, str(min(BATCH_ROWS, int(before[rows])) if int(before[rows]) > 0 else BATCH_ROWS))
    try:
        return kept(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context, so that their Python
    workers can import it wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._scriptorium_shipped = True


def waits(attempts: int) -> list[int]:
    """Seconds to wait before each attempt: none, then 1, 2, 4 and so on."""
    return [2**k // 2 for k in range(attempts)]
