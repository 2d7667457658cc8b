"""The master list of tracked programs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zero_pad_code
from ..operators.match import last_wins

# Fixed values of the master file.
SHEET, KEY, NAME = "תוכניות", "קוד", "שם תוכנית"


def in_file_order(rows: DataFrame, order: str = "_order") -> DataFrame:
    """Rows as they are read from files, with ``order``: by the file's name, then by where
    they stand in it, however files are cut and dealt."""
    place = rows.metadataColumn("_metadata")
    return rows.select("*", F.struct(place["file_path"], place["file_block_start"], F.monotonically_increasing_id()).alias(order))


def master_table(rows: DataFrame, key: str = KEY, name: str = NAME, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(master, errors): code and name, the last name of a code in the order of a column
    (by default that of the frame's partitions); rows without a whole
    number as code are errors. Raises if a column is missing."""
    if missing := {key, name} - set(rows.columns):
        raise ValueError(f"missing columns {sorted(missing)} in the master list")
    number = F.col(f"`{key}`").cast("string").try_cast("double")
    rows = rows.withColumns({"_row": F.col(order) if order else F.monotonically_increasing_id(), "_code": F.when(number == F.floor(number), number.try_cast("long"))})
    good = rows.filter("_code IS NOT NULL").select(zero_pad_code(F.col("_code").cast("string")).alias("code"), F.col(f"`{name}`").alias("name"), "_row")
    bad = rows.filter("_code IS NULL").select(F.lit("master").alias("stage"), F.concat(F.lit("no code for "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("a blank row"))).alias("message"))
    return last_wins(good, "code", "name", "_row"), bad


def load_master(spark: SparkSession, path: str, sheet: str = SHEET, key: str = KEY, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """From xlsx (read on the driver; openpyxl is optional), csv or parquet."""
    if path.endswith(".xlsx"):
        import pandas as pd

        if not Path(path).is_file():
            raise FileNotFoundError(f"no master file {path}")
        sheet_rows = pd.read_excel(path, sheet_name=sheet)
        rows = spark.createDataFrame(sheet_rows.assign(_order=range(len(sheet_rows))))
    else:
        rows = in_file_order(spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path))
    return master_table(rows, key, name, "_order")
