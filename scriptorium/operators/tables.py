"""Operators over table cells in long form: cells(doc_id, table_no, row_no, col_no, text).

Columns of these tables are found by content and differ from letter to letter, so cells
stay rows: which column holds codes, money, changes or names is an aggregate per letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as t
from ..profile import Profile
from ..sources.stage import kept, kept_by_python, ship
from . import table_arrays

_TABLE = ["doc_id", "table_no"]
#: Cells of a letter that a task holds at most.
LARGE_LETTER = 2_000_000


def clean_cells(cells: DataFrame) -> DataFrame:
    """Null as empty, stripped."""
    return cells.withColumn("text", t.strip_cell(F.coalesce("text", F.lit(""))))


def _of_table(*keys: str):
    """All cells of a table, or of a part of it, in the order of rows and columns: one sort
    serves all windows of this kind, one after the other."""
    order = [c for c in ("row_no", "col_no") if c not in keys]
    return W.partitionBy(*_TABLE, *keys).orderBy(*order)


def _all(window):
    return window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def promote_header(cells: DataFrame) -> DataFrame:
    """col_name from the first row, which leaves; a table of one row keeps it and has its
    columns named by number. A blank name becomes col and the number."""
    table, col = _all(_of_table()), F.col("col_no")
    heads = F.collect_list(F.when(F.col("row_no") == 0, F.struct("col_no", "text"))).over(table)
    named = cells.withColumns({"_heads": heads, "_rows": F.max("row_no").over(table)})
    # As a rule a column's heading stands at its number.
    at = F.get("_heads", col)
    there = F.coalesce((at["col_no"] == col) & ~F.get("_heads", col + 1)["col_no"].eqNullSafe(col), F.lit(False))
    found = F.array_max(F.transform(F.filter("_heads", lambda h: h["col_no"] == col), lambda h: h["text"]))
    number = col.cast("string")
    head = F.coalesce(F.nullif(t.strip_ws(F.coalesce("_head", F.lit(""))), F.lit("")), F.concat(F.lit("col"), number))
    named = named.withColumn("_head", F.when(there, at["text"]).otherwise(found)).withColumn("col_name", F.when(F.col("_rows") == 0, number).otherwise(head))
    return named.filter("_rows = 0 OR row_no > 0").drop("_rows", "_head", "_heads")


def pair_of(text: Column) -> Column:
    """The two numbers of a stacked cell, as an array; null if it is none."""
    parts = F.split(text, "\n", -1)
    numbers = F.transform(parts, lambda p: t.parse_number(p))
    return F.when(text.contains("\n") & (F.size(parts) == 2) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def split_stacked(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, col_name, col_pos, text, num.

    A column with any pair cell becomes three: from, to and delta, in which other cells
    are null. Columns of a table that come to the same name are one, with the last value
    and the first position. Only a table's columns, and where their names may meet a row's
    are gathered; cells are sorted once.
    """
    table, row = _of_table(), _of_table("row_no")
    rows = cells.withColumn("_pair", pair_of(F.col("text")))
    rows = rows.withColumns({
        "_stacks": F.collect_set(F.when(F.col("_pair").isNotNull(), F.col("col_no"))).over(_all(table)),
        "_cols": F.collect_set(F.struct("col_no", "col_name")).over(_all(table)), "_names": F.collect_set("col_name").over(_all(table)),
        "_ends": F.max(F.col("col_name").rlike(" (from|to|delta)$")).over(_all(table)),
    })
    rows = rows.select("*", F.array_contains("_stacks", F.col("col_no")).alias("_stacked"), (F.col("_ends") | (F.size("_names") < F.size("_cols"))).alias("_meet"))
    rows = rows.withColumns({"_row": F.collect_list(F.when(F.col("_meet"), F.struct("col_no", "col_name"))).over(_all(row)), "_next": F.lead("col_no").over(row)})
    rows = rows.filter(~F.col("_next").eqNullSafe(F.col("col_no")))  # one cell in a place
    top, bottom = F.get("_pair", F.lit(0)), F.get("_pair", F.lit(1))
    suffixes = (" from", " to", " delta")

    def places(c: Column) -> Column:
        """Names and places of what a column becomes."""
        one = lambda k, suffix: F.struct(F.concat(c["col_name"], F.lit(suffix)).alias("name"), F.struct(c["col_no"].alias("col_no"), F.lit(k).alias("part")).alias("at"))
        return F.when(F.array_contains("_stacks", c["col_no"]), F.array(*[one(k, x) for k, x in enumerate(suffixes)])).otherwise(F.array(one(0, "")))

    def part(k: int, suffix: str, text: Column, num: Column) -> Column:
        name, own = F.concat("col_name", F.lit(suffix)), F.struct("col_no", F.lit(k).alias("part"))
        alike = lambda cs: F.filter(F.flatten(F.transform(cs, places)), lambda q: q["name"] == name)
        first = F.when(F.col("_meet"), F.array_min(F.transform(alike(F.col("_cols")), lambda q: q["at"]))).otherwise(own)
        last = ~F.col("_meet") | (F.array_max(F.transform(alike(F.col("_row")), lambda q: q["at"])) == own)
        return F.struct(name.alias("col_name"), first.alias("col_pos"), text.cast("string").alias("text"), num.cast("double").alias("num"), last.alias("_last"))

    none = F.lit(None)
    parts = F.when(F.col("_stacked"), F.array(*[part(k, x, none, n) for k, (x, n) in enumerate(zip(suffixes, (top, bottom, bottom - top), strict=True))])).otherwise(F.array(part(0, "", F.col("text"), none)))
    return rows.select("doc_id", "table_no", "row_no", F.inline(parts)).filter("_last").drop("_last")


def data_table_keys(logical: DataFrame) -> DataFrame:
    """doc_id, table_no of tables that have a column ending in delta, once each."""
    return logical.filter(F.col("col_name").endswith("delta")).select(*_TABLE).distinct()


def data_tables(logical: DataFrame) -> DataFrame:
    """Cells of tables that have a column ending in delta."""
    return logical.withColumn("_data", F.max(F.col("col_name").endswith("delta")).over(W.partitionBy(*_TABLE))).filter("_data").drop("_data")


def column_scores(logical: DataFrame, counts: Column) -> DataFrame:
    """doc_id, col_name, pos, score: how many cells of a column pass."""
    pos = F.struct("table_no", "col_pos")
    return logical.groupBy("doc_id", "col_name").agg(F.min(pos).alias("pos"), F.count_if(F.coalesce(counts, F.lit(False))).alias("score"))


def best_column(scores: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, col_name: the highest score, the first position on ties."""
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("pos")))
    return scores.filter(F.col("score") >= least).withColumn("_n", first).filter("_n = 1").select("doc_id", "col_name")


def is_leaf(text: Column, most: int = 6) -> Column:
    """Whether a cell holds a code of five digits up to ``most``."""
    return t.strip_ws(text).rlike(rf"\A[0-9]{{5,{most}}}\z")


def _table_rows(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cells: each row of a table as an array in column order of
    col_no, text and pair (its two numbers)."""
    # Texts are stripped before they are gathered, once; only two lines that start like
    # numbers are parsed.
    rows = clean_cells(cells).groupBy(*_TABLE, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("cells"))
    stacked = rf"(?U)\A{t.SPACE}*[-,0-9][^\n]*\n{t.SPACE}*[-,0-9][^\n]*\z"
    return rows.withColumn("cells", F.transform("cells", lambda c: F.struct(c["col_no"], c["text"], F.when(c["text"].rlike(stacked), pair_of(c["text"])).alias("pair"))))


def _table_columns(rows: DataFrame) -> DataFrame:
    """doc_id, table_no, single (a table of one row, which is data), names (of all columns,
    by number), stacked (columns with a pair), columns (name and place of what they become,
    in order), data (whether one of these ends in delta). Distinct patterns of columns are
    all that is gathered of a table's rows."""
    held, pairs = F.col("cells.col_no"), F.transform(F.filter("cells", lambda c: c["pair"].isNotNull()), lambda c: c["col_no"])
    first = F.col("row_no") == 0
    info = rows.groupBy(*_TABLE).agg(
        F.max(F.when(first, F.transform("cells", lambda c: F.struct(c["col_no"], c["text"])))).alias("head"), F.max(F.when(first, pairs)).alias("head_pairs"),
        (F.max("row_no") == 0).alias("single"), F.collect_set(F.when(~first, held)).alias("held"), F.collect_set(F.when(~first, pairs)).alias("pairs"),
    )
    own = lambda lone, sets: F.array_sort(F.array_distinct(F.when(F.col("single"), lone).otherwise(F.flatten(sets))))
    info = info.withColumns({"held": own(F.col("head.col_no"), F.col("held")), "stacked": own(F.col("head_pairs"), F.col("pairs")), "head": F.map_from_entries(F.coalesce("head", F.array().cast("array<struct<col_no:int,text:string>>")))})
    number = lambda c: c.cast("string")
    name = lambda c: F.when(F.col("single"), number(c)).otherwise(F.coalesce(F.nullif(F.try_element_at("head", c), F.lit("")), F.concat(F.lit("col"), number(c))))
    info = info.withColumn("names", F.map_from_arrays("held", F.transform("held", name)))
    columns = F.flatten(F.transform("held", lambda c: _parts_of(F.array_contains("stacked", c), c, F.element_at("names", c))))
    info = info.withColumn("columns", columns)
    return info.select(*_TABLE, "single", "names", "stacked", "columns", F.exists("columns", lambda c: c["name"].endswith("delta")).alias("data"))


def _parts_of(stacked: Column, col_no: Column, name: Column, plain: dict | None = None, halves: tuple = ({}, {}, {})) -> Column:
    """The logical columns of a column, with further values: itself, or from, to and delta."""
    part = lambda k, suffix, more: F.struct(F.concat(name, F.lit(suffix)).alias("name"), (col_no * 4 + k).alias("at"), *[v.alias(n) for n, v in more.items()])
    return F.when(stacked, F.array(*[part(k, s, halves[k]) for k, s in enumerate((" from", " to", " delta"))])).otherwise(F.array(part(0, "", plain or {})))


def _logical_rows(rows: DataFrame, info: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, table_no, row_no, parts (name, at, text, amount, digits) of the data tables; of
    columns of a table that come to the same name the last one's value. Amounts are those of
    halves; digits is how many digits a text of digits alone has, up to ``most``."""
    rows = rows.join(info.filter("data").select(*_TABLE, "single", "names", "stacked"), _TABLE).filter("single OR row_no > 0")
    none = lambda kind: F.lit(None).cast(kind)
    half = lambda v: {"text": none("string"), "amount": v, "digits": none("int")}

    def parts(c: Column) -> Column:
        digits = F.when(c["text"].rlike(rf"\A[0-9]{{1,{most}}}\z"), F.length(c["text"]))
        name = F.element_at("names", c["col_no"])
        amount = F.when((name.endswith(" from") | name.endswith(" to")) & (c["text"] != ""), c["text"].try_cast("double"))
        plain = {"text": c["text"], "amount": amount, "digits": digits}
        top, bottom = F.get(c["pair"], F.lit(0)), F.get(c["pair"], F.lit(1))
        return _parts_of(F.array_contains("stacked", c["col_no"]), c["col_no"], name, plain, (half(top), half(bottom), half(bottom - top)))

    rows = rows.select(*_TABLE, "row_no", F.flatten(F.transform("cells", parts)).alias("parts"))
    last = F.filter("parts", lambda p, i: ~F.exists(F.slice("parts", i + 2, F.size("parts")), lambda q: q["name"] == p["name"]))
    return rows.withColumn("parts", F.when(F.size(F.array_distinct("parts.name")) < F.size("parts"), last).otherwise(F.col("parts")))


def _best(names: DataFrame, scores: DataFrame, least: int) -> DataFrame:
    """doc_id, best: of names (doc_id, name, at) the one with the highest score (doc_id,
    name, score; 0 without), the first on ties."""
    scored = names.join(scores, ["doc_id", "name"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return scored.filter(F.col("score") >= least).groupBy("doc_id").agg(F.max_by("name", F.struct("score", "at")).alias("best"))


def _named(parts: Column, name: Column, value: str) -> Column:
    return F.get(F.filter(parts, lambda p: p["name"] == name), F.lit(0))[value]


def budget_lines(cells: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The combined table of each letter, and what went wrong.

    lines: doc_id, line_no, number, from, to, delta, name. errors: doc_id, stage, message
    for letters without a data table or without a column of codes; these have no lines.

    Cells are dealt by letter, unless they are already, and many letters at a time decided as
    arrays, once for both frames. A letter of more than LARGE_LETTER cells is not held by a
    task: it goes by counts (see _large_letters).
    """
    ship(cells.sparkSession)
    numbered = F.row_number().over(W.partitionBy("doc_id").orderBy("table_no", "row_no", "col_no"))
    place = [F.col(c).cast("long").alias(c) for c in ("table_no", "row_no", "col_no")]
    cells_of = cells.select("doc_id", *place, "text")
    digits, wanted, most, chunk = profile.code_digits, "".join(profile.name_header.split()), LARGE_LETTER, table_arrays.CHUNK
    schema = StructType([cells.schema["doc_id"], *StructType.fromDDL("kind int, line_no int, number string, `from` double, `to` double, delta double, name string, message string")])
    found = cells_of.withColumn("n", numbered).mapInArrow(lambda batches: table_arrays.budget_rows(batches, digits, wanted, most, chunk), schema)
    found = kept_by_python(found, "budget-lines")
    lines = found.filter(F.col("kind") == table_arrays.LINE).select("doc_id", "line_no", "number", "from", "to", "delta", "name")
    errors = found.filter(F.col("kind") == table_arrays.ERROR).select("doc_id", F.lit("combine").alias("stage"), "message")
    large = found.filter(F.col("kind") == table_arrays.LARGE).select(F.col("doc_id").alias("_large"))
    if not large.isEmpty():
        more = _large_letters(cells.join(large, F.col("doc_id").eqNullSafe(F.col("_large")), "left_semi"), profile)
        lines, errors = lines.unionByName(more[0]), errors.unionByName(more[1])
    return lines, errors


def _large_letters(cells: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """As budget_lines, for letters of any size.

    Which columns hold codes, money, changes and names is decided by counts per letter and
    column name, which are combined before every shuffle, and joined back to rows: nothing
    gathers the cells of a letter. Only the lines themselves are numbered by letter.
    """
    rows = kept(_table_rows(cells), "table-rows")
    info = kept(_table_columns(rows), "table-columns")
    parts = kept(_logical_rows(rows, info, profile.code_digits), "logical-rows")
    # Positions are negated, so that the first is the greatest.
    place = -(F.shiftleft(F.col("table_no").cast("long"), 30) + F.col("c.at"))
    names = info.filter("data").select("*", F.explode("columns").alias("c")).groupBy("doc_id", F.col("c.name").alias("name")).agg(F.max(place).alias("at"))
    names = kept(names, "column-names")
    count = lambda df, found: df.select("doc_id", F.explode(found).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("score"))
    hits = F.transform(F.filter("parts", lambda p: p["digits"].isNotNull()), lambda p: p["name"])
    codes = kept(_best(names, count(parts, hits), 1).withColumnRenamed("best", "code_col"), "code-columns")
    code = F.filter("parts", lambda p: (p["name"] == F.col("code_col")) & (p["digits"] >= 5))
    leaves = parts.join(codes, "doc_id").withColumn("number", t.zero_pad_code(F.get(code, F.lit(0))["text"])).filter("number IS NOT NULL")
    leaves = kept(leaves, "leaf-rows")
    # Of kept rows: pairs of which both halves are numbers; numbers in columns of their own.
    ends = lambda p, suffix: p["name"].endswith(suffix) & p["amount"].isNotNull()
    base = lambda suffix: F.transform(F.filter("parts", lambda p: ends(p, suffix)), lambda p: F.substring(p["name"], 1, F.length(p["name"]) - len(suffix)))
    free = lambda c: ~c.rlike(" (from|to|delta)$")
    number = lambda text: F.when(text.rlike(r"\A[-,0-9]"), t.parse_number(text))
    single = F.transform(F.filter("parts", lambda p: (p["name"] != F.col("code_col")) & free(p["name"]) & number(p["text"]).isNotNull()), lambda p: p["name"])
    cut = lambda suffix: names.filter(F.col("name").endswith(suffix)).select("doc_id", F.substring("name", F.lit(1), F.length("name") - len(suffix)).alias("name"), "at")
    bases = cut(" from").join(cut(" to").select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    money = _best(bases, count(leaves, F.array_intersect(base(" from"), base(" to"))), 0).withColumnRenamed("best", "money_base")
    others = names.join(codes, "doc_id").filter((F.col("name") != F.col("code_col")) & free(F.col("name"))).select("doc_id", "name", "at")
    change = _best(others, count(leaves, single), 1).withColumnRenamed("best", "change_col")
    wanted = "".join(profile.name_header.split())
    titled = names.filter(t.drop_ws(F.reverse("name")) == wanted).groupBy("doc_id").agg(F.max_by("name", "at").alias("name_col"))
    chosen = codes.select("doc_id").join(money, "doc_id", "left").join(change, "doc_id", "left").join(titled, "doc_id", "left")
    wide = leaves.join(kept(chosen, "chosen-columns"), "doc_id").select(
        "doc_id", "table_no", "row_no", "number",
        _named(F.col("parts"), F.concat("money_base", F.lit(" from")), "amount").alias("frm"), _named(F.col("parts"), F.concat("money_base", F.lit(" to")), "amount").alias("till"),
        number(_named(F.col("parts"), F.col("change_col"), "text")).alias("change"), F.col("change_col").isNotNull().alias("has_change"),
        _named(F.col("parts"), F.col("name_col"), "text").alias("raw_name"),
    )
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("table_no", "row_no"))
    lines = reserve_fill(wide).select("doc_id", order.alias("line_no"), "number", F.col("frm").alias("from"), F.col("till").alias("to"), "delta", t.clean_name(F.col("raw_name")).alias("name"))
    state = info.groupBy("doc_id").agg(F.max("data").alias("data")).join(codes, "doc_id", "left")
    message = F.when(~F.col("data"), "no data table with a delta column").when(F.col("code_col").isNull(), "no column of budget codes")
    errors = state.select("doc_id", F.lit("combine").alias("stage"), message.alias("message")).filter("message IS NOT NULL")
    return lines, errors


def reserve_fill(rows: DataFrame) -> DataFrame:
    """frm, till, delta from frm, till, change, has_change: where there is no pair, the
    change negated and 0; the difference; then 0 for what is missing."""
    gap = F.col("has_change") & F.col("frm").isNull()
    rows = rows.withColumns({"frm": F.when(gap, -F.col("change")).otherwise(F.col("frm")), "till": F.when(gap, F.lit(0.0)).otherwise(F.col("till"))})
    return rows.withColumn("delta", F.col("till") - F.col("frm")).fillna(0.0, ["frm", "till", "delta"])


def history_cells(cells: DataFrame) -> DataFrame:
    """doc_id, row_no, col_no, header, value of a history table: headers as names, the
    first column as codes, numbers with thousands separators, other cells reversed."""
    # Headings alone are cleaned. Rows are sorted as report_rows takes them.
    head = F.when(F.col("row_no") == 0, F.struct("text", t.clean_name(F.col("text")).alias("header")))
    header = F.max(head).over(_all(W.partitionBy("doc_id", "col_no").orderBy("row_no")))["header"]
    rows = cells.withColumn("header", F.coalesce(header, F.lit(""))).filter("row_no > 0")
    rows = rows.withColumn("_turned", F.reverse(t.strip_cell(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("_number", F.when(F.col("col_no") > 0, t.parse_bare(F.col("_turned"))))
    value = F.coalesce(t.format_thousands(F.col("_number")), "_turned")
    return rows.select("doc_id", "row_no", "col_no", "header", value.alias("value"))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All columns of all tables by name, null where a table lacks one."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
