import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.operators import compare, fields, match, model_fields, pages, tables
from scriptorium.plans import letters
from scriptorium.plans.report import outbox, render_html
from scriptorium.profile import HEBREW, LATIN
from scriptorium.sources import stage

CELLS = "doc_id string, table_no int, row_no int, col_no int, text string"


def number(x):
    x = x.strip().replace(",", "")
    body = x.removeprefix("-")
    whole, dot, part = body.partition(".")
    return float(x) if whole.isdigit() and (not dot or part.isdigit()) else None


def expected(doc):
    """The combined table of a letter, from its tables as lists of rows, step by step."""
    frames = []
    for rows in doc:
        rows = [[(c or "").strip() for c in r] for r in rows]
        head, data = ([str(k) for k in range(len(rows[0]))], rows) if len(rows) == 1 else (rows[0], rows[1:])
        cols = {}
        for j, h in enumerate(head):
            h = h or f"col{j}"
            vals = [r[j] for r in data]
            pairs = [tuple(map(number, v.split("\n"))) if len(v.split("\n")) == 2 and None not in map(number, v.split("\n")) else None for v in vals]
            if any(pairs):
                for k, s in enumerate((" from", " to")):
                    cols[h + s] = [p and p[k] for p in pairs]
                cols[h + " delta"] = [p and p[1] - p[0] for p in pairs]
            else:
                cols[h] = vals
        if any(c.endswith("delta") for c in cols):
            frames.append((cols, len(data)))
    if not frames:
        return None
    names = list(dict.fromkeys(c for f, _ in frames for c in f))
    rows = [{c: f[c][i] if c in f else None for c in names} for f, n in frames for i in range(n)]
    digits = lambda v, lo: isinstance(v, str) and v.strip().isdigit() and lo <= len(v.strip()) <= 6

    def best(cands, score, least):
        top = max(((score(c), -k) for k, c in enumerate(cands)), default=(-1, 0))
        return cands[-top[1]] if top[0] >= least else None

    code = best(names, lambda c: sum(digits(r[c], 1) for r in rows), 1)
    if code is None:
        return None
    rows = [r for r in rows if digits(r[code], 5)]
    real = lambda v: v if isinstance(v, float) else None if v is None else number(v) if "," not in v else None
    bases = [c[:-5] for c in names if c.endswith(" from") and c[:-5] + " to" in names]
    money = best(bases, lambda b: sum(real(r[b + " from"]) is not None and real(r[b + " to"]) is not None for r in rows), 0)
    free = [c for c in names if c != code and not c.endswith((" from", " to", " delta"))]
    change = best(free, lambda c: sum(isinstance(r[c], str) and "\n" not in r[c] and number(r[c]) is not None for r in rows), 1)
    named = [c for c in names if "".join(c[::-1].split()) == "itemname"]
    out = []
    for r in rows:
        a, b = (real(r[money + s]) for s in (" from", " to")) if money is not None else (None, None)
        if change is not None and a is None:
            v = number(r[change]) if isinstance(r[change], str) else None
            a, b = None if v is None else -v, 0.0
        d = None if a is None or b is None else b - a
        name = (r[named[0]] or "") if named else ""
        name = " ".join(x for x in (y[::-1].strip() for y in name.split("\n")) if any(ch.isalnum() or ch == "_" for ch in x))
        out.append((r[code].strip().zfill(6), (a or 0.0) + 0.0, (b or 0.0) + 0.0, (d or 0.0) + 0.0, name))
    return out


def random_doc(r):
    def cell(j):
        kinds = [f"{r.randint(1, 99)}\n{r.randint(1, 99)}", "1\n2\n3", str(r.randint(0, 9999)), "5-", "abc", "", None, "1,200\n-3", "-7.5", ",5", "-,6", "cba\n=="]
        return str(r.randint(1, 10 ** r.randint(4, 7))) if j == 0 and r.random() < 0.8 else r.choice(kinds)

    doc = []
    for _ in range(r.randint(1, 3)):
        width = r.randint(2, 5)
        heads = [r.choice(["code", "a", "b", "a", "", None, "eman meti", "b from", "delta"]) for _ in range(width)]
        doc.append([heads] + [[cell(j) for j in range(width)] for _ in range(r.randint(0, 4))])
    return doc


def test_budget_lines_on_random_tables(spark):
    r = random.Random(5)
    docs = {f"d{k}": random_doc(r) for k in range(150)}
    cells = [(d, n, i, j, c) for d, doc in docs.items() for n, rows in enumerate(doc) for i, row in enumerate(rows) for j, c in enumerate(row)]
    lines, errors = tables.budget_lines(spark.createDataFrame(cells, CELLS), LATIN)
    got = {}
    for x in lines.orderBy("doc_id", "line_no").collect():
        got.setdefault(x["doc_id"], []).append((x["number"], x["from"] + 0.0, x["to"] + 0.0, x["delta"] + 0.0, x["name"]))
    bad = {x["doc_id"] for x in errors.collect()}
    for d, doc in docs.items():
        want = expected(doc)
        assert (want is None) == (d in bad), (d, doc)
        assert got.get(d, []) == (want or []), (d, doc)


def test_letters_as_arrays_and_large_ones_by_counts(spark, monkeypatch):
    """Letters decided in tasks, in pieces of any size, and letters that no task holds agree;
    letters are written once, as lines."""
    r = random.Random(11)
    docs = {f"d{k}": random_doc(r) for k in range(60)} | {None: random_doc(r)}
    cells = [(d, n, i, j, c) for d, doc in docs.items() for n, rows in enumerate(doc) for i, row in enumerate(rows) for j, c in enumerate(row)]
    cells += [("odd", 0, i, j, c) for i, row in enumerate([["code", "s from", "s to", "eman meti"], ["12345", " 1e1", "0x1p3", "\u24b6\n==\nx\u00a0"], ["23456", "NaN", "7d", "\u2003ba\u200d "]]) for j, c in enumerate(row)]
    cells += [("odd", 0, 2, 0, "12"), ("odd", 0, 2, 0, "99999"), ("odd", 0, 3, 0, "34567"), ("odd", 1, 1, 1, "1\n\x1c2")]
    frame, names, own = spark.createDataFrame(cells, CELLS).repartition(3), [], stage.once
    monkeypatch.setattr(stage, "once", lambda df, beside: names.append(beside.split("/")[-1]) or own(df, beside))
    rows = lambda found: [sorted(map(repr, map(tuple, x.collect()))) for x in found]
    whole = rows(tables.budget_lines(frame, LATIN))
    assert names == ["budget-lines"] and len(whole[0]) > 30 and len(whole[1]) > 5
    monkeypatch.setattr(tables.table_arrays, "CHUNK", 7)
    assert rows(tables.budget_lines(frame, LATIN)) == whole
    assert rows(tables._large_letters(frame, LATIN)) == whole
    monkeypatch.setattr(tables, "LARGE_LETTER", 15)
    names.clear()
    assert rows(tables.budget_lines(frame, LATIN)) == whole and len(names) > 1


def test_stacked_cells_and_reserve_rows(spark):
    cells = [("d", 0, 0, j, h) for j, h in enumerate(["code", "sum", "", HEBREW.name_header[::-1]])]
    cells += [("d", 0, 1, 0, "45211"), ("d", 0, 1, 1, "100\n250"), ("d", 0, 1, 2, None), ("d", 0, 1, 3, HEBREW.gist[0][::-1])]
    cells += [("d", 0, 2, 0, "123456"), ("d", 0, 2, 1, "x"), ("d", 0, 2, 2, "37,018"), ("d", 0, 2, 3, "===")]
    cells += [("d", 0, 3, 0, "1234"), ("d", 0, 3, 1, "1\n2"), ("d", 0, 3, 2, ""), ("d", 0, 3, 3, "")]
    lines, errors = tables.budget_lines(spark.createDataFrame(cells, CELLS), HEBREW)
    assert [tuple(r)[2:] for r in lines.orderBy("line_no").collect()] == [("045211", 100.0, 250.0, 150.0, HEBREW.gist[0]), ("123456", -37018.0, 0.0, 37018.0, "")]
    assert errors.isEmpty()
    master = spark.createDataFrame([("045211", "x"), ("999999", "y")], "code string, name string")
    assert [tuple(r) for r in match.tracked_codes(lines, master).collect()] == [("d", ["045211"])]
    empty = tables.budget_lines(spark.createDataFrame([], CELLS), HEBREW)
    assert empty[0].isEmpty() and empty[1].isEmpty()


def letter():
    p = HEBREW
    return "\n".join([p.page_marker, f"{p.date_label}: 6202/50/01", f"{p.request_label} 202-15", f"{p.request_label} 202-15", "מספר פניה לועדה: 6 עד 9",
        f"{p.gist[0]} לשלם", "מטרת השינוי", "תכנית 201103: אחת 832,84", "103201: שתיים", "השפעה על", "הסכמים קואליציוניים", "שינויים בכוח אדם", "בכבוד רב"])


WANT = ["10/05/2026", "202-51 | מספר פנייה לועדה: 6 עד 9", "301102, 102301", "לשלם", "אחת 48,238\nשתיים", "1. http://x/dec5", "כן", "כן"]


def test_whole_batch(spark, tmp_path):
    reversed_ = "\n".join(line[::-1] for line in letter().split("\n")) + "\nhttp://x/dec5"
    page_text = spark.createDataFrame([("a", 0, reversed_), ("a", 1, HEBREW.history_marker[::-1]), ("b", 0, None), ("b", 1, HEBREW.page_marker[::-1])], "doc_id string, page_no int, raw_text string")
    grid = [("a", 0, 0, [["code", "s"], ["45211", "1\n2"]]), ("a", 1, 1000, [["edoc", "0202"], ["11254", "-000,1"]]), ("b", 1, 1000, [["code", "s"], ["77777", "3\n4"]])]
    cells = spark.createDataFrame([(d, p, n, i, j, c) for d, p, n, rows in grid for i, row in enumerate(rows) for j, c in enumerate(row)], "doc_id string, page_no int, table_no int, row_no int, col_no int, text string")
    master = spark.createDataFrame([("045211", "x")], "code string, name string")
    batch = letters.run_letters(page_text, cells, master)
    assert [tuple(r) for r in batch.matched.collect()] == [("a", ["045211"])]
    assert [r["value"] for r in batch.fields.orderBy("field_no").collect()] == WANT
    assert [tuple(r)[1:] for r in batch.history.orderBy("row_no", "col_no").collect()] == [(1, 0, "code", "45211"), (1, 1, "2020", "1,000-")]
    assert batch.errors.isEmpty() and batch.report.filter("section = 'budget'").count() == 1
    assert [tuple(r)[2:] for r in batch.report.filter("section = 'history'").orderBy("row_no").collect()] == [(0, "code", "2020 | code"), (1, "45211", "1,000- | 45211")]
    head = batch.report.filter("section = 'letterhead'").orderBy("row_no").collect()
    assert len(head) == 3 and head[0]["value"] == letter().split("\n")[0].strip()
    names = letters.slugs(spark.createDataFrame([("a", "http://x/y/letter_12.pdf")], "doc_id string, url string"))
    html = render_html(batch.report, names)
    row = html.first()
    assert row["file"] == "12_a_summary_parse.html" and "045211" in row["html"]
    assert outbox(html, ["one@example.org"], "s").first()["attachments"] == 1
    assert outbox(html.limit(0), ["one@example.org"], "s").isEmpty()

    asked = tmp_path / "asked"

    def client(text, schema):
        with asked.open("a") as f:
            f.write("x")
        return json.dumps({k: "v" for k in schema["required"]})

    for _ in range(2):  # the second run finds the answer in the cache
        again = letters.run_letters(page_text, cells, master, method="llm", client=client, answers=str(tmp_path / "answers"))
        values = {r["field"]: r["value"] for r in again.fields.collect()}
        assert values.pop(HEBREW.links_field) == WANT[5] and set(values.values()) == {"v"}
    assert asked.read_text() == "x"
    with pytest.raises(ValueError):
        letters.run_letters(page_text, cells, master, method="other")
    pairs = compare.field_comparison(batch.fields, again.fields)
    assert tuple(compare.match_tally(pairs).first()) == ("a", 1, 8)


def test_model_answers_are_checked():
    schema = model_fields.answer_schema(LATIN)
    good = json.dumps({k: "" for k in schema["required"]})
    waits = []
    replies = iter([model_fields.RetryLater(), model_fields.RetryLater(), good])

    def client(text, s):
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    assert model_fields.ask(client, "", schema, pause=waits.append)["date"] == "" and waits == [1, 2]
    with pytest.raises(ValueError):
        model_fields.ask(lambda *a: '{"date": "x"}', "", schema)

    def busy(*a):
        raise model_fields.RetryLater

    with pytest.raises(model_fields.RetryLater):
        model_fields.ask(busy, "", schema, pause=waits.append)
    assert waits == [1, 2, 1, 2, 4, 8]


def test_both_empty_is_no_match(spark):
    one = spark.createDataFrame([("d", "f", ""), ("d", "g", "a 1/2")], "doc_id string, field string, value string")
    two = spark.createDataFrame([("d", "f", ""), ("d", "g", " a\n2/1 ")], "doc_id string, field string, value string")
    assert {r["field"]: r["matched"] for r in compare.field_comparison(one, two).collect()} == {"f": False, "g": True}


def test_coalition_flag(spark):
    cases = {"האם יש התייחסות לכספים קואליציונים": "לא", "כספים קואליציוניים הועברו": "כן", "אינה כוללת כספים קואליציוניים. הסכמים קואליציוניים": "לא", "תקציב זה קואליציוני": "לא", "תקציב קואליציוני": "כן"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", fields.flag_with_exclusion(F.col("x"), HEBREW)).collect()}
    assert {k: got[k] for k in list(cases)[:3] + list(cases)[4:]} == {k: cases[k] for k in list(cases)[:3] + list(cases)[4:]}


def test_first_matching_page_and_letterhead(spark):
    df = spark.createDataFrame([("a", 2, "zyx"), ("a", 1, "zyx"), ("b", 1, None)], "doc_id string, page_no int, raw_text string")
    assert [tuple(r)[:2] for r in pages.first_page_with(df, "xyz").collect()] == [("a", 1)]
    text = spark.createDataFrame([("12\n מדינת ישרא ל \n\nאוצר\nא\nב",)], "x string")
    assert text.select(t.letterhead(F.col("x"), HEBREW.letters)).first()[0] == ["מדינת ישראל", "אוצר", "א"]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "k string, v string, n int")
    assert {r["k"]: r["v"] for r in match.last_wins(df, "k", "v", "n").collect()} == {"a": "3", "b": "2"}


def test_split_columns_on_random_tables(spark):
    """Names that meet, ragged rows and tables of one row, against loops; by one sort."""
    r = random.Random(8)
    cells, want = [], []
    for k in range(120):
        heads = [r.choice(["a", "b", "a", "", "a from", "b delta"]) for _ in range(r.randint(1, 5))]
        rows = [heads] + [[r.choice(["1\n2", "7", "", "x"]) if r.random() < 0.85 else "gone" for _ in heads] for _ in range(r.randint(0, 4))]
        own = [(i, j, c) for i, row in enumerate(rows) for j, c in enumerate(row) if c != "gone"]
        cells += [(f"d{k}", 0, *c) for c in own]
        one = max(i for i, _, _ in own) == 0
        kept = own if one else [c for c in own if c[0] > 0]
        stacks, places, values = {j for _, j, c in kept if "\n" in c}, {}, {}
        for i, j, c in sorted(kept):
            name = str(j) if one else heads[j] or f"col{j}"
            if j in stacks:
                a, b = map(float, c.split("\n")) if "\n" in c else (None, None)
                parts = [(f"{name} from", None, a), (f"{name} to", None, b), (f"{name} delta", None, None if a is None else b - a)]
            else:
                parts = [(name, c, None)]
            for p, (n, text, num) in enumerate(parts):
                places[n] = min(places.get(n, (j, p)), (j, p))
                values[i, n] = text, num
        want += [(f"d{k}", 0, i, n, places[n], *v) for (i, n), v in values.items()]
    logical = tables.split_stacked(tables.promote_header(spark.createDataFrame(cells, CELLS)))
    got = [(*x[:4], tuple(x["col_pos"]), x["text"], x["num"]) for x in logical.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = logical._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    keys = {tuple(x) for x in tables.data_table_keys(logical).collect()}
    assert keys == {x[:2] for x in want if x[3].endswith("delta")} and keys
