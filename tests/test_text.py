import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as t
from scriptorium.profile import HEBREW


def run(spark, body, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(body(F.col("x"))).collect()]


CASES = {
    "unreverse": (t.unreverse_numbers, {"011540": "045110", "832,84": "48,238", "x 832,84. y": "x .48,238 y", "12a34.": "21a.43", "": "", None: None}),
    "number": (t.parse_number, {"1,539,800": 1539800.0, "461.5": 461.5, "-3": -3.0, "+3": None, "5-": None, "1e3": None, ".5": None, "(5)": None, "": None, " 7\n": 7.0, None: None}),
    "pad": (t.zero_pad_code, {"45211": "045211", "1234567": "1234567", "-12": "-00012", "": "000000", None: None}),
    "lines": (t.split_lines, {"a\nb\n": ["a", "b"], "": [], "a\r\nb c": ["a", "b", "c"], "\n": [""], None: None}),
    "normal": (t.normalize_text, {"  a  12/05/2026\n b": "a //00122256 b", None: None}),
    "strip": (t.strip_ws, {"  a b\x1c\n": "a b", "": "", None: None}),
    "rejoin": (lambda x: t.rejoin_final_letter(x, HEBREW.letters), {"האוצר - אגף התקציבי ם": "האוצר - אגף התקציבים"}),
    "name": (t.clean_name, {"ב א \n===\nד": "א ב ד", None: "", "--": ""}),
    "links": (t.decision_links, {"http://a/dec1 http://b/dec1 http://c/dec_2). zz": ["http://a/dec1", "http://c/dec_2"], "": []}),
    "slug": (t.url_slug, {"http://a/b/c12_34.pdf": "34", "http://a/b/ex am.pdf": "ex_am", "http://a/": "doc", "http://a/תקציב.pdf": "_", None: "doc"}),
    "key": (t.url_cache_key, {"ftp://x": None, None: None}),
    "escape": (t.escape_lines, {"a<b&\nc>": "a&lt;b&amp;<br/>c&gt;", "": " ", None: " "}),
    "section": (lambda x: t.section_between(x, "S:", ["E", "F"]), {"a S: b F c E": "b", "S: x": "x", "none": "", "": "", None: None}),
    "numbered": (lambda x: t.numbered_join(F.split(x, " ")), {"a b": "1. a\n2. b"}),
    "anchor": (lambda x: t.first_anchor(x, ["b", "a"]), {"a b": "b", "a": "a", "c": None}),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    body, cases = CASES[name]
    assert run(spark, body, cases) == list(cases.values())


def test_thousands(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1539800.4,)], "x double")
    assert [r[0] for r in df.select(t.format_thousands(F.col("x"))).collect()] == ["0", "2", "2", "1,539,800"]


TEXTS = st.lists(st.text(alphabet="ab 1.,/\n\tא ", max_size=30), min_size=20, max_size=40)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_against_python(spark, xs):
    assert run(spark, t.unreverse_numbers, xs) == [re.sub(r"\d[\d.,/]*", lambda m: m[0][::-1], x) for x in xs]
    assert run(spark, t.split_lines, xs) == [x.splitlines() for x in xs]
    assert run(spark, t.strip_ws, xs) == [x.strip() for x in xs]
    assert run(spark, t.collapse_ws, xs) == [" ".join(x.split()) for x in xs]
    once = run(spark, t.normalize_text, xs)
    assert run(spark, t.normalize_text, once) == once


SPACED = ["", " ", "x", " x", "x\u2003", "\x1c\x85x y\u00a0\n", "\u3000", "\u05d0 ", "\u05d0", "~", "!a b!", "\x7f", "a\u200bb\u200b", "\U0001f600\u1680", None]


def test_stripping_without_patterns(spark):
    """White space as str.strip sees it, by whichever way."""
    want = [v and v.strip() for v in SPACED]
    assert run(spark, t.strip_ws, SPACED) == want == run(spark, t.strip_cell, SPACED)
    plan = spark.range(1).select(t.strip_ws(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_sections_and_letterheads_of_odd_texts(spark):
    texts = ["a.(b\\Ec] x\ny;z", "a.(b\\E", "none", "a.(b\\Ec;z\u2028", "\ud7ff a.(b\\E  \u05d0 a.(b\\E ;", "", None]
    section = lambda v: v if v is None else v.split("a.(b\\E", 1)[1].split(";", 1)[0].split("]", 1)[0].strip() if "a.(b\\E" in v else ""
    assert run(spark, lambda x: t.section_between(x, "a.(b\\E", [";", "]"]), texts) == [section(v) for v in texts]
    heads = ["1\n" * 9 + " ab c\n2\nd\ne\nf", "a\r\n\rb\u2028\x1cc\x85d", "\n1\n\n", "", "x\ny", "a\nb\nc\nd", None]
    own = lambda v: v if v is None else [re.sub(r"(\S) ([a-z])(?=\s|\Z)", r"\1\2", line.strip()) for line in v.splitlines() if re.search("[a-z]", line)][:3]
    assert run(spark, lambda x: t.letterhead(x, "[a-z]"), heads) == [own(v) for v in heads]
