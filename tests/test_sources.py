import json
import urllib.error

import pandas as pd
import pytest

from scriptorium.sources import config, fetch, master, pdf, rest
from scriptorium.streaming.letters import SCHEMA, stream_fields


def listing(url, body):
    return [{"ReportUrl": f"{url}/{body['PageNumber']}/{k}"} for k in range(2)] if body["PageNumber"] <= 3 else []


@pytest.mark.parametrize("pages", [None, 3])
def test_rest_listing(spark, pages):
    rows = rest.list_reports(spark, "http://x", pages, listing).collect()
    assert sorted(r["ReportUrl"] for r in rows) == sorted(f"http://x/{p}/{k}" for p in (1, 2, 3) for k in (0, 1))


def test_download_retries():
    waits, replies = [], iter([urllib.error.URLError("a"), TimeoutError(), b"ok"])

    def opener(url):
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch.tried("u", opener, pause=waits.append) == (b"ok", None) and waits == [1, 2]

    def down(url):
        raise TimeoutError

    content, error = fetch.tried("u", down, pause=waits.append)
    assert content is None and error.startswith("u: 4 attempts") and waits == [1, 2, 1, 2, 4]

    def broken(url):
        raise ValueError("no such letter")

    assert fetch.tried("u", broken, pause=waits.append) == (None, "no such letter") and len(waits) == 5


def test_fetched_letters_are_handed_on_together():
    """Not a frame for each letter, nor more than so many bytes at once."""
    batch = lambda n: pd.DataFrame({"key": [str(k) for k in range(n)], "url": [f"http://a/{k}" for k in range(n)]})

    def opener(url):
        if url.endswith("7"):
            raise ValueError("no")
        return url.encode()

    frames = list(fetch.answers([batch(1000), batch(10)], opener, 1, None, 1 << 20))
    assert [len(f) for f in frames] == [1000, 10]
    assert [(r.key, r.content, r.error) for r in frames[1].itertuples()] == [(str(k), None, "no") if k == 7 else (str(k), f"http://a/{k}".encode(), None) for k in range(10)]
    assert [len(f) for f in fetch.answers([batch(5)], opener, 1, None, 20) if len(f)] == [2, 2, 1]


def test_fetch_and_cache(spark, tmp_path):
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("https://b/bad",), ("file.pdf",), (None,)], "url string")

    def opener(url):
        if "bad" in url:
            raise urllib.error.URLError("no")
        return url.encode()

    path = str(tmp_path / "cache")
    errors = fetch.fetch_missing(urls, path, opener, pause=lambda s: None)
    assert [r["url"] for r in errors.collect()] == ["https://b/bad"]
    assert {(r["url"], bytes(r["content"])) for r in fetch.cached(urls, path).collect()} == {("http://a/1", b"http://a/1")}

    def never(url):
        if "bad" not in url:
            raise AssertionError("it is in the cache")
        raise urllib.error.URLError("no")

    assert fetch.fetch_missing(urls, path, never, pause=lambda s: None).count() == 1


def test_cache_of_runs_at_the_same_time(spark, tmp_path):
    """Both miss a letter and add it; the first entry counts, in every later read, and
    an unfinished run is not seen."""
    path = str(tmp_path / "cache")
    urls = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://a/2",)], "url string")

    def slow(url):  # while this run fetches, another begins and ends
        return b"late"

    cache = fetch.cache_table(spark, path)
    missed = fetch.cache_misses(urls, cache).collect()
    assert len(missed) == 2
    assert fetch.fetch_missing(urls, path, lambda url: b"early").count() == 0
    fetch.add_to_cache(spark.createDataFrame([(r["key"], r["url"], bytearray(slow(r["url"]))) for r in missed], "key string, url string, content binary"), path)
    (tmp_path / "cache" / "run=lost" / "_temporary" / "0").mkdir(parents=True)
    assert fetch.cache_table(spark, path).count() == 4
    assert sorted((r["url"], bytes(r["content"])) for r in fetch.cached(urls, path).collect()) == [("http://a/1", b"early"), ("http://a/2", b"early")]
    assert fetch.cache_misses(urls, fetch.cache_table(spark, path)).isEmpty()


def test_the_cache_stays_where_it_lies(spark, tmp_path):
    """No exchange above a scan of the cache, neither for what misses nor for what is read."""
    path = str(tmp_path / "cache")
    urls = spark.createDataFrame([(f"http://a/{k}",) for k in range(50)], "url string")
    fetch.fetch_missing(urls, path, str.encode)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (fetch.cache_misses(urls, fetch.cache_table(spark, path)), fetch.cached(urls, path)):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            scans = [k for k, x in enumerate(lines) if "FileScan parquet" in x]
            assert scans
            for k in scans:
                above, now = [], depth(lines[k])
                for x in reversed(lines[:k]):
                    if depth(x) < now:
                        above.append(x)
                        now = depth(x)
                joins = [n for n, x in enumerate(above) if "Join" in x]
                assert not any("Exchange" in x for x in above[: joins[0]]), "\n".join(lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pdf_scan(spark):
    def parser(content):
        if content != b"ok":
            yield [("seen", 0, 1, 0, 1)], []
            raise ValueError("no header")
        grid = [(0, 100, y, y) for y in (0, 20, 40)] + [(x, x, 0, 40) for x in (0, 50, 100)]
        yield [("h", 5, 9, 4, 14), ("1", 5, 9, 24, 34), ("2", 55, 59, 24, 34)], grid
        yield [], []

    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad")), ("c", bytearray())], "doc_id string, content binary")
    scanned = pdf.scan(files, parser, rows_at_once=3)
    assert {tuple(r) for r in pdf.page_text(scanned).collect()} == {("a", 0, "h\n1 2"), ("a", 1, None)}
    assert {(r["row_no"], r["col_no"], r["text"]) for r in pdf.cells(scanned).collect()} == {(0, 0, "h"), (0, 1, ""), (1, 0, "1"), (1, 1, "2")}
    assert {tuple(r) for r in pdf.errors(scanned).collect()} == {("b", "scan", "no header"), ("c", "scan", "no header")}
    assert [r["message"] for r in pdf.errors(pdf.scan(files.limit(1), lambda c: iter(()))).collect()] == ["no pages"]


def test_master(spark, tmp_path):
    rows = spark.createDataFrame([(45211, "a"), (45211, "b"), (None, "blank"), (1234567, "c")], f"`{master.KEY}` int, `{master.NAME}` string")
    good, bad = master.master_table(rows.coalesce(1))
    assert {tuple(r) for r in good.collect()} == {("045211", "b"), ("1234567", "c")} and bad.count() == 1
    rows.write.parquet(str(tmp_path / "m"))
    assert master.load_master(spark, str(tmp_path / "m"))[0].count() == 2
    with pytest.raises(ValueError):
        master.master_table(rows.drop(master.NAME))
    with pytest.raises((FileNotFoundError, ImportError)):
        master.load_master(spark, str(tmp_path / "none.xlsx"))


def test_master_of_several_files_in_any_pieces(spark, tmp_path):
    """The last row wins, by file name and place, though files are cut into small pieces
    and large ones are read first."""
    rows = [[(k % 40, f"{f}-{k}") for k in range(n)] for f, n in enumerate((30, 900, 35))]
    for f, own in enumerate(rows):
        (tmp_path / f"m{f}.csv").write_text(f"{master.KEY},{master.NAME}\n" + "".join(f"{a},{b}\n" for a, b in own))
    want = {str(a).zfill(6): b for own in rows for a, b in own}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = master.load_master(spark, f"{tmp_path}/*.csv")
            assert {r["code"]: r["name"] for r in good.collect()} == want and bad.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mailing_list": [], "notifier": {"email": "a@b.example", "password": "hunter2"}, "programs": [{"key": "1", "name": "a"}, {"key": "1", "name": "b"}]}))
    c = config.Config.load(str(path))
    assert c.ids() == {"1": "b"} and "hunter2" not in repr(c)
    c.set(mailing_list=["x@y.example"], model_name="m")
    c.set_master({"045211": "p"}, "/some/master.xlsx")
    again = config.Config.load(str(path))
    assert (again.mailing_list, again.model_name, again.last_master_filename) == (["x@y.example"], "m", "master.xlsx")
    for bad in ({"model_name": ""}, {"mailing_list": "x"}, {"notifier": {"email": "a"}}):
        with pytest.raises(ValueError):
            c.set(**bad)
    assert [tuple(r) for r in config.programs(config.read_config(spark, str(path))).collect()] == [("045211", "p")]
    path.write_text("{}")
    with pytest.raises(KeyError):
        config.Config.load(str(path))


def test_env(tmp_path, monkeypatch):
    monkeypatch.setenv("SCRIPTORIUM_A", "kept")
    f = tmp_path / ".env"
    f.write_text("# c\n\nSCRIPTORIUM_A=new\nSCRIPTORIUM_B = x=y\n")
    assert config.load_env(str(f)) == {"SCRIPTORIUM_B": "x=y"}


def test_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in (1, 2):
        spark.createDataFrame([(f"d{k}", "http://x/dec1", "")], SCHEMA).write.mode("append").parquet(source)
        stream_fields(spark, source, sink, state).awaitTermination()
        assert spark.read.parquet(sink).count() == 8 * k
