import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import common, warc
from scriptorium.llm import exact_dedup as ed
from scriptorium.llm import kd_shards as kd
from scriptorium.llm import line_chunks as lc
from scriptorium.llm import line_frequency as lf
from scriptorium.llm import line_runs as lr
from scriptorium.llm import mixing as mx
from scriptorium.llm.common import sized_join, written
from scriptorium.llm.jaccard_join import jaccard_classes

from .conftest import SCHEMA, WORDS, edge_rows, text

WS = re.compile(r"[\x20\x09-\x0D]")


def words(t):
    return [w for w in WS.split(t or "") if w]


# exact dedup


def test_exact_dedup_edges(spark, edges, nothing):
    groups = defaultdict(list)
    for r in edge_rows():
        groups[WS.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] if r[0] is not None else 1e9, r[0]))
    got = ed.exact_dedup(edges).collect()
    assert len(got) == len(edge_rows())
    seen = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(seen.values()) == {1} and len(seen) == len(groups)
    for norm, rows in groups.items():
        digest = hashlib.sha256(norm.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == digest]
        assert len(mine) == len(rows) and {r["group_size"] for r in mine} == {len(rows)} and {r["keep_id"] for r in mine} == {min(rows)[2]}
    assert ed.exact_dedup(nothing).count() == 0


def test_exact_dedup_state_goes_on(spark, tmp_path):
    log, state = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "a  b"), (4, "d")], "doc_id long, text string")
    one, two = (written(x, "test-docs") for x in (one, two))
    ed.fingerprints(one).write.mode("append").parquet(log)
    ed.update_state(spark, log, state)
    assert ed.read_state(spark, state).filter("group_size > 1").count() == 0
    ed.fingerprints(two).write.mode("append").parquet(log)
    ed.update_state(spark, log, state)
    hit = ed.read_state(spark, state).filter("group_size > 1").collect()
    assert [(r["keep_id"], r["group_size"]) for r in hit] == [(3, 2)]
    assert ed.read_state(spark, state).count() == 3


def test_exact_dedup_of_later_rows(spark, tmp_path):
    """Rows that come later decide with the earlier ones; of equal ones just one stays."""
    log, state = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    schema = "doc_id long, text string"
    ed.exact_dedup(spark.createDataFrame([(2, "a b"), (7, "c")], schema).coalesce(1), log, state)
    got = ed.exact_dedup(spark.createDataFrame([(1, "a b"), (7, "c")], schema).coalesce(1), log, state).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(1, 1, 2), (2, 1, 2), (7, 7, 2), (7, 7, 2)]
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 7]


def test_exact_dedup_over_several_batches(spark, tmp_path):
    """A batch for each file of the log gives what one batch gives."""
    import os

    df = spark.createDataFrame([(k, f"text {k % 37}" + " " * (k % 3)) for k in range(400)], "doc_id long, text string").repartition(6)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    got = ed.exact_dedup(df, f"file://{tmp_path}/log", f"file://{tmp_path}/state", bytes_per_batch=1).select(columns).collect()
    assert len(os.listdir(tmp_path / "state" / "commits")) > 3
    assert Counter(got) == Counter(ed.exact_dedup(df).select(columns).collect())


def test_a_failed_call_is_taken_up(spark, tmp_path, monkeypatch):
    """Repeated with the same rows after a failure between the log and the state, or within
    the log, it gives what one call gives; so does a call that is made twice."""
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (None, None)], "doc_id long, text string").repartition(2)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    want = Counter(ed.exact_dedup(rows).select(columns).collect())
    update = ed.update_state

    def fails(*args):
        raise RuntimeError("lost")

    for k, broken in enumerate((False, True)):
        log, state = f"file://{tmp_path}/log{k}", f"file://{tmp_path}/state{k}"
        monkeypatch.setattr(ed, "update_state", fails)
        with pytest.raises(RuntimeError):
            ed.exact_dedup(rows, log, state)
        monkeypatch.setattr(ed, "update_state", update)
        if broken:
            next((tmp_path / f"log{k}").glob("call=*/_SUCCESS")).unlink()
        for _ in range(2):
            assert Counter(ed.exact_dedup(rows, log, state).select(columns).collect()) == want
    more = ed.exact_dedup(spark.createDataFrame([(9, "c ")], rows.schema), log, state)
    assert Counter(r["group_size"] for r in more.collect()) == {2: 2, 3: 3, 1: 1}


def test_locators_clash_with_no_column_format_or_path(spark, tmp_path):
    """Columns named like a locator's, files of other formats, names that look like
    patterns: through the operators that tell rows by their place."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "a  b c"), (3, "x"), (4, None)], "doc_id long, text string")
    for name in ("_file", "_at", "_row", "_no", "_metadata", "__row", "file", "at", "row", "a.b"):
        rows = rows.withColumn(name, F.lit("clash"))
    want = {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)}
    for kind, frame in (("parquet", rows), ("parquet", rows.drop("_metadata")), ("json", rows), ("orc", rows), ("csv", rows)):
        path = f"{tmp_path}/x[1]{{a,b}} {kind}{len(frame.columns)}"
        frame.coalesce(1).write.format(kind).option("header", True).save(path)
        escaped = "".join("\\" + c if c in "[]{}," else c for c in path)
        docs = spark.read.format(kind).schema(frame.schema).option("header", True).load(escaped)
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.exact_dedup(docs).collect()} == want, kind
        assert {(r["doc_id"], r["component_id"]) for r in jaccard_classes(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}, kind


def test_exact_dedup_checks_bytes(spark, monkeypatch, tmp_path):
    """With a digest that two texts share, decisions are made on the bytes, which are
    fetched by the locator, those of earlier calls too."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    short = lambda text, _: F.when(text.isNotNull(), "same")
    want = {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}
    plain = ed.exact_dedup(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in plain.collect()} == want
    monkeypatch.setattr(ed.F, "sha2", short)
    once = ed.exact_dedup(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in once.collect()} == want
    log, state = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    ed.exact_dedup(rows.filter("doc_id = 1"), log, state)
    later = ed.exact_dedup(rows.filter("doc_id > 1"), log, state)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in later.collect()} == want


def test_texts_stay_where_they_lie(spark, monkeypatch, tmp_path):
    """With decisions beyond the limit, files are taken in rounds whose joins are
    broadcast and read these files alone; only a file with more by itself is shuffled.
    Results are those of one broadcast."""
    r = random.Random(8)
    lines = [" ".join(r.choices(WORDS, k=6)) for _ in range(40)]
    made = lambda: "\n".join(lines[(k := r.randrange(34)) : k + r.randint(2, 6)])
    rows = [(i, made() if i % 3 else f"only {i}", f"_{i % 5}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, _file string").repartition(6, "doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat("text", F.repeat(F.lit("-"), 100)).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    results = lambda: [
        Counter(map(tuple, ed.exact_dedup(docs).drop("file", "at").collect())),
        Counter(map(tuple, lc.dedup_line_chunks(docs).collect())),
        Counter(map(tuple, lr.dedup_line_runs(docs).collect())),
        Counter((x["page_id"], x["refers_to"], bytes(x["payload"])) for x in warc.with_revisits(pages).collect()),
    ]
    want, plans, join = results(), [], common.sized_join

    def seen(left, right, *more):
        out = join(left, right, *more)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(common, "sized_join", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is not asked for is not broadcast
    try:
        for limit, shuffled in ((9000, False), (300, True)):
            plans.clear()
            monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
            assert results() == want
            assert len(plans) > 5
            moves = [bool(re.search(r"(?<!Broadcast)Exchange hashpartitioning", x)) for x in plans]
            assert any(moves) == shuffled, limit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# line frequency


def brute_repeats(ws):
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_base_rules_edges(spark, edges, nothing):
    more = ["x " * 40, text(4, 20) + "\n" + text(4, 20), "a b c d e f g h " * 3 + text(5, 30), "# | <\n\n# | <\n x"]
    docs = edges.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(100 + k, t, "s") for k, t in enumerate(more)], "doc_id long, text string, source string"))
    got = {(r["doc_id"], r["text"]): r for r in lf.base_rules(docs).collect()}
    for (_, t), r in got.items():
        ws = words(t)
        spoken = [x for x in (t or "").split("\n") if words(x)]
        n = brute_repeats(ws)
        want = (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(spoken) - len(set(spoken)), n, len(ws) < 20 or 100 * n > 30 * len(ws))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, t
    assert lf.line_verdicts(nothing).count() == 0 and lf.line_verdicts(edges).count() == edges.count()


def test_line_frequency_brute_force(spark):
    docs = [(k, ("Common  LINE of the site here\n" * (k % 3 != 0)) + text(k % 40, 30) + ("\nfoot er" if k % 2 else ""), f"h{k % 2}") for k in range(80)]
    docs += [(100 + k, "\n".join(text(7, 32).split("\n")) + f"\nown {k}", "h0") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    norm = lambda x: " ".join(words(x.lower()))
    hosts, held = defaultdict(set), defaultdict(set)
    for _, t, h in docs:
        hosts[h].add(t)
        for x in t.split("\n"):
            held[h, norm(x)].add(t)
    often = {k for k, v in held.items() if len(v) > 10 and 100 * len(v) > 5 * len(hosts[k[0]])}
    assert often
    got = {r["doc_id"]: r for r in lf.line_verdicts(df, 10, 5).collect()}
    for d, t, h in docs:
        gone = [x for x in t.split("\n") if (h, norm(x)) in often]
        left = len(words(t)) - sum(len(words(x)) for x in gone)
        assert (got[d]["removed_lines"], got[d]["removed_words"]) == (len(gone), len(words(t)) - left)
        assert got[d]["kept"] == (not got[d]["base_failed"] and left >= 10 and 100 * left >= 20 * len(words(t)))
    assert not got[100]["kept"] and got[1]["kept"]
    rows = lf.base_rules(df.withColumn("host", F.concat(F.lit("="), "source"))).withColumn("text_hash", F.xxhash64("text"))
    clean = lf.cleaned(df, lf.frequent_lines(rows, 10, 5)).collect()
    assert {r["doc_id"]: r["text"] for r in clean} == {d: "\n".join(x for x in t.split("\n") if (h, norm(x)) not in often) for d, t, h in docs}


# line chunks


def brute_chunks(t):
    lines = (t or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for i, x in enumerate(lines):
        now.append(x)
        mark = lambda i: (h[i] + (31 * h[i - 1] if i else 0)) % 2147483647 % 2 == 0
        if i + 1 == len(lines) or mark(i) and not (i and mark(i - 1)):
            out.append(now)
            now = []
    return out


def brute_extended(docs):
    """doc_id -> removed chunks, removed lines, text left; docs: distinct doc_ids."""
    seen, paired, out = set(), brute_runs(docs), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        n, at, chunked = 0, 0, set()
        for c in brute_chunks(t):
            body, multi = "\n".join(c), sum(bool(words(x)) for x in c) >= 2
            if multi and body in seen:
                n += 1
                chunked |= set(range(at, at + len(c)))
            seen |= {body} if multi else set()
            at += len(c)
        lines, gone, run = (t or "").split("\n"), set(), []
        for i in range(len(lines) + 1):
            if i in chunked | paired[d]:
                run.append(i)
            else:
                if chunked & set(run) or sum(len(words(lines[j])) for j in run) >= 30:
                    gone |= set(run)
                run = []
        out[d] = (n, len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


def test_line_chunks_brute_force(spark, edges, nothing):
    shared = text(50, 200)
    docs = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] != 3] + [(200 + k, text(60 + k, 16 * k) + "\n" + shared + "\n" + text(90 + k, 40)) for k in range(6)]
    want = brute_extended(docs)
    got = {r["doc_id"]: (r["removed_chunks"], r["removed_lines"], r["text"]) for r in lc.dedup_line_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 20
    out = lc.dedup_line_chunks(edges)
    assert out.count() == edges.count() and set(out.columns) == {*edges.columns, "n_lines", "n_chunks", "removed_chunks", "removed_lines"}
    clash = spark.createDataFrame([(1, "a", 5, "p", "g", 3)], "doc_id long, text string, key int, parts string, gone_lines string, n_chunks int")
    assert lc.dedup_line_chunks(clash).first().asDict() == {"doc_id": 1, "text": "a", "key": 5, "parts": "p", "gone_lines": "g", "n_lines": 1, "n_chunks": 1, "removed_chunks": 0, "removed_lines": 0}
    assert lc.dedup_line_chunks(nothing).count() == 0


def test_blocks_of_equal_lines(spark):
    """Blocks of equal lines, or of two in turn, are not cut at each line and go from copies."""
    docs = [(k, "\n".join([f"line {k // 3}"] * 30)) for k in range(30)] + [(100 + k, "\n".join([f"a {k // 3}", "c d"] * 15)) for k in range(30)]
    got, want = {r["doc_id"]: r for r in lc.dedup_line_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}, brute_extended(docs)
    for d, t in docs:
        assert got[d]["n_chunks"] <= 16
        if d % 100 % 3:
            assert got[d]["removed_lines"] >= 28
        assert got[d]["text"] == want[d][2]


def test_insertions_move_few_boundaries():
    a = text(70, 800).split("\n")
    b = a[:40] + ["something new"] + a[40:]
    cut = lambda x: Counter("\n".join(c) for c in brute_chunks("\n".join(x)))
    assert sum((cut(a) - cut(b)).values()) <= 3


# line runs


def brute_runs(docs):
    """doc_id -> numbers of the lines that go; docs: distinct doc_ids."""
    at = defaultdict(list)
    for d, t in sorted(docs):
        lines = (t or "").split("\n")
        worded = [i for i, x in enumerate(lines) if words(x)]
        for a, b in zip(worded, worded[1:]):
            at["\n".join(lines[a : b + 1])].append((d, a, b))
    cover = lambda places: {(d, i) for d, a, b in places for i in range(a, b + 1)}
    gone = cover(x for v in at.values() for x in v[1:]) - cover(v[0] for v in at.values() if len(v) > 1)
    return {d: {i for e, i in gone if e == d} for d, _ in docs}


def test_line_runs_find_short_passages_at_any_offset(spark):
    """Passages of 2 to 6 whole lines; extended chunks find those of 30 words."""
    docs = []
    for n in range(2, 7):
        shared = text(300 + n, 8 * n)
        docs += [(1000 * n + k, text(400 + 10 * n + k, 8 * k + 16) + "\n" + shared + "\n" + text(500 + 10 * n + k, 40)) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in lr.dedup_line_runs(df).collect()}
    for d, t in docs:
        n, k = divmod(d, 1000)
        assert got[d] == ((n, "\n".join(t.split("\n")[: k + 2] + t.split("\n")[k + 2 + n :])) if k else (0, t))
    extended = {r["doc_id"]: r["text"] for r in lc.dedup_line_chunks(df).collect()}
    assert all(extended[d] == got[d][1] for d, t in docs if len(words(t)) - len(words(got[d][1])) >= 30)
    assert any(extended[d] == t for d, t in docs if d % 1000)


def test_line_runs_brute_force(spark, edges, nothing):
    docs = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] != 3]
    docs += [(200 + k, "\n".join(["a", "b", "", "c", "d"][k % 3 : 3 + k % 4] * (1 + k % 3))) for k in range(12)] + [(300, "ha\nha\nha"), (301, "z\na"), (302, "z\na\nb"), (303, "a\nb\n\n")]
    want = brute_runs(docs)
    got = {r["doc_id"]: r for r in lr.dedup_line_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        lines = (t or "").split("\n")
        assert (got[d]["n_lines"], got[d]["removed_lines"]) == (len(lines), len(want[d]))
        assert got[d]["text"] == ("\n".join(x for i, x in enumerate(lines) if i not in want[d]) if want[d] else t)
    out = lr.dedup_line_runs(edges)
    assert out.count() == edges.count() and set(out.columns) >= {"doc_id", "text", "kept", "size", "host"}
    assert lr.dedup_line_runs(nothing).count() == 0


# sharding


def test_kd_shards_edges(spark, edges, nothing):
    rows = kd.kd_shards(edges, n_shards=5).collect()
    assert len(rows) == edges.count() and {r["shard"] for r in rows} <= set(range(5))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert kd.kd_shards(nothing, n_shards=5).count() == 0
    one = spark.createDataFrame(edge_rows()[:1], SCHEMA)
    assert kd.kd_shards(one, n_shards=5).count() == 1


def test_kd_shards_are_even_and_split_in_space(spark):
    rows = [(k, "x" * (k * 7 % 300), "en", f"s{k % 4}" if k % 3 else "hot", k * 7 % 300) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (7, 16):
        sizes = kd.kd_shards(df, n_shards=n).groupBy("shard").agg(F.sum("size").alias("b")).collect()
        mean = sum(r["b"] for r in sizes) / n
        assert len(sizes) == n and all(abs(r["b"] - mean) < 0.03 * mean for r in sizes)
    total = sum(len(r[1]) + 16 for r in rows)
    assert kd.kd_shards(df, target_bytes=total // 9 + 1).select("shard").distinct().count() == 9
    again = kd.kd_shards(df.repartition(7), n_shards=7).select("doc_id", "shard")
    assert again.exceptAll(kd.kd_shards(df, n_shards=7).select("doc_id", "shard")).isEmpty()


def brute_tree(rows, n, spans):
    """Row number -> shard; rows: number -> (size, keys). Each part is split at the weighted
    median of its keys along its widest dimension."""
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update(dict.fromkeys(part, first))
            return
        place = lambda i, d: rows[i][1][d] >> kd.HASH_BITS
        wide = [(max(place(i, d) for i in part) - min(place(i, d) for i in part)) / spans[d] for d in range(len(spans))]
        d, total = wide.index(max(wide)), sum(rows[i][0] for i in part)
        goal, upto, by = total * ((n // 2) / n), 0, defaultdict(int)
        for i in part:
            by[rows[i][1][d]] += rows[i][0]
        for k in sorted(by):
            upto += by[k]
            if upto >= goal:
                cut = k if upto - goal <= goal - (upto - by[k]) else k - 1
                break
        split([i for i in part if rows[i][1][d] <= cut], first, n // 2)
        split([i for i in part if rows[i][1][d] > cut], first + n // 2, n - n // 2)

    split(list(rows), 0, n)
    return out


def test_kd_shards_brute_force(spark, edges):
    import random

    r = random.Random(5)
    rows = [(r.choice([None, r.randint(-5, 10**6)]) if k % 9 == 0 else k * 37 % 5003, "x" * r.choice([0, 3, 40, 41, r.randint(1, 900)]) + str(k % 50), r.choice(["en", "de", None]), r.choice(["hot"] * 5 + [f"s{k % 7}", None])) for k in range(3000)]
    many = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for df, n in ((many, 13), (many, 40), (many.drop("source", "n_chars"), 6), (edges, 5)):
        ranked = kd.with_ranks(df, *[c for c in ("source", "lang") if c in df.columns])
        raw = [list(x) for x in ranked.select((F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size"), kd.tie_hash().alias("tie"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "doc_id", *kd.dimensions(ranked).values()).collect()]
        lo, hi = [min(x) for x in zip(*[x[4:] for x in raw])], [max(x) for x in zip(*[x[4:] for x in raw])]
        keyed = {i: (x[0], [(v - a << kd.HASH_BITS) + x[1] for v, a in zip(x[4:], lo)]) for i, x in enumerate(raw)}
        shard = brute_tree(keyed, n, [max(b - a, 1) for a, b in zip(lo, hi)])
        want = Counter((x[3], x[2], shard[i]) for i, x in enumerate(raw))
        got = kd.kd_shards(df, n_shards=n, tolerance=0).collect()
        assert Counter((x["doc_id"], x["text_crc32"], x["shard"]) for x in got) == want


def test_kd_shards_tell_long_sources_apart(spark):
    """Sources that share their first bytes; no other dimension is as wide."""
    for name in ("source_%d", "https://site%d.example.org/"):
        rows = [(0, "x" * 20, "en", name % (k % 4), 20) for k in range(4000)]
        df = spark.createDataFrame([(7, t + str(k), *r) for k, (_, t, *r) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        shards = kd.kd_shards(df, n_shards=4).select("text_crc32", "shard")
        held = df.select(F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "source").join(shards, "text_crc32").groupBy("shard").agg(F.countDistinct("source").alias("n"), F.min("source").alias("s")).collect()
        assert len(held) == 4 and [r["s"] for r in sorted(held, key=lambda r: r["shard"])] == [name % k for k in range(4)]
        assert sum(r["n"] for r in held) <= 7


# mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(w[s] for s in order if s not in capped)
        out = {s: cap * sizes[s] if s in capped else w[s] * left / share for s in order}
        over = {s for s in order if s not in capped and out[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 3, "é": 700}, {"a": 0, "b": 0}, {"a": 1}, {None: 4, "z": 0}, {chr(97 + k): k * k for k in range(12)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mx.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_mixing_edges(spark, edges, nothing):
    rows = mx.mix_rates(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert {r["size"] for r in rows if r["text"] is None} == {0}
    out = mx.mixed(edges)
    assert out.columns == edges.columns and out.count() == sum(r["copies"] for r in rows)
    assert mx.mixed(nothing).count() == 0 and mx.mix_rates(nothing).count() == 0


def test_mixing_draws_once_with_the_fraction_as_probability(spark):
    rows = [(k, "w " * (k % 50 + 1), f"s{k % 5}") for k in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mix_rates(df).collect()
    by = defaultdict(list)
    for r in got:
        rate = r["target"] / r["source_size"]
        u = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["copies"] == int(rate) + (u < rate - int(rate))
        by[r["source"]].append(r)
    for mine in by.values():
        rate, n = mine[0]["target"] / mine[0]["source_size"], len(mine)
        f = rate - int(rate)
        extra = sum(r["copies"] - int(rate) for r in mine)
        assert abs(extra - f * n) <= 4 * (f * (1 - f) * n) ** 0.5 + 1e-9
        spread = (f * (1 - f) * sum(r["size"] ** 2 for r in mine)) ** 0.5
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 4 * spread + 1e-6
    # Draws of different sizes are alike: no document is favoured by its length.
    split = [r for r in got if 0 < (r["target"] / r["source_size"]) % 1 < 1]
    for half in (lambda r: r["size"] <= 25, lambda r: r["size"] > 25):
        part = [r for r in split if half(r)]
        f = [r["target"] / r["source_size"] % 1 for r in part]
        extra = sum(r["copies"] - int(r["target"] / r["source_size"]) for r in part)
        assert abs(extra - sum(f)) <= 4 * sum(x * (1 - x) for x in f) ** 0.5


def test_sized_join_beyond_the_limit(spark):
    a = spark.range(100)
    for limit, plan in ((10, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        j = sized_join(a, spark.range(50), ["id"], "inner", 8, limit)
        assert j.count() == 50 and plan in j._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
