import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import jaccard_join as jj
from scriptorium.llm import packing as pk
from scriptorium.llm import personal_data as pd_
from scriptorium.llm import queries
from scriptorium.llm import toxicity as tx
from scriptorium.llm import warc

from .conftest import edge_rows, text

# packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.default_vocabulary()[0])


def check_pieces(rows, docs, tokenizer, length=pk.LENGTH):
    """Each id once, pieces in order, windows without gaps; the share of padding."""
    ids = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in docs)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= length
    left = Counter()
    for (d, n), pieces in by_doc.items():  # copies of a document may be cut differently
        cover, whole = np.zeros(n, dtype=int), np.full(n, -1, dtype=np.int64)
        for p in pieces:
            own, at = np.frombuffer(p["ids"], "<u4").astype(np.int64), slice(p["start"], p["start"] + p["length"])
            assert ((whole[at] == -1) | (whole[at] == own)).all()
            whole[at] = own
            cover[at] += 1
        assert cover.min() == cover.max() > 0
        left[d, tuple(whole.tolist())] += int(cover[0])
    assert left == ids
    return 1 - sum(sum(n for _, n in w) for w in windows.values()) / length / len(windows)


def test_packing_edges(edges, nothing, tokenizer):
    docs = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    check_pieces(pk.pack(edges.filter("doc_id IS NOT NULL")).collect(), docs, tokenizer)
    assert pk.pack(edges).filter("doc_id IS NULL").count() == 2
    assert pk.pack(nothing).count() == 0


def test_packing_wastes_little_and_merges_leftovers(spark, tokenizer):
    r = random.Random(3)
    docs = [(k, text(k, r.randint(1, 700))) for k in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(24)
    check_pieces(pk.pack(df, windows=6, fan_in=3).collect(), docs, tokenizer)
    assert check_pieces(pk.pack(df).collect(), docs, tokenizer) < 0.01
    with_specials = [(1, "a <|endoftext|> b"), (2, "中文 テキスト"), (3, "naïve café — “quoted”…")]
    check_pieces(pk.pack(spark.createDataFrame(with_specials, "doc_id long, text string")).collect(), with_specials, tokenizer)


def test_both_encoders_agree(spark, tokenizer):
    """The faster encoder gives the tokenizer's ids for texts in Latin script."""
    encode, r = pk.encoder(pk.default_vocabulary()), random.Random(8)
    texts = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(chr(r.choice((r.randint(1, 0x24F), r.randint(9, 126), 32, 10))) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_open_windows_are_bounded():
    r, w, fill = random.Random(1), pk.OpenWindows(100, 4), Counter()
    for _ in range(5000):
        n = r.randint(1, 100)
        k, offset = w.place(n)
        assert fill[k] == offset and offset + n <= 100 and len(w.open) <= 4
        fill[k] += n


# WARC


def test_archives(spark, tmp_path):
    body = "<html>" + "y" * 200
    rows = [(5, "http://a b/\n", body), (3, None, body), (9, "u", body), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "n", body), (10, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 30), (11, "u", text(1, 30000)), (5, "again", body)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder, manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=50_000)
    got = warc.read_archives(spark, folder).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[3, "response"]["refers_to"] is None and bytes(by[3, "response"]["payload"]) == body.encode()
    for k in (5, 9, None):
        assert (by[k, "revisit"]["refers_to"], by[k, "revisit"]["payload_bytes"], by[k, "revisit"]["payload"]) == (3, len(body), None)
    assert {r["record_type"] for r in got if r["page_id"] in (1, 2, 7, 8, 10, 11)} == {"response"}
    assert by[5, "revisit"]["url"] in ("http://a%20b/%0A", "again") and bytes(by[10, "response"]["payload"]).decode() == rows[8][2]
    # What another attempt of a task left behind is not in the manifest and not read.
    import glob
    import shutil

    left = sorted(glob.glob(f"{tmp_path}/w/*.warc.zst"))
    shutil.copy(left[0], left[0].replace(".warc.zst", "0.warc.zst"))
    assert warc.read_archives(spark, folder).count() == len(rows)
    # A second run into the same folder adds to it.
    more = spark.createDataFrame([(99, "u", "z" * 300, "clash")], pages.schema)
    warc.write_archives(more, folder)
    assert warc.read_archives(spark, folder).count() == len(rows) + 1
    assert not glob.glob(f"{tmp_path}/w/.part*.zst")
    empty = pages.limit(0)
    folder, manifest = warc.write_archives(empty, f"file://{tmp_path}/none")
    assert manifest.count() == 0 == warc.read_archives(spark, folder).count()


def test_archive_layout():
    import zstandard

    records = [warc.format_record(k, f"http://x/{k}", text(k, 80).encode(), "0" * 64, None) for k in range(200)]
    content = warc.format_archive(records)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and content[8:12] == b"\x37\xa4\x30\xec"
    assert [b for _, b in warc.read_archive(content)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]
    # each record is a frame that reads alone with the dictionary
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])).decompressobj()
    assert reader.decompress(content[8 + size :]) == records[0] and reader.unused_data
    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(content) - size < 0.9 * plain
    assert [b for _, b in warc.read_archive(warc.format_archive(records[:1]))]
    damaged = warc.format_archive([warc.format_record(1, "u", b"abc", "0" * 64, None)])
    assert len(list(warc.read_archive(damaged))) == 1


# Jaccard join


def brute_components(docs, n, num):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n_docs):
    """Chains and stars of near copies of several lengths, with shared passages."""
    r, docs, passage = random.Random(seed), [], text(999, 40)
    while len(docs) < n_docs:
        base = text(r.random(), r.choice([2, 4, 8, 20, 60, 66, 70, 150, 400])).split(" ")
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 50)}"
            if r.random() < 0.3:
                base = copy
            docs.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy) + (("\n" + passage) if r.random() < 0.2 else ""))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_jaccard_brute_force(spark, n, num, seed):
    docs = near_copies(seed, 350)
    want = brute_components(docs, n, num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), n, num).collect()}
    assert got == want and len({c for _, c in want.values()}) < 320


def test_jaccard_edges(spark, edges, nothing):
    rows = jj.jaccard_classes(edges).collect()
    assert len(rows) == edges.count()
    want = brute_components([(r[0], r[1]) for r in edge_rows() if r[0] is not None], 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert jj.jaccard_classes(nothing).count() == 0


def test_jaccard_of_one_id_with_several_texts(spark):
    """A document has the links of all rows that repeat its doc_id."""
    a, b, c = text(11, 80), text(12, 80), text(13, 80)
    docs = [(7, a), (2, b), (9, a + " x"), (9, b + " x"), (9, b + " x"), (5, c), (5, None), (4, c + " y"), (4, text(14, 70)), (None, a)]
    rows = jj.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 5, 80).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str)
    assert got == sorted([(7, 2), (2, 2), (9, 2), (9, 2), (9, 2), (5, 4), (5, 5), (4, 4), (4, 4), (None, None)], key=str)


def test_jaccard_repeated_copies(spark):
    """Rows that repeat a document which is a copy of another come out once each."""
    docs = [(1, text(8, 80)), (5, text(8, 80)), (5, text(8, 80)), (6, text(8, 80) + " x"), (6, text(8, 80) + " x")]
    rows = jj.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (5, 1), (5, 1), (6, 1), (6, 1)]


def test_prefixes_reach_beyond_counted_tokens(spark):
    """Documents without counted tokens, or none that others have, keep the rest of their
    prefixes: 64 - ceil(0.8 * 64) + 1 = 13 tokens."""
    schema = "doc long, n long, large array<long>, beyond array<long>, small array<long>"
    rest = list(range(100, 126, 2))
    rows = [(1, 64, [], rest, []), (2, 64, [2], rest[:12], []), (3, 64, [4, 6], rest[:11], []), (4, 64, [8], [], [])]
    got = defaultdict(set)
    for r in jj._postings(spark.createDataFrame(rows, schema), 80, 100).collect():
        got[r["doc"]].add(r["token"])
    assert dict(got) == {1: set(rest), 2: set(rest[:12]), 3: set(rest[:11])}


# personal data


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            v = int(c) * (1 + k % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    r = random.Random(7)
    texts = ["".join(r.choice("a1.@_-+ ()5") for _ in range(r.randint(0, 60))) for _ in range(6000)]
    texts += ["4041894974608795 x a.b@c.d-e.f_g@h.i", "4041-8949 7460-8795", "+1 (414) 555-3519", "1.2.3.4.5", "0001.2.3.255 256.1.1.1", "1" * 5000 + ".1.1.1"]
    for t in texts[:-1]:
        assert pd_.base_spans(t) == brute_spans(t), t
    assert pd_.base_spans(texts[-1]) == []


def test_field_on_held_out_rows():
    field = pd_.train()
    found = wanted = right = 0
    for row in pd_.labelled_table(500, seed=77):
        scores = field.scores([w for w, _ in row])[None]
        tags = [pd_.LABELS[y] for y in pd_.viterbi(scores, field.moves)[0]]
        found += sum(x != "O" for x in tags)
        wanted += sum(y != "O" for _, y in row)
        right += sum(x == y != "O" for x, (_, y) in zip(tags, row, strict=True))
    assert right > 0.97 * wanted and right > 0.97 * found


def test_field_on_other_wording():
    """Wording that the labelled table does not make: links are no secrets, numbers of
    several countries are phones, a long word's shape counts at any number of runs."""
    spans = lambda t: [(k, t[a:b]) for k, a, b in pd_.field_spans([t], pd_.train())[0]]
    for t in ("see https://x.org/a?id=1234567890abcdef for more", "x = https://x.org/a?id=1234567890abcdef", 'url: "https://ex.com/p/9f8a7b6c5d4e3f2a"', "page 123-4567 of the register", "between 1914 and 1918, 12 345 people", "commit 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f00 fixed"):
        assert spans(t) == [], t
    for t in ("030 1234567", "555-0142", "020 7946 0958", "089/12345678"):
        assert spans(f"call {t} today") == [("phone", t)]
    for t in ("api_key = {}", "AWS_KEY={}", "Authorization: Bearer {}"):
        assert spans(t.format("9f8a7b6c5d4e3f2a1b0c9d8e")) == [("secret", "9f8a7b6c5d4e3f2a1b0c9d8e")], t
    assert pd_.shape("a-1." * 20 + "=") != pd_.shape("a_1," * 20 + ":")


def test_viterbi_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    moves = rng.normal(size=(4, 4))
    scores = rng.normal(size=(6, 5, 4))
    best = pd_.viterbi(scores, moves)
    for s, y in zip(scores, best, strict=True):
        value = lambda p, s=s: moves[0, p[0]] + sum(s[t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) + moves[p[-1], 0]
        assert tuple(y) == max(itertools.product(range(4), repeat=5), key=value)


def test_decoding_agrees_with_viterbi_over_whole_texts():
    """Runs that are decoded alone give the labels of the whole text's best path."""
    field, r = pd_.train(), random.Random(6)
    texts = [text(k, r.randint(0, 40)).split() for k in range(40)]
    for row in pd_.labelled_table(120, seed=5):
        texts[r.randrange(40)] += [w for w, _ in row]
    texts += [[], ["1"] * 40, ["4041894974608795"] * 30, ["+1", "(414)", "555-3519"] * 9, ["x=" + "ab1" * 500], ["token", "=", '"' + "a1" * 20 + '"']]
    got = field.decode(texts)
    n = 0
    for k, words in enumerate(texts):
        plain = [] if not words else [pd_.LABELS[y] for y in pd_.viterbi(field.scores(words)[None], field.moves)[0]]
        assert [got.get(k, {}).get(i, "O") for i in range(len(words))] == plain
        n += sum(y != "O" for y in plain)
    assert n > 150


def test_added_spans_on_the_test_tables(spark):
    """Secrets that the tables plant (a name, =, a quoted value) are found; other added
    spans are few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    wanted = {(d, *m.span(1)) for d, t in texts.items() for m in given.finditer(t)}
    rows = pd_.personal_data(docs).collect()
    spans = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in rows for x in r["spans"].split(",") if x.startswith("secret:")}
    assert len(wanted) > 5 and len(wanted & spans) >= 0.9 * len(wanted) and len(spans - wanted) <= 0.1 * len(wanted) + 1
    more = sum(r["n_spans"] - r["n_secret"] - sum(r[f"n_{k}"] for k in pd_.BASE_KINDS) for r in rows)
    assert 0 <= more <= 0.1 * sum(r[f"n_{k}"] for r in rows for k in pd_.BASE_KINDS)
    for r in rows:  # the whole span passes the exact check
        for x in filter(None, r["spans"].split(",")):
            kind, a, b = x.split(":")
            assert pd_.plausible(kind, texts[r["doc_id"]][int(a) : int(b)])


def test_spans_that_exceed_the_base():
    base = [("email", 5, 10), ("ip", 20, 30)]
    more = [("email", 3, 10), ("email", 5, 10), ("phone", 8, 12), ("ip", 18, 31), ("card", 10, 20), ("ip", 3, 31), ("secret", 30, 40)]
    assert pd_.added_spans(base, more) == [("email", 3, 10), ("ip", 18, 31), ("card", 10, 20), ("secret", 30, 40)]
    assert pd_.added_spans([], more[:1]) == more[:1] and pd_.added_spans(base, []) == []


def test_personal_data_edges(spark, edges, nothing):
    rows = pd_.personal_data(edges).collect()
    assert len(rows) == edges.count()
    base = Counter((d, pd_.joined(brute_spans(t or ""))) for d, t, *_ in edge_rows())
    assert Counter((r["doc_id"], r["base"]) for r in rows) == base
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in rows)
    df = spark.createDataFrame([(1, "call (414) 555-3519 now"), (2, "in 1999 about 12 of 300, v2.0.1"), (3, "x +1 (826) 555-4081 190.137.223.204")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pd_.personal_data(df).collect()}
    assert got == {1: "phone:5:19", 2: "", 3: "ip:20:35,phone:2:19"}
    assert pd_.personal_data(nothing).count() == 0


# toxicity


def labelled(n, seed):
    """Documents and three categories, the later ones mostly where the earlier are."""
    r, rows = random.Random(seed), []
    for k in range(n):
        insult = r.random() < 0.3
        threat = insult and r.random() < 0.6
        severe = threat and r.random() < 0.7
        t = text(r.random(), r.randint(5, 80)).split(" ") + ["fool"] * insult + ["hurtyou"] * threat + ["horrid"] * severe
        r.shuffle(t)
        rows.append((k, " ".join(t), int(insult), int(threat) if k % 7 else None, int(severe)))
    return rows


def test_chain_on_held_out_documents(spark):
    rows = labelled(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (2000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, insult int, threat int, severe int")
    chain = tx.train_chain(docs, labels, ("insult", "threat", "severe"), rows=1000, vocabulary=30)
    assert [len(w) for w in chain.weights] == [31, 32, 33]
    fresh = labelled(500, 2)
    got = {r["doc_id"]: r for r in tx.score(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), chain).collect()}
    for k, c in enumerate(("insult", "threat", "severe")):
        hits = sum((got[r[0]][f"p_{c}"] >= 0.5) == bool(r[2 + k]) for r in fresh if r[2 + k] is not None)
        assert hits > 0.97 * sum(r[2 + k] is not None for r in fresh)


def plain_logistic(x, y):
    """The same penalised likelihood by many small steps along its gradient."""
    x = np.hstack([x, np.ones((len(x), 1))])
    held = np.append(np.full(x.shape[1] - 1, 0.5), 1e-6)
    w = np.zeros(x.shape[1])
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + 0.5)
    v, t = w.copy(), 1.0
    for _ in range(60000):
        g = x.T @ (1 / (1 + np.exp(-(x @ v))) - y) + held * v
        new, s = v - step * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
        if np.abs(g).max() < 1e-9:
            break
    return w


def test_chain_against_brute_force():
    """Each later model is fitted on what models of the other folds say of a document. The
    words mark single documents, so models that had seen it would say something else."""
    rng = np.random.default_rng(3)
    n = 120
    x = np.hstack([rng.integers(0, 2, (n, 4)), np.eye(n)[:, ::2]]).astype(float)
    y1 = (rng.random(n) < 0.3 + 0.4 * x[:, 0]).astype(float)
    y2 = np.where(rng.random(n) < 0.15, 1 - y1, y1)
    folds, known = np.arange(n) % 4, np.arange(n) % 11 != 0
    labels = np.stack([y1, np.where(known, y2, np.nan)], 1)
    chain = tx.fit_chain(x, labels, folds, ("a", "b"), [b"w"] * x.shape[1])
    out, inside = np.zeros(n), None
    for f in range(4):
        w = plain_logistic(x[folds != f], y1[folds != f])
        out[folds == f] = 1 / (1 + np.exp(-(x[folds == f] @ w[:-1] + w[-1])))
    w1 = plain_logistic(x, y1)
    inside = 1 / (1 + np.exp(-(x @ w1[:-1] + w1[-1])))
    second = lambda p: plain_logistic(np.hstack([x, np.log(p / (1 - p))[:, None]])[known], y2[known])
    right, wrong = second(out), second(inside)
    assert np.abs(chain.weights[0] - w1).max() < 1e-4 and np.abs(chain.weights[1] - right).max() < 1e-3
    assert np.abs(right - wrong).max() > 0.1  # in-fold probabilities would fail this test
    p1 = 1 / (1 + np.exp(-(x @ w1[:-1] + w1[-1])))
    z = np.hstack([x, np.log(p1 / (1 - p1))[:, None], np.ones((n, 1))]) @ right
    assert np.abs(chain.probabilities(x) - np.stack([p1, 1 / (1 + np.exp(-z))], 1)).max() < 1e-3


def test_scores_against_brute_force(spark):
    """score over a table, with empty and null texts, against the chain applied by hand."""
    words = ("alpha", "beta", "gamma^", "delta")
    chain = tx.Chain(("a", "b"), tuple(w.encode() for w in words), [np.array([1.0, -2.0, 0.5, 0.0, -0.3]), np.array([0.2, 0.1, -1.0, 2.0, 0.7, 0.4])])
    texts = [None, "", "Alpha beta", "alpha, ALPHA gammaray", "delta " * 5000 + "beta", "éclair alphabet"]
    held = [set(), set(), {"alpha", "beta"}, {"alpha", "gamma^"}, {"delta", "beta"}, set()]
    got = {r["doc_id"]: (r["p_a"], r["p_b"]) for r in tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for k, h in enumerate(held):
        x = [float(w in h) for w in words]
        za = sum(a * b for a, b in zip(x, (1.0, -2.0, 0.5, 0.0))) - 0.3
        pa_ = 1 / (1 + np.exp(-za))
        zb = sum(a * b for a, b in zip(x, (0.2, 0.1, -1.0, 2.0))) + 0.7 * za + 0.4
        assert np.allclose(got[k], (pa_, 1 / (1 + np.exp(-zb))))


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert queries.toxicity(edges, labels).count() == edges.count()
    rows = queries.toxicity(edges, labels.limit(0)).collect()
    assert len(rows) == edges.count() and {r["p_toxic"] for r in rows} == {0.5}
    assert queries.toxicity(nothing, labels).count() == 0


def test_toxicity_on_the_test_tables(spark):
    """Held out: the hashes beyond those of the training rows."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = tx.train_chain(docs, own, ("junk", "toxic"), rows=2400)
    late = labels.orderBy(F.xxhash64("doc_id"), "doc_id").offset(2400)
    got = tx.score(docs, chain).join(late, "doc_id").groupBy("toxic").agg(F.count_if(F.col("p_toxic") >= queries.TOXIC_AT).alias("hit"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["toxic"]: (r["hit"], r["n"]) for r in got}
    assert by[1][0] > 0.8 * by[1][1] and by[0][0] < 0.01 * by[0][1]


# other


def test_crc_of_ids(spark):
    assert spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")
