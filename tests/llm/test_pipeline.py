import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from scriptorium.llm import packing as pk
from scriptorium.llm import queries

from .conftest import text
from .test_native import brute_targets, words
from .test_python import brute_components, check_pieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, exact and near copies, several sources, nulls."""
    r, texts = random.Random(4), []
    for k in range(160):
        t = text(k, r.randint(3, 120)) + (" you idiot scum" if k % 6 == 0 else "")
        texts.append(t)
        if k % 5 == 0:
            texts.append(t.replace(" ", "  ", 3))
        if k % 7 == 0:
            texts.append(t + " more")
    texts += [None, "", "a"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_mix(docs):
    """doc_id -> copies."""
    sizes = {d: len(words(t)) for d, t, _ in docs}
    by = defaultdict(list)
    for d, _, s in docs:
        by[s].append(d)
    targets = brute_targets({s: sum(sizes[d] for d in ds) for s, ds in by.items()})
    out = {}
    for s, ds in by.items():
        total = sum(sizes[d] for d in ds)
        rate = targets[s] / total if total else 0
        out |= {d: int(rate) + (int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / 2**52 < rate - int(rate)) for d in ds}
    return out


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = cp.written(stage(spark, docs, folder), "test-stage")
        if k < 4:
            assert out.columns == docs.columns
            now = Counter(r["doc_id"] for r in out.collect())
        if name == "toxicity":
            rated = queries.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            bad = {r["doc_id"] for r in rated.filter(F.col("p_toxic") >= queries.TOXIC_AT).collect()}
            assert {d for d, (t, _) in rows.items() if "idiot" in (t or "")} == bad
            want = Counter(rows.keys() - bad)
        elif name == "exact dedup":
            groups = defaultdict(list)
            for d, (t, _) in rows.items():
                groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
            want = Counter(min(g)[1] for g in groups.values())
        elif name == "n-gram Jaccard join":
            want = Counter(d for d, (_, c) in brute_components([(d, t) for d, (t, _) in rows.items()], 5, 80).items() if d == c)
            assert len(want) < len(rows)
        elif name.startswith("mixing"):
            want = Counter({d: n for d, n in brute_mix([(d, t, s) for d, (t, s) in rows.items()]).items() if n})
        else:
            from tokenizers import Tokenizer

            given = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert check_pieces(out.collect(), given, Tokenizer.from_file(pk.default_vocabulary()[0])) < 0.1
            break
        assert now == want, name
        docs, rows = out, {r["doc_id"]: (r["text"], r["source"]) for r in out.collect()}
    assert cp.run(spark, folder).count() == out.count()


def test_stages_decide_on_rows(spark, tmp_path):
    """Rows that repeat a doc_id, or have none, are dropped like any other."""
    a, b, c, bad = text(901, 60), text(902, 60), text(903, 60), text(904, 20) + " you idiot scum"
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, c + " more"), (5, b + " more"), (6, ""), (None, bad), (7, bad), (7, c.replace(" ", "  ", 1)), (8, text(905, 60)), (8, text(906, 60))]
    rows += [(100 + k, text(950 + k, 20) + (" you idiot scum" if k % 3 == 0 else "")) for k in range(60)]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int("idiot" in t)) for d, t in rows if d and d >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs, docs.filter("n_chars >= 0")):  # as it is read, and not
        mine = lambda out: Counter((r["doc_id"], r["text"]) for r in out.filter("doc_id IS NULL OR doc_id < 100").collect())
        first = cp.written(cp.drop_toxic(spark, frame, str(tmp_path)), "test-stage")
        want = Counter((d, t) for d, t in rows if (d is None or d < 100) and t != bad)
        assert first.columns == docs.columns and mine(first) == want
        second = cp.written(cp.drop_copies(spark, first, str(tmp_path)), "test-stage")
        kept = [(1, a), (1, b), (None, c + " more"), (5, b + " more"), (6, ""), (7, c.replace(" ", "  ", 1)), (8, text(905, 60)), (8, text(906, 60))]
        assert mine(second) == Counter(kept)
        third = cp.drop_near_copies(spark, second, str(tmp_path))
        assert mine(third) == Counter([kept[0], kept[1], *kept[4:]])
        # Alone, this stage drops copies too.
        alone = mine(cp.drop_near_copies(spark, frame, str(tmp_path)))
        assert alone == Counter([(1, a), (1, b), (6, ""), (7, bad), (7, c.replace(" ", "  ", 1)), (8, text(905, 60)), (8, text(906, 60))])


def test_pipeline_on_edge_tables(spark, edges, nothing, tmp_path):
    """Nulls in any column, long and empty texts, repeated rows, clashing columns; no rows."""
    for name, docs in (("edges", edges), ("nothing", nothing)):
        docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("file", "at", "row", "doc", "p_toxic", "target", "_file", "_at", "_row", "_no", "_metadata", "a.b"))})
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        columns, n = now.columns, now.count()
        for stage, f in cp.STAGES[:4]:
            now = cp.written(f(spark, now, f"{tmp_path}/{name}"), "test-stage")
            assert now.columns == columns and (now.count() <= n or stage.startswith("mixing")), stage
            if stage == "exact dedup":
                texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in now.collect()]
                assert len(texts) == len(set(texts))
        packed = cp.STAGES[4][1](spark, now, f"{tmp_path}/{name}")
        assert packed.filter("start = 0").count() == now.count() and (n or now.count() == 0)
