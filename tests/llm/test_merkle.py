import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import merkle

from .conftest import text


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, body):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, body)))


def tree(nodes):
    """All levels, and for each node the siblings before and after it on its way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][j : j + 8]) for j in range(0, len(levels[-1]), 8)])
    ways = []
    for i in range(len(nodes)):
        way, k = [], i
        for level in levels[:-1]:
            run = k - k % 8
            way.append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
            k //= 8
        ways.append(way)
    return levels[-1][0], ways


def expected(rows):
    by_lang = defaultdict(list)
    for doc_id, body, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, body)
        lowered = body if body is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in body)
        struck = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by_lang[lang].append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n_chars, lowered) if struck else own, doc_id))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    below = {v: (sorted(by_lang[v]), *tree([r[2] for r in sorted(by_lang[v])])) for v in langs}
    root, above = tree([below[v][1] for v in langs])
    out = Counter()
    for v, upper in zip(langs, above, strict=True):
        members, subroot, ways = below[v]
        for (_, _, own, now, doc_id), way in zip(members, ways, strict=True):
            proof = digest(*(a + b for a, b in way + upper))
            for a, b in way + upper:
                now = digest(a, now, b)
            out[doc_id, own, subroot, root, proof, now, now == root] += 1
    return out


def check(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    for c in ("tree", "node", "tampered", "at", "n", "path", "block", "part", "place"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = Counter(tuple(r) for r in merkle.merkle_manifest(docs).collect())
    assert got == expected(rows)
    return got


def test_manifest_edges(spark, edges, nothing):
    rows = [tuple(r) for r in edges.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = check(spark, rows)
    assert sum(got.values()) == len(rows)
    assert merkle.merkle_manifest(nothing).count() == 0
    one = check(spark, [(7, "A b", "en", None, None)])
    (only,) = one
    assert only[1] == only[2] == only[3] and only[4] == digest("") and not only[6]


def test_manifest_block_boundaries(spark):
    """Trees of one, eight, nine, 64, 512 and 513 leaves, and one that needs two rounds of
    blocks with a lone node in its last; more than eight languages."""
    rows, at = [], 0
    for k, n in enumerate((1, 8, 9, 64, 65, 512, 513, 1, 2, 1540)):
        for _ in range(n):
            rows.append((at * 7919 % 100003, text(at % 50, 5).upper() if at % 4 else text(at % 50, 5), None if k == 3 else f"l{k}é", f"s{at % 3}", at))
            at += 1
    got = check(spark, rows)
    changed = [k for k in got if k[0] is not None and zlib.crc32(str(k[0]).encode()) % 3 == 0]
    assert 0 < sum(not k[6] for k in changed) < len(changed) and all(k[6] for k in got if k not in set(changed))


def test_a_change_anywhere_changes_the_root(spark):
    rows = [(i, f"t{i}", "en" if i % 2 else "de", "s", 2) for i in range(40)]
    root = lambda r: {k[3] for k in check(spark, r)}
    assert len(root(rows) | root([*rows[:20], (20, "t20 ", "de", "s", 2), *rows[21:]]) | root(rows[:-1])) == 3
