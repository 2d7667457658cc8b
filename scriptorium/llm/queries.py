"""One query per operator of this subpackage over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import CLUSTERS, DIMENSIONS, ROUNDS, cluster_vectors
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_classes
from .kd_shards import kd_shards
from .line_chunks import dedup_line_chunks
from .line_frequency import line_verdicts
from .line_runs import dedup_line_runs
from .merkle import merkle_manifest
from .mixing import mix_rates
from .packing import pack
from .personal_data import personal_data
from .quality import quality
from .toxicity import score, train_chain
from .warc import read_archives, write_archives

SHARDS = 40
#: Documents are rejected from this probability on.
TOXIC_AT = 0.3
#: Documents are predicted to be good from this score on.
GOOD_AT = 0.3


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("file", "at")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards(table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_line_chunks(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_line_runs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_spans")


def toxicity(docs: DataFrame, labels: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """doc_id, p_junk, p_toxic: junk is a quality of 0, and comes first in the chain. It is
    trained on ``docs``; ``rated`` gives the rows to score if they are others."""
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return score(docs if rated is None else rated, train_chain(docs, labels, ("junk", "toxic")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("*", (F.col("p_toxic") >= TOXIC_AT).alias("toxic"), (F.col("p_toxic") < TOXIC_AT).alias("kept"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", (F.col("score") >= GOOD_AT).cast("int"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_line_frequency, op3_packing, op4_warc, op5_kd_shards, op6_line_chunks, op6_line_runs, op7_mixing, op8_jaccard_join, op9_personal_data, op10_toxicity, op11_merkle, op12_quality, op13_centroids)}

_WS = r"[\x20\x09-\x0D]"

SQL = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op1_exact_dedup": rf"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op2_line_frequency": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
                   list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS words
            FROM documents),
        spoken AS (
            SELECT doc_id, host, text, line, len(list_filter(string_split_regex(line, '{_WS}+'), lambda x: x <> '')) AS w,
                   trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+', ' ', 'g'), ' ') AS norm
            FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
        again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
        repeated AS (
            SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM again) GROUP BY doc_id),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM spoken GROUP BY doc_id),
        hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
        frequent AS (
            SELECT s.host, s.norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM spoken GROUP BY host, norm) s
            JOIN hosts h ON h.host = s.host WHERE s.n > 20 AND 100 * s.n > 2 * h.n),
        removed AS (
            SELECT doc_id, sum(w) AS words, count(*) AS lines FROM spoken s JOIN frequent f ON f.host = s.host AND f.norm = s.norm GROUP BY doc_id),
        counted AS (
            SELECT d.doc_id, len(d.words)::BIGINT AS n_words,
                   length(regexp_replace(d.text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(removed.words, 0)::BIGINT AS removed_words, coalesce(removed.lines, 0)::BIGINT AS removed_lines
            FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id
            LEFT JOIN removed ON removed.doc_id = d.doc_id)
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
               AND n_words - removed_words >= 10 AND 100 * (n_words - removed_words) >= 20 * n_words AS kept
        FROM counted""",
    "op6_line_chunks": r"""
        WITH lines AS (
            SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        rolled AS (
            SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0)) % 2147483647 % 2 = 0 AS mark
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        ends AS (SELECT *, mark AND NOT coalesce(lag(mark) OVER w, false) AS last FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        numbered AS (
            SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
            FROM ends),
        chunks AS (
            SELECT doc_id, no, count(*) AS n, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) >= 2 AS multi,
                   string_agg(line, chr(10) ORDER BY i) AS body
            FROM numbered GROUP BY doc_id, no),
        marked AS (
            SELECT *, multi AND row_number() OVER (PARTITION BY multi, body ORDER BY doc_id, no) > 1 AS gone FROM chunks),
        d AS (SELECT doc_id, list(line ORDER BY i) AS lines FROM lines GROUP BY doc_id),
        worded AS (
            SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        pairs AS (
            SELECT w.doc_id, i, e, array_to_string(lines[i:e], chr(10)) AS body
            FROM worded w JOIN d ON d.doc_id = w.doc_id WHERE e IS NOT NULL),
        again AS (
            SELECT doc_id, i, e, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) = 1 AS first
            FROM pairs QUALIFY count(*) OVER (PARTITION BY body) > 1),
        paired AS (
            SELECT doc_id, i FROM (SELECT doc_id, first, unnest(range(i, e + 1)) AS i FROM again)
            GROUP BY doc_id, i HAVING NOT bool_or(first)),
        chunked AS (SELECT n.doc_id, n.i FROM numbered n JOIN marked m ON m.doc_id = n.doc_id AND m.no = n.no WHERE m.gone),
        runs AS (
            SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT * FROM paired UNION SELECT * FROM chunked)),
        long AS (
            SELECT r.doc_id, run FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.i = r.i
            LEFT JOIN chunked c ON c.doc_id = r.doc_id AND c.i = r.i
            GROUP BY r.doc_id, run
            HAVING bool_or(c.i IS NOT NULL) OR sum(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) >= 30),
        gone AS (SELECT r.doc_id, r.i FROM runs r JOIN long ON long.doc_id = r.doc_id AND long.run = r.run),
        c AS (SELECT doc_id, count(*)::BIGINT AS n_chunks, count(*) FILTER (gone)::BIGINT AS removed_chunks FROM marked GROUP BY doc_id)
        SELECT l.doc_id, count(*)::BIGINT AS n_lines, c.n_chunks, c.removed_chunks, count(g.i)::BIGINT AS removed_lines,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS text_sha256
        FROM lines l JOIN c ON c.doc_id = l.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
        GROUP BY l.doc_id, c.n_chunks, c.removed_chunks""",
    "op6_line_runs": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        worded AS (
            SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        pairs AS (
            SELECT w.doc_id, i, e, array_to_string(lines[i:e], chr(10)) AS body
            FROM worded w JOIN d ON d.doc_id = w.doc_id WHERE e IS NOT NULL),
        marked AS (
            SELECT doc_id, i, e, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) = 1 AS first
            FROM pairs QUALIFY count(*) OVER (PARTITION BY body) > 1),
        gone AS (
            SELECT doc_id, i FROM (SELECT doc_id, first, unnest(range(i, e + 1)) AS i FROM marked)
            GROUP BY doc_id, i HAVING NOT bool_or(first)),
        g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS removed_lines,
               sha256(array_to_string(list_filter(lines, lambda x, i: NOT coalesce(list_contains(gone, i), false)), chr(10))) AS text_sha256
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (
            SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b
            WHERE 100 * common >= 90 * (ca.n + cb.n - common)),
        r(doc_id, reached) AS (
            SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id
        JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op7_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, text, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
        s AS (
            SELECT source, size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
            FROM (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source)),
        r AS (
            SELECT *, row_number() OVER o AS rank, sum(size) OVER () AS total, sum(weight) OVER () AS weights,
                   coalesce(sum(3 * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
                   coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
            FROM s WINDOW o AS (ORDER BY size / weight, source NULLS LAST)),
        first AS (
            SELECT * FROM r WHERE weight * (total - cut) <= 3 * size * (weights - used) ORDER BY rank LIMIT 1),
        t AS (
            SELECT r.source, r.size AS source_size,
                   CASE WHEN f.rank IS NULL OR r.rank < f.rank THEN (3 * r.size)::DOUBLE
                        ELSE (r.weight * (f.total - f.cut))::DOUBLE / (f.weights - f.used)::DOUBLE END AS target
            FROM r LEFT JOIN first f ON true),
        j AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
                   coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, ''))) AS key
            FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM j""",
}

_BYTES = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_BYTES.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: crc32 of ASCII text, bit by bit: the first of a character's eight steps takes it in.
_CRC = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""

#: levels of a tree of nodes (tree, i, h), and for each node the joined siblings by level.
SQL["op11_merkle"] = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_BYTES.format("text")}) AS leaf,
               sha256({_HEAD} || {_BYTES.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    nodes(tree, level, i, h) AS (
        SELECT tree, 0, i, leaf FROM placed
        UNION ALL
        SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, i // 8),
    tops AS (SELECT tree, level AS top, h AS subroot FROM nodes QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1),
    ordered AS (SELECT *, row_number() OVER (ORDER BY encode(tree)) - 1 AS k FROM tops),
    upper(level, i, h) AS (
        SELECT 0, k, subroot FROM ordered
        UNION ALL
        SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
        FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, i // 8),
    steps AS (
        SELECT p.tree, p.i, n.level, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < p.i // (8 ** n.level)::BIGINT), '') AS before,
               coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > p.i // (8 ** n.level)::BIGINT), '') AS after
        FROM (SELECT tree, i FROM placed) p JOIN ordered o ON o.tree = p.tree
        JOIN nodes n ON n.tree = p.tree AND n.level < o.top AND n.i // 8 = p.i // (8 ** (n.level + 1))::BIGINT
        GROUP BY p.tree, p.i, n.level
        UNION ALL
        SELECT p.tree, p.i, o.top + u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < o.k // (8 ** u.level)::BIGINT), ''),
               coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > o.k // (8 ** u.level)::BIGINT), '')
        FROM (SELECT tree, i FROM placed) p JOIN ordered o ON o.tree = p.tree
        JOIN upper u ON u.level < (SELECT max(level) FROM upper) AND u.i // 8 = o.k // (8 ** (u.level + 1))::BIGINT
        GROUP BY p.tree, p.i, o.top, u.level),
    folds(tree, i, level, h) AS (
        SELECT tree, i, 0, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN lowered ELSE leaf END FROM placed
        UNION ALL
        SELECT f.tree, f.i, f.level + 1, sha256(s.before || f.h || s.after)
        FROM folds f JOIN steps s ON s.tree = f.tree AND s.i = f.i AND s.level = f.level),
    folded AS (SELECT tree, i, h FROM folds QUALIFY row_number() OVER (PARTITION BY tree, i ORDER BY level DESC) = 1),
    proofs AS (SELECT tree, i, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, i),
    root AS (SELECT h AS root FROM upper ORDER BY level DESC LIMIT 1)
    SELECT p.doc_id, p.leaf, o.subroot, root.root, coalesce(proofs.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
    FROM placed p JOIN ordered o ON o.tree = p.tree JOIN folded f ON f.tree = p.tree AND f.i = p.i
    LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.i = p.i CROSS JOIN root"""

#: Components as one row each; the rounds one after the other.
_NEAREST = """
    d{k} AS (SELECT v.id, c.no, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c ON c.i = v.i GROUP BY v.id, c.no),
    a{k} AS (SELECT id, no, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, no) = 1)"""
_MOVED = """
    m{k} AS (SELECT a.no, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v ON v.id = a.id GROUP BY a.no, v.i),
    c{n} AS (SELECT c.no, c.i, coalesce((s - ((s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.no = c.no AND m.i = c.i)"""
_LLOYD = ",".join([_NEAREST.format(k=k) + "," + _MOVED.format(k=k, n=k + 1) for k in range(ROUNDS)] + [_NEAREST.format(k=ROUNDS)])

SQL["op13_centroids"] = f"""
    WITH q AS (
        SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
    v AS (SELECT id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM q),
    f AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS no, q FROM q QUALIFY no < {CLUSTERS}),
    c0 AS (SELECT no, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM f),
    {_LLOYD},
    named AS (SELECT no, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY no)
    SELECT q.vec_id, a.no::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.no)::BIGINT AS cluster_inertia,
           sum(a.d) OVER ()::BIGINT AS inertia, named.centroid_sha256
    FROM q JOIN a{ROUNDS} a ON a.id = q.id JOIN named ON named.no = a.no"""
