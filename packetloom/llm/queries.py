"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, langid, lexical, mixing, repair, sharding, simhash, substring_dedup, topk, toxicity, warc
from .common import shared_dir, split_of, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), split_of("doc_id", 3) == 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), split_of("doc_id", 5) == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.assign(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), times_col="times"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree_of(8), sharding.tree_of(9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_topk": op3_topk,
    "op4_html_text": op4_html_text,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_langid": op8_langid,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_repair": op11_repair,
    "op12_lexical": op12_lexical,
    "op13_sharding": op13_sharding,
}

#: Terms of a text, with repeats.
TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: CRC-32 of a text, four bits a step.
CRC32_SQL = """
            SELECT k, xor(list_reduce(list_transform(range(len(nib)), lambda i: nib[i + 2 - 2 * (i % 2)]), lambda v, x: xor(v >> 4, t[1 + (xor(v, x) & 15)]), 4294967295), 4294967295) AS crc
            FROM (SELECT k, list_transform(string_split(hex(encode(s)), ''), lambda c: CAST(instr('123456789ABCDEF', c) AS BIGINT)) AS nib FROM hashed), (
                SELECT list(list_reduce(range(4), lambda v, j: xor(v >> 1, 3988292384 * (v & 1)), i) ORDER BY i) AS t FROM range(16) AS r(i)
            )"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
        ), l AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM l""",
    "op3_topk": """
        WITH e AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum([a[1] * a[2] for a in list_zip(q.v, e.v)]) AS BIGINT) AS score
            FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, list_aggregate(w[i:i + 49], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), hit AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS p FROM hit, range(0, 50) AS r(k)
        ), word AS (
            SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
        ), kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
        ), r AS (
            SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        )
        SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r""",
    "op11_repair": rf"""
        WITH RECURSIVE c AS (
            SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
        ), hashed AS (
            SELECT k, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM c
        ), crc AS ({CRC32_SQL}
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
                CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n
            FROM c JOIN crc USING (k)
        ), placed AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
        ), judged AS (
            SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
            FROM placed
        ), insertion(q, p, ins) AS (VALUES
            (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II'), (2, 2, 'II'), (3, 3, 'II')
        ), shift(p, t, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
        ), edit(p, t, r, e) AS (
            SELECT p, t, r, 'K' FROM shift UNION ALL SELECT p, t, r, 'R' FROM shift WHERE t <> 's' UNION ALL SELECT p, '', p, 'D' FROM range(4) AS s(p)
        ), st AS (
            SELECT conv_id, 0 AS i, 0 AS r, {{'cost': 0, 'audit': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT st.conv_id, st.i + 1, edit.r, min({{'cost': best.cost + 2 * len(ins) + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, 'audit': best.audit || ins || e}})
            FROM st JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM st.conv_id AND j.i = st.i + 1 JOIN insertion ON insertion.q = st.r JOIN edit ON edit.p = insertion.p
            WHERE e = 'D' OR fault IN ('', 'truncated') AND (e = 'R' OR j.x = edit.t)
            GROUP BY st.conv_id, st.i, edit.r
        ), ended AS (
            SELECT conv_id, min({{'cost': best.cost + 2 * len(ins), 'audit': best.audit || ins}}) AS best
            FROM st JOIN insertion ON q = r AND p IN (0, 3) WHERE i = (SELECT count(*) FROM judged AS j WHERE j.conv_id IS NOT DISTINCT FROM st.conv_id) GROUP BY conv_id
        ), letter AS (
            SELECT conv_id, audit, pos, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o
            FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS pos, unnest(string_split(best.audit, '')) AS e FROM ended WHERE best.audit <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        ), line AS (
            SELECT l.conv_id, pos, CASE WHEN e = 'K' THEN j.role WHEN (o + len(replace(audit, 'D', ''))) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE j.text END AS s
            FROM letter AS l LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i WHERE e <> 'D'
        ), text AS (
            SELECT conv_id, string_agg(s, chr(10) ORDER BY pos) AS s FROM line GROUP BY conv_id
        ), n AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        )
        SELECT ended.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(coalesce(s, '')) AS repaired_sha256
        FROM ended LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ended.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM ended.conv_id""",
    "op12_lexical": rf"""
        WITH tf AS (
            SELECT k, doc_id, term, count(*) AS tf FROM (SELECT k, doc_id, unnest({TERMS_SQL}) AS term FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)) GROUP BY ALL
        ), len AS (
            SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY k
        ), total AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len
        ), weight AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
        ), q AS (
            SELECT j, item_id, term, count(*) AS times FROM (SELECT j, item_id, unnest({TERMS_SQL}) AS term FROM (SELECT row_number() OVER () AS j, item_id, text FROM benchmark)) GROUP BY ALL
        ), s AS (
            SELECT j, item_id, k, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
            FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (k), total GROUP BY j, item_id, k, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op13_sharding": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS s FROM documents
        ), hashed AS (
            SELECT k, s FROM d
        ), crc AS ({CRC32_SQL}
        ), node(grown, above, name, weight) AS (VALUES
            (0, '', 'region0', 4.0), (0, '', 'region1', 4.0), (1, '', 'region2', 1.0),
            (0, 'region0', 'rack0', 2.0), (0, 'region0', 'rack1', 2.0), (0, 'region1', 'rack0', 2.0), (0, 'region1', 'rack1', 2.0), (1, 'region2', 'rack0', 1.0),
            (0, 'region0/rack0', 'shard0', 1.0), (0, 'region0/rack0', 'shard1', 1.0), (0, 'region0/rack1', 'shard2', 1.0), (0, 'region0/rack1', 'shard3', 1.0),
            (0, 'region1/rack0', 'shard4', 1.0), (0, 'region1/rack0', 'shard5', 1.0), (0, 'region1/rack1', 'shard6', 1.0), (0, 'region1/rack1', 'shard7', 1.0), (1, 'region2/rack0', 'shard8', 1.0)
        ), draw AS (
            SELECT k, grown, above, ltrim(above || '/' || name, '/') AS path,
                -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || ltrim(above || '/' || name, '/')), 1, 12) AS BIGINT) + 0.5) / 16.0::DOUBLE ** 12) / weight::DOUBLE AS score
            FROM d, node
        ), best AS (
            SELECT k, g, above, arg_min(path, score) AS path FROM draw, (VALUES (0), (1)) AS s(g) WHERE grown <= g GROUP BY k, g, above
        ), leaf AS (
            SELECT c.k, c.g, CAST(regexp_extract(c.path, '[0-9]+$') AS INTEGER) AS shard
            FROM best AS a JOIN best AS b ON a.above = '' AND b.above = a.path AND a.k = b.k AND a.g = b.g JOIN best AS c ON c.above = b.path AND c.k = b.k AND c.g = b.g
        ), placed AS (
            SELECT doc_id, CAST(strlen(s) + 1 AS BIGINT) AS size, crc AS text_crc32, a.shard, b.shard AS grown_shard, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/slot'), 1, 12) AS h
            FROM d JOIN crc USING (k) JOIN leaf AS a ON a.k = d.k AND a.g = 0 JOIN leaf AS b ON b.k = d.k AND b.g = 1
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed""",
}
