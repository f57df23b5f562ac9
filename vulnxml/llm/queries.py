"""Registered queries of the training-data operators: each applies its operator
to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnxml.llm import ann, bpe, html_blocks, lang_id, merkle, mixing, packing, pii, prefix_trie, quality_mil, quality_rules, simhash, warc
from vulnxml.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language(read_table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(read_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digests(read_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc_index, op3_pii, op4_simhash, op5_quality_rules, op6_mixing,
                                   op7_nearest, op8_quality_mil, op9_main_text, op10_packing, op11_bpe, op12_prefix_trie, op13_merkle, pipeline)}

ORACLE = {
    "op2_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             d AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to,
               strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM p JOIN d USING (h)""",
    "op12_prefix_trie": """
        WITH t AS (
          SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
          SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(s, 1, 1) >= '8' DESC, substr(s, 1, 16),
                 substr(s, 17, 1) >= '8' DESC, substr(s, 17, 16)) - 1 AS i FROM t),
        convs AS (
          SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] for x in string_split(CAST(c AS VARCHAR), '')])),
                 lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM own)),
        rebuilt AS (
          SELECT v.c, i, role, text FROM convs v JOIN own o ON o.c = v.base WHERE i < h
          UNION ALL SELECT v.c, i, role, text FROM convs v JOIN own o ON o.c = v.c WHERE i >= h),
        p AS (
          SELECT c, row_number() OVER w AS d, strlen(text) AS b,
                 string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
          FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY i)
          UNION ALL SELECT c, 0, 0, '' FROM convs),
        q AS (SELECT *, max(d) OVER (PARTITION BY c) AS n, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
        nodes AS (
          SELECT k, d, any_value(up) AS up, any_value(b) AS b, min(c) AS conv_id, count(*) AS n_convs, max(n) > d AS inner_node,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM q GROUP BY k, d),
        sums AS (
          SELECT q.k, count(*) FILTER (WHERE NOT inner_node) AS n_leaves, sum((n_convs - 1) * o.b) AS saved
          FROM nodes o JOIN q ON q.c = o.conv_id AND q.d <= o.d GROUP BY q.k)
        SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, (SELECT count(*) FROM nodes x WHERE x.up = o.k) AS n_children,
               s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends_sha256
        FROM nodes o JOIN sums s USING (k) LEFT JOIN nodes u ON u.k = o.up""",
    "op13_merkle": """
        WITH RECURSIVE d AS (
          SELECT doc_id, source, row_number() OVER () AS rid,
                 coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS fixed, text,
                 list_reduce(list_concat([4294967295], flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
                             lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS crc
          FROM documents),
        leaf AS (
          SELECT doc_id, source, rid, sha256(fixed || coalesce(strlen(text) || ':' || text, '-')) AS h,
                 CASE WHEN doc_id IS NOT NULL AND crc % 2 = 1 THEN sha256(fixed || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS claimed
          FROM d),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf),
        nodes(source, l, i, h) AS (
          SELECT source, 0, i, h FROM ranked
          UNION ALL
          SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) x WHERE n > 1 GROUP BY source, l, i // 3),
        steps AS (
          SELECT source, l, i, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS before,
                 coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS after, max(l) OVER (PARTITION BY source) AS top
          FROM nodes WINDOW w AS (PARTITION BY source, l, i // 3 ORDER BY i)),
        subroots AS (
          SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
          FROM (SELECT *, max(l) OVER (PARTITION BY source) AS top FROM nodes) x WHERE l = top),
        upper(l, i, h) AS (
          SELECT 0, i, h FROM subroots
          UNION ALL
          SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper) x WHERE n > 1 GROUP BY l, i // 3),
        upper_steps AS (
          SELECT l, i, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS before,
                 coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS after, max(l) OVER () AS top
          FROM upper WINDOW w AS (PARTITION BY l, i // 3 ORDER BY i)),
        walk(rid, source, l, i, folded, proof) AS (
          SELECT rid, source, 0, i, coalesce(claimed, h), '' FROM ranked
          UNION ALL
          SELECT rid, w.source, w.l + 1, w.i // 3, sha256(before || folded || after), proof || before || after
          FROM walk w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND w.l = s.l AND w.i = s.i WHERE s.l < s.top),
        at_subroot AS (SELECT * FROM (SELECT *, max(l) OVER (PARTITION BY rid) AS top FROM walk) x WHERE l = top),
        climb(rid, subroot, l, i, folded, proof) AS (
          SELECT rid, s.h, 0, s.i, folded, proof FROM at_subroot a JOIN subroots s ON a.source IS NOT DISTINCT FROM s.source
          UNION ALL
          SELECT rid, subroot, c.l + 1, c.i // 3, sha256(before || folded || after), proof || before || after
          FROM climb c JOIN upper_steps s ON c.l = s.l AND c.i = s.i WHERE s.l < s.top),
        ended AS (SELECT * FROM (SELECT *, max(l) OVER (PARTITION BY rid) AS top FROM climb) x WHERE l = top),
        root AS (SELECT h FROM upper ORDER BY l DESC LIMIT 1)
        SELECT r.doc_id, r.h AS leaf, e.subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root.h AS verified
        FROM ranked r JOIN ended e USING (rid), root""",
}
