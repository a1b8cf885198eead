"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, jaccard, lm, merkle, packing, quality, secrets, suffix, toxicity, warc, whitening
from .common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), order=3, alpha=0.4)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), length=100)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(documents(spark, sf_dir), percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = chat.with_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), -7, [("user", said), ("assistant", said)])
    return chat.read_back(chat.formatted(chat.log_of(rows)), in_order=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return merkle.verified(merkle.manifest(documents(spark, sf_dir), tampered))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_stupid_backoff, op2_suffix_dedup, op3_best_fit_packing, op4_ngram_jaccard, op5_warc,
        op6_quality_rules, op7_fingerprints, op8_secret_scan, op9_toxicity, op10_byte_bpe,
        op11_chat_format, op12_merkle_manifest, op13_whitening,
    )
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
            CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
    "op11_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, i, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
        ), e AS (
            SELECT *, length(replace(replace(replace(t, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t')) AS body,
                length(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t'), ': ', '\\c')) AS head FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS state FROM documents
        ), l AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN xor(state, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS told
            FROM f
        ), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
        t AS (
            SELECT tree, 0 AS level, pos, n, leaf AS h FROM p
            UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, n, pos // 8
        ), s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
            SELECT 0 AS level, pos, n, h FROM s
            UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 8
        ), a AS (
            SELECT p.tree, p.pos AS place, t.level, t.n, t.pos, t.h, t.pos = p.pos // CAST(8 ** t.level AS BIGINT) AS mine
            FROM p JOIN t ON t.tree = p.tree AND t.pos // 8 = p.pos // CAST(8 ** (t.level + 1) AS BIGINT) AND t.n > 1
            UNION ALL SELECT p.tree, p.pos, 1000 + u.level, u.n, u.pos, u.h, u.pos = s.pos // CAST(8 ** u.level AS BIGINT)
            FROM p JOIN s ON s.tree = p.tree JOIN u ON u.pos // 8 = s.pos // CAST(8 ** (u.level + 1) AS BIGINT) AND u.n > 1
        ), b AS (
            SELECT tree, place, level, row_number() OVER (PARTITION BY tree, place ORDER BY level) - 1 AS step, string_agg(h, '' ORDER BY pos) FILTER (NOT mine) AS others,
                coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS below, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS over_
            FROM (SELECT *, max(CASE WHEN mine THEN pos END) OVER (PARTITION BY tree, place, level) AS own FROM a) GROUP BY tree, place, level
        ), g AS (
            SELECT tree, pos AS place, 0 AS step, coalesce(told, leaf) AS h FROM p
            UNION ALL SELECT g.tree, g.place, g.step + 1, sha256(b.below || g.h || b.over_) FROM g JOIN b ON b.tree = g.tree AND b.place = g.place AND b.step = g.step
        ), k AS (SELECT tree, place, sha256(coalesce(string_agg(others, '' ORDER BY step), '')) AS proof_sha256, count(*) AS steps FROM b GROUP BY tree, place)
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(k.proof_sha256, sha256('')) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
        FROM p JOIN s ON s.tree = p.tree CROSS JOIN (SELECT h FROM u WHERE n = 1) r LEFT JOIN k ON k.tree = p.tree AND k.place = p.pos
        JOIN g ON g.tree = p.tree AND g.place = p.pos AND g.step = coalesce(k.steps, 0)
    """,
}
