"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import digests
from .chat import SCHEMAS, format_chat, tool_turns
from .common import table
from .html_text import extract
from .line_dedup import line_report
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .simhash import near_duplicates
from .suffix_dedup import removal_digests
from .token_counts import token_counts
from .top_k import top_k
from .toxicity import toxicity
from .whitening import whiten


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(*tool_turns(table(spark, sf_dir, "conversations")), SCHEMAS)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_html": op3_html,
    "op4_top_k": op4_top_k,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, coalesce(text, '') AS text,
                   substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS t FROM turns
        ), convs AS (
            SELECT conv_id, base, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc
            FROM (SELECT DISTINCT conv_id, base FROM turns)
        ), sized AS (
            SELECT c.conv_id, c.base, xor(crc, 4294967295) % 9 AS h, (SELECT count(*) FROM own b WHERE b.conv_id = c.base) AS given FROM convs c
        ), whole AS (
            SELECT s.conv_id, b.t AS d, b.text, b.digest FROM sized s JOIN own b ON b.conv_id = s.base AND b.t <= s.h
            UNION ALL
            SELECT s.conv_id, least(s.h, s.given) + o.t - s.h AS d, o.text, o.digest FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.t > s.h
        ), prefixes AS (
            SELECT conv_id, d, strlen(text) AS size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM whole
            UNION ALL
            SELECT conv_id, 0, 0, '' FROM convs
        ), lengths AS (
            SELECT conv_id, max(d) AS len FROM prefixes GROUP BY conv_id
        ), nodes AS (
            SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len), '') AS ends
            FROM prefixes JOIN lengths USING (conv_id) GROUP BY p, d
        ), hung AS (
            SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), full_nodes AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN hung h ON h.p = n.p
        ), below AS (
            SELECT left(p, 32 * e) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
            FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY ALL
        )
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
               CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM full_nodes n JOIN below b ON b.p = n.p LEFT JOIN nodes u ON n.d > 0 AND u.p = left(n.p, 32 * (n.d - 1))
    """,
}
