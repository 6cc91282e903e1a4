"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_ac, chat, langid, media_mkv, packing, projections, quality, simhash, token_orc, warc
from .common import fresh_path, table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_mkv.digest(media_mkv.store(table(spark, sf_dir, "documents")))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens-orc")
    token_orc.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_orc.digest(spark, path)


def op4_bpe_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_ac.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), splitting_pattern())


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format(rows, vocabulary("byte_bpe_50k.json"))).drop("n_tokens")


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska_media": op1_matroska_media,
    "op2_collision_counting": op2_collision_counting,
    "op3_token_orc": op3_token_orc,
    "op4_bpe_aho_corasick": op4_bpe_aho_corasick,
    "op5_hilbert_packing": op5_hilbert_packing,
    "op6_chat_masks": op6_chat_masks,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_quality_attention": op8_quality_attention,
    "op9_language_bitmask": op9_language_bitmask,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_collision_counting": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
              WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
                AND list_dot_product(p.e, q.e) / (p.n * q.n) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    # A user or assistant turn has 16 or 10 characters of control strings around it, a system turn 18, another 31
    # and its role; each backslash and each control string inside is escaped by one character.
    "op6_chat_masks": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        t AS (
            SELECT *, length(regexp_replace(text, '\\|\[/?(?:INST|ROLE|TEXT)\]|<</?SYS>>|</?s>', '_\0', 'g')) AS escaped,
                   CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18 ELSE 31 + length(role) END AS marks
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op7_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
}
