"""One query for each operator, over its whole table with production parameters, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    conversations,
    impacts,
    language,
    licenses,
    neighbours,
    packing,
    periodic,
    repeats,
    sentencepieces,
    sequences,
    simhash,
    token_counts,
    warc,
)
from weftline.llm.common import held_out
from weftline.queries.registry import table
from weftline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-cache")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.learn(docs, ~held_out())
    said = language.identify(docs, filters)
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_sentencepieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000
                         THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN newest <> page_id THEN newest END AS refers_to
    FROM m
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_count())


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), length=100).drop("begins", "ends")


@query(
    "op2_exact_top_k",
    """
    WITH q AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op1_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


# DuckDB has no checksum of this kind: eight shifts for each byte of the decimal id.
_SHIFT = "xor(({0}) // 2, CASE WHEN ({0}) % 2 = 1 THEN 3988292384 ELSE 0 END)"


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII text in SQL: a reduction over bits of bytes, the byte joined before its first bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii(substr({text}, i, 1)) + 256], [0, 0, 0, 0, 0, 0, 0])))"
    state = "(CASE WHEN b >= 256 THEN xor(c, b - 256) ELSE c END)"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, b: {_SHIFT.format(state)}), 4294967295)"


@query(
    "op12_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t),
    h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("name")} % 9 AS h FROM c),
    r AS (
        SELECT h.conv_id, 0 AS part, t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.n <= h.h
        UNION ALL
        SELECT h.conv_id, 1, t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.n > h.h
    ),
    l AS (SELECT conv_id, list(sha256(concat(length(role), ':', role, text)) ORDER BY part, n) AS turns,
                 list(octet_length(encode(text)) ORDER BY part, n) AS sizes FROM r GROUP BY conv_id),
    w AS (SELECT c.conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM c LEFT JOIN l USING (conv_id)),
    p AS (
        SELECT conv_id, d AS depth, len(turns) AS last, turns[1:d] AS steps, sha256(array_to_string(turns[1:d], ',')) AS node,
               CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], ',')) END AS up, coalesce(sizes[d], 0) AS size
        FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM w)
    ),
    v AS (
        SELECT node, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(steps) AS steps,
               (count(*) - 1) * any_value(size) AS worth,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = depth), '')) AS ends_sha256
        FROM p GROUP BY node, depth
    ),
    k AS (SELECT up, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
    e AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k ON k.up = v.node),
    s AS (
        SELECT node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(worth) AS saved
        FROM (SELECT unnest(list_transform(range(0, depth + 1), lambda d: sha256(array_to_string(steps[1:d], ',')))) AS node,
                     n_children, worth FROM e)
        GROUP BY node
    )
    SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
           CAST(s.saved AS BIGINT) AS saved_tokens, e.ends_sha256
    FROM e JOIN s USING (node) LEFT JOIN v u ON u.node = e.up
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie_report(table(spark, sf_dir, "conversations"))
