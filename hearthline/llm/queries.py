"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), checksum=True)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_of_held_out

    return quality_of_held_out(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests

    return media_digests(read_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_digests

    return near_duplicate_digests(read_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_of_held_out

    return language_of_held_out(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests

    return secret_digests(read_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_digests

    return licence_digests(read_table(spark, sf_dir, "documents"))


def op11_ranked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_bpe import ranked_digests

    return ranked_digests(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit_sources

    return audit_sources(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_media_columns": op3_media_columns,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_licence_scan": op10_licence_scan,
    "op11_ranked_round_trip": op11_ranked_round_trip,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}

_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)
"""

_SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT lang, source, d, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
vocab AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN found USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 1)) // (s.total + v.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN vocab v ON g.lang = v.lang JOIN sums s ON g.lang = s.lang AND g.source = s.source
    LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_CONVERSATION_TRIE = r"""
WITH named AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, sha256(concat(length(role), ':', role, text)) AS k, length(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(concat(length(role), ':', role, text)), 1, 32)) AS pos FROM named),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
begun AS (SELECT c.conv_id, c.base, c.h, (SELECT count(*) FROM turns t WHERE t.conv_id = c.base AND t.pos <= c.h) AS n_base FROM convs c),
rebuilt AS (
  SELECT b.conv_id, t.pos AS d, k, size FROM begun b JOIN turns t ON t.conv_id = b.base AND t.pos <= b.h
  UNION ALL SELECT b.conv_id, t.pos - b.h + b.n_base, k, size FROM begun b JOIN turns t ON t.conv_id = b.conv_id AND t.pos > b.h),
seqs AS (
  SELECT conv_id, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(size ORDER BY d) FILTER (k IS NOT NULL), []) AS sizes
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, ks, sizes, unnest(range(0, len(ks) + 1)) AS d FROM seqs),
path AS (SELECT conv_id, d, sha256(array_to_string(list_slice(ks, 1, d), '')) AS node, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(ks) AS ended FROM steps),
nodes AS (
  SELECT node, d, min(conv_id) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM path GROUP BY node, d),
up AS (SELECT n.node, n.d, n.saved, p.node AS above, p.d AS above_d FROM nodes n JOIN path p ON p.conv_id = n.c AND p.d <= n.d),
kids AS (SELECT above AS node, above_d AS d, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY ALL),
sums AS (
  SELECT above AS node, above_d AS d, sum(up.saved) AS saved, count(*) FILTER (kids.node IS NULL) AS n_leaves
  FROM up LEFT JOIN kids ON kids.node = up.node AND kids.d = up.d GROUP BY ALL)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.d = n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
  LEFT JOIN up u ON u.node = n.node AND u.d = n.d AND u.above_d = n.d - 1 LEFT JOIN nodes p ON p.node = u.above AND p.d = u.above_d
"""

#: Only what DuckDB can express as a whole.
ORACLE_SQL: dict[str, str] = {"op5_near_duplicates": _NEAR_DUPLICATES, "op12_source_divergence": _SOURCE_DIVERGENCE, "op13_conversation_trie": _CONVERSATION_TRIE}
