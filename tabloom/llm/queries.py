"""Queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, decontaminate, divergence, license_scan, line_rules, mixing, sharding, simhash, substring_index, suffix_dedup, templates, token_ids, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(_table(spark, sf_dir, "pages"))


#: The language shares that op4 asks for; sources and topics are tempered.
LANGUAGES = {"en": 0.48, "de": 0.17, "fr": 0.17, "es": 0.16, mixing.NONE: 0.02}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"), targets={"lang": LANGUAGES})


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.deduplicate(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digests(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_cotraining, op3_templates, op4_mixing, op5_line_rules, op6_simhash_near_dedup, op7_substring_index, op8_sharding, op9_license_scan, op10_suffix_array,
        op11_whitening, op12_token_ids, op13_divergence,
    )
}

_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM starts),
firsts AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (words), range(13) r(k) WHERE first_id < doc_id),
marked AS (SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS is_gone FROM words LEFT JOIN gone USING (doc_id, p)),
left_over AS (SELECT doc_id, count(*) FILTER (WHERE is_gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT is_gone) AS kept
              FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

#: Strings of 400 bytes as 800 hex digits, cut from pieces of 655 bytes that start every 256.
_OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bases AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 399, 256)) AS base, h FROM d WHERE len(h) >= 800),
pieces AS MATERIALIZED (SELECT doc_id, base, substr(h, 2 * base + 1, 1310) AS piece FROM bases),
starts AS (SELECT doc_id, base, unnest(range(0, len(piece) // 2 - 399)) AS k, piece FROM pieces),
strings AS MATERIALIZED (SELECT doc_id, base + k AS i, md5_number(substr(piece, 2 * k + 1, 800)) AS s FROM starts),
repeats AS (SELECT doc_id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
edges AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS is_new FROM repeats),
numbered AS (SELECT doc_id, i, sum(is_new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS kept_from, hi FROM runs),
left_over AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail,
                     string_agg(substr(h, 2 * kept_from + 1, 2 * (lo - kept_from)), '' ORDER BY lo) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
numbered AS (SELECT row_number() OVER () AS doc, * FROM d),
found AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM numbered),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // CAST(coalesce(t.total, 0) + 5 * s.v AS HUGEINT) AS BIGINT) AS p
           FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term),
lang_shares AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * CAST(n + 5 AS HUGEINT) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS q FROM whole JOIN sizes USING (lang)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items QUALIFY part = 'pair' OR rank <= 50
"""

#: DuckDB SQL where SQL can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {"op7_substring_index": _OP7, "op10_suffix_array": _OP10, "op13_divergence": _OP13}
