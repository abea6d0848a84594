"""The query of each corpus operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, common, decontaminate, html_extract, ngram_join, pii, quality_cnn, secret_scan, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new table of this run, so that every run encodes all distinct texts once."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), common.scratch(spark, "token-cache"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents"), keep_text=False).drop("longest_run")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has media, so every embedding is played as a melody: one recording a row."""
    return audio.self_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.render).withColumnRenamed("id", "vec_id")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), repo_col="doc_id", owner_col="source")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


#: For synthetic tables; whoever has it can undo the pseudonyms.
DEMO_KEY = b"a key for demonstrations"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), DEMO_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_audio": op7_audio,
    "op8_ngram_join": op8_ngram_join,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, w, least(13, len(w)) AS n
    FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0),
item_windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
doc_windows AS (
    SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
found AS (SELECT k, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
hits AS (
    SELECT k, count(DISTINCT p) AS n_hit
    FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM found)) GROUP BY k),
items AS (
    SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""

OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_of AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS p FROM win JOIN least_of USING (win) WHERE m < doc_id),
words AS (SELECT k, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

#: RE2 folds case beyond ASCII, so the keywords' letters are written out.
_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = (
    (0, "assign", f"""(?:{_WORD})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "len(v) >= 8"),
    (1, "access", "(AKIA[A-Z0-9]+)", "len(v) >= 16"),
    (2, "hex", "([0-9a-f]+)", "len(v) >= 32"),
    (3, "opaque", "([A-Za-z0-9+/_-]+)", "len(v) >= 24 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9].*[0-9]')"),
)


def _kind_sql(number: int, name: str, pattern: str, good: str) -> str:
    quoted = f"(?s)(.*?)({pattern}|\\z)".replace("'", "''")
    return f"""
    SELECT k, {number} AS kind, '{name}' AS name, stop - len(m) AS start, stop, v
    FROM (SELECT k, i, m, v, sum(len(g) + len(m)) OVER (PARTITION BY k ORDER BY i) AS stop
        FROM (SELECT k, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g, unnest(ms) AS m, unnest(vs) AS v
            FROM (SELECT k, regexp_extract_all(t, '{quoted}', 1) AS gs, regexp_extract_all(t, '{quoted}', 2) AS ms, regexp_extract_all(t, '{quoted}', 3) AS vs FROM d)))
    WHERE len(m) > 0 AND {good}"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(*p) for p in _PATTERNS)}),
owned AS (SELECT v, count(DISTINCT source) AS owners FROM found JOIN d USING (k) GROUP BY v),
judged AS (SELECT k, kind, name || ':' || start || ':' || stop AS span, start, owners < 2 AS live FROM found JOIN owned USING (v)),
one AS (
    SELECT k, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (live) AS l, count(*) FILTER (NOT live) AS n,
        string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans
    FROM judged GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0) AS n_live, coalesce(n, 0) AS n_copied
FROM d LEFT JOIN one USING (k)
"""

OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b, m = c AND n = c AS same FROM shared WHERE 5 * c >= 4 * (m + n - c)),
links AS (SELECT a, b, same FROM linked UNION ALL SELECT b, a, same FROM linked),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1),
equal AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS name FROM d LEFT JOIN (SELECT a, b FROM links WHERE same) ON a = doc_id GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) FILTER (same) AS n_copies, count(*) AS n_links, count(DISTINCT name) FILTER (NOT same) AS n_similar FROM links JOIN equal ON b = equal.doc_id GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, CAST(coalesce(n_copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_similar, 0) AS BIGINT) AS n_similar
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORACLES: dict[str, str] = {"op8_ngram_join": OP8_SQL, "op2_substring_dedup": OP2_SQL, "op6_decontamination": OP6_SQL, "op9_secrets": OP9_SQL}
