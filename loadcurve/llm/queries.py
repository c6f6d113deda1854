"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from loadcurve.llm import collocation_queries as _collocation_queries
from loadcurve.llm import manifest_queries as _manifest_queries
from loadcurve.llm import vector_queries as _vector_queries
from loadcurve.llm import factorization, fixity, language, near_join, packing, quality_rules, secret_scan, sharding, tiling, token_counts
from loadcurve.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op1_quality_rules")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels, keep=["doc_id"])


@query("op8_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def _(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op2_secret_scan")
def _(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"), path="source")


@query("op3_factorisation_machine")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return factorization.classify(docs, labels, keep=["doc_id"])


@query("op4_hypergeometric_sharding")
def _(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


#: The second replica has changed bytes where the digest of the address starts with one pair, and lacks records where it starts with another.
CHANGED, LOST = "0a", "1b"


@query(
    "op5_merkle_fixity_audit",
    f"""
    WITH stored AS (
      SELECT page_id, html, md5(coalesce(url, '')) AS mark, coalesce(floor(page_id / 1000), -1) AS volume,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
             || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
             || chr(13) || chr(10) || 'Content-Length: ' AS head
      FROM pages WHERE html IS NOT NULL),
    records AS (
      SELECT *, head || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS good,
             head || CAST(strlen(html || ' ') AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || ' ' || chr(13) || chr(10) || chr(13) || chr(10) AS bad
      FROM stored),
    laid AS (
      SELECT *, sum(strlen(good)) OVER (PARTITION BY volume ORDER BY page_id) - strlen(good) AS place FROM records)
    SELECT 'pages-' || CAST(CAST(volume AS BIGINT) AS VARCHAR) || '-0' AS file, CAST(place AS BIGINT) AS "offset",
           CASE WHEN substr(mark, 1, 2) = '{LOST}' THEN 'missing' ELSE 'changed' END AS kind,
           sha256(good) AS left_digest, CASE WHEN substr(mark, 1, 2) = '{CHANGED}' THEN sha256(bad) END AS right_digest
    FROM laid WHERE substr(mark, 1, 2) IN ('{CHANGED}', '{LOST}')
    """,
)
def _(spark, sf_dir):
    mark = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    body = F.col("html")
    copy = F.when(mark == LOST, F.lit(None)).when(mark == CHANGED, F.concat(body, F.lit(" "))).otherwise(body)
    records = fixity.warc_records(table(spark, sf_dir, "pages").where(body.isNotNull()), {"first": body, "second": copy})
    found = fixity.audit(fixity.replica(records, "first"), fixity.replica(records, "second"))
    digest = lambda c: F.substring_index(c, "x", 1).alias(c)  # noqa: E731  without the number of copies
    return found.select("file", "offset", "kind", digest("left_digest"), digest("right_digest"))


@query("op6_language_codes")
def _(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op10_string_tiling")
def _(spark, sf_dir):
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_jaccard_join")
def _(spark, sf_dir):
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))
