"""Logs of hosted requests: attempt outcomes, streamed replies, page budgets, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import run_sql

# Three attempts; twenty pages a scan; image caps of providers (null: none); languages and summary lengths.
ATTEMPTS, MOST_PAGES = 3, 20
PROVIDERS = (
    ("Gemini", "gemini", None), ("Mistral OCR", "document", 1), ("OpenRouter", "openai", None), ("Hugging Face", "openai", 5), ("NVIDIA", "openai", 1),
    ("Groq", "openai", 5), ("Cerebras", "openai", 5), ("Cloudflare", "openai", 1), ("OpenAI", "openai", None), ("Claude", "anthropic", None), ("Custom", "openai", 1),
)
SUMMARY_LENGTHS = ("SHORT", "MEDIUM", "LONG")


def provider_caps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([[n, k, c, k == "document"] for n, k, c in PROVIDERS], "provider string, kind string, cap int, takes_pdf boolean")


_CLASS = """CASE WHEN http_status = 429 OR http_status BETWEEN 500 AND 599 THEN 'transient' WHEN error_kind = 'timeout' THEN CASE WHEN coalesce(streamed, false) THEN 'exhausted' ELSE 'transient' END
    WHEN error_kind = 'io' THEN 'network' WHEN error_kind IN ('body', 'cleartext') THEN 'fatal' WHEN error_kind = 'chunk' THEN 'transient' WHEN http_status IS NOT NULL AND http_status <> 200 THEN 'fatal'
    WHEN trim(coalesce(text, '')) <> '' THEN 'success' WHEN coalesce(empty_stream, false) THEN 'transient' ELSE 'fatal' END"""


def attempt_outcomes(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attempts (scan_id, provider_rank, attempt, http_status, error_kind, text[, streamed, empty_stream])`` → outcomes per provider and per scan.

    A provider's outcome is its first terminal attempt among three, else exhausted (with a network flag).  A scan ends at the first
    success or fatal in provider order; all exhausted gives ``network`` if every provider had network trouble, else ``rate_limited``.
    """
    for c in ("streamed", "empty_stream"):
        if c not in attempts.columns:
            attempts = attempts.withColumn(c, F.lit(False))
    providers = run_sql(
        f"""
        WITH c AS (SELECT scan_id, provider_rank, attempt, {_CLASS} AS class FROM {{attempts}} WHERE attempt <= {ATTEMPTS}),
        t AS (SELECT scan_id, provider_rank, coalesce(min_by(class, attempt) FILTER (WHERE class IN ('success', 'fatal', 'exhausted')), 'exhausted') AS outcome,
              min(attempt) FILTER (WHERE class IN ('success', 'fatal', 'exhausted')) AS ended, min(attempt) FILTER (WHERE class = 'network') AS network FROM c GROUP BY scan_id, provider_rank)
        SELECT scan_id, provider_rank, outcome, outcome = 'exhausted' AND ended IS NULL AND network IS NOT NULL AS network_problem FROM t
        """,
        attempts=attempts,
    )
    scans = run_sql(
        """
        SELECT scan_id, coalesce(min_by(outcome, provider_rank) FILTER (WHERE outcome <> 'exhausted'), CASE WHEN bool_and(network_problem) THEN 'network' ELSE 'rate_limited' END) AS outcome,
          min(provider_rank) FILTER (WHERE outcome <> 'exhausted') AS provider_rank FROM {providers} GROUP BY scan_id
        """,
        providers=providers,
    )
    return providers, scans


def assemble_responses(chunks: DataFrame) -> DataFrame:
    """``chunks (response_id, seq, payload)`` → ``(response_id, text)``: data lines before the first ``[DONE]``, reasoning taken out, trimmed."""
    return run_sql(
        r"""
        WITH d AS (SELECT response_id, seq, trim(substring(payload, 6)) AS piece FROM {chunks} WHERE startswith(payload, 'data:')),
        e AS (SELECT *, min(CASE WHEN piece = '[DONE]' THEN seq END) OVER (PARTITION BY response_id) AS done FROM d),
        t AS (SELECT response_id, array_join(transform(array_sort(collect_list(struct(seq, piece))), s -> s.piece), '') AS t FROM e WHERE done IS NULL OR seq < done GROUP BY response_id)
        SELECT response_id, regexp_replace(raw, r'^\s+|\s+$', '') AS text FROM (SELECT response_id, regexp_replace(t, r'(?s)<think>.*?(?:</think>\s*|$)', '') AS raw FROM t)
        """,
        chunks=chunks,
    )


def join_page_replies(replies: DataFrame) -> DataFrame:
    """``replies (response_id, index, markdown)`` → ``(response_id, text)``: pages by index, a blank line between."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("index", F.trim("markdown").alias("m")))), lambda s: s["m"])
    return replies.groupBy("response_id").agg(F.trim(F.array_join(held, "\n\n")).alias("text"))


def budget_pages(pages: DataFrame, caps: DataFrame) -> DataFrame:
    """``pages (scan_id, page, provider[, source_pdf])`` → ``(scan_id, provider, total, sent, dropped, notice)``.

    Twenty pages a scan, then the provider's cap, from the front.  A provider that reads documents, given a PDF, sends no pages and drops none.
    The caps are eleven rows and are broadcast.
    """
    if "source_pdf" not in pages.columns:
        pages = pages.withColumn("source_pdf", F.lit(False))
    return run_sql(
        f"""
        WITH n AS (SELECT p.*, row_number() OVER (PARTITION BY scan_id, provider ORDER BY page) AS nth FROM {{pages}} p),
        j AS (SELECT /*+ BROADCAST(c) */ n.*, c.takes_pdf AND n.source_pdf AS whole, coalesce(c.cap, {MOST_PAGES}) AS cap FROM n JOIN {{caps}} c USING (provider) WHERE nth <= {MOST_PAGES}),
        g AS (SELECT scan_id, provider, count(*) AS total, count_if(nth <= cap AND NOT whole) AS sent, count_if(nth > cap AND NOT whole) AS dropped, max(cap) AS cap FROM j GROUP BY scan_id, provider)
        SELECT scan_id, provider, total, sent, dropped, CASE WHEN dropped > 0 THEN concat('Note: ', provider, ' accepts ', cap, CASE WHEN cap = 1 THEN ' page' ELSE ' pages' END,
          ' per request, so only the first ', cap, ' of ', total, ' were scanned.') END AS notice FROM g
        """,
        pages=pages, caps=caps,
    )


def pending_transforms(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, kind, option)`` that the cache does not hold."""
    return requests.select("doc_id", "kind", "option").distinct().join(cache, ["doc_id", "kind", "option"], "left_anti")
