"""Product codes: routing to sources and lookup by priority.

A source is a ``Source``: its name, priority, category, and the SQL predicate on ``code`` that says which codes it may answer.  A new source is
one more entry in the list that is passed; nothing here is edited for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import run_sql


class Source(NamedTuple):
    source: str
    priority: int
    category: str
    eligible: str


# Which codes a category's sources may answer, and the sources in priority order (there is no priority 4).
RULES = {
    "product": r"code rlike '^[0-9]{8,13}$'",
    "book": r"replace(code, '-', '') rlike '^([0-9]{9}[0-9Xx]|[0-9]{13})$'",
    "medicine": r"length(regexp_replace(code, '[^0-9]', '')) BETWEEN 10 AND 13",
}
SOURCES = tuple(Source(name, priority, kind, RULES[kind]) for name, priority, kind in (("off", 0, "product"), ("gbooks", 1, "book"), ("openlib", 2, "book"), ("fda", 3, "medicine"), ("beauty", 5, "product"), ("pet", 6, "product")))


def route_codes(codes: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """``(code, source, priority)``: the sources that may answer each distinct code, each source's predicate asked once a code, without a join."""
    able = F.array(*(F.when(F.expr(s.eligible), F.struct(F.lit(s.source).alias("source"), F.lit(s.priority).alias("priority"))) for s in sources))
    return codes.select("code").distinct().select("code", F.inline(F.array_compact(able)))


def lookup_products(codes: DataFrame, products: DataFrame, source_status: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """``(code, status, source, name, brand)``: the first *found* source by priority; a failing one does not block those behind it.

    Without an eligible source ``not_found``; ``error`` if every eligible source failed; else ``not_found``.
    """
    routed = route_codes(codes, sources)
    return run_sql(
        """
        WITH p AS (SELECT source, code, min_by(struct(name, brand), name) AS record FROM {products} WHERE trim(name) <> '' GROUP BY source, code),
        e AS (SELECT DISTINCT code, source FROM {status} WHERE status = 'error'),
        j AS (SELECT r.code, r.source, r.priority, p.record, e.code IS NOT NULL AS failed FROM {routed} r
              LEFT JOIN p ON r.code = p.code AND r.source = p.source LEFT JOIN e ON r.code = e.code AND r.source = e.source),
        b AS (SELECT code, min_by(struct(source, record), priority) FILTER (WHERE record IS NOT NULL AND NOT failed) AS best, count_if(failed) = count(*) AS all_failed FROM j GROUP BY code)
        SELECT c.code, CASE WHEN b.best IS NOT NULL THEN 'found' WHEN b.all_failed THEN 'error' ELSE 'not_found' END AS status,
          b.best.source AS source, b.best.record.name AS name, b.best.record.brand AS brand
        FROM (SELECT DISTINCT code FROM {codes}) c LEFT JOIN b ON c.code = b.code
        """,
        codes=codes, products=products, status=source_status, routed=routed,
    )
