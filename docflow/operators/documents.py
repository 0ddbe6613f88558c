"""Documents out of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble_document(page_results: DataFrame) -> DataFrame:
    """``page_results (doc_id, page, status, text, markdown)`` → ``(doc_id, text, markdown)``: successful pages in order.

    Before page N stands its marker, once text is there; Markdown pages are joined by a rule.  Empty and failed pages are skipped.
    """
    ok = page_results.where("status = 'success'")
    w = Window.partitionBy("doc_id").orderBy("page")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.when(before > 0, F.concat(F.lit("\n\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n\n"))).otherwise("")
    d = ok.select("doc_id", "page", F.concat(head, "text").alias("t"), F.regexp_replace("markdown", r"\s+$", "").alias("m"))
    held = F.array_sort(F.collect_list(F.struct("page", "t", "m")))
    d = d.groupBy("doc_id").agg(held.alias("h"))
    text = F.array_join(F.transform("h", lambda s: s["t"]), "")
    md = F.array_join(F.filter(F.transform("h", lambda s: s["m"]), lambda m: m.isNotNull()), "\n\n---\n\n")
    return d.select("doc_id", text.alias("text"), F.when(F.trim(md) != "", md).alias("markdown")).where("text <> ''")
