"""Exports: page JSON, CSV of tables, bulk documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.text import split_pages
from .files import registered


def page_json(page_lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, json)``: pages ascending, each with ordered lines of text, confidence and integer box; documents without boxes get
    the non-blank lines of their marked text."""
    box = F.array(*(F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")))
    line = F.struct("text", "confidence", box.alias("box"))
    boxed = page_lines.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", line.alias("l")))), lambda s: s["l"]).alias("lines"))
    boxed = boxed.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("page", "lines")))).alias("pages"))
    plain = split_pages(docs.join(page_lines.select("doc_id").distinct(), "doc_id", "left_anti")).where("text <> ''")
    plain = plain.groupBy("doc_id", "page_ord", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.struct("text").alias("l")))), lambda s: s["l"]).alias("lines"))
    plain = plain.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", F.struct("page", "lines").alias("p")))), lambda s: s["p"])).alias("pages"))
    every = boxed.unionByName(plain)
    d = docs.select("doc_id", F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("head")).join(every, "doc_id", "left")
    return d.select("doc_id", F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"pages":'), F.coalesce("pages", F.lit("[]")), F.lit("}")).alias("json"))


def csv_rows(table_cells: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``: a cell is quoted only if it holds a comma, a quote or a line feed; an empty line between tables."""
    quoted = F.when(F.col("value").rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(F.col("value"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("value"))
    rows = table_cells.groupBy("doc_id", "table_no", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", quoted.alias("q")))), lambda s: s["q"]), ",").alias("line"))
    gaps = rows.where("table_no > 0").select("doc_id", "table_no", F.lit(-1).cast("long").alias("row"), F.lit("").alias("line")).distinct()
    every = rows.unionByName(gaps)
    return every.sparkSession.sql("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY table_no, row) - 1 AS BIGINT) AS line_no, line FROM {e}", e=every)


def csv_documents(table_cells: DataFrame) -> DataFrame:
    """``(doc_id, csv)`` of documents that have a table: its rows, each ended by CRLF."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.concat(s["line"], F.lit("\r\n")))
    return csv_rows(table_cells).groupBy("doc_id").agg(F.array_join(lines, "").alias("csv"))


def _write(files: DataFrame, suffix: str, path: str, mode: str) -> None:
    registered(files.sparkSession)
    files.write.format("named_files").option("suffix", suffix).mode(mode).save(path)


def write_tables_csv(table_cells: DataFrame, path: str, mode: str = "append") -> None:
    """A CSV file with CRLF for each document that has a table, named by its id, many in a folder (``sources.files``)."""
    _write(csv_documents(table_cells).select(F.col("doc_id").cast("string").alias("name"), F.col("csv").alias("value")), ".csv", path, mode)


def write_documents(docs: DataFrame, titles: DataFrame, fmt: str, path: str, table_cells: DataFrame | None = None, mode: str = "append") -> None:
    """Bulk export of ``docs (doc_id, text)`` as files ``<doc_id> <title>.<fmt>``, many in a folder: ``txt``, ``md``, ``json`` or ``csv`` (only documents with a
    table).  Texts are written as they are; null texts are empty files, null in JSON."""
    named = docs.select("doc_id", "text").join(titles.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), "title").alias("name")), "doc_id")
    if fmt == "csv":
        files = named.join(csv_documents(table_cells), "doc_id").select("name", F.col("csv").alias("value"))
    elif fmt == "json":
        files = named.select("name", F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("value"))
    else:
        files = named.select("name", F.col("text").alias("value"))
    _write(files, f".{fmt}", path, mode)
