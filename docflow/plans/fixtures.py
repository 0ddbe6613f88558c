"""Derived tables: the driver's tables seen as pages, readings, codes and logs.

Each view is SQL over base tables and other views; where Spark and DuckDB differ there are two texts.  No view leaves rows out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.lines import Chars, of_text

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_ARABIC = "translate(lower(text),'abcdefghijklmnopqrstuvwxyz','ابتثجحخدذرزسشصضطظعغفقكلمنه')"

VIEWS: dict[str, str | tuple[str, str]] = {
    "doc_lines": (
        r"SELECT doc_id, n, t FROM documents LATERAL VIEW posexplode(split(text, '\n')) e AS n, t",
        "SELECT doc_id, CAST(generate_subscripts(a,1)-1 AS INTEGER) AS n, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    ),
    "page_lines": """SELECT doc_id, CAST(floor(n/12) AS BIGINT)+1 AS page, CAST(n AS BIGINT) AS line_id, t AS text, CAST((doc_id*31+n*17)%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence,
        CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0+least(240,6*length(t)+6) AS DOUBLE) AS x1, CAST(y0+12 AS DOUBLE) AS y1
        FROM (SELECT doc_id, n, t, 40+CAST(floor((n%12)/6) AS BIGINT)*300+(doc_id+n)%7 AS x0, 60+(n%6)*16+doc_id%3 AS y0 FROM doc_lines) q""",
    "reads": (
        f"""SELECT doc_id, page, line_id, 'universal' AS pack, CASE WHEN doc_id%3=0 THEN regexp_replace(text, '[a-z ]', '') ELSE text END AS text, confidence FROM page_lines
        UNION ALL SELECT doc_id, page, line_id, 'arabic', {_ARABIC}, CASE WHEN doc_id%3=0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END FROM page_lines""",
        f"""SELECT doc_id, page, line_id, 'universal' AS pack, CASE WHEN doc_id%3=0 THEN regexp_replace(text, '[a-z ]', '', 'g') ELSE text END AS text, confidence FROM page_lines
        UNION ALL SELECT doc_id, page, line_id, 'arabic', {_ARABIC}, CASE WHEN doc_id%3=0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END FROM page_lines""",
    ),
    # both readings of a line in one row, as structs; chars_of gives their characters
    "line_packs": (
        f"""SELECT doc_id, page, line_id, struct('arabic' AS pack, {_ARABIC} AS text) AS primary,
        struct('universal' AS pack, CASE WHEN doc_id%3=0 THEN regexp_replace(text, '[a-z ]', '') ELSE text END AS text) AS latin FROM page_lines WHERE text IS NOT NULL""",
        "SELECT 1 AS unused",
    ),
    "orientation_reads": (
        """SELECT r.doc_id, r.page, r.line_id, r.pack, f.flipped, CASE WHEN (r.doc_id%4=0)=f.flipped THEN r.text ELSE regexp_replace(r.text, '[a-m]', '') END AS text, r.confidence, p.x0, p.y0, p.x1, p.y1
        FROM reads r JOIN page_lines p ON p.doc_id=r.doc_id AND p.line_id=r.line_id LATERAL VIEW explode(array(true, false)) f AS flipped""",
        """SELECT r.doc_id, r.page, r.line_id, r.pack, f.flipped, CASE WHEN (r.doc_id%4=0)=f.flipped THEN r.text ELSE regexp_replace(r.text, '[a-m]', '', 'g') END AS text, r.confidence, p.x0, p.y0, p.x1, p.y1
        FROM reads r JOIN page_lines p ON p.doc_id=r.doc_id AND p.line_id=r.line_id CROSS JOIN (SELECT * FROM (VALUES (true),(false)) AS w(flipped)) f""",
    ),
    "chars": tuple(
        f"""SELECT doc_id, page, line_id, pack, ord, substring(text,ord+1,1) AS text, (CAST(ord AS DOUBLE)+CAST(0.5 AS DOUBLE)+CAST(0.6 AS DOUBLE)*CAST(6*floor(ord/20)+(floor(ord/5)%4)*(floor(ord/5)%4+1)/2 AS DOUBLE))/CAST(2*length(text) AS DOUBLE) AS x,
        CASE WHEN pack='arabic' THEN CASE WHEN CAST(floor(ord/6) AS BIGINT)%4=0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.97 AS DOUBLE) END
        ELSE CASE WHEN CAST(floor(ord/6) AS BIGINT)%4=0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END END AS confidence FROM (SELECT r.*, {explode} FROM reads r{lateral} WHERE length(text) > 0) q"""
        for explode, lateral in (("explode(sequence(0, length(text) - 1)) AS ord", ""), ("unnest(range(0, length(text)))::INTEGER AS ord", ""))
    ),
    "regions": """SELECT doc_id, page, g AS region_id, CASE g WHEN 0 THEN 'DOC_TITLE' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'TABLE' ELSE 'HEADER' END AS label, CAST(0.9 AS DOUBLE) AS score,
        min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT *, CAST(floor((line_id%12)/3) AS BIGINT) AS g FROM page_lines) q GROUP BY doc_id, page, g""",
    "some_regions": "SELECT * FROM regions WHERE label <> 'HEADER'",
    "cells": """SELECT doc_id, page, region_id, CAST(r*2+c AS BIGINT) AS cell_ord, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, 1 AS row_span, 1 AS col_span, x0+(x1-x0)*c/CAST(2 AS DOUBLE) AS x0, y0+(y1-y0)*r/CAST(2 AS DOUBLE) AS y0,
        x0+(x1-x0)*(c+1)/CAST(2 AS DOUBLE) AS x1, y0+(y1-y0)*(r+1)/CAST(2 AS DOUBLE) AS y1 FROM regions CROSS JOIN (SELECT * FROM (VALUES (0,0),(0,1),(1,0),(1,1)) AS v(r, c)) k WHERE label='TABLE'""",
    "frames": """SELECT event_id AS frame_id, event_id%5 AS camera_id, CAST(floor(event_id/5) AS BIGINT)*60 AS t_ms,
        CASE WHEN CAST(floor(event_id/5) AS BIGINT)%11=0 THEN NULL ELSE concat('code', CAST(CAST(floor(event_id/15) AS BIGINT)%7 AS VARCHAR(9))) END AS raw FROM events""",
    "requests": "SELECT event_id, (event_id*7+CAST(floor(event_id/13) AS BIGINT))%50 AS user_id, event_id*2 AS t_s FROM events",
    "attempts": """SELECT CAST(floor(event_id/6) AS BIGINT) AS scan_id, CAST(floor((event_id%6)/3) AS BIGINT) AS provider_rank, event_id%3+1 AS attempt,
        CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 429 WHEN 'purchase' THEN 401 WHEN 'click' THEN 200 END AS http_status,
        CASE event_type WHEN 'signup' THEN 'io' END AS error_kind, CASE event_type WHEN 'click' THEN 'ok' END AS text FROM events""",
    "payloads": """SELECT event_id AS scan_id, 0 AS ord, CASE WHEN event_id%8=0 THEN 'EAN_13' ELSE 'QR_CODE' END AS format,
        CASE event_id%8 WHEN 0 THEN lpad(CAST(event_id*7919 AS VARCHAR(20)),13,'0') WHEN 1 THEN concat('WIFI:T:WPA;S:net',CAST(user_id AS VARCHAR(20)),';P:pw;;')
        WHEN 2 THEN concat('https://h',CAST(user_id AS VARCHAR(20)),'.example.com/') WHEN 3 THEN concat('www.h',CAST(user_id AS VARCHAR(20)),'.example.com')
        WHEN 4 THEN concat('mailto:u',CAST(user_id AS VARCHAR(20)),'@example.com?subject=Hi%20there') WHEN 5 THEN concat('tel:+1555',lpad(CAST(user_id AS VARCHAR(20)),7,'0'))
        WHEN 6 THEN concat('smsto:+1555',lpad(CAST(user_id AS VARCHAR(20)),7,'0'),':hello') ELSE concat('MECARD:N:Doe,J',CAST(user_id AS VARCHAR(20)),';TEL:555;;') END AS raw FROM events""",
    "sparse_payloads": "SELECT scan_id, ord, format, CASE scan_id%3 WHEN 0 THEN '  ' WHEN 1 THEN raw END AS raw FROM payloads",
    "scored_regions": "SELECT doc_id, page, region_id, CASE WHEN (doc_id+region_id)%5=0 THEN 'UNHEARD_OF' ELSE label END AS label, CAST((doc_id*7+region_id*3)%10 AS DOUBLE)/CAST(10 AS DOUBLE) AS score, x0, y0, x1, y1 FROM regions",
    "codes": """SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN concat('978',lpad(CAST(p_partkey AS VARCHAR(20)),10,'0')) ELSE lpad(CAST(p_partkey*13+10000000 AS VARCHAR(20)),12,'0') END AS code FROM part""",
    "sources": "SELECT * FROM (VALUES ('off',0),('gbooks',1),('openlib',2),('fda',3),('beauty',5),('pet',6)) AS v(source, priority)",
    "catalog": """SELECT s.source, s.priority, c.code, p.p_name AS name, p.p_brand AS brand FROM part p JOIN codes c ON c.p_partkey=p.p_partkey JOIN sources s ON (p.p_partkey*5+s.priority)%9 IN (0,4)""",
    "source_status": """SELECT c.code, s.source, CASE WHEN c.p_partkey%13=0 OR (c.p_partkey*3+s.priority)%5=0 THEN 'error' ELSE 'ok' END AS status FROM codes c CROSS JOIN sources s""",
    "replies": (
        """SELECT s.source, CASE WHEN s.source IN ('off','beauty','pet') THEN to_json(named_struct('asked', c.code, 'status', 'success', 'product', named_struct('product_name', p.p_name, 'brands', p.p_brand, 'nutriscore_grade', 'b',
          'nutriments', named_struct('energy-kcal_100g', p.p_retailprice, 'fat_100g', CAST(p.p_partkey % 50 AS DOUBLE) / 2))))
        WHEN s.source = 'gbooks' THEN to_json(named_struct('asked', c.code, 'totalItems', 1, 'items', array(named_struct('volumeInfo', named_struct('title', p.p_name, 'publisher', p.p_brand)))))
        WHEN s.source = 'openlib' THEN to_json(named_struct('asked', c.code, 'book', named_struct('title', p.p_name, 'publishers', array(named_struct('name', p.p_brand)))))
        ELSE to_json(named_struct('asked', c.code, 'field', 'upc', 'results', array(named_struct('openfda', named_struct('brand_name', array(p.p_name), 'manufacturer_name', array(p.p_brand)))))) END AS line
        FROM part p JOIN codes c ON c.p_partkey=p.p_partkey JOIN sources s ON (p.p_partkey*5+s.priority)%9 IN (0,4)""",
        "SELECT 1 AS unused",
    ),
    "md_docs": (
        r"""SELECT l_orderkey AS doc_id, concat('# Order ', CAST(l_orderkey AS STRING), '\n\nDue **now**\n\n| Part | Qty |\n| --- | --- |\n', listagg(concat('| **', CAST(l_partkey AS STRING), '** | ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' |'), '\n') WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_quantity), '\n\n- [x] paid\n1. thanks\n') AS text FROM lineitem GROUP BY l_orderkey""",
        """SELECT l_orderkey AS doc_id, concat('# Order ', CAST(l_orderkey AS VARCHAR), chr(10)||chr(10)||'Due **now**'||chr(10)||chr(10)||'| Part | Qty |'||chr(10)||'| --- | --- |'||chr(10), string_agg(concat('| **', CAST(l_partkey AS VARCHAR), '** | ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' |'), chr(10) ORDER BY l_linenumber, l_partkey, l_quantity), chr(10)||chr(10)||'- [x] paid'||chr(10)||'1. thanks'||chr(10)) AS text FROM lineitem GROUP BY l_orderkey""",
    ),
    "chunks": "SELECT conv_id AS response_id, turn AS seq, CASE WHEN turn=0 THEN 'data: <think>plan</think>' WHEN turn=5 THEN 'data: [DONE]' WHEN turn=2 THEN ': keep-alive' ELSE concat('data: ', text) END AS payload FROM conversations",
    "changes": """SELECT source AS owner, doc_id*4 AS seq, 'insert' AS op, CAST(doc_id AS VARCHAR(20)) AS id, text, '' AS image_uri, doc_id*1000 AS ts_ms FROM documents
        UNION ALL SELECT source, doc_id*4+1, 'update', CAST(doc_id AS VARCHAR(20)), concat('edited ', text), NULL, NULL FROM documents WHERE doc_id%5=0
        UNION ALL SELECT source, doc_id*4+2, 'delete', CAST(doc_id-8 AS VARCHAR(20)), NULL, NULL, NULL FROM documents WHERE doc_id%7=0
        UNION ALL SELECT source, doc_id*4+3, 'clear', NULL, NULL, NULL, NULL FROM documents WHERE doc_id%157=0
        UNION ALL SELECT source, doc_id*4+3, 'update', ' ', 'nobody', NULL, NULL FROM documents WHERE doc_id%11=0""",
    "history": "SELECT source AS owner, CAST(doc_id AS VARCHAR(20)) AS id, text, doc_id*1000 AS ts_ms FROM documents",
    "page_results": """SELECT doc_id, page, CASE WHEN count(*) % 5 = 0 THEN 'error' ELSE 'success' END AS status, max(text) AS text, CAST(NULL AS VARCHAR(9)) AS markdown FROM page_lines GROUP BY doc_id, page""",
    "altered": "SELECT doc_id, page, line_id, pack, CASE pack WHEN 'arabic' THEN translate(text, 'ايب', 'أىت') ELSE translate(text, 'aeo', 'oae') END AS text FROM reads",
    "rereads": "SELECT doc_id, CASE WHEN doc_id%3=0 THEN translate(text, 'aeo', 'oae') ELSE translate(text, 'eqhz', 'a') END AS text FROM documents",
}


def chars_of(reading: dict) -> Chars:
    """The rows of ``chars`` of one reading (pack, text), as arrays: the view's formulas, term by term."""
    n = len(reading["text"])
    at = np.arange(n)
    step = at // 5 % 4
    x = (at + 0.5 + 0.6 * (6 * (at // 20) + step * (step + 1) / 2)) / float(max(1, 2 * n))
    first, other = (0.4, 0.97) if reading["pack"] == "arabic" else (0.95, 0.3)
    return of_text(reading["text"], x, np.where(at // 6 % 4 == 0, first, other))


def _needs(sql: str) -> list[str]:
    return [v for v in [*VIEWS, *BASE] if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived view over the tables of ``sf_dir``."""
    if name in BASE:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.createOrReplaceTempView(name)
        return df
    sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    for need in _needs(sql):
        table(spark, sf_dir, need)
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it needs in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for need in _needs(text):
            if need in VIEWS and need not in order:
                visit(VIEWS[need] if isinstance(VIEWS[need], str) else VIEWS[need][1])
                order.append(need)

    visit(sql)
    ctes = ", ".join(f"{v} AS ({VIEWS[v] if isinstance(VIEWS[v], str) else VIEWS[v][1]})" for v in order)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
