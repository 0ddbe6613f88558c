"""Goldens through the public functions, and every oracle on the smallest tables."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docflow import queries
from docflow.operators import actions, evaluate, history, layout, markdown, products, readings, text
from docflow.plans.fixtures import BASE
from docflow.sources.history import parse_history

SF = "/root/testdata/sf0.001"
LINES = "doc_id long, page long, line_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 1, i, f"t{i}", 0.9, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rows)], LINES)


def order(df):
    return [r.line_id for r in df.orderBy("read_pos").collect()]


def test_reading_order_of_columns(spark):
    from pyspark.sql import functions as F

    two = boxes(spark, (0, 0, 100, 20), (0, 24, 100, 20), (200, 0, 100, 20), (200, 24, 100, 20))
    assert order(layout.reading_order(two)) == [0, 1, 2, 3]
    assert order(layout.reading_order(two, F.lit(True))) == [2, 3, 0, 1]


@pytest.mark.parametrize("rows, rtl, want", [
    ([(0, 0, 300, 20), (0, 40, 300, 20), (0, 80, 300, 20)], False, [0, 1, 2]),
    ([(0, 0, 100, 20), (0, 25, 100, 20), (200, 0, 100, 20), (200, 25, 100, 20)], False, [0, 1, 2, 3]),
    ([(0, 0, 100, 20), (0, 25, 100, 20), (200, 0, 100, 20), (200, 25, 100, 20)], True, [2, 3, 0, 1]),
    ([(0, 0, 300, 15), (0, 40, 80, 20), (0, 65, 80, 20), (220, 40, 80, 20), (220, 65, 80, 20)], False, [0, 1, 2, 3, 4]),
    ([(0, 30, 300, 20), (0, 60, 300, 20), (0, 90, 300, 20), (110, 0, 80, 15)], False, [3, 0, 1, 2]),
    ([(200, 0, 80, 20), (0, 0, 80, 20)], False, [1, 0]),
    ([], False, []),
])
def test_reading_order_goldens(spark, rows, rtl, want):
    lines = boxes(spark, *rows) if rows else boxes(spark, (0, 0, 1, 1)).limit(0)
    # whole pages only: the same boxes on several pages, among others
    every = lines.withColumn("page", F.explode(F.array(*(F.lit(p).cast("long") for p in (1, 2, 9)))))
    for page in (1, 2, 9):
        assert order(layout.reading_order(every, F.lit(rtl)).where(F.col("page") == page)) == want


def test_bands_turn_by_their_own_letters(spark):
    """With ``lean`` the page's sum says which column comes first, and each band's sum which way it is read."""
    rows = [(0, 0, 80, 20), (100, 0, 80, 20), (0, 40, 80, 20), (100, 40, 80, 20)]
    lean = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), F.col("line_id").cast("int") + 1)
    assert order(layout.reading_order(boxes(spark, *rows), lean=lean(5, 5, -1, -1))) == [1, 0, 2, 3]
    two = [(0, 0, 100, 20), (0, 24, 100, 20), (200, 0, 100, 20), (200, 24, 100, 20)]
    assert order(layout.reading_order(boxes(spark, *two), lean=lean(9, -1, -1, -1))) == [2, 3, 0, 1]
    assert order(layout.reading_order(boxes(spark, *two), lean=lean(None, None, None, None))) == [0, 1, 2, 3]


def by_recursion(rows, rtl, depth=0):
    """The cuts as their definition says it, one page at a time."""
    def gap(lo, hi):
        best, cut, reach = 0, 0, None
        for r in sorted(rows, key=lambda r: r[lo]):
            if reach is not None and r[lo] - reach > best:
                best, cut = r[lo] - reach, (r[lo] + reach) / 2
            reach = r[hi] if reach is None else max(reach, r[hi])
        return best, cut

    def extent(part, lo, hi):
        return max(r[hi] for r in part) - min(r[lo] for r in part) if part else 0

    if len(rows) > 2 and depth < layout.DEPTH:
        (vg, vc), (hg, hc) = gap(1, 3), gap(2, 4)
        w, h = extent(rows, 1, 3), extent(rows, 2, 4)
        sides = [[r for r in rows if ((r[1] + r[3]) / 2 >= vc) == x] for x in (False, True)]
        ends = [[r for r in rows if ((r[2] + r[4]) / 2 >= hc) == x] for x in (False, True)]
        v = vg >= max(6, 0.015 * w) and all(len(p) >= 2 and extent(p, 2, 4) >= 0.4 * h and extent(p, 1, 3) >= 0.2 * w for p in sides)
        t = hg >= max(6, 0.02 * h) and all(ends)
        if t and (not v or abs(vg / w - hg / h) <= 0.02 or hg / h > vg / w):
            return by_recursion(ends[0], rtl, depth + 1) + by_recursion(ends[1], rtl, depth + 1)
        if v:
            first, second = sides[::-1] if rtl else sides
            return by_recursion(first, rtl, depth + 1) + by_recursion(second, rtl, depth + 1)
    bands = []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if bands and abs((r[2] + r[4]) / 2 - (bands[-1][0][2] + bands[-1][0][4]) / 2) < 0.6 * max(r[4] - r[2], bands[-1][0][4] - bands[-1][0][2]):
            bands[-1].append(r)
        else:
            bands.append([r])
    return [r[0] for b in bands for r in (sorted(b, key=lambda r: (r[1], r[2], r[0]), reverse=rtl))]


@pytest.mark.parametrize("rtl", [False, True])
def test_reading_order_against_recursion(spark, rtl):
    rng = random.Random(3)
    pages = {}
    for p in range(150):
        for k in range(rng.randint(1, 30)):
            x, y = rng.choice([0, 0, 150, 320]) + rng.randint(0, 20), rng.randint(0, 40) * 12 + rng.randint(0, 5)
            pages.setdefault(p, []).append((k, float(x), float(y), float(x + rng.randint(20, 140)), float(y + rng.choice([10, 12, 20]))))
    rows = [(p // 3, p, *r) for p, rs in pages.items() for r in rs]
    d = spark.createDataFrame(rows, "doc_id long, page long, line_id long, x0 double, y0 double, x1 double, y1 double").repartition(4).withColumn("band", F.lit("clash"))
    got = layout.reading_order(d, F.lit(rtl))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    placed = {}
    for r in sorted(got.collect(), key=lambda r: r.read_pos):
        placed.setdefault(r.page, []).append(r.line_id)
    assert placed == {p: by_recursion(rs, rtl) for p, rs in pages.items()}


def test_region_order_of_nested_columns(spark):
    """A title, two columns of which one is stacked, a footer; boxes that overlap by less than 8; missing edges; ties by id."""
    rows = [(0, 0, 300, 20), (0, 30, 140, 60), (160, 30, 140, 20), (160, 52, 140, 38), (0, 95, 300, 10)]
    d = boxes(spark, *rows).withColumnRenamed("line_id", "region_id")
    assert [r.region_id for r in layout.region_order(d).orderBy("read_pos").collect()] == [0, 1, 2, 3, 4]
    same = boxes(spark, (0, 0, 50, 50), (0, 0, 50, 50), (5, 5, 50, 50)).withColumnRenamed("line_id", "region_id")
    assert [r.region_id for r in layout.region_order(same).orderBy("read_pos").collect()] == [0, 1, 2]
    empty = same.withColumn("x1", F.lit(None).cast("double"))
    assert layout.region_order(empty).count() == 3 and layout.region_order(empty.limit(0)).count() == 0


def test_reading_order_keeps_every_line_once(spark):
    rows = [(x, y, 80, 12) for x in (0, 150, 300) for y in range(0, 200, 20)]
    assert sorted(order(layout.reading_order(boxes(spark, *rows)))) == list(range(len(rows)))


def test_titles(spark):
    docs = spark.createDataFrame([(1, "# Annual report 2024\nbody"), (2, "--- Page 1 ---\n\n"), (3, "of the\nbig invoice\nfrom acme works")], "doc_id long, text string")
    got = {r.doc_id: r.title for r in text.suggest_titles(docs).collect()}
    assert got == {1: "Annual Report 2024", 2: "Scanned Document", 3: "Big Invoice Acme Works"}


def test_titles_are_read_inside_the_row(spark):
    texts = ["of the\nof", None, "x\n- [x] ßa Ünder ΣΑΣ σας\nmore words here", "so\n" * 25 + "late words", "«Foo» foo FOO bar²! a-b-c\n## _Head_ of|it\n", "w" * 91 + " z9\nshort one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "some words")], "doc_id long, text string")
    titles = text.suggest_titles(docs)
    plan = titles._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.title for r in titles.collect()} == {
        0: "Scanned Document", 1: "Scanned Document", 2: "ẞa Ünder ΣΑΣ", 3: "Scanned Document", 4: "Head Foo Bar²", 5: "Short One Z9", None: "Scanned Document"}
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1  # only titles are exchanged


def test_written_documents_are_read_back_by_folder(spark):
    got = queries.QUERIES["write_documents"](spark, SF)
    paths = int(re.search(r"InMemoryFileIndex\((\d+) paths?\)", got._jdf.queryExecution().executedPlan().toString())[1])
    assert paths <= 8 and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_split_pages(spark):
    docs = spark.createDataFrame([(1, "a\n\n--- Page 2 ---\n\nb\n\nc\n")], "doc_id long, text string")
    assert [(r.page, r.text) for r in text.split_pages(docs).orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (2, ""), (2, "c")]


def test_markdown_blocks_and_plain_text(spark):
    md = "# A *b* c\n\n```\n| x |\n```\n> q\n> r\np1\np2\n---\n- [x] done\n1. n\n| a | b |\n| - | - |\n| 1 |\n"
    blocks = markdown.markdown_blocks(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    kinds = [r.kind for r in blocks.orderBy("block_no").collect()]
    assert kinds == ["heading", "code", "quote", "paragraph", "divider", "bullet", "numbered", "table"]
    assert [r.rows for r in blocks.where("kind = 'table'").collect()] == [[["a", "b"], ["1", ""]]]
    assert markdown.plain_text(blocks).first().text.startswith("A b c\n\n| x |\n\nq\nr\n\np1\np2\n\n\n• ☑ done\n1. n\na   b\n1")


def test_inline_marks(spark):
    want = {
        "**a** *b* ~~c~~ `d*` [e](f) 5 * 3 \\* **open": "a b c d* e 5 * 3 * **open", "plain **bold** *it* `code` ~~out~~ <u>u</u>": "plain bold it code out u", "*it* ": "it ", "*it*": "it*",  # a star that ends the text is next to no word
        "5 * 3 = 15": "5 * 3 = 15", "5*3=15": "5*3=15", "Use *asterisk for footnotes": "Use *asterisk for footnotes", "a ** b": "a ** b", "open ~~strike": "open ~~strike", "a <u> b": "a <u> b",
        "\\- not a bullet": "- not a bullet", "5 \\* 3": "5 * 3", "C:\\temp\\file": "C:\\temp\\file", "5\\|10": "5|10", "see [docs](https://x.dev/a_b*c) here": "see docs here", "***both*** <U>x</U>": "both x",
        "`a\\*b` and `*c": "a\\*b and `*c", "\\\\*x* ": "\\x ", "[a **b** c](d) [e] (f)": "a **b** c [e] (f)", "": "",
        "***a**": "a", "<u>a <u>b</u>": "a b", "**a `** `": "a ** ", "***": "***", "a*": "a*", "**a ***b* ": "a b ", "****x": "****x", "~~a ~~ b~~c": "a  b~~c", "</u>": "</u>", "<U>a</U> </u>": "a </u>", "*a\n*": "a\n*",
    }
    rows = spark.createDataFrame([(k, v) for k, v in want.items()] + [(None, None)], "x string, want string")
    got = rows.select("x", "want", markdown.inline_plain(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]


def test_payload_escapes(spark):
    p = spark.createDataFrame([(1, 0, "QR_CODE", r"WIFI:T:WPA;S:my\;net;P:a\:b;;"), (2, 0, "QR_CODE", "mailto:a%2Bb+c@x.org?subject=Hi%20there"), (3, 0, "QR_CODE", "  ")], "scan_id long, ord int, format string, raw string")
    got = {(r.scan_id, r.kind): r for r in actions.payload_actions(p).collect()}
    assert got[1, "wifi"].key == "my;net" and got[1, "wifi"].attrs == {"password": "a:b", "security": "WPA"}
    assert got[2, "email"].key == "a+b+c@x.org" and got[2, "email"].attrs["subject"] == "Hi there"
    assert not any(k[0] == 3 for k in got)


def test_logical_order(spark):
    lines = spark.createDataFrame([(1, "ba 2.5 noisreV اب"), (2, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in readings.logical_order(lines, "doc_id").collect()}
    assert got[2] == "plain" and got[1].startswith("با")


def test_a_hot_name_is_numbered_by_many_tasks(spark):
    """A third of the rows fall back to one name: several tasks number them; null names are a group of their own."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '...' WHEN id % 500 = 1 THEN NULL ELSE concat('n ', id % 40, '.pdf') END AS name").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = text.sanitize_names(docs, "pdf").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by: dict = {}
    for r in got:
        by.setdefault(r.name, []).append((r.doc_id, r.copy_no, r.task))
    assert len(got) == 3000 and len(by[text.FALLBACK]) == 1000 and len({t for *_, t in by[text.FALLBACK]}) >= 2 and None in by
    for rows in by.values():
        assert [n for _, n, _ in sorted(rows)] == list(range(len(rows)))


def test_spaces_at_several_factors(spark):
    """Steps of 1, 2 and 3 pitches between Arabic letters, one between others: each factor decides by itself."""
    at = [0, 1, 2, 4, 5, 8, 9, 10, 13, 14]
    letters = "ابتثجحخدxy"
    chars = spark.createDataFrame([(1, 1, 1, i, c, x / 20) for i, (c, x) in enumerate(zip(letters, at))] + [(1, 1, 2, 0, "ا", 0.1), (1, 1, 2, 1, "ب", 0.9)], "doc_id long, page long, line_id long, ord int, text string, x double")
    got = {(r.line_id, r.factor): r.text for r in readings.spaces_at(chars, (0.0, 1.7, 2.5, 4.0)).collect()}
    assert got == {(1, 0.0): letters, (1, 1.7): "ابت ثج حخدxy", (1, 2.5): "ابتثج حخدxy", (1, 4.0): letters, (2, 0.0): "اب", (2, 1.7): "اب", (2, 2.5): "اب", (2, 4.0): "اب"}
    assert readings.recover_spaces(chars, 1.7).where("line_id = 1").first().text == "ابت ثج حخدxy"


def test_a_new_source_is_one_more_row(spark):
    """Its own predicate on the code, its own priority; nothing of the library knows it."""
    own = products.Source("films", 4, "film", "code LIKE 'F-%' OR length(code) = 12")
    codes = spark.createDataFrame([("F-1",), ("036000291452",), ("nonsense",), (None,), ("F-1",)], "code string")
    got = {(r.code, r.source, r.priority) for r in products.route_codes(codes, [*products.SOURCES, own]).collect()}
    assert got == {("F-1", "films", 4), ("036000291452", "films", 4), *(("036000291452", s.source, s.priority) for s in products.SOURCES if s.category != "book")}
    held = spark.createDataFrame([("films", "F-1", "A film", "b"), ("pet", "036000291452", "food", "c")], "source string, code string, name string, brand string")
    status = spark.createDataFrame([("036000291452", "films", "error")], "code string, source string, status string")
    found = {r.code: (r.status, r.source, r.name) for r in products.lookup_products(codes, held, status, [*products.SOURCES, own]).collect()}
    assert found["F-1"] == ("found", "films", "A film") and found["036000291452"] == ("found", "pet", "food") and found["nonsense"][0] == "not_found"


def test_line_recall_without_loss(spark):
    hyp = spark.createDataFrame([(1, "xx the quick brown fox jumqs over yy")], "doc_id long, text string")
    truth = spark.createDataFrame([(1, 1, "quick brown fox jumps"), (1, 2, "entirely different words")], "doc_id long, line_id long, text string")
    r = evaluate.line_recall(hyp, truth).first()
    assert (r.hits, r.lines) == (1, 2)


def test_history_changes_and_files(spark):
    h = spark.createDataFrame([("o", str(i), f"t{i}", "", i) for i in range(50)], "owner string, id string, text string, image_uri string, ts_ms long")
    c = spark.createDataFrame([("o", 1, "insert", "new", "n", "", 99), ("o", 2, "update", "3", "edited", None, None), ("o", 3, "delete", "4", None, None, None), ("o", 4, "update", "none", "x", None, None)], "owner string, seq long, op string, id string, text string, image_uri string, ts_ms long")
    got = {r.id: r.text for r in history.apply_changes(h, c).collect()}
    assert got["new"] == "n" and got["3"] == "edited" and "4" not in got and "none" not in got and len(got) == 50
    files = spark.createDataFrame([("a", '[{"id":"1","text":"x"}]'), ("b", "[]"), ("c", '[{"id":"1"'), ("d", "garbage")], "owner string, value string")
    good, bad = parse_history(files)
    assert [r.owner for r in good.collect()] == ["a"] and {r.owner for r in bad.collect()} == {"c", "d"}


@pytest.mark.parametrize("name", ["action_summary", "lookup_products", "stable_detections", "admit_requests", "band_rows", "choose_reading", "extract_tables", "suggest_titles"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    mine = sorted(repr([norm(r[c]) for c in cols]) for r in got.collect())
    rel = con.sql(queries.ORACLES[name])
    theirs = sorted(repr([norm(dict(zip(rel.columns, r))[c]) for c in cols]) for r in rel.fetchall())
    assert mine == theirs
