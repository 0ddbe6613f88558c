"""Structure of pages to Markdown: regions and lines with their boxes, and what is wanted of the text."""

import pytest
from pyspark.sql import functions as F

from docflow import queries
from docflow.operators import layout

LINES = "doc_id long, page long, line_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
REGIONS = "doc_id long, page long, region_id long, label string, score double, x0 double, y0 double, x1 double, y1 double"
CELLS = "doc_id long, page long, region_id long, cell_ord long, r long, c long, row_span int, col_span int, x0 double, y0 double, x1 double, y1 double"
COLUMNS = (100, 200, 300, 400, 500, 600)


def region(label, top, bottom, left=0, right=500):
    return label, left, top, right, bottom


def table_lines():
    rows = {100: "Name Tamil English Maths Science Total", 140: "Moni 80 85 88 82", 180: "Selvi 90 98 98 90", 220: "Susmi 85 90 80 90"}
    return [(text, COLUMNS[i], y) for y, cells in rows.items() for i, text in enumerate(cells.split())]


PIPES = """| Name | Tamil | English | Maths | Science | Total |
| --- | --- | --- | --- | --- | --- |
| Moni | 80 | 85 | 88 | 82 |   |
| Selvi | 90 | 98 | 98 | 90 |   |
| Susmi | 85 | 90 | 80 | 90 |   |
"""
QUESTION = "Question 1: Highlight above 90 Marks."
WIDE = ("TABLE", 80, 80, 700, 260)

# name: regions, lines (text, left, top), cells (row, column, x0, y0, x1, y1), a line's width and height, the whole text or parts in their order, what is absent
CASES = {
    "headings and paragraphs": ([region("DOC_TITLE", 0, 20), region("PARAGRAPH_TITLE", 30, 50), region("TEXT", 60, 100)], [("Quarterly Report", 10, 5), ("Summary", 10, 35), ("Revenue grew", 10, 65), ("across regions", 10, 80)], [], (60, 10), "# Quarterly Report\n\n## Summary\n\nRevenue grew  \nacross regions\n", ()),
    "furniture stays out": ([region("HEADER", 0, 20), region("TEXT", 30, 60), region("FOOTER", 70, 90)], [("confidential", 10, 5), ("Body text", 10, 35), ("page 4 of 9", 10, 75)], [], (60, 10), ["Body text"], ("confidential", "page 4 of 9")),
    "cells make a pipe table": ([region("TABLE", 100, 150, 0, 100)], [("Item", 5, 102), ("Qty", 55, 102), ("Bolt", 5, 127), ("2", 55, 127)], [(0, 0, 0, 100, 40, 120), (0, 1, 50, 100, 90, 120), (1, 0, 0, 125, 40, 145), (1, 1, 50, 125, 90, 145)], (60, 10), "| Item | Qty |\n| --- | --- |\n| Bolt | 2 |\n", ()),
    "a table without cells is lines": ([region("TABLE", 0, 50)], [("Item Qty", 5, 10)], [], (60, 10), "Item Qty\n", ()),
    "a title that overlaps comes first": ([region("DOC_TITLE", 0, 60, 200, 400), region("TEXT", 45, 200, 80, 400)], [("The Title", 210, 10), ("Body text", 90, 100)], [], (60, 10), ["# The Title", "Body text"], ()),
    "columns from left to right": ([region("TEXT", 0, 200, 300, 500), region("TEXT", 0, 200, 0, 200)], [("right column", 310, 20), ("left column", 10, 20)], [], (60, 10), ["left column", "right column"], ()),
    "an abstract is body text": ([region("ABSTRACT", 0, 60)], [("We present a method for", 10, 10)], [], (60, 10), "We present a method for\n", ()),
    "lines outside every region": ([region("TEXT", 0, 30)], [("inside", 10, 10), ("orphan", 10, 200)], [], (60, 10), ["inside", "orphan"], ()),
    "a grid from lines alone": ([WIDE], table_lines(), [], (40, 14), PIPES, ()),
    "prose is no table": ([("TEXT", 80, 80, 700, 260)], [(QUESTION, 100, 100), ("Question 2: Double Line Border.", 100, 140)], [], (40, 14), ["Question 1"], ("|",)),
    "a long header is a heading misread": ([("HEADER", 80, 80, 700, 260)], [(QUESTION, 100, 100)], [], (40, 14), ["Question 1"], ()),
    "uncovered text in its place": ([WIDE], [(QUESTION, 100, 20), *table_lines()], [], (40, 14), ["Question 1", "| Name"], ()),
    "a heading region": ([("PARAGRAPH_TITLE", 80, 80, 700, 260)], [(QUESTION, 100, 100)], [], (40, 14), ["## Question 1"], ()),
    "stacked paragraphs in a column": ([region("TEXT", 0, 300, 0, 200), region("TEXT", 310, 600, 0, 200), region("TEXT", 0, 600, 300, 500)], [("left first", 10, 20), ("left second", 10, 320), ("right column", 310, 20)], [], (60, 10), ["left first", "left second", "right column"], ()),
    "a line below the cells": ([region("TABLE", 100, 200, 0, 100)], [("Item", 5, 102), ("Qty", 55, 102), ("stray", 5, 160)], [(0, 0, 0, 100, 40, 120), (0, 1, 50, 100, 90, 120)], (60, 10), ["stray"], ()),
}


@pytest.fixture(scope="module")
def texts(spark):
    """All cases at once, a page each."""
    lines, regions, cells = [], [], []
    for page, (rs, ls, cs, (w, h), *_) in enumerate(CASES.values()):
        lines += [(1, page, i, t, 0.9, float(x), float(y), float(x + w), float(y + h)) for i, (t, x, y) in enumerate(ls)]
        regions += [(1, page, i, label, 0.9, *map(float, box)) for i, (label, *box) in enumerate(rs)]
        cells += [(1, page, 0, i, r, c, 1, 1, *map(float, box)) for i, (r, c, *box) in enumerate(cs)]
    got = layout.structure_markdown(spark.createDataFrame(lines, LINES), spark.createDataFrame(regions, REGIONS), spark.createDataFrame(cells, CELLS))
    return {r.page: r.markdown for r in got.collect()}


@pytest.mark.parametrize("name", CASES)
def test_structure(texts, name):
    *_, want, absent = CASES[name]
    got = texts[list(CASES).index(name)]
    if isinstance(want, str):
        assert got == want
    else:
        places = [got.find(part) for part in want]
        assert -1 not in places and places == sorted(places)
    assert not [x for x in absent if x in got]


def test_grid_takes_four_lines_two_bands_two_columns(spark):
    def grid(*lines):
        rows = [(1, 1, i, t, 0.9, float(x), float(y), float(x + 40), float(y + 14)) for i, (t, x, y) in enumerate(lines)]
        d = spark.createDataFrame(rows, LINES).withColumn("region_id", F.lit(0).cast("long"))
        return sorted((r.row, r.col, r.text) for r in layout.grid_table(d).collect())

    four = [("a", 0, 0), ("b", 100, 0), ("c", 0, 40), ("d", 100, 40)]
    assert grid(*four) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]
    assert grid(*four[:3]) == [] and grid(*[(t, 0, 40 * i) for i, (t, *_) in enumerate(four)]) == [] and grid(*[(t, 100 * i, 0) for i, (t, *_) in enumerate(four)]) == []
    assert grid(*four, (" e", 2, 41)) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c e"), (1, 1, "d")]


def test_lines_are_not_made_again_for_each_part(spark):
    got = queries.QUERIES["structure_markdown"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= 12 and plan.count("MapInArrow") == 0, (plan.count("posexplode"), plan.count("MapInArrow"))
