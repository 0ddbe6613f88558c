"""Page structure from recognised lines, layout regions and table cells.

Tables: ``page_lines (doc_id, page, line_id, text, confidence, x0, y0, x1, y1)``, ``regions (doc_id, page, region_id, label, score, x0,
y0, x1, y1)``, ``cells (doc_id, page, region_id, cell_ord, r, c, row_span, col_span, x0, y0, x1, y1)``.  Everything is keyed by
``(doc_id, page)`` first, so a page pipeline is shuffled once; a page is small, folds over it are bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import Sums, banded, divided, islands, widest
from ..functions.strings import run_sql
from ..plans.lineage import cut

# The labels of layout regions.
LABELS = (
    "PARAGRAPH_TITLE IMAGE TEXT NUMBER ABSTRACT CONTENT FIGURE_TITLE FORMULA TABLE TABLE_TITLE REFERENCE DOC_TITLE FOOTNOTE HEADER ALGORITHM FOOTER "
    "SEAL CHART_TITLE CHART FORMULA_NUMBER HEADER_IMAGE FOOTER_IMAGE ASIDE_TEXT"
).split()
# Thresholds.
LEAST_CONFIDENCE, LEAST_SCORE, BAND, COLUMN_SLACK, OVERLAP_SLACK = 0.3, 0.4, 0.6, 4, 8
PAGE = ["doc_id", "page"]


def keep_confident(page_lines: DataFrame) -> DataFrame:
    """Lines with text and a confidence of 0.3 or more; the filter reaches the scan."""
    return page_lines.where((F.col("confidence") >= LEAST_CONFIDENCE) & F.col("text").rlike(r"\S"))


def keep_regions(regions: DataFrame) -> DataFrame:
    """Regions with a known label and a score of 0.4 or more."""
    return regions.where((F.col("score") >= LEAST_SCORE) & F.col("label").isin(LABELS))


def page_status(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, page, n_kept, status)``; a page without a kept line is ``empty``."""
    kept = F.count_if((F.col("confidence") >= LEAST_CONFIDENCE) & F.col("text").rlike(r"\S"))
    return page_lines.groupBy(*PAGE).agg(kept.alias("n_kept")).withColumn("status", F.when(F.col("n_kept") > 0, "ok").otherwise("empty"))


def page_confidence(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, n_pages, confidence)``: the mean of page means over pages with kept lines (not weighted by lines)."""
    pages = keep_confident(page_lines).groupBy(*PAGE).agg(F.avg("confidence").alias("confidence"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.avg("confidence").alias("confidence"))


def band_rows(page_lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, line_id, band, pos)``: lines by top edge; a line joins the band while its centre is within 0.6 times the larger
    height of the band's first line.  A fold over the sorted lines of a page; positions in a band by left edge.
    """
    keys = keys or PAGE
    held = F.array_sort(F.collect_list(F.struct("y0", "line_id", "y1", "x0")))
    folded = F.expr(
        f"""aggregate(held, named_struct('c', cast(null as double), 'h', cast(null as double), 'band', -1L, 'out', cast(array() as array<struct<band:bigint,line_id:bigint,x0:double,y0:double>>)),
        (s, q) -> if(s.c is not null and abs((q.y0 + q.y1) / 2 - s.c) < greatest(q.y1 - q.y0, s.h) * {BAND},
          named_struct('c', s.c, 'h', s.h, 'band', s.band, 'out', array_append(s.out, named_struct('band', s.band, 'line_id', q.line_id, 'x0', q.x0, 'y0', q.y0))),
          named_struct('c', (q.y0 + q.y1) / 2, 'h', q.y1 - q.y0, 'band', s.band + 1, 'out', array_append(s.out, named_struct('band', s.band + 1, 'line_id', q.line_id, 'x0', q.x0, 'y0', q.y0)))),
        s -> s.out)"""
    )
    d = page_lines.withColumn("line_id", F.col("line_id").cast("long")).groupBy(*keys).agg(held.alias("held"))
    d = d.select(*keys, F.inline(folded))
    order = Window.partitionBy(*keys, "band").orderBy("x0", "y0", "line_id")
    return d.select(*keys, "line_id", "band", (F.row_number().over(order) - 1).cast("long").alias("pos"))


def column_bounds(page_lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, col, x0, x1)``: x-spans merged where the gap is 4 or less, from left to right."""
    keys = keys or PAGE
    k = ", ".join(keys)
    return run_sql(
        f"""
        WITH r AS (SELECT {k}, x0, x1, max(x1) OVER (PARTITION BY {k} ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {{lines}}),
        g AS (SELECT *, sum(CASE WHEN x0 <= reach + {COLUMN_SLACK} THEN 0 ELSE 1 END) OVER (PARTITION BY {k} ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS col FROM r)
        SELECT {k}, CAST(col AS BIGINT) AS col, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY {k}, col
        """,
        lines=page_lines,
    )


def flow_text(ordered: DataFrame) -> DataFrame:
    """``ordered (page_lines, read_pos)`` → ``(doc_id, page, text)``: a space where the centre moved less than 0.6 of the height of the
    line before, else a new line."""
    w = Window.partitionBy(*PAGE).orderBy("read_pos")
    centre, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    same = F.abs(centre - F.lag(centre).over(w)) < F.lag(height).over(w) * BAND
    glue = F.when(F.row_number().over(w) == 1, "").when(same, " ").otherwise("\n")
    d = ordered.select(*PAGE, "read_pos", F.concat(glue, "text").alias("part"))
    return d.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_pos", "part"))), lambda s: s["part"]), "").alias("text"))


def _by_page(rows: DataFrame, places, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without ``extra``, with ``read_pos``, a row's place on its page, from ``places(page numbers, batch)``: a sort key of numbers for each row.

    One exchange; a task orders whole pages, many at a time.  A page is held in memory, however many there are.
    """
    keep = [c for c in rows.columns if c not in extra]

    def told(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((*reversed(places(page, batch)), page))
        start = np.flatnonzero(np.concatenate([[True], np.diff(page) > 0]))
        pos = np.empty(len(page), np.int64)
        pos[order] = np.arange(len(page)) - start[page]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pos)], names=[*keep, "read_pos"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.Table.from_batches([*held, b] if held else [b]).combine_chunks().to_batches()[0]
            keys = list(zip(*(b.column(c).to_pylist() for c in PAGE)))
            change = np.array([True, *(x != y for x, y in zip(keys[1:], keys[:-1]))])
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield told(b.slice(0, last), np.cumsum(change[:last]) - 1)
            held = [b.slice(last)]
        if held:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield told(b, np.zeros(b.num_rows, np.int64))

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, f"{schema}, read_pos bigint")


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)) for c in names]


def _ranks(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.rank(batch.column(name), sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)


def region_order(regions: DataFrame) -> DataFrame:
    """``regions`` with ``read_pos`` per page: recursive XY-cut, on every horizontal gap, else on every vertical gap, else by (top, left).

    A gap begins 8 before the reach of what lies before it.  Missing edges count as 0; ties go by ``region_id``.
    """

    def places(page, batch):
        x0, y0, x1, y1 = _numbers(batch, "x0", "y0", "x1", "y1")
        tie = _ranks(batch, "region_id")

        def level(rows, group):
            band, bands = islands(group, y0[rows], y1[rows], tie[rows], OVERLAP_SLACK)
            column, columns = islands(group, x0[rows], x1[rows], tie[rows], OVERLAP_SLACK)
            return np.where(bands > 1, band, np.where(columns > 1, column, -1))

        return divided(page, level), y0, x0, tie

    return _by_page(regions, places)


def lines_in_regions(page_lines: DataFrame, ordered_regions: DataFrame) -> DataFrame:
    """``(doc_id, page, line_id, region_id)``: each line's first region, in reading order, that holds its centre."""
    return run_sql(
        """
        SELECT l.doc_id, l.page, l.line_id, min_by(r.region_id, r.read_pos) AS region_id
        FROM {lines} l JOIN {regions} r ON l.doc_id = r.doc_id AND l.page = r.page
          AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1
        GROUP BY l.doc_id, l.page, l.line_id
        """,
        lines=page_lines, regions=ordered_regions,
    )


def uncovered_regions(page_lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines that no region covers, banded into new TEXT regions of score 0 and negative ids."""
    loose = run_sql(
        """
        SELECT l.* FROM {lines} l LEFT ANTI JOIN {regions} r ON l.doc_id = r.doc_id AND l.page = r.page
          AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1
        """,
        lines=page_lines, regions=regions,
    )
    b = band_rows(loose).join(loose.withColumn("line_id", F.col("line_id").cast("long")), [*PAGE, "line_id"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return b.groupBy(*PAGE, "band").agg(*box).select(*PAGE, (-1 - F.col("band")).alias("region_id"), F.lit("TEXT").alias("label"), F.lit(0.0).alias("score"), "x0", "y0", "x1", "y1")


def lines_in_cells(region_lines: DataFrame, cells: DataFrame) -> DataFrame:
    """``region_lines (page_lines, region_id)`` → ``(doc_id, page, region_id, cell_ord, r, c, text)`` for every cell.

    A line goes to the first cell that holds its centre, else to the cell of the least squared distance (first on ties).
    A cell's text is its contained lines by left edge, then strays by (top, left).
    """
    return run_sql(
        """
        WITH j AS (SELECT l.doc_id, l.page, l.region_id, l.line_id, l.text, l.x0, l.y0, c.cell_ord,
              (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1 AS inside,
              pow(greatest(c.x0 - (l.x0 + l.x1) / 2, (l.x0 + l.x1) / 2 - c.x1, 0), 2) + pow(greatest(c.y0 - (l.y0 + l.y1) / 2, (l.y0 + l.y1) / 2 - c.y1, 0), 2) AS far
              FROM {lines} l JOIN {cells} c ON l.doc_id = c.doc_id AND l.page = c.page AND l.region_id = c.region_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, region_id, line_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0.0D ELSE far END, cell_ord) AS nth FROM j),
        t AS (SELECT doc_id, page, region_id, cell_ord, array_join(transform(array_sort(collect_list(struct(CASE WHEN inside THEN 0 ELSE 1 END AS stray, CASE WHEN inside THEN x0 ELSE y0 END AS a, x0, line_id, trim(text) AS t))), s -> s.t), ' ') AS text
              FROM b WHERE nth = 1 GROUP BY doc_id, page, region_id, cell_ord)
        SELECT c.doc_id, c.page, c.region_id, c.cell_ord, c.r, c.c, coalesce(trim(t.text), '') AS text
        FROM {cells} c LEFT JOIN t ON c.doc_id = t.doc_id AND c.page = t.page AND c.region_id = t.region_id AND c.cell_ord = t.cell_ord
        """,
        lines=region_lines, cells=cells,
    )


def grid_table(region_lines: DataFrame) -> DataFrame:
    """``(doc_id, page, region_id, row, col, text)`` of TABLE regions without cells: bands are rows, merged x-spans columns.

    It takes four lines, two bands, two columns, and a row with two filled cells.
    """
    keys = [*PAGE, "region_id"]
    k = ", ".join(keys)
    lines = region_lines.withColumn("line_id", F.col("line_id").cast("long")).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n >= 4").drop("n")
    bands, columns = band_rows(lines, keys), column_bounds(lines, keys)
    return run_sql(
        f"""
        WITH p AS (SELECT l.*, b.band, b.pos FROM {{lines}} l JOIN {{bands}} b USING ({k}, line_id)),
        n AS (SELECT {k}, p.band, p.pos, p.text, c.col, row_number() OVER (PARTITION BY {k}, p.line_id ORDER BY greatest(c.x0 - (p.x0 + p.x1) / 2, (p.x0 + p.x1) / 2 - c.x1, 0), c.col) AS nth FROM p JOIN {{columns}} c USING ({k})),
        t AS (SELECT {k}, band AS row, col, trim(array_join(transform(array_sort(collect_list(struct(pos, trim(text) AS t))), s -> s.t), ' ')) AS text FROM n WHERE nth = 1 GROUP BY {k}, band, col),
        size AS (SELECT {k}, count(*) AS n_cols FROM {{columns}} GROUP BY {k}),
        ok AS (SELECT {k} FROM (SELECT {k}, row, count_if(text <> '') AS filled FROM t GROUP BY {k}, row) GROUP BY {k} HAVING count(*) >= 2 AND max(filled) >= 2),
        grid AS (SELECT {k}, row, explode(sequence(0L, n_cols - 1)) AS col FROM (SELECT DISTINCT {k}, row FROM t) JOIN size USING ({k}) JOIN ok USING ({k}) WHERE n_cols >= 2)
        SELECT {k}, row, col, coalesce(t.text, '') AS text FROM grid LEFT JOIN t USING ({k}, row, col)
        """,
        lines=lines, bands=bands, columns=columns,
    )


def _escaped(c: Column) -> Column:
    """Inline marks escaped, and a leading list or heading mark."""
    inline = F.regexp_replace(c, r"([\\`*_\[\]<|])", r"\\$1")
    return F.concat(F.when(c.rlike("^[#>+-]"), "\\").otherwise(""), inline)  # none of these is an inline mark


def _pipe_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells (keys, row, col, text)`` → ``(keys, md)``: the first row is the header."""
    text = F.coalesce(F.nullif(F.trim(_escaped(F.regexp_replace("text", "\n", " "))), F.lit("")), F.lit(" "))
    rows = cells.withColumn("t", F.when(F.trim(F.col("text")) == "", " ").otherwise(text)).groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "t"))).alias("held"), F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("held", lambda s: s["t"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    first = F.col("row") == F.min("row").over(Window.partitionBy(*keys))
    rows = rows.withColumn("line", F.when(first, F.concat(line, rule)).otherwise(line))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("md"))


FURNITURE = ("HEADER", "FOOTER", "ASIDE_TEXT", "NUMBER", "FORMULA_NUMBER", "SEAL")


def structure_markdown(page_lines: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """``(doc_id, page, markdown)``: regions, and bands of uncovered lines, rendered by label in reading order."""
    lines = page_lines.withColumn("line_id", F.col("line_id").cast("long"))
    every = regions.select(*PAGE, F.col("region_id").cast("long").alias("region_id"), "label", "score", "x0", "y0", "x1", "y1").unionByName(uncovered_regions(lines, regions))
    # new regions follow the given ones where positions tie
    every = every.withColumn("region_id", F.when(F.col("region_id") < 0, F.lit(1 << 40) - F.col("region_id")).otherwise(F.col("region_id")))
    # regions and lines are each read several times below: made once, not from the lines of all pages each time
    ordered = cut(region_order(every))
    placed = cut(lines.join(lines_in_regions(lines, ordered), [*PAGE, "line_id"]))
    key = [*PAGE, "region_id"]
    trimmed = F.trim(F.col("text"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("line_id", trimmed.alias("t")))), lambda s: s["t"])
    texts = placed.groupBy(*key).agg(held.alias("held"))
    tables = ordered.where("label = 'TABLE'").select(*key)
    in_table = cut(placed.join(tables, key))
    with_cells = cells.select(*PAGE, F.col("region_id").cast("long").alias("region_id"), "cell_ord", "r", "c", "x0", "y0", "x1", "y1").join(tables, key)
    filled = lines_in_cells(in_table, with_cells)
    by_cells = filled.groupBy(*key, F.col("r").cast("long").alias("row"), F.col("c").cast("long").alias("col")).agg(F.max("text").alias("text"))
    by_cells = by_cells.withColumn("any", F.max(F.col("text") != "").over(Window.partitionBy(*key))).where("any").drop("any")
    by_grid = grid_table(in_table.join(with_cells.select(*key).distinct(), key, "left_anti"))
    md = _pipe_table(by_cells.unionByName(by_grid.select(*key, "row", "col", "text")), key)
    d = ordered.join(texts, key, "left").join(md, key, "left")
    joined = F.trim(F.array_join("held", " "))
    paragraph = F.nullif(F.array_join(F.transform("held", _escaped), "  \n"), F.lit(""))
    block = (
        F.when(F.col("label").isin(*FURNITURE), F.when(F.length(joined) > 24, paragraph))
        .when(F.col("label").isin("IMAGE", "HEADER_IMAGE", "FOOTER_IMAGE"), "*(image)*")
        .when(F.col("label") == "CHART", F.coalesce(paragraph, F.lit("*(chart)*")))
        .when(F.col("label") == "DOC_TITLE", F.when(joined != "", F.concat(F.lit("# "), _escaped(joined))))
        .when(F.col("label") == "PARAGRAPH_TITLE", F.when(joined != "", F.concat(F.lit("## "), _escaped(joined))))
        .when(F.col("label").isin("FIGURE_TITLE", "TABLE_TITLE", "CHART_TITLE"), F.when(joined != "", F.concat(F.lit("*"), _escaped(joined), F.lit("*"))))
        .when(F.col("label") == "TABLE", F.coalesce("md", paragraph))
        .otherwise(paragraph)
    )
    # blank blocks go behind the exchange: a filter before it would make each block twice
    told = F.filter(F.array_sort(F.collect_list(F.struct("read_pos", block.alias("block")))), lambda s: F.trim(s["block"]) != "")
    pages = d.groupBy(*PAGE).agg(told.alias("told")).where("size(told) > 0")
    body = F.array_join(F.transform("told", lambda s: s["block"]), "\n\n")
    return pages.select(*PAGE, F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n")).alias("markdown"))


# The reading-order cuts.
DEPTH, LEAST_GAP, V_GAP, H_GAP, V_HEIGHT, V_WIDTH, TIE = 14, 6.0, 0.015, 0.02, 0.40, 0.20, 0.02


def reading_order(page_lines: DataFrame, rtl: Column | None = None, lean: Column | None = None) -> DataFrame:
    """``page_lines`` with ``read_pos`` per page: recursive widest-gap XY-cut to depth 14, leaves banded.

    ``rtl`` says of a page whether the right side of a vertical cut comes first and bands run from the right.  Or ``lean``, a line's right-to-left
    letters less its others, decides both: the sides by the sum over the page, each band by its own.  Missing edges count as 0; ties go by ``line_id``.
    """
    whole = rtl is not None
    d = page_lines.withColumn("line_id", F.col("line_id").cast("long"))
    d = d.withColumn("__lean", F.coalesce(F.lit(0) if lean is None else lean, F.lit(0)).cast("long") if rtl is None else F.when(rtl, 1).otherwise(0).cast("long"))

    def places(page, batch):
        x0, y0, x1, y1, own = _numbers(batch, "x0", "y0", "x1", "y1", "__lean")
        tie = _ranks(batch, "line_id")
        turned = np.bincount(page, own)[page] > 0

        def level(rows, group):
            l, t, r, b = x0[rows], y0[rows], x1[rows], y1[rows]
            sums = Sums(group)
            every = np.ones(len(rows), bool)
            width, height = sums.extent(l, r, every), sums.extent(t, b, every)
            v_gap, v_cut = widest(group, sums, l, r, tie[rows])
            h_gap, h_cut = widest(group, sums, t, b, tie[rows])
            right, below = (l + r) / 2 >= v_cut, (t + b) / 2 >= h_cut
            v = v_gap >= np.maximum(LEAST_GAP, V_GAP * width)
            for side in (right, ~right):
                v &= (sums.count(side) >= 2) & (sums.extent(t, b, side) >= V_HEIGHT * height) & (sums.extent(l, r, side) >= V_WIDTH * width)
            h = (h_gap >= np.maximum(LEAST_GAP, H_GAP * height)) & (sums.count(below) > 0) & (sums.count(~below) > 0)
            share_v, share_h = np.divide(v_gap, width, out=np.zeros(len(rows)), where=width > 0), np.divide(h_gap, height, out=np.zeros(len(rows)), where=height > 0)
            across = h & (~v | (np.abs(share_v - share_h) <= TIE) | (share_h > share_v))
            part = np.where(across, below, np.where(v, np.where(turned[rows], ~right, right), -1)).astype(np.int64)
            return np.where((sums.count(every) > 2) & (across | v), part, -1)

        band = banded(divided(page, level, DEPTH), y0, y1, tie, BAND)
        order = np.lexsort((tie, y0, x0, band))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        back = turned if whole else np.bincount(band, own)[band] > 0
        return band, np.where(back, -place, place)

    return _by_page(d, places, ("__lean",))
