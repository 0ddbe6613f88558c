"""Text mining: pages, paragraphs, Markdown share, plain tables, titles, names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import BLANKS, WS, run_sql, trimmed
from ..plans.numbering import numbered

LINES = r"\r\n|\n|\r"


def split_pages(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` → ``(doc_id, page_ord, page, line_no, text)``.

    A line ``--- Page N ---`` starts page N; the first page is 1.  Lines are trimmed, pages without a non-blank line are
    dropped, blank lines at both ends of a page too.
    """
    return run_sql(
        r"""
        WITH l AS (SELECT doc_id, line_no, @trim(raw) AS text FROM {docs} LATERAL VIEW posexplode(split(text, r'\r\n|\n|\r')) e AS line_no, raw),
        m AS (SELECT *, text rlike r'^-{3} Page [0-9]+ -{3}$' AS marker FROM l),
        p AS (SELECT *, sum(CAST(marker AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS page_ord FROM m),
        n AS (SELECT *, CASE WHEN page_ord = 0 THEN 1 ELSE coalesce(max(CASE WHEN marker THEN try_cast(regexp_extract(text, r'([0-9]+)', 1) AS INT) END) OVER (PARTITION BY doc_id, page_ord), page_ord + 1) END AS page FROM p),
        b AS (SELECT *, min(CASE WHEN text <> '' THEN line_no END) OVER w AS lo, max(CASE WHEN text <> '' THEN line_no END) OVER w AS hi FROM n WHERE NOT marker WINDOW w AS (PARTITION BY doc_id, page_ord))
        SELECT doc_id, CAST(page_ord AS BIGINT) AS page_ord, CAST(page AS BIGINT) AS page, CAST(line_no AS BIGINT) AS line_no, text FROM b WHERE line_no BETWEEN lo AND hi
        """,
        docs=docs,
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, para_no, text)``: the trimmed text cut at blank lines; the whole text where nothing is left."""
    d = docs.select("doc_id", trimmed(F.col("text")).alias("body"))
    parts = F.filter(F.transform(F.split("body", rf"\n{WS}*\n"), trimmed), lambda p: p != "")
    d = d.select("doc_id", "body", parts.alias("parts"))
    d = d.select("doc_id", F.posexplode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("body"))).alias("para_no", "text"))
    return d.withColumn("para_no", F.col("para_no").cast("long"))


def is_markdown(text: Column) -> Column:
    """Whether a line is a table row, a heading, a fence or a dash item, or holds ``**``."""

    def line(raw: Column) -> Column:
        t = trimmed(raw)
        return (t.startswith("|") & t.endswith("|")) | t.rlike(r"^#{1,6}\s+.*$") | t.startswith("```") | t.startswith("- ") | t.contains("**")

    return F.coalesce(F.exists(F.split(text, LINES), line), F.lit(False))


def markdown_share(docs: DataFrame) -> DataFrame:
    """``(source, lang, n_docs, n_markdown)``."""
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count_if(is_markdown(F.col("text"))).alias("n_markdown"))


def extract_tables(docs: DataFrame) -> DataFrame:
    """Plain tables: ``(doc_id, table_no, row, col, value)``.

    A line is a row if it splits into two cells or more, none blank: on ``|`` behind outer pipes, else on tabs or two
    spaces.  A run of two rows or more of equal width is a table.
    """
    return run_sql(
        r"""
        WITH l AS (SELECT doc_id, line_no, @trim(raw) AS t FROM {docs} LATERAL VIEW posexplode(split(text, r'\r\n|\n|\r')) e AS line_no, raw),
        c AS (SELECT doc_id, line_no, CASE WHEN t = '' THEN array() WHEN contains(t, '|') THEN transform(split(regexp_replace(t, r'^[|]+|[|]+$', ''), '[|]', -1), x -> @trim(x))
              ELSE transform(split(t, r'\t+| {2,}', -1), x -> @trim(x)) END AS cells FROM l),
        r AS (SELECT doc_id, line_no, cells, CASE WHEN size(cells) >= 2 AND NOT exists(cells, x -> x = '') THEN size(cells) ELSE 0 END AS width FROM c),
        f AS (SELECT *, CASE WHEN width = coalesce(lag(width) OVER (PARTITION BY doc_id ORDER BY line_no), -1) THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f),
        k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1 AS row FROM g WHERE width > 0),
        t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS table_no FROM k WHERE n >= 2)
        SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, value FROM t LATERAL VIEW posexplode(cells) e AS col, value
        """,
        docs=docs,
    )


# Function words that carry no meaning in a name.
STOP_WORDS = (
    "a an the and or but if of in on at to for with from by as is are was were be been am this that these those it its he she they we you your our "
    "their his her my me us them do does did not no so than then there here all any each into over under about after before up down out off can will "
    "would should could have has had page pages "
    "في من الى إلى على عن مع هذا هذه ذلك تلك التي الذي ان أن إن او أو ثم قد كان كانت لا ما هو هي نحن انت أنت به بها له لها كل بعد قبل بين عند حتى صفحة"
).split()
# Characters between words.
SEPARATORS = r"""[ \t,;:./\\|\-–—()\[\]{}"'؛،!?؟=+&@#*~<>]"""
FALLBACK = "Scanned Document"


_LINE, _PAGE = re.compile(LINES), re.compile(r"--- Page [0-9]+ ---\Z")
_HEADING, _ITEM = re.compile(r"#{1,6}[ \t\x0b\f]+"), re.compile(r"[ \t\x0b\f]*(?:[-*+•]|[0-9]+[.)])[ \t\x0b\f]+(?:\[[ xX]\][ \t\x0b\f]+)?")
_MARK, _BETWEEN = re.compile(r"[*_`~>|#\[\]]"), re.compile(SEPARATORS.replace("[", "[^", 1) + "+")
_STOPS = frozenset(STOP_WORDS)


def _keywords(line: str) -> Iterator[str]:
    """Words of 2 to 24 characters from letter or digit to letter or digit, without function words."""
    for w in _BETWEEN.findall(line):
        if not w.isalnum():
            inner = [i for i, c in enumerate(w) if category(c)[0] in "LN"]
            w = w[inner[0] : inner[-1] + 1] if inner else ""
        if 2 <= len(w) <= 24 and w.lower() not in _STOPS:
            yield w


def _capital(c: str) -> str:
    """The one letter that is its capital, or its title letter; what would become several stays."""
    return "ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c)


def _title(text: str) -> str | None:
    """A document's title; only lines and words that decide about it are looked at."""
    lines, nth, head = [], 0, None
    for raw in _LINE.split(text):
        t = raw.strip(BLANKS)
        if not t or _PAGE.match(t):
            continue
        nth += 1
        if nth > 20:
            break
        mark = _HEADING.match(t)
        t = t[mark.end() :] if mark else t
        item = _ITEM.match(t)
        t = _MARK.sub(" ", t[item.end() :] if item else t).strip(BLANKS)
        if t:
            if mark and head is None:
                head = len(lines)
            lines.append(t)
    if head is None:
        head = next((i for i, t in enumerate(lines) if len(t) <= 90 and any(True for _ in _keywords(t))), None)
    if head is not None:
        lines.insert(0, lines.pop(head))
    found, have = {}, 0
    for t in lines:
        if have >= 3 or len(found) == 4:
            break
        for w in _keywords(t):
            have += 1
            found.setdefault(w.lower(), w)
            if len(found) == 4:
                break
    name = " ".join(w if any(category(c) == "Lu" for c in w) else _capital(w[0]) + w[1:] for w in found.values())
    return (name if len(name) <= 60 else name[:60].rpartition(" ")[0].strip(" ") or name[:60]) or None


def suggest_titles(docs: DataFrame) -> DataFrame:
    """``(doc_id, title)`` from the first twenty lines that are neither blank nor page markers.

    The title line is the first heading, else the first line of at most 90 characters with a keyword.  While there are fewer than
    three words, the other lines give theirs, a whole line at a time.  The first four distinct words are capitalised.

    A text is read inside its row, so that only titles are exchanged.  Of rows that repeat an id the smallest title stays.
    """

    def run(batches):
        for b in batches:
            title = [None if t is None else _title(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(title, pa.string())], names=["doc_id", "title"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, title string").groupBy("doc_id").agg(F.min("title").alias("title"))
    return each.select("doc_id", F.when(F.col("doc_id").isNull() | F.col("title").isNull(), FALLBACK).otherwise(F.col("title")).alias("title"))


def sanitize_names(names: DataFrame, extension: str = "") -> DataFrame:
    """``names (doc_id, name)`` → ``(doc_id, name, copy_no)``: usable file names, equal ones numbered from 0 by doc_id.

    However many share a name (the fallback, say), their numbering is split over tasks (``plans.numbering``).
    """
    ext = rf"(?i)\.{extension}$" if extension else "$^"
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", ext, ""), r'[\\/:*?"<>|\x00-\x1F]', " "), r"\s+", " ")
    d = names.select("doc_id", clean.alias("n"))
    d = d.select("doc_id", F.expr("trim(trim(BOTH '.' FROM trim(n)))").alias("n"))
    short = F.when(F.length("n") <= 60, F.col("n")).otherwise(F.trim(F.regexp_replace(F.substring("n", 1, 60), " [^ ]*$", "")))
    d = d.select("doc_id", F.when(F.trim(short) == "", FALLBACK).otherwise(short).alias("name"))
    return numbered(d, "name", "doc_id", "copy_no")
