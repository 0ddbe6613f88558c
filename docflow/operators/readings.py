"""Reconciling several readings of a line or page.

Tables: ``reads (doc_id, page, line_id, pack, text, confidence)`` and ``chars (doc_id, page, line_id, pack, ord, x, text,
confidence)``, x in 0..1 of the line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import Chars, codes, merged, of_rows, spaced, winning_runs
from ..functions.strings import BLANKS, run_sql

#: makes a line's characters of what a row holds of it
Reader = Callable[[Any], Chars]

# Strong right-to-left scripts; strong left-to-right letters of other scripts.
RTL = r"[\x{5BE}\x{5C0}\x{5C3}\x{5C6}\x{5D0}-\x{5F4}\x{608}\x{60B}\x{60D}\x{61B}-\x{64A}\x{66D}-\x{66F}\x{671}-\x{6D5}\x{6E5}\x{6E6}\x{6EE}\x{6EF}\x{6FA}-\x{70D}\x{710}\x{712}-\x{72F}\x{74D}-\x{7A5}\x{7B1}-\x{7EA}\x{FB1D}\x{FB1F}-\x{FDFC}\x{FE70}-\x{FEFC}]"
LTR = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2B8}\x{370}-\x{373}\x{376}-\x{52F}\x{531}-\x{589}\x{904}-\x{1FFF}\x{3041}-\x{D7FF}]"
LINE = "doc_id, page, line_id"


def _marks(letters: str) -> np.ndarray:
    """Which characters a pattern of characters and ranges holds."""
    out = np.zeros(0x110000, bool)
    ends = [chr(int(x[3:-1], 16)) if len(x) > 1 else x for x in re.findall(r"\\x\{[0-9A-F]+\}|.", letters[1:-1])]
    for i, c in enumerate(ends):
        if c == "-":
            out[ord(ends[i - 1]) : ord(ends[i + 1]) + 1] = True
        else:
            out[ord(c)] = True
    return out


#: 1 for a right-to-left character, 2 for a left-to-right one
_SCRIPT = (_marks(RTL) + 2 * _marks(LTR)).astype(np.uint8)


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right-to-left and left-to-right characters of each text, and its length without outer white space."""
    script = _SCRIPT[codes("".join(filter(None, texts)))]
    edge = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
    rtl, ltr = (np.diff(np.concatenate([[0], np.cumsum(script == k)])[edge]) for k in (1, 2))
    return rtl, ltr, np.array([len((t or "").strip(BLANKS)) for t in texts], np.int64)


def script_profile(reads: DataFrame) -> DataFrame:
    """``(doc_id, page, pack, rtl, ltr, rtl_fraction, rtl_dominant, chars, dense)``.

    Chars count where the confidence is 0.3 or more; a page is dense from 25 chars a line on.  Digits are neutral.  Characters are counted in a batch
    at once; only counts leave it.
    """
    keys = ["doc_id", "page", "pack"]
    counts = "rtl bigint, ltr bigint, chars bigint, sure boolean"

    def run(batches):
        for b in batches:
            text = b.column("text")
            none = text.is_null().to_numpy(zero_copy_only=False)
            told = [pa.array(c, pa.int64(), mask=none) for c in _counts(text.to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *told, b.column("sure")], names=[*keys, "rtl", "ltr", "chars", "sure"])

    schema = ", ".join([*(f"`{k}` {reads.schema[k].dataType.simpleString()}" for k in keys), counts])
    lines = reads.select(*keys, "text", (F.col("confidence") >= 0.3).alias("sure")).mapInArrow(run, schema)
    return run_sql(
        """
        WITH s AS (SELECT doc_id, page, pack, sum(rtl) AS rtl, sum(ltr) AS ltr, sum(CASE WHEN sure THEN chars ELSE 0 END) AS chars, count(*) AS n FROM {lines} GROUP BY doc_id, page, pack)
        SELECT doc_id, page, pack, rtl, ltr, CASE WHEN rtl + ltr = 0 THEN 0.0D ELSE rtl / (rtl + ltr) END AS rtl_fraction, rtl > ltr AS rtl_dominant, chars, chars >= 25 * n AS dense FROM s
        """,
        lines=lines,
    )


def choose_reading(reads: DataFrame, packs: list[str]) -> DataFrame:
    """``(doc_id, page, pack)``: the first of ``packs`` if it reads densely, else the pack with the most chars among the first and those
    with more chars and an RTL share of 0.6 or more (the earlier on ties)."""
    order = F.array_position(F.array(*(F.lit(p) for p in packs)), F.col("pack"))
    p = script_profile(reads).withColumn("nth", order).where("nth > 0")
    return run_sql(
        """
        WITH f AS (SELECT *, max(CASE WHEN nth = 1 THEN chars END) OVER w AS first_chars, max(CASE WHEN nth = 1 THEN dense END) OVER w AS first_dense FROM {p} WINDOW w AS (PARTITION BY doc_id, page))
        SELECT doc_id, page, max_by(pack, struct(chars, -nth)) AS pack FROM f WHERE nth = 1 OR (NOT first_dense AND chars > first_chars AND rtl_fraction >= 0.6) GROUP BY doc_id, page
        """,
        p=p,
    )


def page_orientation(reads: DataFrame) -> DataFrame:
    """``reads`` with flipped and boxes → ``(doc_id, page, upright, turned, flip)``.

    A pack's score is the sum of confidence times trimmed length over its lines, over the five widest lines of the page; the best packs
    are compared, and a page flips beyond 1.15 times with at least 3.
    """
    return run_sql(
        """
        WITH b AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page, pack, flipped ORDER BY (x1 - x0) / (y1 - y0) DESC, line_id) AS wide FROM {reads}),
        s AS (SELECT doc_id, page, pack, flipped, sum(confidence * length(@trim(text))) / count(*) AS score FROM b WHERE wide <= 5 GROUP BY doc_id, page, pack, flipped),
        p AS (SELECT doc_id, page, coalesce(max(score) FILTER (WHERE NOT flipped), 0) AS upright, coalesce(max(score) FILTER (WHERE flipped), 0) AS turned FROM s GROUP BY doc_id, page)
        SELECT *, greatest(upright, turned) >= 3 AND turned > upright * 1.15D AS flip FROM p
        """,
        reads=reads,
    )


def _gathered(chars: DataFrame, keys: str, **sides: Column) -> DataFrame:
    """One row a line: the characters of each side, gathered in one exchange."""
    row = F.struct("ord", "text", "x", *(["confidence"] if "confidence" in chars.columns else []))
    names = [k.strip() for k in keys.split(",")]
    return chars.groupBy(*names).agg(*(F.collect_list(F.when(of, row)).alias(side) for side, of in sides.items()))


def _paired(primary: DataFrame, latin: DataFrame) -> DataFrame:
    names = [k.strip() for k in LINE.split(",")]
    both = [d.select(*names, "ord", F.col("x").cast("double").alias("x"), "text", F.col("confidence").cast("double").alias("confidence"), F.lit(side).alias("side")) for side, d in enumerate((primary, latin))]
    return _gathered(both[0].unionByName(both[1]), LINE, primary=F.col("side") == 0, latin=F.col("side") == 1)


def _schema(df: DataFrame, keys: str, more: str) -> tuple[list[str], str]:
    names = [k.strip() for k in keys.split(",")]
    return names, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names), more])


def _kept(b: pa.RecordBatch, names: list[str], at: list[int], values: dict[str, pa.Array]) -> pa.RecordBatch:
    """The keys of rows ``at`` of a batch, and new columns beside them."""
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in names), *values.values()], names=[*names, *values])


def merge_script_runs(primary: DataFrame, latin: DataFrame) -> DataFrame:
    """Latin runs that win over the primary reading: ``(doc_id, page, line_id, run, lo, hi, text, confidence)``.

    Runs are Latin characters of confidence 0.4 or more, cut where a step exceeds the larger of 0.035 and three upper-median steps; they have two
    characters or more.  A run wins with a mean of 0.85 or more where less than half of the primary's non-blank characters under it
    (0.0175 wider on each side) are sure script characters, or none are there.
    """
    return runs_of_lines(_paired(primary, latin))


def merge_readings(primary: DataFrame, latin: DataFrame) -> DataFrame:
    """``(doc_id, page, line_id, text, confidence, n_runs)`` of lines where a Latin run wins: winners replace the primary's characters.

    A blank goes only inside a run, Latin within 0.035 of it, others within 0.0175; double spaces are collapsed.
    """
    return merged_lines(_paired(primary, latin))


def runs_of_lines(lines: DataFrame, chars: Reader = of_rows, keys: str = LINE) -> DataFrame:
    """``merge_script_runs`` of ``lines (keys, primary, latin)``, a row a line, with no exchange: ``chars`` makes a line's characters of a value of either column."""
    names, schema = _schema(lines, keys, "run bigint, lo double, hi double, text string, confidence double")

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, (p, q) in enumerate(zip(b.column("primary").to_pylist(), b.column("latin").to_pylist())):
                r = winning_runs(chars(p), chars(q)) if p is not None and q is not None else None
                if r is not None:
                    at += [i] * len(r.run)
                    out.append(r)
            whole = {f: pa.array(np.concatenate([getattr(r, f) for r in out]) if out else [], pa.int64() if f == "run" else pa.float64()) for f in ("run", "lo", "hi", "confidence")}
            text = pa.array([t for r in out for t in r.text], pa.string())
            yield _kept(b, names, at, {"run": whole["run"], "lo": whole["lo"], "hi": whole["hi"], "text": text, "confidence": whole["confidence"]})

    return lines.select(*names, "primary", "latin").mapInArrow(run, schema)


def merged_lines(lines: DataFrame, chars: Reader = of_rows, keys: str = LINE) -> DataFrame:
    """``merge_readings`` of ``lines (keys, primary, latin)``, as ``runs_of_lines`` takes them."""
    names, schema = _schema(lines, keys, "text string, confidence double, n_runs bigint")

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, (p, q) in enumerate(zip(b.column("primary").to_pylist(), b.column("latin").to_pylist())):
                main = chars(p) if p is not None and q is not None else None
                r = winning_runs(main, chars(q)) if main is not None else None
                if r is not None:
                    at.append(i)
                    out.append((*merged(main, r), len(r.run)))
            text, confidence, n = zip(*out) if out else ((), (), ())
            yield _kept(b, names, at, {"text": pa.array(text, pa.string()), "confidence": pa.array(confidence, pa.float64()), "n_runs": pa.array(n, pa.int64())})

    return lines.select(*names, "primary", "latin").mapInArrow(run, schema)


def recover_spaces(chars: DataFrame, factor: float = 2.3, keys: str = LINE) -> DataFrame:
    """``(keys, text)``: a space between two Arabic letters whose step exceeds ``factor`` times the upper median of positive steps.

    Lines of fewer than three characters, and lines without a positive step, keep their text.
    """
    return spaces_at(chars, (factor,), keys).drop("factor")


def spaces_at(chars: DataFrame, factors: tuple[float, ...], keys: str = LINE) -> DataFrame:
    """``(keys, factor, text)``: the spaces recovered at each of ``factors``, in one pass over the characters; 0 keeps the stored text."""
    return spaces_of_lines(_gathered(chars, keys, reading=F.lit(True)), factors, keys=keys)


def spaces_of_lines(lines: DataFrame, factors: tuple[float, ...], chars: Reader = of_rows, keys: str = LINE) -> DataFrame:
    """``spaces_at`` of ``lines (keys, reading)``, a row a line, with no exchange: ``chars`` makes a line's characters of a reading."""
    names, schema = _schema(lines, keys, "factor double, text string")
    factors = [float(f) for f in factors]

    def run(batches):
        for b in batches:
            at, text = [], []
            for i, r in enumerate(b.column("reading").to_pylist()):
                if r is not None:
                    at += [i] * len(factors)
                    text += spaced(chars(r), factors)
            yield _kept(b, names, at, {"factor": pa.array(factors * (len(at) // len(factors)), pa.float64()), "text": pa.array(text, pa.string())})

    return lines.select(*names, "reading").mapInArrow(run, schema)


def logical_order(lines: DataFrame, keys: str = LINE) -> DataFrame:
    """``lines (keys, text)`` in visual order → logical order, of lines with a right-to-left character, each inside its row.

    The line is reversed with its brackets mirrored; runs of left-to-right characters and digits, which single joiners (``. , : / - +`` or a space)
    extend, are turned back.
    """
    strong, joiner = LTR.rstrip("]") + r"\p{Nd}]", "[.,:/+ -]"
    # where a run begins: a strong character behind none, nor behind a joiner that follows one; where it ends, the same the other way
    edge = rf"(?<!{strong})(?<!{strong}{joiner})(?={strong})|(?<={strong})(?!{strong})(?!{joiner}{strong})"
    seen = F.translate(F.reverse("text"), "()[]{}<>«»", ")(][}{><»«")
    parts = F.transform(F.split(seen, edge, -1), lambda p: F.when(p.rlike(f"^{strong}"), F.reverse(p)).otherwise(p))
    names = [k.strip() for k in keys.split(",")]
    return lines.where("text IS NOT NULL").select(*names, F.when(F.col("text").rlike(RTL), F.array_join(parts, "")).otherwise(F.col("text")).alias("text"))
