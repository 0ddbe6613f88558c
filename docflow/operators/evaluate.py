"""Accuracy of readings against ground truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import Truth, distances, evened, folded, has_windows
from ..functions.lines import of_rows, spaced
from ..functions.strings import FOLD_FROM, FOLD_TO, WS
from .readings import Reader, _gathered

# The gap factors to compare (0 keeps the stored text).
FACTORS = (0.0, 1.7, 1.9, 2.1, 2.3, 2.5, 2.8)
# Fixed value: characters of texts whose lines are sought together.
_TOGETHER = 1 << 21


def normalized(c: Column, keep_diacritics: bool) -> Column:
    one = F.trim(F.regexp_replace(c, f"{WS}+", " "))
    return one if keep_diacritics else F.translate(F.regexp_replace(one, r"[\x{64B}-\x{652}\x{640}]", ""), FOLD_FROM, FOLD_TO)


def _similarities(a: list[str], b: list[str]) -> np.ndarray:
    got, apart = np.ones(len(a)), [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    if apart:
        x, y = [a[i] for i in apart], [b[i] for i in apart]
        got[apart] = 1 - distances(x, y) / np.array([max(len(p), len(q)) for p, q in zip(x, y)])
    return got


def score_accuracy(hypothesis: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Join ``hypothesis (keys, text, by)`` with ``truth (keys, text)`` → ``(by, n, raw, folded)``: mean similarities, 1 less the edit distance over the
    larger length, of texts with even white space, and with letters folded.

    A batch's distances are measured together (``functions.edits.distances``), each pair inside its row.
    """
    j = hypothesis.withColumnRenamed("text", "h").join(truth.select(*keys, F.col("text").alias("t")), keys).select(*by, "h", "t")

    def run(batches):
        for b in batches:
            told = np.flatnonzero((b.column("h").is_valid().to_numpy(zero_copy_only=False)) & (b.column("t").is_valid().to_numpy(zero_copy_only=False)))
            at = pa.array(told, pa.int64())
            h, t = ([evened(x) for x in b.column(c).take(at).to_pylist()] for c in ("h", "t"))
            fold_h, fold_t = [folded(x) for x in h], [folded(x) for x in t]
            raw = _similarities(h, t)
            more = [i for i in range(len(h)) if fold_h[i] is not h[i] or fold_t[i] is not t[i]]  # others have nothing to fold
            fold = raw.copy()
            fold[more] = _similarities([fold_h[i] for i in more], [fold_t[i] for i in more])
            out = []
            for got in (raw, fold):
                every = np.full(b.num_rows, np.nan)
                every[told] = got
                out.append(pa.array(every, mask=np.isnan(every)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *out], names=[*by, "raw", "folded"])

    schema = ", ".join([*(f"`{c}` {j.schema[c].dataType.simpleString()}" for c in by), "raw double", "folded double"])
    return j.mapInArrow(run, schema).groupBy(*by).agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("folded").alias("folded"))


def sweep_gap_factor(chars: DataFrame, truth: DataFrame, keys: list[str], factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """``(factor, n, raw, folded)`` of space recovery at each factor (0 keeps the stored text), from one pass over the characters."""
    lines = _gathered(chars, ", ".join(keys), reading=F.lit(True)).join(truth.select(*keys, F.col("text").alias("truth")), keys)
    return sweep_of_lines(lines, factors)


def sweep_of_lines(lines: DataFrame, factors: tuple[float, ...] = FACTORS, chars: Reader = of_rows) -> DataFrame:
    """``sweep_gap_factor`` of ``lines (reading, truth)``, a row a line: texts are recovered and measured where the line is, so that only
    similarities leave the row.  ``chars`` makes a line's characters of a reading."""
    factors = [float(f) for f in factors]

    def run(batches):
        for b in batches:
            raw, folded = [], []
            for r, t in zip(b.column("reading").to_pylist(), b.column("truth").to_pylist()):
                told = Truth(t)
                for h in spaced(chars(r), factors):
                    x, y = told.similarities(h)
                    raw.append(x)
                    folded.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(factors * b.num_rows, pa.float64()), pa.array(raw, pa.float64()), pa.array(folded, pa.float64())], names=["factor", "raw", "folded"])

    s = lines.where("reading IS NOT NULL").select("reading", "truth").mapInArrow(run, "factor double, raw double, folded double")
    return s.groupBy("factor").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("folded").alias("folded"))


def line_recall(hypothesis: DataFrame, truth: DataFrame, least: float = 0.8, block: int = 2048) -> DataFrame:
    """``hypothesis (doc_id, text)``, ``truth (doc_id, line_id, text)`` → ``(doc_id, hits, lines)``: truth lines (over three characters when
    normalised) whose best window of their length in the document has similarity of ``least`` or more.

    A document's text is shuffled once, beside blocks of ``block`` of its lines (by ``line_id``, their number); windows are sought without loss, the
    lines of some rows together (``functions.edits.has_windows``).  Documents without such lines have no row; a missing or null text holds no line.
    """
    t = truth.where("text IS NOT NULL").groupBy("doc_id", F.expr(f"line_id div {block}").alias("block")).agg(F.collect_list("text").alias("lines"))
    rows = t.join(hypothesis.select("doc_id", F.col("text").alias("h")), "doc_id", "left").select("doc_id", "h", "lines")

    def run(batches):
        for b in batches:
            size = pc.add(pc.coalesce(pc.utf8_length(b.column(1)), 0), pc.list_value_length(b.column(2))).to_numpy()
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(np.cumsum(size) // _TOGETHER)) + 1):
                if len(part):
                    yield counted(b.slice(part[0], len(part)))

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        every = [folded(evened(x)) for x in b.column(2).flatten().to_pylist()]
        owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
        told = [i for i, x in enumerate(every) if len(x) > 3]
        lines, of = [every[i] for i in told], owner[told]
        texts = [folded(evened(x or "")) for x in b.column(1).to_pylist()]
        near = has_windows(texts, of.tolist(), lines, [int((1 - least) * len(x) + 1e-9) for x in lines])
        out = [np.bincount(of, weights, minlength=b.num_rows).astype(np.int64) for weights in (near, None)]
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", "hits", "lines"]).filter(pa.array(out[1] > 0))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, hits bigint, lines bigint").groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.sum("lines").alias("lines"))
