"""Operators on lines: the view's characters as arrays, both ways into an operator, and plans without an exchange of characters."""

import random

import pytest
from pyspark.sql import functions as F

from docflow import queries
from docflow.operators import evaluate, readings
from docflow.plans.fixtures import chars_of, table

SF = "/root/testdata/sf0.001"
KEYS = ["doc_id", "page", "line_id"]


@pytest.fixture(scope="module")
def chars(spark):
    keep = F.col("doc_id") < 12
    return table(spark, SF, "chars").where(keep).cache(), table(spark, SF, "line_packs").where(keep).cache(), table(spark, SF, "reads").where(keep & (F.col("pack") == "arabic")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_characters_of_a_reading_are_those_of_the_view(chars):
    want = {}
    for r in chars[0].orderBy(*KEYS, "pack", "ord").collect():
        want.setdefault((r.doc_id, r.page, r.line_id, r.pack), []).append((r.ord, r.text, r.x, r.confidence))
    got = {}
    for r in chars[1].collect():
        for reading in (r.primary, r.latin):
            c = chars_of(reading.asDict())
            if len(c.x):
                got[r.doc_id, r.page, r.line_id, reading.pack] = list(zip(c.ord.tolist(), c.text, c.x.tolist(), c.confidence.tolist()))
    assert got == want


def test_rows_and_lines_give_the_same(chars):
    rowwise, lines, reads = chars
    packs = [rowwise.where(F.col("pack") == p).drop("pack") for p in ("arabic", "universal")]
    assert rows(readings.merge_script_runs(*packs)) == rows(readings.runs_of_lines(lines, chars_of))
    assert rows(readings.merge_readings(*packs)) == rows(readings.merged_lines(lines, chars_of))
    read = queries._arabic(reads)
    assert rows(readings.spaces_at(packs[0], (0.0, 2.3))) == rows(readings.spaces_of_lines(read, (0.0, 2.3), chars_of))
    whole = evaluate.sweep_gap_factor(packs[0], reads.select(*KEYS, "text"), KEYS)
    lean = evaluate.sweep_of_lines(read.withColumn("truth", F.col("reading.text")), chars=chars_of)
    assert [x[:2] + tuple(round(v, 9) for v in x[2:]) for x in rows(whole)] == [x[:2] + tuple(round(v, 9) for v in x[2:]) for x in rows(lean)]


@pytest.mark.parametrize("name", ["merge_script_runs", "merge_readings", "recover_spaces"])
def test_no_character_is_exchanged(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "explode(sequence" not in plan


def test_sweep_exchanges_no_text(spark):
    plan = queries.QUERIES["sweep_gap_factor"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


def test_runs_of_scattered_characters(spark):
    """Places out of order, and a long line: against the definition, a run at a time."""
    r = random.Random(5)
    main = [(1, 1, 0, i, r.random() * 9, r.choice("ابج "), r.choice([0.5, 0.95])) for i in range(400)]
    latin = [(1, 1, 0, i, r.random() * 9 if i % 7 else i / 50, r.choice("ab1 -"), r.choice([0.3, 0.9, 0.99])) for i in range(400)]
    schema = "doc_id long, page long, line_id long, ord int, x double, text string, confidence double"
    used = [c for c in latin if c[5] in "ab1" and c[6] >= 0.4]
    steps = sorted(b[4] - a[4] for a, b in zip(used, used[1:]))
    least, parts = max(0.035, 3 * steps[len(steps) // 2]), [[used[0]]]
    for a, b in zip(used, used[1:]):
        if b[4] - a[4] > least:
            parts.append([])
        parts[-1].append(b)
    want = []
    for n, p in enumerate(parts):
        lo, hi, mean = min(c[4] for c in p), max(c[4] for c in p), sum(c[6] for c in p) / len(p)
        under = [c for c in main if c[5] != " " and lo - 0.0175 <= c[4] <= hi + 0.0175]
        if len(p) > 1 and mean >= 0.85 and (not under or sum(c[6] >= 0.9 for c in under) / len(under) < 0.5):
            want.append((n, lo, hi, "".join(c[5] for c in latin if lo <= c[4] <= hi).strip(" "), pytest.approx(mean)))
    got = readings.merge_script_runs(spark.createDataFrame(main, schema), spark.createDataFrame(latin, schema)).orderBy("run").collect()
    assert want and [tuple(x)[3:] for x in got] == want
