"""Logical order inside the row: long lines, and no exchange."""

from docflow.operators import readings


def test_a_long_line_and_a_plan_without_exchange(spark):
    text = "".join(f"ab.{n} (دج) " for n in range(20000))
    lines = spark.createDataFrame([(1, text), (2, None), (3, "abc"), (4, "x. د")], "doc_id long, text string")
    df = readings.logical_order(lines, "doc_id")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.text for r in df.collect()}
    assert got == {1: got[1], 3: "abc", 4: "د .x"}
    assert len(got[1]) == len(text) and got[1].startswith(" (جد) ab.19999 (جد) ab.19998")
