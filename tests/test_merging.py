"""Latin runs merged into a line's primary reading: characters with place and confidence, and the text that is wanted."""

import pytest

from docflow.operators import readings

SCHEMA = "doc_id long, page long, line_id long, ord int, x double, text string, confidence double"


def line(text, start=0.05, pitch=0.03, confidence=0.95):
    return [(c, start + i * pitch, confidence) for i, c in enumerate(text)]


# name: primary, Latin reading, merged text (None: the line keeps its primary reading)
CASES = {
    "a Latin word replaces the guess at it": (
        [("أ", 0.05, 0.44), ("و", 0.08, 0.36), ("أ", 0.11, 0.43), ("ر", 0.14, 0.66), (" ", 0.26, 0.90), ("ى", 0.30, 0.99), ("ل", 0.33, 1.0), ("ع", 0.36, 0.99)],
        line("Original", 0.05, 0.02, 0.96), "Original ىلع",
    ),
    "two words do not swallow the script between them": (
        [("M", 0.05, 0.79), ("r", 0.11, 0.27), ("ا", 0.13, 0.26), (" ", 0.28, 0.90), ("ع", 0.31, 0.99), ("ل", 0.34, 1.0), ("ى", 0.37, 0.99), (" ", 0.39, 0.90), ("ن", 0.42, 0.43), ("ر", 0.45, 0.36), ("ا", 0.48, 0.66)],
        line("Markdown", 0.05, 0.03) + line("Original", 0.42, 0.02), "Markdown على Original",
    ),
    "Latin over sure script is rejected": ([("ه", 0.10, 0.99), ("ذ", 0.20, 1.0), ("ا", 0.30, 0.98), ("م", 0.50, 0.99), ("ق", 0.60, 1.0), ("ص", 0.70, 0.99)], [("J", 0.10, 0.90), ("e", 0.20, 0.88), ("a", 0.30, 0.92)], None),
    "a lone character never wins": ([("و", 0.10, 0.55), ("ل", 0.20, 0.60)], [("J", 0.10, 0.99)], None),
    "an echo of a run's edge is not doubled": ([("R", 0.03, 0.70), (" ", 0.25, 0.90), ("ب", 0.30, 0.50), ("س", 0.34, 0.45)], line("Repost", 0.06, 0.02, 0.96), "Repost بس"),
    "no Latin at all": (line("مرحبا", confidence=0.98), [], None),
    "a Latin line stays": (line("Invoice 4471", confidence=0.97), line("Invoice 4471", confidence=0.98), "Invoice 4471"),
    **{f"token {t}": ([("ذ", 0.60, 0.45), ("ه", 0.64, 0.50)], line(t), f"{t}ذه") for t in ("Scanly OCR", "Version 2.5", "Android 15", "GPT-5")},
}


@pytest.fixture(scope="module")
def merged(spark):
    rows = [[(1, 1, n, i, x, c, conf) for n, case in enumerate(CASES.values()) for i, (c, x, conf) in enumerate(case[side])] for side in (0, 1)]
    primary, latin = (spark.createDataFrame(r, SCHEMA) for r in rows)
    runs = {r.line_id for r in readings.merge_script_runs(primary, latin).collect()}
    return {r.line_id: r.text for r in readings.merge_readings(primary, latin).collect()}, runs


@pytest.mark.parametrize("name", CASES)
def test_merging(merged, name):
    texts, runs = merged
    n, want = list(CASES).index(name), CASES[name][2]
    assert (n in runs) == (want is not None) and texts.get(n) == want
