"""Scripts of pages, counted in batches."""

import random
import re

from docflow.functions.strings import WS
from docflow.operators import readings

ODD = "a Z\u00e9\u00d7\u0390\u05d0\u05be\u0627\u064b\u0660\u061b\u07ea\u07eb\u0904\u1fff\u2000\u3041\ud7ff\ufb1d\ufb1e\ufefc\U0001f600\U00010800 \t\x1c\u00a0\u200b\u2028\u3000#7"


def test_counts_equal_the_patterns_over_every_character():
    python = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", p).replace(r"\p{Z}", r" \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))
    rtl, ltr, outer = python(readings.RTL), python(readings.LTR), python(f"^{WS}+|{WS}+$")
    r = random.Random(2)
    texts = [None, "", *map(chr, [*range(0xD800), *range(0xE000, 0x11000)]), *("".join(r.choices(ODD, k=r.randint(1, 30))) for _ in range(3000))]
    got = list(zip(*(c.tolist() for c in readings._counts(texts))))
    assert got == [(len(rtl.findall(t)), len(ltr.findall(t)), len(outer.sub("", t))) for t in (x or "" for x in texts)]


def test_profile_of_null_texts_and_unknown_confidence(spark):
    rows = [(1, 1, "p", " \u05d0\u05d0b ", 0.9), (1, 1, "p", "cc", None), (1, 1, "p", None, 0.5), (2, 1, "p", None, 0.9), (3, 1, "q", "12", 0.3)]
    got = {r.doc_id: tuple(r)[3:] for r in readings.script_profile(spark.createDataFrame(rows, "doc_id long, page long, pack string, text string, confidence double")).collect()}
    assert got == {1: (2, 3, 0.4, False, 3, False), 2: (None, None, None, None, None, None), 3: (0, 0, 0.0, False, 2, False)}
