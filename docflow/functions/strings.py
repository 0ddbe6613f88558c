"""SQL with named DataFrames, and Unicode white space (Spark's own trim only strips spaces)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: white space: ASCII controls 9-13 and 28-31, and Unicode separators
WS = r"[\x{9}-\x{D}\x{1C}-\x{1F}\p{Z}]"
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x20), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Letters folded when diacritics do not count.
FOLD_FROM, FOLD_TO = "أإآٱىة", "ااااي" + "ه"


def run_sql(text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over DataFrames: ``{name}`` stands for a frame, ``@trim(column)`` for the column without outer white space.

    Other braces (of patterns) are taken as they are.
    """
    text = re.sub(r"@trim\((\w+)\)", lambda m: f"regexp_replace({m[1]}, r'^{WS}+|{WS}+$', '')", text)
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
