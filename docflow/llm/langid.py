"""Language identification by rank-order profiles.

Every language has a profile: its most frequent character n-grams in rank order.  A document's own profile is compared with
each by out-of-place distance: the sum, over the document's n-grams, of how far the rank is off, or the profile length
where the language lacks the n-gram.  The nearest language wins; ties go to the smaller name.

Words are maximal runs of letters, lower-cased, padded with ``_``; n-grams of one to three characters lie within a padded
word.  Null texts and texts without a letter are ``und`` with score 0.  Rows without a language teach nothing.  With no
labelled row at all every document is ``und``.  Repeated rows get equal answers; extra columns are kept, but those that are named
like a result column give way to it (as in ``withColumn``); an empty table gives an empty result.  A text is read whole
and its n-grams are counted in memory that grows with its length alone.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, returned

SIZE, MAX_LABELS = 300, 10_000
PAD = ord("_")
_FLUSH = 1 << 22  # characters whose n-grams are counted at once


@lru_cache(1)
def _letters() -> np.ndarray:
    """Every code point as itself if it is a letter, else the pad."""
    return np.array([c if chr(c).isalpha() else PAD for c in range(sys.maxunicode + 1)], dtype=np.int64)


def _padded(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one pad around each word."""
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = points == PAD
    return points[~(gap & np.concatenate([[False], gap[:-1]]))]


def _grams(points: np.ndarray) -> np.ndarray:
    """The n-grams of padded words as numbers of 3 x 21 bits, in the order of the strings."""
    two, three = points[:-1] << 42 | points[1:] << 21, points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    return np.concatenate([points[points != PAD] << 42, two, three[points[1:-1] != PAD]])


def _string(gram: int) -> str:
    return "".join(chr(c) for c in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


def _number(gram: str) -> int:
    return sum(ord(c) << (42 - 21 * i) for i, c in enumerate(gram))


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """Profiles ``(lang, rank, gram, n)``, ranks from 0, of all labelled rows; ties in n-gram order."""

    def count(batches):
        frugal()
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        alphabet, index = np.array([PAD], np.int64), np.full(sys.maxunicode + 1, -1, np.int32)
        index[PAD] = 0

        def out():
            nonlocal alphabet
            for lang, parts in held.items():
                points = np.concatenate(parts)
                at = index[points]
                if (at < 0).any():
                    fresh = np.unique(points[at < 0])
                    index[fresh] = len(alphabet) + np.arange(len(fresh), dtype=np.int32)
                    alphabet = np.concatenate([alphabet, fresh])
                    at = index[points]
                if len(alphabet) <= 160:  # few letters: count by position in a table of all n-grams
                    a, at = len(alphabet), at.astype(np.int64)
                    three = np.bincount(((at[:-2] * a + at[1:-1]) * a + at[2:])[at[1:-1] > 0], minlength=a**3).reshape(a, a, a)
                    two = np.bincount(at[:-1] * a + at[1:], minlength=a * a).reshape(a, a)
                    one = np.bincount(at, minlength=a)
                    one[0] = 0
                    keys, n = [], []
                    for table in (one, two, three):
                        where = np.nonzero(table)
                        keys.append(sum(alphabet[w] << (42 - 21 * i) for i, w in enumerate(where)))
                        n.append(table[where])
                    keys, n = np.concatenate(keys), np.concatenate(n)
                    own = keys != PAD << 42 | PAD << 21  # two pads meet only between documents
                    keys, n = keys[own], n[own]
                else:
                    grams = _grams(points.astype(np.int64))
                    keys, n = _counted(grams[grams != PAD << 42 | PAD << 21])
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([_string(int(k)) for k in keys]), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                for text, lang in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    held.setdefault(lang, []).append(_padded(text).astype(np.int32))
                    size += len(held[lang][-1])
                if size > _FLUSH:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()
        held.clear()
        returned()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "rank", "gram", "n")


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = SIZE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1 less the distance over the largest possible distance).

    Profiles are ``size`` rows a language and go to every task; more than MAX_LABELS labels (300 rows of 40 bytes each) are an error,
    as they are no languages any more.
    """
    learned: dict[str, list[tuple[int, int]]] = {}
    for r in profiles.limit(MAX_LABELS * size + 1).collect():
        learned.setdefault(r.lang, []).append((_number(r.gram), r.rank))
    if len(learned) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} language labels")
    langs = sorted(learned)
    known = np.array(sorted({g for rows in learned.values() for g, _ in rows}), np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int32)  # the last column: n-grams that no profile has
    for i, lang in enumerate(langs):
        for g, rank in learned[lang]:
            ranks[i, np.searchsorted(known, g)] = rank
    text = F.col(text_col).alias("__text")
    docs = docs.select(text, "*").drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in names}))
    schema = docs.drop("__text").select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema

    def judged(text: str | None) -> tuple[str, float]:
        points = _padded(text) if text and langs else ()
        if len(points) < 2:
            return "und", 0.0
        grams, n = _counted(_grams(points))
        top = grams[np.argsort(-n, kind="stable")[:size]]
        k = np.searchsorted(known, top)
        rank = ranks[:, np.where(known[np.minimum(k, len(known) - 1)] == top, k, len(known))]
        far = np.where(rank < 0, size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())
        return langs[best], float(1 - far[best] / (size * len(top)))

    def judge(batches):
        frugal()
        for b in (batch.slice(i, 1000) for batch in batches for i in range(0, batch.num_rows, 1000)):
            got = [judged(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*b.schema.names[1:], *names])
        returned()

    return docs.mapInArrow(judge, schema)


def identify(docs: DataFrame, teach: Column, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """Learn profiles from the rows where ``teach`` holds, then predict every row."""
    return predict(docs, learn(docs.where(teach), text_col, lang_col, size), text_col, size)
