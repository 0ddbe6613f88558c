"""Licence scans: an Aho-Corasick automaton over normalised words, and licence expressions.

Words are as the contract has them.  The automaton finds notice phrases and the identifier tag at word boundaries; the
expression after a tag is parsed by shunting-yard (``with`` binds closest, then ``and``, then ``or``) and evaluated: its
identifiers (words of an identifier's form) become labels, and it is permitted if a choice of its alternatives is allowed by the policy.  An expression
with an open operator or bracket at a line's end goes on in the next line.

Null texts count as empty: no words, no labels, null word places, score 0.  Broken expressions give the labels of the
identifiers before the fault and are not permitted.  Repeated rows and rows with null ids get their own answers; an empty
table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases (as words) and the labels that the method adds for them.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "apache license version 2 0": "apache-2.0",
    "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0", "cc0": "cc0", "bsd license": "bsd", "mozilla public license": "mpl", "eclipse public license": "epl",
    "isc license": "isc", "public domain dedication": "public-domain", "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})
# Licence identifiers that are plain words; all others hold a digit, a hyphen or a plus sign.
PLAIN = frozenset({
    "beerware", "curl", "fair", "ftl", "hpnd", "icu", "ijg", "imagemagick", "intel", "ipa", "isc", "json", "libpng", "libtiff", "mit", "mitnfa", "multics", "naumen",
    "ncsa", "netcdf", "ntp", "openssl", "plexus", "postgresql", "qhull", "ruby", "sendmail", "sissl", "sleepycat", "tcl", "unlicense", "vim", "wtfpl", "xnet", "zed", "zlib",
})
_BREAKS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx[^a-z0-9\n]license[^a-z0-9\n]identifier[ \t]*:?[ \t]*([^\n\r]*)", re.I)
_PART = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_COMMENT = re.compile(r"[ \t]*(?://+|/?\*+|#+|--+|;+|%+|\"+|'+)?[ \t]*([^\n\r]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def is_identifier(part: str) -> bool:
    """Whether a lower-case word has the form of a licence identifier; ``see`` has not."""
    return part in PLAIN or bool(re.search(r"[a-z]", part) and re.search(r"[0-9+-]", part))


def parse(expression: str, is_operand=bool) -> list[str] | None:
    """Reverse Polish form of the longest expression that the text starts with; None without one.  ``is_operand`` tells which
    (lower-case) words may be identifiers: any, unless given."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for m in re.finditer(r"\S+", expression):
        gap = _PART.sub("", m[0])
        for part in _PART.findall(m[0]):
            low = part.lower()
            if low == "(" and operand:
                stack.append(low)
            elif low == ")" and not operand and "(" in stack:
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
            elif low in _STRENGTH and not operand:
                while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                    out.append(stack.pop())
                stack.append(low)
                operand = True
            elif operand and low not in _STRENGTH and low not in "()" and is_operand(low.rstrip(".-")):
                out.append(low.rstrip(".-"))
                operand = False
            else:
                gap = "?"
                break
        if gap:
            break
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def identifiers(expression: str, is_operand=bool) -> list[str]:
    """The identifiers before the fault of an expression that is broken."""
    out, operand = [], True
    for m in re.finditer(r"\S+", expression):
        gap = _PART.sub("", m[0])
        for part in _PART.findall(m[0]):
            low = part.lower()
            if low in _STRENGTH and not operand:
                operand = True
            elif operand and low not in _STRENGTH and low not in "()" and is_operand(low.rstrip(".-")):
                out.append(low.rstrip(".-"))
                operand = False
            elif low not in ("(", ")") or (low == "(") != operand:
                return out
        if gap:
            break
    return out


def expression_at(text: str, m: re.Match) -> str:
    """The expression of a tag; while an operator or a bracket is open at a line's end, the next line (without its comment sign) belongs to it."""
    got, end = m[1], m.end()
    while True:
        parts = [p.lower() for p in _PART.findall(got)]
        bare = re.sub(r"[ \t]*(?:\*+/|-->)?[ \t]*$", "", got)
        whole = not re.sub(r"\s", "", _PART.sub("", bare))
        if not (whole and parts and (parts[-1] in _STRENGTH or parts.count("(") > parts.count(")"))) or bare != got.rstrip(" \t"):
            return got
        line = re.compile(r"\r\n|\n|\r").match(text, end)
        more = line and _COMMENT.match(text, line.end())
        if not more or not _PART.match(more[1]):
            return got
        got, end = f"{bare} {more[1]}", more.end()


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """Labels of the expression, and whether the policy permits some choice of its alternatives."""
    stack: list[tuple[set[str], bool]] = []
    for part in rpn:
        if part in _STRENGTH:
            (b, ok_b), (a, ok_a) = stack.pop(), stack.pop()
            if part == "with":
                stack.append(({f"{x}-with-{y}" for x in a for y in b} | a, ok_a))
            else:
                stack.append((a | b, ok_a and ok_b if part == "and" else ok_a or ok_b))
        else:
            stack.append(({part}, part in allowed))
    return stack[0]


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, automaton, allowed: frozenset[str] = PERMISSIVE) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, permitted, score)`` of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BREAKS).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, more, tagged = [], set(), set(), False
    at = word = 0
    for end, phrase in automaton.iter(line):
        if phrase in BASE:
            start = end - len(phrase) - 1
            word += line.count(" ", at, start) - line.count(" ", start, at)
            at = start
            places.append(word)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            more.add(NOTICES[phrase])
    permitted, doubt = None, 1.0
    if tagged:
        for m in _EXPRESSION.finditer(text):
            expression = expression_at(text, m)
            if (rpn := parse(expression, is_identifier)) is None:
                more.update(identifiers(expression, is_identifier))
                permitted = False
                continue
            found, ok = evaluate(rpn, allowed)
            more |= found
            permitted = ok if permitted is None else permitted and ok
            doubt *= 0.05
    for weight in [0.6] * len(base) + [0.5] * len(more - base):
        doubt *= 1 - weight
    labels = sorted(base | more)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), permitted, 1 - doubt if labels else 0.0


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, permitted boolean, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row per document with FIELDS; one pass, no shuffle."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]

    def run(batches):
        a = _automaton()
        for b in batches:
            got = [scan_text(t, a, allowed) for t in b.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {FIELDS}")
