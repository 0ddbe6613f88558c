"""Readings of one line as arrays of characters, and what is decided inside a line: Latin runs, merging, lost spaces, reading direction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

# Merging Latin runs.
GAP, SEEN, SURE, SURE_SHARE, RUN_MEAN, PITCHES = 0.035, 0.4, 0.9, 0.5, 0.85, 3
#: what a character is: spaces only, Latin with a letter or digit, beyond Latin, Arabic throughout, null
BLANK, LATIN, OTHER, ARABIC, NULL = 1, 2, 4, 8, 16
_SPACES = re.compile(" {2,}")

_KINDS = np.full(0x110000, OTHER, np.uint8)
_KINDS[:0x590] = [LATIN if unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nd" else 0 for c in range(0x590)]
_KINDS[0x600:0x700] |= ARABIC
_KINDS[0x20] = BLANK


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Chars(NamedTuple):
    """A reading of a line in the order of ``ord``; ``text`` is a string of single characters, or a list; unknown numbers are NaN."""

    ord: np.ndarray
    x: np.ndarray
    text: str | list[str]
    confidence: np.ndarray
    kind: np.ndarray


def of_text(text: str, x: np.ndarray, confidence: np.ndarray) -> Chars:
    return Chars(np.arange(len(text)), x, text, confidence, _KINDS[codes(text)])


def _kind(c: str | None) -> int:
    if c is None:
        return NULL
    each = _KINDS[codes(c)]
    if not c.strip(" "):
        return BLANK
    if (each & OTHER).any():
        return OTHER | (ARABIC if (each & ARABIC).all() else 0)
    return LATIN if (each & LATIN).any() else 0


def of_rows(rows: Iterable[dict]) -> Chars:
    """From rows of ``ord, text, x, confidence``."""
    rows = sorted(rows, key=lambda r: (r["ord"], r["text"] or ""))
    kinds = {c: _kind(c) for c in {r["text"] for r in rows}}
    numbers = lambda name: np.array([r.get(name) for r in rows], np.float64)
    return Chars(np.array([r["ord"] for r in rows], np.int64), numbers("x"), [r["text"] or "" for r in rows], numbers("confidence"), np.array([kinds[r["text"]] for r in rows], np.uint8))


def _by_place(c: Chars) -> np.ndarray | None:
    """Characters by place, unknown ones first; None where they stand so already."""
    if not np.isnan(c.x).any() and (c.x[1:] >= c.x[:-1]).all():
        return None
    return np.lexsort((c.ord, np.where(np.isnan(c.x), -np.inf, c.x)))


def _joined(text: str | list[str], at: np.ndarray) -> str:
    return "".join(map(text.__getitem__, at.tolist()))


class Runs(NamedTuple):
    run: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    text: list[str]
    confidence: np.ndarray


def winning_runs(primary: Chars, latin: Chars) -> Runs | None:
    """The Latin runs that win over the primary reading (see ``operators.readings.merge_script_runs``)."""
    at = np.flatnonzero((latin.kind & LATIN).astype(bool) & (latin.confidence >= SEEN))
    if len(at) < 2:
        return None
    x = latin.x[at]
    step = np.diff(x)
    known = np.sort(step[~np.isnan(step)])
    fresh = step > max(GAP, PITCHES * known[len(known) // 2] if len(known) else GAP)
    start = np.flatnonzero(np.concatenate([[True], fresh]))
    size = np.diff(np.append(start, len(at)))
    lo, hi, mean = np.fmin.reduceat(x, start), np.fmax.reduceat(x, start), np.add.reduceat(latin.confidence[at], start) / size
    run = np.flatnonzero((size >= 2) & (mean >= RUN_MEAN) & ~np.isnan(lo))
    if not len(run):
        return None
    lo, hi, mean = lo[run], hi[run], mean[run]
    under = np.flatnonzero(((primary.kind & (BLANK | NULL)) == 0) & ~np.isnan(primary.x))
    under = under[np.argsort(primary.x[under], kind="stable")]
    sure = np.concatenate([[0], np.cumsum(((primary.kind[under] & OTHER) > 0) & (primary.confidence[under] >= SURE))])
    a, b = np.searchsorted(primary.x[under], lo - GAP / 2, "left"), np.searchsorted(primary.x[under], hi + GAP / 2, "right")
    wins = (a == b) | (sure[b] - sure[a] < SURE_SHARE * (b - a))
    if not wins.any():
        return None
    run, lo, hi, mean = run[wins], lo[wins], hi[wins], mean[wins]
    order = _by_place(latin)
    places = latin.x if order is None else latin.x[order]
    first = np.count_nonzero(np.isnan(places))  # unknown places stand in front
    a, b = first + np.searchsorted(places[first:], lo, "left"), first + np.searchsorted(places[first:], hi, "right")
    text = ["".join(latin.text[i:j]) if order is None else _joined(latin.text, np.sort(order[i:j])) for i, j in zip(a.tolist(), b.tolist())]
    return Runs(run, lo, hi, [t.strip(" ") for t in text], mean)


def merged(primary: Chars, runs: Runs) -> tuple[str, float | None]:
    """Text and mean confidence of a line after its winning runs have replaced what lies under them."""
    kept = np.ones(len(primary.x), bool)
    blank, latin = (primary.kind & BLANK) > 0, (primary.kind & LATIN) > 0
    for of, pad in ((blank, 0.0), (latin, GAP), (~(blank | latin), GAP / 2)):
        x = primary.x[of]
        kept[of] = np.searchsorted(np.sort(runs.lo - pad), x, "right") == np.searchsorted(np.sort(runs.hi + pad), x, "left")
    at = np.flatnonzero(kept)
    x = np.concatenate([primary.x[at], runs.lo])
    order = np.lexsort((np.concatenate([primary.ord[at], runs.run]), np.arange(len(x)) >= len(at), np.where(np.isnan(x), -np.inf, x)))
    confidence = np.concatenate([primary.confidence[at], runs.confidence])
    confidence = confidence[~np.isnan(confidence)]
    text = _joined([*map(primary.text.__getitem__, at.tolist()), *runs.text], order)
    return _SPACES.sub(" ", text), float(confidence.sum() / len(confidence)) if len(confidence) else None


def spaced(c: Chars, factors: Iterable[float]) -> list[str]:
    """The line's text with the spaces recovered at each factor; 0 keeps the stored text."""
    stored = c.text if isinstance(c.text, str) else "".join(c.text)
    order = _by_place(c)
    x, kind, text = (c.x, c.kind, c.text) if order is None else (c.x[order], c.kind[order], [c.text[i] for i in order.tolist()])
    step = np.diff(x)
    rising = np.sort(step[step > 0])
    if len(x) < 3 or not len(rising):
        return [stored for _ in factors]
    pitch, arabic = rising[len(rising) // 2], (kind & ARABIC) > 0
    wide = np.where(arabic[1:] & arabic[:-1], step, -np.inf)
    out = []
    for f in factors:
        if f == 0:
            out.append(stored)
            continue
        cuts = [0, *(np.flatnonzero(wide > pitch * f) + 1).tolist(), len(x)]
        out.append(_SPACES.sub(" ", " ".join("".join(text[a:b]) for a, b in zip(cuts, cuts[1:]))))
    return out
