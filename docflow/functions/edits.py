"""Edit distances a whole column of cells at once: a row of the table is the bits of one integer, so a step costs n / 64 words."""

from __future__ import annotations

import re
from itertools import repeat
from operator import contains

import numpy as np

from .strings import FOLD_FROM, FOLD_TO

_WS = r"\t-\r\x1c-\x1f \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS, _UNEVEN = re.compile(f"[{_WS}]+"), re.compile(f"[{_WS.replace(' ', '')}]|  ")
_MARKS, _FOLDED = re.compile("[\u064b-\u0652\u0640]+"), re.compile(f"[\u064b-\u0652\u0640{FOLD_FROM}]")
_FOLDS = str.maketrans(FOLD_FROM, FOLD_TO)


def _columns(text: str, pattern: str, fixed: bool):
    """The distance of ``pattern`` and the text so far, after each character; ``fixed``: from its start, else from any place before."""
    n = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, top, low = (1 << n) - 1, 1 << (n - 1), int(fixed)
    up, down, now = mask, 0, n
    get = where.get
    for c in text:
        eq = get(c, 0)
        side = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        more, less = down | (mask & ~(diagonal | up)), up & diagonal
        if more & top:
            now += 1
        elif less & top:
            now -= 1
        more = more << 1 | low
        up = (less << 1 | (mask & ~(side | more))) & mask
        down = more & side & mask
        yield now


def distance(a: str, b: str) -> int:
    """The edit distance, after what both begin and end with alike is left out."""
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    a, b, most = a[lo:], b[lo:], most - lo
    hi = 0
    while hi < most and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return len(a) or len(b)
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(map(contains, repeat(rest), b)):  # only insertions: nothing is shorter than what the lengths differ by
        return len(a) - len(b)
    for now in _columns(a, b, True):
        pass
    return now


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, one after the other: each element's run, and its place in it."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - (np.cumsum(size) - size)[run]


def _dense(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different characters there are, and each one's number among them."""
    seen = np.bincount(codes) > 0
    return int(np.count_nonzero(seen)), (np.cumsum(seen) - 1)[codes]


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """``distance`` of many pairs at once: what both begin and end with alike is left out; where the characters that one side has too many of
    are as many as the places that differ, that is the distance; the rest goes through the table, many pairs a step."""
    n = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    order, out = np.argsort(n, kind="stable"), np.zeros(len(a), np.int64)
    # pairs of about one length, as many as caches hold
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(n[order]) // _BLOCK)) + 1):
        if len(part):
            out[part] = _alike([a[i] for i in part], [b[i] for i in part])
    return out


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    (x, n), (y, m) = _flat(a), _flat(b)
    kinds, both = _dense(np.concatenate([x, y]))
    x, y = both[: len(x)], both[len(x) :]
    at_x, at_y, most = np.cumsum(n) - n, np.cumsum(m) - m, np.minimum(n, m)
    run, i = _spread(most)
    head = most.copy()
    other = x[at_x[run] + i] != y[at_y[run] + i]
    np.minimum.at(head, run[other], i[other])
    tail = most - head
    other = x[(at_x + n - 1)[run] - i] != y[(at_y + m - 1)[run] - i]
    np.minimum.at(tail, run[other], i[other])
    at_x, at_y, n, m = at_x + head, at_y + head, n - head - tail, m - head - tail
    out = np.maximum(n, m)
    left = np.flatnonzero((n > 0) & (m > 0))
    # blocks of pairs, so that counts of characters stay small
    for part in np.array_split(left, len(left) * kinds // _COUNTS + 1):
        if len(part):
            out[part] = _told(x, y, at_x[part], at_y[part], n[part], m[part], kinds)
    return out


# Characters of a block of pairs; counts of characters, words, and words of character masks that are held at once.
_BLOCK, _COUNTS, _WORDS, _MASKS = 1 << 19, 1 << 21, 4096, 1 << 21


def _told(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, n: np.ndarray, m: np.ndarray, kinds: int) -> np.ndarray:
    (run_x, i), (run_y, j) = _spread(n), _spread(m)
    x, y = x[at_x[run_x] + i], y[at_y[run_y] + j]
    more = [np.bincount(run * kinds + c, minlength=len(n) * kinds) for run, c in ((run_x, x), (run_y, y))]
    more = (more[0] - more[1]).reshape(len(n), -1)
    least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    most, even = np.maximum(n, m), n == m
    most[even] = np.bincount(run_x[even[run_x]], x[even[run_x]] != y[even[run_y]], minlength=len(n))[even]
    out = np.where(most <= 2, most, least)  # one or two places of equally long texts that differ are as many edits
    start_x, start_y = np.cumsum(n) - n, np.cumsum(m) - m
    words = (m + 63) // 64
    left = np.flatnonzero((least < most) & ((most > 2) | ~even))
    # a bound that most keep; what lies beyond it is done again with a wider one
    bound = np.minimum(most, np.maximum(np.maximum(64, np.maximum(n, m) // 4), 2 * least))
    while len(left):
        again, left = [], left[np.lexsort((n[left], words[left]))]
        while len(left):
            first = left[0]
            reach = (bound[left] + abs(n[left] - m[left])) // 2 + 1
            held = np.maximum.accumulate(np.minimum(words[left], 2 * reach // 65 + 2)) * np.arange(1, len(left) + 1)
            fits = (held <= _WORDS) & (words[left] <= words[first] * 5 // 4) & (n[left] <= n[first] * 5 // 4 + 64)
            many = max(1, len(left) if fits.all() else int(fits.argmin()))
            now, left, reach = left[:many], left[many:], int(reach[:many].max())
            text, pattern = [x[s : s + k] for s, k in zip(start_x[now], n[now])], [y[s : s + k] for s, k in zip(start_y[now], m[now])]
            wide = int(words[now[-1]])
            # in microseconds a step, as measured: few long texts are quicker one by one
            if 25 + 0.02 * many * min(wide, 2 * reach // 65 + 2) > many * (1.5 + 0.045 * wide):
                out[now] = [distance(*(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for c in pair)) for pair in zip(text, pattern)]
                continue
            out[now] = _stepped(text, pattern, reach)
            over = now[out[now] > bound[now]]
            bound[over] = np.minimum(out[over], 4 * bound[over])
            again.append(over)
        left = np.concatenate(again) if again else left
    return out


def _stepped(text: list[np.ndarray], pattern: list[np.ndarray], reach: int) -> np.ndarray:
    """Distances of several texts and their patterns, exact where no more than ``reach`` from the diagonal is needed, else not below them.

    A pattern's bits are words of 64, each a character of the text behind the word above it, so that all words of all pairs take a step at once; a
    word is under way while its rows lie within ``reach`` of the diagonal.
    """
    n, m = np.array([len(t) for t in text]), np.array([len(p) for p in pattern])
    words, pairs = (m + 63) // 64, len(text)
    deep = int(words.max())
    size = deep * pairs
    letters, place = _dense(np.concatenate([*pattern, *text]))
    place, known = place[: m.sum()], place[m.sum() :]
    if (letters + 1) * size > _MASKS and pairs > 1:
        half = pairs // 2
        return np.concatenate([_stepped(text[:half], pattern[:half], reach), _stepped(text[half:], pattern[half:], reach)])
    owner, bit = _spread(m)
    masks = np.zeros((letters + 1) * size, np.uint64)  # the last row: behind a text's end
    np.add.at(masks, place * size + bit // 64 * pairs + owner, np.uint64(1) << (bit % 64).astype(np.uint64))
    until = n + words - 2  # the step in which a pair's last word meets its last character
    steps = int(until.max()) + 1
    owner, i = _spread(n)
    columns = np.full((steps, pairs), letters * size)
    columns[i, owner] = known * size
    every = np.arange(size).reshape(deep, pairs)
    top = np.full((deep, pairs), 63, np.uint64)
    top[words - 1, np.arange(pairs)] = (m - 1) % 64
    up, down, score = np.full((deep, pairs), ~np.uint64(0)), np.zeros((deep, pairs), np.uint64), np.zeros((deep, pairs), np.int64)
    # what each word hears from the one above it, in row 0 from the table's edge
    more, less = np.zeros((deep + 1, pairs), np.uint64), np.zeros((deep + 1, pairs), np.uint64)
    more[0] = 1
    rises, falls = more.view(np.int64), less.view(np.int64)
    out, one = np.zeros(pairs, np.int64), np.uint64(1)
    ended = np.argsort(until, kind="stable")
    until, done = until[ended].tolist(), 0
    space = [np.empty((deep, pairs), t) for t in (np.int64, *[np.uint64] * 5)]
    hi = 0
    for step in range(steps):
        lo = max(0, -((63 + reach - step) // 65))
        if hi < min(deep, step + 1, (step + reach) // 65 + 1):
            score[hi] = top[hi].astype(np.int64) + 1
            if hi:
                score[hi] += score[hi - 1] - rises[hi] + falls[hi]
            hi += 1
        if lo:
            more[lo], less[lo] = 1, 0
        if lo < hi:
            now = slice(lo, hi)
            at, eq, side, sums, gain, loss = (s[: hi - lo] for s in space)
            u, d, t = up[now], down[now], top[now]
            np.add(columns[step - hi + 1 : step - lo + 1][::-1], every[now], out=at)
            np.take(masks, at, out=eq, mode="clip")
            np.bitwise_or(eq, d, out=side)
            np.bitwise_or(eq, less[now], out=eq)
            np.bitwise_and(eq, u, out=sums)
            np.add(sums, u, out=sums)
            np.bitwise_xor(sums, u, out=sums)
            np.bitwise_or(sums, eq, out=sums)
            np.bitwise_and(u, sums, out=loss)
            np.bitwise_or(sums, u, out=gain)
            np.invert(gain, out=gain)
            np.bitwise_or(gain, d, out=gain)
            np.left_shift(gain, one, out=eq)
            np.bitwise_or(eq, more[now], out=eq)
            np.left_shift(loss, one, out=sums)
            np.bitwise_or(sums, less[now], out=sums)
            g, l = more[lo + 1 : hi + 1], less[lo + 1 : hi + 1]
            np.right_shift(gain, t, out=g)
            np.bitwise_and(g, one, out=g)
            np.right_shift(loss, t, out=l)
            np.bitwise_and(l, one, out=l)
            np.add(score[now], rises[lo + 1 : hi + 1], out=score[now])
            np.subtract(score[now], falls[lo + 1 : hi + 1], out=score[now])
            np.bitwise_or(side, eq, out=u)
            np.invert(u, out=u)
            np.bitwise_or(u, sums, out=u)
            np.bitwise_and(eq, side, out=d)
        while done < pairs and until[done] == step:
            k = ended[done]
            out[k] = score[words[k] - 1, k]
            done += 1
    return out


def evened(text: str) -> str:
    """White space as one space, none at the ends."""
    return (_BLANKS.sub(" ", text) if _UNEVEN.search(text) else text).strip(" ")


def folded(text: str) -> str:
    """Without diacritics, and with letters folded."""
    return _MARKS.sub("", text).translate(_FOLDS) if _FOLDED.search(text) else text


def similarity(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


class Truth:
    """A true text, to be compared with several readings; equal readings are measured once."""

    def __init__(self, text: str | None):
        self.raw = None if text is None else evened(text)
        self.folded = None if text is None else folded(self.raw)
        self.met: dict[str, tuple[float, float]] = {}

    def similarities(self, text: str | None) -> tuple[float | None, float | None]:
        """As they are, and folded; None if either text is."""
        if text is None or self.raw is None:
            return None, None
        if text not in self.met:
            raw = evened(text)
            fold = folded(raw)
            first = similarity(raw, self.raw)
            self.met[text] = first, first if fold == raw and self.folded == self.raw else similarity(fold, self.folded)
        return self.met[text]


def has_window(text: str, line: str, most: int) -> bool:
    """Whether a window of the line's length in the text (the whole text, if it is shorter) is within ``most`` edits of it.

    One pass finds the ends of what lies within ``most`` edits of the line whatever its length; only windows that end there can be.
    """
    n = len(line)
    if len(text) <= n:
        return n - len(text) <= most and distance(text, line) <= most
    ends = sorted((d, j) for j, d in enumerate(_columns(text, line, False)) if d <= most and j >= n - 1)
    out: set[int] = set()
    for _, j in ends:
        if j not in out:
            over = distance(text[j + 1 - n : j + 1], line) - most
            if over <= 0:
                return True
            out.update(range(j - (over - 1) // 2, j + (over + 1) // 2))  # a window one place on is at most two edits nearer
    return False


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` characters at each place; different ones rarely share it."""
    key = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(key)]
    return key


class Text:
    """A text whose n-grams are sorted once, to be asked for windows near many lines.

    A line of n characters in m pieces: a window within e edits holds m - e of them intact, none moved by more than e / 2.  The first characters
    of the pieces are looked up; only where m - e of them, or more, start within e places of each other, and where windows share enough
    short runs of characters with the line, are windows measured.
    """

    def __init__(self, text: str, busy: int = 1 << 22):
        self.text, self.busy = text, busy
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _places(self, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if size not in self.sorted:
            grams = _grams(self.codes, size)
            order = np.argsort(grams, kind="stable")
            self.sorted[size] = grams[order], order
        grams, order = self.sorted[size]
        return np.searchsorted(grams, keys, "left"), np.searchsorted(grams, keys, "right"), order

    def near(self, line: str, most: int) -> bool:
        n, long = len(line), len(self.text)
        if long <= n:
            return has_window(self.text, line, most)
        if line in self.text:
            return True
        if not most:
            return False
        pieces = max(most + 1, n // 4)
        start = np.arange(pieces) * n // pieces
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = min(4, n // pieces)
        lo, hi, order = self._places(_grams(codes, size)[start], size)
        many = hi - lo
        if many.sum() > self.busy:  # few different pieces: measuring everywhere is cheaper
            return has_window(self.text, line, most)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        begin = np.sort(order[inside] - np.repeat(start, many))
        need = pieces - most
        if len(begin) < need:
            return False
        first, last = begin[: len(begin) - need + 1], begin[need - 1 :]
        half = most // 2  # a window has the line's length: as many characters come in as go out, and nothing moves by more than half the edits
        close = last - first <= 2 * half
        low, high = np.maximum(last[close] - half, 0), np.minimum(first[close] + half, long - n)
        low, high = low[low <= high], high[low <= high]
        if not len(low):
            return False
        begins = np.concatenate([high - half, low + half])  # what most pieces agree on: count differing characters before edits
        begins = np.unique(begins[(begins >= np.tile(low, 2)) & (begins <= np.tile(high, 2))])
        windows = np.lib.stride_tricks.sliding_window_view(self.codes, n)
        for part in np.array_split(begins, len(begins) * n // self.busy + 1):
            if len(part) and ((windows[part] != codes).sum(axis=1) <= most).any():
                return True
        runs: list[list[int]] = []
        for a, b in self._able(low, high, codes, most):
            if runs and a <= runs[-1][1] + n:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        return any(has_window(self.text[a : b + n], line, most) for a, b in runs)

    def _able(self, low: np.ndarray, high: np.ndarray, codes: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Spans of window starts in any of ``low`` to ``high`` (both ascending), less those whose windows hold too few of the line's pairs and triples
        of characters near their places: an edit spoils no more than q of the line's n - q + 1 runs of q characters."""
        n, half = len(codes), most // 2
        fresh = np.concatenate([[True], low[1:] > high[:-1] + 1])
        first, last = low[fresh], high[np.append(np.flatnonzero(fresh)[1:] - 1, len(high) - 1)]
        wide = max(8, n // 4)
        parts = (last - first) // wide + 1
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a = np.repeat(first, parts) + step * wide
        b = np.minimum(a + wide - 1, np.repeat(last, parts))
        for q in (3, 2):
            least = n - q + 1 - q * most
            if least <= 0 or not len(a):
                continue
            grams = _grams(codes, q)
            lo, hi, order = self._places(grams, q)
            if q not in self.ranked:
                sorted_ = self.sorted[q][0]
                rank = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) * len(self.codes)
                self.ranked[q] = rank, rank + order  # ascending: by gram, then by place
            rank, placed = self.ranked[q]
            known = np.flatnonzero(hi > lo)
            if len(known) < least:
                return []
            able = []
            for x, y in zip(np.array_split(a, len(a) * len(known) // self.busy + 1), np.array_split(b, len(a) * len(known) // self.busy + 1)):
                base = rank[lo[known]]
                begin = np.searchsorted(placed, base + np.maximum(x[:, None] + (known - half), 0), "left")
                end = np.searchsorted(placed, base + np.minimum(y[:, None] + (known + half), len(self.codes) - 1), "right")
                able.append((end > begin).sum(axis=1) >= least)
            able = np.concatenate(able)
            a, b = a[able], b[able]
        return list(zip(a.tolist(), b.tolist()))


def has_windows(texts: list[str], of: list[int], lines: list[str], most: list[int], busy: int = 1 << 22) -> np.ndarray:
    """``has_window`` of many lines, each in its text (``of``) within its ``most`` edits, as ``Text`` finds it but a step at a time for all lines.

    The pieces of all lines are looked up together; windows that agree with their line place by place are told first, and spans that may hold one are
    measured side by side.  Lines beyond ``_LONG`` characters go by themselves.
    """
    out, rest, short, alone = np.zeros(len(lines), bool), [], [], {}
    for i, (t, line, e) in enumerate(zip(of, lines, most)):
        long, n = len(texts[t]), len(line)
        if long <= n:
            if n - long <= e:
                short.append(i)
        elif e >= n or line in texts[t]:
            out[i] = True
        elif e:
            alone.setdefault(t, []).append(i) if n > _LONG else rest.append(i)
    out[short] = distances([texts[of[i]] for i in short], [lines[i] for i in short]) <= np.array([most[i] for i in short], np.int64)
    for t, which in alone.items():
        held = Text(texts[t], busy)
        out[which] = [held.near(lines[i], most[i]) for i in which]
    if rest:
        used, own = np.unique([of[i] for i in rest], return_inverse=True)
        out[rest] = _Lines([texts[t] for t in used.tolist()], own, [lines[i] for i in rest], np.array([most[i] for i in rest], np.int64), busy).told()
    return out


# Characters of a line that is sought with others; places that are held at once while spans are measured.
_LONG, _PLACES = 2048, 1 << 21


def _chunks(weight: np.ndarray, busy: int) -> list[np.ndarray]:
    """Runs of numbers whose weights sum up to about ``busy``."""
    return [p for p in np.split(np.arange(len(weight)), np.flatnonzero(np.diff(np.cumsum(weight) // busy)) + 1) if len(p)]


class _Lines:
    """Lines that are shorter than their texts and in them with edits, if at all."""

    def __init__(self, texts: list[str], of: np.ndarray, lines: list[str], most: np.ndarray, busy: int):
        self.texts, self.of, self.lines, self.most, self.busy = texts, of, lines, most, busy
        (self.codes, self.long), (self.line, self.n) = _flat(texts), _flat(lines)
        self.at, self.start = np.cumsum(self.long) - self.long, np.cumsum(self.n) - self.n
        self.half = most // 2
        self.shift = np.int64(int(self.long.max() + 2 * self.n.max() + 2).bit_length())

    def told(self) -> np.ndarray:
        out = np.zeros(len(self.lines), bool)
        pieces = np.maximum(self.most + 1, self.n // 4)
        size = np.minimum(4, self.n // pieces)
        text, place = _spread(self.long)
        turn = np.arange(len(self.texts), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)  # a gram is sought in its own text
        wide, codes = self.codes.astype(np.uint64), self.line.astype(np.uint64)
        for s in np.unique(size).tolist():
            which = np.flatnonzero(size == s)
            grams = _grams(wide, s)
            whole = np.flatnonzero(place[: len(grams)] + s <= self.long[text[: len(grams)]])
            grams = grams[whole] + turn[text[whole]]
            order = np.argsort(grams)
            grams, order = grams[order], whole[order]
            run, k = _spread(pieces[which])
            line = which[run]
            start = k * self.n[line] // pieces[line]
            key = _grams(codes, s)[self.start[line] + start] + turn[self.of[line]]
            by = np.argsort(key)  # neighbours are found near each other
            lo, hi = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            lo[by], hi[by] = np.searchsorted(grams, key[by], "left"), np.searchsorted(grams, key[by], "right")
            many = hi - lo
            met = np.bincount(run, many, minlength=len(which)).astype(np.int64)
            for i in which[met > self.busy].tolist():  # few different pieces: measuring everywhere is cheaper
                out[i] = has_window(self.texts[self.of[i]], self.lines[i], int(self.most[i]))
            many[(met > self.busy)[run]] = 0
            edge = np.concatenate([[0], np.cumsum(pieces[which])])
            for part in _chunks(np.where(met > self.busy, 0, met), self.busy):
                now = slice(edge[part[0]], edge[part[-1] + 1])
                rep, inside = _spread(many[now])
                begin = order[inside + lo[now][rep]] - (self.at[self.of[line[now]]] + start[now])[rep]
                out |= self._near(line[now][rep], begin, pieces - self.most)
        return out

    def _near(self, line: np.ndarray, begin: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Lines with a window, told by where their pieces would have it begin: ``need`` of these places have to lie close together."""
        low = int(self.n.max())
        both = np.sort(line << self.shift | begin + low)
        line, begin = both >> self.shift, (both & (1 << self.shift) - 1) - low
        owner, guess = self._agreed(line, begin)
        last = np.arange(len(line)) + need[line] - 1
        first = np.flatnonzero(last < np.searchsorted(line, line, "right"))
        first, last, line = begin[first], begin[last[first]], line[first]
        half = self.half[line]
        low, high = np.maximum(last - half, 0), np.minimum(first + half, (self.long[self.of] - self.n)[line])
        able = (last - first <= 2 * half) & (low <= high)
        line, low, high = line[able], low[able], high[able]
        out = np.zeros(len(self.lines), bool)
        for part in _chunks(self.n[owner], self.busy):
            now = part[~out[owner[part]]]
            if len(now):
                own = owner[now]
                run, i = _spread(self.n[own])
                other = self.codes[(self.at[self.of[own]] + guess[now])[run] + i] != self.line[self.start[own][run] + i]
                n = self.n[own]
                out[own[np.add.reduceat(other, np.cumsum(n) - n, dtype=np.int64) <= self.most[own]]] = True
        left = ~out[line]
        line, low, high = line[left], low[left], high[left]
        if not len(line):
            return out
        fresh = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (low[1:] > high[:-1] + self.n[line[1:]])]))
        out[self._measured(line[fresh], low[fresh], high[np.append(fresh[1:], len(high)) - 1])] = True
        return out

    def _agreed(self, line: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line (ascending, as ``begin`` is for each), the place where most of its pieces would have a window begin."""
        inside = (begin >= 0) & (begin <= (self.long[self.of] - self.n)[line])
        line, begin = line[inside], begin[inside]
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (begin[1:] != begin[:-1])])) if len(line) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(line)))
        order = np.lexsort((-many, line[first]))
        own = line[first[order]]
        best = order[np.flatnonzero(np.diff(own, prepend=-1))]
        return line[first[best]], begin[first[best]]

    def _measured(self, line: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Lines with a window that begins in a span from ``low`` to ``high``."""
        found: list[int] = []
        parts = (high - low) // self.n[line] + 1  # a long span is measured as several of about the line's length and its window's
        run, k = _spread(parts)
        first, wide = low[run], (high - low + 1)[run]
        line, low, high = line[run], first + k * wide // parts[run], first + (k + 1) * wide // parts[run] - 1
        size, words = high - low + self.n[line], (self.n[line] + 63) // 64
        ends = [np.zeros(0, np.int64)] * 3
        left = np.argsort(words, kind="stable")
        while len(left):
            held = np.arange(1, len(left) + 1)
            fits = (held * words[left] <= _WORDS) & (held * np.maximum.accumulate(size[left]) <= _PLACES) & (words[left] <= words[left[0]] * 5 // 4)
            many = max(1, len(left) if fits.all() else int(fits.argmin()))
            now, left = left[:many], left[many:]
            own, deep = line[now], int(words[now[-1]])
            if 25 + 0.012 * many * deep > many * (1.5 + 0.045 * deep):  # as in _told
                begin = self.at[self.of[own]] + low[now]
                found += [i for i, b, k in zip(own.tolist(), begin.tolist(), size[now].tolist()) if has_window(self._text(b, k), self.lines[i], int(self.most[i]))]
                continue
            begin = self.at[self.of[own]] + low[now]
            span, column, apart = _ends([self.codes[b : b + k] for b, k in zip(begin, size[now])], [self.line[b : b + k] for b, k in zip(self.start[own], self.n[own])], self.most[own])
            begin = low[now][span] + column + 1 - self.n[own[span]]
            ends = [np.concatenate(x) for x in zip(ends, (own[span], begin, apart))]
        order = np.lexsort((ends[2], ends[0]))  # the nearest end of each line first
        line, begin = ends[0][order], ends[1][order]
        turns = 1
        while len(line):
            start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            rank = np.arange(len(line)) - np.repeat(start, np.diff(np.append(start, len(line))))
            now = np.flatnonzero(rank < turns)
            own = line[now]
            over = distances([self._text(b, k) for b, k in zip((self.at[self.of[own]] + begin[now]).tolist(), self.n[own].tolist())], [self.lines[i] for i in own.tolist()]) - self.most[own]
            found += own[over <= 0].tolist()
            keep = (rank >= turns) & ~np.isin(line, own[over <= 0])
            turn, place = np.searchsorted(line[start], line), rank[now]
            for k in range(turns):  # a window one place on is at most two edits nearer
                there = place == k
                middle, reach = np.full(len(start), -1), np.full(len(start), -1)
                which = np.searchsorted(line[start], own[there])
                middle[which], reach[which] = begin[now[there]], (over[there] - 1) // 2
                keep &= abs(begin - middle[turn]) > reach[turn]
            line, begin = line[keep], begin[keep]
            turns = min(16, 2 * turns)
        return np.array(found, np.int64)

    def _text(self, begin: int, size: int) -> str:
        return self.codes[begin : begin + size].tobytes().decode("utf-32-le", "surrogatepass")


def _ends(text: list[np.ndarray], pattern: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pair, column, distance)`` of the columns of each text, from the pattern's length on, where something that ends there is within ``most`` edits of
    its pattern: the table of ``_columns`` from any place before, all words of all pairs a step (as ``_stepped``).

    Patterns end with their last word; the rows above one match everything and stay 0, so that all are read at the same row.
    """
    n, m = np.array([len(t) for t in text]), np.array([len(p) for p in pattern])
    deep, pairs = int((m.max() + 63) // 64), len(text)
    size, above = deep * pairs, deep * 64 - m
    letters, place = _dense(np.concatenate([*pattern, *text]))
    place, known = place[: m.sum()], place[m.sum() :]
    if (letters + 1) * size > _MASKS and pairs > 1:
        half = pairs // 2
        a, b = _ends(text[:half], pattern[:half], most[:half]), _ends(text[half:], pattern[half:], most[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    one = np.uint64(1)
    free = np.clip(above - 64 * np.arange(deep)[:, None], 0, 64)
    open_ = np.where(free == 64, ~np.uint64(0), (one << (free % 64).astype(np.uint64)) - one)  # rows above the pattern
    masks = np.tile(open_.ravel(), letters + 1)  # the last row: behind a text's end
    owner, bit = _spread(m)
    bit += above[owner]
    np.add.at(masks, place * size + bit // 64 * pairs + owner, one << (bit % 64).astype(np.uint64))
    long = int(n.max())
    steps = long + deep - 1
    columns = np.full((steps, pairs), letters * size)
    owner, i = _spread(n)
    columns[i, owner] = known * size
    every = np.arange(size).reshape(deep, pairs)
    up, down = ~open_, np.zeros((deep, pairs), np.uint64)
    # what each word hears from the one above it; row 0 is the table's edge, where nothing rises
    more, less = np.zeros((deep + 1, pairs), np.uint64), np.zeros((deep + 1, pairs), np.uint64)
    turns = np.empty((long, pairs), np.int8)
    rises, falls, top = more[deep].view(np.int64), less[deep].view(np.int64), np.uint64(63)
    space = [np.empty((deep, pairs), t) for t in (np.int64, *[np.uint64] * 5)]
    for step in range(steps):
        hi, lo = min(deep, step + 1), max(0, step - long + 1)
        part = slice(lo, hi)
        at, eq, side, sums, gain, loss = (s[: hi - lo] for s in space)
        u, d = up[part], down[part]
        np.add(columns[step - hi + 1 : step - lo + 1][::-1], every[part], out=at)
        masks.take(at, out=eq, mode="clip")
        np.bitwise_or(eq, d, out=side)
        np.bitwise_or(eq, less[part], out=eq)
        np.bitwise_and(eq, u, out=sums)
        np.add(sums, u, out=sums)
        np.bitwise_xor(sums, u, out=sums)
        np.bitwise_or(sums, eq, out=sums)
        np.bitwise_and(u, sums, out=loss)
        np.bitwise_or(sums, u, out=gain)
        np.invert(gain, out=gain)
        np.bitwise_or(gain, d, out=gain)
        np.left_shift(gain, one, out=eq)
        np.bitwise_or(eq, more[part], out=eq)
        np.left_shift(loss, one, out=sums)
        np.bitwise_or(sums, less[part], out=sums)
        np.right_shift(gain, top, out=more[lo + 1 : hi + 1])
        np.right_shift(loss, top, out=less[lo + 1 : hi + 1])
        np.bitwise_or(side, eq, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, sums, out=u)
        np.bitwise_and(eq, side, out=d)
        if hi == deep:
            np.subtract(rises, falls, out=turns[step - deep + 1], casting="unsafe")
    now = m + np.cumsum(turns, axis=0, dtype=np.int32)
    column, pair = np.nonzero((now <= most) & (np.arange(long)[:, None] >= m - 1) & (np.arange(long)[:, None] < n))
    return pair, column, now[column, pair]
