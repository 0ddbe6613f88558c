"""White-space tokens as 64-bit hashes, and hashes of n-grams, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import LOWER

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Places(dict):
    """Numbers words as they are first asked for."""

    def __init__(self, known: dict[bytes, int] | None = None):
        super().__init__(known or {})
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Hasher:
    """Hashes of texts' lower-cased (A-Z) words; remembers words, up to a bound of words and one of their bytes (16 for each word of the bound)."""

    def __init__(self, bound: int = 200_000):
        self.bound = bound
        self.known, self.letters = Places(), 0
        self.table = np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts, one after the other, and the number of words of each text."""
        if len(self.known) > self.bound or self.letters > 16 * self.bound:
            self.known, self.letters = Places(), 0
            self.table = np.zeros(0, np.uint64)
        place = self.known.__getitem__
        at: list[int] = []
        many = []
        for t in texts:
            before = len(at)
            at += map(place, (t or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
            many.append(len(at) - before)
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            self.letters += sum(map(len, fresh))
            self.table = np.concatenate([self.table, np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], np.uint64)])
        return self.table[np.array(at, np.int64)] if at else np.zeros(0, np.uint64), np.array(many, np.int64)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the n-gram whose first part hashes to ``left`` and last word to ``right``."""
    x = (left ^ (left >> np.uint64(29))) * _A + right * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(31))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and for each key its place among them."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return sorted_keys[fresh], place


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after a byte that says how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    if width in (1, 2, 4, 8):
        return bytes([width]) + x.astype(f"<u{width}").tobytes()
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(raw: bytes) -> np.ndarray:
    width = raw[0]
    if width in (1, 2, 4, 8):
        return np.frombuffer(raw, f"<u{width}", offset=1).astype(np.uint64)
    full = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return full.view("<u8").ravel()


def gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, the first key after them."""
    return narrow(np.diff(keys)) + (keys[0].tobytes() if len(keys) else b"")


def ungapped(raw: bytes) -> np.ndarray:
    if len(raw) == 1:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw[-8:], "<u8"), widened(raw[:-8])]), dtype=np.uint64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    start = runs(keys)
    return keys[start], np.diff(np.append(start, len(keys)))


# A number for each byte, 0 for white space; bytes that are hashed together; a step, and its inverse modulo 2 ** 64.
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[[9, 10, 11, 12, 13, 32]] = 0
_SPACE, _TOGETHER, _STEP = re.compile(rb"[\t-\r ]"), 1 << 20, 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """What ``Hasher`` gives (other numbers), without a look-up for each word: a word's hash is the sum of its bytes' numbers times powers of a step,
    the difference of two running sums."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    every = b" ".join(raw) + b" "
    words, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    power, back = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    done = 0
    while done < len(every):
        cut = _SPACE.search(every, min(done + _TOGETHER, len(every) - 1)).end()
        flat = np.frombuffer(every, np.uint8, cut - done, done)
        if len(power) < len(flat):
            power, back = (np.cumprod(np.full(len(flat), x, np.uint64)) for x in (_STEP, _BACK))
        letters = _LETTER[flat]
        at = np.flatnonzero(letters == 0)
        begin = np.concatenate([[0], at[:-1] + 1])
        real = at > begin
        at, begin = at[real], begin[real]
        sums = np.cumsum(letters * power[: len(flat)], dtype=np.uint64)
        x = (sums[at] - np.where(begin > 0, sums[begin - 1], np.uint64(0))) * back[begin]
        x = (x ^ (x >> np.uint64(31))) * _B
        words.append(x ^ (x >> np.uint64(29)))
        ends.append(at + done)
        done = cut
    return np.concatenate(words), np.diff(np.searchsorted(np.concatenate(ends), np.cumsum(size)), prepend=0)
