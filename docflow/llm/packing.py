"""Hierarchical multi-length packing.

Documents are cut into windows of the longest tier; what remains of each goes to the shortest tier that holds it.  Tiers
are packed from long to short: a window starts with its tier's longest piece, its gap takes the longest pieces of shorter
tiers that fit, and a last gap is closed by cutting a longer piece.  What is left when a block of documents runs out falls
into a ladder of powers of two, so that no window needs padding.  Windows of a tier are dealt into step groups of equal
token counts, in snake order of their attention cost.

Blocks are runs of rows of one partition, of ``block_tokens`` tokens or one document; sequence ids are
``partition << 40 | number``.  Null texts are empty documents: only the end token.  Repeated rows are packed
once for each row, also those with null ids.  Extra columns are ignored, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, frugal, returned
from .tokens import Places

# begins with the stop itself, so that the search does not halt at every letter
_STOP = re.compile(rb"[.,](?=[\x20\x09-\x0D])(?<=[a-z0-9].)")
TIERS = (2048, 1024, 512, 256)
FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"


@lru_cache(1)
def _tokenizer(path: str):
    """One for each worker process; what an Encoder remembers of texts goes with its task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts.  This tokenizer drops white space, so words are encoded once and remembered, up to a bound of words and
    one of their bytes (16 for each word of the bound).

    A word that ends in a full stop or comma behind an ASCII letter or digit is two (always a border of the tokenizer's own
    pre-tokens), and any other word is cut behind its leading letters where an ASCII character follows (another such
    border, unless the last letter's lower case is more than letters); such parts, in lower case, are remembered too.  Remembered ids lie in one flat array, so that texts are put
    together by gathering.
    """

    def __init__(self, path: str, end: int = 1, bound: int = 250_000):
        self.tokenizer, self.end, self.bound = _tokenizer(path), end, bound
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = Places({b"": 0})  # place 0 is the end token; no word is empty
        self.flat, self.size, self.start = [np.array([self.end], "<u4")], [np.array([1], np.int64)], [np.array([0], np.int64)]
        self.held, self.letters = 1, 0
        self.asked = np.zeros(1, np.int64)

    def _thin(self) -> None:
        """Forget the words that were asked for only once since they were learned or kept, or all where that leaves more than half of a bound."""
        asked = np.zeros(len(self.known), np.int64)
        asked[: len(self.asked)] = self.asked
        asked[0] = 2  # the end token
        at = np.flatnonzero(asked > 1)
        words = list(self.known)
        kept = [words[i] for i in at.tolist()]
        letters = sum(map(len, kept))
        if 2 * len(kept) > self.bound or letters > 8 * self.bound:
            self._forget()
            return
        flat, size, start = (held[0] for held in (self.flat, self.size, self.start))
        size, start = size[at], start[at]
        ends = np.cumsum(size)
        self.flat = [flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]]
        self.size, self.start, self.held, self.letters = [size], [ends - size], int(ends[-1]), letters
        self.known, self.asked = Places(dict(zip(kept, range(len(kept))))), np.zeros(len(kept), np.int64)

    @staticmethod
    def _words(text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if b"<|" in raw:  # a special token is matched as written
            return raw.split()
        return _STOP.sub(rb" \g<0>", raw.translate(LOWER)).split()

    @staticmethod
    def _cut(w: str) -> tuple[str, ...]:
        if "<|" in w:
            return (w,)
        if len(w) > 1 and w[-1] in ".," and w[-2].isascii() and w[-2].isalnum():
            return (*Encoder._cut(w[:-1]), w[-1])
        low = w.lower() if w.isascii() else w
        n = 0
        while n < len(low) and low[n].isalpha():
            n += 1
        # a letter that is more than letters in lower case (U+0130) belongs to what follows it
        return (low[:n], low[n:]) if 0 < n < len(low) and low[n].isascii() and low[n - 1].lower().isalpha() else (low,)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember ids of words that follow each other; their starts."""
        start = np.cumsum(sizes) - sizes + self.held
        self.flat.append(ids.astype("<u4"))
        self.held += len(ids)
        return start

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new words: letters, and letters before a stop, in few calls that are cut behind closing ids; others by their parts."""
        size, start = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        words = [w.decode("utf-8", "surrogatepass") for w in fresh]
        many = np.fromiter(map(str.isalpha, words), np.int64, len(words))
        for i in np.flatnonzero(many == 0).tolist():
            w = words[i]
            if w[-1] in ".," and w[-2:-1].isascii() and w[:-1].isalpha():
                words[i], many[i] = f"{w[:-1]} {w[-1]}", 2
        plain = np.flatnonzero(many)
        done = np.zeros(len(fresh), bool)
        for s in range(0, len(plain), 20_000):
            at = plain[s : s + 20_000]
            some = words if len(at) == len(words) else [words[i] for i in at.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(many[at]) - 1
            if len(ends) == last[-1] + 1:
                sizes = np.diff(ends[last], prepend=0)
                size[at], start[at], done[at] = sizes, self._keep(ids, sizes), True
        left = np.flatnonzero(~done)
        cut = [self._cut(fresh[i].decode("utf-8", "surrogatepass")) for i in left.tolist()]
        new = list({p for ps in cut for p in ps if p not in self.parts})
        for s in range(0, len(new), 20_000):
            some = new[s : s + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.parts[p] = e.ids
        ids: list[int] = []
        sizes = []
        for ps in cut:
            before = len(ids)
            for p in ps:
                ids += self.parts[p]
            sizes.append(len(ids) - before)
        sizes = np.array(sizes, np.int64)
        size[left], start[left] = sizes, self._keep(np.array(ids, np.int64), sizes)
        self.size.append(size)
        self.start.append(start)
        for p in [p for p in new if len(p) > 256]:
            del self.parts[p]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.bound or self.letters > 16 * self.bound:
            self._thin()
        if len(self.parts) > self.bound:
            self.parts.clear()
        place = self.known.__getitem__
        at: list[int] = []
        for t in texts:
            at += map(place, self._words(t))
            at.append(0)
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            self.letters += sum(map(len, fresh))
            self._learn(fresh)
        for held in (self.flat, self.size, self.start):
            if len(held) > 1:
                held[:] = [np.concatenate(held)]
        at = np.array(at, np.int64)
        asked = np.bincount(at, minlength=len(self.known))
        asked[: len(self.asked)] += self.asked
        self.asked = asked
        size, start = self.size[0][at], self.start[0][at]
        ends = np.cumsum(size)
        whole = self.flat[0][np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = ends[np.flatnonzero(at == 0)]
        return np.split(whole, stops[:-1])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows ``(tier, [(document, start, length), ...])`` that together hold every token of every document once."""
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    shelves: list[list[tuple[int, int]]] = [[] for _ in range(top)]
    full = 0  # bit n is set while shelf n has pieces

    def put(doc: int, start: int, n: int) -> None:
        nonlocal full
        shelves[n].append((doc, start))
        full |= 1 << n

    def take(n: int) -> tuple[int, int, int]:
        nonlocal full
        doc, start = shelves[n].pop()
        if not shelves[n]:
            full &= ~(1 << n)
        return doc, start, n

    for doc in range(len(lengths) - 1, -1, -1):
        whole = lengths[doc] // top
        windows += [(top, [(doc, i * top, top)]) for i in range(whole)]
        if lengths[doc] % top:
            put(doc, whole * top, lengths[doc] % top)
    for tier in tiers:
        least = next((t for t in tiers if t < tier), 0)
        while full.bit_length() - 1 > least:
            gap = tier
            pieces = []
            while gap and full:
                if fits := full & ((1 << (gap + 1)) - 1):
                    piece = take(fits.bit_length() - 1)
                else:
                    doc, start, n = take(((full >> gap) & -(full >> gap)).bit_length() - 1 + gap)
                    put(doc, start + gap, n - gap)
                    piece = doc, start, gap
                pieces.append(piece)
                gap -= piece[2]
            left = tier - gap
            if not gap:
                windows.append((tier, pieces))
                continue
            pieces.reverse()
            while left:  # the ladder
                rung = 1 << (left.bit_length() - 1)
                held, need = [], rung
                while need:
                    doc, start, n = pieces.pop()
                    if n > need:
                        pieces.append((doc, start + need, n - need))
                        n = need
                    held.append((doc, start, n))
                    need -= n
                windows.append((rung, held))
                left -= rung
    return windows


def step_groups(windows: list, step_tokens: int) -> list[int]:
    """A group number per window: windows of one tier, equally many tokens a group, attention costs balanced."""
    groups, base = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = sorted((i for i, (t, _) in enumerate(windows) if t == tier), key=lambda i: (-sum(p[2] ** 2 for p in windows[i][1]), i))
        many = max(1, -(-len(own) * tier // step_tokens))
        for k, i in enumerate(own):
            turn, at = divmod(k, many)
            groups[i] = base + (at if turn % 2 == 0 else many - 1 - at)
        base += many
    return groups


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, block_tokens: int = 1_000_000, step_tokens: int = 32_768) -> DataFrame:
    """One row per piece: the document's id and FIELDS.  One pass over the partitions, no shuffle."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        frugal()
        encode, part = Encoder(tokenizer), TaskContext.get().partitionId()
        keys, ids, held, sequence, group = [], [], 0, 0, 0

        def out():
            nonlocal sequence, group
            windows = pack([len(x) for x in ids], tiers)
            groups = step_groups(windows, step_tokens)
            rows: list[list] = [[] for _ in range(1 + len(names))]
            for w, (tier, pieces) in enumerate(windows):
                offset = 0
                for doc, start, n in pieces:
                    crc = zlib.crc32(ids[doc][start : start + n])
                    for col, v in zip(rows, (keys[doc], start, n, crc, len(ids[doc]), part << 40 | sequence + w, offset, tier, part << 40 | group + groups[w])):
                        col.append(v)
                    offset += n
            sequence += len(windows)
            group += max(groups, default=-1) + 1
            cols = [pa.array(rows[0], key), *(pa.array(r, pa.int64()) for r in rows[1:])]
            table = pa.Table.from_arrays(cols, names=["doc_id", *names])
            yield from table.to_batches(max_chunksize=50_000)

        key = None
        for b in batches:
            key = b.schema.field(0).type
            for i in range(0, b.num_rows, 500):
                part_b = b.slice(i, 500)
                fresh = encode(part_b.column(1).to_pylist())
                for k, x in zip(part_b.column(0).to_pylist(), fresh):
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
                    if held >= block_tokens:
                        yield from out()
                        keys.clear(), ids.clear()
                        held = 0
        if ids:
            yield from out()
        keys.clear(), ids.clear()
        del encode
        returned()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {FIELDS}")
