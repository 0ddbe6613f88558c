"""Deleted interpolation: an n-gram model whose orders are mixed by how often the context was seen.

Maximum-likelihood estimates of every order come from the counts of all training rows.  The weights of a context-frequency
bucket (powers of two) are learned by expectation-maximisation on one fold of the training rows, whose counts are deleted
from the estimates meanwhile.

How it runs: rows are dealt into blocks of bounded size, each within one fold.  Each block gathers its texts and sends its n-grams with
their counts, as one array a bucket, to buckets of n-gram hashes (arrays of what each task holds of a block would be as many as tasks x
blocks x buckets).  A bucket adds up and tells each block, by a bit for
each of its n-grams, which totals differ from the block's own counts, and those totals.  A block then scores its texts
with its own counts and the totals told.  So what moves is the distinct n-grams of blocks, nothing is broadcast, and no
group is larger than a block or a bucket.

Single words go by hashes of 64 bits, longer n-grams by as many bits (48 at most) as keep a chance meeting rarer than one in 4096.  Null texts count as empty: one token, the end.  Rows with a
null id belong to the fold of the text ``null``.  Repeated rows each count and each get a score.  With no training row the
model is uniform.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, frugal, returned, stored
from .tokens import counted, gaps, hashed, mixed, narrow, numbered, runs, ungapped, widened

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))  # words hold no spaces
BUCKET_KEYS, STEPS, LEVELS = 2_000_000, 4, 40
SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
FAMILIES = ("one", "more")  # single words; longer n-grams
_SENT = "bucket bigint, block bigint, one binary, one_n binary, more binary, more_n binary"
_TOLD = "block bigint, bucket bigint, v bigint, n bigint, nd bigint, one binary, one_t binary, one_d binary, more binary, more_t binary, more_d binary"


class Block:
    """The n-grams of texts: the distinct keys of each family, sorted, and for each order the place of every token's n-gram (unless ``placed`` is false)."""

    def __init__(self, texts: list[str | None], order: int, width: int, placed: bool = True):
        self.width = {"one": 64, "more": width}
        words, many = hashed(texts)
        pads = max(order - 1, 1)
        size = many + pads + 1
        start = np.cumsum(size) - size
        stream = np.full(int(size.sum()), START, np.uint64)
        stream[np.repeat(start + pads - (np.cumsum(many) - many), many) + np.arange(len(words))] = words
        stream[start + size - 1] = END
        real = np.ones(len(stream), bool)
        for k in range(pads):
            real[start + k] = False
        inner = real.copy()
        inner[start + pads - 1] = True  # the last pad stands for the empty context
        self.tokens, self.at, self.order = many + 1, np.flatnonzero(real), order
        self.places, grams, longer = [], stream, []
        for k in range(1, order + 1):
            if k > 1:
                grams = np.concatenate([grams[:1], mixed(grams[:-1], stream[1:])])
            where = np.flatnonzero(inner if k < order or k == 1 else real)
            if k == 1 and not placed:
                self.one, self.one_n = counted(grams[where])
                continue
            if k == 1:
                self.one, place = numbered(grams[where])
            else:
                longer.append(grams[where] >> np.uint64(64 - width))
                place = where
            if not placed:
                continue
            full = np.full(len(stream), -1, np.int32)
            full[where] = place
            self.places.append(full)
        if not placed:
            self.more, self.more_n = counted(np.concatenate(longer) if longer else np.zeros(0, np.uint64))
            return
        self.more, place = numbered(np.concatenate(longer) if longer else np.zeros(0, np.uint64))
        done = 0
        for k in range(2, order + 1):
            full = self.places[k - 1]
            where = full >= 0
            here = int(where.sum())
            full[where] = place[done : done + here]
            done += here
        self.one_n = np.bincount(self.places[0][self.places[0] >= 0], minlength=len(self.one))
        self.more_n = np.bincount(place, minlength=len(self.more))

    def buckets(self, family: str, bits: int) -> np.ndarray:
        """The bucket of each key: its first bits."""
        return (getattr(self, family) >> np.uint64(self.width[family] - bits)).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in full."""
    low = np.minimum(x, 255).astype(np.uint8)
    return len(low).to_bytes(4, "little") + low.tobytes() + narrow(x[low == 255])


def _wide(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.uint64)
    out[out == 255] = widened(raw[4 + n :])
    return out


def score(docs: DataFrame, order: int = 2, folds: int = 7, held_out: int = 2, deleted: int = 3, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out and SCORES; learned from the rows whose crc32(id as text) mod ``folds`` is not ``held_out``.

    ``base_score`` is add-one unigram, ``score`` the interpolated model; both log10.  The expectation-maximisation of a bucket of
    contexts runs on bins of its estimates, (LEVELS * STEPS + 1) ** order of 16 bytes at most, in one task a bucket; the
    driver sees the weights alone.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), fold(F.col(id_col), folds).cast("int").alias("fold"))
    total = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-total // (folds * block_bytes)))
    d = d.withColumn("block", (F.col("fold") + folds * F.pmod(F.xxhash64("doc_id", "text"), F.lit(many))).cast("long"))
    keys = max(1, order * total / 6)
    bits = min(32, max(6, int(np.ceil(np.log2(keys / BUCKET_KEYS)))))
    width = min(64, max(32, int(np.ceil(np.log2(keys))) + 12))

    def send(t: pa.Table) -> pa.Table:
        frugal()
        number = t.column("block")[0].as_py()
        b = Block(t.column("text").to_pylist(), order, width, placed=False)
        own = {f: b.buckets(f, bits) for f in FAMILIES}
        used = np.unique(np.concatenate([x[runs(x)] for x in own.values()]))
        edge = {f: list(zip(np.searchsorted(own[f], used, "left").tolist(), np.searchsorted(own[f], used, "right").tolist())) for f in FAMILIES}
        cut = lambda x, f, g: pa.array([g(x[i:j]) for i, j in edge[f]], pa.binary())
        out = pa.table({"bucket": used, "block": pa.array([number] * len(used), pa.int64()), "one": cut(b.one, "one", gaps), "one_n": cut(b.one_n, "one", _small), "more": cut(b.more, "more", gaps), "more_n": cut(b.more_n, "more", _small)})
        del b, own
        returned()
        return out

    def add(t: pa.Table) -> pa.Table:
        blocks, back = np.unique(t.column("block").to_numpy(), return_inverse=True)
        bucket = t.column("bucket")[0].as_py()
        told = {int(b): [int(b), bucket, None, None, None] for b in blocks}
        facts = [-1, bucket, 0, 0, 0] + [None] * 6
        for family in FAMILIES:
            keys = [ungapped(x) for x in t.column(family).to_pylist()]
            counts = np.concatenate([_wide(x) for x in t.column(f"{family}_n").to_pylist()]).astype(np.int64)
            pair, own = _summed(np.concatenate(keys), np.repeat(back.astype(np.uint64), [len(k) for k in keys]), counts, (64 if family == "one" else width) - bits)
            every, key, block = pair
            own_t, own_d = np.where(blocks[block] % folds != held_out, own, 0), np.where(blocks[block] % folds == deleted, own, 0)
            first = runs(key)
            all_t, all_d = np.add.reduceat(own_t, first), np.add.reduceat(own_d, first)
            if family == "one":
                words = every != START
                facts[2:5] = [int((words & (all_t > 0)).sum()), int(all_t[words].sum()), int(all_d[words].sum())]
            tell = (all_t[key] != own_t) | ((all_d[key] != own_d) & (blocks[block] % folds == deleted))
            order_ = np.argsort(block.astype(np.uint16) if len(blocks) < 1 << 16 else block, kind="stable")  # by block, then key
            edge = np.searchsorted(block[order_], np.arange(len(blocks) + 1))
            for i, b in enumerate(blocks.tolist()):
                e = order_[edge[i] : edge[i + 1]]
                k = key[e[tell[e]]]
                told[b] += [np.packbits(tell[e]).tobytes(), _small(all_t[k]), _small(all_d[k]) if b % folds == deleted else None]
        cols = list(zip(facts, *told.values()))
        names = [x.split()[0] for x in _TOLD.split(", ")]
        return pa.table({n: pa.array(c, pa.int64() if i < 5 else pa.binary()) for i, (n, c) in enumerate(zip(names, cols))})

    sent = d.select("block", "text").groupBy("block").applyInArrow(send, _SENT)
    back = stored(sent.groupBy("bucket").applyInArrow(add, _TOLD), "lm-counts")
    v, n, nd = (x or 0 for x in back.where("block = -1").agg(F.sum("v"), F.sum("n"), F.sum("nd")).first())
    slices = back.where("block >= 0").drop("v", "n", "nd")

    def bins(texts: pa.Table, counts: pa.Table) -> pa.Table:
        frugal()
        if not texts.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        ps, seen = _Counts(texts, counts, order, folds, held_out, deleted, bits, width).estimates(n - nd, v, without_deleted=True)
        code = _bucket(seen)
        for p in ps[1:]:
            q = np.where(p > 0, np.clip(np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), 0, LEVELS * STEPS - 1), -1).astype(np.int64)
            code = code * (LEVELS * STEPS + 1) + q + 1
        code, times = np.unique(code, return_counts=True)
        own = (LEVELS * STEPS + 1) ** order
        returned()
        return pa.table({"bucket": pa.array(code // own), "code": pa.array(code % own), "n": pa.array(times, pa.int64())})

    def learn(t: pa.Table) -> pa.Table:
        w = maximised(t.column("code").to_numpy(), t.column("n").to_numpy().astype(float), order, 1 / (v + 1))
        return pa.table({"bucket": t.column("bucket")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    held = d.where(F.col("fold") == deleted).select("block", "text").groupBy("block")
    got = held.cogroup(slices.where(F.pmod("block", F.lit(folds)) == deleted).groupBy("block")).applyInArrow(bins, "bucket bigint, code bigint, n bigint")
    weights = np.full((64, order + 1), 1 / (order + 1))  # a bucket without data stays even
    for r in got.groupBy("bucket", "code").agg(F.sum("n").alias("n")).groupBy("bucket").applyInArrow(learn, "bucket bigint, w array<double>").collect():
        weights[r.bucket] = r.w
    key = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, held_out boolean, {SCORES}"

    def judge(texts: pa.Table, counts: pa.Table) -> pa.Table:
        frugal()
        c = _Counts(texts, counts, order, folds, held_out, deleted, bits, width)
        ps, seen = c.estimates(n, v)
        w = weights[_bucket(seen)]
        p = sum(w[:, k] * x for k, x in enumerate(ps))
        base = np.log10((c.count[0] + 1) / (n + v + 1))
        at = np.cumsum(c.block.tokens) - c.block.tokens
        add_up = lambda x: np.add.reduceat(x, at) if len(at) else x
        returned()
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array([x == held_out for x in texts.column("fold").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(c.block.tokens, pa.int64()), "n_known": pa.array(add_up((c.count[0] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(at), n), pa.int64()), "base_score": pa.array(add_up(base), pa.float64()), "score": pa.array(add_up(np.log10(p)), pa.float64()),
        })

    return d.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(judge, schema)


def _summed(keys: np.ndarray, block: np.ndarray, counts: np.ndarray, span: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """``(distinct keys, (key number, block) of each pair in order), counts`` summed for each pair of key and block.

    A block's rows come from several tasks.  Keys agree in all but their last ``span`` bits.
    """
    many = int(block.max()).bit_length() if len(block) else 0
    if span + many <= 64:
        both = keys << np.uint64(many) | block  # bits that all keys share go lost
        order = np.argsort(both)
        start = runs(both[order])
        keys, block = keys[order[start]], block[order[start]]
    else:
        order = np.lexsort((block, keys))
        start = np.flatnonzero(np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(block[order]) != 0)])) if len(keys) else np.zeros(0, np.int64)
        keys, block = keys[order[start]], block[order[start]]
    own = np.add.reduceat(counts[order], start) if len(start) else counts
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return (keys[first], np.cumsum(first) - 1, block.astype(np.int64)), own


class _Counts:
    """A block with the totals of its n-grams: its own counts where nothing was told."""

    def __init__(self, texts: pa.Table, counts: pa.Table, order: int, folds: int, held_out: int, deleted: int, bits: int, width: int):
        self.block = b = Block(texts.column("text").to_pylist(), order, width)
        self.order = order
        mine = texts.column("block")[0].as_py() % folds if texts.num_rows else held_out
        total, gone = {}, {}
        for family in FAMILIES:
            own = getattr(b, f"{family}_n")
            total[family], gone[family] = (own.copy() if mine != held_out else own * 0), (own.copy() if mine == deleted else own * 0)
            place, buckets = b.buckets(family, bits), counts.column("bucket").to_numpy()
            start, end = np.searchsorted(place, buckets, "left").tolist(), np.searchsorted(place, buckets, "right").tolist()
            for i, j, mask, t, d in zip(start, end, *(counts.column(x).to_pylist() for x in (family, f"{family}_t", f"{family}_d"))):
                at = i + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=j - i))
                total[family][at] = _wide(t)
                if d is not None:
                    gone[family][at] = _wide(d)
        here, before = [p[b.at] for p in b.places], [p[b.at - 1] for p in b.places]
        name = lambda k: FAMILIES[k > 1]
        self.count = [total[name(k)][here[k - 1]] for k in range(1, order + 1)]
        self.gone = [gone[name(k)][here[k - 1]] for k in range(1, order + 1)]
        self.context = [total[name(k - 1)][before[k - 2]] for k in range(2, order + 1)]
        self.context_gone = [gone[name(k - 1)][before[k - 2]] for k in range(2, order + 1)]

    def estimates(self, n: int, v: int, without_deleted: bool = False):
        """Per order, from 0 (uniform), the estimate at each token; and how often the longest context was seen."""
        c = [x - y for x, y in zip(self.count, self.gone)] if without_deleted else self.count
        h = [x - y for x, y in zip(self.context, self.context_gone)] if without_deleted else self.context
        ps = [np.full(len(c[0]), 1 / (v + 1)), c[0] / max(n, 1)]
        for k in range(2, self.order + 1):
            ps.append(np.where(h[k - 2] > 0, c[k - 1] / np.maximum(h[k - 2], 1), 0.0))
        return ps, (h[-1] if h else np.full(len(c[0]), n))


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0).astype(np.int64)


def maximised(code: np.ndarray, n: np.ndarray, order: int, uniform: float, rounds: int = 40) -> np.ndarray:
    """The order + 1 mixture weights of one bucket from its binned held-out estimates.

    Every order keeps a weight of at least 1e-6, so that no text has probability 0.
    """
    ps = []
    for _ in range(order):
        q = code % (LEVELS * STEPS + 1) - 1
        ps.append(np.where(q < 0, 0.0, 2.0 ** (-q / STEPS)))
        code = code // (LEVELS * STEPS + 1)
    p = np.stack([np.full(len(n), uniform), *ps[::-1]], axis=1)
    w = np.full(order + 1, 1 / (order + 1))
    for _ in range(rounds):
        share = p * w
        gain = (n / share.sum(axis=1)) @ share
        w = np.maximum(gain / gain.sum(), 1e-6)
        w /= w.sum()
    return w
