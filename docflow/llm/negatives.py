"""Hard negatives by a secondary sort.

Every anchor meets every row, in blocks of both.  From its block of rows an anchor takes what may be among its first: rows of its own
label in a first pass, and, once its positives are known, for each positive's window the block's first rows of other labels in a
second (this pre-aggregation drops nothing that could be told).  Scores are packed into keys (anchor, descending score,
positives first, id); ``repartitionAndSortWithinPartitions`` brings an anchor's keys into one partition in order, and an iterator
reads them: a positive opens a window, a negative is told for each open window that it lies in, a window closes when it has
told all or has been passed.  The iterator holds the open windows alone.

Components become ``floor(scale * x)`` and scores are their integer inner products, exact up to 2**56 in size, where they stop.
Rows with a null id, label, vector or component, or a component that is not finite, take no part; vectors of different
length never meet.  An id that several rows carry is one anchor, by the smallest (label, vector); as positives and negatives its
rows stay rows of their own, and a row is never a positive or negative of its own id.  Ties in score go to the smaller id.  Extra columns
are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, every_block, runs_of, stored

MOST, NONE = 1 << 56, np.iinfo(np.int64).min
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def usable(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """``(vec_id, label, dims, vector)`` of the rows that take part; the vector as whole doubles."""

    def run(batches):
        for b in batches:
            keep, raw, dims = [], [], []
            for i, (k, name, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                if k is None or name is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    keep.append(i)
                    raw.append(np.clip(np.floor(np.clip(x, -1e300, 1e300) * scale), -1e300, 1e300).tobytes())
                    dims.append(len(x))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dims", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vec_col).alias("vector"))
    return rows.mapInArrow(run, "vec_id bigint, label string, dims int, vector binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole doubles."""
    if a.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole double
    whole = [[int(x) for x in row] for row in b]
    return np.array([[max(-MOST, min(MOST, sum(int(x) * y for x, y in zip(row, other)))) for other in whole] for row in a], np.int64).reshape(len(a), len(b))


def firsts(scores: np.ndarray, many: int):
    """The highest scores of each row, one after the other, as (rows, columns); the first of equal columns.  Overwrites ``scores``."""
    every = np.arange(len(scores))
    for _ in range(min(many, scores.shape[1])):
        at = scores.argmax(axis=1)
        some = scores[every, at] > NONE
        if not some.any():
            return
        yield every[some], at[some]
        scores[every[some], at[some]] = NONE


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    key = np.zeros(len(ids), KEY)
    key["anchor"], key["id"] = anchor.view(np.uint64) ^ _SIGN, ids.view(np.uint64) ^ _SIGN
    key["score"], key["kind"] = ~(score.view(np.uint64) ^ _SIGN), kind
    raw = key.tobytes()
    return [raw[i : i + KEY.itemsize] for i in range(0, len(raw), KEY.itemsize)]


def told(keys, many: int, low: int, high: int):
    """Rows ``(anchor, positive, rank, negative, positive score, negative score)`` from one partition's sorted keys."""
    last, open_ = None, []
    for k in keys:
        anchor, score, kind, i = np.frombuffer(k, KEY)[0].tolist()
        score, i = (1 << 63) - 1 - score, i - (1 << 63)
        if anchor != last:
            last, open_ = anchor, []
        if kind == 0:
            open_.append([i, score, 0])
            continue
        for w in open_:
            if low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor - (1 << 63), w[0], w[2], i, w[1], score
        open_ = [w for w in open_ if w[2] < many and 100 * score >= low * w[1]]


def _met(anchors: DataFrame, rows: DataFrame, block: int, tile: int) -> DataFrame:
    """Blocks of anchors beside blocks of rows: anchors first, rows in the order of their ids."""
    a, many_a = blocks(anchors, block, "block", "vec_id")
    r, many_r = blocks(rows, tile, "tile", "number")
    r = r.drop("number")
    none = F.lit(None).cast(dict(anchors.dtypes)["wins"])
    both = every_block(a, "tile", many_r).withColumn("kind", F.lit(0)).unionByName(every_block(r, "block", many_a).withColumn("kind", F.lit(1)).withColumn("wins", none))
    return both.repartition("tile", "block", "dims").sortWithinPartitions("tile", "block", "dims", "kind", "vec_id")


def _compared(batches, chunk: int = 256):
    """For a chunk of anchors and a block of rows: ids, scores, whether the labels agree, whether the ids do, and the anchors' windows."""
    for t in runs_of(batches, "tile", "block", "dims"):
        n = int((t.column("kind").to_numpy() == 0).sum())
        if not 0 < n < len(t):
            continue
        ids, wins = t.column("vec_id").to_numpy(), t.column("wins").slice(0, n).to_pylist()
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(len(t), -1)
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        for s in range(0, n, chunk):
            e = min(n, s + chunk)
            yield ids[s:e], ids[n:], products(x[s:e], x[n:]), label[s:e, None] == label[None, n:], ids[s:e, None] == ids[None, n:], wins[s:e]


def _positives(many: int):
    def run(batches):
        for anchor, ids, scores, same, own, _ in _compared(batches):
            found = np.where(same & ~own, scores, NONE)
            for a, r in firsts(found, many):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a]), pa.array(scores[a, r]), pa.array(ids[r])], names=["anchor_id", "score", "vec_id"])

    return run


def _negatives(many: int, low: int, high: int):
    def run(batches):
        for anchor, ids, scores, same, own, wins in _compared(batches):
            free = ~(same | own)
            hit = set()
            for w in range(max(map(len, wins))):
                p = np.array([x[w] if w < len(x) else 0 for x in wins], np.int64)[:, None]
                inside = np.array([w < len(x) for x in wins])[:, None] & (low * p <= 100 * scores) & (100 * scores <= high * p)
                found = np.where(free & inside, scores, NONE)
                for a, r in firsts(found, many):
                    hit.update(zip(a.tolist(), r.tolist()))
            a, r = np.array(sorted(hit), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(packed(anchor[a], scores[a, r], 1, ids[r]), pa.binary())], names=["key"])

    return run


def _keys(batches):
    for b in batches:
        anchor, score, ids = (b.column(i).to_numpy() for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(packed(anchor, score, 0, ids), pa.binary())], names=["key"])


def mine(
    vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    block: int = 4096, tile: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each of an anchor's first ``positives`` rows of
    its label, the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``.

    ``anchor`` is a condition on column ``vec_id``; ``high`` is at most 100.  ``block`` anchors and ``tile`` rows meet in one task.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies between 0 and 100 per cent of its positive's score")
    spark = vectors.sparkSession
    rows = stored(usable(vectors, scale, id_col, vec_col, label).withColumn("number", F.monotonically_increasing_id()), "mined-rows")
    one = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "dims")).alias("r")).select("vec_id", "r.*")
    anchors = stored(one.select("vec_id", "label", "dims", "vector"), "mined-anchors")
    empty = F.array().cast("array<bigint>")
    found = _met(anchors.withColumn("wins", empty), rows, block, tile).mapInArrow(_positives(positives), "anchor_id bigint, score bigint, vec_id bigint")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    first = stored(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "mined-positives")
    wins = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("wins"))
    near = _met(anchors.join(wins, "vec_id"), rows, block, tile).mapInArrow(_negatives(negatives, low, high), "key binary")
    keys = stored(first.mapInArrow(_keys, "key binary").unionByName(near), "mined-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    out = ordered.mapPartitions(lambda it: told((k for k, _ in it), negatives, low, high))
    return spark.createDataFrame(out, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint", verifySchema=False)
