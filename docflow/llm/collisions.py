"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random lines.  Two vectors collide on a line when one lies in the window around the other;
close vectors collide on most lines, so pairs whose collision count reaches a threshold are verified by their cosine in
double precision.  The threshold is the largest that a pair exactly at the wanted cosine still reaches with probability
``keep``, by the binomial distribution of its collisions.

Windows are counted inside cells, so that not every pair is counted: a table cuts several lines into strips, a cell is one
strip of each, and there are as many tables as a pair at the wanted cosine needs to share a cell with probability ``find``.
Strips a table grow with the logarithm of the number of vectors.  Inside a cell, every line's values are sorted and
each member's window is found in the sorted order.  A pair is counted in the first table where it shares a cell only.

Equal vectors are one class with its number of copies.  Cells with more than ``tile`` members are split into pairs of leaves
over tasks.  Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length
do not link.  Rows with a null id link with nothing.  Rows that repeat an id are vectors of their
own, each with a row in the result and its own count of links.  Extra columns are ignored, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

LINES, STRIP, SEED = 32, 2.0, 20


def shares(cosine: float, strip: float = STRIP) -> float:
    """The chance that a pair at ``cosine`` falls into one strip of a randomly shifted line."""
    sigma = math.sqrt(2 - 2 * cosine)
    steps = np.linspace(0, strip, 2001)
    density = np.exp(-((steps / sigma) ** 2) / 2) * 2 / (sigma * math.sqrt(2 * math.pi))
    return float(np.trapezoid(density * (1 - steps / strip), steps))


def tables(n: int, cosine: float, find: float) -> tuple[int, int]:
    """Lines a table and number of tables for ``n`` vectors: about 32 unrelated vectors share a cell."""
    lines = max(1, round(math.log(max(n, 64) / 32) / -math.log(shares(0.0))))
    return lines, max(1, math.ceil(math.log(1 - find) / math.log(1 - shares(cosine) ** lines)))


def threshold(cosine: float, window: float, lines: int, keep: float) -> int:
    p = math.erf(window / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    tail, c = 1.0, 0
    while tail - math.comb(lines, c) * p**c * (1 - p) ** (lines - c) >= keep:
        tail -= math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        c += 1
    return c


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raw])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vector, vec_hash)``: the bytes of usable vectors in double precision, null for others."""

    def run(batches):
        import xxhash

        for b in batches:
            raw = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = None if v is None or i is None or None in v or not len(v) else np.array(v, np.float64)
                good = x is not None and np.isfinite(x).all() and np.abs(x).max() > 0
                raw.append((x + 0.0).tobytes() if good else None)
            hashed = [xxhash.xxh3_64_intdigest(r, seed=3) - (1 << 63) if r else None for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(hashed, pa.int64())], names=["vec_id", "vector", "vec_hash"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col)).mapInArrow(run, "vec_id bigint, vector binary, vec_hash bigint")


def _cells(reps: DataFrame, lines: int, many: int) -> DataFrame:
    """A row for each vector and table, with the vector's cells of all tables (32 bits each)."""

    def run(batches):
        import xxhash

        for b in batches:
            raw = b.column("vector").to_pylist()
            for size in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == size]
                rng = np.random.default_rng((SEED, size))
                normal, shift = rng.standard_normal((size // 8, lines * many)), rng.uniform(0, STRIP, lines * many)
                strips = np.floor((_unit([raw[i] for i in at]) @ normal + shift) / STRIP).astype("<i4").reshape(len(at), many, lines)
                keys = np.array([[xxhash.xxh32_intdigest(s.tobytes(), seed=t) for t, s in enumerate(row)] for row in strips], "<u4")
                whole = [k.tobytes() for k in keys]
                pick = np.repeat(np.array(at), many)
                cell = (keys.astype(np.int64) | np.arange(many, dtype=np.int64) << 32) ^ size << 48
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell.ravel()), pa.array(np.tile(np.arange(many), len(at)), pa.int64()), b.column("vec_id").take(pa.array(pick)), b.column("copies").take(pa.array(pick)),
                    b.column("vector").take(pa.array(pick)), pa.array([w for w in whole for _ in range(many)], pa.binary())], names=["cell", "table", "vec_id", "copies", "vector", "keys"])

    return reps.mapInArrow(run, "cell bigint, table bigint, vec_id bigint, copies bigint, vector binary, keys binary")


def collisions(lines: np.ndarray, window: float, rows: slice) -> np.ndarray:
    """How often each member collides with the members of ``rows``: windows around them in every line's sorted order."""
    queries, n = lines[rows], len(lines)
    count = np.zeros(len(queries) * n, np.int32)
    base = np.arange(len(queries)) * n
    for m in range(lines.shape[1]):
        order = np.argsort(lines[:, m])
        values = lines[order, m]
        low, high = np.searchsorted(values, queries[:, m] - window, "left"), np.searchsorted(values, queries[:, m] + window, "right")
        many = high - low
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        count += np.bincount(np.repeat(base, many) + order[inside], minlength=len(count))
    return count.reshape(len(queries), n)


def cell_links(table: int, x: np.ndarray, keys: np.ndarray, side: np.ndarray | None, cosine: float, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one cell that share no cell of an earlier table."""
    normal = np.random.default_rng((SEED + 1, x.shape[1])).standard_normal((x.shape[1], LINES))
    lines = x @ normal
    a, b = [], []
    for s in range(0, len(x), 256):
        rows = slice(s, min(s + 256, len(x)))
        fresh = np.arange(len(x))[None, :] > np.arange(rows.start, rows.stop)[:, None]
        for t in range(table):
            fresh &= keys[rows, t][:, None] != keys[:, t][None, :]
        if side is not None:
            fresh &= side[rows][:, None] != side[None, :]
        if not fresh.any():
            continue
        i, j = np.nonzero(fresh & (collisions(lines, window, rows) >= least))
        i += s
        for k in range(0, len(i), 100_000):
            u, v = i[k : k + 100_000], j[k : k + 100_000]
            ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            a.append(u[ok])
            b.append(v[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a cell's links."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def links(rows: DataFrame, cosine: float, window: float, least: int, tiled: bool) -> DataFrame:
    """Per cell: rows (vec_id, n, null) with weighted link counts, and rows (vec_id, 0, other) of a spanning forest."""
    key = ["cell", "tile"] if tiled else ["cell"]

    def run(batches):
        held: list = []

        def out(t: pa.Table):
            cell = t.column("cell").to_numpy()
            change = cell[1:] != cell[:-1]
            if tiled:
                tile = t.column("tile").to_numpy()
                change |= tile[1:] != tile[:-1]
            edge = np.concatenate([[0], np.flatnonzero(change) + 1, [len(cell)]])
            ids, copies, table = (t.column(c).to_numpy() for c in ("vec_id", "copies", "table"))
            side = t.column("side").to_numpy() if tiled else None
            raw, keys = t.column("vector"), t.column("keys")
            who, n, other = [], [], []
            for s, e in zip(edge[:-1], edge[1:]):
                if e - s < 2:
                    continue
                x = _unit(raw.slice(s, e - s).to_pylist())
                k = np.stack([np.frombuffer(r, "<u4") for r in keys.slice(s, e - s).to_pylist()])
                own = side[s:e] if tiled and side[s:e].any() else None
                a, b = cell_links(int(table[s]), x, k, own, cosine, window, least)
                if not len(a):
                    continue
                w = np.bincount(a, copies[s + b], e - s) + np.bincount(b, copies[s + a], e - s)
                some = np.flatnonzero(w)
                who += ids[s + some].tolist()
                n += w[some].astype(np.int64).tolist()
                other += [None] * len(some)
                for i, j in _forest(e - s, a, b):
                    who.append(int(ids[s + i]))
                    n.append(0)
                    other.append(int(ids[s + j]))
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], names=["vec_id", "n", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            cell = t.column("cell").to_numpy()
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if last:
                yield from out(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "vec_id bigint, n bigint, other bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, window: float = 0.6, find: float = 0.99, keep: float = 0.995, tile: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    v = stored(classes(vectors, id_col, vec_col), "vec-all")
    reps = stored(v.where("vec_hash is not null").groupBy("vec_hash").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vec-reps")
    lines, many = tables(reps.count(), cosine, find)
    rows = _cells(reps, lines, many)
    least = threshold(cosine, window, LINES, keep)
    sizes = _cells(reps, lines, many).groupBy("cell").count().where(F.col("count") > 1)
    sizes = stored(sizes, "vec-cells")
    hot = sizes.where(F.col("count") > tile)
    rows = rows.join(sizes, "cell")
    found = links(rows.where(F.col("count") <= tile).drop("count"), cosine, window, least, False)
    if not hot.isEmpty():
        leaves = F.ceil(F.col("count") / F.lit(tile // 2)).cast("int")
        big = rows.where(F.col("count") > tile).withColumn("leaf", F.pmod(F.xxhash64("vec_id"), leaves).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), leaves - 1)))
        big = big.withColumn("tile", F.least("leaf", "other").cast("long") * (1 << 20) + F.greatest("leaf", "other")).withColumn("side", (F.col("leaf") > F.col("other")).cast("int")).drop("leaf", "other", "count")
        found = found.union(links(big, cosine, window, least, True))
    found = stored(found, "vec-links")
    counts = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    linked = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    r = reps.select("vec_hash", "vec_id", "copies").join(counts, "vec_id", "left").join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    r = r.select("vec_hash", "copies", F.col("vec_id").alias("rep"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "vec_id").alias("component_id"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    told = r.where("copies > 1 or n > 0").select("vec_hash", "copies", "n", "component_id", spread)
    salted = v.select("vec_id", "vec_hash", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("salt"))
    out = salted.join(told, ["vec_hash", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
