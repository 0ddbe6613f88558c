"""Exact Jaccard join of shingle sets through a count-vector R-tree.

Shingles are hashed into groups; a set's group counts are its point.  The overlap of two sets is at most the summed minima
of their coordinates, and the overlap of two boxes of points at most the summed minima of their upper corners, so pairs and
whole nodes whose bound is below the required overlap are dropped; surviving pairs are verified on the sets.

The root of the tree is a fan-out that Spark can shuffle: with at most ``r`` shingles in which a linked pair of a size class
can differ, ``r + 1 + s`` groups leave at least ``s + 1`` groups without a difference, so a pair shares a (class, group, group
content) cell, or at least ``s + 1`` empty groups, which have cells of their own.  Each cell is a subtree: its points are
packed into leaves by size and coordinates, and searched by the bounds above.  (One tree over all points prunes little: count
vectors of unrelated texts of one size lie close together in most coordinates, and splits run out before dimensions do.)

Exact copies are one point.  Every set is first verified against the leader of its cells alone; only sets that are then
still apart are paired, so a group of near copies doesn't make all its pairs.  Cells that hold more than ``tile`` such
entries are split into leaf pairs over tasks.

Null texts and texts without a word have no shingles and link with nothing; texts with fewer words than a shingle are one
shingle.  Rows with a null id link with nothing and have a null component; rows that repeat an id are one document with
several texts.  An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, frugal, removed, returned, shared_dir, stored, thinned
from .meeting import KEY_BITS, apart, beside, dealt, parents, shared_keys, tiles
from .tokens import Hasher, mixed, narrow, runs, widened

DIMS, LEAF, LEAD = 64, 32, 8


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (of the whole sequence where it is shorter) of hashed words."""
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    grams = w[:n]
    for i in range(1, min(k, len(w))):
        grams = mixed(grams, w[i : i + n])
    return np.unique(grams ^ np.uint64(min(k, len(w))))


class Classes:
    """Size classes of ratio ``(den / num)^2``; a linked pair is in one class or in two next to each other."""

    def __init__(self, num: int, den: int, top: int = 1 << 40):
        self.num, self.den, lows = num, den, [1]
        while lows[-1] < top:
            lows.append(max(lows[-1] + 1, lows[-1] * den * den // (num * num) + 1))
        self.lows = np.array(lows, np.int64)
        self.shapes: dict[int, tuple[int, int]] = {}

    def of(self, n: np.ndarray | int):
        return np.searchsorted(self.lows, n, "right") - 1

    def differences(self, c: int) -> int:
        """The most shingles in which a linked pair differs whose smaller set is of class ``c``.

        |A| <= |B| <= |A| den / num, and the symmetric difference is at most (|A| + |B|) (den - num) / (den + num).
        """
        small = int(self.lows[c + 1]) - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def groups(self, c: int) -> tuple[int, int]:
        """The number of groups of class ``c``, and ``s``: about twice as many groups as a small set of it leaves empty."""
        if c not in self.shapes:
            r, s = self.differences(c), 0
            while s < 2 + 2 * (r + 1 + s) * exp(-int(self.lows[c]) / (r + 1 + s)) and s < r + 8:
                s += 1
            self.shapes[c] = r + 1 + s, s
        return self.shapes[c]


def cells(s: np.ndarray, classes: Classes) -> tuple[np.ndarray, bytes, bytes]:
    """Cell keys of a set in its own class and, if its partners reach there, in the one below (lowest bit 1), the bit above marks leading cells; the leading cells of both."""
    own, out, leads = int(classes.of(len(s))), [], []
    for c in (own, own - 1):
        first = np.zeros(LEAD, "<u4")
        if c == own or c >= 0 and -(-len(s) * classes.num // classes.den) < classes.lows[own]:
            groups, spare = classes.groups(c)
            at = (s % np.uint64(groups)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            start = runs(at[order])
            used = at[order][start]
            content = np.add.reduceat((s[order] ^ (s[order] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15), start)
            key = mixed(content, used.astype(np.uint64) * np.uint64(4099) + np.uint64(c)) >> np.uint64(64 - KEY_BITS)
            lead = used < LEAD
            first[used[lead]] = short(key[lead] >> np.uint64(2))
            key = (key & ~np.uint64(3)) | (lead.astype(np.uint64) << np.uint64(1))
            if groups - len(used) > spare:
                key = np.concatenate([key, _empties(c, groups, spare, used) & ~np.uint64(3)])
            out.append(key | np.uint64(c != own))
        leads.append(first.tobytes())
    return np.concatenate(out), *leads


def _empties(c: int, groups: int, spare: int, used: np.ndarray) -> np.ndarray:
    """Cells of a set that leaves more than ``spare`` groups empty: one for each choice of ``spare + 1`` of them, or one for all where a class has many choices."""
    names = [b""]
    if comb(groups, spare + 1) <= 1000:
        names = [bytes(x) for x in combinations(np.setdiff1d(np.arange(groups), used).tolist(), spare + 1)]
    return np.array([xxhash.xxh3_64_intdigest(x, seed=c + 1) for x in names], np.uint64) >> np.uint64(64 - KEY_BITS)


def points(s: np.ndarray) -> np.ndarray:
    """Group counts of a set: DIMS of them, four times as many for each five times of size from 800 on, or large sets would all lie close together."""
    dims = DIMS
    while len(s) >= 800 * (dims // DIMS) ** 1.161:  # 4 ** 1.161 is 5
        dims *= 4
    return np.bincount(((s >> np.uint64(40)) % np.uint64(dims)).astype(np.int64), minlength=dims)


def folded(raw: list[bytes]) -> np.ndarray:
    """Points (by ``narrow``) as rows of DIMS coordinates."""
    kind = np.array([len(x) << 4 | x[0] for x in raw], np.int64)
    out = np.empty((len(raw), DIMS), np.int32)
    for k in np.unique(kind).tolist():
        at = np.flatnonzero(kind == k)
        counts = np.concatenate([widened(raw[i]) for i in at.tolist()]).reshape(len(at), -1, DIMS)
        out[at] = counts.sum(axis=1)
    return out


def finer(raw: list[bytes], n: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (x, y) also pass the bound on the smaller point's own coordinates."""
    ok = np.ones(len(x), bool)
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        if min(len(raw[i]), len(raw[j])) > 2 * DIMS:
            a, b = widened(raw[i]), widened(raw[j])
            dims = min(len(a), len(b))
            over = int(np.minimum(a.reshape(-1, dims).sum(axis=0), b.reshape(-1, dims).sum(axis=0)).sum())
            ok[k] = over * (num + den) >= num * int(n[i] + n[j])
    return ok


def short(cell: np.ndarray) -> np.ndarray:
    return (cell & np.uint64(0xFFFFFFFF)).astype("<u4") | np.uint32(1)


SETS = "doc_id bigint, text_hash bigint, n_shingles bigint, set_id bigint, point binary, cells binary, n_cells bigint, lead binary, lead_low binary"


def shingle_sets(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """A row a document: the size and hash of its set, its point, and its cells."""

    def run(batches):
        frugal()
        hasher, classes = Hasher(), Classes(num, den)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = []
                words, many = hasher(part.column(1).to_pylist())
                for w in np.split(words, np.cumsum(many)[:-1]):
                    s = shingles(w, k)
                    if len(s):
                        p, (keys, high, low) = points(s), cells(s, classes)
                        rows.append((len(s), _set_id(s), narrow(p), narrow(keys), len(keys), high, low))
                    else:
                        rows.append((0, None, None, None, 0, None, None))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=[f.split()[0] for f in SETS.split(", ")])
        del hasher
        returned()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SETS)


def _set_id(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=7) - (1 << 63) if len(s) else None


def first_here(a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether no leading cell that both share comes before this one: a pair is emitted by its first leading cell alone."""
    same = (a == b) & (a != 0)
    first = np.take_along_axis(a, same.argmax(axis=-1)[..., None], axis=-1)[..., 0]
    return ~same.any(axis=-1) | (first == cell)


def search(n: np.ndarray, p: np.ndarray, upper: np.ndarray, lead: np.ndarray, label: np.ndarray, cell: np.uint32, side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels of one subtree's points that pass the bound; ``side`` (0 or 1) restricts pairs to those across."""
    order = np.lexsort((p[:, 1], p[:, 0], n))
    n, p, upper, lead, label, side = n[order], p[order], upper[order], lead[order], label[order], None if side is None else side[order]
    edge = np.arange(0, len(n), LEAF)
    high, low_n, high_n = np.maximum.reduceat(p, edge), n[edge], np.maximum.reduceat(n, edge)
    out_a, out_b = [], []
    for i, a in enumerate(edge):
        # node against node: sizes within the ratio, and the upper corners' summed minima reach the overlap of the smallest sets
        near = np.flatnonzero(low_n[i:] * num <= high_n[i] * den) + i
        bound = np.minimum(high[near], high[i]).sum(axis=1)
        near = near[bound * (num + den) >= num * (low_n[near] + low_n[i])]
        for j in near:
            b = edge[j]
            rows, cols = slice(a, min(a + LEAF, len(n))), slice(b, min(b + LEAF, len(n)))
            ok = label[rows, None] != label[None, cols]
            ok &= ~(upper[rows, None] & upper[None, cols])
            if i == j:
                ok &= np.triu(np.ones_like(ok), 1)
            if side is not None:
                ok &= side[rows, None] != side[None, cols]
            if not ok.any():
                continue
            over = np.minimum(p[rows, None, :], p[None, cols, :]).sum(axis=2)
            ok &= over * (num + den) >= num * (n[rows, None] + n[None, cols])
            x, y = np.nonzero(ok)
            own = first_here(lead[a + x], lead[b + y], cell)
            x, y = x[own], y[own]
            out_a.append(order[a + x])
            out_b.append(order[b + y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def candidates(rows: DataFrame, num: int, den: int, tiled: bool) -> DataFrame:
    """Candidate pairs (a, b) of ``rows (cell[, tile, side], id, flag, label, n_shingles, point, lead)``, each cell searched as a subtree."""
    key = ["cell", "tile"] if tiled else ["cell"]
    names = [*key, "id", "flag", "label", "n_shingles", "point", "lead", *(["side"] if tiled else [])]

    def run(batches):
        frugal()
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table):
            cell = t.column("cell").to_numpy()
            change = cell[1:] != cell[:-1]
            if tiled:
                tile = t.column("tile").to_numpy()
                change |= tile[1:] != tile[:-1]
            edge = np.concatenate([[0], np.flatnonzero(change) + 1, [len(cell)]])
            ids, n, label = (t.column(c).to_numpy() for c in ("id", "n_shingles", "label"))
            upper = t.column("flag").to_numpy(zero_copy_only=False)
            side = t.column("side").to_numpy() if tiled else None
            raw = t.column("point").to_pylist()
            p = folded(raw)
            lead = np.frombuffer(b"".join(t.column("lead").to_pylist()), "<u4").reshape(-1, LEAD)
            brief = short(cell.view(np.uint64))
            a, b = [], []
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            if len(two) and not tiled:
                over = np.minimum(p[two], p[two + 1]).sum(axis=1)
                ok = (over * (num + den) >= num * (n[two] + n[two + 1])) & ~(upper[two] & upper[two + 1]) & (label[two] != label[two + 1]) & first_here(lead[two], lead[two + 1], brief[two])
                a.append(two[ok]), b.append(two[ok] + 1)
            for s, k in zip(edge[:-1], size):
                if k > 2 or (tiled and k > 1):
                    e = slice(s, s + k)
                    x, y = search(n[e], p[e], upper[e], lead[e], label[e], brief[s], side[e] if tiled and side[e].any() else None, num, den)
                    a.append(x + s), b.append(y + s)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                ok = finer(raw, n, a, b, num, den)
                a, b = ids[a[ok]], ids[b[ok]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            if t.num_rows < 20_000:
                held.append(batch)
                continue
            cell = t.column("cell").to_numpy()
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if last:
                yield from out(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))
        held = []
        returned()

    return rows.select(*names).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", tile: int = 1024) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents link where intersection * den >= union * num."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "jaccard-cells")
    shingle_sets(docs, k, num, den, id_col, text_col).write.parquet(path)
    celled = spark.read.schema(SETS).parquet(path)
    sets = stored(celled.drop("cells"), "jaccard-sets")
    own = sets.where("set_id is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    distinct = own.groupBy("set_id").agg(first, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "point", "lead", "lead_low")))
    distinct = stored(distinct.select(F.col("set_id").alias("id"), "rep.doc_id", "rep.text_hash", "copies", "n_shingles", "point", "lead", "lead_low"), "jaccard-distinct")
    total = own.select(F.sum("n_cells")).first()[0] or 0
    members = stored(shared_keys(celled.where("set_id is not null and doc_id is not null").select(F.col("set_id").alias("id"), F.col("cells").alias("keys")), total, tile), "jaccard-members")
    removed(spark, path)

    sizes = distinct.select("id", "n_shingles")
    led = parents(members).join(sizes.withColumnRenamed("id", "a").withColumnRenamed("n_shingles", "na"), "a").join(sizes.withColumnRenamed("id", "b").withColumnRenamed("n_shingles", "nb"), "b")
    led = stored(led.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b"), "jaccard-led")
    near = stored(verified(docs, distinct, led, k, num, den, id_col, text_col), "jaccard-near")
    labels = components(near.select("a", "b")).select("id", F.col("component_id").alias("label"))
    lead = F.when(F.col("flag"), F.col("lead_low")).otherwise(F.col("lead_own")).alias("lead")
    points_of = distinct.select("id", "n_shingles", "point", F.col("lead").alias("lead_own"), "lead_low")
    few, many = (rest.join(points_of, "id").select("*", lead).drop("lead_own", "lead_low") for rest in apart(members, labels))
    pairs = candidates(few, num, den, False).union(candidates(tiles(many, tile), num, den, True)).distinct()
    far = verified(docs, distinct, stored(pairs, "jaccard-pairs"), k, num, den, id_col, text_col)

    linked = components(thinned(near.select("doc_a", "doc_b").union(far.select("doc_a", "doc_b")).toDF("a", "b")))
    whole = distinct.select(F.col("id").alias("set_id"), F.col("doc_id").alias("rep"), "copies").join(linked, F.col("rep") == F.col("id"), "left").select("set_id", "copies", F.coalesce("component_id", "rep").alias("component_id"), "rep")
    spread = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt")
    moved = whole.where("copies > 1 or component_id <> rep").select("set_id", "component_id", spread)
    salted = sets.select("doc_id", "n_shingles", "set_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("salt"))
    out = salted.join(moved, ["set_id", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, small: int = 500_000) -> DataFrame:
    """Links ``(a, b, doc_a, doc_b)`` among pairs of sets, decided on the shingle sets of their texts.

    The roles of the pairs (30 bytes each) are broadcast to the texts up to ``small`` of them; beyond that both sides are shuffled.
    """
    roles = stored(dealt(pairs).join(distinct.select("id", "doc_id", "text_hash"), "id"), "jaccard-roles")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    full = texts.join(F.broadcast(roles) if roles.count() <= small else roles, ["doc_id", "text_hash"]).select("key", "salt", "tail", "id", "doc_id", "text")

    def run(batches):
        frugal()
        hasher = Hasher()
        place, head, head_doc = None, None, None
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                words, many = hasher(part.column("text").to_pylist())
                out = []
                for w, key, salt, tail, one, doc in zip(np.split(words, np.cumsum(many)[:-1]), *(part.column(c).to_pylist() for c in ("key", "salt", "tail", "id", "doc_id"))):
                    s = shingles(w, k)
                    if _set_id(s) != one:  # another row that repeats the id
                        continue
                    if not tail:
                        place, head, head_doc = (key, salt), s, doc
                    elif place == (key, salt):
                        both = np.concatenate([head, s])
                        both.sort(kind="stable")
                        shared = int((both[1:] == both[:-1]).sum())
                        if shared * den >= (len(both) - shared) * num:
                            out.append((key, one, head_doc, doc))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "doc_a", "doc_b"])
        del hasher
        returned()

    return beside(full).mapInArrow(run, "a bigint, b bigint, doc_a bigint, doc_b bigint")


def deduplicated(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id; rows with a null id all stay.

    Of rows that repeat a doc_id one stays.
    """
    found = stored(jaccard_components(docs, k, num, den).select("doc_id", "component_id"), "jaccard-components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = stored(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
