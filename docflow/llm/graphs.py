"""Approximate nearest neighbours by inner product: one navigable small-world graph of several levels for each shard.

Equal vectors are one node that carries its first ids.  Nodes are dealt to shards by hash; a task builds a shard's graph and stores
it as flat arrays: per level the nodes on it and, in rows of equal width, their neighbours' places (-1 for none).  Queries go to every shard of
their length in streams of batches behind the shard's graph, descend its levels, and a window merges what the shards tell.

Inner products become distances by one more coordinate, ``sqrt(M**2 - |x|**2)`` with M the shard's longest vector, 0 for queries: nearest
then means largest product.  Graphs are built and walked in single precision; what is found is scored in double precision on
the original vectors, in the order of their components.

Building inserts nodes in batches that never exceed what the graph holds already: a batch is searched in the graph as it stands, all
of its members at once, meets itself by full comparison, and neighbours are chosen by the usual rule (a candidate stays unless
it is closer to one that stays than to the node).  A node's list that overflows is chosen anew from what it holds.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different length never meet.  Rows that repeat both id and vector count once; a query never finds rows of its own id.  Ties go to the
smaller id.  Extra columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .collisions import classes
from .common import blocks, runs_of, stored

#: neighbours a node keeps on upper levels and twice as many on the ground, candidates while building, nodes opened at once
LINKS, BUILD, WIDTH = 16, 80, 4


class Level:
    """One level: its nodes' vectors and, in flat rows, the places of their neighbours among them."""

    def __init__(self, points: np.ndarray, links: int):
        self.points, self.links = points, links
        self.near = np.full((len(points), links + links // 2), -1, np.int32)
        self.many = np.zeros(len(points), np.int32)
        self.held = 0

    def search(self, queries: np.ndarray, entry: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``most`` best places found from its ``entry`` places, best first (-1 for none), and their products."""
        n, q = len(self.points), len(queries)
        seen = np.zeros(q * (n + 1), np.int32)  # 0, or 1 and more after a node was met
        seen[n :: n + 1] = 1
        ids = np.full((q, most), n, np.int32)
        score = np.full((q, most), -np.inf, np.float32)
        done = np.ones((q, most), bool)
        fresh = np.where(entry < 0, n, entry)
        active = np.arange(q)
        while len(active):
            key = (active[:, None] * (n + 1) + fresh).ravel()
            key = key[seen[key] == 0]
            turns = np.arange(1, len(key) + 1, dtype=np.int32)
            seen[key] = turns
            key = key[seen[key] == turns]  # of a query's equal keys one stays
            row = key // (n + 1)
            place = key - row * (n + 1)
            product = np.einsum("ij,ij->i", self.points[place], queries[row])
            first = np.searchsorted(row, active)
            many = np.searchsorted(row, active, "right") - first
            wide = int(many.max(initial=0))
            slot = np.arange(len(row)) - np.repeat(first, many)
            line = np.repeat(np.arange(len(active)), many)
            new_id, new_score = np.full((len(active), wide), n, np.int32), np.full((len(active), wide), -np.inf, np.float32)
            new_id[line, slot], new_score[line, slot] = place, product
            every = np.concatenate([score[active], new_score], 1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :most]
            score[active] = np.take_along_axis(every, order, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new_id], 1), order, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros_like(new_id, bool)], 1), order, 1) | (score[active] == -np.inf)
            turn = ~done & (np.cumsum(~done, axis=1) <= WIDTH)
            active = np.flatnonzero(turn.any(axis=1))
            line, at = np.nonzero(turn[active])
            slot = np.cumsum(turn[active], axis=1)[line, at] - 1
            fresh = np.full((len(active), WIDTH, self.near.shape[1]), n, np.int32)
            opened = self.near[ids[active[line], at]]
            fresh[line, slot] = np.where(opened < 0, n, opened)
            fresh = fresh.reshape(len(active), WIDTH * self.near.shape[1])
            done |= turn
        return np.where(ids == n, -1, ids), score

    def chosen(self, nodes: np.ndarray, cand: np.ndarray, product: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each node's candidates (best first, -1 for none) that are no closer to a chosen one than to the node."""
        out = np.full((len(nodes), most), -1, np.int32)
        for s in range(0, len(nodes), 256):
            c, p = cand[s : s + 256], product[s : s + 256]
            x = self.points[np.maximum(c, 0)]
            between = x @ x.transpose(0, 2, 1)
            kept, many = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
            blocked = c < 0
            for k in range(c.shape[1]):
                take = ~blocked[:, k] & (many < most)
                if not take.any():
                    continue
                kept[take, k] = True
                out[s : s + 256][take, many[take]] = c[take, k]
                many[take] += 1
                blocked[take] |= between[take, k] > p[take]
        return out

    def linked(self, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Put ``chosen`` in the nodes' lists and the nodes in the lists of those chosen."""
        self.near[nodes, : chosen.shape[1]] = chosen
        self.many[nodes] = (chosen >= 0).sum(axis=1)
        line, at = np.nonzero(chosen >= 0)
        to, back = chosen[line, at], nodes[line]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        more = np.diff(np.append(first, len(to)))
        slot = self.many[to] + np.arange(len(to)) - np.repeat(first, more)
        over = self.many[to[first]] + more > self.near.shape[1]
        full = np.repeat(over, more)
        self.near[to[~full], slot[~full]] = back[~full]
        for size in sorted(set(more[over].tolist())):
            pick = np.flatnonzero(over & (more == size))
            hub = to[first[pick]]
            cand = np.concatenate([self.near[hub], back[first[pick, None] + np.arange(size)]], 1)
            product = np.where(cand < 0, -np.inf, np.einsum("ijk,ik->ij", self.points[np.maximum(cand, 0)], self.points[hub]))
            best = np.argsort(-product, axis=1, kind="stable")
            self.near[hub] = -1
            self.near[hub, : self.links] = self.chosen(hub, np.take_along_axis(cand, best, 1), np.take_along_axis(product, best, 1), self.links)
            self.many[hub] = (self.near[hub] >= 0).sum(axis=1)
        self.many[to[first[~over]]] += more[~over].astype(np.int32)

    def flat(self) -> bytes:
        return self.near.astype("<i4").tobytes()


def lifted(x: np.ndarray, longest: float | None = None) -> tuple[np.ndarray, float]:
    """Unit-scaled vectors with the coordinate that makes all equally long; queries (``longest`` given) get 0."""
    size = np.abs(x).max(axis=1)
    if longest is not None:
        x = x / size[:, None]
        return np.concatenate([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))], 1).astype(np.float32), longest
    x = x / size.max()
    norm = (x * x).sum(axis=1)
    most = norm.max()
    return np.concatenate([x, np.sqrt(np.maximum(most - norm, 0))[:, None]], 1).astype(np.float32) / np.float32(np.sqrt(most)), 1.0


def heights(n: int, seed: int) -> np.ndarray:
    """How many levels each node stands on beyond the ground."""
    return np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64)


def built(points: np.ndarray, seed: int = 11) -> tuple[list[np.ndarray], list[Level]]:
    """Levels from the ground up, each with the numbers of its nodes."""
    n = len(points)
    high = heights(n, seed)
    nodes = [np.flatnonzero(high >= h) for h in range(int(high.max()) + 1)]
    levels = [Level(points[at], 2 * LINKS if h == 0 else LINKS) for h, at in enumerate(nodes)]
    done = 0
    while done < n:
        size = min(n - done, max(1, done), 256) if done else min(n, 2 * LINKS)
        batch = np.arange(done, done + size)
        entry = None
        for h in range(len(levels) - 1, -1, -1):
            level = levels[h]
            mine = batch[high[batch] >= h]
            ground = level.held
            at = np.arange(ground, ground + len(mine))  # places are in the order of the nodes
            queries = points[batch]
            if ground:
                entry = np.zeros((len(batch), 1), np.int32) if entry is None else entry
                found, product = level.search(queries, entry, BUILD if len(mine) else 8)
            else:
                found, product = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32)
            if len(mine):
                row = mine - done
                own = points[mine] @ points[mine].T
                np.fill_diagonal(own, -np.inf)
                cand = np.concatenate([found[row], np.where(own == -np.inf, -1, np.broadcast_to(at, own.shape)).astype(np.int32)], 1)
                near = np.concatenate([product[row], own], 1)
                order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD]
                cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
                level.linked(at, level.chosen(at, cand, near, LINKS))
                level.held += len(mine)
            if h:
                up = nodes[h][np.maximum(found[:, :8], 0)]
                below = np.searchsorted(nodes[h - 1], up).astype(np.int32)
                entry = np.where(found[:, :8] < 0, -1, below)
                entry = np.where((entry < 0).all(axis=1, keepdims=True) & (levels[h - 1].held > 0), 0, entry)
        done += size
    return nodes, levels


def walked(nodes: list[np.ndarray], levels: list[Level], queries: np.ndarray, most: int) -> np.ndarray:
    """For each query the places of the ``most`` best nodes found on the ground."""
    entry = np.zeros((len(queries), 1), np.int32)
    for h in range(len(levels) - 1, 0, -1):
        found, _ = levels[h].search(queries, entry, 8)
        below = np.searchsorted(nodes[h - 1], nodes[h][np.maximum(found, 0)]).astype(np.int32)
        entry = np.where(found < 0, -1, below)
    return levels[0].search(queries, entry, most)[0]


_GRAPH = "shard bigint, dims int, kind int, level int, nodes binary, near binary, vectors binary, ids array<array<bigint>>"


def _graphs(batches):
    """A row for each level of a shard's graph: its nodes and neighbours; the ground's row also has the vectors and ids."""
    for t in runs_of(batches, "shard", "dims"):
        dims = t.column("dims")[0].as_py()
        raw = t.column("vector").to_pylist()
        x, _ = lifted(np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dims))
        nodes, levels = built(x)
        for h, (at, level) in enumerate(zip(nodes, levels)):
            row = [t.column("shard")[0].as_py(), dims, 0, h, at.astype("<i4").tobytes(), level.flat(), b"".join(raw) if h == 0 else None]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            ids = pa.array([t.column("ids").to_pylist() if h == 0 else None], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds)), ids], names=["shard", "dims", "kind", "level", "nodes", "near", "vectors", "ids"])


def opened(rows: list[dict]) -> tuple[list[np.ndarray], list[Level], np.ndarray, list[list[int]]]:
    """A stored graph: nodes and levels from the ground up, the original vectors, the ids of each node."""
    rows = sorted(rows, key=lambda r: r["level"])
    vectors = np.frombuffer(rows[0]["vectors"], "<f8").reshape(-1, rows[0]["dims"])
    x, _ = lifted(vectors)
    nodes, levels = [], []
    for r in rows:
        at = np.frombuffer(r["nodes"], "<i4")
        level = Level.__new__(Level)
        level.points, level.near = x[at], np.frombuffer(r["near"], "<i4").reshape(len(at), -1)
        nodes.append(at)
        levels.append(level)
    return nodes, levels, vectors, rows[0]["ids"]


def _found(top: int, most: int):
    """Queries behind their shard's graph; tells ``top + 1`` ids or more a query, so that its own may go."""

    def run(batches):
        now, rows, graph = None, [], None
        for b in batches:
            kinds, shards, dims = (b.column(c).to_numpy() for c in ("kind", "shard", "dims"))
            start = 0
            while start < b.num_rows:
                key = (shards[start], dims[start])
                if key != now:
                    now, rows, graph = key, [], None
                if kinds[start] == 0:
                    rows += b.slice(start, 1).select(["dims", "level", "nodes", "near", "vectors", "ids"]).to_pylist()
                    start += 1
                    continue
                end = start
                while end < b.num_rows and end - start < 256 and (shards[end], dims[end]) == key:
                    end += 1
                graph = graph or opened(rows)
                nodes, levels, vectors, ids = graph
                raw = b.column("vector").slice(start, end - start).to_pylist()
                x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
                hits = walked(nodes, levels, lifted(x, 1.0)[0], most)
                out: list = []
                for k, (name, own) in enumerate(zip(b.column("query").slice(start, end - start).to_pylist(), hits)):
                    own = own[own >= 0]
                    score = np.add.accumulate(vectors[own] * x[k], axis=1)[:, -1]  # summed in the components' order
                    told = 0
                    for s, group in sorted(((-float(s), ids[p]) for s, p in zip(score, own.tolist())), key=lambda e: e[0]):
                        if told > top and -s < last:
                            break
                        out += [(name, i, -s) for i in group]
                        told, last = told + len(group), -s
                cols = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "vec_id", "score"])
                start = end

    return run


def nearest(
    vectors: DataFrame, query: Column, top: int = 20, shard: int = 16384, block: int = 65536, most: int = 192, salts: int = 16,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows that meet ``query`` (a condition on ``vec_id``) the ``top`` nearest found.

    ``shard`` nodes make one graph, ``block`` queries follow it in one stream, ``most`` candidates are held while walking.
    """
    v = stored(classes(vectors, id_col, vec_col).where("vec_hash is not null"), "graph-all")
    first = F.row_number().over(W.partitionBy("vec_hash", "vector").orderBy("vec_id"))
    few = v.select("vec_hash", "vec_id", "vector").withColumn("place", first).where(F.col("place") <= top + 1)
    node = few.groupBy("vec_hash", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("query", F.monotonically_increasing_id()).withColumn("dims", (F.octet_length("vector") / 8).cast("int"))
    node = stored(node, "graph-nodes")
    dealt = node.join(node.groupBy("dims").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("shards")), "dims")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("query"), F.col("shards")).cast("long"))
    graphs = dealt.select("shard", "dims", "vector", "ids", "vec_hash").repartition("shard", "dims").sortWithinPartitions("shard", "dims", "vec_hash").drop("vec_hash").mapInArrow(_graphs, _GRAPH)
    graphs = stored(graphs, "graph-levels")
    asked = v.where(query).select(F.col("vec_id").alias("query_id"), "vec_hash", "vector")
    names = stored(asked.select("vec_hash", "vector").distinct().join(node, ["vec_hash", "vector"]).select("query", "dims", "vector", "vec_hash"), "graph-queries")
    names_in, many = blocks(names, block, "block", "query")
    shards = graphs.where("level = 0").groupBy("dims").agg((F.max("shard") + 1).alias("shards"))
    sent = names_in.join(shards, "dims").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    sent = sent.select("shard", "dims", F.lit(1).alias("kind"), "block", "query", "vector")
    laid = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    met = laid.unionByName(sent, allowMissingColumns=True).repartition("shard", "block", "dims").sortWithinPartitions("shard", "block", "dims", "kind", "level")
    found = met.mapInArrow(_found(top, most), "query bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    # one id more than is told, for the query's own
    best = found.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("place") <= top + 1)
    told = best.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))).alias("near"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    near = names.join(told, "query").select("vec_hash", "vector", "near", spread)
    each = asked.distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int")).join(near, ["vec_hash", "vector", "salt"])
    got = each.select("query_id", F.posexplode(F.slice(F.array_sort(F.filter("near", lambda x: x["i"] != F.col("query_id"))), 1, top)).alias("rank", "x"))
    return got.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
