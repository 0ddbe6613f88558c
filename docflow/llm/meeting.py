"""Rows that meet in hashed keys: the keys that several rows hold, a leader for each row, and pairs dealt beside their leader.

Shared by the operators on pairs.  A group of copies meets in very many keys; so its members are first compared with their
leader alone, and only members that are still apart are paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, returned, stored
from .tokens import gaps, narrow, runs, ungapped, widened

KEY_BITS = 48
_SENT = "bucket bigint, keys binary, ids binary, met binary, many binary"


def shared_keys(rows: DataFrame, total: int, tile: int, per_bucket: int = 400_000, buffer: int = 2_000_000) -> DataFrame:
    """``(cell, id, flag, lead)`` of the entries of ``rows (id, keys)`` whose cell at least two different ids hold; some may come twice.
    For cells with more than ``tile`` entries there is one more row, without an id.

    ``keys`` holds ``total`` numbers of KEY_BITS bits altogether, by ``narrow``; their two lowest bits are lead and flag, the rest
    the cell.
    Tasks send what they hold as arrays to buckets of cells: a cell in which two ids meet inside a task is known to be
    shared, its entries go on as they are, and the bucket only hears of it once; so a bucket gets at most one entry of a
    cell from each task's buffer, however many rows hold it.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total / per_bucket)))))
    buckets = 1 << bits
    shift = np.uint64(KEY_BITS - bits)

    def send(batches):
        frugal()
        held_k: list[np.ndarray] = []
        held_i: list[np.ndarray] = []
        size = 0

        def out():
            key, ids = np.concatenate(held_k), np.concatenate(held_i)
            order = np.argsort(key)
            key, ids = key[order], ids[order]
            start = runs(key >> np.uint64(2))
            low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
            met = low != high
            rows = []
            inside = np.repeat(met, np.diff(np.append(start, len(key))))
            k, i = key[inside], ids[inside]
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            k, i = k[fresh], i[fresh]
            for s in range(0, len(k), 100_000):
                rows.append((buckets + int(k[s] ^ i[s].view(np.uint64)) % max(buckets, 64), gaps(k[s : s + 100_000]), i[s : s + 100_000].tobytes(), b"", b""))
            k, many = key[start], np.diff(np.append(start, len(key)))
            edge = np.searchsorted(k >> shift, np.arange(buckets + 1, dtype=np.uint64)).tolist()
            for b in range(buckets):
                e = slice(edge[b], edge[b + 1])
                if e.start < e.stop:
                    rows.append((b, gaps(k[e]), low[e].tobytes(), np.packbits(met[e]).tobytes(), narrow(many[e])))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "ids", "met", "many"])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = [widened(x) for x in part.column(1).to_pylist()]
                held_k += raw
                held_i.append(np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in raw]))
                size += len(held_i[-1])
                if size >= buffer:
                    yield from out()
                    held_k, held_i, size = [], [], 0
        if size:
            yield from out()
        held_k, held_i = [], []
        returned()

    def meet(t: pa.Table) -> pa.Table:
        many = [ungapped(x) for x in t.column("keys").to_pylist()]
        key, ids = np.concatenate(many), np.frombuffer(b"".join(t.column("ids").to_pylist()), "<i8")
        hot = np.zeros(0, np.uint64)
        if t.column("bucket")[0].as_py() < buckets:
            count = np.concatenate([widened(x) for x in t.column("many").to_pylist()]).astype(np.int64)
            met = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(t.column("met").to_pylist(), many)]).astype(bool)
            order = np.argsort(key)
            key, ids, met = key[order], ids[order], met[order]
            start = runs(key >> np.uint64(2))
            shared = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) | np.logical_or.reduceat(met, start)
            size = np.add.reduceat(count[order], start)
            hot = key[start[(size > tile) & shared]] & ~np.uint64(3)
            own = np.repeat(shared, np.diff(np.append(start, len(key)))) & ~met
            key, ids = np.concatenate([key[own], hot]), ids[own]
        return pa.table({"cell": pa.array((key >> np.uint64(2)).view(np.int64)), "id": pa.concat_arrays([pa.array(ids), pa.nulls(len(hot), pa.int64())]), "flag": pa.array((key & np.uint64(1)).astype(bool)), "lead": pa.array((key & np.uint64(2)).astype(bool))})

    sent = rows.select("id", "keys").where("id is not null and keys is not null").mapInArrow(send, _SENT)
    return sent.groupBy("bucket").applyInArrow(meet, "cell bigint, id bigint, flag boolean, lead boolean")


def picked(leading: DataFrame) -> DataFrame:
    """``(id, met, cell)``: how many entries of ``leading (cell, id)`` an id has, and two of its cells (one, if it has no other): those of the
    smallest and the largest hash, which members of a group that share their cells choose alike."""
    mark = F.struct(F.xxhash64("cell"), "cell")
    ends = leading.groupBy("id").agg(F.count("*").alias("met"), F.min(mark)["cell"].alias("lo"), F.max(mark)["cell"].alias("hi"))
    return ends.select("id", "met", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("cell"))


def parents(members: DataFrame) -> DataFrame:
    """``(a, b)``: for each id ``b`` of ``members (cell, id, lead)`` the leader ``a`` that it meets in a leading cell, if it isn't one itself.

    A cell's leader is the id that meets others in the most cells (the larger on ties): the original of a group of edited copies
    shares every cell with some of them.  An id follows the better leader of two of its cells, so that ids meet leaders in no more than two
    rows each; an id that misses its leader that way is still apart, and paired with the rest.
    """
    m = members.where("lead").select("cell", "id")
    met = m.groupBy("id").agg(F.count("*").alias("met"))
    leader = m.join(met, "id").groupBy("cell").agg(F.max(F.struct("met", "id")).alias("top"))
    best = picked(m).join(leader, "cell").groupBy("id").agg(F.max("top").alias("top"))
    return best.where(F.col("top.id") != F.col("id")).select(F.col("top.id").alias("a"), F.col("id").alias("b"))


def followed(few: DataFrame, many: DataFrame, turn: int, least: int) -> DataFrame:
    """``(a, b)``: for each id ``b`` of the cells of ``apart`` at most one id ``a`` of another label: of the cells' leaders the one that it meets most
    often, ``least`` times at least.

    A cell's leader is its id of the largest hash, another one each ``turn``; members of a group, which share many cells, so meet the same few leaders.
    """

    def led(m: DataFrame) -> DataFrame:
        leader = m.groupBy("cell").agg(F.max(F.struct(F.xxhash64(F.lit(turn), "id").alias("mark"), "id", "label")).alias("top"))
        return m.join(small_enough(leader), "cell").where(F.col("top.label") != F.col("label")).select("cell", "id", F.col("top.id").alias("top"))

    each = led(few.select("cell", "id", "label").distinct()).union(led(many.select("cell", "id", "label").distinct()))
    n = each.groupBy("id", "top").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.groupBy("id").agg(F.max(F.struct("n", "top"))["top"].alias("a")).select("a", F.col("id").alias("b"))


def small_enough(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (narrow) rows; else joins shuffle both sides."""
    return F.broadcast(df) if df.count() <= most else df


def apart(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct ``(cell, id, flag, label)`` of cells in which different labels (of ``labels (id, label)``, else the id) meet: those
    of ordinary cells, and those of cells marked as large, with their size ``n``."""
    large = small_enough(stored(members.where("id is null").select("cell").distinct(), "meeting-large"))
    named = members.where("id is not null").join(small_enough(labels), "id", "left").select((F.col("cell") * 2 + F.col("flag").cast("long")).alias("entry"), "cell", "id", "label")

    def run(batches):
        frugal()
        held: list[pa.Table] = []

        def out(t: pa.Table):
            entry, ids, label = (t.column(c).to_numpy() for c in ("entry", "id", "label"))
            cell = entry >> 1
            start = runs(cell)
            mixed = np.repeat(np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start), np.diff(np.append(start, len(cell))))
            mixed[1:] &= (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1])
            got = pa.table({"cell": pa.array(cell[mixed]), "id": pa.array(ids[mixed]), "flag": pa.array((entry[mixed] & 1).astype(bool)), "label": pa.array(label[mixed])})
            yield from got.to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            label = pc.coalesce(batch.column(2), batch.column(1))
            held.append(pa.table([batch.column(0), batch.column(1), label], names=["entry", "id", "label"]))
            if sum(h.num_rows for h in held) < 50_000:
                continue
            t = pa.concat_tables(held)
            cell = t.column("entry").to_numpy() >> 1
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield from out(t.slice(0, last))
            held = [t.slice(last)]
        if held:
            yield from out(pa.concat_tables(held))
        held = []
        returned()

    few = named.join(large, "cell", "left_anti").select("entry", "id", "label")
    few = few.repartition(F.expr("entry div 2")).sortWithinPartitions("entry", "id").mapInArrow(run, "cell bigint, id bigint, flag boolean, label bigint")
    # a large cell's labels are told by a row a cell, so that only entries of cells that are still apart meet it, once
    label = F.coalesce("label", "id")
    sizes = named.groupBy("cell").agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("n"))
    mixed = stored(sizes.join(large, "cell").where("lo <> hi").select("cell", "n"), "meeting-mixed")
    many = named.join(small_enough(mixed), "cell").select("cell", "n", "id", (F.col("entry") % 2 == 1).alias("flag"), label.alias("label"))
    return few, many.distinct()


def tiles(hot: DataFrame, tile: int) -> DataFrame:
    """Rows of cells of ``n`` members, once for each pair of leaves of about ``tile // 2`` that they are in: ``tile`` names the pair,
    ``side`` the leaf of it (0 for both if it is one leaf)."""
    many = F.ceil(F.col("n") / F.lit(tile // 2)).cast("int")
    leafed = hot.withColumn("leaf", F.pmod(F.xxhash64("id"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return leafed.withColumn("tile", F.least("leaf", "other").cast("long") * (1 << 20) + F.greatest("leaf", "other")).withColumn("side", (F.col("leaf") > F.col("other")).cast("int")).drop("leaf", "other")


def dealt(pairs: DataFrame, tile: int = 4096) -> DataFrame:
    """The roles ``(key, salt, tail, id)`` of distinct ``pairs (a, b)``: each ``b`` (tail 1) beside its ``a`` (tail 0); at most about ``tile`` tails a salt."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("salts"))
    tails = pairs.join(salts, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tail"), F.col("b").alias("id"))
    heads = salts.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tail"), F.col("a").alias("id"))
    return tails.unionByName(heads)


def beside(roles: DataFrame) -> DataFrame:
    """Rows of ``dealt`` with their items, each head right before its tails."""
    return roles.repartition("key", "salt").sortWithinPartitions("key", "salt", "tail")
