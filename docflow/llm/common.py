"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in local runs (tests) is one made, on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="docflow-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frugal() -> None:
    """Called where a task begins: what it frees from then on goes back to the system at once, also after ``returned``, when the
    task's own arrays and batches go.  Arrow takes its memory from malloc, and blocks beyond 1 MB are mapped one by one."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; set by hand, it stays
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not glibc
        pass


def returned() -> None:
    """Give freed memory back to the system: workers are used again, and what one task has held adds to the next one's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, and let Spark clear the shuffles of finished jobs: those that the driver
    has forgotten, which it notices when it collects its garbage."""
    import gc

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def fold(col, parts: int):
    """crc32 of the column as text, modulo ``parts``; null ids count as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("null"))), F.lit(parts))


def thinned(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges ``(a, b)`` that connect what ``edges`` connect: a spanning forest of every ``most`` edges or so.

    A group of copies that are all linked with each other keeps about one edge a member.
    """

    def run(batches):
        root: dict[int, int] = {}

        def find(i: int) -> int:
            root.setdefault(i, i)
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for batch in batches:
            a, b = [], []
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    return held.repartition(max(1, -(-held.count() // most))).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """Connected components of undirected ``edges (a, b)`` as ``(id, component_id)``, component_id the smallest id.

    Rounds of min-label spreading along edges and pointer jumping; only vertices that have an edge appear.  The join of
    edges with labels is salted, so that a vertex with very many edges is split over tasks, and the minimum is
    pre-aggregated.  Each round is written to the shared folder.
    """
    both = stored(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
        .withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")),
        "edges",
    )
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label", spread), ["b", "salt"])
        best = near.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(best, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        # a label that is far from its own root moves on to its label's label; labels are ids of the same component
        hot = jump.where("label <> far").select("label", "far", spread)
        step = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        step = stored(
            step.join(hot, ["label", "salt"], "left").select("id", "old", F.coalesce("far", "label").alias("label")), "labels"
        )
        if step.where("old <> label").isEmpty():
            return step.select("id", F.col("label").alias("component_id"))
        labels = step.select("id", "label")


def runs_of(batches, *keys: str):
    """Batches sorted by ``keys`` as one table for each run of rows with equal keys; holds one run and one batch."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edge = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(edge[:-1], edge[1:]):
            now = tuple(c[s] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def blocks(rows: DataFrame, size: int, column: str, *by: str) -> tuple[DataFrame, int]:
    """``rows`` with a ``column`` that deals them by the hash of ``by`` into so many blocks that one holds ``size`` rows or so."""
    many = max(1, -(-rows.count() // size))
    return rows.withColumn(column, F.pmod(F.xxhash64(*by), F.lit(many)).cast("int")), many


def every_block(rows: DataFrame, column: str, many: int) -> DataFrame:
    """``rows`` once for each of ``many`` blocks of the other side."""
    return rows.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
