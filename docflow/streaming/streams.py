"""Structured Streaming operators with keyed state.

Rows of a key wait in its state until the watermark passes them and are then folded in event-time order, so the result does not
depend on how micro-batches cut the stream.  Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import apply_changes
from .folds import COOLDOWN_S, MATCHES, PAUSE_MS, QUOTA


def _ordered(stream: DataFrame, key: str, payload: list[str], schema: str, fold, delay: str, idle_ms: int | None = None, end=None) -> DataFrame:
    """Fold each key's rows in event-time order; ``fold(memory, ts_ms, row) → (memory, output rows)``.

    With ``idle_ms``, a key that is silent for so long after its last row, by the watermark, gives ``end(memory)`` and leaves no state.
    """
    names = [f.split()[0] for f in schema.split(", ")][1:]

    def step(k, batches, state):
        waiting, memory, last = map(json.loads, state.get) if state.exists else ([], None, None)
        if not state.hasTimedOut:
            for b in batches:
                ts = (b["event_time"].astype("int64") // 1000 if b["event_time"].dt.unit == "us" else b["event_time"].astype("int64") // 1_000_000).tolist()
                waiting += [[int(t), *(None if v is None or v != v else v for v in row)] for t, row in zip(ts, b[payload].astype(object).values.tolist())]
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], str(r[1:])))
        out, done = [], 0
        while done < len(waiting) and waiting[done][0] < mark:
            last, *row = waiting[done]
            memory, rows = fold(memory, last, row)
            out += rows
            done += 1
        waiting = waiting[done:]
        over = idle_ms is not None and last is not None and not waiting and last + idle_ms < mark
        if over:
            out += end(memory)
            state.remove()
        else:
            state.update((json.dumps(waiting), json.dumps(memory), json.dumps(last)))
            due = waiting[0][0] if waiting else last + idle_ms if idle_ms is not None and last is not None else None
            if due is not None:
                state.setTimeoutTimestamp(max(due, mark) + 1)
        yield pd.DataFrame([[k[0], *r] for r in out], columns=[key, *names])

    rows = stream.withWatermark("event_time", delay).select(key, "event_time", *payload)
    return rows.groupBy(key).applyInPandasWithState(step, schema, "waiting string, memory string, last string", "append", "EventTimeTimeout")


def state_counts(query) -> dict[str, int]:
    """Of a streaming query: rows that came behind the watermark and were dropped, and keys that hold state now."""
    progress = [op for p in query.recentProgress for op in p["stateOperators"]]
    return {"late": sum(op["numRowsDroppedByWatermark"] for op in progress), "keys": progress[-1]["numRowsTotal"] if progress else 0}


def detections(frames: DataFrame, delay: str = "1 second") -> DataFrame:
    """Stream of ``frames (camera_id, event_time, frame_id, codes ARRAY<STRING>)`` → confirmed frames (see ``folds.stable_detections``)."""

    def fold(memory, t, row):
        frame, codes = row[0], json.loads(row[1])
        last, n, till = memory or [[], 0, None]
        if till is not None and t < till:
            return memory, []
        if not codes:
            return [[], 0, till], []
        n = n + 1 if codes == last else 1
        if n >= MATCHES:
            return [codes, n, t + PAUSE_MS], [[int(frame), t, ",".join(codes)]]
        return [codes, n, till], []

    s = frames.withColumn("codes", F.to_json(F.array_sort("codes")))
    return _ordered(s, "camera_id", ["frame_id", "codes"], "camera_id bigint, frame_id bigint, t_ms bigint, codes string", fold, delay)


def admissions(requests: DataFrame, delay: str = "1 second") -> DataFrame:
    """Stream of ``requests (user_id, event_time, event_id, kind)`` → ``(user_id, event_id, t_ms, admitted)``; the checkpoint keeps the quota over restarts."""

    def fold(memory, t, row):
        n, since = memory or [0, None]
        if row[1] == "grant":
            return [QUOTA - 1, None], []
        if since is not None and t - since < COOLDOWN_S * 1000:
            return memory, [[int(row[0]), t, False]]
        n = 1 if since is not None else n + 1
        return [n, t if n >= QUOTA else None], [[int(row[0]), t, True]]

    return _ordered(requests, "user_id", ["event_id", "kind"], "user_id bigint, event_id bigint, t_ms bigint, admitted boolean", fold, delay)


def live_responses(chunks: DataFrame, delay: str = "1 second", every_ms: int = 100, idle_ms: int = 90_000) -> DataFrame:
    """Stream of ``chunks (response_id, event_time, seq, payload)`` → ``(response_id, seq, text, final)``: the running text at most every 100 ms,
    and the final text, without reasoning, at ``[DONE]``.

    A stream that breaks off is given up after ``idle_ms`` without a row: what it has said, if anything, becomes its final text.  After that
    silence a response holds no state, whether it ended or broke off; rows that come later than that start it anew.
    """

    def final(text, seq):
        said = re.sub(r"(?s)<think>.*?(?:</think>\s*|$)", "", text).strip()
        return [[seq, said, True]] if said else []

    def fold(memory, t, row):
        text, shown, done, _ = memory or ["", None, False, None]
        seq, payload = None if row[0] is None else int(row[0]), row[1] or ""
        if done or not payload.startswith("data:"):
            return [text, shown, done, seq], []
        piece = payload[5:].strip()
        if piece == "[DONE]":
            return ["", shown, True, seq], final(text, seq)
        text += piece
        if piece and (shown is None or t - shown >= every_ms):
            return [text, t, False, seq], [[seq, text, False]]
        return [text, shown, False, seq], []

    def end(memory):
        text, _, done, seq = memory
        return [] if done else final(text, seq)

    return _ordered(chunks, "response_id", ["seq", "payload"], "response_id bigint, seq bigint, text string, final boolean", fold, delay, idle_ms, end)


HISTORY = "owner string, id string, text string, image_uri string, ts_ms bigint"


def maintain_history(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Apply a change stream to the history table under ``path``, copy on write by bucket of owners.

    A batch reads the buckets that its owners are in, writes their new state as ``data/v=<batch>/bucket=<n>``, and then a manifest that names
    each bucket's newest version; buckets without a change are not touched.  A batch that runs again starts from the
    manifest before its own and overwrites what it wrote.  Returns the running query; ``newest(spark, path)`` reads the table, ``vacuum`` removes
    versions that no kept manifest names.
    """
    bucket = F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
            held = manifest(spark, path, before=number)
            old = _read(spark, path, {b: v for b, v in held.items() if b in touched})
            new = apply_changes(old, batch).withColumn("bucket", bucket)
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={number}")
        finally:
            batch.unpersist()
        held = {b: v for b, v in held.items() if b not in touched}  # a bucket whose owners are all gone has no version
        held |= {b: number for b in touched if _exists(spark, f"{path}/data/v={number}/bucket={b}")}
        spark.createDataFrame(list(held.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _manifests(spark, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and _exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def manifest(spark, path: str, before: int | None = None) -> dict[int, int]:
    """The newest finished manifest (before a given batch): each bucket's version."""
    done = [n for n in _manifests(spark, path) if before is None or n < before]
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").parquet(f"{path}/manifest/n={done[-1]}").collect()} if done else {}


def _read(spark, path: str, versions: dict[int, int]) -> DataFrame:
    files = [f"{path}/data/v={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.schema(HISTORY).parquet(*files) if files else spark.createDataFrame([], HISTORY)


def newest(spark, path: str, before: int | None = None) -> DataFrame:
    """The table as of the newest finished batch (before a given one)."""
    return _read(spark, path, manifest(spark, path, before))


def vacuum(spark, path: str, keep: int = 2) -> int:
    """Remove all manifests but the newest ``keep``, and the bucket versions that none of those names; how many versions went."""
    every = _manifests(spark, path)
    kept = {(b, v) for n in every[-keep:] for b, v in manifest(spark, path, before=n + 1).items()}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for s in fs.globStatus(fs_path(f"{path}/data/v=*/bucket=*")) or []:
        at = s.getPath()
        if (int(at.getName()[7:]), int(at.getParent().getName()[2:])) not in kept:
            gone += fs.delete(at, True)
    for n in every[:-keep]:
        fs.delete(fs_path(f"{path}/manifest/n={n}"), True)
    return gone
