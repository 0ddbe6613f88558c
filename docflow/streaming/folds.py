"""Batch forms of the keyed stream operators: a key's sorted events pass through a state, in as many tasks as they fill.

Events are range-partitioned by key and order, so that a long history is cut into chunks of bounded size.  What a chunk does to any state
that may come in is summed up without knowing it (``Quota.summary``, ``Sightings.summary``): events in the chunk are followed backwards, each with the
state that leaves the chunk if the fold stands there.  A short pass chains the summaries of a key, and every chunk is then folded by
itself from the state that reaches it.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Matches before a detection, the pause after one in ms; requests before a cooldown, its length in seconds.
MATCHES, PAUSE_MS, QUOTA, COOLDOWN_S = 2, 100, 5, 300


def _first(times: list, at: int, low) -> int:
    """The first event from ``at`` on at ``low`` or later; events without a time come first and never wait."""
    if at < len(times) and times[at] is None:
        return at
    return bisect_left(times, low, at)


class Quota:
    """State: requests counted since it opened (the last one closes it), or when it closed, as ``[count, None]`` or ``[None, since]``."""

    begin = (0, None)

    @staticmethod
    def run(state, rows: list[tuple]) -> list[bool | None]:
        n, since = state
        told: list[bool | None] = []
        for t, _, kind in rows:
            if kind == "grant":
                n, since = QUOTA - 1, None
                told.append(None)
            elif since is not None and t is not None and t - since < COOLDOWN_S:
                told.append(False)
            else:
                n = 1 if since is not None else min(n + 1, QUOTA)
                since = t if n >= QUOTA else None
                n = min(n, QUOTA - 1)
                told.append(True)
        return told

    @staticmethod
    def summary(rows: list[tuple]) -> list:
        """What leaves the chunk for each count that comes in, and for a closed quota by the event that opens it."""
        times, end = [t for t, *_ in rows], len(rows)
        leaves = [[n, None] for n in range(QUOTA)]
        after = [leaves]  # by the number of events that follow: what leaves if it stands open with n before them
        grant = end
        for i in range(end - 1, -1, -1):
            t, _, kind = rows[i]
            if kind == "grant":
                grant = i
                after.append([after[-1][QUOTA - 1]] * QUOTA)
                continue
            if t is None:
                closing = after[-1][QUOTA - 1]
            else:
                j = min(grant, bisect_left(times, t + COOLDOWN_S, i + 1))
                closing = [None, t] if j == end else after[end - j - 1][QUOTA - 1 if j == grant else 1]
            after.append([*after[-1][1:], closing])
        first = [k for k in range(end) if times[k] is not None]
        opens: list[list] = []  # a quota closed at s is opened by the first of these at s + COOLDOWN_S or later
        for k in range(first[0] if first else 0, min(grant, end)):
            if times[k] is not None:
                leave = after[end - k - 1][1]
                if opens and (opens[-1][1] == leave or opens[-1][0] == times[k]):
                    if opens[-1][0] != times[k]:
                        opens[-1][0] = times[k]
                else:
                    opens.append([times[k], leave])
                if times[k] >= times[first[0]] + COOLDOWN_S:
                    break
        early = first[0] if first else end  # an event without a time opens at once
        without = None if early == 0 or grant == 0 else after[end - 1][1]
        return [after[-1], opens, after[end - grant - 1][QUOTA - 1] if grant < end else None, without]

    @staticmethod
    def passed(state, summary):
        n, since = state
        leaves, opens, granted, without = summary
        if since is None:
            return leaves[n]
        if without is not None:
            return without
        at = bisect_left(opens, since + COOLDOWN_S, key=lambda o: o[0])
        return opens[at][1] if at < len(opens) else granted or state


class Sightings:
    """State: the codes of the last frame that counted, and until when frames are ignored."""

    begin = ([], None)

    @staticmethod
    def run(state, rows: list[tuple]) -> list[bool | None]:
        last, till = state
        told: list[bool | None] = []
        for t, _, codes in rows:
            if till is not None and t is not None and t < till:
                told.append(None)
                continue
            hit = bool(codes) and codes == last
            last, till = codes, t + PAUSE_MS if hit and t is not None else None
            told.append(True if hit else None)
        return told

    @staticmethod
    def summary(rows: list[tuple]) -> list:
        """For each frame that may be the chunk's first to count: its codes, and what leaves if it is not, or is, confirmed."""
        times, end = [t for t, *_ in rows], len(rows)
        after: list = [None] * end
        for i in range(end - 1, -1, -1):
            t, _, codes = rows[i]
            both = []
            for hit in (False, True):
                till = t + PAUSE_MS if hit and t is not None else None
                j = i + 1 if till is None else _first(times, i + 1, till)
                both.append([codes, till] if j == end else after[j][bool(codes) and rows[j][2] == codes])
            after[i] = both
        most = 0 if times[0] is None else _first(times, 0, times[0] + PAUSE_MS)
        return [[times[k], rows[k][2], *after[k]] for k in range(min(end, most + 1))]

    @staticmethod
    def passed(state, summary):
        last, till = state
        for t, codes, plain, hit in summary:
            if till is None or t is None or t >= till:
                return hit if codes and codes == last else plain
        return state


def _chunks(batches, key: str, order: list[str], most: int):
    """Runs of one key, ``most`` rows at most: the key and the batches' slices."""
    held: list[pa.RecordBatch] = []
    last = size = None
    for b in batches:
        keys = b.column(key).to_pylist()
        start = 0
        while start < len(keys):
            end = start
            room = most - size if held and (keys[start],) == last else most
            while end < len(keys) and keys[end] == keys[start] and end - start < room:
                end += 1
            if held and ((keys[start],) != last or size >= most):
                yield last[0], held
                held, size = [], 0
            if end > start:
                held.append(b.slice(start, end - start))
                size, last = (size or 0) + end - start, (keys[start],)
            start = end
    if held:
        yield last[0], held


def _rows(batches: list[pa.RecordBatch], order: list[str]) -> list[tuple]:
    return [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in order))]


def folded(rows: DataFrame, fold, key: str, order: list[str], told: str | None, keep: list[str], tasks: int | None = None, most: int = 200_000) -> DataFrame:
    """Rows in ``order`` through ``fold`` for each key; rows that it drops (None) are gone, ``told`` names its answer for the others.

    ``tasks`` range partitions (the session's number of shuffle partitions unless given), chunks of ``most`` rows.
    """
    columns = list(dict.fromkeys([*keep, key, *order]))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}

    def number(batches):
        part = TaskContext.get().partitionId()
        for n, (k, held) in enumerate(_chunks(batches, key, order, most)):
            chunk = (part << 32) + n
            for b in held:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([chunk] * len(b), pa.int64()), pa.nulls(len(b), pa.string())], names=[*columns, "chunk", "summary"])
            sums = json.dumps(fold.summary(_rows(held, order)))
            one = held[0].slice(0, 1)
            yield pa.RecordBatch.from_arrays([*(one.column(c) for c in columns), pa.array([chunk], pa.int64()), pa.array([sums], pa.string())], names=[*columns, "chunk", "summary"])

    def chained(batches):
        last, state = None, None
        for b in batches:
            states = []
            for k, s in zip(b.column(key).to_pylist(), b.column("summary").to_pylist()):
                if (k,) != last:
                    last, state = (k,), fold.begin
                states.append(json.dumps(state))
                state = fold.passed(state, json.loads(s))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(states, pa.string())], names=["chunk", "state"])

    def run(batches):
        for _, held in _chunks(batches, "chunk", order, 1 << 62):
            said = fold.run(json.loads(held[0].column("state")[0].as_py()), _rows(held, order))
            start = 0
            for b in held:
                own = said[start : start + len(b)]
                start += len(b)
                at = [n for n, x in enumerate(own) if x is not None]
                out = b.select(keep).take(pa.array(at, pa.int64()))
                yield out if told is None else pa.RecordBatch.from_arrays([*out.columns, pa.array([own[n] for n in at], pa.bool_())], names=[*keep, told])

    by = [F.col(c) for c in (key, *order)]
    dealt = rows.select(*columns)
    dealt = dealt.repartitionByRange(tasks, *by) if tasks else dealt.repartitionByRange(*by)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    cuts = cut(dealt.sortWithinPartitions(*by).mapInArrow(number, f"{schema}, chunk bigint, summary string"))
    sums = cuts.where("summary is not null").select(key, "chunk", "summary").repartition(key).sortWithinPartitions(key, "chunk")
    states = cut(sums.mapInArrow(chained, "chunk bigint, state string"))
    ready = cuts.where("summary is null").drop("summary").join(states, "chunk")
    ready = (ready.repartition(tasks, "chunk") if tasks else ready.repartition("chunk")).sortWithinPartitions("chunk", *order)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (f", {told} boolean" if told else "")
    return ready.mapInArrow(run, out)


def stable_detections(frames: DataFrame, tasks: int | None = None) -> DataFrame:
    """``frames (camera_id, frame_id, t_ms, raw)`` → ``(camera_id, frame_id, t_ms, codes)`` of confirmed frames.

    An empty frame resets; the same set as before counts on, another starts at 1; from 2 on a frame is confirmed, and frames
    less than 100 ms after are ignored (they change nothing).  Frames without a time come first and are never ignored.
    """
    f = frames.groupBy("camera_id", "frame_id").agg(F.min("t_ms").cast("long").alias("t_ms"), F.array_sort(F.collect_set("raw")).alias("codes"))
    return folded(f, Sightings, "camera_id", ["t_ms", "frame_id", "codes"], None, ["camera_id", "frame_id", "t_ms", "codes"], tasks)


def admit_requests(requests: DataFrame, tasks: int | None = None) -> DataFrame:
    """``requests (user_id, event_id, t_s[, kind, own_key])`` → ``(user_id, event_id, t_s, admitted)``.

    Five are admitted, then a user is closed for 300 s from the fifth; a request at 300 s or later starts at 0 and is admitted.  Below five
    nothing decays.  A ``grant`` sets the count to 4 and opens (and is no request); users on their own key pass by.  Requests without
    a time come first, are admitted and close nothing.
    """
    for name, default in (("kind", "request"), ("own_key", False)):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(default))
    r = requests.where("not own_key").select("user_id", F.col("event_id").cast("long").alias("event_id"), F.col("t_s").cast("long").alias("t_s"), "kind")
    held = folded(r, Quota, "user_id", ["t_s", "event_id", "kind"], "admitted", ["user_id", "event_id", "t_s"], tasks)
    free = requests.where("own_key and kind <> 'grant'").select("user_id", "event_id", F.col("t_s").cast("long").alias("t_s"), F.lit(True).alias("admitted"))
    return held.unionByName(free)
