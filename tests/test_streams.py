"""Stream operators against their batch folds; a late sentinel row moves the watermark past the rest."""

import glob
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docflow.streaming import folds, streams


def run(spark, df, op, name):
    src, ck = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    end = F.unix_timestamp("event_time") > 5000  # the sentinel comes last, or what comes after it is late
    df.where(~end).repartition(3).write.mode("overwrite").parquet(src)
    df.where(end).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = op(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_detections_match_fold(spark):
    rows = [(i, i % 2, 60_000 + (i // 2) * 60, None if i // 2 % 5 == 4 else f"c{i // 6 % 2}") for i in range(60)]
    frames = spark.createDataFrame(rows, "frame_id long, camera_id long, t_ms long, raw string")
    want = {(r.camera_id, r.frame_id) for r in folds.stable_detections(frames).collect()}
    s = frames.groupBy("camera_id", "frame_id", "t_ms").agg(F.collect_set("raw").alias("codes"))
    end = spark.createDataFrame([(9, -1, 10_000_000)], "camera_id long, frame_id long, t_ms long").withColumn("codes", F.expr("cast(array() as array<string>)"))
    s = s.unionByName(end).withColumn("event_time", F.timestamp_millis("t_ms")).select("camera_id", "event_time", "frame_id", "codes")
    got = {(r.camera_id, r.frame_id) for r in run(spark, s, lambda d: streams.detections(d, "1 hour"), "det")}
    assert got == want and want


def test_admissions_match_fold(spark):
    rows = [(i, i % 2, 60 + i * 9) for i in range(120)]
    req = spark.createDataFrame(rows, "event_id long, user_id long, t_s long")
    want = {(r.event_id, r.admitted) for r in folds.admit_requests(req).collect()}
    s = req.unionByName(spark.createDataFrame([(-1, 9, 10_000_000)], "event_id long, user_id long, t_s long"))
    s = s.select("user_id", F.timestamp_millis(F.col("t_s") * 1000).alias("event_time"), "event_id", F.lit("request").alias("kind"))
    got = {(r.event_id, r.admitted) for r in run(spark, s, lambda d: streams.admissions(d, "1 hour"), "adm") if r.event_id >= 0}
    assert got == want


def test_folds_hold_no_key_in_one_row(spark):
    frames = spark.range(4000).selectExpr("id AS frame_id", "0L AS camera_id", "id * 60 AS t_ms", "CASE WHEN id % 7 < 5 THEN concat('c', id div 7 % 2) END AS raw")
    till, last, n, want = -1, None, 0, set()
    for i in range(4000):
        if i * 60 < till:
            continue
        code = f"c{i // 7 % 2}" if i % 7 < 5 else None
        n = 0 if code is None else n + 1 if code == last else 1
        last = code
        if n >= 2:
            till = i * 60 + 100
            want.add(i)
    found = folds.stable_detections(frames)
    admitted = folds.admit_requests(spark.range(4000).selectExpr("id AS event_id", "0L AS user_id", "id * 10 AS t_s"))
    assert {r.frame_id for r in found.collect()} == want and want
    # five are admitted, the fifth closes for 30 requests; the next opens a count of 1
    n, since, passed = 0, None, set()
    for i in range(4000):
        if since is not None and i * 10 - since < 300:
            continue
        n, since = (1, None) if since is not None else (n + 1, i * 10 if n == 4 else None)
        passed.add(i)
    got = admitted.collect()
    assert len(got) == 4000 and {r.event_id for r in got if r.admitted} == passed
    for d in (found, admitted):
        assert "collect_list" not in d._jdf.queryExecution().toString()


def plain_quota(rows):
    n, since, out = 0, None, []
    for t, _, kind in rows:
        if kind == "grant":
            n, since = folds.QUOTA - 1, None
            out.append(None)
        elif since is not None and t is not None and t - since < folds.COOLDOWN_S:
            out.append(False)
        else:
            n, since = (1, None) if since is not None else (n + 1, t if n + 1 >= folds.QUOTA else None)
            out.append(True)
    return out


def plain_sightings(rows):
    last, n, till, out = [], 0, None, []
    for t, _, codes in rows:
        if till is not None and t is not None and t < till:
            out.append(None)
            continue
        n = 0 if not codes else n + 1 if codes == last else 1
        hit, last = bool(codes) and codes == last and n >= folds.MATCHES, codes
        if hit:
            till = None if t is None else t + folds.PAUSE_MS
        out.append(True if hit else None)
    return out


@pytest.mark.parametrize("fold, plain, choices", [(folds.Quota, plain_quota, ["grant"] + ["request"] * 30), (folds.Sightings, plain_sightings, [[], ["a"], ["a", "b"]])])
def test_summaries_of_chunks_compose(fold, plain, choices):
    """Whatever the cuts, the states chained through summaries are those of the whole history."""
    rng = random.Random(1)
    for _ in range(1500):
        step, t = rng.choice([1, 5, 20, 80, 200, 400]), 0
        rows = [(None, k, rng.choice(choices)) for k in range(rng.choice([0, 0, 1, 7]))]
        for k in range(rng.randint(1, 60)):
            t += rng.choice([0, step, rng.randint(0, step)])
            rows.append((t, k, rng.choice(choices)))
        state, got, at = fold.begin, [], 0
        while at < len(rows):
            part = rows[at : at + rng.randint(1, 20)]
            at += len(part)
            got += fold.run(state, part)
            state = fold.passed(json.loads(json.dumps(state)), json.loads(json.dumps(fold.summary(part))))
        assert got == plain(rows)


def test_long_histories_over_many_tasks(spark):
    """Five keys over sixteen tasks and chunks of 50 rows: the rows of a plain fold, every task with a share."""
    req = spark.range(4000).selectExpr("id AS event_id", "CASE WHEN id % 3 = 0 THEN 0L ELSE id % 5 END AS user_id", "id * 7 div 2 AS t_s", "CASE WHEN id % 97 = 5 THEN 'grant' ELSE 'request' END AS kind")
    by: dict = {}
    for r in req.collect():
        by.setdefault(r.user_id, []).append((r.t_s, r.event_id, r.kind))
    want = {(e, x) for rows in by.values() for (_, e, _), x in zip(sorted(rows), plain_quota(sorted(rows))) if x is not None}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = folds.folded(req, folds.Quota, "user_id", ["t_s", "event_id", "kind"], "admitted", ["user_id", "event_id", "t_s"], tasks=16, most=50)
        shares = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert {(r.event_id, r.admitted) for r in got.collect()} == want and len(shares) >= 12 and max(shares) < 800
        frames = req.selectExpr("user_id AS camera_id", "event_id AS frame_id", "t_s * 10 AS t_ms", "CASE WHEN event_id % 11 > 2 THEN concat('c', event_id div 40 % 3) END AS raw")
        by = {}
        for r in frames.collect():
            by.setdefault(r.camera_id, []).append((r.t_ms, r.frame_id, [r.raw] if r.raw else []))
        want = {f for rows in by.values() for (_, f, _), x in zip(sorted(rows), plain_sightings(sorted(rows))) if x}
        assert {r.frame_id for r in folds.stable_detections(frames, tasks=16).collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_history_files_are_of_bounded_size(spark):
    from docflow.sources import history

    items = spark.range(2000).selectExpr("'one' AS owner", "cast(id AS string) AS id", "repeat('x', 500) AS text", "id AS ts_ms")
    files = history.history_files(items, most=50_000)
    assert files.selectExpr("max(length(value)) AS n").first().n < 100_000 and files.count() > 10
    good, bad = history.parse_history(files)
    assert good.count() == good.select("id").distinct().count() == 2000 and bad.count() == 0


def test_live_responses(spark):
    said = [(1, 0, 0, "data: Hel"), (1, 50, 1, "data: lo"), (1, 60, 2, ": a comment"), (1, 120, 3, "data: <think>x</think>"), (1, 130, 4, "data: !"), (1, 140, 5, "data: [DONE]"), (1, 300, 6, "data: late")]
    said += [(2, 10, 0, "data: a"), (2, 105, 1, "data: b"), (2, 110, 2, "data: c"), (2, 400, 3, None), (9, 10_000_000, 0, "data: end")]
    s = spark.createDataFrame(said, "response_id long, t_ms long, seq long, payload string").withColumn("event_time", F.timestamp_millis(F.col("t_ms") + 1000)).drop("t_ms")
    got = {tuple(r) for r in run(spark, s, lambda d: streams.live_responses(d, "1 hour"), "live") if r.response_id != 9}
    assert got == {(1, 0, "Hel", False), (1, 3, "Hello<think>x</think>", False), (1, 5, "Hello!", True), (2, 0, "a", False), (2, 2, "abc", False), (2, 3, "abc", True)}


def test_broken_streams_end_and_leave_no_state(spark):
    """A stream that breaks off gives its text after 90 s of silence; ended and broken keys are gone from state; late rows are counted."""
    s = 1000
    said = [(1, 0, 0, "data: part"), (1, 50, 1, "data: ial <think>never closed"), (2, 0, 0, "data: a"), (2, 9, 1, "data: [DONE]"), (3, 0, 0, ": only a comment"), (4, 0, 0, "data: slow"), (4, 80 * s, 1, "data: er"), (4, 160 * s, 2, "data: [DONE]")]
    arrivals = [said, [(8, 7200 * s, 0, None)], [(1, 60 * s, 2, "data: much too late"), (8, 7300 * s, 1, None)], [(8, 9000 * s, 2, None)]]
    src, ck = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    got, late = [], 0
    for n, rows in enumerate(arrivals):
        df = spark.createDataFrame(rows, "response_id long, t_ms long, seq long, payload string").withColumn("event_time", F.timestamp_millis(F.col("t_ms") + 1000)).drop("t_ms")
        df.coalesce(1).write.mode("append").parquet(src)
        live = streams.live_responses(spark.readStream.schema(df.schema).parquet(src), "10 seconds")
        q = live.writeStream.format("parquet").option("path", f"{ck}/out").option("checkpointLocation", f"{ck}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        counts = streams.state_counts(q)
        late += counts["late"]
    got = {(r.response_id, r.seq, r.text) for r in spark.read.parquet(f"{ck}/out").where("final").collect()}
    assert got == {(1, 1, "partial"), (2, 1, "a"), (4, 2, "slower")}
    assert late == 1 and counts["keys"] == 1  # the one key that still speaks


def test_history_rewrites_touched_buckets_only(spark):
    """Bytes written follow the owners of a batch; a batch that runs again gives the same table; vacuum keeps what is named."""
    schema = "owner string, seq long, op string, id string, text string, image_uri string, ts_ms long"
    src, path, ck = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))

    def arrive(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.maintain_history(spark.readStream.schema(schema).parquet(src), path, checkpoint, buckets=16).awaitTermination(120)

    def table():
        return {tuple(r) for r in streams.newest(spark, path).collect()}

    def size(version):
        return sum(os.path.getsize(f) for f in glob.glob(f"{path}/data/v={version}/bucket=*/*.parquet"))

    arrive([(f"o{k}", i, "insert", f"{k}-{i}", "t" * 200, "", i) for k in range(60) for i in range(20)], ck)
    whole = manifest = streams.manifest(spark, path)
    assert len(whole) > 10 and len(table()) == 1200
    arrive([("o1", 30, "update", "1-3", "edited", None, None), ("o1", 31, "delete", "1-4", None, None, None)], ck)
    manifest = streams.manifest(spark, path)
    assert sum(manifest[b] != whole[b] for b in whole) == 1 and size(1) < size(0) / 4
    before = table()
    assert len(before) == 1199 and ("o1", "1-3", "edited", "", 3) in before
    arrive([("o2", 40, "clear", None, None, None, None), ("new", 1, "insert", "n", "x", "u", 1)], ck)
    after = table()
    assert len(after) == 1199 - 20 + 1 and len(os.listdir(f"{path}/manifest")) >= 3
    # the last batch runs again, as after a crash between its write and the stream's commit
    os.remove(f"{ck}/commits/2")
    for crc in glob.glob(f"{ck}/commits/.2.crc"):
        os.remove(crc)
    streams.maintain_history(spark.readStream.schema(schema).parquet(src), path, ck, buckets=16).awaitTermination(120)
    assert table() == after
    assert streams.vacuum(spark, path, keep=1) >= 1 and table() == after and streams.vacuum(spark, path, keep=1) == 0


def test_maintained_history_is_that_of_all_changes(spark):
    from docflow.operators.history import apply_changes

    schema = "owner string, seq long, op string, id string, text string, image_uri string, ts_ms long"
    batches = [
        [("a", i, "insert", f"i{i}", f"t{i}", "", i) for i in range(40)] + [("b", 1, "insert", "x", "gone", "", 1)],
        [("a", 100, "update", "i3", "edited", None, None), ("a", 101, "delete", "i4", None, None, None), ("a", 102, "update", "none", "n", None, None), ("a", 103, "update", " ", "n", None, None), ("b", 2, "clear", None, None, None, None)],
        [("b", 3, "insert", "y", "stays", "u", 5)] + [("c", i, "insert", f"c{i}", "t", "", i) for i in range(70)],
    ]
    src, path, ck = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    for rows in batches:  # a run of the query for each arrival
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = streams.maintain_history(spark.readStream.schema(schema).parquet(src), path, ck)
        q.awaitTermination(60)
        q.stop()
    got = {tuple(r) for r in streams.newest(spark, path).select("owner", "id", "text", "image_uri", "ts_ms").collect()}
    every = spark.createDataFrame([r for rows in batches for r in rows], schema)
    want = {tuple(r) for r in apply_changes(spark.createDataFrame([], streams.HISTORY), every).select("owner", "id", "text", "image_uri", "ts_ms").collect()}
    assert got == want and len(got) == 39 + 1 + 50 and ("a", "i3", "edited", "", 3) in got and {x[1] for x in got if x[0] == "b"} == {"y"}
    assert len([x for x in got if x[0] == "c" and x[4] >= 20]) == 50
