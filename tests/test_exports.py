"""What exports write, read back from their files."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import Row

from docflow.operators import markdown
from docflow.sources import exports

MD = "| a | b,c |\n| - | - |\n| say \"x\" |  |\n\ntext\n\n| z |\n| - |\n"
DOCS = [(1, MD), (2, "no table\nhere"), (3, "")]


def files(path):
    return {os.path.basename(f): open(f, newline="").read() for f in glob.glob(f"{path}/*-*/*")}


def test_tables_csv_files(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/csv"
    exports.write_tables_csv(markdown.markdown_tables(docs), path)
    assert files(path) == {"1.csv": 'a,"b,c"\r\n"say ""x""",\r\n\r\nz\r\n'}


def test_documents_under_their_names(spark):
    docs = spark.createDataFrame([*DOCS, (4, None)], "doc_id long, text string")
    titles = spark.createDataFrame([(1, "Table"), (2, "Plain"), (3, "a/b"), (4, "Plain")], "doc_id long, title string")

    def written(fmt, mode="append", path=None):
        path = path or tempfile.mkdtemp(prefix="spark-", dir="/tmp") + f"/{fmt}"
        exports.write_documents(docs, titles, fmt, path, markdown.markdown_tables(docs), mode)
        return files(path), path

    got, path = written("md")
    assert got == {"1 Table.md": MD, "2 Plain.md": "no table\nhere", "3 a_b.md": "", "4 Plain.md": ""}
    assert {k: json.loads(v) for k, v in written("json")[0].items()} == {"1 Table.json": {"text": MD}, "2 Plain.json": {"text": "no table\nhere"}, "3 a_b.json": {"text": ""}, "4 Plain.json": {"text": None}}
    assert written("csv")[0] == {"1 Table.csv": 'a,"b,c"\r\n"say ""x""",\r\n\r\nz\r\n'}
    # a folder for each task, not for each document; an overwrite leaves only its own files
    assert len(os.listdir(path)) <= 6 and os.path.exists(f"{path}/_SUCCESS")
    assert set(written("txt", "overwrite", path)[0]) == {"1 Table.txt", "2 Plain.txt", "3 a_b.txt", "4 Plain.txt"}
    assert len(written("md", "append", path)[0]) == 8


def test_retried_tasks_leave_no_doubles(tmp_path):
    """Two attempts of a task write; only the one whose message is committed stays.  An aborted job leaves nothing."""
    from docflow.sources import files as sink

    def attempt(writer, part, n, rows, fail=False):
        class Context:
            partitionId, taskAttemptId = staticmethod(lambda: part), staticmethod(lambda: n)

        def given():
            yield from (Row(name=a, value=b) for a, b in rows)
            if fail:
                raise RuntimeError("lost executor")

        held, sink.TaskContext.get = sink.TaskContext.get, staticmethod(lambda: Context)
        try:
            return writer.write(given())
        finally:
            sink.TaskContext.get = held

    w = sink.NamedFilesWriter(str(tmp_path), ".txt", False)
    with pytest.raises(RuntimeError):
        attempt(w, 0, 1, [("a", "half")], fail=True)
    first, twice = attempt(w, 0, 2, [("a", "x"), ("a", "y"), ("b", None)]), attempt(w, 1, 3, [("c", "z")])
    attempt(w, 1, 4, [("c", "speculative")])
    w.commit([first, twice, attempt(w, 2, 5, [])])
    assert files(tmp_path) == {"a.txt": "x", "a (2).txt": "y", "b.txt": "", "c.txt": "z"} and not glob.glob(f"{tmp_path}/_staging/*")
    lost = sink.NamedFilesWriter(str(tmp_path), ".txt", True)
    attempt(lost, 0, 1, [("d", "never seen")])
    lost.abort([None])
    assert len(files(tmp_path)) == 4 and not glob.glob(f"{tmp_path}/_staging/*")


def test_broken_jobs_write_nothing(spark):
    from docflow.sources.files import registered

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    rows = registered(spark).createDataFrame([("a", "x"), (None, "y")], "name string, value string")
    with pytest.raises(Exception, match="without a name"):
        rows.write.format("named_files").mode("append").save(path)
    with pytest.raises(Exception, match="name and value"):
        rows.withColumn("more", rows["name"]).write.format("named_files").mode("append").save(path)
    assert files(path) == {} and not os.path.exists(f"{path}/_SUCCESS")


def test_page_json(spark):
    lines = spark.createDataFrame([(1, 2, 0, "b", 0.5, 1.9, 2.0, 3.0, 4.0), (1, 1, 1, "second", 0.9, 0.0, 0.0, 5.0, 5.0), (1, 1, 0, 'q"', None, 0.0, 0.0, 5.0, 5.0)], "doc_id long, page long, line_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    docs = spark.createDataFrame([(1, "whole"), (2, "a\n\n--- Page 2 ---\n\nb"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: json.loads(r.json) for r in exports.page_json(lines, docs).where("doc_id < 3").collect()}
    assert got[1]["text"] == "whole" and [p["page"] for p in got[1]["pages"]] == [1, 2]
    assert [(x["text"], x.get("confidence"), x["box"]) for x in got[1]["pages"][0]["lines"]] == [('q"', None, [0, 0, 5, 5]), ("second", 0.9, [0, 0, 5, 5])]
    assert [[x["text"] for x in p["lines"]] for p in got[2]["pages"]] == [["a"], ["b"]] and got[1]["pages"][1]["lines"][0]["box"] == [1, 2, 3, 4]
    empty = exports.page_json(lines, docs).where("doc_id = 3").first().json
    assert json.loads(empty) == {"text": None, "pages": []}


def test_read_back_has_every_file_under_its_name(spark, tmp_path):
    """Empty and null texts are empty files that are read back; a letter whose capital would be several letters stays."""
    import duckdb

    from docflow import queries

    texts = ["", None, "ŉapple ﬁre ᾳx ßa", "50% off + 20%41 more", "Größe a:b=c", "{a,b} [c] \\d"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT name, bytes, md5 FROM ({queries.ORACLES['write_documents']})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["write_documents"](spark, str(tmp_path)).collect())) == want and len(want) == len(texts)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["write_documents"](spark, f"{tmp_path}/none").count() == 0


def test_read_back_deals_files_by_shares(spark, tmp_path, monkeypatch):
    from docflow.sources import files as sink

    path = f"file://{tmp_path}/out"
    for part in (range(70), range(70, 100)):
        rows = spark.createDataFrame([(f"n{i}", f"v{i}" * (i % 3)) for i in part], "name string, value string")
        sink.registered(spark)
        rows.coalesce(1).write.format("named_files").option("suffix", ".txt").mode("append").save(path)
    monkeypatch.setattr(sink, "_SHARE", 20)
    monkeypatch.setattr(sink, "_FILES", 7)
    got = sink.read_back(spark, path, ".txt")
    assert got.rdd.getNumPartitions() == 4 + 2  # not one for each file
    assert sorted(map(tuple, got.collect())) == sorted((f"n{i}.txt", f"v{i}" * (i % 3)) for i in range(100))
    assert sink.read_back(spark, path, ".csv").count() == 0
