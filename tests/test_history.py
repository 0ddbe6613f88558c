"""Long arrays in pieces: braces in strings and inside items, escapes, blocks that cut anywhere, broken items, files that are no arrays."""

import json
import random

import pytest

from docflow.sources import history


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        return str(tmp_path)

    return put


def told(frames):
    good, faults = frames
    return {(r.owner, r.id): (r.text, r.image_uri, r.ts_ms) for r in good.collect()}, sorted((r.owner, r.item_no, r.reason) for r in faults.collect())


TEXTS = ["plain", "a } brace", "{ and }", 'a "quoted" }', "back\\slash \\", "\\\"}", "line\nbreak }", "é}😀", "", "}", '"', "][,"]


@pytest.mark.parametrize("block", [None, 300])
def test_arrays_of_any_text(spark, folder, block):
    rng = random.Random(5)
    want = {}
    for owner in ("one", "two"):
        items = [{"id": f"{owner}{i}", "text": "".join(rng.choices(TEXTS, k=3)), "imageUri": "u{}", "timestamp": i} | ({"more": {"deep": {"x": "}"}, "list": [{}, {"y": 1}]}} if i % 5 == 0 else {}) for i in range(120)]
        want |= {(owner, x["id"]): (x["text"], x["imageUri"], x["timestamp"]) for x in items}
        path = folder(owner, json.dumps(items, ensure_ascii=owner == "two", indent=2 if owner == "one" else None))
    folder("empty", " [ ]\n")
    if block:  # a split every few items, in strings too
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        good, faults = told(history.read_long_history(spark, path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert good == want and faults == []
    whole, bad = history.read_history(spark, path)
    assert {(r.owner, r.id): (r.text, r.image_uri, r.ts_ms) for r in whole.collect()} == want and bad.count() == 0


def test_faults_are_told_and_the_rest_is_read(spark, folder):
    folder("broken", '[{"id": "a", "text": "x"}, {"id": "b", "text": nonsense}, {"id": "c"}]')
    folder("comma", '[{"id": "a"} {"id": "b"}]')
    folder("cut", '[{"id": "a"}, {"id": "b", "te')
    folder("open", '[{"id": "a"}')
    path = folder("other", '{"id": "a"}')
    good, faults = told(history.read_long_history(spark, path))
    assert set(good) == {("broken", "a"), ("broken", "c"), ("comma", "a"), ("cut", "a")} and good["broken", "c"][0] == ""
    assert faults == [("broken", 1, "broken item"), ("comma", 1, "no comma before it"), ("cut", 1, "no array that ends"), ("open", 0, "no array that ends"), ("other", 0, "no array that ends")]
