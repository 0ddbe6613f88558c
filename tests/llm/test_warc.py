"""Archives as others write them: several gzip members, uuid ids, any bytes, other kinds of records, damage."""

import base64
import gzip
import hashlib
import os

import pytest

from docflow.llm import warc

BYTES = b"\xff\xfe\x00\r\n\r\nWARC/1.1\r\n<\xe9>" + bytes(range(256))


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(name, body=b"", kind="response", http=b"HTTP/1.1 200 OK\r\nServer: own\r\n\r\n", content="application/http; msgtype=response", **more):
    block = http + body
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": "2024-05-06T07:08:09Z", "Content-Type": content, "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def response(name, body, url="http://a/", **more):
    return record(name, body, **{"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha1:{digest(body)}"} | more)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, *members):
        (tmp_path / "in" / name).write_bytes(b"".join(members))
        return str(tmp_path / "in")

    return put


def test_every_member_of_a_gzip_file(spark, folder):
    path = folder("a.warc.gz", *(gzip.compress(response(f"{i}", b"page %d" % i)) for i in range(5)))
    folder("b.warc.gz", gzip.compress(response("5", b"x") + response("6", b"y")), b"\0" * 512)
    folder("c.warc", response("7", b"z"))
    got = warc.read(spark, path).collect()
    assert sorted(r.record for r in got) == [f"<urn:uuid:{i}>" for i in range(8)] and all(r.intact and r.page_id is None for r in got)


def test_payloads_are_the_bytes_they_are(spark, folder):
    path = folder("a.warc.gz", gzip.compress(response("1", BYTES)), gzip.compress(response("2", "é".encode())))
    got = {r.record[10]: r for r in warc.read(spark, path).collect()}
    assert bytes(got["1"].body) == BYTES and got["1"].payload is None and got["1"].intact and got["1"].payload_digest == digest(BYTES)
    assert got["2"].payload == "é" and bytes(got["2"].http) == b"HTTP/1.1 200 OK\r\nServer: own\r\n\r\n"


def test_rewriting_archives_of_others(spark, folder, tmp_path):
    """Equal pages become one response and revisits of it, by record id; bytes, HTTP headers and other records are kept."""
    path = folder("a.warc.gz", *(gzip.compress(response(f"b{i}", BYTES, f"http://h/{i}")) for i in range(4)), gzip.compress(record("w", b"software: x", "warcinfo", b"", "application/warc-fields")))
    folder("b.warc", response("a0", BYTES), response("c", b"own"), record("q", b"", "request", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request"))
    folder("c.warc", record("r", b"", "revisit", WARC_Payload_Digest=f"sha1:{digest(b'own')}", WARC_Refers_To="<urn:uuid:c>", WARC_Target_URI="http://z/"))
    again = str(tmp_path / "out")
    warc.rewrite(spark, path, again)
    got = {r.record[10:-1]: r for r in warc.read(spark, again, every=True).collect()}
    assert {k: r.record_type for k, r in got.items()} == {"a0": "response", "b0": "revisit", "b1": "revisit", "b2": "revisit", "b3": "revisit", "w": "warcinfo", "c": "response", "q": "request", "r": "revisit"}
    assert bytes(got["a0"].body) == BYTES and got["a0"].intact and b"Server: own" in bytes(got["b2"].http) and got["b2"].url == "http://h/2"
    assert bytes(got["w"].body) == b"software: x" and b"warcinfo" in bytes(got["w"].http) and bytes(got["q"].body).startswith(b"GET /")
    raw = b"".join(gzip.decompress(open(f"{again}/{f}", "rb").read()) for f in os.listdir(again) if f.endswith(".gz"))
    assert raw.count(b"WARC-Refers-To: <urn:uuid:a0>") == 4 and raw.count(BYTES) == 1
    whole = warc.dereferenced(warc.read(spark, again)).collect()
    assert sorted(bytes(r.body) for r in whole) == sorted([BYTES] * 5 + [b"own"] * 2)


def test_broken_and_damaged_records_are_set_aside(spark, folder, tmp_path):
    good, cut = response("1", b"good"), response("2", b"cut off here")
    path = folder("a.warc", good, b"WARC/1.0\r\nno length at all\r\n\r\njunk\r\n", response("3", b"after the junk"), cut[:-9])
    whole = gzip.compress(response("4", b"in a member"))
    folder("b.warc.gz", whole, gzip.compress(response("5", os.urandom(5000)))[:-2000])
    folder("c.warc", response("6", b"changed", WARC_Payload_Digest=f"sha1:{digest(b'else')}"), record("7", b"", "revisit", WARC_Payload_Digest=f"sha1:{digest(b'nowhere')}"))
    got = warc.read(spark, path, every=True).collect()
    assert sorted(r.record for r in got if r.record) == [f"<urn:uuid:{i}>" for i in (1, 3, 4, 6, 7)]
    broken = [bytes(r.body) for r in got if r.record_type == "broken"]
    assert len(broken) == 3 and any(b"junk" in b for b in broken) and cut[:-9] in broken
    assert {r.record[10] for r in got if r.record and not r.intact} == {"6"}
    with pytest.raises(ValueError, match="5 records"):
        warc.rewrite(spark, path, str(tmp_path / "never"))
    warc.rewrite(spark, path, str(tmp_path / "out"), aside=str(tmp_path / "aside"))
    assert sorted(r.record[10] for r in warc.read(spark, str(tmp_path / "out")).collect()) == ["1", "3", "4"]
    aside = spark.read.parquet(str(tmp_path / "aside")).collect()
    assert sorted(r.reason for r in aside) == ["broken", "broken", "broken", "damaged", "no response"]


def test_a_very_long_record(spark, folder):
    body = b"x" * (20 << 20) + b"end"
    path = folder("a.warc.gz", gzip.compress(response("1", body)), gzip.compress(response("2", b"")))
    got = {r.record[10]: r for r in warc.read(spark, path).select("record", "payload_bytes", "intact").collect()}
    assert got["1"].payload_bytes == len(body) and got["1"].intact and got["2"].payload_bytes == 0
