"""WARC archives: writing, reading, and revisit resolution.

``resolve`` shuffles only headers (id, digest, length) by payload digest: the smallest id of each digest is the original,
the others are revisits of it.  ``write`` makes archives of response and revisit records with fresh headers through
Spark's text sink (a record is followed by the record separator CRLF CRLF), so that any store that Spark writes can hold
them.  ``read`` parses archives by their Content-Length, whatever the payload holds: gzip files of one or many members and plain ones, the payload's
bytes as ``body`` (and as the string ``payload`` where they are UTF-8), records of any id.  ``dereferenced`` gives revisit records the payload of their original, and ``rewrite`` makes
fresh archives of archives that already hold revisits, keeping HTTP headers, content types and records of other kinds.

Damage loses nothing silently: a record whose header cannot be read, or that the file ends within, becomes a row of type ``broken`` with its bytes, reading goes on
at the next record, and a payload that is not what its header says is not ``intact``; ``rewrite`` sets such records aside.

A null page counts as an empty payload, a null url as the empty url.  Records of equal payloads below ``min_bytes`` are all
responses.  Ids should be unique; rows repeated as a whole are written once for each row and refer to the same
original (a repeated original is a response each time); a record id is the page id, with a number from the second row of a
page id on.  Rows with a null id are responses of their own, spread by their content.  Extra columns are ignored, whatever
their names.  An empty table gives an empty archive and an empty result.  Payloads of any length are one record; a file's compressed bytes and one
record are in memory at a time, so that source files stay below 2 GB.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

EOL = "\r\n"
MAX_FILE = 32 << 20
RECORD = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, body binary, intact boolean, record string, "
    "date timestamp, http binary, content_type string"
)
#: kinds of records that have a payload, and those that ``read`` tells unless asked for all
PAYLOADS = ("response", "revisit", "resource")
SHOWN = ("response", "revisit")


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a string's UTF-8 bytes: four runs of 40 bits, each eight digits."""
    hexed = F.sha1(text.cast("binary"))
    runs = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = 0, salts: int = 64, order: Column | None = None) -> DataFrame:
    """``headers (page_id, payload_digest, payload_bytes, ...)`` with ``record_type`` and ``refers_to``; ids are numbers or strings, the first by
    ``order`` (the smallest, if not given) is the original.

    The originals are pre-aggregated; only digests that occur twice join back, salted, so that a page copied onto a third
    of all rows is spread over tasks.
    """
    big = (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()
    first = F.min("page_id") if order is None else F.min_by("page_id", order)
    firsts = headers.where(big).groupBy("payload_digest").agg(first.alias("original"), F.count("*").alias("copies")).where("copies > 1")
    firsts = firsts.select("payload_digest", "original", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    h = headers.withColumn("salt", F.when(big, F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")))
    h = h.join(firsts, ["payload_digest", "salt"], "left")
    revisit = F.col("original").isNotNull() & (F.col("original") != F.col("page_id"))
    return h.select(*headers.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def records(date: Column, urn=lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")), http: Column | None = None, content_type: Column | None = None) -> Column:
    """The text of one WARC record without the separator after it, of rows with the columns of ``resolve``, ``record``, ``url``
    and ``html``; ``date`` is the timestamp of the capture, ``urn`` makes an id of a record's name.  ``http`` and ``content_type`` are kept where they are not null."""
    revisit = F.col("record_type") == "revisit"
    fresh = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    http = fresh if http is None else F.coalesce(http.cast("string"), fresh)
    kind = F.lit("application/http; msgtype=response")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html").cast("string"))
    size = F.octet_length(http) + F.octet_length(body)
    url = F.translate(F.col("url"), "\r\n", "")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.col("record_type"), F.lit(f"{EOL}WARC-Record-ID: "), urn(F.col("record")),
        F.lit(f"{EOL}WARC-Date: "), F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{EOL}WARC-Target-URI: "), url, F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{EOL}Content-Type: "), kind if content_type is None else F.coalesce(content_type, kind), F.lit(f"{EOL}Content-Length: "), size.cast("string"), F.lit(EOL + EOL), http, body,
    )


def _dealt(p: DataFrame, files: int, min_bytes: int, order: str | None = None) -> DataFrame:
    """``p (page_id, url, html, ...)`` with ``record_type``, ``refers_to`` and ``record``, in ``files`` partitions; page ids are numbers or strings, originals first by
    column ``order``."""
    p = p.select("*", base32_sha1(F.col("html")).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    heads = p.select("page_id", "payload_digest", "payload_bytes", *([order] if order else []))
    typed = resolve(heads, min_bytes, order=F.col(order) if order else None).select("page_id", "record_type", "refers_to").where("record_type = 'revisit'")
    typed = typed.select(F.col("page_id").alias("key"), "record_type", "refers_to")
    content = F.xxhash64("url", "html")
    p = p.select("*", F.col("page_id").isNull().alias("anonymous"), F.coalesce("page_id", content if dict(p.dtypes)["page_id"] == "bigint" else F.hex(content)).alias("key"))
    # both sides and the window are dealt by the key alone, so the payloads are shuffled once; a row without an id may share its key with a page
    full = p.repartition(files, "key").join(typed.repartition(files, "key").dropDuplicates(["key"]), "key", "left")
    full = full.withColumn("record_type", F.when(F.col("anonymous"), "response").otherwise(F.coalesce("record_type", F.lit("response")))).withColumn("refers_to", F.when(~F.col("anonymous"), F.col("refers_to")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("anonymous"))
    record = F.concat(F.when(F.col("anonymous"), F.concat(F.lit(":"), F.hex("key"), F.lit("."))).otherwise(F.col("page_id").cast("string")), F.when(F.col("anonymous"), F.col("nth").cast("string")).when(F.col("nth") > 1, F.concat(F.lit(":"), F.col("nth").cast("string"))).otherwise(""))
    return full.withColumn("nth", nth).withColumn("record", record)


def _files(rows: DataFrame, column: str, max_file: int) -> int:
    total = rows.select(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + 500)).first()[0] or 0
    return max(1, -(-total // max_file))


def _sink(values: DataFrame, path: str) -> None:
    values.write.mode("append").option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def write(pages: DataFrame, path: str, min_bytes: int = 0, max_file: int = MAX_FILE, date: Column | None = None) -> None:
    """Write deduplicated archives of ``pages (page_id, url, html)`` under ``path``, gzip files of about ``max_file`` bytes.

    Headers alone are shuffled by digest; the payloads meet their record type by page id.  ``date`` (of ``pages``) is the time
    of the captures, now if not given.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce(F.current_timestamp() if date is None else date.cast("timestamp"), F.current_timestamp()).alias("date"),
    )
    _sink(_dealt(p, _files(pages, "html", max_file), min_bytes).select(records(F.col("date")).alias("value")), path)


def _text() -> Column:
    text = F.col("body").cast("string")
    return F.when(F.is_valid_utf8(text), text)


def dereferenced(found: DataFrame, least: int = 100_000) -> DataFrame:
    """``read``'s rows with each revisit's ``payload`` taken from the response (the least page id, then record) of its digest.

    Revisits whose response is not there keep a null body.  Only digests and counts of the revisits are gathered; a
    response is sent once for each ``least`` revisits of it, and those are spread over as many tasks.
    """
    revisit = F.col("record_type") == "revisit"
    asked = found.where(revisit).groupBy("payload_digest").agg(F.ceil(F.count("*") / F.lit(least)).cast("int").alias("parts"))
    firsts = found.where((F.col("record_type") == "response") & F.col("intact")).join(asked, "payload_digest").groupBy("payload_digest", "parts")
    firsts = firsts.agg(F.min_by(F.struct("body"), F.struct(F.col("page_id").isNull(), "page_id", "record")).alias("original"))
    firsts = firsts.select("payload_digest", "parts", "original", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = found.where(revisit).join(asked, "payload_digest").withColumn("part", F.pmod(F.xxhash64("record", "url"), F.col("parts")).cast("int"))
    got = dealt.join(firsts.drop("parts"), ["payload_digest", "part"], "left").withColumn("body", F.col("original.body")).withColumn("payload", _text())
    nameless = found.where(revisit & F.col("payload_digest").isNull())
    return found.where(~revisit).unionByName(got.select(*found.columns)).unionByName(nameless)


def rewrite(spark: SparkSession, source: str, path: str, min_bytes: int = 0, aside: str | None = None, max_file: int = MAX_FILE) -> None:
    """Fresh archives under ``path`` of those under ``source``, whose own revisits are resolved first; all payloads of responses are
    deduplicated over all archives, by record id: of equal ones the smallest id is the response.  HTTP headers, content types, and records of
    other kinds (request, warcinfo, metadata and so on) are kept as they are.

    Broken and damaged records and revisits without their response anywhere go to ``aside`` as Parquet rows of ``read`` with a ``reason``; they are an
    error if no such place is given.
    """
    every = stored(dereferenced(read(spark, source, every=True)), "warc-records")
    lost = (F.col("record_type") == "revisit") & F.col("body").isNull()
    reason = F.when(F.col("record_type") == "broken", "broken").when(lost, "no response").when(~F.col("intact"), "damaged")
    told = every.withColumn("reason", reason)
    if aside is not None:
        told.where("reason is not null").write.mode("append").parquet(aside)
    elif many := told.where("reason is not null").count():
        raise ValueError(f"{many} records are broken, damaged, or revisits without a response; name a place to set them aside")
    good = told.where("reason is null")
    inner = F.regexp_replace(F.regexp_replace(F.col("record"), "^<|>$", ""), r"^(urn:page:-?[0-9]+):[0-9]+$", "$1")  # further rows of a page id
    nameless = F.col("record").isNull() | F.startswith(F.col("record"), F.lit("<urn:page::"))  # rows without an id were, and stay, responses of their own
    first = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record")).alias("first")
    p = good.where(F.col("record_type").isin(*SHOWN)).select(F.when(~nameless, inner).alias("page_id"), "url", F.col("body").alias("html"), F.coalesce("date", F.current_timestamp()).alias("date"), "http", "content_type", first)
    urn = lambda c: F.concat(F.when(F.startswith(c, F.lit(":")), "<urn:page:").otherwise("<"), c, F.lit(">"))
    _sink(_dealt(p, _files(p, "html", max_file), min_bytes, "first").select(records(F.col("date"), urn, F.col("http"), F.col("content_type")).alias("value")), path)
    others = good.where(~F.col("record_type").isin(*SHOWN)).select(F.concat(F.col("http"), F.col("body")).cast("string").alias("value"))
    _sink(others.repartition(_files(others, "value", max_file)), path)


def inflated(data: bytes, step: int = 1 << 20):
    """The bytes of a plain or gzip file, of all its members, piece by piece; ends early where the compressed data is cut off or damaged."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    unzip = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        piece = data[at : at + step]
        while piece:
            try:
                got = unzip.decompress(piece)
            except zlib.error:
                return
            if got:
                yield got
            piece = unzip.unused_data
            if unzip.eof:
                piece = piece.lstrip(b"\0")  # padding between members
                unzip = zlib.decompressobj(31)


class Blocks:
    """A stream of pieces that is read by length or up to a mark."""

    def __init__(self, pieces):
        self.pieces, self.held = iter(pieces), bytearray()

    def more(self) -> bool:
        for piece in self.pieces:
            self.held += piece
            return True
        return False

    def have(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, start: int = 0) -> int:
        while (at := self.held.find(mark, start)) < 0:
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


def _header(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name; folded lines belong to the field before."""
    lines = raw.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split(EOL)
    return {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in lines[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">").split(":")[0]
    return int(number) if (urn or "").startswith("<urn:page:") and number.lstrip("-").isdigit() else None


def _record(raw: bytes, block: bytes, head: dict[str, str]) -> tuple:
    kind, content = head["warc-type"].lower(), head.get("content-type")
    name, url = head.get("warc-record-id"), head.get("warc-target-uri", "")
    date = datetime.datetime.fromisoformat(head["warc-date"]) if "warc-date" in head else None
    if kind not in PAYLOADS:
        return _page(name), url, kind, len(block), None, None, block, True, name, date, raw + b"\r\n\r\n", content
    http, payload = b"", block
    if (content or "application/http").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        http += mark
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    digest = head.get("warc-payload-digest", "")
    digest = digest[5:].upper() if digest.lower().startswith("sha1:") and len(digest) == 37 else None
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), len(payload))
    if kind == "revisit":
        return _page(name), url, kind, length, digest, _page(head.get("warc-refers-to")), None, not payload, name, date, http, content
    if kind == "resource":
        return _page(name), url, kind, len(block), own, None, block, digest in (None, own), name, date, raw + b"\r\n\r\n", content
    # a decoded body may be longer or shorter than HTTP says, so the digest decides where there is one
    intact = own == digest if digest else length == len(payload) or b"transfer-encoding" in http.lower()
    return _page(name), url, kind, len(payload), own, None, payload, intact, name, date, http, content


def parse(data: bytes, every: bool = False):
    """The responses and revisits of one archive, as RECORD, or ``every`` record; what cannot be read is of type ``broken``, with its bytes."""
    return (r for r in _parsed(data) if every or r[2] in SHOWN)


def _parsed(data: bytes):
    stream = Blocks(inflated(data))

    def broken(raw: bytes) -> tuple:
        return None, "", "broken", len(raw), None, None, raw, False, None, None, b"", None

    while True:
        while stream.have(1) and stream.held[:1] in (b"\r", b"\n"):
            stream.take(len(stream.held) - len(stream.held.lstrip(b"\r\n")))
        if not stream.have(1):
            return
        stop = stream.find(b"\r\n\r\n")
        try:
            head = _header(bytes(stream.held[:stop])) if stop >= 0 and stream.held.startswith(b"WARC/") else {}
            size = int(head["content-length"])
            if size < 0 or not stream.have(stop + 4 + size):
                raise ValueError("cut off")
            got = _record(bytes(stream.held[:stop]), bytes(stream.held[stop + 4 : stop + 4 + size]), head)
        except (KeyError, ValueError):
            # the next record begins after a line end, wherever this one was meant to end
            at = stream.find(b"\r\nWARC/1.", 1)
            yield broken(stream.take(at + 2 if at >= 0 else len(stream.held)))
            continue
        stream.take(stop + 4 + size)
        yield got


def read(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """RECORD rows of the archives under ``path`` (gzip or plain): responses and revisits, or ``every`` record, those of other kinds with their whole header in
    ``http`` and their block as ``body``, and what is ``broken``."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "body": pa.binary(), "intact": pa.bool_(), "date": pa.timestamp("us", "UTC"), "http": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds.get(f.split()[0], pa.string())) for f in RECORD.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in parse(content.as_buffer().to_pybytes(), every):
                    rows.append(r)
                    held += len(r[6] or b"") + 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD).withColumn("payload", _text())
