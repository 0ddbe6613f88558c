"""History files: a JSON array of items a file, read as a whole or, however long, in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

SCHEMA = "array<struct<id:string, text:string, imageUri:string, timestamp:bigint>>"


def parse_history(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files (owner, value)`` → ``(history, quarantine)``.

    Missing ids get a fresh one, missing times now, missing texts and uris are empty.  A malformed file goes to quarantine;
    an empty array is valid.
    """
    parsed = files.withColumn("items", F.from_json(F.when(F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$"), F.col("value")), SCHEMA))
    bad = F.col("items").isNull() | F.exists("items", lambda i: i.isNull())
    return _filled(parsed.where(~bad).select("owner", F.inline("items"))), parsed.where(F.coalesce(bad, F.lit(True))).select("owner", "value")


def _filled(items: DataFrame) -> DataFrame:
    return items.select(
        "owner", F.coalesce("id", F.expr("uuid()")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("imageUri", F.lit("")).alias("image_uri"),
        F.coalesce("timestamp", F.unix_millis(F.current_timestamp())).alias("ts_ms"),
    )


def history_files(items: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``items (owner, id, text, ts_ms)`` → ``files (owner, value)`` of about ``most`` bytes each, several for a large owner."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(100))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("id", "ts_ms", "text"), F.lit(-(-size // most) or 1)).alias("chunk")
    item = F.struct("id", "text", F.lit("").alias("imageUri"), F.col("ts_ms").alias("timestamp"))
    return items.groupBy("owner", chunk).agg(F.to_json(F.collect_list(item)).alias("value")).select("owner", "value")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every file under ``path`` is one owner's history, named by the file."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("owner"), "value")
    return parse_history(files)


ITEM = SCHEMA.removeprefix("array<").removesuffix(">")


def read_long_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(history, faults)`` of files of any length: Spark splits a file at its closing braces, and a long array is many rows from the start.

    A brace may stand in a string, or close an object inside an item.  Each piece between braces is counted without knowing where it stands
    (quotes; opening braces if it begins outside or inside a string); running sums over the pieces, block by block of the file and then over the blocks,
    tell where strings and items end, and the pieces of an item are put together.

    ``faults (owner, item_no, value, reason)``: items that do not parse or are not set apart by a comma, and files that do not begin or end as an array (their
    good items stay in ``history``).  An empty array is valid, an empty file is not told at all.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("owner")
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    opens = lambda x: F.regexp_count(F.regexp_replace(x, '"[^"]*("|$)', ""), F.lit(r"\{"))
    pieces = cut(pieces.select("*", F.regexp_count(bare, F.lit('"')).alias("quotes"), opens(bare).alias("outside"), opens(F.concat(F.lit('"'), bare)).alias("inside")))

    whole = Window.partitionBy("file").orderBy("block")
    ends = pieces.groupBy("file", "block").agg(F.max("pos").alias("last"))
    ends = ends.withColumn("last", F.when(F.lead("block").over(whole).isNull(), F.col("last")))  # what follows a file's last brace is not closed by one
    d = _running(pieces.drop("value", "owner"), F.col("quotes"), "before").join(ends, ["file", "block"])
    text = F.col("before") % 2 == 1
    closes = ((F.col("before") + F.col("quotes")) % 2 == 0) & ~F.coalesce(F.col("pos") == F.col("last"), F.lit(False))
    d = d.select("file", "block", "pos", closes.alias("closes"), (F.when(text, F.col("inside")).otherwise(F.col("outside")) - closes.cast("int")).alias("step"))
    d = cut(_running(d, F.col("step"), "depth"))
    done = F.col("closes") & (F.col("depth") + F.col("step") <= 0)
    d = _running(d.select("file", "block", "pos", "closes", done.alias("done")), F.col("done").cast("int"), "item_no")
    held = pieces.select("file", "owner", "block", "pos", "value").join(d, ["file", "block", "pos"])
    part = F.struct("block", "pos", F.concat("value", F.when(F.col("done"), "}").otherwise("")).alias("value"), "done")
    items = held.groupBy("file", "owner", "item_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    items = items.select("owner", "item_no", F.array_join(F.transform("parts", lambda x: x["value"]), "}").alias("value"), F.try_element_at("parts", F.lit(-1))["done"].alias("done"))
    first = F.col("item_no") == 0
    lead = F.when(first, r"[").otherwise(r",")
    body = F.regexp_extract("value", r"(?s)^\s*[\[,]?\s*(.*)$", 1)
    items = cut(items.select("owner", "item_no", "value", "done", body.alias("body"), F.startswith(F.regexp_replace("value", r"^\s+", ""), lead).alias("apart")))
    whole_item = items.where("done").withColumn("item", F.from_json("body", f"{ITEM.removesuffix('>')}, _broken:string>", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    bad = F.col("item._broken").isNotNull() | F.col("item").isNull() | ~F.startswith("body", F.lit("{"))
    reason = F.when(bad, "broken item").when(~F.col("apart"), "no comma before it")
    told = whole_item.select("owner", "item_no", "value", "item", reason.alias("reason"))
    tail = F.when(first, ~F.col("value").rlike(r"^\s*\[\s*\]\s*$")).otherwise(~F.col("value").rlike(r"^\s*\]\s*$"))
    open_ = items.where("not done").where(tail).select("owner", "item_no", "value", F.lit("no array that ends").alias("reason"))
    good = told.where("reason is null").select("owner", "item.*").drop("_broken")
    return _filled(good), told.where("reason is not null").drop("item").unionByName(open_)


def _running(pieces: DataFrame, amount: Column, name: str) -> DataFrame:
    """``pieces (file, block, pos, ...)`` with the sum of ``amount`` over the file's earlier pieces: within a block by a window, over blocks by their totals."""
    before = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("file", "block").agg(F.sum(amount).alias("total"))
    totals = totals.select("file", "block", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    own = pieces.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)))
    return own.join(totals, ["file", "block"]).withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")
