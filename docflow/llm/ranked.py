"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in shards of some thousand: a shard's postings are flat arrays, term after term, of document places and counts.
Terms belong to owners by how many documents hold them, rarest first, and owners are stages.  A bundle is an item within a
shard: its terms and a sparse accumulator, the documents that have a score so far.  Stage after stage, bundles and the
stage's postings meet in a cogroup by shard, the owner adds its terms' whole-number contributions, and the bundle goes on to the
next owner.  The last owner tells each bundle's best documents, a window the item's best.

A bundle drops a document when later stages cannot bring it among the shard's ``top``: its score and the most that the item's later terms
give in this shard are below the score that ``top`` documents have already.  Nothing that could be told is dropped.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, of the whole text.  Null and empty texts have
no terms, count nowhere and are told nowhere; an item without terms, or whose terms no document holds, has no rows.  Rows that repeat
an item id are one item with the terms of all; rows that repeat a document id are documents of their own.  Equal scores are told by ascending
document id, nulls last.  A term that every document holds is spread over the shards like any other.  Very long texts are cut
between terms while they are counted.  Extra columns are ignored, whatever their names.  Empty tables give an empty result.

The distinct terms of the items are sent to the tasks in parts of ``part_bytes``; each part is one pass over the documents.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, every_block, stored
from .tokens import narrow, widened

#: ASCII characters that are no letters and digits become spaces, A-Z lower case
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PIECE = 1 << 22
UNIT = 1_000_000_000
_LATER = np.dtype([("term", "<i8"), ("most", "<i8")])
_OWNED = np.dtype([("term", "<i8"), ("stage", "<i8")])


def pieces(text: str | None):
    """The terms of a text, a list for every 4 MB or so."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while len(raw) - at > PIECE:
        cut = raw.rfind(b" ", at, at + PIECE)
        cut = cut if cut > at else raw.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, at, terms = b.column(0), [], []
            for n, text in enumerate(b.column(1).to_pylist()):
                own = {t for p in pieces(text) for t in p}
                at += [n] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id bigint, term binary").distinct()


def _indexed(terms, shard: int):
    """Postings of a part's terms in every shard: sorted by term, then by place."""

    def run(batches):
        known = {t: n for n, t in enumerate(terms.value)}
        get = known.get
        now = None
        ids: list = []
        long: list = []
        some: list = []
        held: list = []

        def taken():
            if some:
                at, place = np.concatenate([s for s, _ in some]), np.concatenate([np.full(len(s), p) for s, p in some])
                key, many = np.unique(at.astype(np.int64) * shard + place, return_counts=True)
                held.append((key, many))
                some.clear()

        def out():
            taken()
            key, many = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(key, kind="stable")
            key, many = key[order], many[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, many = key[start], np.add.reduceat(many, start) if len(start) else many
            term, place = key // shard, key % shard
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            n = np.array(long, np.int64)
            row = [now, int((n > 0).sum()), int(n.sum()), term[first].astype("<i4").tobytes(), first.astype("<i4").tobytes(), narrow(place), narrow(many), n.tobytes()]
            cols = [pa.array([v]) for v in row] + [pa.array([ids], pa.list_(pa.int64()))]
            ids.clear(), long.clear(), held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["shard", "n_docs", "n_terms", "terms", "starts", "places", "counts", "lengths", "ids"])

        pending = 0
        for b in batches:
            for number, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if number // shard != now:
                    if now is not None:
                        yield out()
                    now, pending = number // shard, 0
                n = 0
                for words in pieces(text.as_py()):
                    n += len(words)
                    at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    at = at[at >= 0]
                    some.append((at, len(ids)))
                    pending += len(at) + 100
                    if pending > 1_000_000:
                        taken()
                        pending = 0
                ids.append(i)
                long.append(n)
        if now is not None:
            yield out()

    return run


_BLOCK = "shard bigint, n_docs bigint, n_terms bigint, terms binary, starts binary, places binary, counts binary, lengths binary, ids array<bigint>"


def _frequencies(batches):
    for b in batches:
        for terms, starts, places in zip(*(b.column(c).to_pylist() for c in ("terms", "starts", "places"))):
            first = np.frombuffer(starts, "<i4")
            df = np.diff(np.append(first, len(widened(places))))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i4")), pa.array(df.astype(np.int64))], names=["term", "df"])


def _owned(weights, stages: int, base: int, total: tuple[int, int], tenths: int, percent: int):
    """A shard's postings dealt to the stages that own their terms, with the most that each later term gives in the shard."""
    docs, words = total

    def run(batches):
        weight, owner = weights.value
        for b in batches:
            for shard, terms, starts, places, counts, lengths, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "terms", "starts", "places", "counts", "lengths", "ids"))):
                term, first = np.frombuffer(terms, "<i4"), np.frombuffer(starts, "<i4")
                place, tf, n = widened(places).astype(np.int64), widened(counts).astype(np.int64), np.frombuffer(lengths, "<i8")
                m = np.array([100 - percent + percent * x * docs // words for x in n.tolist()], np.int64)
                many = np.diff(np.append(first, len(place)))
                gain = np.repeat(weight[term], many) * ((UNIT * tf) // (1000 * tf + tenths * m[place]))
                later = np.zeros(len(term), _LATER)
                later["term"] = term.astype(np.int64) + base
                later["most"] = np.maximum.reduceat(gain, first) if len(first) else 0
                own = owner[term]
                rows = []
                for s in range(stages):
                    mine = own == s
                    wide = np.repeat(mine, many)
                    rows.append((shard, s, later["term"][mine].tobytes(), np.concatenate([[0], np.cumsum(many[mine])]).astype("<i4").tobytes(), narrow(place[wide]), narrow(gain[wide]), later[own > s].tobytes(), len(n), ids if s == stages - 1 else None))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.list_(pa.int64()))],
                    names=["shard", "stage", "terms", "starts", "places", "gains", "later", "n", "ids"])

    return run


_POSTINGS = "shard bigint, stage int, terms binary, starts binary, places binary, gains binary, later binary, n int, ids array<bigint>"
_BUNDLE = "lane int, block int, shard bigint, item_id bigint, terms binary, docs binary, scores binary, closed boolean"


class Shard:
    """What one stage's owner holds of a shard."""

    def __init__(self):
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most: dict[int, int] = {}
        self.n, self.ids = 0, None

    def add(self, row: dict) -> None:
        first, place, gain = np.frombuffer(row["starts"], "<i4").tolist(), widened(row["places"]).astype(np.int64), widened(row["gains"]).astype(np.int64)
        for k, t in enumerate(np.frombuffer(row["terms"], "<i8").tolist()):
            self.at[t] = place[first[k] : first[k + 1]], gain[first[k] : first[k + 1]]
        self.most |= dict(np.frombuffer(row["later"], _LATER).tolist())
        self.n, self.ids = row["n"], row["ids"] or self.ids

    def step(self, stage: int, top: int, terms: np.ndarray, docs: np.ndarray, scores: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """An accumulator after this stage's additions; ``closed`` says that documents it lacks can no longer come among the best."""
        total = np.zeros(self.n, np.int64)
        total[docs] = scores
        for t in terms["term"][terms["stage"] == stage].tolist():
            if t in self.at:
                place, gain = self.at[t]
                total[place] += gain
        docs = docs if closed else np.flatnonzero(total)
        scores = total[docs]
        rest = sum(self.most.get(t, 0) for t in terms["term"][terms["stage"] > stage].tolist())
        if len(docs) >= top:
            least = np.partition(scores, len(scores) - top)[len(scores) - top]
            keep = scores + rest >= least
            docs, scores, closed = docs[keep], scores[keep], closed or rest < least
        return docs, scores, closed


def _stage(stage: int, last: bool, top: int):
    def run(key, bundles: pa.Table, postings: pa.Table) -> pa.Table:
        shards: dict[int, Shard] = {}
        for row in postings.to_pylist():
            shards.setdefault(row["shard"], Shard()).add(row)
        out = []
        for b in bundles.to_pylist():
            terms = np.frombuffer(b["terms"], _OWNED)
            for number in [b["shard"]] if b["shard"] is not None else shards:
                own = shards[number]
                docs, scores, closed = own.step(stage, top, terms, np.frombuffer(b["docs"], "<u4").astype(np.int64), np.frombuffer(b["scores"], "<i8"), b["closed"])
                if not last:
                    out.append((b["lane"], b["block"], number, b["item_id"], b["terms"], docs.astype("<u4").tobytes(), scores.tobytes(), closed))
                    continue
                ids = [own.ids[d] for d in docs.tolist()]
                best = sorted(zip((-scores).tolist(), [i is None for i in ids], [i or 0 for i in ids]))[:top]
                out += [(b["item_id"], None if none else i, -s) for s, none, i in best]
        if last:
            cols = list(zip(*out)) or [()] * 3
            return pa.table([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])
        cols = list(zip(*out)) or [()] * 8
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=re.findall(r"(\w+) \w+", _BUNDLE))

    return run


def rank(
    documents: DataFrame, items: DataFrame, top: int = 10, tenths: int = 8, percent: int = 90, stages: int = 4, shard: int = 8192, block: int = 256,
    part_bytes: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0.

    A document's score sums ``w * ((10**9 * tf) div (1000 * tf + tenths * m))`` over the item's terms, once each, with ``w = floor(1000 * ln((2 N + 2) /
    (2 df + 1)))`` and ``m = 100 - percent + (percent * n * N) div L``.  ``shard`` documents and ``block`` items meet in one task.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    wanted = stored(item_terms(items, item_col, item_text), "ranked-terms")
    size = wanted.select("term").distinct().agg(F.sum(F.octet_length("term") + 64).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    docs = documents.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if parts > 1:  # several passes have to see the same shards
        docs = stored(docs, "ranked-docs")
    found = []
    for p in range(parts):
        terms = sc.broadcast(sorted(bytes(r["term"]) for r in wanted.where(part == p).select("term").distinct().collect()))
        found.append((p, terms, stored(docs.mapInArrow(_indexed(terms, shard), _BLOCK), "ranked-index")))
    totals = found[0][2].agg(F.count("*").alias("shards"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n, words, lanes = totals["n"], totals["l"], max(1, totals["shards"])
    if not n:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    postings = bundles = None
    for p, terms, index in found:
        df = np.zeros(len(terms.value), np.int64)
        for r in index.mapInArrow(_frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        owner = np.array([sum(x * 10**j >= n for j in range(1, stages)) for x in df.tolist()], np.int64)
        base = p << 32
        weights = sc.broadcast((weight, owner))

        def numbered(batches, terms=terms, weights=weights, base=base):
            place, owner = {t: k for k, t in enumerate(terms.value)}, weights.value[1]
            for b in batches:
                at = np.array([place[t] for t in b.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at + base), pa.array(owner[at])], names=["item_id", "term", "stage"])

        own = index.mapInArrow(_owned(weights, stages, base, (n, words), tenths, percent), _POSTINGS)
        asked = wanted.where(part == p).mapInArrow(numbered, "item_id bigint, term bigint, stage bigint")
        postings, bundles = (own, asked) if postings is None else (postings.unionByName(own), bundles.unionByName(asked))
    postings = stored(postings.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int")), "ranked-postings")

    def opened(batches):
        for b in batches:
            raw = [np.array([(t["term"], t["stage"]) for t in own], _OWNED).tobytes() for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["item_id", "terms"])

    bundles = stored(bundles.groupBy("item_id").agg(F.collect_list(F.struct("term", "stage")).alias("terms")).mapInArrow(opened, "item_id bigint, terms binary"), "ranked-items")
    bundles, many = blocks(bundles, block, "block", "item_id")
    none = F.lit(b"").cast("binary")
    bundles = every_block(bundles, "lane", lanes).select("lane", "block", F.lit(None).cast("long").alias("shard"), "item_id", "terms", none.alias("docs"), none.alias("scores"), F.lit(False).alias("closed"))
    for s in range(stages):
        last = s == stages - 1
        owned = every_block(postings.where(F.col("stage") == s), "block", many)
        bundles = bundles.groupBy("lane", "block").cogroup(owned.groupBy("lane", "block")).applyInArrow(_stage(s, last, top), "item_id bigint, doc_id bigint, score bigint" if last else _BUNDLE)
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return bundles.where("score > 0").withColumn("rank", best).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
