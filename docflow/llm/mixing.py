"""Mixing sources to target weights by hierarchical budgeting.  DataFrame functions only.

A budget of tokens runs down a tree (such as domain, language, source): a node's budget is shared among its children by weight;
a child that cannot use its share (its tokens times the most epochs) takes what it can, and its shortage goes to its
siblings first; only what a whole family cannot use was never given to it, and stays with its ancestors' other
families.  A leaf takes whole epochs of its documents and, of one more epoch, a prefix: the documents in the
order of a seeded hash while their tokens fit.

Tokens are white-space words of the text (null: none).  Null level values are one group of their own, named ``""``; null
ids hash as the text ``null``.  Documents of equal id are together in the order: they all enter a prefix or
none does.  Documents that get no copy are left out.  An empty table gives an empty result.  Extra columns are kept; in
``mix`` those that are named like a result column give way to it (as in ``withColumn``), ``repeated`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UNIT = 4096  # documents a hash range holds, about
HASH_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, levels: list[str], share: float, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """``leaves (levels, leaf_docs, leaf_tokens)`` with ``leaf_budget``: the tree has a row a node, documents are gone.

    ``share`` is the budget as a share of all tokens; ``weights`` gives a level's weight from its node's columns (1 where
    none is given).  A node of weight 0 or less gets nothing.
    """
    open_ = F.lit(True)
    for level in levels:
        open_ = open_ & (weights.get(level, F.lit(1.0)) > 0)
    leaves = leaves.withColumn("cap", F.when(open_, F.col("leaf_tokens") * max_epochs).otherwise(0).cast("double"))
    every = Window.partitionBy(F.lit(0))
    leaves = leaves.withColumn("root", F.least(F.sum("leaf_tokens").over(every) * share, F.sum("cap").over(every)))
    for depth in range(1, len(levels) + 1):
        path, above = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("root").alias("budget")).withColumn("w", F.greatest(weights.get(path[-1], F.lit(1.0)).cast("double"), F.lit(0.0)))
        if above:
            nodes = nodes.drop("budget").join(given, above)
        family = Window.partitionBy(*(above or [F.lit(0)]))
        rising = family.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), path[-1])
        before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        from_here = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("cap") * from_here <= F.col("w") * (F.col("budget") - before))
        filled = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(family)
        open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(family)
        got = F.when(F.col("full"), F.col("cap")).when(open_w > 0, F.least(F.col("cap"), F.col("w") * (F.col("budget") - filled) / open_w)).otherwise(0.0)
        given = nodes.select(*path, got.alias("budget"))
    return leaves.drop("cap", "root").join(given.withColumnRenamed("budget", "leaf_budget"), levels).withColumn("leaf_budget", F.floor(F.col("leaf_budget") + 1e-6).cast("long"))


def _place(seed: int) -> Column:
    """Where a document stands in its epoch: 60 bits of a seeded hash."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, levels: list[str], share: float, weights: dict[str, Column], max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """A row a leaf: its budget, whole epochs, and the end of the next epoch's prefix (``below`` or up to ``last``).

    ``docs`` has doc_id, levels and tokens.  Hash ranges of about UNIT documents are summed first; only the range in which
    a prefix ends is ordered document by document, so that a leaf with a third of all rows is spread over tasks.
    """
    leaves = docs.groupBy(*levels).agg(F.count("*").alias("leaf_docs"), F.sum("tokens").alias("leaf_tokens"))
    p = budgets(leaves, levels, share, weights, max_epochs)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(0).cast("long")
    p = p.withColumn("epochs", whole).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("leaf_docs") / F.lit(float(UNIT))))).cast("int")
    p = stored(p.withColumn("bits", bits), "mix-plan")
    placed = _with_leaf(docs, p, levels).where("rest > 0").withColumn("place", _place(seed))
    placed = placed.withColumn("range", F.expr(f"shiftright(place, {HASH_BITS} - bits)"))
    ranges = placed.groupBy(*levels, "range", "rest").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*levels).orderBy("range"))
    ends = ranges.withColumn("before", upto - F.col("t")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    ends = stored(ends.select(*levels, F.col("range").alias("end_range"), "before"), "mix-ends")
    near = _with_leaf(placed, ends, levels).where(F.col("range") == F.col("end_range"))
    so_far = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("place", "doc_id"))
    lasts = near.withColumn("so_far", so_far + F.col("before")).where("so_far <= rest").groupBy(*levels).agg(F.max(F.struct("place", "doc_id")).alias("last"))
    p = p.join(ends, levels, "left").join(lasts, levels, "left")
    return stored(p.withColumn("below", F.expr(f"shiftleft(end_range, {HASH_BITS} - bits)")), "mix-cuts")


def _with_leaf(docs: DataFrame, per_leaf: DataFrame, levels: list[str], salts: int = 64) -> DataFrame:
    """Join rows with their leaf's one row; salted, for leaves that hold very many rows."""
    spread = per_leaf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(spread, [*levels, "__salt"]).drop("__salt")


def _mixed(docs: DataFrame, levels: dict[str, Column], share: float, weights: dict[str, Column] | None, max_epochs: int, seed: int, row: Column | None) -> DataFrame:
    """``(row, doc_id, levels, tokens, leaf_budget, copies)``; without ``row`` texts are read once."""
    names = [f"mix_{k}" for k in levels]
    named = docs.select(*([row.alias("row")] if row is not None else []), "doc_id", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())), n_words(F.col("text")).alias("tokens"))
    small = stored(named.select("doc_id", *names, "tokens"), "mix-docs")
    cuts = plan(small, names, share, {f"mix_{k}": v for k, v in (weights or {}).items()}, max_epochs, seed)
    got = _with_leaf(named if row is not None else small, cuts.select(*names, "leaf_budget", "epochs", "rest", "below", "last"), names).withColumn("place", _place(seed))
    upto = F.coalesce((F.col("place") < F.col("below")) | (F.struct("place", "doc_id") <= F.col("last")), F.col("place") < F.col("below"), F.lit(False))
    got = got.withColumn("copies", F.col("epochs") + F.when((F.col("rest") > 0) & upto, 1).otherwise(0))
    return got.where("copies > 0").select(*(["row"] if row is not None else []), "doc_id", *names, "tokens", "leaf_budget", "copies")


def mix(docs: DataFrame, levels: dict[str, Column], share: float, weights: dict[str, Column] | None = None, max_epochs: int = 4, seed: int = 17, whole_rows: bool = True) -> DataFrame:
    """``docs`` that get a copy, with the level columns (prefixed ``mix_``), ``tokens``, ``leaf_budget`` and ``copies``.

    Without ``whole_rows`` only doc_id is kept of the documents' columns, and their texts are read once.
    """
    new = [*(f"mix_{k}" for k in levels), "tokens", "leaf_budget", "copies"]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}] if whole_rows else ["doc_id"]
    got = _mixed(docs, levels, share, weights, max_epochs, seed, F.struct(*kept) if whole_rows else None)
    return got.select(*([f"row.{c}" for c in kept] if whole_rows else kept), *new)


def repeated(docs: DataFrame, levels: dict[str, Column], share: float, weights: dict[str, Column] | None = None, max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that get a copy, each once for each copy."""
    got = _mixed(docs, levels, share, weights, max_epochs, seed, F.struct("*"))
    return got.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
