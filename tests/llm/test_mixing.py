"""Budgets against water filled by bisection, prefixes against a plain walk: ties, repeated rows, null levels and ids, a very long text."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from docflow.llm import mixing

WEIGHTS = {"a": {"x": 4.0, "y": 2.0, "z": 0.0}, "b": {"p": 3.0}}


def poured(caps, weights, budget):
    """Each takes weight times a level, at most its cap; the level that uses the budget, by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, w * mid) for c, w in zip(caps, weights)) < budget else (lo, mid)
    return [min(c, w * hi) for c, w in zip(caps, weights)]


def brute(rows, share, epochs, seed):
    leaf = collections.defaultdict(list)
    for doc, a, b, text in rows:
        leaf[a or "", b or ""].append((doc, len((text or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    cap = {k: epochs * n if WEIGHTS["a"].get(k[0], 1.0) > 0 and WEIGHTS["b"].get(k[1], 1.0) > 0 else 0 for k, n in tokens.items()}
    tops = sorted({k[0] for k in leaf})
    given = dict(zip(tops, poured([sum(c for k, c in cap.items() if k[0] == t) for t in tops], [WEIGHTS["a"].get(t, 1.0) for t in tops], min(sum(tokens.values()) * share, sum(cap.values())))))
    out = {}
    for t in tops:
        own = sorted(k for k in leaf if k[0] == t)
        for k, got in zip(own, poured([cap[k] for k in own], [WEIGHTS["b"].get(k[1], 1.0) for k in own], given[t])):
            got = math.floor(got + 1e-6)
            whole = got // tokens[k] if tokens[k] else 0
            rest, so_far, copies = got - whole * tokens[k], 0, {}
            place = lambda d: int(hashlib.md5(f"{seed}:{whole}:{'null' if d is None else d}".encode()).hexdigest()[:15], 16)
            groups = collections.defaultdict(list)
            for d, n in leaf[k]:
                groups[place(d), d is not None, d or 0].append(n)
            for key in sorted(groups):
                so_far += sum(groups[key])
                copies[key[2] if key[1] else None] = whole + (1 if rest > 0 and so_far <= rest else 0)
            for d, n in leaf[k]:
                if copies[d]:
                    out.setdefault((d, *k, n, got, copies[d]), 0)
                    out[d, *k, n, got, copies[d]] += 1
    return out


@pytest.mark.parametrize("share, epochs, seed", [(0.4, 1, 17), (0.9, 2, 3), (3.0, 2, 17)])
def test_budgets_and_prefixes(spark, share, epochs, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", "z", "v", None]), rng.choice(["p", "q", "q", "q", None]), " w" * rng.choice([0, 1, 5, 5, 5, 40])) for i in range(400)]
    rows += [(1000 + i, "tie", f"t{i % 4}", "one two three") for i in range(40)]  # equal caps and weights
    rows += [rows[7], rows[7], (None, "x", "q", "no id at all"), (None, "x", "q", "no id at all"), (2000, "x", "q", None), (2001, "y", "p", "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string, text string").withColumn("tokens", F.lit("clash")).withColumn("budget", F.lit("clash"))
    level = lambda n: F.create_map(*(F.lit(x) for kv in WEIGHTS[n].items() for x in kv))[F.col(f"mix_{n}")]
    weights = {n: F.coalesce(level(n), F.lit(1.0)) for n in WEIGHTS}
    got = mixing.mix(docs, {"a": F.col("a"), "b": F.col("b")}, share=share, weights=weights, max_epochs=epochs, seed=seed, whole_rows=False)
    told = collections.Counter((r.doc_id, r.mix_a, r.mix_b, r.tokens, r.leaf_budget, r.copies) for r in got.collect())
    assert told == brute(rows, share, epochs, seed) and told
    again = mixing.repeated(docs, {"a": F.col("a"), "b": F.col("b")}, share=share, weights=weights, max_epochs=epochs, seed=seed)
    assert again.columns == docs.columns and again.count() == sum(n * k[-1] for k, n in told.items())
