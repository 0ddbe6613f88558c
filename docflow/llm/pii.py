"""Personal data: four kinds found by their form, more found by the company they keep.  DataFrame functions only.

``find_pii`` takes the four base kinds by pattern (leftmost, non-overlapping, checked afterwards, no retries), then runs a
bootstrapped contextual extraction: the base matches are seeds, the words around a seed are its lexical patterns, the
bipartite graph of patterns and identifier-like spans is scored in rounds, and patterns of high confidence contribute
spans that no base pattern matched.  These are seeds of further patterns, until nothing new is found.

Offsets are code points, ends exclusive.  Null texts count as empty.  A null id is kept as it is.  Repeated rows each get
the same answer.  Extra columns of the input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BASE = ("email", "ip", "card", "phone")

# Possessive forms of the contract's patterns: where the original could not have matched differently by giving characters
# back, nothing is given back, and a match starts only at the start of a run (or at the end of the match before), so that
# long runs cost linear time and the regex engine does not recurse.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: cheap tests that spare most texts the pattern
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9]", "phone": r"\+[0-9]"}
#: identifier-like spans of a text whose base spans are overlaid with the character 1: such a span, digit groups one space
#: apart, or a word with a digit or an at sign
TOKEN = (
    r"\x01++"
    r"|(?<![^\x20\x09-\x0D\x01,;:=<\[])[(+]*+[0-9][0-9().+/-]*+(?:\x20[(+]*+[0-9][0-9().+/-]*+)*+(?![^\x20\x09-\x0D\x01,;:!?>\]])"
    r"|(?<![^\x20\x09-\x0D\x01])[^\x20\x09-\x0D0-9@\x01]*+[0-9@][^\x20\x09-\x0D\x01]*+"
)
#: what may be added and become a seed
IDENTIFIER = "(value like '%@%' or length(regexp_replace(value, '[^0-9]', '')) >= 5)"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _chunked(items: str, zero: dict[str, str], step: str) -> str:
    """SQL of the arrays ``out`` that a fold over ``items`` gathers, one for each run of about sqrt(n) items.

    ``step`` is a lambda of a state with the fields of ``zero`` (among them ``out``, empty) and an item.  Each run starts with the state that
    the one before it left, but gathers into an array of its own: n items copy n * sqrt(n) entries, not n * n.
    """
    first = ", ".join(f"'{n}', {v}" for n, v in zero.items())
    again = ", ".join(f"'{n}', {zero[n] if n == 'out' else f'element_at(runs, -1).{n}'}" for n in zero)
    width = "greatest(1, cast(sqrt(size(p)) as int))"
    return f"""element_at(transform(array({items}), p -> aggregate(
          transform(sequence(0, greatest(size(p) - 1, 0), {width}), i -> slice(p, i + 1, {width})),
          array(named_struct({first})),
          (runs, run) -> concat(runs, array(aggregate(run, named_struct({again}), {step}))),
          runs -> transform(runs, z -> z.out))), 1)"""


def _places(text: Column, pattern: str, kind: str) -> Column:
    """Matches of ``pattern`` with offsets: the pieces between matches and the matches alternate, so lengths add up."""
    runs = _chunked(
        f"arrays_zip(split({text}, {_q(pattern)}, -1), regexp_extract_all({text}, {_q(pattern)}, 0))",
        {"at": "0L", "out": f"cast(array() as {SPAN})"},
        f"""(s, x) -> named_struct(
            'at', s.at + length(x.`0`) + coalesce(length(x.`1`), 0),
            'out', if(x.`1` is null, s.out, concat(s.out, array(named_struct('kind', '{kind}', 'start', s.at + length(x.`0`),
              'end', s.at + length(x.`0`) + length(x.`1`), 'value', x.`1`)))))""",
    )
    return F.expr(f"flatten({runs})")


def _q(pattern: str) -> str:
    return "r'" + pattern + "'"


def _valid(span: Column) -> Column:
    """The checks of each kind: parts at most 255; 16 to 19 digits passing Luhn; 8 to 15 digits."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    small = F.forall(F.split(span["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    back = F.reverse(digits)

    def luhn(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    card = F.length(digits).between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19))), F.lit(0), luhn) % 10 == 0)
    return (
        F.when(span["kind"] == "email", F.lit(True))
        .when(span["kind"] == "ip", small)
        .when(span["kind"] == "card", card)
        .otherwise(F.length(digits).between(8, 15))
    )


def base_spans(text: str = "text") -> Column:
    """Array of base spans of the (non-null) text column, by kind as listed, then start."""
    none = F.expr(f"cast(array() as {SPAN})")
    return F.concat(*(F.when(F.col(text).rlike(HINTS[k]), F.filter(_places(text, PATTERNS[k], k), _valid)).otherwise(none) for k in BASE))


def _replaced(text: str, spans: Column, fill) -> Column:
    """The text column with each of ``spans`` (sorted by start) replaced by ``fill(span, at)``; ``at`` is where the span before
    it ended.  What a span covers of a later one is not replaced twice; a span inside an earlier one is passed over.

    Runs of about sqrt(n) spans work on their own piece of the text, so that no span copies or counts through all of it.
    """
    width = F.greatest(F.lit(1), F.sqrt(F.size(spans)).cast("int"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(s["piece"], (s["at"] - s["base"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - s["at"]).cast("int"))
        out = F.when(x["end"] > s["at"], F.concat(s["out"], gap, fill(x, s["at"]))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"), s["piece"].alias("piece"), s["base"].alias("base"))

    def run(s: Column, part: Column) -> Column:
        reach = F.array_max(F.transform(part, lambda x: x["end"]))
        piece = F.substring(s["rest"], F.lit(1), F.greatest(F.lit(0), reach - s["at"]).cast("int"))
        start = F.struct(s["at"].alias("at"), F.lit("").alias("out"), piece.alias("piece"), s["at"].alias("base"))
        new = F.concat(s["out"], F.aggregate(part, start, step, lambda e: e["out"]))
        left = F.substring(s["rest"], (F.greatest(F.lit(0), reach - s["at"]) + 1).cast("int"), F.length(s["rest"]))
        return F.struct(F.greatest(s["at"], reach).alias("at"), new.alias("out"), left.alias("rest"))

    parts = F.transform(F.sequence(F.lit(1), F.size(spans), width), lambda i: F.slice(spans, i, width))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.col(text).alias("rest"))
    return F.when(F.size(spans) > 0, F.aggregate(parts, zero, run, lambda e: F.concat(e["out"], e["rest"]))).otherwise(F.col(text))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(x: str) -> str:
    """SQL of the words of a string: lower case, letters and a few signs, digits with what follows them as one sign."""
    signs = rf"regexp_replace(regexp_replace(lower({x}), r'[0-9\x01][^\x20\x09-\x0D]*', '#'), r'[^\p{{L}} :#=\x09-\x0D]', '')"
    return rf"filter(split({signs}, r'[\x20\x09-\x0D]+'), w -> w <> '')"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, hash of the text, base spans, and candidates with their patterns.

    A candidate is a base span (then it is a seed, of the kind of the one that starts there) or a TOKEN beside them.  Its
    patterns are the last one, two and three words to its left, and the last with the first to its right; digits in them
    are one sign, and the text's ends are words.  ``near`` is the last word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans().alias("base"))
    d = d.withColumn("bare", F.translate("text", "\x01", " ")).withColumn("sorted", F.array_sort(F.transform("base", lambda b: F.struct(b["start"], b["end"]))))
    d = d.withColumn("masked", _replaced("bare", F.col("sorted"), lambda x, at: F.repeat(F.lit("\x01"), (x["end"] - F.greatest(x["start"], at)).cast("int"))))
    kind = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"
    d = d.withColumn("gaps", F.when(F.col("masked").rlike(r"[0-9@\x01]"), F.expr(f"split(masked, {_q(TOKEN)}, -1)"))).withColumn("hits", F.when(F.col("gaps").isNotNull(), F.expr(f"regexp_extract_all(masked, {_q(TOKEN)}, 0)")))
    # a context is words, wherever they stand: the last three carry over from token to token, white space and signs of any length between them
    last = lambda x: f"array_join(slice(concat(array('^', '^', '^'), {_plain(x)}), -3, 3), ' ')"
    runs = _chunked(
        "arrays_zip(gaps, hits, slice(gaps, 2, size(gaps)), slice(hits, 2, size(gaps)))",
        {"at": "0L", "tail": "''", "out": f"cast(array() as {kind})"},
        f"""(s, x) -> named_struct(
            'at', s.at + length(x.gaps) + coalesce(length(x.hits), 0),
            'tail', {last("concat(s.tail, x.gaps, coalesce(x.hits, ''))")},
            'out', if(x.hits is null, s.out, concat(s.out, array(named_struct('start', s.at + length(x.gaps),
              'end', s.at + length(x.gaps) + length(x.hits), 'value', x.hits, 'left', {last("concat(s.tail, x.gaps)")},
              'right', try_element_at({_plain("concat(x.`2`, coalesce(x.`3`, ''))")}, 1))))))""",
    )
    found = F.when(F.col("gaps").isNotNull(), F.expr(runs)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
    d = d.select("doc_id", "text_hash", "base", found.alias("found"))

    def candidate(c: Column, base: Column) -> Column:
        seed = F.when(c["value"].startswith("\x01"), F.try_element_at(F.filter(base, lambda b: b["start"] == c["start"]), F.lit(1)))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.regexp_replace(F.lower(F.coalesce(seed["value"], c["value"])), r"^[^a-z0-9+@]+|[^a-z0-9]+$", "").alias("value"),
            F.split(c["left"], " ").alias("words"),
            F.coalesce(c["right"], F.lit("$")).alias("next"),
            seed["kind"].alias("seed"),
        )

    def patterned(c: Column) -> Column:
        w = [F.element_at(c["words"], k) for k in (1, 2, 3)]
        patterns = F.array(w[2], F.concat_ws(" ", w[1], w[2]), F.concat_ws(" ", *w), F.concat_ws(" ", w[2], F.lit("_"), c["next"]))
        return F.struct(*(c[n].alias(n) for n in ("start", "end", "value", "seed")), w[2].alias("near"), patterns.alias("patterns"))

    def seeded(run: Column) -> Column:
        """The candidates of a run; only the base spans that start within it are searched for theirs."""
        near = F.filter("base", lambda b: (b["start"] >= F.get(run, F.lit(0))["start"]) & (b["start"] <= F.try_element_at(run, F.lit(-1))["start"]))
        return F.get(F.transform(F.array(near), lambda base: F.transform(run, lambda c: candidate(c, base))), F.lit(0))

    kept = F.transform(F.filter(F.flatten(F.transform("found", seeded)), lambda c: (c["value"] != "")), patterned)
    return d.select("doc_id", "text_hash", "base", F.when(F.size("found") > 0, kept).alias("found"))


def confident_patterns(found: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6, salts: int = 16) -> DataFrame:
    """``(pattern, kind, score)`` of the patterns that the graph of ``found (pattern, near, value, seed)`` makes credible.

    A pattern scores the share of its distinct instances that are believed, an instance the noisy-or of its patterns (of
    those that end in one word, the best: they are one context), in ``rounds`` scorings; seeds stay at 1.  Only patterns with at least ``least_seeds`` distinct seed values start, and a pattern
    keeps the kind most of its seeds have (first by name on ties).  Instances of credible patterns then become seeds, of the
    kind of their best pattern, and patterns start anew from all seeds, until no instance is new.  Joins on a pattern are
    salted by instance.
    """
    edges = found.groupBy("pattern", "near", "value").agg(F.min("seed").alias("seed"))
    edges = stored(edges.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")), "pii-edges")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    told = edges
    while True:
        votes = told.where("seed is not null").groupBy("pattern", "seed").agg(F.count("*").alias("n"))
        start = votes.groupBy("pattern").agg(F.sum("n").alias("seeds"), F.max_by("seed", F.struct("n", F.expr("-ascii(seed)"))).alias("kind")).where(F.col("seeds") >= least_seeds)
        live = stored(told.join(start.select("pattern", "kind", spread), ["pattern", "salt"]), "pii-graph")
        belief = live.select("pattern", "kind", "value", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("belief"))
        scores = belief.groupBy("pattern", "kind").agg((F.sum("belief") / (F.count("*") + F.lit(1.0))).alias("score"))
        for _ in range(rounds - 1):
            scored = live.join(scores.select("pattern", "score", spread), ["pattern", "salt"])
            doubt = scored.groupBy("value", "near").agg(F.max("score").alias("score")).groupBy("value").agg((F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.000001) - F.col("score"))))).alias("hope"))
            belief = live.join(doubt, "value").select("pattern", "kind", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("hope") * F.col("hope")).alias("belief"))
            scores = stored(belief.groupBy("pattern", "kind").agg((F.sum("belief") / (F.count("*") + F.lit(1.0))).alias("score")), "pii-scores")
        good = stored(scores.where(F.col("score") >= confidence), "pii-good")
        fresh = live.drop("kind").where("seed is null").where(IDENTIFIER).join(good.select("pattern", "kind", "score", spread), ["pattern", "salt"])
        fresh = stored(fresh.groupBy("value").agg(F.max_by("kind", F.struct("score", F.expr("-ascii(kind)"))).alias("new")), "pii-fresh")
        if fresh.isEmpty():
            return good
        told = stored(told.join(fresh, "value", "left").select("pattern", "near", "value", F.coalesce("seed", "new").alias("seed"), "salt"), "pii-edges")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """``(doc_id, text_hash, base, added)``: spans as arrays of (kind, start, end, value); added kinds are ``ctx_<kind>``.

    An added span has at least five digits or an at sign; it never overlaps a base span.
    """
    d = stored(scanned(docs, id_col, text_col), "pii-scan")
    found = d.select("doc_id", "text_hash", F.explode("found").alias("c")).select("doc_id", "text_hash", "c.*")
    found = stored(found.withColumn("pattern", F.explode("patterns")).drop("patterns"), "pii-found")
    good = confident_patterns(found, rounds, least_seeds, confidence)
    spread = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    fresh = found.where("seed is null").where(IDENTIFIER)
    fresh = fresh.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(16)).cast("int")).join(good.select("pattern", "kind", "score", spread), ["pattern", "salt"])
    fresh = fresh.groupBy("doc_id", "text_hash", "start", "end", "value").agg(F.max_by("kind", F.struct("score", F.expr("-ascii(kind)"))).alias("kind"))
    fresh = fresh.select("doc_id", "text_hash", F.struct(F.concat(F.lit("ctx_"), "kind").alias("kind"), "start", "end", "value").alias("s"))
    added = fresh.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("added"))
    same = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_hash") == F.col("a.text_hash"))
    return d.alias("d").join(added.alias("a"), same, "left").select(
        "d.doc_id", "d.text_hash", "d.base", F.coalesce(F.col("a.added"), F.expr(f"cast(array() as {SPAN})")).alias("added")
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_pii``'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; null texts stay null.

    Of overlapping spans the one that starts first (the longer on ties) gives the mark, which stands for all that they cover.  ``n_chars`` follows the new text.
    """
    found = find_pii(docs, **options).select("doc_id", "text_hash", F.concat("base", "added").alias("pii_spans")).where(F.size("pii_spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("f.text_hash"))
    d = docs.alias("d").join(found.alias("f"), same, "left")
    ordered = F.array_sort("f.pii_spans", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    d = d.withColumn("__spans", ordered)
    mark = lambda x, at: F.when(x["start"] >= at, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
    text = F.when(F.col("f.pii_spans").isNull(), F.col("d.text")).otherwise(_replaced("d.text", F.col("__spans"), mark))
    cols = [F.col(f"d.{c}") for c in docs.columns]
    new = d.select(*cols, text.alias("__clean"), F.col("f.pii_spans").isNotNull().alias("__hit"))
    new = new.withColumn("text", F.col("__clean"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)
