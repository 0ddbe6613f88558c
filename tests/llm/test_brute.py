"""Operators against plain Python on whole small tables, and what nulls, repeats, clashing columns and long texts give."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import collisions, jaccard, langid, licenses, lm, media, mixing, packing, pii, queries, warc
from docflow.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"en": ["the", "and", "ing", "th", "wh", "ou", "er"], "de": ["der", "sch", "ung", "ch", "ei", "ü", "ß"], "fr": ["les", "eau", "tion", "é", "qu", "oi", "ç"]}


def fold(doc, parts):
    return zlib.crc32(("null" if doc is None else str(doc)).encode()) % parts


def texts(n, seed, vocabulary=60):
    """Texts of invented words, more often the first ones, in three languages."""
    rng = np.random.default_rng(seed)
    words = {lang: ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(vocabulary)] for lang, parts in SOUNDS.items()}
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        at = np.minimum(rng.zipf(1.4, rng.integers(3, 60)), vocabulary) - 1
        out.append((i, " ".join(words[lang][k] for k in at), lang if i % 7 else None, f"s{i % 4}", 0))
    return out


HARD = [(900, None, "en", "s1", 0), (901, "", None, None, None), (902, " \t\n ", "de", "s1", 0), (903, "12 34 -- !", "fr", "s0", 0), (None, "no id of the row", "en", None, None), (5, "the same id twice", "en", "s1", 0), (904, "wörd " * 40_000, "de", "s2", 0)]


@pytest.fixture(scope="module")
def rows():
    got = texts(150, 1) + HARD
    return got + [got[0], got[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def grams(text):
    n = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f"_{w}_"
        n.update(g for k in (1, 2, 3) for i in range(len(w) - k + 1) if (g := w[i : i + k]) != "_")
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:300]], n


def test_languages_against_brute_force(docs, rows):
    totals = collections.defaultdict(collections.Counter)
    for d, t, lang, *_ in rows:
        if lang is not None and fold(d, 5):
            totals[lang].update(grams(t)[1])
    ranks = {lang: {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:300])} for lang, n in totals.items()}
    want = []
    for d, t, *_ in rows:
        top, _ = grams(t)
        far = min((sum(abs(r[g] - i) if g in r else 300 for i, g in enumerate(top)), lang) for lang, r in ranks.items())
        want.append((str(d), far[1], round(1 - far[0] / (300 * len(top)), 9)) if top else (str(d), "und", 0.0))
    teach = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(5)) != 0
    got = langid.identify(docs, teach).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)
    held = [(x[1], x[2]) for x in zip((r[0] for r in rows[:150]), (r[2] for r in rows[:150]), (w[1] for w in want[:150])) if x[1] and not fold(x[0], 5)]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(held) > 10


@pytest.mark.parametrize("order", [2, 3])
def test_interpolated_scores_against_brute_force(docs, rows, order):
    """Scores are those of plain Python with the same bins of held-out estimates; without bins they differ by two hundredths at most, and in sum by half of one."""
    start, end = 0, 1
    count, gone = ([collections.Counter() for _ in range(order + 1)] for _ in range(2))
    streams = []
    for d, t, *_ in rows:
        s = [start] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [end]
        streams.append(s)
        if fold(d, 7) == 2:
            continue
        for held in (count, gone) if fold(d, 7) == 3 else (count,):
            for i in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    held[k][tuple(s[i - k + 1 : i + 1])] += 1
                    if k < order and i == order - 1:
                        held[k][(start,) * k] += 1  # the context of a first word
    words = [g for g in count[1] if g != (start,)]
    n, v = sum(count[1][g] for g in words), len(words)
    nd = sum(gone[1][g] for g in words)

    def estimates(s, i, less):
        c = lambda g: count[len(g)][g] - (gone[len(g)][g] if less else 0)
        ps = [1 / (v + 1), c((s[i],)) / (n - nd if less else n)]
        for k in range(2, order + 1):
            h = c(tuple(s[i - k + 1 : i]))
            ps.append(c(tuple(s[i - k + 1 : i + 1])) / h if h else 0)
        return np.array(ps), int(math.log2(h)) + 1 if h else 0

    held = collections.defaultdict(list)
    for (d, *_), s in zip(rows, streams):
        if fold(d, 7) == 3:
            for i in range(order - 1, len(s)):
                p, b = estimates(s, i, True)
                held[b].append(p)

    def scores(binned):
        weights = {}
        for b, ps in held.items():
            ps, w = np.array(ps), np.full(order + 1, 1 / (order + 1))
            if binned:
                logs = np.round(-np.log2(np.where(ps > 0, ps, 1)) * lm.STEPS) / lm.STEPS
                ps[:, 1:] = np.where(ps > 0, 2.0**-logs, 0)[:, 1:]
            for _ in range(40):
                share = ps * w
                w = np.maximum((share / share.sum(axis=1)[:, None]).mean(axis=0), 1e-6)
                w /= w.sum()
            weights[b] = w
        out = []
        for (d, *_), s in zip(rows, streams):
            got = [estimates(s, i, False) for i in range(order - 1, len(s))]
            out.append((str(d), len(got), sum(math.log10(weights.get(b, even) @ p) for p, b in got)))
        return sorted(out)

    even = np.full(order + 1, 1 / (order + 1))
    got, same, free = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(docs, order=order).collect()), scores(True), scores(False)
    assert [x[:2] for x in got] == [x[:2] for x in same] == [x[:2] for x in free]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in same], rel=1e-6)
    assert [x[2] for x in got] == pytest.approx([x[2] for x in free], rel=0.02) and sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in free), rel=0.005)


def test_packing_against_the_tokenizer(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for d, text, *_ in rows:
        want[str(d), np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    whole = collections.defaultdict(set)
    for d, ids in want:
        whole[d, len(ids) // 4].add(ids)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs, queries.tokenizer_path()).collect():
        pieces[str(r.doc_id), r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(whole)
    for key, got in pieces.items():
        copies = sum(want[key[0], ids] for ids in whole[key])
        assert sum(n for _, n, _ in got) == copies * key[1]
        covered = np.zeros(key[1], int)
        for start, n, crc in got:
            covered[start : start + n] += 1
            assert n > 0 and crc in {zlib.crc32(ids[4 * start : 4 * (start + n)]) for ids in whole[key]}
        assert (covered == copies).all()
    for s in sequences.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and total <= 2048 and total & (total - 1) == 0


def test_collisions_find_planted_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * base[:1500]).sum(axis=1)[:, None] * base[:1500]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = np.linspace(0.88, 0.99, 1500)[:, None]
    x = np.concatenate([base, c * base[:1500] + np.sqrt(1 - c * c) * noise])
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    d = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in collisions.near_duplicates(d).collect()}
    assert all(got[i].n_links <= k for i, k in enumerate(links)) and sum(r.n_links for r in got.values()) >= 0.97 * links.sum() > 2000
    assert all((r.component_id == r.vec_id) == r.kept for r in got.values())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Which documents stay after languages and near copies, and that every copy's tokens are packed once; one e-mail address is masked."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [r for r in texts(90, 2) if len(r[1].split()) >= 12]
    near = [(500 + i, r[1] + " tail", r[2], r[3], 0) for i, r in enumerate(rows[:20]) if len(r[1].split()) > 30]
    rows += near + [(700, None, "en", "s0", 0), (701, "12 34", "en", "s0", 0), (702, "write to jo.doe@mail.example.org about the thing and other things", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows if r[0] not in (700, 701)}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in text.items())}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    kept = {d for d, r in root.items() if d == r}
    assert len(near) > 5 and not kept & {r[0] for r in near}
    masked = {d: text[d].replace("jo.doe@mail.example.org", "[EMAIL]") for d in kept}
    t = Tokenizer.from_file(queries.tokenizer_path())
    size = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in masked.items()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.doc_tokens == size[r.doc_id]
        got[r.doc_id] += r.length
    copies = {d: n // size[d] for d, n in got.items()}
    assert set(got) <= kept and all(n % size[d] == 0 and 1 <= copies[d] <= 2 for d, n in got.items())
    words = {d: len(x.split()) for d, x in masked.items()}
    share = sum(words[d] * n for d, n in copies.items()) / sum(words.values())
    assert 0.7 < share <= 0.9


CLASH = "payload_bytes payload_digest record_type refers_to n_email spans value kind held_out n_tokens score lang_pred n_links component_id kept copies epochs tokens rest place start length offset sequence_id n_shingles block cell n_words labels n_features salt label id a b n"


def test_extra_columns_named_like_results(spark):
    extra = {c: F.lit("mine") for c in CLASH.split()}
    rows = texts(20, 3) + [(None, "a row without an id", "en", None, None), (900, None, None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    e = d.withColumns(extra)
    same = lambda f, cols: sorted(map(str, f(e).select(*cols).collect())) == sorted(map(str, f(d).select(*cols).collect()))
    assert same(lambda x: pii.report(pii.find_pii(x)), ["doc_id", "n_email", "spans"])
    assert same(lambda x: lm.score(x), ["doc_id", "score"])
    assert same(lambda x: langid.predict(x, langid.learn(x)), ["doc_id", "lang_pred", "score"])
    assert same(lambda x: mixing.mix(x, {"lang": F.col("lang")}, share=0.5, whole_rows=False), ["doc_id", "copies"])
    assert same(lambda x: packing.pack_documents(x.coalesce(1), queries.tokenizer_path()), ["doc_id", "start", "length", "ids_crc32"])
    assert same(lambda x: jaccard.jaccard_components(x), ["doc_id", "n_shingles", "component_id"])
    assert same(lambda x: licenses.scan(x), ["doc_id", "n_words", "labels"])


def test_pages_vectors_and_images_with_null_ids_and_clashing_columns(spark):
    extra = {c: F.lit("mine") for c in CLASH.split()}
    pages = spark.createDataFrame([(1, "u", "x"), (None, "v", "x"), (None, None, None), (2, "w", "x")], "page_id long, url string, html string").withColumns(extra)
    path = shared_dir(spark, "t")
    warc.write(pages, path)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=str)
    assert len(got) == 4 and (1, "response", None) in got and (2, "revisit", 1) in got
    v = [[1.0, 0.0, 0.5, 0.1]] * 3 + [[0.0, 1.0, 0.0, 0.2]]
    vectors = spark.createDataFrame([(1, v[0]), (2, v[1]), (None, v[2]), (3, v[3]), (3, v[3])], "vec_id long, embedding array<double>").withColumns(extra)
    got = collisions.near_duplicates(vectors).collect()
    assert len(got) == 5 and {(r.vec_id, r.component_id) for r in got if r.vec_id in (1, 2)} == {(1, 1), (2, 1)}
    got = media.copies(media.rendered(vectors)).collect()
    assert len(got) == 5 and {(r.media_id, r.component_id) for r in got if r.media_id == 1} == {(1, 1)}


def test_empty_tables_of_pages_images_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    path = shared_dir(spark, "t")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
    assert media.copies(media.rendered(spark.createDataFrame([], "vec_id long, embedding array<double>"))).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
