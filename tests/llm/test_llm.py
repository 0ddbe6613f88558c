"""The ten operators and the pipeline against brute force, on small fixtures: nulls, empties, ties, repeats, clashing columns."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import collisions, jaccard, langid, licenses, lm, media, mixing, packing, pii, queries, warc
from docflow.llm.common import components, shared_dir, thinned
from docflow.llm.meeting import tiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, tokens string"
BASE_TEXT = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf near the old river bank every single day"
TEXTS = [BASE_TEXT + f" tail{i}" for i in range(3)] + [BASE_TEXT, BASE_TEXT, "der schnelle braune fuchs und die katze", "der hund und die maus", "", "   ", None, "x", "x y", "1234 !!", BASE_TEXT * 30, "mail a.b@c.org card 4111 1111 1111 1111 ip 10.0.0.256 8.8.8.8 tel +1 (555) 010-9999"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t and "der" in t else "en" if i % 4 else None, f"src{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "no id here", None, None, None, None, None), rows[0]], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (10, 11), (7, 7)] + [(20, 20 + i) for i in range(1, 30)], "a long, b long")
    for e in (edges, thinned(edges)):
        got = {r.id: r.component_id for r in components(e).collect()}
        assert got[5] == 2 and got[11] == 10 and got[49] == 20 and 7 not in got


def test_warc_round_trip(spark):
    body = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n<p>é</p>"
    pages = spark.createDataFrame([(3, "u", body), (1, "v", body), (2, None, None), (4, "w", ""), (5, "x", "solo")], "page_id long, url string, html string")
    path = shared_dir(spark, "t")
    warc.write(pages, path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert all(r.intact for r in got.values()) and len(got) == 5
    assert (got[3].record_type, got[3].refers_to, got[1].payload) == ("revisit", 1, body)
    assert (got[4].record_type, got[4].refers_to, got[2].payload_bytes) == ("revisit", 2, 0)
    path = shared_dir(spark, "t")
    warc.write(pages, path, min_bytes=1)
    assert {r.page_id for r in warc.read(spark, path).collect() if r.record_type == "revisit"} == {3}


def test_pii_spans_and_redaction(spark, docs):
    r = pii.report(pii.find_pii(docs)).where("doc_id = 14").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[14] == "mail [EMAIL] card [CARD] ip 10.0.0.256 [IP] tel [PHONE]" and clean[3] == BASE_TEXT and clean[9] is None


def test_pii_contexts_find_unseen(spark):
    rows = [(i, f"please call me {'+1 555 010 99' + str(10 + i) if i < 8 else '5550109' + str(10 + i)} today") for i in range(10)]
    got = {r.doc_id: r.n_added for r in pii.report(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[8] == got[9] == 1 and sum(got.values()) == 2


def test_pii_contexts_reach_over_two_hops(spark):
    new = [f"77001{i}" for i in range(5)]
    rows = [f"please call me {'+1 555 010 99' + str(10 + i)} today" for i in range(16)] + [f"please call me {v} today" for v in new]
    rows += [f"member account number {v} was closed" for v in [*new, "990017"]] + ["they sold about 123456 of them"]
    got = {r.doc_id: r.n_added for r in pii.report(pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    assert {d for d, n in got.items() if n} == set(range(16, 27)) and max(got.values()) == 1


def test_pii_contexts_find_spaced_spans_after_short_labels(spark):
    lead = ["", "now ", "she wrote ", "in may 2019 "]
    rows = [f"{lead[i % 4]}Phone: +1 555 010 99{10 + i} {'soon' if i % 2 else ''}" for i in range(16)]
    fresh = ["(555) 010-9999", "555 010 9998", "555-0101"]
    rows += [f"{lead[i]}Phone: {v}" for i, v in enumerate(fresh)] + ["Phone: 555-0101, 555-0102", "it has 120 345 678 parts"]
    got = {r.doc_id: [s.value for s in r.added] for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[16 + i] for i in range(3)] == [["555) 010-9999"], ["555 010 9998"], ["555-0101"]] and "555-0101" in got[19]
    assert not any(got[i] for i in [*range(16), 20])
    clean = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert clean[16:19] == ["Phone: [CTX_PHONE]", "now Phone: [CTX_PHONE]", "she wrote Phone: [CTX_PHONE]"] and clean[20] == rows[20]


@pytest.mark.parametrize("order", [2, 3])
def test_lm_base_score(spark, docs, order):
    train = collections.Counter()
    rows = docs.collect()
    fold = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 7
    for r in rows:
        if fold(r.doc_id) != 2:
            train.update([*words(r.text), 0])
    n, v = sum(train.values()), len(train)
    got = lm.score(docs, order=order).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        toks = [*words(texts[r.doc_id]), 0]
        assert r.base_score == pytest.approx(sum(np.log10((train[t] + 1) / (n + v + 1)) for t in toks))
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(toks), n, sum(train[t] > 0 for t in toks)) and r.score < 0


def test_lm_query_counts_trigrams(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rounded = lambda d: sorted((str(r.doc_id), round(r.score, 6)) for r in d.collect())
    assert rounded(queries.op3_deleted_interpolation(spark, str(tmp_path))) == rounded(lm.score(docs, order=3)) != rounded(lm.score(docs, order=2))


def test_language(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert got[5][0] == "de" and got[3][0] == "en" and all(got[i] == ("und", 0.0) for i in (7, 8, 9, 12)) and all(0 <= s <= 1 for _, s in got.values())


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    x = np.concatenate([b + rng.standard_normal((8, 16)) * s for b, s in zip(base, (0.05, 0.2, 0.3, 0.4, 1, 1))])
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(90, rows0) for rows0 in [[float(f) for f in x[0]]]] + [(91, None), (92, [0.0] * 16), (93, [float("nan")] * 16), (94, [])]
    got = {r.vec_id: r for r in collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.concatenate([x, x[:1]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9).sum(axis=1) - 1
    ids = [*range(48), 90]
    assert sum(got[i].n_links for i in ids) >= 0.97 * link.sum() and all(got[i].n_links <= k for i, k in zip(ids, link))
    assert all(got[i].n_links == 0 and got[i].kept for i in (91, 92, 93, 94)) and got[90].component_id == 0


def test_mixing_water_filling(spark):
    rows = [(i, "a b c d", "en" if i < 80 else "de", "s1" if i < 60 else "s2") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(d, {"lang": F.col("lang"), "source": F.col("source")}, share=1.0, max_epochs=2)
    leaf = {(r.mix_lang, r.mix_source): r.t for r in got.groupBy("mix_lang", "mix_source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    # 400 tokens, 200 a language; de holds 80 and takes 160 at most, en the rest, s2 of en at most 160
    assert leaf[("de", "s2")] == 160 and leaf[("en", "s1")] + leaf[("en", "s2")] == 240


def test_packing(spark, docs):
    path = queries.tokenizer_path()
    rows = packing.pack_documents(docs, path).collect()
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        total = 0
        for o, n in sorted(v):
            assert o == total
            total += n
        assert total <= 2048 and total & (total - 1) == 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert sum(r.length for r in rows) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_jaccard_against_brute_force(spark, docs):
    sets = {}
    rows = docs.collect()
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets if d is not None}
    for _ in root:
        for a in root:
            for b in root:
                i = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == root.get(r.doc_id)
    assert {r.doc_id for r in jaccard.deduplicated(docs, 3, 9, 10).collect()} == {d for d, c in root.items() if c == d} | {None}


def test_jaccard_hot_cells(spark):
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        t = list(w)
        for p in rng.integers(0, 300, 4):
            t[p] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda q: sorted((r.doc_id, r.component_id) for r in q.collect())
    assert key(jaccard.jaccard_components(d)) == key(jaccard.jaccard_components(d, tile=16))


def test_pipeline_near_copies_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = []
    for base in range(12):
        w = [f"b{base}w{i}" for i in range(int(rng.integers(4, 160)))]
        texts.append(list(w))
        for _ in range(5):
            t = list(w)
            for at in rng.integers(0, len(t), int(rng.integers(0, 5))):
                t[at] = f"z{rng.integers(1000)}"
            texts.append(t)
    w = [f"once{i}" for i in range(50)]
    texts += [w, w[:25] + ["other"] + w[26:]]  # 41 of 51 five-word shingles, but 45 of 51 three-word ones
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    d = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    got = {r.doc_id for r in stage(spark, d, "").collect()}
    assert got == {i for i, r in enumerate(root) if i == r} and len(texts) - 2 in got and len(texts) - 1 not in got


def test_licences():
    a = licenses._automaton()
    s = licenses.scan_text("Apache License, Version 2.0\nThe MIT license. mit license\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause", a)
    assert s[1:5] == (3, 0, 8, "apache,mit") and "gpl-2.0-only-with-classpath-exception-2.0" in s[5] and s[6] is True
    assert licenses.scan_text(None, a) == (0, 0, None, None, "", "", None, 0.0)
    assert licenses.parse("mit and (apache-2.0 or x)") == ["mit", "apache-2.0", "x", "or", "and"] and licenses.parse("and mit") is None


def test_licences_of_broken_and_wrapped_expressions():
    a = licenses._automaton()
    tag = "SPDX-License-Identifier: "
    scanned = lambda t: licenses.scan_text(t, a)[5:7]
    assert scanned(f" * {tag}MIT OR\n * Apache-2.0\n * more words") == ("apache-2.0,mit", True)
    assert scanned(f"// {tag}(MIT AND\r\n// (GPL-2.0-only OR\r\n// ISC))\r\ncode") == ("gpl-2.0-only,isc,mit", True)
    assert scanned(f"{tag}(MIT OR Apache-2.0") == ("apache-2.0,mit", False)
    assert scanned(f"{tag}MIT OR") == ("mit", False) and scanned(f"{tag}MIT AND AND ISC") == ("mit", False)
    assert scanned(f"{tag}MIT\nApache-2.0") == ("mit", True) and scanned(f"{tag}") == ("", False)


def test_media(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((12, 64))
    rows = [(i, [float(f) for f in x]) for i, x in enumerate(np.concatenate([v, v + rng.standard_normal((12, 64)) * 0.02]))] + [(50, None)]
    images = media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.media_id: r.component_id for r in media.copies(images).collect()}
    assert sum(got[12 + i] == i for i in range(12)) >= 8 and all(got[i] == i for i in range(12)) and got[50] == 50


def test_media_images_that_are_apart_meet_in_full(spark):
    rows = spark.createDataFrame([(7, i, i % 30, 60) for i in range(60)] + [(8, i, i, 2) for i in (3, 4)], "cell long, id long, label long, n long")
    every = {(a, b) for b in range(60) for a in range(b) if b - a != 30}
    for got in (media.met_pairs(rows, False), media.met_pairs(tiles(rows, 16), True)):
        n = {(r.a, r.b): r.s for r in got.groupBy("a", "b").agg(F.sum("n").alias("s")).collect()}
        assert set(n) == every and n[(3, 4)] == 2 and n[(3, 5)] == 1


def test_media_tables_find_pairs_with_corners_in_common():
    rng = np.random.default_rng(7)
    sample = rng.integers(0, 2, (3000, 40)).repeat(4, axis=1)[:, :128]  # bits that hang together
    for n in (1000, 1_000_000):
        on = media.tables(n, sample)
        met = np.zeros(400, int)
        for _ in range(media.COMMON):
            flipped = np.stack([np.isin(np.arange(128), rng.permutation(128)[: media.FLIPS]) for _ in range(400)])
            met += (~flipped[:, on]).all(axis=2).sum(axis=1)
        assert (met >= media.MEETINGS).mean() >= 0.9
        assert len(media.tables(n)[0]) < len(on[0])


def test_media_crops(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(10):
        whole = media._box(np.kron(rng.integers(20, 236, (60, 60)), np.ones((7, 7)))[None], 2)[0]
        top, left = rng.integers(0, 300, 2)
        rows += [(j, *v.shape, bytearray(v.astype(np.uint8).tobytes())) for j, v in ((i, whole), (100 + i, whole[top : top + 120, left : left + 120] * 0.9 + 9))]
    got = {r.media_id: r.component_id for r in media.copies(spark.createDataFrame(rows, "media_id long, height int, width int, pixels binary")).collect()}
    assert sum(got[100 + i] == i for i in range(10)) >= 9 and all(got[i] == i for i in range(10))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(empty).count() == 0 and lm.score(empty).count() == 0 and jaccard.jaccard_components(empty).count() == 0
    assert langid.predict(empty, langid.learn(empty)).count() == 0 and packing.pack_documents(empty, queries.tokenizer_path()).count() == 0
    assert mixing.mix(empty, {"lang": F.col("lang")}, share=0.5).count() == 0 and licenses.scan(empty).count() == 0
    assert collisions.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns
        d = out
    assert all(c is not None for c in (r.text for r in d.collect()))


def test_jaccard_group_whose_members_link_only_through_the_original(spark):
    """Every copy links with the original alone, and cells of unlinked copies are split into tiles."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(w))]
    for i in range(60):
        t = list(w)
        for p in range(3):
            t[(i * 3 + p * 67) % 200] = f"z{i}x{p}"
        rows.append((i, " ".join(t)))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(198)} for _, t in rows]
    linked = [[10 * len(a & b) >= 9 * len(a | b) for b in sets] for a in sets]
    assert all(linked[0]) and sum(linked[a][b] for a in range(1, 61) for b in range(1, a)) < 300
    for tile in (1024, 8):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
        assert set(got.values()) == {0} and len(got) == 61


def test_warc_headers_and_archives_with_revisits(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "v", "same"), (1, "v", "same"), (2, "w", None), (None, "n", "same"), (None, "m", ""), (7, "x", "own"), (8, "y", "same")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, record string, key string")
    path, again = shared_dir(spark, "t"), shared_dir(spark, "t")
    warc.write(pages, path)
    first = warc.read(spark, path).collect()
    assert len({r.record for r in first}) == len(rows) and all(r.intact and r.date for r in first)
    whole = warc.dereferenced(warc.read(spark, path), least=1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.page_id, r.url, r.payload) for r in whole), key=key) == sorted(((i, u, h or "") for i, u, h in rows), key=key)
    warc.rewrite(spark, path, again)
    second = warc.read(spark, again).collect()
    facts = lambda got: sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, r.date) for r in got), key=str)
    assert facts(first) == facts(second)
    raw = "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert list(warc.parse(raw.encode())) == []
    for r in (pages.limit(0),):
        warc.write(r, shared_dir(spark, "t"))


def brute_spans(text):
    """The contract's base spans, by backtracking regular expressions."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(digits[::-1])) % 10 == 0
            fine = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HOSTILE = [
    "é 4111 1111 1111 1111 +4111 1111 1111 1111 a@b.c a@b..c x@y-.z@w.v 1.2.3.4.5.6.7.8", "+1 (555) 010-9999+1 5550109999 999.1.1.1 0255.0.0.01", "a.b@c.d,e@f.g.h",
    "4111-1111-1111-1111-4111-1111-1111-1111", "\x01 1.1.1.1\x01 😀 +49 30 1234567 ", "@", "+", "1" * 40, "+1" + "2" * 30, "a@b", None, "", " . ",
]


def test_pii_base_spans_against_brute_force(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    texts |= {-1 - i: t for i, t in enumerate(HOSTILE)}
    got = pii.report(pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.BASE]


def test_pii_long_texts_of_numbers(spark):
    """Time that grows with the square of the spans would not end here."""
    text = " ".join(f"10.0.{i % 256}.{i // 256} {i} user{i}@host.example" for i in range(12_000))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    r = pii.report(pii.find_pii(df)).where("doc_id = 1").first()
    assert (r.n_email, r.n_ip) == (12_000, 12_000)
    clean = pii.redact(df).where("doc_id = 1").first().text
    assert clean.startswith("[IP] 0 [EMAIL] [IP] 1 [EMAIL]") and clean.count("[IP]") == clean.count("[EMAIL]") == 12_000


def test_license_words_and_places_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    extra = ["MIT License mit license\x00MIT-LICENSE, cc by cc by", "gnu general public license version 2, or the Apache License, mit", "émit license", None, "", "Cc BY NC 4.0", "mit license " * 5000]
    texts |= {-1 - i: t for i, t in enumerate(extra)}
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
        want = (len(found), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({b for _, b in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert {b for _, b in places} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_operands_have_the_form_of_identifiers():
    a = licenses._automaton()
    labels = lambda t: licenses.scan_text(t, a)[5:7]
    assert labels("SPDX-License-Identifier: see below") == ("", False)
    assert labels("SPDX-License-Identifier: ISC or later terms") == ("isc", False)
    assert labels("SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)") == ("gpl-2.0-only,gpl-2.0-only-with-classpath-exception-2.0,mit", True)
