"""A large group of near copies meets its leader in few rows; what workers remember is bounded."""

import numpy as np

from docflow.llm import media, meeting, packing, queries, tokens
from docflow.llm.common import stored


def test_ids_of_a_large_group_meet_their_leader_in_two_rows_at_most(spark):
    r = np.random.default_rng(3)
    rows = [(c, 1000, True) for c in range(8)] + [(c, 2000, True) for c in (20, 21)] + [(20, 2001, True), (21, 2001, True), (50, 9, False)]
    for i in range(300):  # each shares six of the hub's eight cells
        rows += [(int(c), i, True) for c in r.permutation(8)[:6]]
    members = spark.createDataFrame(rows, "cell long, id long, lead boolean")
    leading = members.where("lead").select("cell", "id")
    got = meeting.picked(leading).collect()
    assert leading.count() > 1800 and len(got) <= 2 * 303 and {x.id for x in got} == {x.id for x in leading.collect()}
    assert {(x.id, x.met) for x in got} == {(i, 6) for i in range(300)} | {(1000, 8), (2000, 2), (2001, 2)}
    assert {(x.a, x.b) for x in meeting.parents(members).collect()} == {(1000, i) for i in range(300)} | {(2001, 2000)}


def test_images_of_a_large_group_are_linked_with_few_of_each_other(spark, monkeypatch):
    r = np.random.default_rng(5)
    group, rest = r.standard_normal(64), r.standard_normal((20, 64))
    rows = [(i, (group + 0.02 * r.standard_normal(64)).tolist()) for i in range(80)] + [(100 + i, v.tolist()) for i, v in enumerate(rest)]
    compare, made = media.agreed, []

    def agreed(own, pairs, votes):
        got = stored(compare(own, pairs, votes), "links")
        made.append((pairs.count(), got.count()))
        return got

    monkeypatch.setattr(media, "agreed", agreed)
    got = {x.media_id: x.component_id for x in media.copies(media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    assert sum(got[i] == 0 for i in range(80)) >= 78 and all(got[100 + i] == 100 + i for i in range(20))
    assert sum(n for _, n in made) <= 3 * 80, made


def test_entries_of_large_cells_meet_them_once_and_only_where_labels_differ(spark):
    rows = [(1, i, False, False) for i in range(50)] + [(2, i, False, False) for i in range(40, 70)] + [(3, i, True, False) for i in (60, 61)] + [(c, None, False, False) for c in (1, 2)]
    members = spark.createDataFrame(rows, "cell long, id long, flag boolean, lead boolean")
    few, many = meeting.apart(members, spark.createDataFrame([(i, 0) for i in range(50)], "id long, label long"))
    assert sorted((r.cell, r.n, r.id, r.flag, r.label) for r in many.collect()) == [(2, 30, i, False, 0 if i < 50 else i) for i in range(40, 70)]
    assert sorted((r.cell, r.id) for r in few.collect()) == [(3, 60), (3, 61)]
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_ids_follow_one_leader_of_another_label(spark):
    cells = [(c, i, i % 2) for c in range(6) for i in range(40)] + [(9, 100, 100), (9, 1, 1)]
    rows = spark.createDataFrame(cells, "cell long, id long, label long")
    for few, many in ((rows, rows.limit(0)), (rows.limit(0), rows)):
        got = meeting.followed(few, many, 0, 2).collect()
        assert len(got) == len({x.b for x in got}) == 20 and len({x.a for x in got}) == 1
        assert all((x.a - x.b) % 2 for x in got)


def test_remembered_words_are_bounded_by_words_and_bytes():
    encode, hasher = packing.Encoder(queries.tokenizer_path()), tokens.Hasher()
    for k in range(12):  # 1 MB of long words a call, beyond both bounds on bytes together
        texts = [" ".join(f"{k}x{i}" + "y" * 4000 for i in range(j, j + 50)) for j in range(0, 250, 50)]
        first, _ = encode(texts), hasher(texts)
        assert [x.tolist() for x in packing.Encoder(queries.tokenizer_path())(texts[:1])] == [first[0].tolist()]
        assert sum(map(len, encode.known)) < 5_500_000 and sum(map(len, hasher.known)) < 5_000_000
    for k in range(5):
        encode([" ".join(f"w{i}" for i in range(j, j + 10_000)) for j in range(k * 80_000, (k + 1) * 80_000, 10_000)])
        assert len(encode.known) < 340_000


def test_words_that_come_again_are_kept_beyond_the_bound():
    encode = packing.Encoder(queries.tokenizer_path(), bound=3000)
    common = [f"common{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}, x{i}" for i in range(100)]
    for k in range(8):
        texts = [" ".join([*common, *(f"once{k}q{i}" for i in range(1000)), *common])]
        assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in packing.Encoder(queries.tokenizer_path())(texts)]
    learned = []
    encode._learn, learn = lambda fresh: (learned.extend(fresh), learn(fresh)), encode._learn
    encode([" ".join(f"more{i}" for i in range(3000))])
    encode([" ".join(common)])
    assert not set(" ".join(common).encode().split()) & set(learned)


def test_hashes_by_sums_tell_the_same_words_apart(monkeypatch):
    import random

    import numpy as np

    from docflow.llm import tokens

    r = random.Random(8)
    texts = [None, "", "  ", "A b\tc\x0bd\x1ce f", "\ud800 x", "z" * 300 + " y"] + ["".join(r.choices("aAb \n\x0cé", k=r.randint(0, 60))) for _ in range(400)]
    words, many = tokens.Hasher()(texts)
    for together in (1 << 20, 50):
        monkeypatch.setattr(tokens, "_TOGETHER", together)
        got, count = tokens.hashed(texts)
        assert count.tolist() == many.tolist() and len(got) == len(words)
        assert len(np.unique(got)) == len(np.unique(words)) == len(np.unique(np.stack([words, got]), axis=1).T)
    assert [len(x) for x in tokens.hashed([])] == [0, 0]


def test_counts_are_sent_by_whole_blocks(spark, monkeypatch):
    """A row for each block and bucket, however many tasks hold texts of a block."""
    from docflow.llm import lm

    docs = spark.createDataFrame([(i, f"some words {i % 7} of {i % 5} and more {i}") for i in range(600)], "doc_id long, text string").repartition(8)
    sent = []

    class Seen(Exception):
        pass

    def stop(df, name):
        sent.append(df)
        raise Seen

    monkeypatch.setattr(lm, "stored", stop)
    held = type(docs.groupBy("text")).applyInArrow
    monkeypatch.setattr(type(docs.groupBy("text")), "applyInArrow", lambda self, f, schema: sent.append(held(self, f, schema)) or held(self, f, schema))
    try:
        lm.score(docs)
    except Seen:
        pass
    assert sent[0].columns == ["bucket", "block", "one", "one_n", "more", "more_n"]
    rows = sent[0].select("block", "bucket").collect()
    assert len(rows) == len({(x.block, x.bucket) for x in rows}) > 100
