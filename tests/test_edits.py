"""Edit distances and windows without loss, against the plain recurrence."""

import random

import pytest
from pyspark.sql import functions as F

from docflow.functions import edits
from docflow.operators import evaluate


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j + 1] + 1, row[j] + 1)
    return row[-1]


def near(text, line, most):
    n = len(line)
    return levenshtein(text, line) <= most if len(text) < n else any(levenshtein(text[i : i + n], line) <= most for i in range(len(text) - n + 1))


def edited(rng, line, letters, times):
    out = list(line)
    for _ in range(times):
        k, op = rng.randrange(len(out) + 1), rng.random()
        if op < 0.4 and k < len(out):
            out[k] = rng.choice(letters)
        elif op < 0.7 and k < len(out):
            del out[k]
        else:
            out.insert(k, rng.choice(letters))
    return "".join(out)


def cases(n, seed=4):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé😀"])
        line = "".join(rng.choices(letters, k=rng.randint(4, 40)))
        most = int(0.2 * len(line) + 1e-9)
        yield "".join(rng.choices(letters, k=rng.randint(0, 60))) + edited(rng, line, letters, rng.randint(0, most + 2)) + "".join(rng.choices(letters, k=rng.randint(0, 60))), line, most


def test_distances():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 90))) for _ in range(2))
        assert edits.distance(a, b) == levenshtein(a, b)
    assert edits.distance("x" * 5000 + "a", "x" * 5000 + "bc") == 2


@pytest.mark.parametrize("busy", [1 << 22, 3])
def test_windows_without_loss(busy):
    hits = 0
    for text, line, most in cases(600):
        want = near(text, line, most)
        assert edits.Text(text, busy).near(line, most) == edits.has_window(text, line, most) == want
        hits += want
    assert 100 < hits < 590


def test_line_recall_equals_its_definition(spark):
    got = list(cases(150, 9))
    hyp = [(i // 3, got[i][0] + " " + got[i + 1][0] + "\n" + got[i + 2][0]) for i in range(0, 150, 3)] + [(900, "nothing is asked of it"), (901, None)]
    truth = [(i // 3, i * 1000, line) for i, (_, line, _) in enumerate(got)] + [(901, 1, "a null text"), (902, 1, "no text at all"), (1, 0, "abc"), (2, 5, None), (3, 7, "  ")]
    h = spark.createDataFrame(hyp, "doc_id long, text string").withColumn("lines", F.lit("clash"))
    t = spark.createDataFrame(truth, "doc_id long, line_id long, text string").withColumn("h", F.lit("clash"))
    want = {}
    one = lambda x: " ".join((x or "").split())
    for doc, _, line in truth:
        if len(one(line)) > 3:
            hits, lines = want.get(doc, (0, 0))
            want[doc] = hits + near(one(dict(hyp).get(doc)), one(line), int(0.2 * len(one(line)) + 1e-9)), lines + 1
    for block in (2048, 700):
        assert {r.doc_id: (r.hits, r.lines) for r in evaluate.line_recall(h, t, block=block).collect()} == want
    assert evaluate.line_recall(h, t.limit(0)).count() == 0


def test_accuracy_of_long_and_short_lines(spark):
    """Both ways to measure, letters that fold, equal and empty lines."""
    rows = [(1, "كتاب", "كتأب"), (2, "", ""), (3, "same", "same"), (4, "kitten", "sitting"), (5, "a" * 300 + "x" + "b" * 300, "a" * 300 + "yy" + "b" * 300), (6, "", "abc")]
    h = spark.createDataFrame([(i, a) for i, a, _ in rows], "line_id long, text string").withColumn("pack", F.lit("p"))
    t = spark.createDataFrame([(i, b) for i, _, b in rows], "line_id long, text string")
    r = evaluate.score_accuracy(h, t, ["line_id"], ["pack"]).first()
    raw = [0.75, 1, 1, 1 - 3 / 7, 1 - 2 / 602, 0]
    assert r.n == 6 and abs(r.raw - sum(raw) / 6) < 1e-12 and abs(r.folded - (sum(raw) + 0.25) / 6) < 1e-12


def test_lines_are_ruled_out_before_they_are_measured(monkeypatch):
    """Lines of the same words in another order share pieces everywhere; few of them may reach the measuring of windows, and none that is near is lost."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(120)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = said(3000)
    asked = []
    monkeypatch.setattr(edits, "has_window", lambda *a, real=edits.has_window: asked.append(len(a[0])) or real(*a))
    held = edits.Text(text)
    for _ in range(40):
        line = said(50)
        assert not held.near(line, len(line) // 5)
    assert sum(asked) < 5000
    for _ in range(20):
        at = r.randrange(len(text) - 300)
        line = list(text[at : at + 300])
        for _ in range(25):
            k = r.randrange(len(line))
            line[k : k + 1] = r.choice([[], ["#"], [line[k], "#"]])
        assert held.near("".join(line), len(line) // 5)


def test_distances_of_many_pairs_are_measured_together(monkeypatch):
    """Over borders of words, with long detours, odd characters and bounds that are too narrow at first; pairs of usual length are not measured one by one."""
    r = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    pairs = []
    for letters in ("ab", "abcdefgh ", "ا\U0001f600b\ud800e"):
        for n in (0, 1, 2, 63, 64, 65, 128, 200, 260):
            a = "".join(r.choices(letters, k=n))
            turned = a.translate(str.maketrans("aeb", "eba"))
            pairs += [(a, turned), (a, a), (a, a[n // 2 :] + a[: n // 2]), (a, "".join(c for c in turned if r.random() > 0.1)), (a, "".join(r.choices(letters, k=r.choice([0, 1, 64, 150])))), (a, a[:3] + a)]
    assert edits.distances(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]
    one_by_one = []
    monkeypatch.setattr(edits, "distance", lambda *a: one_by_one.append(a) or 0)
    lines = ["".join(r.choices("abcdefgh ", k=r.randint(100, 400))) for _ in range(300)]
    got = edits.distances([x.translate(str.maketrans("aeh", "eha")) for x in lines], lines)
    assert len(one_by_one) < 60 and (got > 0).sum() > 240 and len(edits.distances([], [])) == 0


def test_windows_of_many_lines_together(monkeypatch):
    """Several lines a text, of all lengths, with few and many letters; none is lost or made up, and lines of usual length are not measured one by one."""
    r = random.Random(17)
    texts, of, lines = ["", "abc"], [0, 1, 1], ["abcd", "abcd", "wxyz"]
    for letters in ("ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyzé😀 "):
        for _ in range(3):
            texts.append("".join(r.choices(letters, k=r.randint(90, 900))) + "\ud800")
            for n in (4, 5, 9, 17, 63, 64, 65, 129, 300):
                a = r.randrange(max(1, len(texts[-1]) - n))
                line = edited(r, texts[-1][a : a + n], letters, int(r.random() * 0.45 * n))
                of, lines = [*of, len(texts) - 1], [*lines, line + "x" * (4 - len(line))]
    most = [len(x) // 5 for x in lines]
    want = [near(texts[t], line, e) for t, line, e in zip(of, lines, most)]
    assert 20 < sum(want) < len(want) - 20
    for busy in (1 << 22, 200, 3):
        assert edits.has_windows(texts, of, lines, most, busy).tolist() == want
    monkeypatch.setattr(edits, "_LONG", 100)
    assert edits.has_windows(texts, of, lines, most).tolist() == want and len(edits.has_windows([], [], [], [])) == 0
    monkeypatch.undo()
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(60)]
    text = " ".join(r.choices(words, k=1500))
    lines = ["".join(c for c in text[a : a + 250] if r.random() > (0.2 if a % 50 else 0.08)) for a in range(0, 5000, 25)]
    want = [edits.Text(text).near(x, len(x) // 5) for x in lines]
    asked = []
    for name in ("has_window", "distance"):
        monkeypatch.setattr(edits, name, lambda *a, real=getattr(edits, name): asked.append(a) or real(*a))
    assert edits.has_windows([text], [0] * len(lines), lines, [len(x) // 5 for x in lines]).tolist() == want and 0 < sum(want) < len(lines)
    assert len(asked) < 40
