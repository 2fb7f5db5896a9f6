import random
import re

from framelake.llm import jaccard_join
from framelake.llm.jaccard_join import jaccard_components


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            same = sets[x][0] is not None and sets[x][0] == sets[y][0]
            if same or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                up[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [None, "", " \t", "one", "One", "one two three four", "one two three four five", "one two three four five six", "x y", "y x"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy + passage
            if rng.random() < 0.3:
                copy.append("end")
            texts.append(" ".join(copy).replace("w1", "W1") if rng.random() < 0.5 else "\n".join(copy))
    hot = [rng.choice(words) for _ in range(50)]
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


def run(spark, rows, schema="doc_id long, text string"):
    out = jaccard_components(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s"), (None, "a b c d e f"), (None, "z"), (None, None), (7, None), (7, "Q r s")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_ids_of_any_size_and_none(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    ids = [(1 << 62) + 3, (1 << 62) + 1, (1 << 63) - 1, -(1 << 63), -4, None, None, None]
    rows = [(i, f"{near} {k}") for k, i in enumerate(ids)]
    rows += [((1 << 63) - 2 - k, f"other {near.upper()[:-4]} {k}") for k in range(3)]
    rows += [(None, f"{near[::-1]} {k}") for k in range(4)]
    assert run(spark, rows) == brute(rows)
    positive = [(i, t) for i, t in rows if i is None or i > 0]
    assert run(spark, positive) == brute(positive)


def test_texts_that_share_ids_and_repeat(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l"), (9, "m n o p q r"), (3, "m n o p q r")]
    rows += [(20, "s t u v w x")] * 30 + [(21, "s t u v w x y")] * 30 + [(22, None), (22, "s t u v w")]
    assert run(spark, rows) == brute(rows)


def test_hot_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_very_long_text(spark):
    long = " ".join(f"w{k % 70001}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, " " * 1_000_000)]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 1, 3, 4] and got[2][1] == 1 and got[3][1] == 0


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 3, "k"), (2, "a b c d e f", None, None)]
    out = run(spark, rows, "doc_id int, text string, n long, key string")
    assert out == [(1, 2, 1), (2, 2, 1)]
