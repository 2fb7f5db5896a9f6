import random
import re
from collections import defaultdict

import numpy as np

from framelake.llm.mixing import mix_sources, round_pairs, source_targets, take_mix


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", "\U0001f600", "～", None, "hot", "zero"]
    out = []
    for k in range(n):
        s = "hot" if rng.random() < 0.5 else rng.choice(names)
        t = None if rng.random() < 0.02 else "" if s == "zero" or rng.random() < 0.02 else "w x " * int(rng.paretovariate(1.2) * 5)
        out.append((k, t, s))
    return out


def test_targets_and_takes(spark):
    data = rows()
    out = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in data}
    source = {k: s for k, _, s in data}
    sums, took, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, s in source.items():
        sums[s] += size[k]
    want = brute_targets(sums)
    assert sorted(r.doc_id for r in out) == sorted(size)
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        took[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in sums:
        assert abs(took[s] - want[s]) <= most[s] + 1e-6
    again = mix_sources(spark.createDataFrame(data[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_rounding_is_unbiased():
    rng = np.random.default_rng(0)
    sizes, p = [3, 10, 4, 7, 1, 0], [0.3, 0.3, 0.3, 0.3, 0.3, 0.3]
    runs = np.array([round_pairs(p, sizes, rng.random(7), True) for _ in range(20000)])
    assert set(np.unique(runs)) <= {0.0, 1.0}
    assert np.allclose(runs[:, :5].mean(0), 0.3, atol=0.02)


def test_take_mix(spark):
    data = spark.createDataFrame(rows(200), "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "1 as taken", "2 as copies", "3 as _mix_id", "4 as id", "5 as `row`")
    mix = mix_sources(data)
    want = {r.doc_id: r.copies for r in mix.collect() if r.copies and r.size}
    got = defaultdict(int)
    taken = take_mix(data, mix)
    assert taken.columns == data.columns
    for r in taken.collect():
        got[r.doc_id] += 1
    assert dict(got) == want


def test_rows_without_id_and_equal_rows(spark, monkeypatch):
    """They are dealt out over buckets like others, and each source still comes near its target."""
    from framelake.llm import mixing

    monkeypatch.setattr(mixing, "_TURNS", 7)
    data = [(None, f"w{k} " * (1 + k % 9), "a") for k in range(1500)] + [(4, "x y z", "b")] * 1300 + [(5, None, "b")] * 3
    schema = "doc_id long, text string, source string"
    out = mix_sources(spark.createDataFrame(data, schema)).collect()
    assert len(out) == len(data)
    for size, docs in ((3, [r for r in out if r.doc_id == 4]), (9, [r for r in out if r.doc_id is None])):
        assert abs(sum(r.taken for r in docs) - docs[0].target) <= size
    again = mix_sources(spark.createDataFrame(data[::-1], schema).repartition(9)).collect()
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, out), key=key) == sorted(map(tuple, again), key=key)


def test_two_results_live_together(spark):
    schema = "doc_id long, text string, source string"
    a, b = (mix_sources(spark.createDataFrame(rows(50, seed), schema)) for seed in (1, 2))
    assert a.count() == b.count() == 50


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    out = mix_sources(spark.createDataFrame([(1, None, None), (None, "", "a"), (1, None, None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 3
    assert source_targets(spark.createDataFrame([("a", 10)], "source string, size long")).first().target == 15.0
