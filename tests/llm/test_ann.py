import math

import numpy as np

from framelake.llm import ann
from framelake.llm.ann import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = {}
            for j, v in good:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float((q * v).sum()))
            out[i] = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
    return out


def run(spark, rows, schema=SCHEMA):
    out = {}
    for r in sorted(nearest_neighbours(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + 0.6 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[7][1]) for k in range(40)]
    want, got = brute(rows), run(spark, rows)
    assert set(want) == set(got)
    recall = np.mean([len({a for a, _ in want[i]} & {a for a, _ in got[i]}) / len(want[i]) for i in want])
    assert recall >= 0.9
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for i, found in got.items():
        assert found == sorted(found, key=lambda r: (-r[1], r[0])) and len(found) == 20
        assert all(abs(s - float((vectors[i] * vectors[j]).sum())) < 1e-12 for j, s in found)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.5]), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (40, [float("inf"), 0.0]), (8, [])]
    got = run(spark, [(*r, 1) for r in rows], SCHEMA + ", query int")
    assert got == {0: [(6, 2.0), (1, 1.0), (20, 1.0)], 20: [(6, 2.0), (0, 1.0), (1, 1.0)]}
    assert run(spark, []) == {} and run(spark, [(20, [1.0])]) == {}


def test_no_query_stops_short(spark, monkeypatch):
    monkeypatch.setattr(ann, "_candidates_needed", lambda *_: 20)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((240, 24))
    rows = [(i, (centres[i % 240] + 0.001 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(1200)]
    got = run(spark, rows)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    assert {len(found) for found in got.values()} == {20}


def test_each_width_on_its_own(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal((3, 5, 8)[k % 3]).astype(np.float32).tolist()) for k in range(900)] + [(900 + k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(1100)]
    want, got = brute([r for r in rows if r[0] < 900 and r[0] % 3 == 0]), run(spark, rows)
    assert set(got) == {k for k in range(2000) if k % 20 == 0}
    assert all([b for b, _ in got[i]] == [b for b, _ in want[i]] for i in want)
    width = {i: len(v) for i, v in rows}
    assert all(len(found) == 20 and all(width[j] == width[i] for j, _ in found) for i, found in got.items())
    best = brute([r for r in rows if r[0] >= 900])
    assert np.mean([len({a for a, _ in best[i]} & {a for a, _ in got[i]}) / 20 for i in best]) >= 0.9


def test_recall_on_the_given_table(spark):
    """With the parameters of the query, against brute force over all rows."""
    import __spark_entry__

    found = {}
    for r in __spark_entry__.queries()["op8_approximate_neighbours"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows])
    assert set(found) == set(want)
    assert np.mean([len(found[i] & {j for j, _ in want[i]}) / len(want[i]) for i in want]) >= 0.95
