import math

import numpy as np
import pyarrow as pa

from framelake.llm import multi_index
from framelake.llm.multi_index import multi_sequence, near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i if i is not None else 1 << 64, low.get(find(k), 1 << 64))
    return {i: (n[k], low[find(k)], low[find(k)] == i) for k, (i, _) in enumerate(rows) if i is not None}


def run(spark, rows, schema=SCHEMA):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for group in range(150):
        base = rng.standard_normal(16)
        for _ in range(200 if group == 3 else int(rng.integers(1, 7))):
            v = base + 0.08 * rng.standard_normal(16) * rng.integers(0, 2)
            rows.append((k, (v * rng.uniform(0.5, 2) if k % 3 else v).astype(np.float32).tolist()))
            k += 1
    rng.shuffle(rows)
    want, got = brute(rows), run(spark, [(int(i), v) for i, v in rows])
    assert set(want) == set(got)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(r[0] for r in got.values()) >= 0.97 * sum(r[0] for r in want.values())
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.97 * len(want)


def test_odd_rows(spark):
    rows = [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [3.0, 0.0]), (1, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (10, [0.0, -1.0]), (11, [float("inf"), 0.0])]
    got = run(spark, [(*r, 1, 2) for r in rows], SCHEMA + ", copies int, cell int")
    assert got == {5: (2, 2, False), 2: (2, 2, True), 9: (2, 2, False)} | {i: (0, i, True) for i in (1, 3, 4, 6, 7, 8, 10, 11)}
    assert run(spark, []) == {}
    assert run(spark, [(1, [0.0]), (2, None)]) == {1: (0, 1, True), 2: (0, 2, True)}


def test_each_width_on_its_own(spark):
    rng = np.random.default_rng(3)
    rows = []
    for width, groups in ((8, 400), (5, 30), (3, 20)):
        for _ in range(groups):
            base = rng.standard_normal(width)
            rows += [(base + 0.05 * rng.standard_normal(width)).astype(np.float32).tolist() for _ in range(int(rng.integers(1, 7)))]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    got = run(spark, rows)
    for width in (8, 5, 3):
        own = [r for r in rows if len(r[1]) == width]
        want = brute(own)
        assert sum(got[i][0] for i in want) >= 0.97 * sum(r[0] for r in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        if width < 8:  # few enough for one cell
            assert all(got[i] == want[i] for i in want)


def test_recall_of_links_on_planted_neighbours(spark):
    """On the given vectors with a planted neighbour at cosine 0.95 to 1 for each, with the parameters of the query."""
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    planted = []
    for i, v in rows:
        v = v / np.linalg.norm(v)
        noise = rng.standard_normal(len(v))
        noise -= (noise @ v) * v
        c = rng.uniform(0.951, 1.0)
        planted += [(i, v.astype(np.float32).tolist()), (100_000 + i, (c * v + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).astype(np.float32).tolist())]
    want, got = brute_matrix(planted), run(spark, planted)
    assert sum(want.values()) >= len(planted)
    assert all(got[i][0] <= want[i] for i in want)
    assert sum(r[0] for r in got.values()) >= 0.95 * sum(want.values())


def brute_matrix(rows, cosine=0.95):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return dict(zip([i for i, _ in rows], ((x @ x.T >= cosine).sum(axis=1) - 1).tolist()))


def test_the_grid_grows_with_the_table():
    cells = [multi_index.grid_words(n) ** 2 for n in (10_000, 50_000, 250_000, 1_000_000)]
    assert all(b >= 4 * a for a, b in zip(cells, cells[1:]))


def test_ids_near_the_ends(spark):
    rows = [((1 << 63) - 1, [1.0, 0.0]), ((1 << 63) - 2, [1.0, 0.01]), (-(1 << 63), [0.0, 1.0]), (-5, [0.01, 1.0]), ((1 << 62) + 1, [1.0, 0.02])]
    assert run(spark, rows) == brute(rows)


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(9)
    found = multi_sequence(a, b, 63)
    assert len(set(found)) == 63
    sums = [a[i] + b[j] for i, j in found]
    assert sums == sorted(sums)


def test_both_sides_of_a_vertex_keep_their_least():
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(3, True, turn(15)), (2, True, turn(30)), (3, False, turn(15)), (1, False, turn(0))]
    table = pa.table({
        "width": [2] * 4, "id": [r[0] for r in rows], "query": [r[1] for r in rows], "v": [r[2] for r in rows], "copies": [1] * 4, "own": [0] * 4,
        "visited": pa.array([None, None, [0], [0]], pa.list_(pa.int64())),
    })
    out = multi_index._compare(0.95)(table).to_pylist()
    assert {(r["id"], r["low"]) for r in out if r["id"] != r["low"]} == {(3, 1), (3, 2)}
    links = {}
    for r in out:
        links[r["id"]] = links.get(r["id"], 0) + r["links"]
    assert links == {1: 0, 2: 1, 3: 1}


def test_chains_in_dealt_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        rows += [(a * math.cos(0.2 * k) + b * math.sin(0.2 * k)).astype(np.float32).tolist() for k in range(25)]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    whole = run(spark, rows)
    monkeypatch.setattr(multi_index, "MEMBERS", 3)
    monkeypatch.setattr(multi_index, "QUERIES", 2)
    assert run(spark, rows) == whole
