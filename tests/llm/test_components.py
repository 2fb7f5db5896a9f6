import random
import threading

import pytest

from framelake.llm import components
from framelake.llm.components import connected_components
from framelake.llm.scratch import Scratch, released, scratch_root


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up if find(v) != v}


def run(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = connected_components(Scratch(spark, "test"), frame, "c").collect()
    assert len(rows) == len({r.vertex for r in rows})
    return {r.vertex: r.component for r in rows}


@pytest.mark.parametrize("hub", (1000, 3))
def test_against_brute_force(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(hub)
    chain = [(k, k + 1) for k in range(40)]
    star = [(10_000, 500 + k) for k in range(60)] + [(450, 700 + k) for k in range(60)]
    top = [((1 << 63) - 1 - k, (1 << 63) - 2 - k) for k in range(6)] + [(-(1 << 63), (1 << 62) + 5), ((1 << 62) + 5, (1 << 62) + 9), (-5, -9)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    edges = chain + star + top + loose + [(7, 7), (None, 3), (3, None)] + loose[:9]
    rng.shuffle(edges)
    assert run(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert run(spark, []) == {}


def test_tables_of_calls_are_their_own(spark):
    frame = spark.range(3)
    first, second = Scratch(spark, "one"), Scratch(spark, "one")
    a, b = first.table("t", frame), second.table("t", frame)
    with released():
        assert Scratch(spark, "one").table("t", frame).count() == 3
    first.release()
    assert b.count() == 3
    with pytest.raises(Exception):
        a.count()


def test_batch_size_comes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, inside = spark.conf.get(key), []
    scratch, gate = Scratch(spark, "two"), threading.Barrier(3)

    def use():
        with scratch.batches(17):
            gate.wait()
            inside.append(spark.conf.get(key))
            gate.wait()

    threads = [threading.Thread(target=use) for _ in range(2)]
    for t in threads:
        t.start()
    gate.wait()
    gate.wait()
    for t in threads:
        t.join()
    assert inside == ["17", "17"] and spark.conf.get(key) == before


def test_no_local_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        scratch_root(Session)
