"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import ROWS, Scratch

HUB = 1000  # a vertex with more than this share (one in HUB) of all edge ends, and more than HUB, is a hub


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of one batch by stars onto the least vertex."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(v, find(v)) for v in list(parent)]
        rows = [(v, r) for v, r in rows if v != r]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])


def _with_least(scratch: Scratch, edges: DataFrame, label: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (a, b) with m, the least b of each a; and the table of (a, m). Hubs, of which there are 2 * HUB at most
    whatever the number of edges, are joined by broadcast, so that no task gets all edges of one."""
    stars = scratch.table(label, edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), rows=rows)
    many = max(HUB, (stars.agg(F.sum("n")).first()[0] or 0) // HUB)
    hubs = stars.where(F.col("n") > many).select("a", "m")
    held = edges.join(F.broadcast(hubs), "a", "left")
    rest = held.where("m is null").drop("m").join(stars.where(F.col("n") <= many).select("a", "m"), "a")
    return held.where("m is not null").unionByName(rest), stars.select("a", "m")


def connected_components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """``edges`` has long columns a and b. Returns (vertex, component): the least vertex reachable, for every vertex
    that isn't the least of its component. Any longs are vertices. Loops and repeated edges are allowed, edges with a
    null end are dropped; no edges, no rows.

    Ends as soon as the edges are stars: no vertex has two edges down, or both an edge down and one from above."""
    edges = edges.select("a", "b").where("a != b").mapInArrow(_forest, "a long, b long")
    now, step = scratch.table(f"{label}-0", edges), 0
    rows = now.count()
    if rows < ROWS:  # else tiny files would be read again and again
        now = scratch.table(f"{label}-edges", now, rows=rows)
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("above")))
        open_ = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("above").alias("above")).where("down > 1 or down = 1 and above = 1")
        if open_.isEmpty():
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = _with_least(scratch, both, f"{label}-{step}-large", 2 * rows)
        large = scratch.table(f"{label}-{step}-pairs", large.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), rows=2 * rows)
        joined, least = _with_least(scratch, large, f"{label}-{step}-small", 2 * rows)
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now, step = scratch.table(f"{label}-{step + 1}", small, rows=2 * rows), step + 1
        scratch.drop(*[f"{label}-{step - 1}{x}" for x in ("", "-large", "-pairs", "-small")])
