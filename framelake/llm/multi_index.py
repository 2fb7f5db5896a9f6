"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has a codebook of its own, and the pairs of code words
form a grid of cells, as many as keep the rows of a cell few however large the table is. A vector is indexed in its own
cell. As a query it visits cells by the multi-sequence traversal, in order of the sum of the two halves' distances, up to
the number of visits that finds the wanted share of vectors that are as far off as a link allows; every vector in the
visited cells is then compared exactly. Vectors of each width have an index of their own; where they are few, it is one
cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.scratch import Scratch
from framelake.llm.vectors import lists, matrix, usable

CELL = 64  # vectors of a cell, on average, that the grid is sized for
WORDS = 1024  # code words of each half, at most
SAMPLE = 10_000  # vectors of a width that its codebooks are fitted on
PROBES = 512  # of them, those that the number of visits is fitted on
FEW = 1000  # vectors of a width that are compared without an index
RECALL = 0.98
MEMBERS = 2048  # vectors of a cell that one task compares with QUERIES queries
QUERIES = 1024


def _codebook(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)
        for k in range(len(book)):
            if (near == k).any():
                book[k] = x[near == k].mean(axis=0)
    return book


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1, keepdims=True) + (book * book).sum(1) - 2 * x @ book.T)


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The ``visits`` pairs (i, j) with the smallest a[i] + b[j], nearest first."""
    rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    queue, out = [(float(a[rows[0]] + b[columns[0]]), 0, 0)], []
    while queue and len(out) < visits:
        _, i, j = heapq.heappop(queue)
        out.append((int(rows[i]), int(columns[j])))
        if j + 1 < len(columns):
            heapq.heappush(queue, (float(a[rows[i]] + b[columns[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(queue, (float(a[rows[i + 1]] + b[columns[0]]), i + 1, 0))
    return out


def grid_words(vectors: int) -> int:
    """Code words of each half for a table of so many vectors: their square, the number of cells, grows with the table."""
    return int(np.clip(round((vectors / CELL) ** 0.5), 1, WORDS))


class MultiIndex:
    """Codebooks of the halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, cosine: float, recall: float, words: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [_codebook(part, words, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        probes = sample[:PROBES]
        noise = rng.standard_normal(probes.shape)
        noise -= (noise * probes).sum(1, keepdims=True) * probes
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        moved = cosine * probes + np.sqrt(1 - cosine * cosine) * noise
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        # A link is found if either end visits the other's cell.
        ranks = np.minimum(self._ranks(probes, self.cells(moved)), self._ranks(moved, self.cells(probes)))
        self.visits = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])

    def _ranks(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """After how many visits each query comes to its cell."""
        out = []
        for a, b, cell in zip(*self.distances(queries), cells):
            a, b, own = np.sort(a), np.sort(b), a[cell // len(b)] + b[cell % len(b)]
            # Counted along the sorted halves, as the grid may have a million cells; ties count as visited before.
            out.append(int(np.searchsorted(b, own - a + 1e-12, side="right").sum()))
        return np.array(out)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return np.argmin(a, axis=1) * len(self.books[1]) + np.argmin(b, axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        width = len(self.books[1])
        return np.array([[i * width + j for i, j in multi_sequence(a, b, self.visits)] for a, b in zip(*self.distances(x))], dtype=np.int64)


def _indexed(indexes: dict[int, MultiIndex]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                index = indexes.get(int(width))
                if index:
                    x = matrix(part.column(2), int(width))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    cells, visited = index.cells(x), index.visited(x)
                else:
                    cells, visited = np.zeros(len(part), np.int64), np.zeros((len(part), 1), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(part), width), pa.int32()), pa.array(cells), lists(visited, pa.int64()), part.column(2)], ["id", "copies", "width", "cell", "visited", "v"])

    return run


def _spread(hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """From a matrix of links: (vertex, least vertex that it reaches within the matrix)."""
    r, c = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    links, low_r, low_c = hits[np.ix_(r, c)], rows[r].copy(), columns[c].copy()
    most = np.iinfo(np.int64).max
    while True:
        fresh_r = np.minimum(low_r, np.where(links, low_c[None, :], most).min(axis=1))
        fresh_c = np.minimum(low_c, np.where(links, fresh_r[:, None], most).min(axis=0))
        if (fresh_r == low_r).all() and (fresh_c == low_c).all():
            return [(int(v), int(m)) for v, m in [*zip(rows[r], fresh_r), *zip(columns[c], fresh_c)]]
        low_r, low_c = fresh_r, fresh_c


def _compare(cosine: float) -> Callable:
    """Links between the queries and members of a part of a cell. Counts them for the queries, and for those members
    that don't visit the query's cell and so won't find the link themselves."""

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        x, ids, copies, cells = matrix(table.column("v"), table.column("width")[0].as_py()), table.column("id").to_numpy(), table.column("copies").to_numpy(), table.column("own").to_numpy()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        out: list[tuple[int, int, int]] = []
        if len(q) and len(m):
            cosines = x[q] @ x[m].T
            for i, j in zip(*np.nonzero(np.abs(cosines - cosine) < 1e-12)):
                cosines[i, j] = (x[q[i]] * x[m[j]]).sum()
            hits = (cosines >= cosine) & (ids[q][:, None] != ids[m][None, :])
            if hits.any():
                forward = (hits * copies[m][None, :]).sum(axis=1)
                visited = table.column("visited").take(pa.array(m)).to_pylist()
                places, where = np.unique(cells[q], return_inverse=True)
                blind = np.array([~np.isin(places, v) for v in visited])
                backward = (hits.T * blind[:, where] * copies[q][None, :]).sum(axis=1)
                links = dict.fromkeys(ids[q].tolist(), 0)
                for i, n in [*zip(ids[q].tolist(), forward.tolist()), *zip(ids[m].tolist(), backward.tolist())]:
                    links[i] = links.get(i, 0) + n
                # A vertex that is both a query and a member may reach two least vertices: both pairs go on, links on one.
                out = [(v, links.pop(v, 0), low) for v, low in dict.fromkeys(_spread(hits, ids[q], ids[m]))]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["id", "links", "low"])

    return run


def near_duplicate_vectors(rows: DataFrame, cosine: float = 0.95, recall: float = RECALL, owner: str = "op7") -> DataFrame:
    """Links the rows of ``rows`` (vec_id, embedding; others are ignored) whose cosine, in double precision, is at least
    ``cosine``, and labels components.

    Returns vec_id, n_links (other rows linked directly), component_id (the least vec_id reachable by links, itself
    included) and kept (vec_id = component_id), a row for each row. Equal vectors link always, and stand as one in the
    index; of other links about ``recall`` are found at the lowest cosine, nearly all at higher ones, and none is
    false. Vectors of different widths have no cosine and don't link; each width has an index of its own. Vectors that
    are null or zero or hold null or non-finite components, and rows without vec_id, link with nothing. Rows that share a
    vec_id are rows of their own, each with the links and the component of its vector. The codebooks and visits of a width are fitted on its
    ``SAMPLE`` vectors with the lowest hash of vec_id; every row is indexed.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, owner)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    fit = usable("v") & F.col("id").isNotNull()
    classes = scratch.table("classes", rows.where(fit).groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    kind = dict(classes.dtypes)["v"]
    indexes = {}
    # At most a ``FEW``-th of the rows has a width that gets an index.
    for width, n in classes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).where(F.col("n") > FEW).collect():
        sample = classes.where(F.size("v") == width).orderBy(F.xxhash64("rep", F.lit(4)), "rep").limit(SAMPLE).select("v").toPandas()["v"]
        x = np.stack(sample.to_list()).astype(np.float64)
        indexes[width] = MultiIndex(x / np.linalg.norm(x, axis=1, keepdims=True), cosine, recall, grid_words(n))
    indexed = scratch.table("indexed", classes.select(F.col("rep").alias("id"), "copies", "v").mapInArrow(_indexed(indexes), f"id long, copies long, width int, cell long, visited array<long>, v {kind}"))
    members = indexed.select("id", "copies", "v", "visited", F.col("cell").alias("own"), "width", "cell", F.lit(False).alias("query"))
    queries = indexed.select("id", "copies", "v", F.lit(None).cast("array<long>").alias("visited"), F.col("cell").alias("own"), "width", F.explode("visited").alias("cell"), F.lit(True).alias("query"))
    held = members.groupBy("width", "cell").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("a"))
    asked = queries.groupBy("width", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("b"))
    sizes = scratch.table("sizes", held.join(asked, ["width", "cell"]))
    joined = members.unionByName(queries).join(sizes, ["width", "cell"])
    salt = F.xxhash64("id", F.lit(1))
    part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.array(F.pmod(salt, "a").cast("int")))
    side = F.when(F.col("query"), F.array(F.pmod(salt, "b").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("b") - 1))
    dealt = joined.withColumn("part", F.explode(part)).withColumn("side", F.explode(side)).drop("a", "b")
    done = scratch.table("done", dealt.groupBy("width", "cell", "part", "side").applyInArrow(_compare(cosine), "id long, links long, low long"))
    scratch.drop("indexed", "sizes")
    links = done.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(scratch, done.select(F.col("id").alias("a"), F.col("low").alias("b")), "comps")
    known = classes.join(links, F.col("rep") == F.col("id"), "left").join(comps, F.col("rep") == F.col("vertex"), "left")
    known = known.select("h", F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.withColumn("fit", fit).withColumn("g", F.when(F.col("fit"), F.xxhash64("v"))).join(known, (F.col("g") == F.col("h")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
