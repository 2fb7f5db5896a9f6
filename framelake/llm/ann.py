"""Approximate nearest neighbours by a hash-prefix forest.

Every tree is an array of bit strings, the signs of random projections of the vectors, sorted by string; the strings are
longer than any prefix that rows of a table of that size have in common by chance. A query
descends in each tree to the strings that share its longest prefix, and then ascends in all trees at once, a bit a step,
until the trees together hold as many candidates as the search needs. What it needs is fitted: on a bounded sample of
queries, searched exactly, the smallest number of candidates with the recall that is asked for. Vectors of each width
have a forest of their own; where they are few, each query is compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framelake.llm.scratch import Scratch
from framelake.llm.vectors import lists, matrix, usable

TREES = 12
SPARE = 8  # bits of a string beyond the logarithm of the number of rows
FEW = 1000  # vectors of a width that are searched without a forest
SAMPLE = 128  # queries that the number of candidates is fitted on
RECALL = 0.97
MEMBERS = 4096  # rows of a bucket that one task compares with QUERIES queries
QUERIES = 1024


class Forest:
    """Random projections of the trees. Vectors are scaled by the largest norm and lifted by one component to the unit
    sphere, queries are lifted by 0, so that the angle orders rows as the inner product does."""

    def __init__(self, width: int, norm: float, bits: int, trees: int = TREES, seed: int = 8):
        self.width, self.norm, self.trees, self.bits = width, norm, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((width + 1, trees * bits))

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings as integers, a row for each vector and a column for each tree."""
        if query:
            lifted = np.concatenate((x, np.zeros((len(x), 1))), axis=1)
        else:
            y = x / self.norm
            lifted = np.concatenate((y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))), axis=1)
        signs = (lifted @ self.planes > 0).reshape(len(x), self.trees, self.bits)
        return signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def _hashed(forest: Forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), forest.width)
                query = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                strings = np.where(query[:, None], forest.strings(x, True), forest.strings(x, False))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(strings, pa.int64()), batch.column(2)], ["id", "query", "strings", "v"])

    return run


def _score(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed alike whatever stands beside it."""
    return (q * v).sum(axis=-1)


def _best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, int, float]]:
    rough = q @ v.T
    mask = qid[:, None] == vid[None, :]
    rough[mask if allowed is None else mask | ~allowed] = -np.inf
    for i in range(len(q)):
        row = rough[i]
        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        at = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else np.isfinite(row)) & np.isfinite(row))
        exact = _score(q[i], v[at])
        order = np.lexsort((vid[at], -exact))[:k]
        for j in order:
            yield int(qid[i]), int(vid[at[j]]), float(exact[j])


def _exact(ids: np.ndarray, q: np.ndarray, k: int) -> Callable:
    """The best k rows of each partition for a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, float, list]] = []
        for batch in batches:
            if batch.num_rows:
                v, vid = matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy()
                place = {int(x): n for n, x in enumerate(vid)}
                found += [(a, b, s, v[place[b]].tolist()) for a, b, s in _best(q, ids, v, vid, None, k)]
        found.sort(key=lambda r: (r[0], -r[2], r[1]))
        seen: dict[int, int] = {}
        kept = [r for r in found if seen.setdefault(r[0], 0) < k and not seen.update({r[0]: seen[r[0]] + 1})]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in kept], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], ["query", "id", "score", "v"])

    return run


def _counts(bits: int) -> Callable:
    """How many rows of a part of one tree share each query's prefix of every length: ranges of the sorted array. n
    counts all rows, different each vec_id at most once; queries that share an id get their sum, and the least."""

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        strings, ids = table.column("string").to_numpy(), table.column("id").to_numpy()
        members, mine = np.sort(strings[~query]), strings[query]
        single = np.sort(strings[~query][np.unique(ids[~query], return_index=True)[1]])
        depths = np.arange(bits + 1)
        low = (mine[:, None] >> (bits - depths)) << (bits - depths)
        high = low + (np.int64(1) << (bits - depths)).astype(np.int64)
        own, place = np.unique(ids[query], return_inverse=True)
        n, different = np.zeros((len(own), bits + 1), np.int64), np.full((len(own), bits + 1), len(single), np.int64)
        np.add.at(n, place, np.searchsorted(members, high) - np.searchsorted(members, low))
        np.minimum.at(different, place, np.searchsorted(single, high) - np.searchsorted(single, low))
        bucket = [table.column(c)[:1].take(pa.array(np.zeros(len(own), np.int64))) if len(own) else table.column(c)[:0] for c in ("tree", "bucket")]
        return pa.table({"tree": bucket[0], "bucket": bucket[1], "id": pa.array(own), "n": lists(n, pa.int64()), "different": lists(different, pa.int64())})

    return run


def _search(width: int, bits: int, k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        x, ids, strings = matrix(table.column("v"), width), table.column("id").to_numpy(), table.column("string").to_numpy()
        order = np.argsort(strings[~query], kind="stable")
        v, vid, sorted_ = x[~query][order], ids[~query][order], strings[~query][order]
        q, qid, mine, stop = x[query], ids[query], strings[query], table.column("stop").to_numpy(zero_copy_only=False)[query].astype(np.int64)
        shift = bits - stop
        low = (mine >> shift) << shift
        first, last = np.searchsorted(sorted_, low), np.searchsorted(sorted_, low + (np.int64(1) << shift))
        place = np.arange(len(vid))
        rows = list(_best(q, qid, v, vid, (place >= first[:, None]) & (place < last[:, None]), k)) if len(q) and len(v) else []
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _search_all(k: int, every: int) -> Callable:
    """Each query of a width against all of its rows."""

    def run(table: pa.Table) -> pa.Table:
        x, ids = matrix(table.column("v"), table.column("width")[0].as_py()), table.column("id").to_numpy()
        q = ids % every == 0
        best: dict[tuple[int, int], float] = {}
        # Rows may share an id: each finds up to as many more as there are such rows.
        for a, b, score in _best(x[q], ids[q], x, ids, None, k + len(ids) - len(np.unique(ids))):
            best[a, b] = max(score, best.get((a, b), -np.inf))
        rows = [(a, b, score) for (a, b), score in best.items()]
        return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(rows: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL, owner: str = "op8") -> DataFrame:
    """For each row of ``rows`` (vec_id, embedding; others are ignored) whose vec_id is divisible by ``every``, the ``k``
    rows found with the largest inner product, in double precision.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id. A query has fewer rows only if
    there are fewer candidates. A row with the query's own vec_id is no candidate; of rows that share a vec_id one is
    found at most, and queries that share one get the best of what each finds. Vectors of another width than the
    query's have no inner product with it. Vectors that are null or zero or hold null or non-finite components, and rows
    without vec_id, take no part. Every other row is indexed. The sample that the number of candidates of a width is
    fitted on are its ``SAMPLE`` queries with the lowest hash of vec_id.
    """
    scratch = Scratch(rows.sparkSession, owner)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & usable("v")).withColumn("width", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # At most a ``FEW``-th of the rows has a width that gets a forest.
    wide = rows.groupBy("width").agg(F.max(norm).alias("norm"), F.count("*").alias("n")).where(F.col("n") > FEW).collect()
    found = rows.where(~F.col("width").isin(*[r.width for r in wide])) if wide else rows
    found = found.groupBy("width").applyInArrow(_search_all(k, every), "query_id long, vec_id long, score double")
    for r in wide:
        found = found.unionByName(_search_forest(scratch, rows.where(F.col("width") == r.width).drop("width"), r.width, r.norm, r.n, k, every, recall))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_forest(scratch: Scratch, rows: DataFrame, width: int, norm: float, total: int, k: int, every: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score) of what the queries among ``rows`` (id, v) of one width find, more than k each."""
    bits = int(np.clip(int(total).bit_length() + SPARE, 16, 60))
    rows = rows.withColumn("query", F.col("id") % every == 0)
    forest = Forest(width, norm or 1.0, bits)
    both = rows.select("id", F.lit(False).alias("query"), "v").unionByName(rows.where("query").select("id", "query", "v"))
    hashed = scratch.table(f"hashed-{width}", both.mapInArrow(_hashed(forest), f"id long, query boolean, strings array<long>, v {dict(rows.dtypes)['v']}"))

    def parts(pending: DataFrame | None, depth: int, *more: str) -> DataFrame:
        """The trees cut at ``depth``, each bucket dealt into parts of bounded size: rows with (tree, bucket, part, side)."""
        queries = hashed.where("query")
        queries = queries.join(pending, "id") if pending is not None else queries.withColumn("stop", F.lit(None).cast("int"))
        every_ = hashed.where("not query").withColumn("stop", F.lit(None).cast("int")).unionByName(queries)
        flat = every_.select("id", "query", "stop", *more, F.posexplode("strings").alias("tree", "string")).withColumn("bucket", F.shiftright("string", bits - depth))
        sizes = flat.groupBy("tree", "bucket").agg(F.ceil(F.count_if(~F.col("query")) / MEMBERS).cast("int").alias("a"), F.ceil(F.count_if(F.col("query")) / QUERIES).cast("int").alias("b")).where("a > 0 and b > 0")
        joined = flat.join(sizes, ["tree", "bucket"])
        salt = F.xxhash64("id", F.lit(1))
        part = F.when(F.col("query"), F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.array(F.pmod(salt, "a").cast("int")))
        side = F.when(F.col("query"), F.array(F.pmod(salt, "b").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("b") - 1))
        return joined.withColumn("part", F.explode(part)).withColumn("side", F.explode(side)).drop("a", "b")

    def counted(pending: DataFrame | None, depth: int) -> DataFrame:
        """For each query the rows that share its prefix, over all trees, for every length; 0 where no tree alone holds
        ``k`` different rows beside the query's own, as the same rows may count in every tree."""
        cut = parts(pending, depth).select("tree", "bucket", "part", "side", "id", "query", "string")
        n = cut.groupBy("tree", "bucket", "part", "side").applyInArrow(_counts(bits), "tree int, bucket long, id long, n array<long>, different array<long>")
        sums = lambda c: F.array(*[F.sum(F.element_at(c, d + 1)) for d in range(bits + 1)]).alias(c)
        trees = n.groupBy("id", "tree", "bucket").agg(sums("n"), sums("different"))
        most = F.array(*[F.max(F.element_at("different", d + 1)) for d in range(bits + 1)]).alias("different")
        return trees.groupBy("id").agg(sums("n"), most).select("id", F.zip_with("n", "different", lambda a, b: F.when(b > k, a).otherwise(F.lit(0).cast("long"))).alias("n"))

    lowest = hashed.where("query").select("id").distinct().orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE)
    sample = hashed.where("query").join(F.broadcast(lowest), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    need = _candidates_needed(hashed, forest, sample, counted, k, recall)

    depth = int(np.clip(np.floor(np.log2(max(1.0, total * forest.trees / need))) - 1, 0, bits))
    found, pending = None, None
    while True:
        at = F.array(*[F.when(F.col("n")[d] >= need, d) for d in range(depth, bits + 1)])
        counts = counted(pending, depth)
        stops = scratch.table(f"stops-{width}-{depth}", counts.select("id", (F.coalesce(F.array_max(at), F.lit(0)) if not depth else F.array_max(at)).cast("int").alias("stop")))
        ready = stops.where("stop is not null")
        hits = parts(ready, depth, "v").groupBy("tree", "bucket", "part", "side").applyInArrow(_search(width, bits, k), "query_id long, vec_id long, score double")
        found = hits if found is None else found.unionByName(hits)
        if not depth:
            return found
        # Queries whose buckets hold too little ascend further; those that share a bucket with no row are among them.
        known = ready.select(F.col("id").alias("done"))
        pending = scratch.table(f"pending-{width}-{depth}", hashed.where("query").select("id").distinct().join(known, F.col("id") == F.col("done"), "left_anti").withColumn("stop", F.lit(None).cast("int")))
        if pending.isEmpty():
            return found
        depth = max(0, depth - 3)


def _candidates_needed(hashed: DataFrame, forest: Forest, sample: list, counted: Callable, k: int, recall: float) -> int:
    """The smallest number of candidates, among k times powers of 1.5, with which the sample's recall reaches ``recall``;
    if none does, more than there are rows in all trees."""
    if not sample:
        return 1
    ids, q = np.array([r.id for r in sample]), np.array([r.v for r in sample], dtype=np.float64)
    exact = hashed.where("not query").select("id", "v").mapInArrow(_exact(ids, q, k), "query long, id long, score double, v array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = exact.groupBy("query", "id").agg(F.max("score").alias("score"), F.first("v").alias("v")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect()
    if not rows:
        return 1
    spark = hashed.sparkSession
    pending = spark.createDataFrame([(int(i), None) for i in ids], "id long, stop int")
    counts = {r.id: np.array(r.n) for r in counted(pending, 0).collect()}
    place = {int(i): n for n, i in enumerate(ids)}
    mine = forest.strings(q, True)[[place[r.query] for r in rows]]
    theirs = forest.strings(np.array([r.v for r in rows], dtype=np.float64), False)
    shared = np.array([forest.bits - min(int(x).bit_length() for x in row) for row in mine ^ theirs])
    need = k
    while need < 1 << 40:
        stop = np.array([max([d for d in range(forest.bits + 1) if counts[r.query][d] >= need], default=0) for r in rows])
        if (shared >= stop).mean() >= recall or not stop.any():
            return need
        need += need // 2
    return need
