"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies: the source's target over its size in words. Whole
copies are taken at once. Of the fractions, pairs transfer mass at random, weighed by the documents' sizes, until one of
the two is 0 or 1: the words expected of every document stay, and the words of the pair stay exactly. Small buckets of
documents are combined so, each leaves one fraction at most, and these are combined in turn by a reduction tree, so that
a source misses its target by less than its last document's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framelake.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 512  # documents that are combined in one group at first
FAN_IN = 256  # fractions that are combined in one group later
_CLOSE = 1e-9


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, size): a row for each source with its source_size, docs and target.

    Targets share ``share`` times all words by weight; weights repeat over the sources in code point order, null last.
    No target exceeds ``most`` times its source: what is above is shared anew by weight among the rest. The level at
    which this settles is found from running sums over the sources in order of where they are cut off."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / after
    settled = weighed.withColumn("level", level).withColumn("own", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    level = F.first("own", ignorenulls=True).over(every)
    return settled.select("source", "source_size", "docs", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _stream(level: int, source: str | None, bucket: int) -> np.random.Generator:
    name = f"{level}/{bucket}/{'-' if source is None else '+' + source}"
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "little")))


def round_pairs(fractions: list[float], sizes: list[int], draws: np.ndarray, last: bool) -> list[float]:
    """Combines fractions in order; all but one at most become 0 or 1, and that one too if ``last``. draws: one more
    than fractions."""
    out, held = list(fractions), -1
    for k, (p, w) in enumerate(zip(fractions, sizes)):
        if w == 0 or p <= _CLOSE or p >= 1 - _CLOSE:
            out[k] = float(p >= 1 - _CLOSE)
            continue
        if held < 0:
            held = k
            continue
        q, v = out[held], sizes[held]
        gain, loss = min(v * (1 - q), w * p), min(v * q, w * (1 - p))  # words that the held one may gain, or lose
        moved = gain if draws[k] * (gain + loss) < loss else -loss
        q, p = q + moved / v, p - moved / w
        out[held], out[k] = (0.0 if x <= _CLOSE else 1.0 if x >= 1 - _CLOSE else x for x in (q, p))
        if out[held] in (0.0, 1.0):
            held = k if 0 < out[k] < 1 else -1
    if last and held >= 0:
        out[held] = float(draws[len(out)] < out[held])
    return out


_FIELDS = "doc_id long, source string, size long, content long, turn long, source_size long, target double, whole int, fraction double, bucket long, buckets long"
_TURNS = 10_000  # repeats of a row that are made at once


def _combine(level: int, last: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("rank", "doc_id", "size", "content", "turn")])
        draws = _stream(level, table.column("source")[0].as_py(), table.column("bucket")[0].as_py()).random(table.num_rows + 1)
        done = round_pairs(table.column("fraction").to_pylist(), table.column("size").to_pylist(), draws, last)
        at = table.schema.get_field_index("fraction")
        return table.set_column(at, "fraction", pa.array(done, pa.float64())).drop_columns(["rank"])

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, owner: str = "op3") -> DataFrame:
    """Decides how often the mix takes each row of ``docs`` (doc_id, text, source; others are ignored).

    Returns doc_id, size (words), source_size, target (of its source), copies and taken (copies * size), a row for each
    row. A null or blank text has size 0 and is never taken; null is a source of its own. Draws depend on the rows alone,
    so reruns agree however they are dealt out. Rows without doc_id, or that share one, are rows of their own; so are
    equal rows, which are counted and told apart by a number. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, owner)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("content"))
    equal = sized.groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("_n"))
    blocks = equal.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _TURNS))))
    turns = F.sequence(F.col("_block") * _TURNS, F.least("_n", (F.col("_block") + 1) * _TURNS) - 1)
    sized = scratch.table("sized", blocks.select("doc_id", "source", "size", "content", F.explode(turns).alias("turn")))
    targets = scratch.table("targets", source_targets(sized, weights, share, most).withColumnRenamed("source", "s"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("s")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < _CLOSE, F.round(ratio)).otherwise(ratio)
    rank = F.xxhash64("doc_id", "source", "content", "turn", F.lit(3))
    buckets = F.ceil(F.col("docs") / BUCKET).cast("long")
    rows = joined.select("doc_id", "source", "size", "content", "turn", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("fraction"), F.pmod(rank, buckets).alias("bucket"), buckets.alias("buckets"))

    largest = targets.agg(F.max(F.ceil(F.col("docs") / BUCKET))).first()[0] or 1
    level, parts = 0, []
    while True:
        last = largest <= 1
        turn = scratch.table(f"level-{level}", rows.withColumn("rank", F.xxhash64("doc_id", "source", "content", "turn", F.lit(5))).groupBy("source", "bucket").applyInArrow(_combine(level, last), _FIELDS))
        open_ = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        parts.append(turn.where(~open_))
        if last:
            break
        rows = turn.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        largest, level = -(-largest // FAN_IN), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    scratch.drop("sized", "targets")
    copies = (F.col("whole") + F.col("fraction")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with whatever columns they have. Rows that share a doc_id, or
    have none, are taken as often as that one of them that is taken least; of size 0, never."""
    often = mix.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("copies")).where("copies > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(often, F.col("key").eqNullSafe(F.col("id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
