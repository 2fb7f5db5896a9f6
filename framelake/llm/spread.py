"""Joins with hot keys, and column names that no input has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000  # a key with more than this share (one in SHARE) of all rows, and more than SHARE, is dealt out


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores after it until no column in ``taken`` has that name."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def salted(rows: DataFrame, sized: DataFrame, keys: dict[str, str], n: str, total: int, by: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column _salt that belongs to the keys, so that no task gets all rows of a hot key.

    ``sized`` has a row for each key with the number n of its rows among ``total``; ``keys`` maps columns of ``rows`` to
    those of ``sized``; ``by`` is what the rows of a hot key are dealt out by. Only the keys of hot rows are broadcast:
    SHARE of them at most, whatever the size of the tables."""
    limit = max(SHARE, total // SHARE)
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = sized.where(F.col(n) > limit).select(*[F.col(b).alias(f"_hot_{k}") for k, b in enumerate(keys.values())], parts.alias("_parts"))
    same = [F.col(a) == F.col(f"_hot_{k}") for k, a in enumerate(keys)]
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", F.coalesce(F.pmod(by, F.col("_parts")).cast("int"), F.lit(0)))
    copies = F.when(F.col(n) > limit, parts).otherwise(1)
    return dealt.drop("_parts", *[f"_hot_{k}" for k in range(len(keys))]), sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
