"""Relational operators on the long table of fields (see framelake.model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framelake.functions.display import field_alias
from framelake.model import kind_id

STREAM = ("path", "kind", "pos")


def first_write_wins(writes: DataFrame) -> DataFrame:
    """Keeps of every field the value that was written first. A partial aggregation by field; no window."""
    keys = [*STREAM, "name", "is_extra"]
    return writes.groupBy(*keys).agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def last_write_wins(writes: DataFrame) -> DataFrame:
    """Forced writes: the value written last, in the place of the first."""
    keys = [*STREAM, "name", "is_extra"]
    return writes.groupBy(*keys).agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def stream_counts(fields: DataFrame) -> DataFrame:
    """How many streams of each kind a file has: positions up to the largest, as writing to a position creates all
    before it."""
    return fields.groupBy("path", "kind").agg((F.max("pos") + 1).alias("streams"))


def filter_keep(fields: DataFrame, kinds: tuple[str, ...], streams: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Keeps streams of ``kinds``; of a kind that ``streams`` names, only the named ones. Positions are numbered anew."""
    named = {k for k, _ in streams}
    keep: Column = F.col("kind").isin(*[k for k in kinds if k not in named]) if set(kinds) - named else F.lit(False)
    for kind, pos in streams:
        if kind in kinds:
            keep = keep | ((F.col("kind") == kind) & (F.col("pos") == pos))
    kept = fields.where(keep)
    rank = F.dense_rank().over(Window.partitionBy("path", "kind").orderBy("pos")) - 1
    return kept.withColumn("pos", rank.cast("int"))


def selection(video_only: bool = False, audio_only: bool = False, streams: tuple[str, ...] = (), compat: bool = False) -> tuple[tuple[str, ...], tuple[tuple[str, int], ...]]:
    """Command-line switches as arguments of ``filter_keep``; General is always kept. With ``compat`` a lone stream
    selector keeps General only."""
    parsed = tuple((k, int(n)) for k, _, n in (s.partition(":") for s in streams) if n.isdecimal())
    kinds = ["General", *(["Video"] if video_only else []), *(["Audio"] if audio_only else [])]
    if not (video_only or audio_only) and not compat:
        kinds += [k for k, _ in parsed if k not in kinds]
    return tuple(kinds), parsed


def streams_wide(fields: DataFrame) -> DataFrame:
    """One row a stream, with its fields and extras as maps and the names in order."""
    pairs = lambda extra: F.map_from_entries(F.transform(F.filter("rows", lambda r: r["is_extra"] == extra), lambda r: F.struct(r["name"], r["value"])))
    rows = fields.groupBy("path", "kind", "pos").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "value", "is_extra"))).alias("rows"))
    order = F.transform(F.filter("rows", lambda r: ~r["is_extra"]), lambda r: r["name"])
    return rows.select("path", kind_id(F.col("kind")).alias("kind_id"), "kind", "pos", pairs(False).alias("fields"), pairs(True).alias("extras"), order.alias("field_order"))


def lookup_field(wide: DataFrame, name: str) -> DataFrame:
    """A field by its name or alias: fields, then extras, then both by the alias's target."""
    target = field_alias(F.lit(name))
    value = F.coalesce(*[F.try_element_at(m, n) for n in (F.lit(name), target) for m in (F.col("fields"), F.col("extras"))])
    return wide.select("path", "kind", "pos", value.alias("value"))


def typed_view(fields: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """One row a stream of a kind, with named fields cast to types; what can't be cast is null."""
    picked = [F.max(F.when((F.col("name") == n) & ~F.col("is_extra"), F.col("value"))).try_cast(t).alias(n) for n, t in columns.items()]
    return fields.where((F.col("kind") == kind) & F.col("name").isin(*columns)).groupBy("path", "pos").agg(*picked)


def duplicate_streams(wide: DataFrame) -> DataFrame:
    """Streams of video, audio and text that repeat an earlier one of their file and kind: equal Format, Language and
    Width or, lacking that, Channels. ``wide`` has path, kind, pos, format, language, width and channels."""
    known = wide.where(F.col("kind").isin("Video", "Audio", "Text") & F.col("format").isNotNull())
    size = F.coalesce("width", "channels")
    rank = F.row_number().over(Window.partitionBy("path", "kind", "format", F.coalesce("language", F.lit("\0")), F.coalesce(size, F.lit("\0"))).orderBy("pos"))
    return known.withColumn("_rank", rank).where("_rank > 1").select("path", "kind", "pos")


def verify(files: DataFrame) -> DataFrame:
    """From (path, truncated): IsComplete, and a warning for cut-off files."""
    return files.select("path", F.when(F.col("truncated"), "No").otherwise("Yes").alias("IsComplete"), F.when(F.col("truncated"), "File appears truncated").alias("Warning"))
