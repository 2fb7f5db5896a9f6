"""Summaries of streams: per file, or per any collection of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import display as D


def distinct_joined(value: Column, separator: str = ", ") -> Column:
    """Aggregate: the distinct values in byte order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def distinct_numbers(value: Column, separator: str = ", ") -> Column:
    """Aggregate: the distinct whole numbers among the values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(value.try_cast("long"))), lambda x: x.cast("string")), separator)


def resolution(width: Column, height: Column) -> Column:
    """Aggregate: the only size, or the least and the largest of each side."""
    w, h = width.try_cast("long"), height.try_cast("long")
    size = lambda f: F.concat(f(w).cast("string"), F.lit("x"), f(h).cast("string"))
    return F.when(F.count("*") == 1, size(F.min)).otherwise(F.concat_ws(" - ", size(F.min), size(F.max)))


def counts_line(video: Column, audio: Column, text: Column, image: Column) -> Column:
    return F.format_string("Streams: %d video, %d audio, %d text, %d image", video, audio, text, image)


def summarise(wide: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: the number of streams by kind, and what kinds of streams there are. ``wide`` has kind and fields."""
    get = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    grouped = wide.groupBy(*keys).agg(
        *[n(k).alias(f"{k.lower()}_streams") for k in ("Video", "Audio", "Text", "Image")],
        *[distinct_joined(of(k, get("Format"))).alias(f"{k.lower()}_formats") for k in ("Video", "Audio", "Text", "Image")],
        distinct_numbers(of("Audio", get("Channels"))).alias("channels"),
        distinct_numbers(of("Audio", get("SamplingRate"))).alias("sampling_rates"),
        distinct_joined(of("Audio", get("Language"))).alias("audio_languages"),
        F.min(of("Video", get("Width")).try_cast("long")).alias("width_min"),
        F.max(of("Video", get("Width")).try_cast("long")).alias("width_max"),
        F.sum(of("General", get("FileSize")).try_cast("long")).alias("bytes"),
        F.sum(of("General", get("Duration")).try_cast("long")).alias("duration_ms"),
    )
    line = counts_line(F.col("video_streams"), F.col("audio_streams"), F.col("text_streams"), F.col("image_streams"))
    return grouped.withColumns({"line": line, "size": D.summary_size(F.col("bytes")), "duration": D.summary_duration(F.col("duration_ms"))})
