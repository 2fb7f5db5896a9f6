"""Where blobs come from: files, tables, companions of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options by name; underscores and letter case don't matter. multifile and multifilemax decide on companions (``api.read``);
#: the others are known, so that callers' settings pass, and change nothing here.
OPTIONS = frozenset("demux tracelevel traceformat tracetimesectiononlyfirst parsespeed showcomplete complete multifile multifilemax".split())


def options(**given: str) -> dict[str, str]:
    """Checked options; an unknown one is an error."""
    out = {k.replace("_", "").lower(): v for k, v in given.items()}
    if unknown := set(out) - OPTIONS:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return out


def read_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files; ``pattern`` is a glob on names."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(list(paths))


def from_table(rows: DataFrame, path: str, content: str) -> DataFrame:
    """A table's BINARY column as files."""
    return rows.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"), F.octet_length(content).cast("long").alias("length"))


def name_parts(files: DataFrame) -> DataFrame:
    """Adds folder, stem and extension (as it is written) of each path."""
    name = F.substring_index("path", "/", -1)
    folder = F.substring("path", F.lit(1), F.greatest(F.lit(0), F.length("path") - F.length(name) - 1))
    dotted = name.contains(".")
    stem = F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return files.withColumns({"folder": folder, "stem": stem, "extension": F.when(dotted, F.substring_index(name, ".", -1))})


SIDECARS = ("srt", "SST", "sub", "idx")


def sidecars(files: DataFrame) -> DataFrame:
    """Of files with folder, stem and extension, those that accompany another: by extension, or as a stream folder's
    m2ts and mts."""
    inside = F.substring_index("folder", "/", -1).eqNullSafe("STREAM") & F.col("extension").isin("m2ts", "mts")
    return files.where(F.col("extension").isin(*SIDECARS) | inside)


def with_sidecars(files: DataFrame, others: DataFrame) -> DataFrame:
    """Joins files with their companions by folder and stem; a file without one stays."""
    return files.join(others, ["folder", "stem"], "left")


def concatenated(files: DataFrame, others: DataFrame, most: int = 64) -> DataFrame:
    """Each file's content followed by its companions' in order of path, of the first ``most`` of them (the option
    multifilemax). Companions are chosen by their paths; only the contents of those that are are put together."""
    named = others.select("folder", "stem", F.col("path").alias("sidecar")).groupBy("folder", "stem").agg(F.array_sort(F.collect_set("sidecar")).alias("all"))
    chosen = named.select("folder", "stem", F.posexplode(F.slice("all", 1, most)).alias("at", "sidecar"))
    parts = chosen.join(others.select(F.col("path").alias("sidecar"), F.col("content").alias("more")), "sidecar")
    whole = parts.groupBy("folder", "stem").agg(F.array_sort(F.collect_list(F.struct("at", "more"))).alias("parts"))
    joined = files.join(whole, ["folder", "stem"], "left")
    return joined.select("path", F.aggregate(F.coalesce("parts", F.array().cast("array<struct<at: int, more: binary>>")), F.col("content"), lambda a, p: F.concat(a, p["more"])).alias("content"))


def reader_label(path: Column) -> Column:
    """File, Directory, HTTP or MMS."""
    return F.when(path.rlike("^https?://"), "HTTP").when(path.rlike("^mmsh?://"), "MMS").when(path.endswith("/"), "Directory").otherwise("File")
