"""The engine's front: files or tables in, fields and documents out; functions for SQL; a command line.

    from framelake import api
    rows = api.read(spark, "/media/*.mp4")          # one row a file
    api.fields(rows)                                 # the long table
    api.inform(rows, "json")                         # a document a file
    api.register(spark)                              # media_format(content), media_fields(content) in SQL
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.parsing import long_fields, parsed, with_computed, with_file_level
from framelake.operators.registry import KERNELS, first_accepting, parser
from framelake.operators.streams import filter_keep, selection
from framelake.sinks.exporters import FORMS, export
from framelake.sources.media import concatenated, from_table, name_parts, options, read_files, sidecars

__all__ = ["FORMS", "fields", "inform", "parse", "parser", "read", "register", "table", "verify"]


def read(spark: SparkSession, *paths: str, pattern: str | None = None, policy: str = "compat", **given: str) -> DataFrame:
    """(path, length, parser, fields, truncated, error) of files, with what the file as a whole has. Options are those of
    ``sources.media``: with multifile="1", companions (by folder and stem, multifilemax of them) belong to their file."""
    set_ = options(**given)
    files = read_files(spark, *paths, pattern=pattern)
    if set_.get("multifile", "0") in ("1", "yes", "true"):
        named = name_parts(files)
        others = sidecars(named)
        own = named.join(others.select("path"), "path", "left_anti")
        files = concatenated(own, others, int(set_.get("multifilemax", 64)))
    return parse(files, policy)


def table(rows: DataFrame, path: str, content: str, policy: str = "compat") -> DataFrame:
    """The same of a table's BINARY column."""
    return parse(from_table(rows, path, content), policy)


def parse(files: DataFrame, policy: str = "compat") -> DataFrame:
    """The same of any (path, content)."""
    return with_computed(with_file_level(parsed(files, policy, keep_length=True)))


def fields(rows: DataFrame) -> DataFrame:
    return long_fields(rows)


def inform(rows: DataFrame, form: str = "text") -> DataFrame:
    """(path, document)."""
    return export(rows, form)


def verify(rows: DataFrame) -> DataFrame:
    """(path, IsComplete, Warning) of files that were read."""
    from framelake.operators.streams import verify as told

    return told(rows.where("parser is not null"))


def register(spark: SparkSession) -> None:
    """Makes media_format(content) and the table function media_fields(content) known to SQL. Both try the kernels in the
    order of detection; what only layouts know, ``parse`` tells."""
    from pyspark.sql.functions import udf, udtf

    order = _order()

    @udf("string")
    def media_format(content: bytes) -> str | None:
        found = first_accepting(order, bytes(content)) if content else None
        return next((v for k, p, n, v, _ in found[1] if n == "Format"), None) if found else None

    @udtf(returnType="kind_id int, pos int, name string, value string, is_extra boolean")
    class MediaFields:
        def eval(self, content: bytes) -> Iterator[tuple]:
            found = first_accepting(order, bytes(content)) if content else None
            yield from found[1] if found else ()

    spark.udf.register("media_format", media_format)
    spark.udtf.register("media_fields", MediaFields)


def _order() -> list[str]:
    from framelake.operators.detection import kernel_order

    return [n for n in kernel_order("sane") if n in KERNELS]


def main(arguments: list[str] | None = None) -> int:
    """``python -m framelake [--form json] [--policy sane] [--video-only] [--audio-only] [--stream Audio:0] [--verify] PATH...``"""
    cli = argparse.ArgumentParser(prog="framelake", description="Technical metadata of media files")
    cli.add_argument("paths", nargs="+")
    cli.add_argument("--form", choices=sorted(FORMS), default="text")
    cli.add_argument("--policy", choices=("compat", "sane"), default="sane")
    cli.add_argument("--video-only", action="store_true")
    cli.add_argument("--audio-only", action="store_true")
    cli.add_argument("--stream", action="append", default=[])
    cli.add_argument("--verify", action="store_true")
    given = cli.parse_args(arguments)
    spark = SparkSession.builder.appName("framelake").getOrCreate()
    rows = read(spark, *given.paths, policy=given.policy)
    if given.verify:
        for r in verify(rows).toLocalIterator():
            print(f"{r.path}: {r.IsComplete}" + (f" ({r.Warning})" if r.Warning else ""))
        return 0
    if given.video_only or given.audio_only or given.stream:
        out = export(filter_keep(fields(rows), *selection(given.video_only, given.audio_only, tuple(given.stream))), given.form)
    else:
        out = inform(rows, given.form)
    for r in out.toLocalIterator():
        print(r.document)
    for r in rows.where(F.col("error").isNotNull()).select("path", "error").toLocalIterator():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    return 0
