"""Comparing texts line by line and fields by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """From two tables (path, text): the lines that the left text of a path has and the right one lacks or has another
    number of times, with their number."""
    lines = lambda d: d.select("path", F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("path", "line").agg(F.count("*").alias("n"))
    return lines(left).join(lines(right), ["path", "line", "n"], "left_anti")


def name_coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Per path: how many of the wanted field names are found, letter case aside."""
    names = lambda d: d.select("path", F.lower("name").alias("name")).distinct()
    both = names(wanted).join(names(found).withColumn("hit", F.lit(1)), ["path", "name"], "left")
    return both.groupBy("path").agg(F.count("*").alias("total"), F.count("hit").alias("matched")).withColumn("pct", F.round(100.0 * F.col("matched") / F.col("total"), 1))
