"""An extension: files that arrive in a folder are parsed as they come, with the plan of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from framelake.operators.parsing import parse

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def ingest(files: DataFrame, target: str, checkpoint: str, policy: str = "compat") -> StreamingQuery:
    """Appends the fields of all files that are there, exactly once, to Parquet at ``target``."""
    return parse(files, policy).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
