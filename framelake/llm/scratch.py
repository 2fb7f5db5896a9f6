"""Tables that cut lineage, kept in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROWS = 100_000  # narrow rows that a file of a table has at least, where their number is known
_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local: list[str] = []
_lock = threading.Lock()
_held: dict[int, tuple[int, str]] = {}  # by session: runs that have set the batch size, and what it was before
_found: contextvars.ContextVar[list["Scratch"] | None] = contextvars.ContextVar("scratches", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where the setting is empty, a local session (tests) gets a temporary folder; on a
    cluster that would be another folder on each machine, so it is an error there."""
    root = spark.conf.get(_KEY, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_KEY} has to name a folder that all executors share")
    with _lock:
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="framelake-"))
    return _local[0]


class Scratch:
    """The intermediate tables of one call of an operator, in a folder of their own.

    ``table`` writes a frame as Parquet to the shared folder and returns a frame that reads it, so a lost
    executor costs a re-read and never a recomputation. ``drop`` deletes tables that no result still needs.
    The others stay for as long as a lazily read result may need them: until ``release``, the end of an enclosing
    ``released`` block, or the end of the driver. So results of several calls, threads and sessions live side by side.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.owner = spark, owner
        self.paths: dict[str, str] = {}
        self.root = f"{scratch_root(spark)}/framelake-{owner}-{uuid.uuid4().hex}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if (found := _found.get()) is not None:
            found.append(self)

    def folder(self, label: str) -> str:
        self.paths[label] = f"{self.root}/{label}"
        return self.paths[label]

    def table(self, label: str, df: DataFrame, batch: int | None = None, dense: bool = False, rows: int | None = None, each: int = ROWS) -> DataFrame:
        """``batch``: rows that Python workers get at once, where rows are wide. ``dense``: smaller files for more work and
        memory, which pays for texts. ``rows``: about how many there are, so that the table is written by a task for each
        ``each`` of them rather than by one for each partition of a shuffle, however little that holds."""
        path = self.folder(label)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // each)))
        with self.batches(batch):
            df.write.option("compression", "zstd" if dense else "snappy").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def batches(self, rows: int | None) -> Iterator[None]:
        """Sets the session's batch size while an action runs. Of actions at one time the first sets it and the last one
        puts it back; whatever else the session runs meanwhile gets smaller batches, which changes no result."""
        if not rows:
            yield
            return
        key = id(self.spark)
        with _lock:
            users, before = _held.get(key) or (0, self.spark.conf.get(_BATCH))
            _held[key] = users + 1, before
            if not users:
                self.spark.conf.set(_BATCH, str(rows))
        try:
            yield
        finally:
            with _lock:
                users, before = _held.pop(key)
                if users > 1:
                    _held[key] = users - 1, before
                else:
                    self.spark.conf.set(_BATCH, before)

    def drop(self, *labels: str) -> None:
        for label in labels:
            if path := self.paths.pop(label, None):
                fs, at = self._at(path)
                fs.delete(at, True)

    def release(self) -> None:
        """Deletes all tables of the call; its results can't be read any more."""
        fs, path = self._at(self.root)
        fs.delete(path, True)
        self.paths.clear()

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Around calls of operators whose results are written inside: deletes their tables at the end. Calls of other
    threads aren't touched."""
    found: list[Scratch] = []
    token = _found.set(found)
    try:
        yield
    finally:
        _found.reset(token)
        for scratch in found:
            scratch.release()
