"""Files read by range: a kernel sees bytes, and only the blocks that it looks at are fetched, up to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.model import KERNEL_FIELD
from framelake.operators.registry import KERNELS, first_accepting

BUDGET = 8 << 20  # bytes of a file that are read at most
BLOCK = 1 << 16
WHOLE = 1 << 20  # files up to this size are read at once


class Ranged:
    """A file as bytes: slices, indexes, its length and a search. What lies beyond the budget reads as missing, and marks the
    file as not read in full."""

    def __init__(self, file, size: int, budget: int = BUDGET, block: int = BLOCK):
        self.file, self.size, self.budget, self.block = file, size, budget, block
        self.blocks: dict[int, bytes] = {}
        self.requested = self.largest = 0
        self.short = False

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            want = min(self.block, self.size - k * self.block)
            if self.requested + want > self.budget:
                self.short = True
                return b""
            self.file.seek(k * self.block)
            self.blocks[k] = self.file.read(want)
            self.requested, self.largest = self.requested + want, max(self.largest, want)
        return self.blocks[k]

    def __getitem__(self, at):
        if isinstance(at, int):
            one = self[at : at + 1] if at >= 0 else self[self.size + at : self.size + at + 1]
            if not one:
                raise IndexError(at)
            return one[0]
        start, stop, step = at.indices(self.size)
        if step != 1:
            return bytes(self[min(start, stop) : max(start, stop)])[:: step]
        parts = []
        while start < stop:
            k = start // self.block
            part = self._block(k)[start - k * self.block : stop - k * self.block]
            if not part:
                break
            parts.append(part)
            start += len(part)
        return b"".join(parts)

    def __bytes__(self) -> bytes:
        return self[:]

    def startswith(self, mark: bytes) -> bool:
        return self[: len(mark)] == mark

    def find(self, mark: bytes, start: int = 0, stop: int | None = None) -> int:
        """Block by block, so that a mark near ``start`` costs no more than its surroundings."""
        stop = self.size if stop is None else min(stop, self.size)
        at = start
        while at + len(mark) <= stop:
            part = self[at : min(at + self.block + len(mark) - 1, stop)]
            k = part.find(mark)
            if k >= 0:
                return at + k
            if len(part) < len(mark):
                return -1
            at += len(part) - len(mark) + 1
        return -1

    def __contains__(self, mark: bytes) -> bool:
        return self.find(mark) >= 0


_FIELD = pa.struct([("kind_id", pa.int32()), ("pos", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("is_extra", pa.bool_())])


def _walk(parser: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fields, cut, read, errors = [], [], [], [], []
            for path, size, candidates in zip(*(c.to_pylist() for c in batch.columns)):
                found, source, error = None, None, None
                try:
                    store, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                    with store.open_input_file(at) as file:
                        source = Ranged(file, size)
                        body = source[:] if size <= WHOLE else source
                        found = first_accepting([parser] if parser else [n for n in candidates if n in KERNELS], body)
                except (OSError, pa.ArrowException) as e:
                    error = str(e)[:500]
                names.append(found[0] if found else None)
                fields.append([dict(zip(_FIELD.names, row)) for row in found[1]] if found else None)
                cut.append(bool(found and (found[2] or source.short)))
                read.append(source.requested if source else 0)
                errors.append(error or (None if found else "no parser accepts the file"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(fields, pa.list_(_FIELD)), pa.array(cut, pa.bool_()), pa.array(read, pa.int64()), pa.array(errors, pa.string())],
                ["path", "length", "parser", "fields", "truncated", "bytes_read", "error"],
            )

    return run


def parse_paths(spark: SparkSession, *paths: str, parser: str | None = None, policy: str = "compat", pattern: str | None = None) -> DataFrame:
    """(path, length, parser, fields, truncated, bytes_read, error) of files, of which the walked formats are read by range.

    Spark lists the files and never reads their contents for that; a task then opens each and reads what the kernels ask
    for, ``BUDGET`` bytes at most. Needs paths that pyarrow's file systems reach; where only Spark reaches them, ``parse``
    on ``read_files`` does the same with whole contents. Without ``parser``, the kernels are tried in the order of detection;
    formats with a layout or a name only have no fields here. A file that can't be opened has an error and no fields."""
    from framelake.operators.detection import kernel_order

    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(list(paths)).select("path", "length")
    order = F.array(*[F.lit(n) for n in kernel_order(policy)])
    schema = f"path string, length long, parser string, fields array<{KERNEL_FIELD}>, truncated boolean, bytes_read long, error string"
    return files.select("path", "length", order.alias("candidates")).mapInArrow(_walk(parser), schema)
