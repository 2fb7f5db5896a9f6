"""Interleaved samples taken apart into pairs of channels and put together again, and spans of frame indexes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_pairs(data: bytes, channels: int, sample: int) -> list[bytes]:
    """The pairs of channels of interleaved samples of ``sample`` bytes, each interleaved again; a last odd channel stands
    alone. What is less than a whole frame at the end is left out."""
    frame = channels * sample
    grid = np.frombuffer(data, np.uint8)[: len(data) // frame * frame].reshape(-1, channels, sample)
    return [grid[:, k : k + 2].tobytes() for k in range(0, channels, 2)]


def group_pairs(parts: list[bytes], sample: int) -> bytes:
    """Streams of two channels (the last may have one) as one interleaved stream, as long as the shortest."""
    if not parts:
        return b""
    frames = min(len(p) // (2 * sample) for p in parts[:-1]) if len(parts) > 1 else len(parts[0]) // sample
    last = 2 if len(parts[-1]) // max(1, frames * sample) >= 2 or len(parts) == 1 and len(parts[0]) % (2 * sample) == 0 else 1
    frames = min(frames, len(parts[-1]) // (last * sample)) if len(parts) > 1 else len(parts[0]) // (last * sample)
    width = [2] * (len(parts) - 1) + [last]
    return np.concatenate([np.frombuffer(p, np.uint8)[: frames * w * sample].reshape(frames, w, sample) for p, w in zip(parts, width)], axis=1).tobytes()


@functools.cache
def _splitter():
    def run(data: pa.Array, channels: pa.Array, sample: pa.Array) -> pa.Array:
        rows = [split_pairs(d, c, s) if d is not None and c and s else None for d, c, s in zip(data.to_pylist(), channels.to_pylist(), sample.to_pylist())]
        return pa.array(rows, pa.list_(pa.binary()))

    return F.arrow_udf("array<binary>")(run)


def channel_pairs(data: Column, channels: Column, sample: Column) -> Column:
    """``split_pairs`` on columns."""
    return _splitter()(data, channels.cast("int"), sample.cast("int"))


def index_duration(times: Column) -> Column:
    """From the times of a file's frames in ms: from the first to the last; null without frames."""
    return F.when(F.size(times) > 0, F.element_at(times, -1) - F.element_at(times, 1))


def last_frame_duration(times: Column) -> Column:
    """How long the last frame but one is shown; null with fewer than two."""
    return F.when(F.size(times) > 1, F.element_at(times, -1) - F.element_at(times, -2))
