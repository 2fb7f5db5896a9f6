"""Fixed-offset decoding of BINARY columns in Catalyst. Offsets count bytes from 0; a short value gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(content: Column, offset: int, size: int) -> Column:
    return F.substring(content, offset + 1, size)


def reverse_bytes(raw: Column, size: int) -> Column:
    return F.concat(*[F.substring(raw, k, 1) for k in range(size, 0, -1)])


def _number(raw: Column, size: int) -> Column:
    return F.when(F.octet_length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("long"))


def be(content: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes."""
    return _number(at(content, offset, size), size)


def le(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes."""
    return _number(reverse_bytes(at(content, offset, size), size), size)


def signed(value: Column, size: int) -> Column:
    """Two's complement of an unsigned integer of ``size`` bytes."""
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def magic(content: Column, *marks: tuple[int, bytes]) -> Column:
    """Whether all marks stand at their offsets."""
    found = None
    for offset, mark in marks:
        here = at(content, offset, len(mark)) == F.lit(bytes(mark))
        found = here if found is None else found & here
    return F.coalesce(found, F.lit(False))


def to_le(value: Column, size: int) -> Column:
    """Little-endian bytes of an integer column."""
    return reverse_bytes(to_be(value, size), size)


def to_be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def latin1(content: Column, offset: int, size: int) -> Column:
    return F.decode(at(content, offset, size), "ISO-8859-1")
