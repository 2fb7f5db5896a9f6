"""Vectorised splitting of texts into words and hashed word shingles.

A word is a run of ``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased. Work is done on the UTF-8 bytes of many texts at
once, so its memory is a fixed multiple of ``CHUNK`` or of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def chunked(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[list[bytes]]:
    """Encoded texts in groups of about ``limit`` bytes; null counts as empty."""
    group, size = [], 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > limit:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield group


def word_hashes(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text the index of its first word (one more at the end)."""
    buf = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in group), dtype=np.int64, count=len(group))
    text_starts = np.concatenate(([0], np.cumsum(lengths)))
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(group) + 1, dtype=np.int64)
    up, down = _power_tables(len(buf))
    weighed = _BYTE[_LOWER[buf]] * up
    weighed[blank] = 0
    hashes = np.add.reduceat(weighed, starts) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, text_starts)


def shingle_sets(texts: Iterable[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``words``-word shingles as 64-bit hashes.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    for group in chunked(texts):
        hashes, first = word_hashes(group)
        n = len(hashes)
        rolled = hashes.copy()
        for k in range(1, words):
            if n > k:
                rolled[: n - k] = (rolled[: n - k] ^ (rolled[: n - k] >> _U(29))) * _U(0xD6E8FEB86659FD93) + hashes[k:]
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    whole = mix(whole ^ (whole >> _U(17))) + hashes[k : k + 1]
                yield mix(whole)
            else:
                yield np.empty(0, dtype=np.uint64)
