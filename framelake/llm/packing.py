"""Packing of token sequences by vector bin packing with the dot-product heuristic.

A bin is one training sequence with limits on tokens, segments and loss-bearing tokens. The open bin takes, again and
again, the piece whose demands have the largest dot product with the room that is left in each respect, among those that
fit. A gap that no piece fits is filled with the head of a longer one; the tail goes back to the waiting pieces. A bin
that can't be filled at all is cut down to a power of two, which needs no padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = 1024
SEGMENTS = 64
END = 0  # the id after each document
WAITING = 2048  # pieces that a task holds to choose from


@functools.lru_cache(maxsize=4)
def byte_level_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Encodes texts with the byte-level BPE of a tokenizers file: its own ids, found by a faster library.

    The file spells each byte as a printable character: printable Latin-1 ones stand for themselves, the others for the
    code points from 256 on, in order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    encoder = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return encoder.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its matcher has no stack for runs of about a million blanks
            return _slow_encoder(path).encode(text, add_special_tokens=False).ids

    return encode


@functools.lru_cache(maxsize=4)
def _slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Piece:
    """A run of one example's tokens: ``start`` tokens of it come before; ``loss`` marks those that bear loss."""

    __slots__ = ("key", "start", "ids", "loss", "total")

    def __init__(self, key, start: int, ids: np.ndarray, loss: np.ndarray, total: int):
        self.key, self.start, self.ids, self.loss, self.total = key, start, ids, loss, total

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return Piece(self.key, self.start, self.ids[:at], self.loss[:at], self.total), Piece(self.key, self.start + at, self.ids[at:], self.loss[at:], self.total)


class Packer:
    """Places pieces that arrive one by one; yields each bin, a list of pieces, once it is full."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None, waiting: int = WAITING):
        self.limits = np.array([tokens, segments, loss_tokens or tokens], dtype=float)
        self.tokens, self.segments, self.loss_tokens, self.waiting = tokens, segments, loss_tokens or tokens, waiting
        self.pieces: list[Piece] = []
        self.demand = np.empty((0, 3))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.tokens or int(piece.loss.sum()) > self.loss_tokens:
            head, piece = piece.cut(self._fits(piece, self.tokens, self.loss_tokens))
            if len(head.ids) == self.tokens:
                yield [head]
            else:
                self.pieces.append(head)
        if len(piece.ids):
            self.pieces.append(piece)
        if len(self.pieces) >= self.waiting:
            yield from self._pack(self.waiting // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack(0)

    def _fits(self, piece: Piece, tokens: int, loss: int) -> int:
        """How many of the piece's first tokens fit into so much room."""
        size = min(len(piece.ids), tokens)
        if int(piece.loss[:size].sum()) > loss:
            size = int(np.searchsorted(np.cumsum(piece.loss), loss, side="right"))
        return size

    def _pack(self, until: int) -> Iterator[list[Piece]]:
        pieces = self.pieces
        demand = np.array([[len(p.ids), 1, int(p.loss.sum())] for p in pieces], dtype=float).reshape(-1, 3)
        waits = np.ones(len(pieces), dtype=bool)
        scaled = demand / self.limits
        left = len(pieces)
        while left > until:
            room, chosen = self.limits.copy(), []
            while left and room[0] > 0 and room[1] > 0:
                usable = waits & (demand <= room).all(axis=1)
                if room[1] == 1 and room[0] > 0:
                    usable &= demand[:, 0] >= room[0]  # the last segment has to fill the bin
                if usable.any():
                    at = int(np.argmax(np.where(usable, scaled @ (room / self.limits), -1.0)))
                    chosen.append(pieces[at])
                    room -= demand[at]
                    waits[at] = False
                    left -= 1
                    continue
                longer = np.where(waits & (demand[:, 0] > room[0]), demand[:, 0], -1.0)
                at = int(np.argmax(longer))
                if longer[at] < 0 or (size := self._fits(pieces[at], int(room[0]), int(room[2]))) < room[0]:
                    break
                head, pieces[at] = pieces[at].cut(size)
                demand[at] = len(pieces[at].ids), 1, int(pieces[at].loss.sum())
                scaled[at] = demand[at] / self.limits
                chosen.append(head)
                room[0] = 0
            total = self.tokens - int(room[0])
            if room[0] and total & (total - 1):
                chosen, back = self._trim(chosen, 1 << (total.bit_length() - 1))
                pieces.extend(back)
                more = np.array([[len(p.ids), 1, int(p.loss.sum())] for p in back], dtype=float)
                demand, scaled = np.concatenate((demand, more)), np.concatenate((scaled, more / self.limits))
                waits = np.concatenate((waits, np.ones(len(back), dtype=bool)))
                left += len(back)
            yield chosen
        self.pieces = [p for p, w in zip(pieces, waits) if w]

    @staticmethod
    def _trim(chosen: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
        kept, back, used = [], [], 0
        for piece in chosen:
            room = size - used
            if room >= len(piece.ids):
                kept.append(piece)
            elif room > 0:
                head, tail = piece.cut(room)
                kept.append(head)
                back.append(tail)
            else:
                back.append(piece)
            used += min(room, len(piece.ids))
        return kept, back


def _pack_documents(path: str, pattern: str, tokens: int, segments: int, loss_tokens: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(path, pattern)
        packer = Packer(tokens, segments, loss_tokens)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def placed(bins: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for bin_ in bins:
                offset = 0
                for piece in bin_:
                    rows.append((piece.key, piece.start, len(piece.ids), zlib.crc32(piece.ids.astype("<u4").tobytes()), piece.total, sequence, offset))
                    offset += len(piece.ids)
                sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text or ""), END], dtype=np.uint32)
                placed(packer.add(Piece(doc_id, 0, ids, np.full(len(ids), loss, dtype=bool), len(ids))))
                if len(rows) >= 10_000:
                    yield flushed()
        placed(packer.finish())
        yield flushed()

    return run


def pack_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, key: str = "doc_id", loss: str | None = None, loss_tokens: int | None = None
) -> DataFrame:
    """Packs the tokens of ``docs`` (``key`` and text; others are ignored) into sequences of ``tokens`` at most.

    A document is its ids under the tokenizer file at ``path`` and then ``END``; null counts as empty text, which still
    has its ``END``. ``loss`` names a boolean column that tells whether a row's ids bear loss, as those of an answer do
    and those of a prompt don't (null: they don't); without it all do. ``loss_tokens`` limits those of a sequence; a
    sequence that has reached that limit before its others may be cut to a power of two. Returns a row for each piece:
    doc_id (the key), start, length, ids_crc32, doc_tokens, sequence_id and offset. Documents are packed where they are
    read, without a shuffle; without a limit on loss every sequence is full but those few of a task whose length is a
    smaller power of two. Rows that share a key are documents of their own. An empty table gives no rows.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    schema = ", ".join(f"{c} long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    bears = F.coalesce(F.col(loss), F.lit(False)) if loss else F.lit(True)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bears.alias("loss"))
    return rows.mapInArrow(_pack_documents(path, pattern, tokens, segments, loss_tokens), schema)
