"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Cyclic boosting visits the features in turn and adds to each one's lookup table a
shallow tree over its bins, fitted to the logistic loss's gradient; then the pairs whose grids promise most are boosted
in the same way. A text's score is the logistic of the sum of its looked-up values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.language_id import held_out
from framelake.llm.words import chunked, word_hashes

FEATURES = ("symbols", "upper", "digits", "bare_words", "repeats", "distinct", "word_length", "log_words", "stops", "odd_ends", "line_words", "exclaims")

_BYTES = np.arange(256)
_LOWERS = (_BYTES >= 97) & (_BYTES <= 122)
_UPPERS = (_BYTES >= 65) & (_BYTES <= 90)
_DIGITS = (_BYTES >= 48) & (_BYTES <= 57)
_LETTERS = _LOWERS | _UPPERS | (_BYTES >= 192)
_BLANKS = np.isin(_BYTES, (9, 10, 11, 12, 13, 32))
_STOPS = np.isin(_BYTES, list(b".,;:?"))
_SYMBOLS = ~(_LETTERS | _DIGITS | _BLANKS | _STOPS | (_BYTES >= 128) | np.isin(_BYTES, list(b"'\"-()!")))


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text, from its whole bytes; null counts as empty, whose features are 0."""
    rows = [_group_features(group) for group in chunked(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _group_features(group: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in group])))[:-1]

    def count(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[buf].astype(np.int64), begins).astype(float)

    letters, uppers, digits, symbols, stops = (count(x) for x in (_LETTERS, _UPPERS, _DIGITS, _SYMBOLS, _STOPS))
    lines = np.add.reduceat((buf == 10).astype(np.int64), begins) + 1.0
    exclaims = np.add.reduceat((buf == 33).astype(np.int64), begins).astype(float)
    hashes, first = word_hashes(group)
    n = np.diff(first).astype(float)
    owner = np.repeat(np.arange(len(group)), np.diff(first))
    blank = _BLANKS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    starts, ends = edge[0::2], edge[1::2]

    def words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flag], minlength=len(group)).astype(float)

    cum = np.concatenate(([0], np.cumsum(_LETTERS[buf])))
    bare = words(cum[ends] == cum[starts]) if len(starts) else np.zeros(len(group))
    odd = words(_SYMBOLS[buf[ends - 1]]) if len(starts) else np.zeros(len(group))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=float)
    some, used = np.maximum(n, 1), np.maximum(letters, 1)
    return np.stack([symbols / used, uppers / used, digits / used, bare / some, words(same) / some, distinct / np.power(some, 0.8), letters / some, np.log1p(n), stops / some, odd / some, np.minimum(n / lines, 1e4), exclaims / some], axis=1)


class AdditiveModel:
    """Bin edges, a lookup table for each feature and for each chosen pair, and an intercept."""

    def __init__(self, bins: int = 32, cycles: int = 120, pair_cycles: int = 40, pairs: int = 6, rate: float = 0.15, least: float = 8.0, ridge: float = 4.0):
        self.bins, self.cycles, self.pair_cycles, self.pairs_kept, self.rate, self.least, self.ridge = bins, cycles, pair_cycles, pairs, rate, least, ridge
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The best cut of a run of bins: its gain, and how many bins lie left of it (0: none is worthwhile)."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= 1e-3) & (hr >= 1e-3), self._gain(gl, hl) + self._gain(gr, hr) - self._gain(g.sum(), h.sum()), 0.0)
        at = int(np.argmax(gain))
        return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        _, cut = self._split(g, h) if depth else (0.0, 0)
        if not cut:
            return np.full(len(g), -self.rate * g.sum() / (h.sum() + self.ridge))
        return np.concatenate((self._tree(g[:cut], h[:cut], depth - 1), self._tree(g[cut:], h[cut:], depth - 1)))

    def _grid_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """A tree over a grid: one cut by either axis, then one of each half by the other."""
        best = (0.0, np.full(g.shape, -self.rate * g.sum() / (h.sum() + self.ridge)))
        for turn in (False, True):
            a, b = (g.T, h.T) if turn else (g, h)
            gain, cut = self._split(a.sum(1), b.sum(1))
            if not cut:
                cut = a.shape[0] // 2
            out, total = np.empty(a.shape), gain
            for part in (slice(0, cut), slice(cut, None)):
                more, _ = self._split(a[part].sum(0), b[part].sum(0))
                total += more
                out[part] = self._tree(a[part].sum(0), b[part].sum(0), 1)
            if total > best[0]:
                best = (total, out.T if turn else out)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.intercept = float(np.log(rate / (1 - rate)))
        for k in range(x.shape[1]):
            marks = np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.empty(0)
            self.edges.append(marks)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(np.unique(y)) < 2:
            return self
        binned = self._binned(x)
        total = np.full(len(y), self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return p - y, p * (1 - p)

        for _ in range(self.cycles):
            for k, table in enumerate(self.tables):
                g, h = slopes()
                step = self._tree(np.bincount(binned[:, k], g, len(table)), np.bincount(binned[:, k], h, len(table)))
                table += step
                total += step[binned[:, k]]

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            shape = len(self.tables[i]), len(self.tables[j])
            return np.bincount(binned[:, i] * shape[1] + binned[:, j], v, shape[0] * shape[1]).reshape(shape)

        g, h = slopes()
        ranked = sorted(((self._grid_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), key=lambda r: (-r[0], r[1:]))
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for gain, i, j in ranked[: self.pairs_kept] if gain > 0]
        for _ in range(self.pair_cycles):
            for i, j, table in self.pairs:
                g, h = slopes()
                _, step = self._grid_tree(grid(i, j, g), grid(i, j, h))
                table += step
                total += step[binned[:, i], binned[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[binned[:, k]]
        for i, j, table in self.pairs:
            total += table[binned[:, i], binned[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = text_features(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "features"])


def _scored(model: AdditiveModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(text_features(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 10_000) -> AdditiveModel:
    """Fits on a bounded sample: of the labelled rows that aren't held out, the ``train_rows`` with the lowest hash of
    doc_id. Of documents that share a doc_id one counts, that with the lowest features. Without labelled rows every score is 0.5; with one label only, the score is the same for all texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(train_rows)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")
    rows = labelled.mapInArrow(_featured, "doc_id long, features array<double>").groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    found = {r.doc_id: r.features for r in rows}
    pairs = [(found[r.doc_id], r.quality) for r in sample.collect() if r.doc_id in found]
    x = np.array([f for f, _ in pairs], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([q > 0 for _, q in pairs], dtype=float)
    order = np.lexsort((*x.T, y))
    return AdditiveModel().fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), train_rows: int = 10_000) -> DataFrame:
    """Scores every text of ``docs`` (doc_id, text): how likely ``labels`` (doc_id, quality) would mark it 1.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) and, if asked for, the columns in ``keep``
    as fields of a struct named row, a row for each
    row. Null counts as empty text, which is scored like any other. Labels without doc_id or quality are ignored;
    repeated labels count each. Labels of held-out rows are never read; lang, source and doc_id are no features.
    """
    model = fit_quality(docs, labels, train_rows)
    kept = [f for f in docs.schema.fields if f.name in keep]
    inner = [F.col(f"`{f.name}`").alias(f"keep_{k}") for k, f in enumerate(kept)]
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *inner)
    schema = "doc_id long, held_out boolean, " + "".join(f"keep_{k} {f.dataType.simpleString()}, " for k, f in enumerate(kept)) + "score double"
    out = rows.mapInArrow(_scored(model), schema)
    row = [F.struct(*[F.col(f"keep_{k}").alias(f.name) for k, f in enumerate(kept)]).alias("row")] if kept else []
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *row)
