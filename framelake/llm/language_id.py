"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends only on its code point. A trigram's vector binds (multiplies)
the vectors of its letters, the first permuted (rotated) twice and the second once; a text's vector bundles (adds) those
of its trigrams. A language's prototype bundles the vectors of training texts; a text gets the language whose prototype
has the largest cosine with it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
GROUP = 1 << 19  # characters handled at once
BLOCK = 8192  # trigrams bound at once
PAIRS = 64  # vectors of single texts' trigrams that are added at once

_letters: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def _letter_vector(code: int) -> np.ndarray:
    v = _vectors.get(code)
    if v is None:
        if len(_vectors) > 1 << 15:
            _vectors.clear()
        v = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        _vectors[code] = v = v.astype(np.float32)
    return v


def _bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, given as three code points of 21 bits each."""
    out = np.empty((len(codes), DIM), dtype=np.float32)
    parts = [(codes >> 42), (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]
    for turn, part in enumerate(parts):
        used, where = np.unique(part, return_inverse=True)
        rows = np.stack([np.roll(_letter_vector(int(c)), 2 - turn) for c in used])[where]
        out = rows if not turn else out * rows
    return out


def text_vectors(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its bundled vector; all zero for a text without letters, which null counts as."""
    group, size = [], 0
    for text in texts:
        text = f" {(text or '').lower()} "
        if group and size + len(text) > GROUP:
            yield from _group_vectors(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield from _group_vectors(group)


def _group_vectors(group: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(group)), [len(x) for x in group])
    letter = _is_letter()[points]
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1]))
    points, owner, letter = points[keep], owner[keep], letter[keep]
    whole = (owner[2:] == owner[:-2]) & (letter[2:] | letter[1:-1] | letter[:-2])
    codes = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[whole]
    owners = owner[:-2][whole]
    out = np.zeros((len(group), DIM), dtype=np.float64)
    used, where = np.unique(codes, return_inverse=True)
    # Each text's different trigrams and how often it has them, in order of text within a block of trigrams.
    block = where // BLOCK
    cells, counts = np.unique((block * len(group) + owners) * BLOCK + where % BLOCK, return_counts=True)
    texts, columns, edges = cells // BLOCK % len(group), cells % BLOCK, np.searchsorted(cells, np.arange(len(used) // BLOCK + 2) * len(group) * BLOCK)
    for k, start in enumerate(range(0, len(used), BLOCK)):
        vectors, at = _bind(used[start : start + BLOCK]), slice(edges[k], edges[k + 1])
        rows, column, often = texts[at], columns[at], counts[at].astype(np.float32)
        own, first, place = np.unique(rows, return_index=True, return_inverse=True)
        if 30 * len(rows) > len(own) * len(vectors):  # dense enough for a product of matrices
            table = np.zeros((len(own), len(vectors)), dtype=np.float32)
            table[place, column] = often
            out[own] += table @ vectors
            continue
        for a in range(0, len(rows), PAIRS):
            b = min(a + PAIRS, len(rows))
            lo, hi = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, b)
            table = np.zeros((hi - lo, b - a), dtype=np.float32)
            table[place[a:b] - lo, np.arange(b - a)] = often[a:b]
            out[own[lo:hi]] += table @ vectors[column[a:b]]
    return out


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, v in zip(batch.column(0).to_pylist(), text_vectors(batch.column(1).to_pylist())):
            norm = np.linalg.norm(v)
            if norm:
                sums[lang] = sums.get(lang, 0) + v / norm
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("v").to_pylist())
    return pa.table({"lang": table.column("lang")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def learn_prototypes(docs: DataFrame, train: Column, per_lang: int = 2000) -> tuple[list[str], np.ndarray]:
    """Prototypes of all languages of ``docs`` (doc_id, text, lang) where ``train`` holds and lang isn't null.

    Fitted on a bounded sample: about ``per_lang`` texts of each language, those with the lowest hash of doc_id. What
    comes to the driver is a vector for each language."""
    known = docs.where(train & F.col("lang").isNotNull())
    counts = known.groupBy(F.col("lang").alias("l")).agg((F.lit(float(per_lang)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(F.broadcast(counts), (F.col("lang") == F.col("l")) & (draw < F.col("share")))
    rows = sample.select("lang", "text").mapInArrow(_bundle, "lang string, v binary").groupBy("lang").applyInArrow(_add, "lang string, v binary").collect()
    rows.sort(key=lambda r: r.lang)
    vectors = np.stack([np.frombuffer(r.v) for r in rows]) if rows else np.zeros((0, DIM))
    return [r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _predict(langs: list[str], prototypes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for v in text_vectors(batch.column(2).to_pylist()):
                norm = np.linalg.norm(v)
                if not norm or not langs:
                    found.append("und")
                    scores.append(0.0)
                    continue
                cosines = prototypes @ (v / norm)
                best = int(np.argmax(cosines))
                found.append(langs[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(column: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text has remainder 1 by 3; false without id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """Predicts the language of every text of ``docs`` (doc_id, text, lang; others are ignored).

    Learns from rows that aren't held out and have a lang. Returns doc_id, held_out, lang_pred and score (the cosine
    with the prototype, not below 0), a row for each row; any number of languages is learned. A null text or one without letters gets ``und`` and 0, as
    does every text if no row can be learned from. Ties go to the language that sorts first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, prototypes = learn_prototypes(docs, ~held_out(), per_lang)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(langs, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")
