import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np

from framelake.llm import language_id, quality
from framelake.llm.language_id import identify_languages, text_vectors
from framelake.llm.quality import FEATURES, AdditiveModel, score_quality, text_features

WORDS = {"en": "the and of with that from this have which there", "de": "der und nicht mit über schön auch werden größer straße", "el": "και το να είναι στην από με για που δεν"}


def documents(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        rows.append((k, " ".join(w + "$$$" if bad else w for w in words), lang, 0 if bad else 1))
    return rows


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 3 == 1


def test_languages(spark):
    rows = documents()
    data = [(k, t, None if k % 11 == 0 else lang, 1) for k, t, lang, _ in rows] + [(9000, None, "en", 1), (9001, "", "en", 1), (9002, "12 3 !", None, 1), (None, "und nicht mit", None, 1)]
    out = {r.doc_id: r for r in identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string, held_out int")).collect()}
    assert len(out) == len(data)
    right = [out[k].lang_pred == lang for k, _, lang, _ in rows if held(k)]
    assert sum(right) >= 0.98 * len(right)
    assert all(out[k].held_out == held(k) for k in out)
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (9000, 9001, 9002))
    assert out[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())


def test_language_labels_of_held_out_rows_do_not_matter(spark):
    rows = documents(120)
    schema = "doc_id long, text string, lang string"
    a = identify_languages(spark.createDataFrame([(k, t, lang) for k, t, lang, _ in rows], schema)).collect()
    b = identify_languages(spark.createDataFrame([(k, t, "xx" if held(k) else lang) for k, t, lang, _ in rows], schema)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert identify_languages(spark.createDataFrame([], schema)).collect() == []
    assert [r.lang_pred for r in identify_languages(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == ["und"]


def test_vectors_bind_and_bundle():
    a, b, both, empty = text_vectors(["abc", "xyz", "abc xyz", None])
    assert not empty.any()
    cosine = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert abs(cosine(a, b)) < 0.15 < 0.5 < cosine(a, both)
    assert np.array_equal(next(text_vectors(["A-B,  c"])), next(text_vectors(["a b c"])))


def brute_vector(text):
    """Trigram by trigram, in the words of the method."""
    text = re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {(text or '').lower()} "))
    total = np.zeros(language_id.DIM)
    for k in range(len(text) - 2):
        if text[k : k + 3].strip():
            a, b, c = (language_id._letter_vector(ord(x)) for x in text[k : k + 3])
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_vectors_against_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklm  éß\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [None, "", "a", "..", "A b", "x" * 3000, "".join(rng.choice("abcdefg hijklmnopqrstuvwxyzéèà") for _ in range(9000))]
    for block in (8192, 100):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert all(np.array_equal(v, brute_vector(t)) for v, t in zip(text_vectors(texts), texts, strict=True))


def test_predictions_against_brute_force(spark):
    rows = documents(90, 5)
    schema = "doc_id long, text string, lang string"
    sums = {}
    for k, t, lang, _ in rows:
        if not held(k):
            v = brute_vector(t)
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    for parts in (1, 7):
        for r in identify_languages(spark.createDataFrame([r[:3] for r in rows], schema).repartition(parts)).collect():
            v = brute_vector(rows[r.doc_id][1])
            cosines = {lang: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for lang, p in sums.items()}
            assert r.lang_pred == max(sorted(cosines), key=cosines.get) and abs(r.score - max(0, cosines[r.lang_pred])) < 1e-9


def test_short_texts_take_bounded_time():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50)) for _ in range(10_000)]
    began = time.process_time()
    assert sum(1 for _ in text_vectors(texts)) == 10_000
    assert time.process_time() - began < 8


def test_any_number_of_languages_and_long_texts(spark):
    rows = [(k, chr(0x4E00 + k) * 3 + chr(0x4E00 + k + 1), f"l{k}") for k in range(0, 4000, 3)] + [(9001, "und nicht " * 200_000, "de"), (9003, " " * 1_000_000, None)]
    out = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows[:-2] if not held(k)) and out[9003].lang_pred == "und"


def brute_features(text):
    """Character by character and word by word."""
    text = text or ""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    is_letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 192
    is_symbol = lambda b: not (is_letter(b) or 48 <= b <= 57 or b in b"\t\n\x0b\x0c\r .,;:?'\"-()!" or b >= 128)
    lower = [w.lower() for w in words]
    letters, n = sum(map(is_letter, raw)), len(words)
    used, some = max(letters, 1), max(n, 1)
    return [
        sum(map(is_symbol, raw)) / used, sum(65 <= b <= 90 for b in raw) / used, sum(48 <= b <= 57 for b in raw) / used,
        sum(not any(map(is_letter, w)) for w in words) / some, sum(a == b for a, b in zip(lower, lower[1:])) / some, len(set(lower)) / some**0.8, letters / some,
        math.log1p(n), sum(b in b".,;:?" for b in raw) / some, sum(is_symbol(w[-1]) for w in words) / some, min(n / (text.count("\n") + 1), 1e4), raw.count(b"!") / some,
    ]


def test_features_against_brute_force():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "é É ß", "x" * 100_000] + ["".join(rng.choice("aAbB zZ 09.,;:?!'\"-()$%&é\n\t中") for _ in range(rng.randrange(200))) for _ in range(200)]
    assert np.allclose(text_features(texts), [brute_features(t) for t in texts], rtol=1e-12, atol=0)


def test_scores_against_brute_force(spark):
    """One by one through the learned tables; the same for every partitioning, and with repeated ids."""
    rows = documents(200, 7)
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows] + [(3, "other text"), (3, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, _, q in rows] + [(6, 0)] * 3, "doc_id long, quality int")
    model = quality.fit_quality(docs.repartition(7), labels)
    for r in score_quality(docs.repartition(3), labels).where("doc_id != 3").collect():
        f = brute_features(rows[r.doc_id][1])
        bins = [sum(edge <= x for edge in edges) for x, edges in zip(f, model.edges)]
        total = model.intercept + sum(table[b] for table, b in zip(model.tables, bins)) + sum(table[bins[i], bins[j]] for i, j, table in model.pairs)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-6


def test_quality(spark):
    rows = documents()
    docs = spark.createDataFrame([(k, t, 5) for k, t, _, _ in rows] + [(9000, None, 5), (None, "", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, q if not held(k) else 1 - q, "x") for k, _, _, q in rows] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    out = {r.doc_id: r for r in score_quality(docs, labels, keep=("score",)).collect()}
    assert all(r.row.score == 5 for r in out.values())
    assert len(out) == len(rows) + 2
    right = [out[k].predicted == q for k, _, _, q in rows if held(k)]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in out.values())


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r.score for r in none] == [0.5, 0.5]
    one = score_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r.predicted == 1 for r in one.collect())
    assert score_quality(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_features_and_interactions():
    f = dict(zip(FEATURES, text_features(["A a a b! $$$"])[0]))
    assert f["repeats"] == 0.4 and f["symbols"] == 0.75 and f["bare_words"] == 0.2 and f["upper"] == 0.25
    assert not text_features([None, ""])[:, :4].any()
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
