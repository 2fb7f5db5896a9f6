import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from framelake.llm.mixing import mix_sources


def tables(path, spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    block = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(14))
    for k in range(160):
        bad = k % 4 == 0
        lines = [" ".join(rng.choice(words) + ("$$$" if bad else "") for _ in range(10)) for _ in range(rng.randrange(1, 8))]
        if k % 5 == 1:
            lines.append(block)
        rows.append((k, "\n".join(lines), "en", rng.choice(["a", "b", None]), 0, "extra"))
        labels.append((k, 0 if bad else 1, 0))
    rows += [(200 + k, " ".join(["new"] * k) + " " + rows[2][1].split("\n")[0], "en", "a", 0, None) for k in range(3)]
    rows += [(300, None, None, None, None, None), (301, "", None, "b", 0, None), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, removed_lines string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, results = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        results.append((docs, docs := spark.read.parquet(f"{tmp_path}/{name}")))
    kept = {r.doc_id for r in results[0][1].collect()}
    assert all((k in kept) == (k % 4 != 0) for k in range(160))
    before, after = ({r.doc_id: r for r in d.collect()} for d in results[1])
    assert all(after[k].n_chars == len(after[k].text) for k in after if after[k].text is not None)
    assert sum(len(r.text or "") for r in after.values()) < sum(len(r.text or "") for r in before.values())
    ids = Counter(r.doc_id for r in results[2][1].collect())
    assert max(ids.values()) == 1 and set(ids) <= set(after)
    mixed = Counter(r.doc_id for r in results[3][1].collect())
    assert mixed == {r.doc_id: r.copies for r in mix_sources(results[3][0]).collect() if r.copies and r.size}
    packed = results[4][1]
    assert packed.where("start = 0").count() == sum(mixed.values())


def test_near_duplicates_without_ids_and_with_clashing_columns(spark, tmp_path):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, f"{text} 1"), (3, f"{text} 2"), (None, f"{text} 3"), (None, "q r s t u v"), (None, "q r s t u v"), (None, None), (7, None), (7, ""), (9, "x y z"), (9, "other words"), (9, "x y z")]
    docs = spark.createDataFrame([(*r, k, k, k, k) for k, r in enumerate(rows)], "doc_id long, text string, _row int, _kept int, r int, i int")
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), str(tmp_path))
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert got == sorted([(3, f"{text} 2"), (None, "q r s t u v"), (None, None), (7, None), (7, ""), (9, "x y z"), (9, "other words")], key=repr)
    plain = docs.where("doc_id in (3, 5)")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, plain, str(tmp_path)).collect()] == [3]
    taken = corpus_pipeline.mixing(spark, docs.withColumn("source", docs.text).withColumn("_mix_id", docs.r), str(tmp_path))
    assert taken.count() >= 0 and "_mix_id" in taken.columns


def test_runs_in_threads(spark, tmp_path):
    """Two runs at a time in one session neither share nor delete each other's tables."""
    tables(tmp_path, spark)
    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(lambda _: corpus_pipeline.run(spark, str(tmp_path)), range(2)))
    rows = [sorted(map(tuple, r.collect()), key=repr) for r in results]
    assert rows[0] and len(rows[0]) == len(rows[1])


def test_run_and_empty_table(spark, tmp_path):
    tables(tmp_path, spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name in ("documents", "labels"):
        frame = spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0)
        frame.write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
