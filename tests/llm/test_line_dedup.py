import hashlib
import random

from framelake.llm import spread
from framelake.llm.line_dedup import AVERAGE, remove_repeated_chunks


def chunks(text):
    lines = text.split("\n")
    before, start, out = 0, 0, []
    for k, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        if (h * 31 + before) % (1 << 40) % AVERAGE == 0 or k == len(lines) - 1:
            out.append((start, lines[start : k + 1]))
            start = k + 1
        before = h
    return out


def brute(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        for start, lines in chunks(t):
            first.setdefault(tuple(lines), (i, start))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept, gone = [], []
        for start, lines in chunks(t):
            (gone if len(lines) > 1 and first[tuple(lines)] != (i, start) else kept).append(lines)
        out.append((i, "\n".join(x for c in kept for x in c), len(gone), sum(map(len, gone))))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(((r.doc_id, r.text, r.removed_chunks, r.removed_lines) for r in remove_repeated_chunks(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    shared = [[f"shared {k} {j}" for j in range(rng.randint(2, 12))] for k in range(4)]
    rows = [(100, None), (101, ""), (102, "\n\n\n"), (103, "x\r\ny"), (None, "a\nb\nc\nd\ne\nf")]
    for k in range(60):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 8))]
        for block in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = block
        rows.append((k, "\n".join(lines)))
    rows += [(70 + k, rows[-1][1]) for k in range(5)] + [(80, "a\nb\nc\nd\ne\nf"), (81, "same\n" * 500)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 100


def test_odd_tables(spark):
    assert run(spark, []) == []
    rows = [(1, "a\nb\nc\nd\ne", 9, 8, "z")] * 2 + [(2, "a\nb\nc\nd\ne", None, 1, None)]
    out = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id int, text string, hash int, start long, row string"))
    assert out.columns[:5] == ["doc_id", "text", "hash", "start", "row"]
    got = out.collect()
    assert sorted(r.removed_lines for r in got)[:2] == [0, 0] and len(got) == 3


def test_own_columns_keep_off_clashing_ones(spark, tmp_path):
    rows = [(1, "a\nb\nc\nd\ne", 7, "x"), (2, "a\nb\nc\nd\ne", 8, "y")]
    out = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string, removed_chunks int, Removed_Lines string"))
    assert out.columns == ["doc_id", "text", "removed_chunks", "Removed_Lines", "removed_chunks_", "removed_lines_"]
    out.write.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.removed_chunks, r.Removed_Lines) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 7, "x"), (2, 8, "y")]


def test_hot_chunks_and_many_nameless_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "SHARE", 5)
    rng = random.Random(6)
    block = "\n".join(f"hot {k}" for k in range(9))
    rows = [(k if k % 3 else None, "\n".join([f"own {k} {j}" for j in range(rng.randint(0, 5))] + [block] * (k % 2) + [f"end {k % 7}", f"last {k % 5}"])) for k in range(120)]
    assert run(spark, rows) == brute(rows)


def test_very_long_texts(spark):
    rows = [(1, "x" * 2_000_000), (2, "\n" * 200_000), (3, "\n".join(f"line {k}" for k in range(50_000)))]
    rows += [(4, rows[2][1])]
    assert run(spark, rows) == brute(rows)


def test_no_python_in_plan(spark, tmp_path):
    out = remove_repeated_chunks(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_take_one_line_chunks_along(spark):
    rng = random.Random(4)
    rows = [(k, "\n".join(f"own {k} {j}" for j in range(rng.randint(2, 14)))) for k in range(40)]
    rows += [(100 + k, t) for k, t in rows] + [(200, rows[0][1].split("\n")[0]), (201, None), (202, "")]
    assert any(len(lines) == 1 for _, t in rows[:40] for _, lines in chunks(t))
    out = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), runs=True)
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(got[k] == ("" if 100 <= k < 140 else t) for k, t in rows)


def test_runs_keep_each_line_once(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(f"line {rng.randint(0, 30)}" for _ in range(rng.randint(0, 12)))) for k in range(60)]
    first = {}
    for i, t in rows:
        for start, lines in chunks(t):
            first.setdefault(tuple(lines), (i, start))
    want = {}
    for i, t in rows:
        cut = chunks(t)
        again = [first[tuple(lines)] != (i, start) for start, lines in cut]
        kept = [lines for n, (_, lines) in enumerate(cut) if not (again[n] and (len(lines) > 1 or any(again[max(n - 1, 0) : n] + again[n + 1 : n + 2])))]
        want[i] = "\n".join(x for c in kept for x in c)
    out = remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), runs=True)
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert {x for t in want.values() for x in t.split("\n")} >= {x for _, t in rows for x in t.split("\n")} - {""}
