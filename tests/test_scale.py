"""What only shows on larger tables or other batches than those of the driver's small ones."""

import re
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from framelake.functions import display as D
from framelake.model import KERNEL_FIELD
from framelake.operators import layouts, parsing
from framelake.operators.registry import run_kernel
from framelake.plans import blobs
from framelake.sinks import exporters
from tests.test_kernels import SAMPLES


def test_years_of_more_than_four_digits(spark):
    rows = spark.createDataFrame([(2082844801,), (2082844800 + 253402300800,), (2082844800 + 777600000000,), (0,)], "s long")
    assert [r[0] for r in rows.select(D.mp4_date(F.col("s"))).collect()] == ["1970-01-01 00:00:01 UTC", "10000-01-01 00:00:00 UTC", "26611-03-02 00:00:00 UTC", None]
    assert rows.select(D.local_text(F.lit(253402300800), -1)).first()[0] == "9999-12-31 23:59:59"


def wav(tag=1, channels=2, rate=44100, bits=16, samples=1000, align=None):
    align = channels * bits // 8 if align is None else align
    data = bytes(samples * max(align, 1))
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", len(data)) + data


def surely(*found):
    """Results for blobs, as the query's step hands them over: of WAV files the first 44 bytes."""
    heads = [b[:44] if b is not None and b[:4] == b"RIFF" else b for b in found]
    return parsing._surely(pa.array(heads, pa.binary()), pa.array([len(b) if b is not None else None for b in found], pa.int32())).to_pylist()


def test_plain_wav_files_are_read_from_their_heads():
    whole = [wav(), wav(), wav(3, bits=32), wav(6, 1, 8000, 8), wav(1, 1, 8000, 8), wav(0xFFFE), wav(99), wav(rate=0), wav(align=0), wav(samples=0)]
    for blob, made in zip(whole, surely(*whole), strict=True):
        fields, cut = run_kernel("wav", blob)
        assert made["parser"] == "wav" and not cut and {tuple(f.values()) for f in made["fields"]} == set(fields)
    assert [x["parser"] for x in surely(wav()[:-1], wav() + b"x", None, wav())] == [None, None, None, "wav"]


def test_sure_fronts_are_read_as_by_their_kernels():
    png, flac = SAMPLES["png"][0], SAMPLES["flac"][0]
    for name, blob in (("png", png), ("flac", flac)):
        made = surely(blob, None, blob)
        assert [m["parser"] for m in made] == [name, None, name]
        assert [tuple(f.values()) for f in made[2]["fields"]] == run_kernel(name, blob)[0]
    # The gate of MXF stands before that of PNG, so such a blob has to pass all gates.
    assert surely(png + b"\x06\x0e\x2b\x34")[0]["parser"] is None


def test_documents_by_shape_equal_those_made_one_by_one():
    field = lambda kind, pos, name, value, extra=False: {"kind_id": kind, "pos": pos, "name": name, "value": value, "is_extra": extra}
    odd = ['a"b', "x,y", "l\nm", "<&>'", "\b\f\t", "", "é", "1500", "-20", "1.778", "en", "1"]
    files = [[field(0, 0, "Format", v), field(0, 0, "Format", "again"), field(0, 0, "FileSize", "4000"), field(2, 1, "StreamSize", str(k * 100)), field(2, 0, "Duration", v), field(2, 0, "Language", v), field(1, 0, "FrameRate", v), field(1, 0, "Width", "640"), field(1, 0, "Height", str(k)), field(5, 0, "Width", str(k)), field(5, 0, "Height", v), field(2, 0, "MD5_Unencoded", v), field(7, 0, "Make", v, True)] for k, v in enumerate(odd)]
    files += [[field(2, 0, "StreamSize", str(k)), field(0, 0, "CompleteName", "c"), field(2, 0, "SamplingRate", "44100"), field(2, 0, "DisplayAspectRatio", "1.778")] for k in range(20)] + [[]]
    paths = [p for p in (*odd, *map(str, range(20)), None)]
    for files_, paths_ in ((files, paths), ([f for f, v in zip(files, [*odd, *[""] * 21]) if "" not in v], [p for p in paths if not p or "" not in p])):
        rows = pa.array(files_, pa.list_(parsing._FIELD))
        for form, make in exporters.FORMS.items():
            alone = [make(exporters.Media(p or "", f)) for p, f in zip(paths_, files_, strict=True)]
            assert exporters._documents(form, pa.array(paths_, pa.string()), rows).to_pylist() == alone, form
            assert exporters._documents(form, pa.array(paths_, pa.string())[3:], rows[3:]).to_pylist() == alone[3:], form


def test_a_shape_is_rendered_once(monkeypatch):
    made = []
    monkeypatch.setitem(exporters.FORMS, "json", lambda m: made.append(m) or exporters.to_json(m))
    rows = pa.array([[{"kind_id": 0, "pos": 0, "name": "Format", "value": str(k), "is_extra": False}] for k in range(500)], pa.list_(parsing._FIELD))
    assert len(set(exporters._documents("json", pa.array(map(str, range(500))), rows).to_pylist())) == 500
    assert len(made) == 1


def test_planted_blobs_are_dealt_out(spark):
    part = spark.range(100).coalesce(1).select(F.col("id").alias("p_partkey"))
    assert blobs.planted_blobs(part, ["00", "01"]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_plain_pcm_is_read_without_python(spark):
    odd = [wav(), wav(channels=1, rate=8000, bits=8), wav(samples=0), wav(bits=24), wav(rate=0xFFFFFFFF, align=1), wav(channels=255, bits=255, rate=1, samples=3), wav(align=1, samples=45)]
    others = [wav(3, bits=32), wav(rate=0), wav(align=0), wav(channels=0), wav(bits=0), wav(channels=256, bits=256, rate=0xFFFFFFFF, samples=0, align=1), wav()[:-1], wav() + b"x", wav()[:44], wav()[:43], b"RIFF", b"", None]
    rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate([*odd, *others])], "path int, content binary")
    told = rows.select("path", "content", layouts.turned_pcm(layouts.plain_pcm(F.col("content"))).alias("told")).select("path", layouts.settled_pcm(F.col("told"), F.octet_length("content")).alias("told"))
    found = {r["path"]: r["fields"] for r in told.select("path", F.when(F.col("told").isNotNull(), layouts.pcm_fields(F.col("told"))).alias("fields")).collect()}
    for k, blob in enumerate(odd):
        assert [tuple(f) for f in found[k]] == layouts.plain_wav_fields(blob[:44], len(blob)), k
    assert [found[k] for k in range(len(odd), len(odd) + len(others))] == [None] * len(others)
    assert parsing._surely(pa.nulls(3, pa.binary()), pa.array([1, 2, 3], pa.int32())).null_count == 3


def test_wav_blobs_are_whole(spark):
    rows = [(k, k % 4, k + 7, 3, float(k % 51)) for k in range(200)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    made = {r["path"]: bytes(r["content"]) for r in blobs.wav_blobs(lines).collect()}
    assert made == {f"wav/{o}/{n}/{p}/{s}/{int(q)}": wav(channels=n % 2 + 1, rate=blobs.RATES[o % 3], samples=int(q)) for o, n, p, s, q in rows}


def test_no_step_of_parsing_is_too_long_to_be_compiled(spark):
    # HotSpot interprets methods of more than 8000 bytes of bytecode.
    rows = parsing.parsed(spark.createDataFrame([("a", bytearray(wav()))], "path string, content binary"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", rows._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_documents_of_plain_wav_files_equal_those_made_one_by_one(spark):
    paths = ["a/b 1.wav", "é", 'q"', "x,y", "l\nm", "<&>'", "back\\slash", "", None, "", "z"]
    heads = [{"channels": c, "rate": r, "align": 2 * c, "bits": b, "size": s, "riff": s + 36} for c, r, b, s in ((1, 8000, 8, 0), (2, 44100, 16, 400), (255, 1, 255, 1 << 31), (6, 192000, 24, 7_000_001), (2, 7, 16, 12345))]
    rows = [(p, h, None) for p in paths for h in heads] + [("own", None, [(0, 0, "Format", "Other", False)]), (None, None, [(0, 0, "Format", "Other", False)]), ("none", None, None)]
    files = spark.createDataFrame(rows, f"path string, pcm {parsing._TOLD['wav']}, fields array<{KERNEL_FIELD}>").coalesce(1)
    told = [r["f"] for r in files.select(F.coalesce("fields", F.when(F.col("pcm").isNotNull(), layouts.pcm_fields(F.col("pcm")))).alias("f")).collect()]
    for form, make in exporters.FORMS.items():
        alone = [(p, make(exporters.Media(p or "", [x.asDict() for x in f]))) for (p, _, _), f in zip(rows, told) if f is not None]
        assert [tuple(r) for r in exporters.export(files, form).collect()] == alone, form


def test_plain_png_and_flac_files_are_read_without_python(spark):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
    png = lambda *more, w=640, h=480, c=2: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBB3x", w, h, 8, c)) + b"".join(more)
    end = chunk(b"IEND", b"")
    flac = lambda more=b"", head=b"\x80\0\0\x22", rate=44100, c=1, n=1000, least=0, most=0, md5=bytes(16): b"fLaC" + head + bytes(4) + least.to_bytes(3, "big") + most.to_bytes(3, "big") + (rate << 44 | c << 41 | 15 << 36 | n).to_bytes(8, "big") + md5 + more
    plain = {
        "png": [png(end), png(end, w=0, c=7), png(end, h=0), png(end, w=0xFFFFFFFF, h=3), png(chunk(b"IDAT", b"x" * 99), end), *[png(end, c=c) for c in (0, 3, 4, 6)]],
        "flac": [flac(), flac(b"audio" * 99), flac(rate=0), flac(n=0), flac(least=5, most=5), flac(most=5), flac(md5=bytes(range(16))), flac(rate=(1 << 20) - 1, c=7, n=(1 << 36) - 1)],
    }
    others = {
        "png": [png(chunk(b"tEXt", b"Title\0a"), end), png(chunk(b"IDAT", b"x"), chunk(b"IDAT", b"y"), end), png(chunk(b"IDAT", b"8BIM\4\4"), end), png(end, w=0x060E2B34), png(), png()[:28], png(struct.pack(">I", 0xFFFFFFF0) + b"IDATabc"), b"", None],
        "flac": [flac()[:41], flac(head=b"\0\0\0\x22", more=b"\x84\0\0\0"), flac(b"x" * 99 + b"TAG" + bytes(125)), flac(b"x" * 99 + b"APETAGEX" + bytes(24)), b"fLaC", None],
    }
    for name, told, fields in (("png", layouts.plain_png, layouts.png_fields), ("flac", layouts.plain_flac, layouts.flac_fields)):
        rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(plain[name] + others[name])], "path int, content binary")
        seen = rows.select("path", "content", told(F.col("content")).alias("told"))
        found = [r["fields"] for r in seen.select("path", F.when(F.col("told").isNotNull(), fields(F.col("told"))).alias("fields")).orderBy("path").collect()]
        assert [[tuple(f) for f in x] for x in found[: len(plain[name])]] == [run_kernel(name, b)[0] for b in plain[name]]
        assert not any(run_kernel(name, b)[1] for b in plain[name])
        assert found[len(plain[name]) :] == [None] * len(others[name])


def test_only_documents_asked_for_are_made():
    rows = pa.array([[], [{"kind_id": 0, "pos": 0, "name": "Format", "value": "A", "is_extra": False}], [], []], pa.list_(parsing._FIELD))
    made = exporters._asked("graph", pa.array([False, True, False, True]), pa.array([None, "a", None, "b"], pa.string()), rows).to_pylist()
    assert [m is not None for m in made] == [False, True, False, True] and "Format" in made[1]
    assert exporters._asked("graph", pa.array([False] * 4), pa.array([None] * 4, pa.string()), rows).null_count == 4
