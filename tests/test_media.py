import json

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.operators import derived, diffing, streams
from framelake.operators.detection import detected
from framelake.operators.parsing import parse, parsed
from framelake.plans import queries
from framelake.sinks.exporters import FORMS, Media, export
from framelake.sources import media
from framelake.streaming import ingest
from tests.test_kernels import SAMPLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    relation = duck.sql(queries.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in relation.fetchall()), key=repr)
    assert ours == theirs


def blobs(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")


# What each policy calls samples that an earlier gate accepts as well, or that only a direct call reads.
SHADOWED = {
    "aac_adts": ("vp8", "aac_adts"),
    "vvc": ("gain_map", "vvc"),
    "vp8": ("vp8", None),
    "vp9": ("vp8", "vp9"),
    "theora": ("vp8", "theora"),
    "prores": ("gain_map", "prores"),
    "vc3": ("rle", "vc3"),
    "dolby_vision": ("rle", "dolby_vision"),
    "tar": ("rle", "tar"),
    "mz_exe": ("rle", "mz_exe"),
    "mach_o": ("vp8", "mach_o"),
    "iamf": ("vp8", "iamf"),
    "ac4": ("vp8", "ac4"),
    "dat": ("dat", None),
    "usac": ("rle", "aac"),
    "pcm": ("rle", "pcm"),
    "aac": ("rle", "aac"),
    "adm": ("rle", None),
    "pcm_vob": ("rle", None),
    "gain_map": ("gain_map", None),
    "timed_text": ("rle", None),
}


def test_detection_policies(spark):
    rows = [(n, SAMPLES[n][0]) for n in SAMPLES] + [("empty", b""), ("null", None), ("prose", b"Just some prose."), ("high", "Écrit en français".encode()), ("zip", b"PK\x03\x04" + bytes(30)), ("amv", b"RIFF\0\0\0\0AMV " + bytes(20)), ("srt", b"\xef\xbb\xbf1\r\n00:00:01,000 --> 00:00:02,000\r\nHi")]
    compat = {r.path: r.parser for r in detected(blobs(spark, rows)).collect()}
    sane = {r.path: r.parser for r in detected(blobs(spark, rows), "sane").collect()}
    assert {n: compat[n] for n in SAMPLES} == {n: SHADOWED.get(n, (n, n))[0] for n in SAMPLES}
    assert {n: sane[n] for n in SAMPLES} == {n: SHADOWED.get(n, (n, n))[1] for n in SAMPLES}
    assert [compat[n] for n in ("empty", "null", "prose", "high", "zip", "amv", "srt")] == [None, None, "rle", "vp8", "rle", "amv", "sub_rip"]
    assert [sane[n] for n in ("empty", "null", "prose", "high", "zip", "amv", "srt")] == [None, None, None, None, "zip", "amv", "sub_rip"]


def test_parse_mixed_blobs(spark):
    rows = [(n, d) for n, (d, _) in SAMPLES.items() if n not in SHADOWED]
    rows += [("gif", b"GIF89a" + bytes.fromhex("8007 3804") + b"\0\0\0"), ("prose", b"Just some prose."), ("null", None), ("bad", b"RIFF\x04\0\0\0WAVE")]
    fields = parse(blobs(spark, rows)).collect()
    by = {}
    for r in fields:
        by.setdefault(r.path, {})[r.kind_id, r.pos, r.name] = r.value
    for n, (_, want) in ((n, SAMPLES[n]) for n in SAMPLES if n in by):
        assert {k: by[n].get(k) for k in want} == want
    assert by["gif"][5, 0, "DisplayAspectRatio"] == "1.778" and by["prose"] == {(0, 0, "Format"): "RLE", (3, 0, "Format"): "RLE", (3, 0, "Codec"): "RLE"}
    assert by["bad"][0, 0, "Format"] == "RLE"  # its own parser rejects it, so it falls to the next gate
    assert {n for n, _ in rows} - set(by) == {"null"}
    why = {r.path: (r.parser, r.truncated, r.error) for r in parsed(blobs(spark, rows + [("cut", SAMPLES["wav"][0][:3000])]), "sane").collect()}
    assert why["null"] == (None, False, "no content") and why["bad"] == (None, False, "no parser accepts the blob") and why["prose"][2] and why["wav"] == ("wav", False, None) and why["cut"] == ("wav", True, None)
    direct = parse(blobs(spark, [("z", b"PK\x03\x04\x14\0\0\0\x08\0" + bytes(20))]), parser="zip").collect()
    assert [(r.name, r.value) for r in direct] == [("Format", "ZIP"), ("Format_Compression", "Deflate")]
    assert parse(blobs(spark, []), parser="nothing").collect() == []


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, kind_id int, kind string, pos int, name string, value string, is_extra boolean, ord int")


def test_stream_operators(spark):
    rows = [("a", 0, "General", 0, "Format", "MP4", False, 0), ("a", 0, "General", 0, "Format", "MOV", False, 1), ("a", 2, "Audio", 2, "Format", "AAC", False, 2), ("a", 2, "Audio", 0, "Encoded_Application", "x", True, 3), ("a", 1, "Video", 0, "Width", "9", False, 4)]
    t = table(spark, rows)
    assert streams.first_write_wins(t).where("name = 'Format' and pos = 0").first().value == "MP4"
    forced = streams.last_write_wins(t).where("name = 'Format' and pos = 0").first()
    assert (forced.value, forced.ord) == ("MOV", 0)
    assert {(r.kind, r.streams) for r in streams.stream_counts(t).collect()} == {("General", 1), ("Audio", 3), ("Video", 1)}
    kept = streams.filter_keep(t, *streams.selection(audio_only=True, streams=("Audio:2",))).collect()
    assert {(r.kind, r.pos) for r in kept} == {("General", 0), ("Audio", 0)}
    assert streams.selection(streams=("Video:0",), compat=True) == (("General",), (("Video", 0),))
    wide = streams.streams_wide(streams.first_write_wins(t))
    found = {(r.kind, r.pos): r.value for r in streams.lookup_field(wide, "WritingApplication").collect()}
    assert found["Audio", 0] == "x" and found["General", 0] is None
    view = streams.typed_view(t, "Video", {"Width": "long", "Height": "long"}).first()
    assert (view.Width, view.Height) == (9, None)
    done = streams.verify(spark.createDataFrame([("a", True), ("b", False)], "path string, truncated boolean")).collect()
    assert [(r.IsComplete, r.Warning is None) for r in done] == [("No", False), ("Yes", True)]


def test_derived(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(derived.format_profile(F.lit("MPEG-4"), F.lit("mp42"))) == "Base Media / Version 2"
    assert one(derived.lowest_bitrate(F.lit("1001"))) == 500
    assert one(derived.inferred_av1_level(F.lit("Main@L8"), F.lit(1920), F.lit(1080), F.lit(30))) == "4.0"
    assert one(derived.inferred_av1_level(F.lit("Main"), F.lit(1920), F.lit(1080), F.lit(30))) is None


def test_exporters(spark):
    rows = [("f<1>", 0, "General", 0, "Format", "MPEG-4", False, 0), ("f<1>", 0, "General", 0, "Duration", "60095", False, 1), ("f<1>", 0, "General", 0, "Own", 'a,"b"', False, 2), ("f<1>", 0, "General", 0, "note", "n", True, 3)]
    rows += [("f<1>", 2, "Audio", k, "Format", v, False, 0) for k, v in enumerate(("AAC", "AC3"))] + [("f<1>", 2, "Audio", 1, "Channels", "6", False, 1)]
    made = {f: export(table(spark, rows), f).first().document for f in FORMS}
    media_ = json.loads(made["json"])["media"]
    assert media_["track"][0] == {"@type": "General", "Format": "MPEG-4", "Duration": "60.095", "Own": 'a,"b"', "extra": {"note": "n"}} and [t["@type"] for t in media_["track"]] == ["General", "Audio", "Audio"]
    assert '<media ref="f&lt;1>">' in made["xml"] and '<track type="Audio" typeorder="2">\n<Format>AC3</Format>\n<Channels>6</Channels>\n</track>' in made["xml"] and "<extra>\n<note>n</note>\n</extra>" in made["xml"]
    assert made["csv"] == '# f<1>\n# General\nStreamIndex,Format,Duration,Own,note\n0,MPEG-4,60095,"a,""b""",n\n\n# Audio\nStreamIndex,Format,Channels\n0,AAC,\n1,AC3,6\n\n'
    assert f"{'Duration':<41}: 1 min 0 s\n" in made["text"] and "Audio #2\n" in made["text"] and "Own" not in made["text"]
    assert "Streams: 0 video, 2 audio, 0 text, 0 image" in made["summary"] and "Duration: 1 m 0 s" in made["summary"]
    assert '"Audio" [shape=box]' in made["graph"] and all("AC3" in made[f] for f in FORMS if f != "graph")
    assert FORMS["json"](Media("", [])) == '{\n"media":{"@ref":"","track":[]}\n}\n'
    with pytest.raises(ValueError):
        export(table(spark, rows), "yaml")


def test_sources_and_streaming(spark, tmp_path):
    for name, data in (("m.wav", SAMPLES["wav"][0][:5000]), ("m.srt", b"1\n00:00:01,000 --> 00:00:02,000\nHi"), ("n.png", SAMPLES["png"][0])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    files = media.name_parts(media.read_files(spark, f"{tmp_path}/in"))
    assert {(r.stem, r.extension) for r in files.collect()} == {("m", "wav"), ("m", "srt"), ("n", "png")}
    joined = media.concatenated(files.where("extension = 'wav'"), media.sidecars(files)).first()
    assert bytes(joined.content).endswith(b"Hi") and len(joined.content) == 5000 + len(b"1\n00:00:01,000 --> 00:00:02,000\nHi")
    query = ingest.ingest(ingest.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    batch = parse(media.read_files(spark, f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert media.options(Trace_Level="1") == {"tracelevel": "1"}
    with pytest.raises(ValueError):
        media.options(nope="1")


def test_diffing(spark):
    a, b = (spark.createDataFrame([("p", t)], "path string, text string") for t in ("x\ny\ny", "y\nz"))
    assert sorted((r.line, r.n) for r in diffing.line_differences(a, b).collect()) == [("x", 1), ("y", 2)]


def test_export_queries_cover_every_row(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey <= 4")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows.where("l_linenumber > 1").count()
    for form in FORMS:
        made = queries.QUERIES[f"export_{form}"](spark, str(tmp_path))
        assert made.count() == made.select("path").distinct().count() == rows.count()
