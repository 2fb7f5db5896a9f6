import os
import struct

import pytest

from pyspark.sql import functions as F

from framelake import api
from framelake.functions import pcm
from framelake.operators import kernels, kernels_tags
from framelake.operators.kernels import Found
from framelake.operators.parsing import parsed
from framelake.operators.registry import run_kernel
from framelake.sources.ranged import BUDGET, Ranged, parse_paths
from tests.test_kernels import SAMPLES, box, jpeg, mp4, wav


def sparse(path, head, size, tail=b""):
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(size - len(tail))
        f.seek(0, 2)
        f.write(tail)


def film(size, front):
    """An MP4 file of ``size`` bytes, nearly all of it samples, with its tables at the front or at the end."""
    whole = mp4()
    ftyp, moov = whole[: whole.index(b"moov") - 4], whole[whole.index(b"moov") - 4 : whole.index(b"mdat") - 4]
    rest = size - len(ftyp) - len(moov)
    head = struct.pack(">I", rest) + b"mdat"
    return (ftyp + moov + head, b"") if front else (ftyp + head, moov)


@pytest.mark.parametrize("front", (True, False))
def test_few_bytes_of_a_large_film_are_read(spark, tmp_path, front):
    size = 389 << 20
    head, tail = film(size, front)
    path = tmp_path / "film.mp4"
    sparse(path, head, size, tail)
    assert os.path.getsize(path) == size
    with open(path, "rb") as f:
        source = Ranged(f, size)
        rows, _ = run_kernel("mp4", source)
    assert source.requested < BUDGET and source.largest <= 256 << 10 and not source.short
    assert {(k, n): v for k, p, n, v, _ in rows}[1, "Width"] == "1280"
    r = parse_paths(spark, f"file://{path}").first()
    assert r.parser == "mp4" and r.bytes_read < 2 << 20 and not r.truncated and r.error is None
    assert {(x.kind_id, x.name): x.value for x in r.fields}[0, "IsStreamable"] == ("Yes" if front else "No")


@pytest.mark.parametrize("parser", ("wav", "aiff", "flac", "mkv", "ogg", "mp3", "mpeg_ts", "mpeg_ps", "avi"))
def test_budget_of_other_containers(tmp_path, parser):
    path = tmp_path / "large"
    sparse(path, SAMPLES[parser][0], 100 << 20)
    with open(path, "rb") as f:
        source = Ranged(f, 100 << 20)
        run_kernel(parser, source)
    assert source.requested <= BUDGET


@pytest.mark.parametrize("parser", sorted(SAMPLES))
def test_ranged_reads_give_the_same_fields(tmp_path, parser):
    path = tmp_path / "blob"
    path.write_bytes(SAMPLES[parser][0])
    with open(path, "rb") as f:
        assert run_kernel(parser, Ranged(f, len(SAMPLES[parser][0]), block=64)) == run_kernel(parser, SAMPLES[parser][0])


def test_small_files_and_missing_ones(spark, tmp_path):
    for name in ("wav", "flac", "png"):
        (tmp_path / f"x.{name}").write_bytes(SAMPLES[name][0])
    (tmp_path / "x.txt").write_text("prose")
    got = {os.path.basename(r.path): r for r in parse_paths(spark, str(tmp_path), policy="sane").collect()}
    assert {n: r.parser for n, r in got.items()} == {"x.wav": "wav", "x.flac": "flac", "x.png": "png", "x.txt": None}
    assert got["x.txt"].error and got["x.wav"].bytes_read == len(SAMPLES["wav"][0])


def test_front(spark, tmp_path, capsys):
    (tmp_path / "a.wav").write_bytes(wav())
    (tmp_path / "b.wav").write_bytes(wav()[:3000])
    rows = api.read(spark, str(tmp_path))
    by = {os.path.basename(r.path): {(x.kind_id, x.name): x.value for x in r.fields} for r in rows.collect()}
    assert by["a.wav"][0, "FileSize"] == str(len(wav())) and by["a.wav"][0, "OverallBitRate"] and by["a.wav"][0, "StreamSize"] == "44"
    assert {os.path.basename(r.path): (r.IsComplete, r.Warning) for r in api.verify(rows).collect()} == {"a.wav": ("Yes", None), "b.wav": ("No", "File appears truncated")}
    assert api.inform(rows, "json").count() == 2 and api.fields(rows).where("name = 'FileSize'").count() == 2
    api.register(spark)
    spark.createDataFrame([(bytearray(wav()),), (bytearray(b"prose"),), (None,)], "content binary").createOrReplaceTempView("blobs")
    assert sorted((r.f or "" for r in spark.sql("select media_format(content) as f from blobs").collect())) == ["", "", "Wave"]
    assert spark.sql("select f.value from blobs, lateral media_fields(content) f where f.name = 'SamplingRate'").first().value == "44100"
    assert api.main(["--form", "csv", str(tmp_path / "a.wav")]) == 0
    assert "SamplingRate" in capsys.readouterr().out


def test_companions(spark, tmp_path):
    for name, body in (("a.wav", wav()), ("a.srt", b"1"), ("a.sub", b"23"), ("b.wav", wav()), ("c.srt", b"9")):
        (tmp_path / name).write_bytes(body)
    sizes = {os.path.basename(r.path): r.length for r in api.read(spark, str(tmp_path), MultiFile="1").collect()}
    assert sizes == {"a.wav": len(wav()) + 3, "b.wav": len(wav())}
    assert {r.length for r in api.read(spark, str(tmp_path), multifile="1", multifile_max="1").collect()} == {len(wav()) + 1, len(wav())}
    with pytest.raises(ValueError):
        api.read(spark, str(tmp_path), nothing="1")


def found(read, data):
    f = Found()
    assert read(data, f)
    return {(k, n): v for (k, p, n, e), v in f.rows.items()}


def test_tags():
    id3 = b"ID3\3\0\0" + bytes([0, 0, 0, 60]) + b"TIT2" + struct.pack(">IH", 5, 0) + b"\0Song" + b"TCON" + struct.pack(">IH", 5, 0) + b"\0(17)" + b"COMM" + struct.pack(">IH", 8, 0) + b"\0engx\0Hi" + bytes(13)
    assert found(kernels_tags.id3v2, id3) == {(0, "Title"): "Song", (0, "Genre"): "Rock", (0, "Comment"): "Hi"}
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"LP".ljust(30, b"\0") + b"1999" + bytes(29) + b"\7" + bytes([8])
    assert found(kernels_tags.id3v1, bytes(100) + old) == {(0, "Title"): "Song", (0, "Performer"): "Who", (0, "Album"): "LP", (0, "Recorded_Date"): "1999", (0, "Genre"): "Jazz", (0, "Track/Position"): "7"}
    items = b"".join(struct.pack("<II", len(v), 0) + k + b"\0" + v for k, v in ((b"Title", b"Song"), (b"Mood", b"calm")))
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 2, 0) + bytes(8)
    assert found(kernels_tags.ape_tag, bytes(50) + items + foot + old) == {(0, "Title"): "Song", (0, "Mood"): "calm"}
    packet = b'xx<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="5"><dc:title><rdf:Alt><rdf:li>A &amp; B</rdf:li></rdf:Alt></dc:title><xmpMM:DocumentID>id1</xmpMM:DocumentID></rdf:Description></rdf:RDF></x:xmpmeta>'
    assert found(kernels_tags.xmp, packet) == {(9, "XMP_xmp_Rating"): "5", (9, "XMP_dc_title"): "A & B", (9, "XMP_xmpMM_DocumentID"): "id1"}
    records = b"".join(b"\x1c\2" + bytes([k]) + struct.pack(">H", len(v)) + v for k, v in ((5, b"Name"), (25, b"one"), (25, b"two")))
    assert found(kernels_tags.iptc, b"Photoshop 3.0\x008BIM\4\4\0\0" + struct.pack(">I", len(records)) + records) == {(8, "ObjectName"): "Name", (8, "Keywords"): "one / two"}
    profile = bytearray(128)
    profile[:4], profile[8:10], profile[12:16], profile[16:20], profile[24:36], profile[36:40] = struct.pack(">I", 128), b"\4\x30", b"mntr", b"RGB ", struct.pack(">6H", 2020, 1, 2, 3, 4, 5), b"acsp"
    got = found(kernels_tags.icc, b"junk" + bytes(profile))
    assert got[10, "ProfileVersion"] == "4.3.0" and got[10, "ProfileClass"] == "Display Device Profile" and got[10, "ProfileDateTime"] == "2020:01:02 03:04:05"
    assert found(kernels_tags.c2pa, b"jumbxx c2pa.claim yy") == {(11, "Present"): "Yes", (11, "Labels"): "c2pa.claim"}
    assert found(kernels_tags.property_list, b"<plist><dict><key>a</key><string>b</string></dict></plist>") == {(0, "a"): "b"}
    for read in kernels_tags.READERS.values():
        assert not read(b"", Found()) and not read(b"plain text that is nothing", Found())


def test_tags_stand_in_streams_of_their_own(spark):
    packet = b'<x:xmpmeta><rdf:Description xmp:Rating="5"/></x:xmpmeta>'
    picture = jpeg()[:2] + b"\xff\xe1" + struct.pack(">H", len(packet) + 31) + b"http://ns.adobe.com/xap/1.0/\0" + packet + jpeg()[2:]
    rows = parsed(spark.createDataFrame([("a", bytearray(picture))], "path string, content binary")).first().fields
    assert {(r.kind_id, r.name): r.value for r in rows}[9, "XMP_xmp_Rating"] == "5"


def test_mp4_tags_and_configurations():
    data = lambda v: box(b"data", b"\0\0\0\1\0\0\0\0", v)
    ilst = box(b"ilst", box(b"\xa9nam", data(b"Film")), box(b"trkn", data(struct.pack(">4H", 0, 3, 9, 0))), box(b"cpil", data(b"\1")), box(b"stik", data(b"\x09")))
    whole = mp4()
    at = whole.index(b"moov") - 4
    size = struct.unpack(">I", whole[at : at + 4])[0]
    extra = box(b"udta", box(b"meta", bytes(4), ilst))
    changed = whole[:at] + struct.pack(">I", size + len(extra)) + whole[at + 4 : at + size] + extra + whole[at + size :]
    got = {(k, n): v for k, p, n, v, _ in run_kernel("mp4", changed)[0]}
    assert got[0, "Title"] == "Film" and got[0, "Track"] == "3" and got[0, "Track/Total"] == "9" and got[0, "Compilation"] == "Yes" and got[0, "MediaType"] == "Movie"
    assert run_kernel("mp4", whole[:-100])[1] and not run_kernel("mp4", whole)[1]


def test_computed_fields(spark):
    rows = spark.createDataFrame([("a", bytearray(SAMPLES["mp4"][0])), ("b", bytearray(wav())), ("c", bytearray(b"x"))], "path string, content binary")
    by = {r.path: {(x.kind_id, x.name): x.value for x in r.fields or []} for r in api.parse(rows, "sane").collect()}
    video = by["a"]
    assert video[1, "Bits_Pixel_Frame"] == "0.002" and video[1, "BitRate_Minimum"] == "1200" and video[0, "OverallBitRate_Minimum"] == "2400" and by["c"] == {}
    assert by["b"][2, "BitRate_Minimum"] == "705600"


def test_channel_pairs_and_spans(spark):
    data = bytes(range(30)) + b"x"
    assert pcm.split_pairs(data, 3, 2) == [b"".join(data[k : k + 4] for k in range(0, 30, 6)), b"".join(data[k + 4 : k + 6] for k in range(0, 30, 6))]
    assert pcm.group_pairs(pcm.split_pairs(data, 3, 2), 2) == data[:30] and pcm.group_pairs(pcm.split_pairs(data[:24], 4, 2), 2) == data[:24] and pcm.group_pairs([], 2) == b""
    row = spark.createDataFrame([(bytearray(data), [10, 50, 70]), (None, [])], "d binary, t array<long>").select(pcm.channel_pairs(F.col("d"), F.lit(3), F.lit(2)).alias("p"), pcm.index_duration(F.col("t")).alias("a"), pcm.last_frame_duration(F.col("t")).alias("b")).collect()
    assert [bytes(x) for x in row[0].p] == pcm.split_pairs(data, 3, 2) and (row[0].a, row[0].b) == (60, 20) and row[1].p is None and row[1].a is None


def test_apple_note_and_lens():
    note = b"Apple iOS\0\0\1MM" + struct.pack(">H", 2) + struct.pack(">HHII", 1, 9, 1, 14) + struct.pack(">HHII", 5, 9, 1, 180) + bytes(4)
    lens = struct.pack("<8I", 24, 1, 70, 1, 28, 10, 28, 10)
    first = struct.pack("<H", 1) + struct.pack("<HHII", 34665, 4, 1, 26) + bytes(4)
    inner = struct.pack("<H", 2) + struct.pack("<HHII", 37500, 7, len(note), 56) + struct.pack("<HHII", 42034, 5, 4, 56 + len(note)) + bytes(4)
    f = Found()
    assert kernels.exif(b"II*\0" + struct.pack("<I", 8) + first + inner + note + lens, f)
    got = {(k, n): v for (k, p, n, e), v in f.rows.items()}
    assert got[12, "MakerNoteVersion"] == "14" and got[12, "AETarget"] == "180" and got[7, "LensSpec"] == "24-70mm f/2.8"
