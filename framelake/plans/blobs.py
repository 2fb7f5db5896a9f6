"""Media blobs built from table rows, for round trips whose results SQL can compute from the same columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.binary import to_be, to_le

RATES = (8000, 44100, 48000)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out over all cores before they grow into blobs, as a small table is often one row group; by the hash of
    ``keys`` where they are told, which needs no sort."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _bytes(raw: bytes) -> Column:
    return F.lit(bytes(raw))


def _le_hex(value: Column, size: int) -> Column:
    """The hex digits of a little-endian integer that fits into ``size`` bytes."""
    byte = lambda k: F.shiftright(value, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    turned = functools.reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(byte(k), 8 * (size - 1 - k)) for k in range(size)])
    return F.lpad(F.hex(turned), 2 * size, "0")


def wav_blobs(lineitem: DataFrame) -> DataFrame:
    """(path, content): a 16-bit PCM file for each row, with l_quantity samples."""
    channels = (F.col("l_linenumber") % 2 + 1).cast("long")
    rate = F.element_at(F.array(*[F.lit(r).cast("long") for r in RATES]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    path = F.concat_ws("/", F.lit("wav"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    # The numbers are columns of their own, as the header needs each several times.
    told = F.struct(path.alias("path"), channels.alias("channels"), rate.alias("rate"), (F.col("l_quantity").cast("long") * channels * 2).alias("size"))
    rows = spread(lineitem, "l_orderkey", "l_linenumber").select(F.explode(F.array(told)).alias("w")).select("w.*")
    channels, rate, size = F.col("channels"), F.col("rate"), F.col("size")
    digits = lambda raw: F.lit(raw.hex())
    # Neighbours go together as one number: channels and rate, bytes a second and a frame.
    sound, speed = channels.bitwiseOR(F.shiftleft(rate, 16)), (rate * channels * 2).bitwiseOR(F.shiftleft(channels * 2, 32))
    fmt = F.concat(digits(b"WAVEfmt \x10\0\0\0\1\0"), _le_hex(sound, 6), _le_hex(speed, 6), digits(b"\x10\0"))
    head = F.unhex(F.concat(digits(b"RIFF"), _le_hex(size + 36, 4), fmt, digits(b"data"), _le_hex(size, 4)))
    return rows.select("path", F.rpad(head, (size + 44).cast("int"), _bytes(b"\0")).alias("content"))


def bmp_blobs(part: DataFrame) -> DataFrame:
    bits = F.when(F.col("p_partkey") % 2 == 0, 24).otherwise(8)
    width, height = F.col("p_size") + 16, F.col("p_partkey") % 1000 + 16
    content = F.concat(_bytes(b"BM"), to_le(F.lit(54), 4), _bytes(bytes(4)), to_le(F.lit(54), 4), to_le(F.lit(40), 4), to_le(width, 4), to_le(height, 4), to_le(F.lit(1), 2), to_le(bits, 2), _bytes(bytes(24)))
    return spread(part).select(F.concat(F.lit("bmp/"), "p_partkey").alias("path"), content.alias("content"))


def gif_blobs(part: DataFrame) -> DataFrame:
    version = F.when(F.col("p_partkey") % 3 == 0, "GIF87a").otherwise("GIF89a")
    content = F.concat(version.cast("binary"), to_le(F.col("p_size") + 16, 2), to_le(F.col("p_partkey") % 1000 + 16, 2), _bytes(b"\0\0\0;"))
    return spread(part).select(F.concat(F.lit("gif/"), "p_partkey").alias("path"), content.alias("content"))


def png_blobs(orders: DataFrame) -> DataFrame:
    width, height = F.col("o_orderkey") % 4000 + 1, F.col("o_custkey") % 3000 + 1
    colour = F.element_at(F.array(*[F.lit(x) for x in (0, 2, 3, 4, 6)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    content = F.concat(_bytes(b"\x89PNG\r\n\x1a\n"), to_be(F.lit(13), 4), _bytes(b"IHDR"), to_be(width, 4), to_be(height, 4), to_be(F.lit(8), 1), to_be(colour, 1), _bytes(bytes(7)), _bytes(bytes(4)), _bytes(b"IEND"), _bytes(bytes(4)))
    return spread(orders, "o_orderkey").select(F.concat(F.lit("png/"), "o_orderkey").alias("path"), content.alias("content"))


def elf_blobs(supplier: DataFrame) -> DataFrame:
    bits, end = F.col("s_suppkey") % 2 + 1, F.floor(F.col("s_suppkey") / 2) % 2 + 1
    kind = F.col("s_suppkey") % 4 + 1
    content = F.concat(_bytes(b"\x7fELF"), to_be(bits, 1), to_be(end, 1), _bytes(b"\x01"), _bytes(bytes(9)), F.when(end == 1, to_le(kind, 2)).otherwise(to_be(kind, 2)), _bytes(bytes(4)))
    return spread(supplier).select(F.concat(F.lit("elf/"), "s_suppkey").alias("path"), content.alias("content"))


def text_blobs(documents: DataFrame, pages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Texts of the tables as UTF-8 blobs."""
    raw = lambda c: F.encode(F.col(c), "UTF-8").alias("content")
    docs = documents.select(F.concat(F.lit("documents/"), "doc_id").alias("path"), raw("text"))
    html = pages.select(F.concat(F.lit("pages/"), "page_id").alias("path"), raw("html"))
    turns = conversations.select(F.concat_ws("/", F.lit("conversations"), "conv_id", "turn").alias("path"), raw("text"))
    return docs.unionByName(html).unionByName(turns)


def _box(name: bytes, *parts: Column) -> Column:
    """An ISO media box."""
    body = F.concat(*parts)
    return F.concat(to_be(F.octet_length(body) + 8, 4), _bytes(name), body)


def mp4_blobs(part: DataFrame) -> DataFrame:
    """(path, content): one AVC track of p_size + 1 pictures at 25 a second, with codec configuration, colours and tags."""
    frames, key = (F.col("p_size") + 1).cast("long"), F.col("p_partkey")
    width, height = F.col("p_size") * 16 + 16, (key % 50) * 16 + 16
    config = _box(b"avcC", _bytes(b"\x01\x64\x00"), to_be(F.lit(10) + key % 42, 1), _bytes(b"\xff\xe0\x00"))
    colour = _box(b"colr", _bytes(b"nclx"), to_be(F.lit(1) + 8 * (key % 2), 2), to_be(F.lit(1), 2), to_be(F.lit(1), 2), _bytes(b"\0"))
    shape = _box(b"pasp", to_be(F.lit(4), 4), to_be(F.lit(3), 4))
    entry = _box(b"avc1", _bytes(bytes(24)), to_be(width, 2), to_be(height, 2), _bytes(bytes(50)), config, colour, shape)
    table = _box(b"stbl", _box(b"stsd", _bytes(bytes(7) + b"\1"), entry), _box(b"stts", _bytes(bytes(7) + b"\1"), to_be(frames, 4), to_be(F.lit(40), 4)), _box(b"stsz", _bytes(bytes(4)), to_be(F.lit(100), 4), to_be(frames, 4)))
    media = _box(b"mdia", _box(b"mdhd", _bytes(bytes(12)), to_be(F.lit(1000), 4), to_be(frames * 40, 4), to_be(F.lit(5 << 10 | 14 << 5 | 7), 2), _bytes(bytes(2))), _box(b"hdlr", _bytes(bytes(8) + b"vide" + bytes(12))), _box(b"minf", table))
    track = _box(b"trak", _box(b"tkhd", _bytes(bytes(12)), to_be(F.lit(1), 4), _bytes(bytes(64))), media)
    title = _box(b"\xa9nam", _box(b"data", _bytes(b"\0\0\0\1\0\0\0\0"), F.col("p_name").cast("binary")))
    tags = _box(b"udta", _box(b"meta", _bytes(bytes(4)), _box(b"ilst", title)))
    movie = _box(b"moov", _box(b"mvhd", _bytes(bytes(12)), to_be(F.lit(1000), 4), to_be(frames * 40, 4), _bytes(bytes(80))), track, tags)
    content = F.concat(_box(b"ftyp", _bytes(b"isom" + bytes(4) + b"isomavc1")), movie, _box(b"mdat", F.unhex(F.repeat(F.lit("00"), (frames * 100).cast("int")))))
    return spread(part).select(F.concat(F.lit("mp4/"), "p_partkey").alias("path"), content.alias("content"))


def _element(name: str, *parts: Column) -> Column:
    """An EBML element whose size takes eight bytes."""
    body = F.concat(*parts)
    return F.concat(F.unhex(F.lit(name)), _bytes(b"\x01"), to_be(F.octet_length(body), 7), body)


def mkv_blobs(part: DataFrame) -> DataFrame:
    """(path, content): a WebM file with a VP9 and an Opus track."""
    key = F.col("p_partkey")
    number = lambda name, value, size: _element(name, to_be(value, size))
    text = lambda name, value: _element(name, value.cast("binary"))
    head = _element("1A45DFA3", text("4282", F.lit("webm")), number("4287", F.lit(4), 1))
    info = _element("1549A966", number("2AD7B1", F.lit(1_000_000), 3), text("7BA9", F.col("p_name")))
    picture = _element("AE", number("D7", F.lit(1), 1), number("83", F.lit(1), 1), text("86", F.lit("V_VP9")), number("23E383", F.lit(40_000_000), 4), _element("E0", number("B0", F.col("p_size") + 100, 2), number("BA", key % 500 + 100, 2)))
    sound = _element("AE", number("D7", F.lit(2), 1), number("83", F.lit(2), 1), text("86", F.lit("A_OPUS")), text("22B59C", F.lit("ger")), _element("E1", number("9F", key % 2 + 1, 1)))
    content = F.concat(head, _element("18538067", info, _element("1654AE6B", picture, sound)))
    return spread(part).select(F.concat(F.lit("mkv/"), "p_partkey").alias("path"), content.alias("content"))


def flac_blobs(orders: DataFrame) -> DataFrame:
    rate = F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col("o_orderkey") % 3 + 1).cast("int")).cast("long")
    samples = F.col("o_custkey") * 1000 + 1000
    packed = F.shiftleft(rate, 44) + F.shiftleft(F.col("o_orderkey") % 8, 41) + F.shiftleft(F.lit(23).cast("long"), 36) + samples
    content = F.concat(_bytes(b"fLaC\x80\0\0\x22" + bytes(10)), to_be(packed, 8), _bytes(bytes(16)))
    return spread(orders, "o_orderkey").select(F.concat(F.lit("flac/"), "o_orderkey").alias("path"), content.alias("content"))


def mp3_blobs(part: DataFrame) -> DataFrame:
    """(path, content): an ID3 tag without frames, and 1 to 5 frames of MPEG-1 layer 3."""
    code, frames = F.col("p_partkey") % 14 + 1, (F.col("p_size") % 5 + 1).cast("int")
    rates = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    size = F.element_at(F.array(*[F.lit(144 * r * 1000 // 44100) for r in rates]), code.cast("int"))
    frame = F.concat(F.lit("FFFB"), F.lpad(F.hex(code * 16), 2, "0"), F.lit("00"), F.repeat(F.lit("00"), size - 4))
    content = F.concat(_bytes(b"ID3\3\0\0\0\0\0\0"), F.unhex(F.repeat(frame, frames)))
    return spread(part).select(F.concat(F.lit("mp3/"), "p_partkey").alias("path"), content.alias("content"))


def jpeg_blobs(part: DataFrame) -> DataFrame:
    """(path, content): a baseline picture with an Exif segment that tells the maker."""
    maker = F.concat(F.col("p_brand").cast("binary"), _bytes(b"\0"))
    exif = F.concat(_bytes(b"Exif\0\0II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0"), to_le(F.octet_length(maker), 4), to_le(F.lit(26), 4), _bytes(bytes(4)), maker)
    segment = lambda mark, body: F.concat(_bytes(b"\xff" + mark), to_be(F.octet_length(body) + 2, 2), body)
    frame = F.concat(_bytes(b"\x08"), to_be(F.col("p_partkey") % 1000 + 16, 2), to_be(F.col("p_size") + 16, 2), _bytes(b"\x03\x01\x22\0\x02\x11\1\x03\x11\1"))
    content = F.concat(_bytes(b"\xff\xd8"), segment(b"\xe1", exif), segment(b"\xc0", frame), _bytes(b"\xff\xda\0\x02data"))
    return spread(part).select(F.concat(F.lit("jpeg/"), "p_partkey").alias("path"), content.alias("content"))


def planted_blobs(part: DataFrame, heads: list[str]) -> DataFrame:
    """(path, content): for each row one of some blobs, given in hex."""
    every = F.expr("array(" + ", ".join(f"X'{h}'" for h in heads) + ")")
    return spread(part).select(F.col("p_partkey").alias("path"), F.element_at(every, (F.col("p_partkey") % len(heads) + 1).cast("int")).alias("content"))
