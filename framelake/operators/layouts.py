"""Formats whose headers stand at fixed offsets, decoded with Catalyst expressions only."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.binary import at, be, latin1, le, magic, signed
from framelake.functions.display import duration_ms, fixed, lookup
from framelake.model import KINDS
from framelake.operators.kernels import LAYOUTS as FLAC_CHANNELS

_G, _V, _A, _T, _I = (KINDS.index(k) for k in ("General", "Video", "Audio", "Text", "Image"))


def _field(kind: int, name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(F.lit(kind).alias("kind_id"), F.lit(0).alias("pos"), F.lit(name).alias("name"), value.alias("value"), F.lit(False).alias("is_extra"))


def _fields(*rows: tuple[int, str, Column | str]) -> Column:
    """The rows whose value isn't null, in order."""
    return F.filter(F.array(*[_field(*r) for r in rows]), lambda r: r["value"].isNotNull())


def _image(name: str, *rows: tuple[str, Column | str]) -> Column:
    return _fields((_G, "Format", name), (_G, "ImageCount", "1"), *[(_I, n, v) for n, v in rows])


def _ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), fixed(width / height.cast("double"), 3))


def bmp(c: Column) -> Column:
    width, height, bits = F.abs(signed(le(c, 18, 4), 4)), F.abs(signed(le(c, 22, 4), 4)), le(c, 28, 2)
    rows = _image("Bitmap", ("Format", "Raw"), ("Width", width), ("Height", height), ("ColorSpace", F.when(bits <= 8, "Palette").otherwise("RGB")), ("BitDepth", bits))
    return rows


def gif(c: Column) -> Column:
    width, height = le(c, 6, 2), le(c, 8, 2)
    return _image("GIF", ("Format", "GIF"), ("Format_Profile", latin1(c, 3, 3)), ("Width", width), ("Height", height), ("PixelAspectRatio", "1.000"), ("DisplayAspectRatio", _ratio(width, height)), ("Compression_Mode", "Lossless"))


def psd(c: Column) -> Column:
    # Colour modes.
    mode = lookup(be(c, 24, 2).cast("string"), {"0": "Bitmap", "1": "Grayscale", "2": "Indexed", "3": "RGB", "4": "CMYK", "7": "Multichannel", "8": "Duotone", "9": "Lab"})
    name = F.when(be(c, 4, 2) == 2, "PSB").otherwise("PSD")
    rows = [("Format", name), ("Format_Version", be(c, 4, 2)), ("ColorSpace", mode), ("Width", be(c, 18, 4)), ("Height", be(c, 14, 4)), ("BitDepth", be(c, 22, 2)), ("Compression_Mode", "Lossless")]
    return _fields((_G, "Format", name), (_G, "ImageCount", "1"), *[(_I, n, v) for n, v in rows])


def pcx(c: Column) -> Column:
    # Versions.
    version = lookup(be(c, 1, 1).cast("string"), {"0": "Paintbrush v2.5", "2": "Paintbrush v2.8 with palette information", "3": "Paintbrush v2.8 without palette information", "4": "Paintbrush/Windows", "5": "Paintbrush v3.0+"})
    width, height = le(c, 8, 2) - le(c, 4, 2), le(c, 10, 2) - le(c, 6, 2)
    return _image("PCX", ("Format", "PCX"), ("Format_Version", version), ("Width", width), ("Height", height), ("BitDepth", be(c, 3, 1)), ("Compression_Mode", "Lossless"), ("DPI", F.concat(le(c, 14, 2).cast("string"), F.lit(" x "), le(c, 12, 2).cast("string"))))


def dds(c: Column) -> Column:
    packed = (le(c, 76, 4) >= 32) & (le(c, 80, 4).bitwiseAND(F.lit(4)) != 0)
    rows = [("Format", F.when(packed, "DirectX TC").otherwise("DDS")), ("CodecID", F.when(packed, latin1(c, 84, 4))), ("Width", le(c, 16, 4)), ("Height", le(c, 12, 4)), ("BitDepth", F.when(le(c, 8, 4).bitwiseAND(F.lit(0x800000)) != 0, le(c, 24, 4))), ("StreamSize", F.octet_length(c))]
    return _fields((_G, "Format", "DDS"), (_G, "ImageCount", "1"), (_G, "StreamSize", "0"), *[(_I, n, v) for n, v in rows])


def ivf(c: Column) -> Column:
    codec, num, den = latin1(c, 8, 4), le(c, 16, 4), le(c, 20, 4)
    name = lookup(codec, {"VP80": "VP8", "VP90": "VP9", "AV01": "AV1", "AV02": "AV2"})
    return _fields(
        (_G, "Format", "IVF"), (_G, "VideoCount", "1"), (_V, "Format", name), (_V, "CodecID", codec), (_V, "Width", le(c, 12, 2)), (_V, "Height", le(c, 14, 2)),
        (_V, "FrameRate", F.when(den > 0, fixed(num / den.cast("double"), 3))), (_V, "FrameRate_Num", num), (_V, "FrameRate_Den", den), (_V, "FrameCount", le(c, 24, 4)),
    )


def flv(c: Column) -> Column:
    flags = be(c, 4, 1)
    has = lambda bit: F.when(flags.bitwiseAND(F.lit(bit)) != 0, "1").otherwise("0")
    return _fields((_G, "Format", "Flash Video"), (_G, "InternetMediaType", "video/x-flv"), (_G, "VideoCount", has(1)), (_G, "AudioCount", has(4)))


# By encoding of an AU file, format, codec, bits a sample and whether nothing is lost.
AU_ENCODINGS = {
    1: ("ADPCM", "8-bit mu-law", 8, False),
    2: ("PCM", "8-bit signed linear", 8, True),
    3: ("PCM", "16-bit signed linear", 16, True),
    4: ("PCM", "24-bit signed linear", 24, True),
    5: ("PCM", "32-bit signed linear", 32, True),
    6: ("PCM", "floating-point", 32, True),
    7: ("PCM", "double precision float", 64, True),
    8: ("fragmented sampled data", "fragmented sampled data", 0, False),
    10: ("DSP program", "DSP program", 0, False),
    11: ("PCM", "8-bit fixed-point", 8, True),
    12: ("PCM", "16-bit fixed-point", 16, True),
    13: ("PCM", "24-bit fixed-point", 24, True),
    14: ("PCM", "32-bit fixed-point", 32, True),
    17: ("ADPCM", "mu-law squelch", 0, False),
    18: ("PCM", "16-bit linear with emphasis", 16, True),
    19: ("PCM", "16-bit linear with compression", 16, False),
    20: ("PCM", "16-bit linear with emphasis and compression", 16, False),
    21: ("Music Kit DSP commands", "Music Kit DSP commands", 0, False),
    22: ("Music Kit DSP samples", "Music Kit DSP samples", 0, False),
    23: ("ADPCM", "G.721 ADPCM", 0, False),
    24: ("ADPCM", "G.722 ADPCM", 0, False),
    25: ("ADPCM", "G.723 ADPCM", 0, False),
    26: ("ADPCM", "5-bit G.723 ADPCM", 0, False),
    27: ("ADPCM", "8-bit a-law", 8, False),
}


def au(c: Column) -> Column:
    code, rate, channels, start, told = be(c, 12, 4), be(c, 16, 4), be(c, 20, 4), be(c, 4, 4), be(c, 8, 4)
    known = lambda k: lookup(code.cast("string"), {str(n): str(row[k]) for n, row in AU_ENCODINGS.items()})
    name = F.coalesce(known(0), F.lit("PCM"))
    bits = F.nullif(known(2).cast("long"), F.lit(0))
    size = F.when(F.octet_length(c) >= start, F.octet_length(c) - start).when((told != 0) & (told < 0xFFFFFFFF), told).otherwise(0)
    sound = (rate > 0) & (size > 0)
    return _fields(
        (_G, "Format", "AU"), (_G, "AudioCount", "1"), (_A, "Format", name), (_A, "CodecID", known(1)), (_A, "Codec", known(1)), (_A, "Channels", channels), (_A, "SamplingRate", rate), (_A, "BitDepth", bits),
        (_A, "Format_Settings_Endianness", F.when(name.isin("PCM", "ADPCM"), "Big")), (_A, "BitRate_Mode", "CBR"), (_A, "Compression_Mode", F.when(known(3) == "False", "Lossy").otherwise("Lossless")),
        (_A, "Duration", F.when(sound, F.call_function("div", size * 1000, F.nullif(rate, F.lit(0))))), (_A, "BitRate", F.when(sound & (channels > 0), rate * bits * channels)), (_A, "StreamSize", F.when(size > 0, size)),
    )


def midi(c: Column) -> Column:
    return _fields((_G, "Format", "MIDI"), (_G, "AudioCount", "1"), (_A, "Format", "MIDI"))


def elf(c: Column) -> Column:
    # File types.
    little = be(c, 5, 1) == 1
    kind = F.when(little, le(c, 16, 2)).otherwise(be(c, 16, 2)).cast("string")
    return _fields(
        (_G, "Format", "ELF"), (_G, "Format_Profile", lookup(kind, {"1": "Relocatable", "2": "Executable", "3": "Shared object", "4": "Core"})), (_G, "Format_Version", be(c, 6, 1)),
        (_G, "BitDepth", F.when(be(c, 4, 1) == 2, "64").otherwise("32")), (_G, "Format_Settings_Endianness", F.when(little, "Little").otherwise("Big")),
    )


def zip_(c: Column) -> Column:
    method = lookup(le(c, 8, 2).cast("string"), {"0": "Store", "8": "Deflate", "9": "Deflate64", "12": "BZIP2", "14": "LZMA"})
    return _fields((_G, "Format", "ZIP"), (_G, "Format_Compression", F.when(at(c, 2, 2) == F.lit(b"\x03\x04"), method)))


def gzip(c: Column) -> Column:
    return _fields((_G, "Format", "GZip"), (_G, "Format_Profile", F.when(be(c, 2, 1) == 8, "Deflate")))


def bzip2(c: Column) -> Column:
    return _fields((_G, "Format", "BZip2"), (_G, "Format_Level", F.concat(F.lit("block_size="), latin1(c, 3, 1))))


def rar(c: Column) -> Column:
    return _fields((_G, "Format", "RAR"), (_G, "Format_Version", F.concat_ws(".", be(c, 5, 1), be(c, 6, 1))))


def iso9660(c: Column) -> Column:
    text = lambda o: F.nullif(F.trim(latin1(c, o, 32)), F.lit(""))
    return _fields((_G, "Format", "ISO 9660"), (_G, "System_ID", text(0x8008)), (_G, "Volume_ID", text(0x8028)))


# Positions and layouts of Opus by number of channels.
OPUS_CHANNELS = {
    1: ("Front: C", "M"),
    2: ("Front: L R", "L R"),
    3: ("Front: L C R", "L R C"),
    4: ("Front: L R,   Rear: L R", "L R BL BR"),
    5: ("Front: L C R, Back: L R", "L R BL BR LFE"),
    6: ("Front: L C R, Back: L R, LFE", "L R C BL BR LFE"),
    7: ("Front: L C R, Side: L R, Back: C, LFE", "L R C SL SR BC LFE"),
    8: ("Front: L C R, Side: L R, Back: L R, LFE", "L R C SL SR BL BR LFE"),
}


def opus(c: Column) -> Column:
    place = lambda k: lookup(be(c, 9, 1).cast("string"), {str(n): row[k] for n, row in OPUS_CHANNELS.items()})
    return _fields((_A, "Format", "Opus"), (_A, "Codec", "Opus"), (_A, "Channels", be(c, 9, 1)), (_A, "SamplingRate", F.when(le(c, 12, 4) > 0, le(c, 12, 4)).otherwise(48000)), (_A, "ChannelPositions", place(0)), (_A, "ChannelLayout", place(1)))


def vorbis(c: Column) -> Column:
    most, usual, least = (signed(le(c, at, 4), 4) for at in (16, 20, 24))
    mode = F.when((usual > 0) & (most == usual) & (usual == least), "CBR").otherwise("VBR")
    return _fields((_A, "Format", "Vorbis"), (_A, "Codec", "Vorbis"), (_A, "Channels", be(c, 11, 1)), (_A, "SamplingRate", le(c, 12, 4)), (_A, "BitRate_Mode", mode), (_A, "BitRate", F.when(usual > 0, usual)))


def tta(c: Column) -> Column:
    channels, bits, rate, samples = le(c, 6, 2), le(c, 8, 2), le(c, 10, 4), le(c, 14, 4)
    rows = [("Format", "TTA"), ("Codec", "TTA "), ("Compression_Mode", "Lossless"), ("BitRate_Mode", "VBR"), ("BitDepth", bits), ("Channels", channels), ("SamplingRate", rate), ("SamplingCount", samples)]
    return _fields((_G, "Format", "TTA"), (_G, "AudioCount", "1"), *[(_A, n, v) for n, v in rows], (_A, "Duration", F.call_function("div", samples * 1000, F.nullif(rate, F.lit(0)))))


def cr2(c: Column) -> Column:
    return _fields((_G, "Format", "CR2"), (_G, "Format_Version", F.concat_ws(".", be(c, 10, 1), be(c, 11, 1))))


def arriraw(c: Column) -> Column:
    return _fields((_G, "Format", "Arri Raw"), (_G, "StreamSize", "0"), (_I, "Format", "Arri Raw"), (_I, "StreamSize", F.octet_length(c)))


def _head(c: Column) -> Column:
    return F.decode(F.substring(c, 1, 1024), "ISO-8859-1")


def dcp_am(c: Column) -> Column:
    return _fields((_G, "Format", "DCP AM"), (_G, "Format_Version", F.when(_head(c).contains("PROTO-ASDCP-AM"), "Interop").otherwise("SMPTE")))


def dcp_cpl(c: Column) -> Column:
    return _fields((_G, "Format", F.when(_head(c).rlike("PROTO-ASDCP-CPL|schemas/429-7"), "DCP CPL").otherwise("IMF CPL")))


def dcp_pkl(c: Column) -> Column:
    return _fields((_G, "Format", "DCP PKL"), (_G, "StreamSize", F.octet_length(c)))


def vp8(c: Column) -> Column:
    key = be(c, 0, 1) < 128
    side = lambda at_: F.when(key, le(c, at_, 2).bitwiseAND(F.lit(0x3FFF)))
    return _fields((_V, "Format", "VP8"), (_V, "Codec", "VP8"), (_V, "BitDepth", "8"), (_V, "ColorSpace", "YUV"), (_V, "Width", side(6)), (_V, "Height", side(8)), (_G, "Format", "VP8"))


# Codecs of WAV files by their tag.
WAV_CODECS = {1: "PCM", 3: "PCM", 6: "A-law", 7: "µ-law", 65534: "PCM"}


def plain_wav_fields(head: bytes, length: int) -> list[tuple[int, int, str, str, bool]] | None:
    """The fields of a WAV file that is nothing but its usual 44 bytes and the samples that these announce, as the kernel gives
    them for any; null for other blobs."""
    if len(head) < 44 or head[36:40] != b"data":
        return None
    size_told, fmt, tag, channels, rate, align, bits, size = _WAV_HEAD.unpack_from(head)
    if size_told + 8 != length or size + 44 != length or fmt != 16:
        return None
    samples, bps = size // align if align else None, rate * channels * bits
    sign = ("Unsigned" if bits <= 8 else "Signed") if tag == 1 else "Signed" if tag == 3 else None
    rows = (
        (_G, "Format", "Wave"), (_G, "InternetMediaType", "audio/wav"), (_G, "Format_Settings", "PcmWaveformat" if tag == 1 else None),
        (_A, "Format", WAV_CODECS.get(tag, "Unknown")), (_A, "Format_Settings_Endianness", "Little" if tag in (1, 3, 0xFFFE) else None), (_A, "Format_Settings_Sign", sign),
        (_A, "CodecID", tag), (_A, "BitRate_Mode", "CBR"), (_A, "BitRate", bps or None), (_A, "Channels", channels), (_A, "SamplingRate", rate), (_A, "BitDepth", bits), (_A, "StreamSize", size),
        (_A, "SamplingCount", samples), (_A, "Duration", (samples * 1000 + rate // 2) // rate if rate and samples is not None else None), (_G, "AudioCount", "1"),
    )
    return [(k, 0, n, str(v), False) for k, n, v in rows if v is not None]


def plain_pcm(content: Column) -> Column:
    """The numbers, still big-endian, of what may be a WAV file of integer samples that is nothing but its usual 44 bytes and the
    samples that these announce; null for other blobs."""
    front = (at(content, 0, 4) == F.lit(b"RIFF")) & (at(content, 8, 14) == F.lit(b"WAVEfmt \x10\0\0\0\1\0")) & (at(content, 36, 4) == F.lit(b"data"))
    number = lambda offset, size: F.conv(F.hex(at(content, offset, size)), 16, 10).cast("long")
    told = F.struct(number(4, 4).alias("riff"), number(22, 6).alias("sound"), number(32, 4).alias("sample"), number(40, 4).alias("size"))
    return F.when(front & (F.octet_length(content) >= 44), told)


def turned_pcm(told: Column) -> Column:
    """The numbers of ``plain_pcm`` one by one."""

    def number(value: Column, *shifts: int) -> Column:
        bytes_ = [F.shiftleft(F.shiftright(value, s).bitwiseAND(F.lit(255).cast("long")), 8 * k) for k, s in enumerate(shifts)]
        return functools.reduce(lambda x, y: x.bitwiseOR(y), bytes_)

    riff, sound, sample, size = (told[n] for n in ("riff", "sound", "sample", "size"))
    found = (("riff", number(riff, 24, 16, 8, 0)), ("channels", number(sound, 40, 32)), ("rate", number(sound, 24, 16, 8, 0)), ("align", number(sample, 24, 16)), ("bits", number(sample, 8, 0)), ("size", number(size, 24, 16, 8, 0)))
    return F.when(told.isNotNull(), F.struct(*[v.alias(n) for n, v in found]))


def settled_pcm(told: Column, length: Column) -> Column:
    """The numbers of ``turned_pcm``, if they fit to the blob's length and none but the size is zero; else null. Blobs of more than
    255 channels or bits a sample are left to others, so that the product with the rate can't overflow."""
    fits = (told["riff"] + 8 == length) & (told["size"] + 44 == length) & (told["rate"] > 0) & (told["align"] > 0)
    return F.when(fits & told["channels"].between(1, 255) & told["bits"].between(1, 255), told)


def pcm_rows(told: Column) -> tuple[tuple[int, str, Column | str], ...]:
    """Kind, name and value of each field of ``plain_wav_fields``, from the numbers of ``settled_pcm``; none is null."""
    channels, rate, bits, size = (told[n] for n in ("channels", "rate", "bits", "size"))
    samples = F.call_function("div", size, told["align"])
    sign = F.when(bits <= 8, "Unsigned").otherwise("Signed")
    return (
        (_G, "Format", "Wave"), (_G, "InternetMediaType", "audio/wav"), (_G, "Format_Settings", "PcmWaveformat"), (_A, "Format", WAV_CODECS[1]), (_A, "Format_Settings_Endianness", "Little"),
        (_A, "Format_Settings_Sign", sign), (_A, "CodecID", "1"), (_A, "BitRate_Mode", "CBR"), (_A, "BitRate", rate * channels * bits), (_A, "Channels", channels), (_A, "SamplingRate", rate), (_A, "BitDepth", bits),
        (_A, "StreamSize", size), (_A, "SamplingCount", samples), (_A, "Duration", duration_ms(samples, rate)), (_G, "AudioCount", "1"),
    )


def pcm_fields(told: Column) -> Column:
    """The fields of ``plain_wav_fields``, from the numbers of ``settled_pcm``."""
    return F.array(*[_field(*r) for r in pcm_rows(told)])


def _lacks(content: Column, *marks: bytes) -> Column:
    return functools.reduce(lambda a, b: a & b, [~F.contains(content, F.lit(bytes(m))) for m in marks])


def plain_png(content: Column) -> Column:
    """The numbers of a PNG file of a header, one chunk of data at most and the end, in whose first MiB nothing may begin a tag
    and which no gate before that of PNG accepts; null for other blobs."""
    number = lambda offset: F.conv(F.hex(at(content, offset, 4)), 16, 10).cast("long")
    front = (at(content, 0, 16) == F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR")) & (F.octet_length(content) >= 41)
    data = number(33)
    end = F.substring(content, (data + 50).cast("int"), F.lit(4)) == F.lit(b"IEND")
    whole = (at(content, 37, 4) == F.lit(b"IEND")) | ((at(content, 37, 4) == F.lit(b"IDAT")) & (data < 0x7FFFFF00) & end)
    told = F.struct(number(16).alias("width"), number(20).alias("height"), be(content, 24, 1).alias("depth"), be(content, 25, 1).alias("colour"), F.octet_length(content).alias("size"))
    return F.when(front & whole & _lacks(F.substring(content, 1, 1 << 20), b"\x06\x0e\x2b\x34", b"<x:xmpmeta", b"8BIM", b"acsp", b"jumb"), told)


def png_fields(told: Column) -> Column:
    """The fields of a PNG file without tags, from the numbers of ``plain_png``."""
    width, height, colour = told["width"], told["height"], told["colour"]
    space = F.when(colour == 0, "Y").when(colour.isin(2, 3), "RGB").when(colour == 4, "YA").when(colour == 6, "RGBA")
    return _fields(
        (_G, "Format", "PNG"), (_G, "ImageCount", "1"), (_G, "StreamSize", "0"), (_I, "Format", "PNG"), (_I, "Format_Compression", "Deflate"), (_I, "Format_Settings_Packing", "Linear"), (_I, "Width", width), (_I, "Height", height),
        (_I, "PixelAspectRatio", "1.000"), (_I, "DisplayAspectRatio", F.when(height > 0, fixed(width / height.cast("double"), 3))), (_I, "ColorSpace", space), (_I, "BitDepth", told["depth"]),
        (_I, "Compression_Mode", "Lossless"), (_I, "StreamSize", told["size"]),
    )


def plain_flac(content: Column) -> Column:
    """The numbers of a FLAC file whose only block of metadata is STREAMINFO of the usual size and at whose end no tag stands;
    null for other blobs."""
    number = lambda offset, size: F.conv(F.hex(at(content, offset, size)), 16, 10).cast("long")
    front = (at(content, 0, 8) == F.lit(b"fLaC\x80\0\0\x22")) & (F.octet_length(content) >= 42)
    told = F.struct((at(content, 12, 3) == at(content, 15, 3)).alias("even"), number(15, 3).alias("most"), number(18, 4).alias("form"), number(22, 4).alias("low"), at(content, 26, 16).alias("md5"), F.octet_length(content).alias("size"))
    return F.when(front & _lacks(F.substring(content, -192, 192), b"TAG", b"LYRICS"), told)


def flac_fields(told: Column) -> Column:
    """The fields of a FLAC file without comments and tags, from the numbers of ``plain_flac``."""
    form, size = told["form"], (told["size"] - 42).cast("long")
    rate, channels, bits = F.shiftright(form, 12), F.shiftright(form, 9).bitwiseAND(F.lit(7).cast("long")) + 1, F.shiftright(form, 4).bitwiseAND(F.lit(31).cast("long")) + 1
    samples = F.shiftleft(form.bitwiseAND(F.lit(15).cast("long")), 32) + told["low"]
    ms = F.nullif(duration_ms(samples, rate), F.lit(0).cast("long"))
    place = lambda k: F.element_at(F.array(*[F.lit(FLAC_CHANNELS[n][k]) for n in range(1, 9)]), channels.cast("int"))
    return _fields(
        (_G, "Format", "FLAC"), (_G, "StreamSize", "0"), (_A, "Format", "FLAC"), (_A, "BitRate_Mode", F.when(told["even"] & (told["most"] != 0), "CBR").otherwise("VBR")), (_A, "Duration", ms),
        (_A, "BitRate", F.call_function("div", size * 8000, ms)), (_A, "Channels", channels), (_A, "ChannelPositions", place(0)), (_A, "ChannelLayout", place(1)), (_A, "SamplingRate", rate), (_A, "SamplingCount", samples),
        (_A, "BitDepth", bits), (_A, "Compression_Mode", "Lossless"), (_A, "StreamSize", size), (_A, "MD5_Unencoded", F.when(told["md5"] != F.lit(bytes(16)), F.hex(told["md5"]))), (_G, "AudioCount", "1"),
    )


_WAV_HEAD = struct.Struct("<4xI8xIHHI4xHH4xI")


#: Parsers with a layout of their own.
LAYOUTS: dict[str, Callable[[Column], Column]] = {
    "bmp": bmp, "gif": gif, "psd": psd, "pcx": pcx, "dds": dds, "ivf": ivf, "flv": flv, "au": au, "midi": midi, "elf": elf, "zip": zip_, "gzip": gzip, "bzip2": bzip2, "rar": rar, "iso9660": iso9660,
    "opus": opus, "vorbis": vorbis, "tta": tta, "cr2": cr2, "arriraw": arriraw, "dcp_am": dcp_am, "dcp_cpl": dcp_cpl, "dcp_pkl": dcp_pkl, "vp8": vp8,
}

# Formats of which nothing is read but what is told by the format itself, as (kind, field, value).
NAMES: dict[str, tuple[tuple[int, str, str], ...]] = {
    "cdxa": ((_G, "Format", "CDXA"),),
    "amv": ((_G, "Format", "AMV"),),
    "skm": ((_G, "Format", "SKM"),),
    "hds_f4m": ((_G, "Format", "HDS F4M"),),
    "dash_mpd": ((_G, "Format", "DASH MPD"),),
    "dxw": ((_G, "Format", "DXW"),),
    "aaf": ((_G, "Format", "AAF"),),
    "dvdv": ((_G, "Format", "DVDV"),),
    "lxf": ((_G, "Format", "LXF"),),
    "nut": ((_G, "Format", "Nut"),),
    "wm": ((_G, "Format", "Windows Media"), (_G, "InternetMediaType", "video/x-ms-asf")),
    "wtv": ((_G, "Format", "WTV"),),
    "rm": ((_G, "Format", "RealMedia"),),
    "ism": ((_G, "Format", "ISM"),),
    "mi_xml": ((_G, "Format", "MediaInfo XML"),),
    "p2_clip": ((_G, "Format", "P2 Clip"),),
    "xdcam_clip": ((_G, "Format", "XDCAM Clip"),),
    "sequence_info": ((_G, "Format", "SequenceInfo"),),
    "ptx": ((_G, "Format", "Pro Tools Session"), (_G, "Format_Version", "Version 10")),
    "nsv": ((_G, "Format", "NSV"),),
    "cdp": ((_G, "Format", "CDP"), (_T, "Format", "CDP")),
    "pgs": ((_G, "Format", "PGS"), (_T, "Format", "PGS"), (_T, "Codec", "PGS")),
    "dvb_subtitle": ((_G, "Format", "DVB Subtitle"), (_T, "Format", "DVB Subtitle")),
    "cmml": ((_G, "Format", "CMML"), (_T, "Format", "CMML")),
    "ttml": ((_G, "Format", "TTML"), (_T, "Format", "TTML")),
    "n19": ((_G, "Format", "N19"), (_T, "Format", "N19")),
    "sub_rip": ((_G, "Format", "SubRip"), (_T, "Format", "SubRip"), (_T, "Codec", "SubRip")),
    "raf": ((_G, "Format", "RAF"), (_G, "Format_Commercial", "Fujifilm RAW")),
    "aic": ((_V, "Format", "Apple Intermediate Codec"), (_V, "Format_Info", "AIC")),
    "avs": ((_V, "Format", "AVS"), (_V, "Format_Info", "Chinese AVS standard")),
    "avs3": ((_V, "Format", "AVS3"), (_V, "Format_Info", "Chinese AVS3 standard")),
    "canopus": ((_V, "Format", "Canopus HQ"), (_V, "Format_Info", "Grass Valley HQX")),
    "cineform": ((_V, "Format", "CineForm"), (_V, "Format_Info", "GoPro CineForm wavelet")),
    "dirac": ((_V, "Format", "Dirac"), (_V, "Format_Info", "BBC Dirac wavelet")),
    "flic": ((_V, "Format", "FLIC"), (_V, "Format_Info", "Autodesk Animator")),
    "fraps": ((_V, "Format", "Fraps"), (_V, "Format_Info", "Fraps screen capture")),
    "huffyuv": ((_V, "Format", "HuffYUV"), (_V, "Format_Info", "HuffYUV lossless")),
    "lagarith": ((_V, "Format", "Lagarith"), (_V, "Format_Info", "Lagarith lossless")),
    "dts_uhd": ((_G, "Format", "DTS"), (_G, "AudioCount", "1"), (_A, "Format", "DTS"), (_A, "Format_Profile", "UHD"), (_A, "Compression_Mode", "Lossy")),
    "dolby_e": ((_A, "Format", "Dolby E"), (_A, "Format_Info", "Professional Dolby E"), (_A, "Compression_Mode", "Lossless")),
    "mpegh3da": ((_A, "Format", "MPEG-H 3D Audio"), (_A, "Format_Info", "Immersive 3D Audio")),
    "mpc_sv8": ((_A, "Format", "Musepack"), (_A, "Format_Version", "SV8"), (_A, "Format_Info", "Musepack SV8")),
    "ps2_audio": ((_A, "Format", "PS2 Audio"), (_A, "Format_Info", "PlayStation 2 ADPCM")),
    "smpte_st0302": ((_A, "Format", "AES3"), (_A, "Format_Info", "SMPTE ST 302"), (_A, "Format_Settings_Mode", "16 AES3 channels")),
    "smpte_st0331": ((_A, "Format", "AES3"), (_A, "Format_Info", "SMPTE ST 331")),
    "smpte_st0337": ((_A, "Format", "AES3"), (_A, "Format_Info", "SMPTE ST 337"), (_A, "Format_Settings", "Non-PCM")),
    "channel_grouping": ((_A, "Format", "Channel Grouping"), (_A, "Format_Info", "Multi-stream channel grouping")),
    "channel_splitting": ((_A, "Format", "Channel Splitting"), (_A, "Format_Info", "Multi-channel splitting")),
    "rle": ((_G, "Format", "RLE"), (_T, "Format", "RLE"), (_T, "Codec", "RLE")),
    "adpcm": ((_G, "Format", "ADPCM"), (_G, "AudioCount", "1"), (_A, "Format", "ADPCM"), (_A, "Codec", "ADPCM"), (_A, "Compression_Mode", "Lossy"), (_A, "BitRate_Mode", "CBR")),
    "dolby_audio_metadata": ((_A, "Format", "Dolby Audio Metadata"), (_A, "Format_Info", "DAM")),
    "pcm_m2ts": ((_A, "Format", "PCM"), (_A, "Format_Info", "Blu-ray LPCM"), (_A, "Format_Settings_Endianness", "Big")),
    "mga": ((_A, "Format", "MPEG Audio"), (_A, "Format_Info", "MPEG-4 General Audio")),
    "pdf": ((_T, "Format", "PDF"),),
    "sdp": ((_T, "Format", "SDP"), (_T, "Format_Info", "Session Description Protocol")),
    "pac": ((_T, "Format", "PAC"), (_T, "Format_Info", "PAC subtitle format")),
    "dtvcc_transport": ((_T, "Format", "DTVCC"), (_T, "Format_Info", "Digital Television Closed Captioning")),
    "scte20": ((_T, "Format", "SCTE-20"), (_T, "Format_Info", "SCTE 20 closed captioning")),
    "eia608": ((_G, "Format", "EIA-608"), (_G, "TextCount", "1"), (_T, "Format", "EIA-608")),
    "eia708": ((_G, "Format", "EIA-708"), (_T, "Format", "EIA-708")),
    "vbi": ((_G, "Format", "VBI"),),
    "webvtt": ((_T, "Format", "WebVTT"), (_T, "MuxingMode", "WebVTT")),
    "afd_bar_data": ((_V, "Format", "AFD/Bar Data"), (_V, "Format_Info", "SMPTE 2016-1")),
    "hdr_vivid": ((_V, "Format", "HDR Vivid"), (_V, "HDR_Format", "HDR Vivid"), (_V, "Format_Info", "Chinese HDR Vivid")),
    "teletext": ((_T, "Format", "Teletext"), (_T, "MuxingMode", "Teletext")),
    "scc": ((_T, "Format", "SCC"), (_T, "MuxingMode", "SCC")),
    "7z": ((_G, "Format", "7-Zip"),),
    "ace": ((_G, "Format", "ACE"),),
}


def _constants() -> Column:
    """The fields of ``NAMES`` by parser, as one map of literals."""
    row = lambda kind, name, value: f"named_struct('kind_id', {kind}, 'pos', 0, 'name', '{name}', 'value', '{value}', 'is_extra', false)"
    return F.expr("map(" + ", ".join(f"'{n}', array({', '.join(row(*r) for r in rows)})" for n, rows in NAMES.items()) + ")")


def layout_fields(parser: Column, content: Column) -> Column:
    """The fields of a blob by its parser; null for parsers without a layout."""
    out = F.when(F.lit(False), F.array(_field(_G, "Format", "")))
    for name, layout in LAYOUTS.items():
        out = out.when(parser == name, layout(content))
    return F.coalesce(F.try_element_at(_constants(), parser), out)
