"""Scalar functions on field values, as Column expressions: derived numbers, dates, lookups and two families of display
forms (the text report's and the summary's, which differ)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language codes and names.
LANGUAGES = {
    "en": "English",
    "eng": "English",
    "es": "Spanish",
    "spa": "Spanish",
    "fr": "French",
    "fre": "French",
    "fra": "French",
    "de": "German",
    "ger": "German",
    "deu": "German",
    "it": "Italian",
    "ita": "Italian",
    "ja": "Japanese",
    "jpn": "Japanese",
    "ko": "Korean",
    "kor": "Korean",
    "zh": "Chinese",
    "chi": "Chinese",
    "zho": "Chinese",
    "ru": "Russian",
    "rus": "Russian",
    "pt": "Portuguese",
    "por": "Portuguese",
    "nl": "Dutch",
    "dut": "Dutch",
    "nld": "Dutch",
    "ar": "Arabic",
    "ara": "Arabic",
    "hi": "Hindi",
    "hin": "Hindi",
}
# Display aspect ratios.
ASPECTS = {
    "1.778": "16:9",
    "1.333": "4:3",
    "1.600": "16:10",
    "2.350": "2.35:1",
    "2.35": "2.35:1",
    "2.400": "2.40:1",
    "2.40": "2.40:1",
    "1.850": "1.85:1",
    "0.562": "9:16",
    "0.750": "3:4",
}
# Media types of containers.
CONTAINER_MIME = {
    "mp42": "video/mp4",
    "isom": "video/mp4",
    "avc1": "video/mp4",
    "qt  ": "video/quicktime",
    "3gp4": "video/3gpp",
    "mkv": "video/x-matroska",
    "matroska": "video/x-matroska",
    "webm": "video/x-matroska",
    "avi": "video/x-msvideo",
    "AVI ": "video/x-msvideo",
    "wav": "audio/wav",
    "WAVE": "audio/wav",
    "flv": "video/x-flv",
    "FLV ": "video/x-flv",
    "ogg": "audio/ogg",
    "OggS": "audio/ogg",
    "asf ": "video/x-ms-asf",
    "WMA ": "video/x-ms-asf",
    "WMV ": "video/x-ms-asf",
    "mpeg": "video/mp2t",
    "ts": "video/mp2t",
    "dvd": "video/mpeg",
    "vob": "video/mpeg",
    "heic": "image/heif",
    "mif1": "image/heif",
    "jp2 ": "image/jp2",
    "MXF ": "application/mxf",
}
# Media types of codecs.
CODEC_MIME = {
    "mp4a": "audio/mp4",
    "avc1": "video/H264",
    "avc3": "video/H264",
    "h264": "video/H264",
    "hvc1": "video/H265",
    "hev1": "video/H265",
    "h265": "video/H265",
    "av01": "video/AV1",
    "vp09": "video/VP9",
    "vp9 ": "video/VP9",
    "vp8 ": "video/VP9",
    "mp3 ": "audio/mpeg",
    "aac ": "audio/aac",
    "AAC ": "audio/aac",
    "ac-3": "audio/ac3",
    "ac3 ": "audio/ac3",
    "ec-3": "audio/eac3",
    "eac3": "audio/eac3",
    "dts ": "audio/dts",
    "dtsc": "audio/dts",
    "flac": "audio/flac",
    "opus": "audio/opus",
    "vorb": "audio/vorbis",
    "theo": "video/theora",
    "jpeg": "image/jpeg",
    "png ": "image/png",
}
# Other spellings of field names and what they stand for.
ALIASES = {
    "WritingApplication": "Encoded_Application",
    "Writing_Application": "Encoded_Application",
    "WritingLibrary": "Encoded_Library",
    "Writing_Library": "Encoded_Library",
    "MimeType": "InternetMediaType",
    "ColorPrimaries": "colour_primaries",
    "Color_primaries": "colour_primaries",
    "TransferCharacteristics": "transfer_characteristics",
    "Transfer_Characteristics": "transfer_characteristics",
    "MatrixCoefficients": "matrix_coefficients",
    "Matrix_Coefficients": "matrix_coefficients",
    "ColorRange": "colour_range",
    "Range": "colour_range",
    "Coded_Width": "Sampled_Width",
    "Stored_Width": "Sampled_Width",
    "Coded_Height": "Sampled_Height",
    "Stored_Height": "Sampled_Height",
    "Codec_Profile": "Format_Profile",
    "Codec_Level": "Format_Level",
    "Resolution": "BitDepth",
    "Channel(s)": "Channels",
    "Channel_s_": "Channels",
    "Channel_Layout": "ChannelLayout",
    "PixelFormat": "Format_Settings_CABAC",
    "Colorimetry": "Format_Settings_CABAC",
    "FrameRate_Original": "FrameRate",
    "FrameRate_Nominal": "FrameRate",
    "BitRate_Nominal": "BitRate",
    "Video_Delay": "Delay",
    "Video0_Delay": "Delay",
    "Format_Settings/String": "Format_Settings",
    "Format_Settings_Encoding": "Format_Settings",
    "Codec": "CodecID",
    "Track": "Title",
    "Source_FrameCount": "FrameCount",
    "Sampling_Rate": "SamplingRate",
    "SampleRate": "SamplingRate",
    "ImageLength": "ImageHeight",
}
# Level index: name, most luma samples a picture, most luma samples a second.
AV1_LEVELS = (
    ("2.0", 147456, 4915200), ("2.1", 262144, 8847360), ("3.0", 491520, 16515072), ("3.1", 1048576, 35389440), ("4.0", 2088960, 69632000), ("4.1", 2088960, 139264000), ("5.0", 8912896, 297096000),
    ("5.1", 8912896, 594192000), ("5.2", 8912896, 1188384000), ("5.3", 8912896, 1980640000), ("6.0", 35651584, 1188384000), ("6.1", 35651584, 2376768000), ("6.2", 35651584, 4753536000), ("6.3", 35651584, 7922560000),
)


def lookup(key: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = F.try_element_at(F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")"), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places; exact ties go to the even digit."""
    return F.call_function("format_number", value.cast("double"), F.lit("0" + ("." + "0" * digits if digits else "")))


def duration_ms(samples: Column, rate: Column) -> Column:
    """Samples at a rate as milliseconds, rounded half up; 0 if the rate is 0."""
    whole = F.call_function("div", samples * 1000 + F.call_function("div", rate, F.lit(2)), F.when(rate > 0, rate))
    return F.when(rate > 0, whole).otherwise(F.lit(0))


def three_figures(value: Column) -> Column:
    return F.when(value >= 100, fixed(value, 0)).when(value >= 10, fixed(value, 1)).otherwise(fixed(value, 2))


def text_size(size: Column) -> Column:
    """512 Bytes, 1.50 KiB, 12.3 MiB, 256 GiB."""
    b = size.cast("double")
    out = F.concat(size.cast("string"), F.lit(" Bytes"))
    for unit, power in (("KiB", 1), ("MiB", 2), ("GiB", 3)):
        out = F.when(b >= 1024.0**power, F.concat(three_figures(b / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def text_size_with_share(size: Column, whole: Column) -> Column:
    share = F.concat(text_size(size), F.lit(" ("), F.round(size * 100.0 / whole).cast("long").cast("string"), F.lit("%)"))
    return F.when(whole > 0, share).otherwise(text_size(size))


def milliseconds(raw: Column) -> Column:
    """Integer text is milliseconds, other numbers are seconds."""
    return F.coalesce(raw.try_cast("long"), F.round(raw.try_cast("double") * 1000).cast("long"))


def text_duration(raw: Column) -> Column:
    """1 h 2 min, 3 min 29 s, 29 s, 95 ms; what isn't a number stays as it is."""
    ms = milliseconds(raw)
    s = F.call_function("div", ms, F.lit(1000))
    h, m, rest = F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60)), s % 60
    out = F.when(h > 0, F.concat_ws(" ", h, F.lit("h"), m, F.lit("min"))).when(m > 0, F.concat_ws(" ", m, F.lit("min"), rest, F.lit("s")))
    out = out.when(rest > 0, F.concat_ws(" ", rest, F.lit("s"))).otherwise(F.concat_ws(" ", ms % 1000, F.lit("ms")))
    return F.when(ms.isNull(), raw).otherwise(out)


def text_delay(raw: Column) -> Column:
    return F.concat(F.coalesce(milliseconds(raw), F.lit(0)).cast("string"), F.lit(" ms"))


def text_bitrate(bps: Column) -> Column:
    kb = bps / 1000.0
    return F.when(kb >= 1000, F.concat(three_figures(kb / 1000.0), F.lit(" Mb/s"))).otherwise(F.concat(three_figures(kb), F.lit(" kb/s")))


def text_sampling_rate(hz: Column) -> Column:
    khz = hz / 1000.0
    whole = F.round((khz - F.floor(khz)) * 100) % 100 == 0
    return F.concat(F.when(whole, fixed(khz, 1)).otherwise(F.regexp_replace(fixed(khz, 3), r"\.?0+$", "")), F.lit(" kHz"))


def thousands(raw: Column) -> Column:
    """Groups of three characters from the right, with spaces between."""
    return F.reverse(F.trim(F.regexp_replace(F.reverse(raw), "(.{3})", "$1 ")))


def display_aspect(raw: Column) -> Column:
    return lookup(raw, ASPECTS, raw)


def language_name(code: Column) -> Column:
    return lookup(code, LANGUAGES, code)


def rate_mode_word(raw: Column) -> Column:
    return lookup(raw, {"CFR": "Constant", "CBR": "Constant", "VFR": "Variable", "VBR": "Variable"}, raw)


def container_mime(code: Column) -> Column:
    return lookup(code, CONTAINER_MIME)


def codec_mime(fourcc: Column) -> Column:
    return lookup(fourcc, CODEC_MIME)


def field_alias(name: Column) -> Column:
    return lookup(name, ALIASES, name)


def summary_size(size: Column) -> Column:
    b = size.cast("double")
    out = F.concat(size.cast("string"), F.lit(" Bytes"))
    for unit, power in (("KiB", 1), ("MiB", 2), ("GiB", 3), ("TiB", 4)):
        out = F.when(b >= 1024.0**power, F.concat(fixed(b / 1024.0**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def summary_duration(ms: Column) -> Column:
    s = F.call_function("div", ms, F.lit(1000))
    m = F.call_function("div", s, F.lit(60))
    h = F.call_function("div", m, F.lit(60))
    out = F.when(ms < 1000, F.concat_ws(" ", ms, F.lit("ms"))).when(h > 0, F.concat_ws(" ", h, F.lit("h"), m % 60, F.lit("m"), s % 60, F.lit("s")))
    return out.when(m > 0, F.concat_ws(" ", m, F.lit("m"), s % 60, F.lit("s"))).otherwise(F.concat_ws(" ", s, F.lit("s")))


def summary_bitrate(bps: Column) -> Column:
    return F.when(bps >= 1_000_000, F.concat(fixed(bps / 1e6, 2), F.lit(" Mb/s"))).when(bps >= 1000, F.concat(fixed(bps / 1e3, 2), F.lit(" kb/s"))).otherwise(F.concat(bps.cast("string"), F.lit(" b/s")))


def _civil(unix_seconds: Column) -> Column:
    """Date and time. Spark puts a plus before years of more than four digits, which is no part of them."""
    return F.ltrim(F.date_format(F.timestamp_seconds(unix_seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


def utc_text(unix_seconds: Column) -> Column:
    """Needs a session in UTC."""
    return F.concat(_civil(unix_seconds), F.lit(" UTC"))


def local_text(unix_seconds: Column, offset_seconds: int) -> Column:
    return _civil(unix_seconds + offset_seconds)


def mp4_date(seconds_since_1904: Column) -> Column:
    return F.when(seconds_since_1904 > 0, utc_text(seconds_since_1904 - 2082844800))


def timecode_ms(raw: Column, fps: Column) -> Column:
    """hh:mm:ss:ff or hh:mm:ss;ff at whole frames a second as milliseconds, without drop-frame compensation."""
    m = [F.regexp_extract(raw, r"^(\d+):(\d+):(\d+)[:;](\d+)$", k).try_cast("long") for k in (1, 2, 3, 4)]
    frames = (m[0] * 3600 + m[1] * 60 + m[2]) * fps + m[3]
    return F.call_function("div", frames * 1000, F.when(fps > 0, fps.cast("long")))


def bits_pixel_frame(width: Column, height: Column, rate: Column, bps: Column) -> Column:
    ok = (width > 0) & (height > 0) & (rate > 0) & (bps > 0)
    return F.when(ok, fixed(bps / (width * height * rate), 3))


def compression_ratio(is_audio: Column, size: Column, seconds: Column, channels: Column, depth: Column, sampling: Column, bps: Column) -> Column:
    """From parsed numbers that may be null; seconds is the raw Duration, in whatever unit its parser wrote."""
    t = F.when(seconds > 0, (seconds * 1000).cast("long"))
    audio = F.call_function("div", F.call_function("div", F.coalesce(channels, F.lit(1)) * sampling * F.coalesce(depth, F.lit(8)) * t, F.lit(8)), F.lit(1000))
    other = F.call_function("div", F.call_function("div", bps * t, F.lit(8)), F.lit(1000))
    plain = F.when(is_audio & (sampling > 0), audio).when(bps > 0, other)
    return F.when((size > 0) & (plain > 0), fixed(plain / size.cast("double"), 3))


def av1_level(width: Column, height: Column, rate: Column) -> Column:
    """Name of the lowest level whose limits hold a picture of the larger side by 9/16 of it, both rounded up to 16; null
    if none does."""
    up = lambda x: F.ceil(x / 16.0) * 16
    side = F.greatest(width, height)
    pixels = up(side) * up(F.ceil(side * 9 / 16.0))
    levels = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("long").alias("p"), F.lit(s).cast("long").alias("s")) for n, p, s in AV1_LEVELS])
    return F.try_element_at(F.filter(levels, lambda v: (pixels <= v["p"]) & (pixels * rate <= v["s"])), F.lit(1))["name"]


def snap_frame_rate(rate: Column) -> Column:
    """The first standard rate within half a per cent, else the rate."""
    standard = (15, 23.976, 24, 25, 29.97, 30, 47.952, 48, 50, 59.94, 60, 100, 119.88, 120)
    return F.coalesce(*[F.when(F.abs(rate - s) / s < 0.005, F.lit(float(s))) for s in standard], rate)


def scan_order(top: Column, bottom: Column, progressive: Column) -> Column:
    """From counts of fields by kind."""
    return F.when((top > 0) & (bottom > 0), "Mixed").when(top > 0, "TFF").when(bottom > 0, "BFF").when(progressive > 0, "Progressive")


def xml_text(raw: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), raw)


def csv_cell(raw: Column) -> Column:
    return F.when(raw.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(raw, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(raw)
