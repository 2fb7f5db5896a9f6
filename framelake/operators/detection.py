"""Format detection: the gates, in a fixed order, that a blob passes, as one Catalyst expression.

Gates look at fixed offsets, or at the first KiBs as text. A gate says what a blob may be; where its parser has to walk the
blob, the parser decides, and the next gate is asked if it rejects. So detection is a list of candidates up to the first one
that needs no walk. Two policies: ``compat`` keeps the historic order, in which some gates that accept nearly anything
stand before others; ``sane`` leaves those out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.binary import at, be, le, magic

HEAD = 1024
Gate = Callable[[Column, Column], Column]


class Marks:
    """A gate that wants fixed bytes: all marks of one of the alternatives, in a blob of ``least`` bytes or more."""

    def __init__(self, *alternatives: tuple[tuple[int, bytes], ...], least: int = 1):
        self.alternatives, self.least = alternatives, least


class Text:
    """A gate that reads the head as text. It is only tried on blobs whose first byte may begin such a text."""

    def __init__(self, gate: Gate):
        self.gate = gate


#: Blanks, a byte order mark, and the characters that the text gates' formats begin with.
TEXT_STARTS = tuple(b"\t\n\x0b\x0c\r \xef<#[0123456789vWIMH")


def _m(*marks: tuple[int, bytes]) -> Marks:
    return Marks(marks)


def _any(*gates: Marks) -> Marks:
    return Marks(*[a for g in gates for a in g.alternatives])


def _long(gate: Marks | Text, least: int) -> Marks | Text:
    if isinstance(gate, Marks):
        return Marks(*gate.alternatives, least=least)
    return Text(lambda c, text: (F.octet_length(c) >= least) & gate.gate(c, text))


def _four(*codes: str, offset: int = 0) -> Marks:
    return Marks(*[((offset, c.encode("latin-1")),) for c in codes])


def _root(names: str, *needs: str) -> Text:
    """XML whose root element has one of the names, after declaration, comments and doctype, and whose head holds one of
    the needed strings."""
    pattern = rf"(?s)^(?:\xEF\xBB\xBF)?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![^>]*>\s*)*<(?:{names})[\s/>]"

    def run(c: Column, text: Column) -> Column:
        out = text.rlike(pattern)
        if needs:
            out = out & text.rlike("|".join(re.escape(n) for n in needs))
        return out

    return Text(run)


def _rlike(pattern: str) -> Text:
    return Text(lambda c, text: text.rlike(pattern))


def _starts(c: Column, text: Column) -> Column:
    """A start code at the front."""
    return magic(c, (0, b"\0\0\0\1")) | magic(c, (0, b"\0\0\1"))


def _holds(mark: bytes, within: int) -> Gate:
    return lambda c, text: F.contains(F.substring(c, 1, within), F.lit(bytearray(mark)))


def _byte(at_: int, low: int, high: int) -> Gate:
    return lambda c, text: be(c, at_, 1).between(low, high)


def _both(*gates: Gate) -> Gate:
    def run(c: Column, text: Column) -> Column:
        out = gates[0](c, text)
        for g in gates[1:]:
            out = out & g(c, text)
        return out

    return run


def _least(size: int) -> Gate:
    return lambda c, text: F.octet_length(c) >= size


def _bits(at_: int, shift: int, mask: int, *values: int) -> Gate:
    """Some bits of a byte have one of the values."""
    return lambda c, text: F.shiftright(be(c, at_, 1), shift).bitwiseAND(F.lit(mask)).isin(*values)


def _vp8(c: Column, text: Column) -> Column:
    return (F.octet_length(c) >= 10) & ((be(c, 0, 1) >= 128) | magic(c, (3, b"\x9d\x01\x2a")))


def _tar(c: Column, text: Column) -> Column:
    """The mark, or digits where a header without one has the sum of its bytes."""
    digits = F.decode(F.substring(c, 149, 8), "ISO-8859-1").rlike(r"^\s*[0-7]+[\s\x00]*$")
    return (F.octet_length(c) >= 512) & (magic(c, (257, b"ustar")) | digits)


def _sub_rip(c: Column, text: Column) -> Column:
    return (F.octet_length(c) >= 16) & F.substring(text, 1, 512).rlike(r"^(?:\xEF\xBB\xBF)?\s*\d+[ \t]*\r?\n\s*\d+:\d\d:\d\d[,.]\d+\s*-->\s*\d+:\d\d:\d\d[,.]\d+")


def _any_bytes(c: Column, text: Column) -> Column:
    return F.octet_length(c) > 0


# Place in the historic order, name, and the marks of each format.
GATES: tuple[tuple[int, str, Marks | Text | Gate], ...] = (
    (0, "wav", _any(_m((0, b"RIFF"), (8, b"WAVE")), _m((0, b"RF64"), (8, b"WAVE")))),
    (1, "avi", _m((0, b"RIFF"), (8, b"AVI "))),
    (2, "cdxa", _m((0, b"RIFF"), (8, b"CDXA"), (12, b"fmt "))),
    (3, "amv", _m((0, b"RIFF"), (8, b"AMV "))),
    (4, "webp", _m((0, b"RIFF"), (8, b"WEBP"))),
    (5, "jp2", _any(_m((0, b"\xff\x4f")), _m((0, b"\x00\x00\x00\x0cjP  \r\n\x87\n")))),
    (6, "aiff", _any(_m((0, b"FORM"), (8, b"AIFF")), _m((0, b"FORM"), (8, b"AIFC")))),
    (7, "flac", _m((0, b"fLaC"))),
    (8, "dsdiff", _m((0, b"FRM8"), (12, b"DSD "))),
    (9, "caf", _m((0, b"caff"), (8, b"desc"))),
    (10, "mp4", _m((4, b"ftyp"))),
    (11, "mkv", _m((0, b"\x1a\x45\xdf\xa3"))),
    (12, "ogg", _m((0, b"OggS"))),
    (13, "mpeg_ts", lambda c, text: magic(c, *[(188 * k, b"\x47") for k in range(16)]) | magic(c, *[(4 + 192 * k, b"\x47") for k in range(16)]) | magic(c, *[(204 * k, b"\x47") for k in range(16)])),
    (14, "mpeg_ps", lambda c, text: magic(c, (0, b"\x00\x00\x01")) & (be(c, 3, 1).between(0xC0, 0xEF) | be(c, 3, 1).isin(0xBA, 0xBD, 0xFA, 0xFD, 0xFE))),
    (15, "swf", _four("FWS", "CWS", "ZWS")),
    (16, "skm", _four("DMSKM")),
    (17, "dpg", lambda c, text: magic(c, (0, b"DPG")) & be(c, 3, 1).between(48, 57)),
    (18, "hds_f4m", _root("manifest", "http://ns.adobe.com/f4m/1.0")),
    (19, "hls", _long(_rlike(r"^#EXTM3U\r?\n"), 10)),
    (20, "dash_mpd", _root("MPD", "urn:mpeg:dash:schema:mpd", "urn:3GPP:ns:PSS:AdaptiveHTTPStreaming")),
    (21, "dcp_am", _root("AssetMap", "PROTO-ASDCP-AM", "smpte-ra.org/schemas/429-9")),
    (22, "dcp_cpl", _root("CompositionPlaylist", "PROTO-ASDCP-CPL", "smpte-ra.org/schemas/")),
    (23, "dcp_pkl", _root("PackingList", "PROTO-ASDCP-PKL", "smpte-ra.org/schemas/")),
    (24, "ibi", _m((0, b"\x1a\x45\xdf\xa3"))),
    (25, "dxw", _root("indexFile", "urn:digimetrics-xml-wrapper")),
    (26, "aaf", _m((0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), (8, b"\x41\x41\x46\x42\x0d\x00\x4f\x4d"))),
    (27, "mxf", _both(_least(16), _holds(b"\x06\x0e\x2b\x34", 4096))),
    (28, "bdmv", _rlike(r"^(INDX|MOBJ|MPLS|HDMV)\d{4}")),
    (29, "dvdv", _four("DVDVIDEO-VMG", "DVDVIDEO-VTS")),
    (30, "dv_dif", _both(_least(640), _byte(0, 0, 31), _byte(80, 32, 63), _byte(160, 32, 63), _byte(240, 64, 95), _byte(480, 96, 127), _byte(560, 128, 159))),
    (31, "flv", _m((0, b"FLV\x01"))),
    (32, "lxf", _m((0, b"LEITCH\x00\x00"))),
    (33, "nut", _m((0, b"nut/multimedia container\x00"))),
    (34, "wm", _m((0, bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")))),
    (35, "wtv", _m((0, bytes.fromhex("b7d800203749da11a64e0007e95ead8d")))),
    (36, "rm", _four(".RMF")),
    (37, "ivf", _four("DKIF")),
    (38, "ism", _root("smil|SmoothStreamingMedia|ism:SmoothStreamingMedia")),
    (39, "mi_xml", _root("MediaInfo", "mediaarea.net/mediainfo")),
    (40, "p2_clip", _root("P2Main")),
    (41, "xdcam_clip", _root("NonRealTimeMeta")),
    (42, "sequence_info", _root(r"(?:[\w.-]+:)?SequenceInfo")),
    (43, "ptx", _m((0, b"\x030010111100101011"))),
    (44, "nsv", _four("NSVf", "NSVs")),
    (45, "pmp", _four("pmpm")),
    (46, "gxf", _m((0, b"\x00\x00\x00\x00\x01\xbc"), (14, b"\xe1\xe2"))),
    (47, "scte35", _both(_least(14), _byte(0, 0xFC, 0xFC))),
    (48, "cdp", _m((0, b"\x96\x69"))),
    (49, "pgs", lambda c, text: magic(c, (0, b"PG")) & be(c, 10, 1).isin(0x14, 0x15, 0x16, 0x17, 0x80)),
    (50, "dvb_subtitle", _any(_m((0, b"\x20\x00\x0f")), _m((0, b"\x20\x00\xff")))),
    (51, "arib_std_b24_b37", lambda c, text: (F.shiftright(be(c, 0, 1), 2).bitwiseAND(F.lit(31)) <= 8) & (be(c, 3, 2) >= 1) & (be(c, 3, 2) + 7 <= F.least(F.octet_length(c), F.lit(4096)))),
    (52, "kate", _long(_m((0, b"\x80kate\x00\x00\x00")), 64)),
    (53, "cmml", _root("cmml")),
    (54, "ttml", _root("tt", "http://www.w3.org/ns/ttml")),
    (55, "n19", _m((3, b"STL"))),
    (56, "sub_rip", Text(_sub_rip)),
    (57, "other_text", _long(_rlike(r"^(\[Script Info\]|<SAMI>|00:|-->> 0|\*|~CPC)"), 0x200)),
    (58, "dsf", _m((0, b"DSD "), (28, b"fmt "))),
    (59, "png", _m((0, b"\x89PNG\r\n\x1a\n"), (12, b"IHDR"))),
    (60, "jpeg", _m((0, b"\xff\xd8\xff"))),
    (61, "bmp", _long(_m((0, b"BM")), 30)),
    (62, "gif", _long(_four("GIF87a", "GIF89a"), 10)),
    (63, "cr2", _m((0, b"II*\x00"), (8, b"CR"))),
    (64, "raf", _four("FUJIFILM")),
    (65, "tiff", _any(_m((0, b"II*\x00")), _m((0, b"MM\x00*")))),
    (66, "ico", lambda c, text: magic(c, (0, b"\x00\x00")) & le(c, 2, 2).isin(1, 2) & le(c, 4, 2).between(1, 255) & (le(c, 18, 4) >= 6 + 16 * le(c, 4, 2))),
    (67, "psd", _any(_m((0, b"8BPS\x00\x01")), _m((0, b"8BPS\x00\x02")))),
    (68, "dpx", _long(_four("SDPX", "XPDS", "\x80\x2a\x5f\xd7", "\xd7\x5f\x2a\x80"), 32)),
    (69, "dds", lambda c, text: magic(c, (0, b"DDS ")) & (le(c, 4, 4) >= 124)),
    (70, "exr", _m((0, b"\x76\x2f\x31\x01"))),
    (71, "bpg", _m((0, b"BPG\xfb"))),
    (72, "pcx", lambda c, text: magic(c, (0, b"\x0a"), (2, b"\x01")) & (be(c, 1, 1) <= 5) & be(c, 3, 1).isin(1, 4, 8, 24)),
    (73, "arriraw", _m((0, b"ARRI\x12\x34\x56\x78"))),
    (74, "amiga_icon", _long(_m((0, b"\xe3\x10")), 78)),
    (75, "y4m", _four("YUV4MPEG2 ")),
    (76, "vc1", _four("\x00\x00\x01\x0f", "\x00\x00\x01\x0e", "\x00\x00\x01\x0d")),
    (77, "mpeg2", _m((0, b"\x00\x00\x01\xb3"))),
    (78, "av1", lambda c, text: be(c, 0, 1).isin(8, 10, 12, 14, 16, 18, 20, 22)),
    (79, "apv", _m((4, b"aPv1"))),
    (80, "avc", _starts),
    (81, "hevc", _starts),
    (82, "vp8", _vp8),
    (83, "vp9", _both(_least(6), _byte(0, 128, 191))),
    (84, "theora", _m((0, b"\x80theora"))),
    (85, "ffv1", _four("FFV1")),
    (86, "h263", lambda c, text: be(c, 0, 4).between(0x20000, 0x203FF)),
    (87, "mpeg4v", lambda c, text: magic(c, (0, b"\x00\x00\x01")) & (be(c, 3, 1).between(0xB0, 0xB7) | be(c, 3, 1).between(0x20, 0x2F))),
    (88, "aic", _any(_four("AIC "), _four("aic ", offset=4))),
    (89, "avs", _four("AVS ")),
    (90, "avs3", _four("AVS3", "\x00\x00\x01\xb0")),
    (91, "canopus", _four("CHQX", "CHQH", "CHQS", "CHQL", offset=4)),
    (92, "cineform", _four("CFHD")),
    (93, "dirac", _four("BBCD")),
    (94, "flic", _any(_m((4, b"\x11\xaf")), _m((4, b"\x12\xaf")))),
    (95, "fraps", _four("FPS1")),
    (96, "huffyuv", _four("HFYU")),
    (97, "lagarith", _four("LAGS")),
    (98, "ac3", _m((0, b"\x0b\x77"))),
    (99, "ac4", _any(_m((0, b"\xac\x40")), _m((0, b"\xac\x41")))),
    (100, "dts", _m((0, b"\x7f\xfe\x80\x01"))),
    (101, "dts_uhd", _m((0, b"\x40\x41\x1b\xf2"))),
    (102, "aac_adts", lambda c, text: magic(c, (0, b"\xff")) & (be(c, 1, 1) >= 0xF0) & (F.shiftright(be(c, 2, 1), 2).bitwiseAND(F.lit(15)) < 13)),
    (103, "iab", _both(_least(11), _byte(0, 1, 1))),
    (104, "iamf", _both(_byte(0, 0xF8, 0xFF), _holds(b"iamf", 64))),
    (105, "als", _m((0, b"ALS\x00"))),
    (106, "ape", _four("MAC ", "MACF")),
    (107, "au", _long(_four(".snd"), 24)),
    (108, "amr", _four("#!AMR")),
    (109, "speex", _long(_four("Speex   "), 80)),
    (110, "mpc", _long(_four("MP+"), 25)),
    (111, "la", _long(_four("LA"), 45)),
    (112, "tak", _four("tBaK")),
    (113, "tta", _long(_four("TTA1"), 22)),
    (114, "wvpk", _long(_four("wvpk"), 32)),
    (115, "twin_vq", _four("TWIN")),
    (116, "extended_module", _m((0, b"Extended Module: "), (37, b"\x1a"))),
    (117, "dat", _both(_least(5822), _bits(5820, 6, 3, 0), _bits(5820, 2, 3, 0, 1, 2), _bits(5820, 0, 3, 0, 1), _bits(5821, 6, 3, 0, 1))),
    (118, "rkau", _four("RKA")),
    (119, "aptx100", _both(_least(92), lambda c, text: magic(c, (76, b"\x00\x00")))),
    (120, "open_mg", _four("EA3", "ea3")),
    (121, "midi", _four("MThd")),
    (122, "module", _four("M.K.", "M!K!", "FLT4", "FLT8", "6CHN", "8CHN", offset=1080)),
    (123, "impulse_tracker", _long(_four("IMPM"), 192)),
    (124, "scream_tracker3", _m((28, b"\x1a"), (44, b"SCRM"))),
    (125, "mp3", lambda c, text: magic(c, (0, b"ID3")) | (magic(c, (0, b"\xff")) & (be(c, 1, 1) >= 0xE0) & (be(c, 1, 1).bitwiseAND(F.lit(6)) != 0))),
    (126, "celt", _four("CELT")),
    (127, "dolby_e", _four("\x96\x69\x07\x8e", "\x96\x6a\x07\x8e")),
    (128, "mpegh3da", lambda c, text: (be(c, 0, 4) >= 12) & (magic(c, (4, b"mhm1")) | magic(c, (4, b"mha1")))),
    (129, "mpc_sv8", _four("MPCK")),
    (130, "ps2_audio", _four("SSmp", "VSab", "VSaf")),
    (131, "truehd", _four("\xf8\x72\x6f\xba", "\xf8\x72\x6f\xbb")),
    (132, "smpte_st0302", _long(_m((0, b"\xf8\x72")), 4)),
    (133, "smpte_st0331", _m((0, b"\x96\x69"))),
    (134, "smpte_st0337", lambda c, text: magic(c, (0, b"\xf8\x72")) & (be(c, 3, 1).bitwiseAND(F.lit(31)) >= 1)),
    (135, "channel_grouping", _four("CHGR")),
    (136, "channel_splitting", _four("CHSP")),
    (137, "tga", _both(_least(18), lambda c, text: be(c, 1, 1).isin(0, 1) & be(c, 2, 1).isin(1, 2, 3, 9, 10, 11, 32, 33) & be(c, 16, 1).isin(8, 16, 24, 32))),
    (138, "gain_map", _long(_m((0, b"\x00\x00\x00")), 5)),
    (139, "rle", _any_bytes),
    (140, "adpcm", _any_bytes),
    (141, "adm", lambda c, text: F.contains(F.substring(c, 1, 1 << 16), F.lit(bytearray(b"axml"))) | F.contains(F.substring(c, 1, 1 << 16), F.lit(bytearray(b"ADM ")))),
    (142, "dolby_audio_metadata", _any(_m((0, b"RIFF"), (8, b"DAM ")), _m((0, b"RIFF"), (8, b"DAMG")))),
    (143, "pcm", lambda c, text: (F.octet_length(c) >= 16) & le(c, 0, 2).isin(1, 0xFFFE)),
    (144, "pcm_vob", lambda c, text: F.contains(F.substring(c, 1, 64), F.lit(bytearray(b"DVD "))) | F.contains(F.substring(c, 1, 64), F.lit(bytearray(b"LPCM")))),
    (145, "pcm_m2ts", _four("HDMV")),
    (146, "mga", _four("MGA ")),
    (147, "aac", lambda c, text: (F.octet_length(c) >= 4) & magic(c, (0, b"\xff")) & (be(c, 1, 1) >= 0xF0)),
    (148, "pdf", _four("%PDF-")),
    (149, "sdp", Text(lambda c, text: text.startswith("v=0") & text.contains("m="))),
    (150, "pac", _four("PAC ", "PAC\x00")),
    (151, "dtvcc_transport", _m((0, b"\x03\x00"))),
    (152, "scte20", _four("SCTE", "scte")),
    (153, "eia608", _any_bytes),
    (154, "eia708", _any_bytes),
    (155, "vbi", _any_bytes),
    (156, "webvtt", _rlike(r"^(?:\xEF\xBB\xBF)?WEBVTT")),
    (157, "vvc", _starts),
    (158, "prores", _long(_four("icpf", "apcn", "apcs", "apco", "ap4h", "prrf", offset=4), 21)),
    (159, "vc3", _long(_four("\x00\x00\x02\x80"), 44)),
    (160, "dolby_vision", Text(lambda c, text: text.rlike(r"^\s*<") & F.contains(F.substring(c, 1, 1 << 16), F.lit(bytearray(b"DolbyVision"))))),
    (161, "afd_bar_data", _four("AFBd", "BARD")),
    (162, "hdr_vivid", _four("HDRV", "HVIV")),
    (163, "opus", _long(_four("OpusHead"), 19)),
    (164, "vorbis", _long(_m((0, b"\x01vorbis")), 30)),
    (165, "usac", lambda c, text: (F.octet_length(c) >= 5) & magic(c, (0, b"\xff")) & (be(c, 1, 1) >= 0xF0) & (be(c, 1, 1).bitwiseAND(F.lit(6)) == 0)),
    (166, "teletext", _m((0, b"\x55\x55\x27"))),
    (167, "scc", _four("Scenarist_SCC V1.0")),
    (168, "timed_text", lambda c, text: (be(c, 0, 2) >= 1) & (be(c, 0, 2) + 2 <= F.octet_length(c))),
    (169, "zip", _four("PK\x03\x04", "PK\x01\x02", "PK\x05\x06")),
    (170, "rar", _four("Rar!")),
    (171, "7z", _m((0, b"7z\xbc\xaf\x27\x1c"))),
    (172, "tar", _tar),
    (173, "gzip", _m((0, b"\x1f\x8b"))),
    (174, "bzip2", _four("BZh")),
    (175, "iso9660", _m((0x8001, b"CD001"))),
    (176, "elf", _m((0, b"\x7fELF"))),
    (177, "mach_o", _any(*[_m((0, bytes.fromhex(x))) for x in ("feedface", "cefaedfe", "feedfacf", "cffaedfe", "bebafeca")])),
    (178, "mz_exe", _four("MZ")),
    (179, "ace", _four("**ACE**")),
)
#: Gates that accept nearly anything, or much plain text; the sane policy leaves them out.
PERMISSIVE = frozenset(("vp8", "gain_map", "rle", "adpcm", "eia608", "eia708", "vbi", "dat", "timed_text", "adm", "pcm_vob"))


def _row(idx: int, least: int, marks: tuple[tuple[int, bytes], ...]) -> str:
    """SQL of a literal; one expression to parse costs less than a call for each of its parts."""
    parts = ", ".join(f"named_struct('at', {o}, 'size', {len(m)}, 'bytes', X'{m.hex()}')" for o, m in marks)
    return f"named_struct('idx', {idx}, 'least', {least}, 'marks', array({parts}))"


def _gates(policy: str) -> list[tuple[int, str, Marks | Text | Gate]]:
    if policy not in ("compat", "sane"):
        raise ValueError(f"unknown policy {policy}")
    return [g for g in GATES if policy == "compat" or g[1] not in PERMISSIVE]


def with_candidates(rows: DataFrame, policy: str = "compat") -> DataFrame:
    """``rows`` (content, plain, ...) with tried: the names of the gates that accept the blob, in their order, up to the first whose
    parser needs no walk; empty for an empty blob, null for a null one.

    What gates find is a column of its own first, in compiled code; gates of fixed bytes at the front, most of them, are found
    in a map by four bytes. The few that met are sorted out after that. Where ``plain`` holds, the blob is settled and no gate
    is asked."""
    from framelake.operators.registry import IN_LAYOUTS, KERNELS

    gates, content = _gates(policy), F.col("content")
    text = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")  # marks are ASCII, so any bytes may be read so
    by_start: dict[bytes, list[str]] = {}
    others: list[Column] = []
    met = lambda condition, i: F.when(F.coalesce(condition, F.lit(False)), F.lit(i))
    for i, _, g in gates:
        for a in g.alternatives if isinstance(g, Marks) else ():
            if a[0][0] == 0 and len(a[0][1]) >= 4:
                by_start.setdefault(a[0][1][:4], []).append(_row(i, g.least, a))
            else:
                others.append(met(magic(content, *a) & (F.octet_length(content) >= g.least), i))
    starts = F.expr("map(" + ", ".join(f"X'{k.hex()}', array({', '.join(found)})" for k, found in by_start.items()) + ")")
    texts = F.when(be(content, 0, 1).isin(*TEXT_STARTS), F.array(*[met(g.gate(content, text), i) for i, _, g in gates if isinstance(g, Text)]))
    computed = F.array(*others, *[met(g(content, text), i) for i, _, g in gates if not isinstance(g, (Marks, Text))])
    own = [F.col(f"`{c}`") for c in rows.columns]
    # A function with a lambda keeps Spark from fusing this step with others to one method, of some 63 KB of bytecode, which the JVM
    # would interpret for every row, plain ones included, as it compiles none of more than 8 KB.
    plain = F.exists(F.array("plain"), lambda x: x)
    found = rows.select(*own, F.struct(plain.alias("plain"), *[F.when(~F.col("plain"), c).alias(n) for n, c in (("starts", F.try_element_at(starts, F.substring(content, 1, 4))), ("computed", computed), ("texts", texts))]).alias("_gates"))
    none = F.array().cast("array<int>")
    fits = lambda r: (F.octet_length(content) >= r["least"]) & F.forall(r["marks"], lambda m: F.substring(content, m["at"] + 1, m["size"]) == m["bytes"])
    front = F.when(F.col("_gates.starts").isNotNull(), F.transform(F.filter("_gates.starts", fits), lambda r: r["idx"])).otherwise(none)
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(front, F.coalesce("_gates.computed", none), F.coalesce("_gates.texts", none)))))
    found = found.select(*own, F.explode(F.array(F.when(F.col("_gates.plain"), none).when(F.octet_length(content) > 0, every).when(content.isNotNull(), none))).alias("_every"))
    walked = [i for i, n, _ in gates if n in KERNELS and n not in IN_LAYOUTS]
    settled = F.array_min(F.filter("_every", lambda i: ~i.isin(*walked)))
    return found.select(*own, names(F.filter("_every", lambda i: i <= F.coalesce(settled, i))).alias("tried"))


def kernel_order(policy: str = "compat") -> list[str]:
    """The parsers that walk, in the order of detection."""
    from framelake.operators.registry import KERNELS

    return [n for _, n, _ in _gates(policy) if n in KERNELS]


def names(indexes: Column) -> Column:
    """The names of gates by their indexes."""
    table = F.expr("map(" + ", ".join(f"{i}, '{n}'" for i, n, _ in GATES) + ")")
    return F.transform(indexes, lambda i: F.element_at(table, i))


def index_of(name: Column) -> Column:
    return F.try_element_at(F.expr("map(" + ", ".join(f"'{n}', {i}" for i, n, _ in GATES) + ")"), name)


def detected(files: DataFrame, policy: str = "compat") -> DataFrame:
    """(path, content, ...) to (path, parser, parser_idx, ok): the first parser that accepts each blob, its own verdict
    where it has to walk the blob. Blobs whose first candidate needs no walk never reach Python."""
    from framelake.operators.parsing import parsed

    rows = parsed(files, policy).select("path", "parser", index_of(F.col("parser")).alias("parser_idx"))
    return rows.withColumn("ok", F.col("parser").isNotNull())
