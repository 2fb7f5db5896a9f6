import random
import struct
import zlib

import pytest

from framelake.operators import kernels_image, registry
from framelake.operators.kernels import Found, extended, mpeg_frame, vint
from framelake.operators.registry import KERNELS


def run_kernel(parser, data):
    out = registry.run_kernel(parser, data)
    return out[0] if out else []


def parsed(parser, data):
    return {(k, p, n): v for k, p, n, v, _ in run_kernel(parser, data)}


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def chunk(name, body, little=True):
    return name + struct.pack("<I" if little else ">I", len(body)) + body + b"\0" * (len(body) % 2)


def wav(channels=2, rate=44100, bits=16, size=176400, tag=1, more=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + chunk(b"fmt ", fmt) + more + chunk(b"data", bytes(size))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff():
    comm = struct.pack(">HIH", 2, 44100, 16) + bytes.fromhex("400eac44000000000000")
    body = b"AIFF" + chunk(b"COMM", comm, False) + chunk(b"SSND", bytes(8 + 400), False)
    return b"FORM" + struct.pack(">I", len(body)) + body


def flac():
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | 88200
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + packed.to_bytes(8, "big") + bytes(range(16))
    tags = struct.pack("<I", 3) + b"lib" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(t)) + t for t in (b"TITLE=Song", b"artist=Who"))
    return b"fLaC" + b"\x00" + struct.pack(">I", 34)[1:] + info + b"\x84" + struct.pack(">I", len(tags))[1:] + tags + bytes(1000)


def png():
    part = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1920, 1080, 8, 6, 0, 0, 0)) + part(b"tEXt", b"Software\0me") + part(b"IDAT", b"x" * 20) + part(b"IEND", b"")


def jpeg():
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\x01\x02" + bytes(7)) + seg(0xFE, b"hello") + seg(0xC0, struct.pack(">BHHB", 8, 600, 800, 3) + b"\x01\x22\0\x02\x11\1\x03\x11\1") + seg(0xDA, bytes(4)) + b"data"


def mp4():
    entry = box(b"avc1", bytes(24), struct.pack(">HH", 1280, 720), bytes(50))
    stbl = box(b"stbl", box(b"stsd", bytes(7), b"\1", entry), box(b"stsz", bytes(4), struct.pack(">II", 0, 3), struct.pack(">III", 100, 200, 300)))
    mdhd = box(b"mdhd", bytes(12), struct.pack(">IIHH", 1000, 2000, 5 << 10 | 14 << 5 | 7, 0))
    trak = box(b"trak", box(b"tkhd", bytes(12), struct.pack(">I", 1), bytes(64)), box(b"mdia", mdhd, box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl)))
    mvhd = box(b"mvhd", struct.pack(">IIIII", 0, 2082844800 + 86400, 0, 600, 1200), bytes(80))
    return box(b"ftyp", b"isom", bytes(4), b"isomavc1isom") + box(b"moov", mvhd, trak) + box(b"mdat", bytes(600))


def element(name, body):
    size = len(body) | 1 << 28
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size.to_bytes(4, "big") + body


def mkv():
    video = element(0xAE, element(0xD7, b"\1") + element(0x83, b"\1") + element(0x86, b"V_VP9") + element(0x23E383, struct.pack(">I", 40_000_000)) + element(0xE0, element(0xB0, b"\x05\x00") + element(0xBA, b"\x02\xd0")))
    audio = element(0xAE, element(0xD7, b"\2") + element(0x83, b"\2") + element(0x86, b"A_OPUS") + element(0xE1, element(0xB5, struct.pack(">f", 48000)) + element(0x9F, b"\2")))
    info = element(0x1549A966, element(0x2AD7B1, b"\x0f\x42\x40") + element(0x4489, struct.pack(">d", 1500.0)) + element(0x4D80, b"mux"))
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(0x18538067, element(0x114D9B74, b"") + info + element(0x1654AE6B, video + audio))


def ogg():
    page = lambda flag, granule, body: b"OggS\0" + bytes([flag]) + struct.pack("<QIII", granule, 7, 0, 0) + bytes([1, len(body)]) + body
    head = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, 44100, 0, 128000, 0, 0) + b"\1"
    return page(2, 0, head) + page(4, 66150, b"x" * 50)


def mp3():
    return b"ID3\4\0\0\0\0\0\x0a" + bytes(10) + (b"\xff\xfb\x90\x00" + bytes(413)) * 5


def avi():
    avih = chunk(b"avih", struct.pack("<IIIIIIIIII", 40000, 0, 0, 0, 50, 0, 2, 0, 640, 480))
    strh = chunk(b"strh", b"vidsXVID" + struct.pack("<IIIIIIII", 0, 0, 0, 1, 25, 0, 50, 0) + bytes(16))
    strf = chunk(b"strf", struct.pack("<IiiHH", 40, 640, 480, 1, 24) + b"XVID" + bytes(20))
    hdrl = chunk(b"LIST", b"hdrl" + avih + chunk(b"LIST", b"strl" + strh + strf))
    body = b"AVI " + hdrl + chunk(b"LIST", b"INFO" + chunk(b"ISFT", b"maker\0"))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tiff():
    rows = [(256, 3, 1, 640), (257, 3, 1, 480), (258, 3, 1, 8), (259, 3, 1, 5), (262, 3, 1, 2)]
    return b"II*\0" + struct.pack("<IH", 8, len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + bytes(4)


def ico():
    return struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 16, 16, 0, 0, 1, 32, 40, 38) + struct.pack("<BBBBHHII", 0, 0, 0, 0, 1, 8, 99, 78) + bytes(139)


def webp():
    body = b"WEBP" + chunk(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28) + b"x")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bits(*pairs):
    """Bytes of (value, size) pairs and of plain numbers as Exp-Golomb codes."""
    out = ""
    for p in pairs:
        out += f"{p[0]:0{p[1]}b}" if isinstance(p, tuple) else (lambda b: "0" * (len(b) - 1) + b)(f"{p + 1:b}")
    out += "1"
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def avc():
    sps = b"\x67" + bytes([77, 0, 40]) + bits(0, 0, 0, 0, 4, (0, 1), 119, 67, (1, 1), (1, 1), (1, 1), 0, 0, 0, 4, (0, 1))
    return b"\0\0\0\1" + sps.replace(b"\0\0\0", b"\0\0\3\0") + b"\0\0\1\x65data"


def adts():
    head = bits((0xFFF, 12), (0, 1), (0, 2), (1, 1), (1, 2), (4, 4), (0, 1), (2, 3), (0, 4), (107, 13), (0x7FF, 11), (0, 2))[:7]
    return (head + bytes(100)) * 43


def ac3():
    frame = b"\x0b\x77" + bits((0, 16), (0, 2), (30, 6), (8, 5), (0, 3), (7, 3), (0, 2), (0, 2), (1, 1), (27, 5))
    return frame.ljust(1792, b"\0") * 10


def ts():
    def packet(pid, body):
        return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + body).ljust(188, b"\xff")

    pat = b"\0\xb0\x0d\0\x09\xc1\0\0" + struct.pack(">HH", 3, 0xE000 | 256) + bytes(4)
    streams = struct.pack(">BHH", 0x1B, 0xE000 | 257, 0xF000) + struct.pack(">BHH", 0x0F, 0xE000 | 258, 0xF006) + b"\x0a\x04eng\0"
    pmt = b"\2" + struct.pack(">H", 0xB000 | 13 + len(streams)) + struct.pack(">HBBBHH", 3, 0xC1, 0, 0, 0xE000 | 257, 0xF000) + streams + bytes(4)
    return packet(0, pat) + packet(256, pmt) + packet(257, b"x") * 20


def dsf():
    return b"DSD " + bytes(24) + b"fmt " + struct.pack("<QIIIIIIQ", 52, 1, 0, 2, 2, 2822400, 1, 2822400) + bytes(20)


def caf():
    return b"caff\0\1\0\0desc" + struct.pack(">Qd", 32, 48000.0) + b"lpcm" + struct.pack(">IIIII", 0, 4, 1, 2, 16)


def dts():
    frame = b"\x7f\xfe\x80\x01" + bits((0, 7), (15, 7), (1005, 14), (9, 6), (13, 4), (24, 5), (0, 9), (1, 2))
    return frame.ljust(1006, b"\0") * 3


def exif():
    rows = struct.pack("<HHI4s", 271, 2, 3, b"Me\0\0") + struct.pack("<HHII", 34853, 4, 1, 38)
    gps = struct.pack("<H", 2) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 70) + bytes(4)
    return b"II*\0" + struct.pack("<IH", 8, 2) + rows + bytes(4) + gps + bytes(2) + struct.pack("<IIIIII", 10, 1, 30, 1, 0, 1)


SAMPLES = {
    "avc": (avc(), {(1, 0, "Width"): "1920", (1, 0, "Height"): "1080", (1, 0, "Format_Profile"): "Main", (1, 0, "Format_Level"): "4", (1, 0, "ScanType"): "Progressive", (1, 0, "Format_Settings_RefFrames"): "4"}),
    "aac_adts": (adts(), {(2, 0, "SamplingRate"): "44100", (2, 0, "Channels"): "2", (2, 0, "FrameCount"): "43", (2, 0, "Format_Version"): "4", (2, 0, "CodecID"): "2", (0, 0, "Format"): "ADTS"}),
    "ac3": (ac3(), {(2, 0, "BitRate"): "448000", (2, 0, "Channels"): "6", (2, 0, "FrameCount"): "10", (2, 0, "Duration"): "320", (2, 0, "dialnorm"): "-27"}),
    "mpeg_ts": (ts(), {(0, 0, "ID"): "9", (1, 0, "Format"): "AVC", (1, 0, "ID"): "257", (2, 0, "Language"): "eng", (6, 0, "Format"): "AVC / AAC", (0, 0, "MenuCount"): "1"}),
    "dsf": (dsf(), {(2, 0, "SamplingRate"): "2822400", (2, 0, "Duration"): "1000"}),
    "caf": (caf(), {(2, 0, "SamplingRate"): "48000", (2, 0, "BitRate"): "1536000", (2, 0, "Format"): "PCM"}),
    "dts": (dts(), {(2, 0, "SamplingRate"): "48000", (2, 0, "Channels"): "6", (2, 0, "BitRate"): "1509000", (2, 0, "SamplesPerFrame"): "512"}),
    "wav": (wav(), {(2, 0, "Duration"): "1000", (2, 0, "SamplingCount"): "44100", (2, 0, "BitRate"): "1411200", (2, 0, "Format_Settings_Sign"): "Signed", (0, 0, "Format"): "Wave"}),
    "aiff": (aiff(), {(2, 0, "SamplingRate"): "44100", (2, 0, "Duration"): "1000", (2, 0, "StreamSize"): "400", (2, 0, "BitRate"): "3200.0000000000"}),
    "flac": (flac(), {(2, 0, "Duration"): "2000", (2, 0, "Channels"): "2", (2, 0, "BitDepth"): "16", (0, 0, "Track"): "Song", (0, 0, "Performer"): "Who", (2, 0, "MD5_Unencoded"): bytes(range(16)).hex().upper(), (0, 0, "StreamSize"): "0"}),
    "png": (png(), {(5, 0, "Width"): "1920", (5, 0, "DisplayAspectRatio"): "1.778", (5, 0, "ColorSpace"): "RGBA", (0, 0, "StreamSize"): "23", (0, 0, "Encoded_Application"): "me"}),
    "jpeg": (jpeg(), {(5, 0, "Width"): "800", (5, 0, "Height"): "600", (5, 0, "ChromaSubsampling"): "4:2:0", (5, 0, "Comment"): "hello", (0, 0, "JFIFVersion"): "1.02"}),
    "mp4": (mp4(), {(0, 0, "Duration"): "2000", (0, 0, "IsStreamable"): "Yes", (0, 0, "CodecID_Compatible"): "isom/avc1", (0, 0, "Encoded_Date"): "1970-01-02 00:00:00 UTC", (1, 0, "Width"): "1280", (1, 0, "FrameRate"): "1.500", (1, 0, "StreamSize"): "600", (1, 0, "Format"): "AVC", (1, 0, "Language"): "en"}),
    "mkv": (mkv(), {(0, 0, "Format"): "WebM", (0, 0, "Duration"): "1500", (1, 0, "FrameRate"): "25.000", (1, 0, "Width"): "1280", (2, 0, "SamplingRate"): "48000", (2, 0, "Format"): "Opus", (0, 0, "IsStreamable"): "Yes"}),
    "ogg": (ogg(), {(2, 0, "Duration"): "1500", (2, 0, "Channels"): "2", (2, 0, "StreamSize"): "24000"}),
    "mp3": (mp3(), {(2, 0, "BitRate"): "128000", (2, 0, "FrameCount"): "5", (2, 0, "Format_Profile"): "Layer 3", (0, 0, "StreamSize"): "20"}),
    "avi": (avi(), {(0, 0, "Duration"): "2000", (1, 0, "Format"): "MPEG-4 Visual", (1, 0, "FrameRate"): "25.000", (0, 0, "Encoded_Application"): "maker"}),
    "tiff": (tiff(), {(5, 0, "Width"): "640", (5, 0, "Format"): "LZW", (5, 0, "ColorSpace"): "RGB"}),
    "ico": (ico(), {(0, 0, "ImageCount"): "2", (5, 1, "Width"): "256", (5, 0, "BitDepth"): "32"}),
    "webp": (webp(), {(5, 0, "Width"): "100", (5, 0, "Height"): "50", (5, 0, "ColorSpace"): "RGBA"}),
    "y4m": (b"YUV4MPEG2 W176 H144 F30000:1001 Ip C420jpeg\nFRAME\n", {(1, 0, "FrameRate"): "29.970", (1, 0, "ChromaSubsampling"): "4:2:0", (1, 0, "Width"): "176"}),
    "swf": (b"FWS\x06" + struct.pack("<I", 99) + bytes.fromhex("780005780000960000") + b"\0\x18\x0a\0", {(0, 0, "Format_Version"): "6"}),
}


le32, le16, be32, be16 = (lambda *v, c=c: struct.pack(c.replace("*", str(len(v))), *v) for c in ("<*I", "<*H", ">*I", ">*H"))


class Writer:
    """Bits from the most significant one on."""

    def __init__(self):
        self.text = ""

    def put(self, value, size):
        self.text += f"{value:0{size}b}" if size else ""
        return self

    def ue(self, *values):
        for value in values:
            self.text += "0" * ((value + 1).bit_length() - 1) + f"{value + 1:b}"
        return self

    def done(self):
        text = self.text + "1"
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")


def hevc(depth=10, width=1920, high=1088, crop=4):
    w = Writer().put(0, 4).put(0, 3).put(1, 1).put(0, 2).put(0, 1).put(2, 5).put(0, 32).put(0, 4).put(0, 44).put(120, 8)
    w.ue(0, 1, width, high).put(1, 1).ue(0, 0, 0, crop, depth - 8, depth - 8, 4).put(1, 1).ue(4, 2, 0, 0, 3, 0, 3, 0, 0).put(0, 1).put(0, 2).put(0, 1).ue(1).ue(1, 0, 0).put(1, 1).put(0, 1).put(0, 2)
    w.put(1, 1).put(0, 1).put(0, 1).put(1, 1).put(5, 3).put(0, 1).put(1, 1).put(9, 8).put(16, 8).put(9, 8).put(0, 8)
    guard = lambda b: b.replace(b"\0\0\0", b"\0\0\3\0").replace(b"\0\0\1", b"\0\0\3\1")
    mastering = be16(35400, 14600, 8500, 39850, 6550, 2300, 15635, 16450) + be32(10_000_000, 50)
    sei = bytes([137, len(mastering)]) + mastering + bytes([144, 4]) + be16(1000, 400) + b"\x80"
    return b"\0\0\0\1" + b"\x40\1vps" + b"\0\0\0\1" + b"\x42\1" + guard(w.done()) + b"\0\0\1" + b"\x4e\1" + guard(sei)


def av1(width=1920, height=1080):
    w = Writer().put(0, 3).put(0, 2).put(0, 1).put(0, 1).put(0, 5).put(0, 12).put(8, 5).put(0, 1).put(10, 4).put(10, 4).put(width - 1, 11).put(height - 1, 11).put(0, 1).put(0, 3).put(0, 4).put(0, 1).put(1, 1).put(1, 1).put(0, 3)
    w.put(1, 1).put(0, 1).put(1, 1).put(9, 8).put(16, 8).put(9, 8).put(0, 1).put(0, 2)
    body = w.done()
    return b"\x12\0" + b"\x0a" + bytes([len(body)]) + body


def mpeg_ps():
    video = b"\0\0\1\xb3" + bytes([0x2D, 0x02, 0x40, 0x33]) + bytes(8) + (b"\0\0\1\0" + bytes(20)) * 25
    sound = (b"\xff\xfd\x84\0" + bytes(380)) * 3
    pes = lambda sid, b: b"\0\0\1" + bytes([sid]) + be16(len(b) + 3) + b"\x80\0\0" + b
    return b"\0\0\1\xba\x44" + bytes(8) + b"\xf8" + pes(0xE0, video) + pes(0xC0, sound)


def scte35():
    segment = b"CUEI" + be32(7) + b"\0\xc0" + (90000 * 30 << 7).to_bytes(5, "big") + b"\x30\x06\x0eurl/1"
    loop = b"\x02" + bytes([len(segment)]) + segment
    body = b"\0" + b"\0" + be32(45000) + b"\x05" + b"\x12\x30\x05\x06" + bytes(5) + be16(len(loop)) + loop + bytes(4)
    return b"\xfc" + be16(0x3000 | len(body)) + body


def amiga_icon():
    head = bytearray(78)
    head[:2], head[22:26], head[48] = b"\xe3\x10", be32(1), 3
    return bytes(head) + bytes(4) + be16(16, 8, 2) + bytes(10) + bytes(2 * 8 * 2) + b"FORM" + be32(4 + 12) + b"ICON" + b"FACE" + be32(4) + bytes([45, 45, 0, 0])


def exr():
    row = lambda n, t, b: n + b"\0" + t + b"\0" + le32(len(b)) + b
    return b"\x76\x2f\x31\x01\x02\0\0\0" + row(b"compression", b"compression", b"\3") + row(b"displayWindow", b"box2i", struct.pack("<4i", 0, 0, 1919, 1079)) + row(b"pixelAspectRatio", b"float", struct.pack("<f", 1)) + b"\0"


def dpx():
    head = bytearray(2048)
    head[:4], head[8:12], head[160:164], head[772:780], head[800], head[803] = b"SDPX", b"V1.0", b"tool", be32(2048, 1556), 50, 10
    return bytes(head)


def ape():
    return b"MAC " + le16(3990, 0) + le32(52, 24, 0, 44, 1000, 0, 0) + bytes(16) + le16(2000, 0) + le32(73728 * 4, 1000, 11) + le16(16, 2) + le32(44100)


def dsdiff():
    part = lambda n, b: n + struct.pack(">Q", len(b)) + b + bytes(len(b) % 2)
    prop = b"SND " + part(b"FS  ", be32(2822400)) + part(b"CHNL", be16(2) + b"SLFTSRGT") + part(b"CMPR", b"DSD \x0enot compressed")
    body = b"DSD " + part(b"PROP", prop) + part(b"DSD ", bytes(100))
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def iamf():
    unit = lambda kind, b: bytes([kind << 3, len(b)]) + b
    return unit(31, b"iamf\0\0") + unit(0, b"\1Opus" + b"\xc0\7" + b"\0\0" + bytes(4)) + unit(1, b"\1\0\1\1\0\0" + b"\1\1\0\2\0\0")


def amiga_like(size, **at):
    out = bytearray(size)
    for where, value in at.items():
        out[int(where[1:]) : int(where[1:]) + len(value)] = value
    return bytes(out)


def aptx():
    return b"Film".ljust(60, b"\0") + b"*ENGL".ljust(8, b"\0") + b"none".ljust(7, b"\0") + b"\0" + le16(0, 1, 1234, 5) + bytes([0x10, 0x20, 0x30, 0x01, 0x10, 0x20, 0x31, 0x01]) + bytes(50)


SAMPLES |= {
    "hevc": (hevc(), {(1, 0, "Width"): "1920", (1, 0, "Height"): "1080", (1, 0, "Format_Profile"): "Main Still Picture", (1, 0, "Format_Level"): "4", (1, 0, "BitDepth"): "10", (1, 0, "colour_primaries"): "BT.2020", (1, 0, "transfer_characteristics"): "SMPTE 2084 (PQ)", (1, 0, "MaxCLL"): "1000 cd/m²", (1, 0, "MasteringDisplay_Luminance"): "min: 0.0050 cd/m², max: 1000 cd/m²"}),
    "av1": (av1(), {(1, 0, "Width"): "1920", (1, 0, "Height"): "1080", (1, 0, "Format_Profile"): "Main@L5.2", (1, 0, "BitDepth"): "10", (1, 0, "colour_primaries"): "BT.2020"}),
    "vvc": (b"\0\0\0\1\x78\1" + Writer().put(0, 8).put(0, 3).put(1, 2).put(2, 2).put(1, 1).put(1, 7).put(0, 9).done() + bytes([9, 9]), {(1, 0, "ChromaSubsampling"): "4:2:0", (1, 0, "Format_Profile"): "Main 10"}),
    "vp8": (b"\x10\x02\0\x9d\x01\x2a" + le16(640, 480) + bytes(4), {(1, 0, "Width"): "640", (1, 0, "Height"): "480"}),
    "vp9": (Writer().put(2, 2).put(0, 2).put(0, 1).put(0, 1).put(1, 1).put(0, 1).put(0x498342, 24).put(1, 3).put(0, 1).put(1279, 16).put(719, 16).put(0, 1).done() + bytes(4), {(1, 0, "Width"): "1280", (1, 0, "Height"): "720", (1, 0, "colour_range"): "Limited"}),
    "theora": (b"\x80theora\3\2\1" + be16(20, 15) + b"\0\1\x40\0\0\xf0\0\0" + be32(25, 1) + bytes(6) + b"\0\0\3\xe8" + bytes(4), {(1, 0, "Width"): "320", (1, 0, "Height"): "240", (1, 0, "FrameRate"): "25.000"}),
    "mpeg2": (b"\0\0\1\xb3\x2d\x02\x40\x33\x24\x9f\x23\x81" + bytes(20), {(1, 0, "Width"): "720", (1, 0, "Height"): "576", (1, 0, "FrameRate"): "25.000", (1, 0, "DisplayAspectRatio/String"): "16:9"}),
    "vc1": (b"\0\0\1\x0f\xd8" + be16(1920, 1080) + b"\x80" + be16(25, 1) + bytes(6), {(1, 0, "Format_Profile"): "Advanced", (1, 0, "Width"): "1920", (1, 0, "Height"): "1080", (1, 0, "FrameRate"): "25.000", (1, 0, "Format_Level"): "L0"}),
    "h263": (be32(0x20000 | 2 << 3) + bytes(8), {(1, 0, "Width"): "176", (1, 0, "Height"): "144"}),
    "mpeg4v": (b"\0\0\1\xb0\1\0\0\1\xb5", {(1, 0, "Format_Profile"): "Simple Profile"}),
    "apv": (be32(30) + b"aPv1" + be32(40) + b"\1\0\0\0" + bytes([33, 60, 0x40]) + (1920).to_bytes(3, "big") + (1080).to_bytes(3, "big") + b"\x22\0\0" + b"\0\x84\x84\x88\x04\x80", {(1, 0, "Format_Profile"): "422-10@2.0", (1, 0, "Width"): "1920", (1, 0, "BitDepth"): "10", (1, 0, "colour_primaries"): "BT.2020"}),
    "prores": (be32(99) + b"icpf" + be16(148, 1) + b"apl0" + be16(1920, 1080) + b"\x80\0\1\1\1", {(1, 0, "Format_Profile"): "422 HQ", (1, 0, "Encoded_Library"): "Apple", (1, 0, "colour_primaries"): "BT.709"}),
    "vc3": (amiga_like(44, _0=b"\0\0\2\x80\1", _24=be16(1080, 1920), _40=be32(1235)), {(1, 0, "Format_Profile"): "HD@HQX", (1, 0, "Width"): "1920", (1, 0, "BitDepth"): "10"}),
    "dolby_vision": (b"<DolbyVisionX><dv_profile>8</dv_profile><dv_version_major>1</dv_version_major><dv_version_minor>0</dv_version_minor></DolbyVisionX>", {(1, 0, "HDR_Format_Profile"): "8", (1, 0, "HDR_Format_Version"): "1.0"}),
    "ffv1": (b"FFV1\3\1\0", {(1, 0, "Format_Version"): "3"}),
    "mpeg_ps": (mpeg_ps(), {(1, 0, "Width"): "720", (1, 0, "Height"): "576", (1, 0, "FrameCount"): "25", (1, 0, "Duration"): "1000", (2, 0, "FrameCount"): "3", (2, 0, "Format_Profile"): "Layer 2", (2, 0, "StreamOrder"): "1"}),
    "scte35": (scte35(), {(4, 0, "SpliceCommandName"): "time_signal", (4, 0, "Tier"): "291", (4, 0, "PTSAdjustment"): "0.500", (4, 0, "SegmentationTypeName"): "Unscheduled Event Start", (4, 0, "SegmentationDuration"): "30.000", (4, 0, "UPID"): "url/1"}),
    "dpg": (b"DPG2" + le32(250, 256 * 25, 32000, 0, 36, 4000, 4036, 9000), {(1, 0, "FrameRate"): "25.000", (2, 0, "StreamSize"): "4000", (0, 0, "Format_Version"): "2"}),
    "pmp": (b"pmpm" + le32(1, 1, 300, 480, 272, 1, 2997, 1, 1, 2, 0, 44100), {(1, 0, "Format"): "AVC", (1, 0, "FrameRate"): "29.970", (2, 0, "SamplingRate"): "44100"}),
    "bdmv": (b"MPLS0200" + bytes(20), {(0, 0, "Format_Profile"): "PlayList", (0, 0, "Format_Version"): "02.00"}),
    "hls": (b'#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXTINF:1,\na.ts\n', {(0, 0, "Format_Profile"): "Media", (0, 0, "Encryption"): "AES-128", (0, 0, "Encryption_Mode"): "CBC"}),
    "mxf": (b"\x06\x0e\x2b\x34" + bytes(8) + b"\x14\0\0\0" + bytes([40]) + bytes(60), {(0, 0, "Format"): "MXF", (0, 0, "TimeCode_FirstFrame"): "00:00:00:00"}),
    "gxf": (b"\0\0\0\0\1\xbc" + be32(16) + bytes(4) + b"\xe1\xe2", {(0, 0, "Format"): "GXF"}),
    "dv_dif": (b"".join(bytes([k, 0, n]) + bytes(77) for k, n in ((0, 0), (32, 0), (32, 1), (64, 0), (64, 1), (64, 2), (96, 0), (128, 0))), {(0, 0, "Format"): "DV"}),
    "ibi": (b"\x1a\x45\xdf\xa3\x92\x42\x82\x8fMediaInfo Index", {(0, 0, "Format"): "Ibi"}),
    "tar": (amiga_like(512, _0=b"name", _257=b"ustar\0"), {(0, 0, "Format"): "TAR"}),
    "mz_exe": (amiga_like(100, _0=b"MZ", _60=le32(70), _70=b"PE\0\0"), {(0, 0, "Format"): "Windows PE"}),
    "mach_o": (bytes.fromhex("cffaedfe") + bytes(20), {(0, 0, "Format_Profile"): "64", (0, 0, "Format_Settings_Endianness"): "LE"}),
    "ape": (ape(), {(2, 0, "Duration"): "66896", (2, 0, "Encoded_Library_Settings"): "Normal", (0, 0, "Format_Version"): "3.990"}),
    "als": (b"ALS\0" + be32(48000, 96000) + be16(1) + b"\x04\0", {(2, 0, "Duration"): "2000", (2, 0, "BitDepth"): "16", (2, 0, "Channels"): "2"}),
    "amr": (b"#!AMR-WB\n" + bytes(30), {(2, 0, "SamplingRate"): "16000", (2, 0, "StreamSize"): "30", (0, 0, "StreamSize"): "9"}),
    "speex": (b"Speex   " + b"speex-1.2".ljust(20, b"\0") + le32(1, 80, 16000, 1, 4, 1, 0xFFFFFFFF, 320, 1, 1, 0, 0, 0), {(2, 0, "SamplingRate"): "16000", (2, 0, "BitRate_Mode"): "VBR", (2, 0, "Encoded_Library"): "speex-1.2"}),
    "mpc": (b"MP+\x07" + le32(1000) + bytes(2) + b"\xa0\0" + bytes(12) + bytes([116]) + bytes(200), {(2, 0, "Duration"): "26122", (2, 0, "Codec_Settings"): "Standard (q=5)", (2, 0, "Encoded_Library"): "1.16 Beta"}),
    "la": (b"LA" + bytes([0, 4]) + le32(0, 0, 16, 0, 16) + le16(1, 2) + le32(44100, 0) + le16(4, 16) + le32(176400) + bytes(5), {(2, 0, "Channels"): "0"} | {(2, 0, "Channels"): "2"}),
    "tak": (b"tBaK\1\x0d\0\0" + bytes([0, 0x40]) + le32(11025) + (38100 * 16).to_bytes(3, "little") + bytes([0x0A]) + bytes(3) + bytes(8), {(2, 0, "SamplingRate"): "44100", (2, 0, "BitDepth"): "16", (2, 0, "SamplingCount"): "44101"}),
    "wvpk": (b"wvpk" + le32(24) + le16(0x410, 0) + le32(88200, 0, 22050, 1 | 9 << 23, 0), {(2, 0, "SamplingRate"): "44100", (2, 0, "BitDepth"): "16", (2, 0, "Duration"): "2000", (2, 0, "Format_Profile"): "4.16"}),
    "twin_vq": (b"TWIN97012000" + be32(24) + b"COMM" + be32(16, 1, 96, 44, 0) + b"DATA", {(2, 0, "Channels"): "2", (2, 0, "BitRate"): "96000", (2, 0, "SamplingRate"): "44100"}),
    "extended_module": (b"Extended Module: " + b"Song".ljust(20) + b"\x1a" + b"Tracker".ljust(20) + b"\x04\x01" + le32(276) + le16(1, 0, 8, 3, 2, 1, 6, 125) + bytes(256), {(0, 0, "BPM"): "125", (0, 0, "Tempo"): "6", (2, 0, "Sampler, Channels"): "8", (0, 0, "Format_Version"): "1.04"}),
    "rkau": (b"RKA7" + le32(352800, 44100) + bytes([2, 16, 0, 0]), {(2, 0, "Duration"): "2000", (0, 0, "Format_Version"): "1.07", (2, 0, "Compression_Mode"): "Lossless"}),
    "open_mg": (b"EA3\1" + be16(96) + bytes(26) + b"\0" + Writer().put(0, 8).put(1, 3).put(2, 3).put(47, 10).done() + bytes(2000), {(2, 0, "Format"): "ATRAC3", (2, 0, "SamplingRate"): "44100", (2, 0, "ChannelLayout"): "L R", (2, 0, "BitRate"): "64771"}),
    "module": (b"Tune".ljust(20, b"\0") + bytes(1060) + b"M.K.", {(0, 0, "Track"): "Tune"}),
    "impulse_tracker": (amiga_like(192, _0=b"IMPM", _4=b"It", _40=bytes([0x14, 2, 0x15, 2, 1]), _51=b"\x7d"), {(0, 0, "BPM"): "125", (0, 0, "Format_Version"): "Version 2.15", (2, 0, "Channels"): "2"}),
    "scream_tracker3": (amiga_like(96, _0=b"S3", _28=b"\x1a", _40=b"\x13\x20", _44=b"SCRM", _50=b"\x7d"), {(0, 0, "BPM"): "125", (0, 0, "Encoded_Application"): "Scream Tracker 19.20"}),
    "truehd": (b"\xf8\x72\x6f\xba\x05\x30\0\0", {(2, 0, "Channels"): "6", (2, 0, "BitDepth"): "24", (2, 0, "SamplingRate"): "48000"}),
    "dsdiff": (dsdiff(), {(2, 0, "SamplingRate"): "2822400", (2, 0, "Channels"): "2", (2, 0, "StreamSize"): "100", (2, 0, "Format"): "DSD"}),
    "iab": (b"\1" + be32(2) + b"xx\2" + be32(9) + b"\1\x19" + bytes(8), {(2, 0, "SamplingRate"): "48000", (2, 0, "BitDepth"): "24", (2, 0, "FrameRate"): "23.976"}),
    "iamf": (iamf(), {(2, 0, "CodecID"): "Opus", (2, 0, "SamplesPerFrame"): "960", (2, 0, "Channels"): "2", (2, 0, "ChannelLayout"): "Stereo"}),
    "ac4": (b"\xac\x41" + Writer().put(0, 1).put(0, 7).put(100, 16).put(1, 4).put(0, 7).put(1, 4).put(1, 4).put(0, 1).put(1, 1).put(10, 5).put(3, 4).put(24, 5).done() + bytes(300), {(2, 0, "SamplingRate"): "48000", (2, 0, "Channels"): "2", (2, 0, "dialnorm"): "-24", (2, 0, "Format_AdditionalFeatures"): "Joint Object Coding (10 objects)"}),
    "dat": (amiga_like(5822 * 2, _5820=b"\0\0"), {(2, 0, "SamplingRate"): "48000", (2, 0, "Channels"): "2", (2, 0, "BitDepth"): "16"}),
    "aptx100": (aptx(), {(0, 0, "Title"): "Film", (2, 0, "Language"): "en", (2, 0, "Duration"): "60000", (2, 0, "ChannelLayout"): "L LS C RS R SW", (2, 0, "TimeCode_LastFrame"): "01:31:20:09"}),
    "usac": (b"\xff\xf1\x50\x80\0", {(2, 0, "SamplingRate"): "44100", (2, 0, "Channels"): "2", (2, 0, "Format_Profile"): "HE-AAC"}),
    "pcm": (le16(1, 2) + le32(48000, 192000) + le16(4, 16), {(2, 0, "SamplingRate"): "48000", (2, 0, "BitDepth"): "16"}),
    "aac": (b"\xff\xf1\x50\x80", {(2, 0, "Format_Profile"): "HE-AAC"}),
    "adm": (b"xx axml xx", {(2, 0, "Format"): "ADM"}),
    "pcm_vob": (b"xx LPCM", {(2, 0, "Format_Info"): "VOB LPCM"}),
    "celt": (b"CELT\1\2\0\3", {(2, 0, "Channels"): "2", (2, 0, "Format_Settings_Mode"): "3"}),
    "tga": (amiga_like(100, _2=b"\x0a", _12=le16(64, 32), _16=b"\x18"), {(5, 0, "Width"): "64", (5, 0, "Format"): "RLE", (5, 0, "BitDepth"): "24"}),
    "dpx": (dpx(), {(5, 0, "Width"): "2048", (5, 0, "DisplayAspectRatio"): "1.316", (5, 0, "ColorSpace"): "RGB", (0, 0, "Format_Version"): "1.0"}),
    "exr": (exr(), {(5, 0, "Width"): "1920", (5, 0, "Format_Compression"): "ZIP", (5, 0, "DisplayAspectRatio"): "1.778", (5, 0, "Compression_Mode"): "Lossless"}),
    "bpg": (b"BPG\xfb\x20\0\xa5\0\x50", {(5, 0, "Width"): str((0xA500 & 0x3FFF)), (5, 0, "Height"): str(0x50)}),
    "jp2": (b"\0\0\0\x0cjP  \r\n\x87\n" + box(b"jp2h", box(b"ihdr", be32(600, 800) + be16(3) + b"\7\7\0\0")), {(5, 0, "Width"): "800", (5, 0, "Height"): "600", (5, 0, "BitDepth"): "8"}),
    "amiga_icon": (amiga_icon(), {(0, 0, "Format_Profile"): "Tool", (5, 0, "Width"): "16", (5, 0, "BitDepth"): "2"}),
    "gain_map": (b"\0\0\0\0\1\x40" + be32(0, 1, 2, 1) + be32(*[1, 2] * 5), {(5, 0, "AlternateHdrHeadroom"): "2.000000", (5, 0, "GainMapMin"): "0.500000", (5, 0, "UseBaseColourSpace"): "Yes"}),
    "kate": (amiga_like(64, _0=b"\x80kate\0\0\0", _32=b"en", _48=b"SUB"), {(3, 0, "Language"): "en", (3, 0, "Language_More"): "Subtitles"}),
    "other_text": (b"[Script Info]\nScriptType: v4.00+\n[V4+ Styles]\n" + b"x" * 600, {(3, 0, "Format"): "ASS", (0, 0, "Format_Info"): "Advanced SubStation Alpha"}),
    "arib_std_b24_b37": ((lambda b: b + struct.pack(">H", kernels_image.crc16(b)))(b"\0\0\0" + be16(4) + b"data"), {(3, 0, "Format"): "ARIB STD B24/B37"}),
    "timed_text": (be16(2) + b"Hi", {(3, 0, "Format"): "Timed Text"}),
}


@pytest.mark.parametrize("parser", sorted(KERNELS))
def test_fields(parser):
    data, want = SAMPLES[parser]
    got = parsed(parser, data)
    assert {k: got.get(k) for k in want} == want


@pytest.mark.parametrize("parser", sorted(KERNELS))
def test_rejects_and_survives(parser):
    data = SAMPLES[parser][0]
    assert run_kernel(parser, b"") == [] and run_kernel(parser, b"plain text that is nothing") == []
    rng = random.Random(1)
    for _ in range(60):
        cut = data[: rng.randrange(len(data))]
        run_kernel(parser, cut)
        bad = bytearray(data)
        for _ in range(5):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        run_kernel(parser, bytes(bad))


def test_wav_cases():
    assert parsed("wav", wav(bits=8, channels=1))[2, 0, "Format_Settings_Sign"] == "Unsigned"
    assert parsed("wav", wav(more=chunk(b"JUNK", b"abc")))[2, 0, "StreamSize"] == "176400"
    cut = parsed("wav", wav()[:2000])
    assert cut[2, 0, "StreamSize"] == "0" and cut[2, 0, "Format"] == "PCM"
    assert run_kernel("wav", b"RIFF\x04\0\0\0WAVE") == []
    bext = b"Title".ljust(256, b"\0") + b"Who".ljust(32, b"\0") + bytes(32) + b"2020-01-0212:00:00" + struct.pack("<QH", 48000, 1) + bytes(254)
    got = parsed("wav", wav(more=chunk(b"bext", bext)))
    assert got[0, 0, "Title"] == "Title" and got[0, 0, "Format_Commercial"] == "Broadcast Wave" and got[0, 0, "TimeReference"] == "48000" and got[0, 0, "Recorded_Date"] == "2020-01-02"


def test_exif_in_jpeg():
    got = parsed("jpeg", jpeg()[:2] + b"\xff\xe1" + struct.pack(">H", len(exif()) + 8) + b"Exif\0\0" + exif() + jpeg()[2:])
    assert got[7, 0, "Make"] == "Me" and got[7, 0, "GPSLatitudeDecimal"] == "-10.500000" and got[5, 0, "Width"] == "800"


def test_numbers():
    assert extended(bytes.fromhex("400eac44000000000000")) == 44100.0
    assert vint(b"\x81", 0, False) == (1, 1) and vint(b"\x40\x02", 0, False) == (2, 2) and vint(b"\x1a\x45\xdf\xa3", 0, True) == (0x1A45DFA3, 4)
    assert mpeg_frame(b"\xff\xfb\x90\x00", 0)[5] == 417
    f = Found()
    f.put(0, "a", 1)
    f.put(0, "a", 2)
    f.put(0, "b", None)
    assert f.rows == {(0, 0, "a", False): "1"}
    f.put(0, "a", 3, force=True)
    assert list(f.rows.values()) == ["3"]
