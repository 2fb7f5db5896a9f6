"""Containers, playlists and transport messages that have to be walked (see kernels)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from framelake.operators.kernels import A, G, MODES, O, V, VERSIONS, Found, elements, milliseconds, mpeg_frame, text, three, u
from framelake.operators.kernels_video import MPEG_RATES


def dpg(data: bytes, f: Found) -> bool:
    if data[:3] != b"DPG" or len(data) < 36 or not 48 <= data[3] <= 57 or u(data, 16, 4):
        return False
    frames, rate, hz, sound, picture = (u(data, at, 4, True) for at in (4, 8, 12, 24, 32))
    f.many(G, Format="DPG", Format_Version=data[3] - 48, VideoCount=1, AudioCount=1)
    f.many(V, FrameRate=three(rate / 256) if rate else None, FrameCount=frames or None, StreamSize=picture or None)
    f.many(A, SamplingRate=hz or None, StreamSize=sound or None)
    return True


def pmp(data: bytes, f: Found) -> bool:
    if data[:4] != b"pmpm":
        return False
    f.put(G, "Format", "PMP")
    if u(data, 4, 4, True) == 1:
        if len(data) < 52:
            return False
        codec, frames, width, height, _, base, _, sound, channels, _, hz = (u(data, at, 4, True) for at in range(8, 52, 4))
        f.many(V, Format={0: "MPEG-4 Visual", 1: "AVC"}.get(codec), FrameCount=frames or None, Width=width or None, Height=height or None, FrameRate=three(base / 100) if base else None)
        f.many(A, Format={0: "MPEG Audio", 1: "AAC"}.get(sound), Channels=channels or None, SamplingRate=hz or None)
        f.many(G, VideoCount=1, AudioCount=1)
    return True


def bdmv(data: bytes, f: Found) -> bool:
    profile = {b"INDX": "Index", b"MOBJ": "MovieObject", b"MPLS": "PlayList", b"HDMV": "ClipInfo"}.get(bytes(data[:4]))
    version = bytes(data[4:8]).decode("latin-1")
    if not profile or len(version) < 4 or not (version.isascii() and version.isdecimal()):
        return False
    f.many(G, Format="BDMV", Format_Profile=profile, Format_Version=f"{version[:2]}.{version[2:]}")
    return True


def hls(data: bytes, f: Found) -> bool:
    if not 10 <= len(data) <= 1 << 20:
        return False
    try:
        lines = bytes(data).decode("utf-8").removeprefix("﻿").replace("\r", "\n").split("\n")
    except UnicodeDecodeError:
        return False
    if lines[0] != "#EXTM3U":
        return False
    f.put(G, "Format", "HLS")
    variant = waiting = segment = False
    for line in filter(None, (x.strip() for x in lines[1:])):
        if line.startswith("#EXT-X-KEY:"):
            waiting = False
            method = next((v.strip().strip('"') for k, eq, v in (a.partition("=") for a in line[11:].split(",")) if eq and k.strip() == "METHOD"), None)
            if method and method.startswith("AES-128"):
                f.many(G, Encryption_Format="AES", Encryption_Length=128, Encryption_Method="Segment", Encryption_Mode="CBC", Encryption_Padding="PKCS7", Encryption_InitializationVector="Sequence number")
            f.put(G, "Encryption", method)
        elif line.startswith("#EXT-X-STREAM-INF:"):
            waiting = True
        elif not line.startswith("#"):
            variant, segment, waiting = variant or waiting, segment or not waiting, False
    f.put(G, "Format_Profile", "Media" if segment and not variant else "Master")
    return True


KLV = b"\x06\x0e\x2b\x34"


def mxf(data: bytes, f: Found) -> bool:
    head = bytes(data[:4096])
    if len(head) < 16 or head[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or head.find(KLV, 0, len(head) - 1) < 0:
        return False

    def value(kind: int, skip: int) -> bytes | None:
        """Eight bytes at ``skip`` in the first item of a kind that holds so much."""
        at = head.find(KLV)
        while 0 <= at < len(head) - 17:
            if head[at + 12] == kind:
                size, body = head[at + 16], at + 17
                if size & 128:
                    n = size & 127
                    size, body = (u(head, body, n), body + n) if n <= 8 and body + n <= len(head) else (-1, 0)
                if size >= 0 and body + skip + 8 <= min(len(head), at + 16 + size):
                    return head[body + skip : body + skip + 8]
            at = head.find(KLV, at + 1)
        return None

    raw = value(0x14, 17) or value(0x01, 16)
    f.many(G, Format="MXF", InternetMediaType="application/mxf")
    if raw:
        packed, dot = u(raw, 0, 4), ";" if raw[0] & 128 else ":"
        parts = (packed >> 2 & 31, (packed >> 8 & 127) << 1 | packed >> 7 & 1, (packed >> 16 & 63) << 1 | packed >> 15 & 1, (packed >> 24 & 63) << 2 | packed >> 22 & 3)
        f.many(G, TimeCode_FirstFrame=dot.join(f"{x:02d}" for x in parts), TimeCode_Source="Material Package")
    return True


def gxf(data: bytes, f: Found) -> bool:
    leads = lambda at: data[at : at + 5] == b"\0\0\0\0\1" and data[at + 14 : at + 16] == b"\xe1\xe2"
    size = u(data, 6, 4)
    if not leads(0) or data[5] != 0xBC or size < 16 or size + 16 <= min(len(data), 1 << 16) and not leads(size):
        return False
    f.put(G, "Format", "GXF")
    return True


# Kind and number of the first blocks.
DV_BLOCKS = ((0x00, 0), (0x20, 0), (0x20, 1), (0x40, 0), (0x40, 1), (0x40, 2), (0x60, 0), (0x80, 0))


def dv_dif(data: bytes, f: Found) -> bool:
    if len(data) < 640 or data[:4] in (b"RIFF", KLV) or data[4:8] in (b"ftyp", b"free", b"mdat", b"moov", b"skip", b"wide"):
        return False
    if any(data[80 * k] & 0xE0 != kind or data[80 * k + 1] & 0xF0 or data[80 * k + 2] != n for k, (kind, n) in enumerate(DV_BLOCKS)):
        return False
    f.put(G, "Format", "DV")
    return True


def ibi(data: bytes, f: Found) -> bool:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return False
    for name, a, b in elements(data, 0, len(data)):
        if name == 0x1A45DFA3 and any(n == 0x4282 and y - x <= 128 and text(bytes(data[x:y])) == "MediaInfo Index" for n, x, y in elements(data, a, b)):
            f.put(G, "Format", "Ibi")
            return True
    return False


# Splice commands and kinds of segmentation.
SPLICE_COMMANDS = {0: "splice_null", 4: "splice_schedule", 5: "splice_insert", 6: "time_signal", 7: "bandwidth_reservation"}
SEGMENTATIONS = {
    0x00: "Not Indicated",
    0x01: "Content Identification",
    0x02: "Program Start",
    0x03: "Program End",
    0x04: "Program Early Termination",
    0x10: "Break",
    0x11: "Break End",
    0x12: "Opening",
    0x13: "Opening End",
    0x14: "Closing",
    0x15: "Closing End",
    0x16: "Provider Advertisement Start",
    0x17: "Provider Advertisement End",
    0x18: "Distributor Advertisement Start",
    0x19: "Distributor Advertisement End",
    0x20: "Provider Placement Opportunity Start",
    0x21: "Provider Placement Opportunity End",
    0x22: "Provider Overlay Placement Opportunity Start",
    0x23: "Provider Overlay Placement Opportunity End",
    0x24: "Distributor Placement Opportunity Start",
    0x25: "Distributor Placement Opportunity End",
    0x26: "Distributor Overlay Placement Opportunity Start",
    0x27: "Distributor Overlay Placement Opportunity End",
    0x30: "Unscheduled Event Start",
    0x31: "Unscheduled Event End",
    0x32: "Network Start",
    0x33: "Network End",
}


def _segmentation(body: bytes, f: Found) -> None:
    """A segmentation descriptor from its event id on; the kind of segment stands before the identifier."""
    if len(body) < 8 or body[4] & 128:
        return
    at = 6
    if body[5] & 128:
        if len(body) < 11:
            return
        ticks = u(body, 6, 5) >> 7 & 0xFFFFFFFF
        f.put(O, "SegmentationDuration", three(ticks / 90000) if ticks else None)
        at = 11
    if at + 2 > len(body):
        return
    f.many(O, SegmentationTypeID=body[at], SegmentationTypeName=SEGMENTATIONS.get(body[at], "Unknown"))
    name = body[at + 3 : at + 2 + body[at + 1]].decode("latin-1")
    if body[at + 1] > 1 and name and all(c.isascii() and (c.isprintable() or c.isspace()) for c in name):
        f.put(O, "UPID", name)


def scte35(data: bytes, f: Found) -> bool:
    data = bytes(data[:4096])
    size = u(data, 1, 2) & 0xFFF
    if data[:1] != b"\xfc" or len(data) < 14 or not 4 <= size <= 4091 or len(data) < size + 3 or data[3] or data[4] & 128:
        return False
    command, length, at = data[13], u(data, 11, 2) & 0xFFF, 14
    if length and command == 5:
        at += 5 if data[at + 4 : at + 5] >= b"\x80" else 11
    elif length and command == 6:
        at += 5
    if at + 2 < len(data):
        end, at = at + 2 + u(data, at, 2), at + 2
        while at + 2 < min(end, len(data)):
            tag, n = data[at], data[at + 1]
            if at + 2 + n > len(data):
                break
            if tag == 2 and n >= 12:
                _segmentation(data[at + 6 :], f)
            at += 2 + n
    name = SPLICE_COMMANDS.get(command, "reserved")
    f.many(O, Format="SCTE 35", Format_Info=f"SCTE 35 {name} command", SpliceCommandType=command, SpliceCommandName=name, Tier=u(data, 10, 2) >> 4, CWIndex=data[9], PTSAdjustment=three(u(data, 4, 5) % (1 << 33) / 90000))
    return True


def _packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(stream id, payload) of the packets of a program stream; system headers and the like have a payload as well."""
    at = data.find(b"\0\0\1")
    while 0 <= at and at + 4 <= len(data):
        kind = data[at + 3]
        if kind == 0xB9 or kind == 0xBA and at + 14 > len(data):
            return
        if kind == 0xBA:
            after = at + (14 + (data[at + 13] & 7) if data[at + 4] & 0xC0 == 0x40 else 12)
        else:
            size = u(data, at + 4, 2)
            after = at + 6 + size if size else data.find(b"\0\0\1", at + 6)
            body = data[at + 6 : after if after >= 0 else len(data)]
            skip = 3 + body[2] if len(body) >= 3 and body[0] & 0xC0 == 0x80 else 0
            yield kind, body[skip:] if size else b""
        at = data.find(b"\0\0\1", after) if after >= 0 else -1


def mpeg_ps(data: bytes, f: Found) -> bool:
    data = bytes(data[: 1 << 20])
    pack = data[:4] == b"\0\0\1\xba" and len(data) >= 14
    first = data[3] if len(data) >= 4 else 0
    if not pack and not (data[:3] == b"\0\0\1" and (0xC0 <= first <= 0xEF or first in (0xBD, 0xFA, 0xFD, 0xFE))):
        return False
    streams: dict[int, list[bytes]] = defaultdict(list)
    for kind, body in _packets(data):
        if 0xC0 <= kind <= 0xEF or kind == 0xBD:
            streams[kind].append(body)
    if not streams and not pack:
        return False
    videos, audios = sorted(k for k in streams if k >= 0xE0), sorted(k for k in streams if 0xC0 <= k < 0xE0)
    private = 0xBD in streams
    f.many(G, Format="MPEG-PS", InternetMediaType="video/mpeg", VideoCount=len(videos) or None, AudioCount=len(audios) + private or None)
    for order, kind in enumerate([*videos, *audios, *([0xBD] if private else [])]):
        stream = b"".join(streams[kind])
        if kind >= 0xE0:
            pos = order
            f.many(V, pos, StreamOrder=order, ID=kind, Format="MPEG Video", Format_Version=2, BitRate_Mode="VBR")
            at = stream.find(b"\0\0\1\xb3")
            rate = MPEG_RATES.get(stream[at + 7] & 15) if 0 <= at and at + 8 < len(stream) else None
            if rate:
                width, height, frames = u(stream, at + 4, 3) >> 12, u(stream, at + 4, 3) & 0xFFF, stream.count(b"\0\0\1\0")
                f.many(V, pos, Format_Profile="Main", Format_Level="Main", Format_Settings_BVOP="No", Format_Settings_Matrix="Default", Width=width, Height=height, Sampled_Width=width, Sampled_Height=height, PixelAspectRatio="1.000")
                f.many(V, pos, DisplayAspectRatio=three(width / height) if height else None, FrameRate=three(rate[0] / rate[1]), FrameRate_Num=rate[0], FrameRate_Den=rate[1], FrameCount=frames or None, Duration=int(frames * 1000 * rate[1] / rate[0] + 0.5) if frames else None, StreamSize=len(stream))
            f.many(V, pos, ColorSpace="YUV", ChromaSubsampling="4:2:0", BitDepth=8, ScanType="Progressive", Compression_Mode="Lossy")
            continue
        pos = order - len(videos)
        f.many(A, pos, StreamOrder=order, ID=kind, Format="Private" if kind == 0xBD else "MPEG Audio")
        if kind == 0xBD:
            continue
        at = next((k for k in range(len(stream) - 4) if stream[k] == 0xFF and mpeg_frame(stream, k)), None)
        if at is not None:
            version, layer, bps, hz, samples, _, mode = mpeg_frame(stream, at)
            step, frames, k = bps * samples // 8 // hz, 0, 0
            while k + 4 <= len(stream):
                sync = stream[k] == 0xFF and stream[k + 1] >= 0xE0
                frames, k = frames + sync, k + (max(step, 4) if sync else 1)
            f.many(A, pos, Format_Version=VERSIONS[version], Format_Profile=f"Layer {layer}", BitRate_Mode="CBR", BitRate=bps, Channels=1 if MODES[mode] == "Mono" else 2, SamplingRate=hz, SamplesPerFrame=samples)
            f.many(A, pos, Duration=milliseconds(frames * samples, hz), FrameCount=frames, SamplingCount=frames * samples, FrameRate=three(hz / samples), StreamSize=len(stream))
        f.put(A, "Compression_Mode", "Lossy", pos)
    return True


def tar(data: bytes, f: Found) -> bool:
    """A header of 512 bytes, with a mark or at least the right sum of its bytes."""
    head = bytes(data[:512])
    if len(head) < 512:
        return False
    if head[257:263] not in (b"ustar\0", b"ustar "):
        digits = head[148:156].decode("latin-1").strip()
        try:
            if not digits or int(digits, 8) != sum(head[:148]) + 256 + sum(head[156:257]):
                return False
        except ValueError:
            return False
    f.put(G, "Format", "TAR")
    return True


def mz_exe(data: bytes, f: Found) -> bool:
    if data[:2] != b"MZ":
        return False
    at = u(data, 60, 4, True)
    f.put(G, "Format", "Windows PE" if at and data[at : at + 4] == b"PE\0\0" else "MZ DOS")
    return True


def mach_o(data: bytes, f: Found) -> bool:
    # Bits and byte order by magic number.
    found = {0xFEEDFACE: ("32", "BE"), 0xCEFAEDFE: ("32", "LE"), 0xFEEDFACF: ("64", "BE"), 0xCFFAEDFE: ("64", "LE"), 0xBEBAFECA: ("Universal", "LE")}.get(u(data, 0, 4))
    if not found:
        return False
    f.many(G, Format="Mach-O", Format_Profile=found[0], Format_Settings_Endianness=found[1])
    return True


KERNELS = {
    "dpg": dpg, "pmp": pmp, "bdmv": bdmv, "hls": hls, "mxf": mxf, "gxf": gxf, "dv_dif": dv_dif, "ibi": ibi, "scte35": scte35, "mpeg_ps": mpeg_ps, "tar": tar, "mz_exe": mz_exe, "mach_o": mach_o,
}
