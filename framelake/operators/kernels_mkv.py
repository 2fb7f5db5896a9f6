"""Matroska and WebM files: one walk over the elements, with the codecs' private data in them (see kernels)."""

from __future__ import annotations

import struct

from framelake.operators.kernels import A, G, V, Found, elements, text, three, u
from framelake.operators.kernels_mp4 import TWO_LETTERS, avc_sps
from framelake.operators.kernels_video import AV1_LEVELS, AV1_PROFILES, av1_sequence, av1_units, encoder, hevc_sps, sei_messages

# Formats by codec id; those that lose nothing; profiles and colours by code.
CODECS = {
    "A_OPUS": "Opus", "A_VORBIS": "Vorbis", "A_AAC": "AAC", "A_AAC/MPEG2/MAIN": "AAC", "A_AAC/MPEG2/LC": "AAC", "A_AAC/MPEG4/LC": "AAC", "A_AAC/MPEG4/LC/SBR": "AAC", "A_AC3": "AC-3", "A_EAC3": "E-AC-3", "A_DTS": "DTS", "A_FLAC": "FLAC",
    "A_MPEG/L3": "MPEG Audio", "A_MPEG/L2": "MPEG Audio", "A_PCM/INT/LIT": "PCM", "A_PCM/INT/BIG": "PCM", "A_PCM/FLOAT/IEEE": "PCM", "V_MPEG4/ISO/AVC": "AVC", "V_MPEGH/ISO/HEVC": "HEVC", "V_VP9": "VP9", "V_AV1": "AV1",
    "V_DOLBYVISION": "Dolby Vision", "V_DOLBYVISION/AVC": "Dolby Vision", "V_DOLBYVISION/HEVC": "Dolby Vision",
}
LOSSLESS = frozenset(("A_FLAC", "A_PCM/INT/LIT", "A_PCM/INT/BIG", "A_PCM/FLOAT/IEEE"))
AVC_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4", 44: "CAVLC 4:4:4"}
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Main 12", 5: "Main 4:2:2 10", 6: "Main 4:2:2 12", 7: "Main 4:4:4", 8: "Main 4:4:4 10", 9: "Main 4:4:4 12"}
PRIMARIES = {1: "BT.709", 4: "BT.470 System M", 5: "BT.601 PAL", 6: "BT.601 NTSC", 7: "SMPTE 240M", 9: "BT.2020"}
TRANSFERS = {1: "BT.709", 6: "BT.601", 7: "SMPTE 240M", 13: "IEC 61966-2-1", 14: "BT.2020 (10-bit)", 15: "BT.2020 (12-bit)", 16: "PQ", 18: "HLG"}
MATRICES = {0: "Identity", 1: "BT.709", 6: "BT.601", 7: "SMPTE 240M", 9: "BT.2020 non-constant", 10: "BT.2020 constant"}
#: Where the walk goes on inside: the master elements that hold something of use.
SEEK, CLUSTER, INFO, TRACKS, TAGS, CHAPTERS, FILES = 0x114D9B74, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0x1254C367, 0x1043A770, 0x1941A469
PRIVATE = 1 << 20  # bytes of private data that are looked at


class Node:
    """The children of a master element by id, the first of each."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.found = data, {}
        for name, a, b in elements(data, at, end):
            self.found.setdefault(name, (a, b))

    def number(self, name: int) -> int | None:
        at = self.found.get(name)
        return int.from_bytes(self.data[at[0] : min(at[1], at[0] + 16)], "big") if at else None

    def text(self, name: int) -> str | None:
        at = self.found.get(name)
        return text(bytes(self.data[at[0] : min(at[1], at[0] + (1 << 16))])) if at else None

    def real(self, name: int) -> float | None:
        at = self.found.get(name)
        raw = bytes(self.data[at[0] : at[1]]) if at else b""
        return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else None

    def raw(self, name: int) -> bytes:
        at = self.found.get(name)
        return bytes(self.data[at[0] : min(at[1], at[0] + PRIVATE)]) if at else b""

    def inside(self, name: int) -> "Node":
        return Node(self.data, *self.found.get(name, (0, 0)))


def mkv(data: bytes, f: Found) -> bool:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return False
    kind = None
    for name, a, b in elements(data, 0, len(data)):
        if name == 0x1A45DFA3:
            head = Node(data, a, b)
            kind = head.text(0x4282)
            if kind not in ("matroska", "webm"):
                return False
            version = head.number(0x4287)
        elif name == 0x18538067 and kind:
            _segment(data, a, b, f, kind, version)
            return True
    if kind:
        f.many(G, Format="WebM" if kind == "webm" else "Matroska", InternetMediaType="video/x-matroska", Format_Version=version or None, IsStreamable="No")
    return kind is not None


def _segment(data: bytes, at: int, end: int, f: Found, kind: str, version: int | None) -> None:
    info, tracks, tags, chapters, cover = None, [], [], 0, None
    streamable, sums = None, False
    f.cut = f.cut or at >= len(data)
    for name, a, b in elements(data, at, end):
        sums = sums or name != CLUSTER and data[a : a + 1] == b"\xbf"
        if name in (SEEK, CLUSTER) and streamable is None:
            streamable = name == SEEK  # an index before the first cluster
        if name == INFO:
            info = Node(data, a, b)
        elif name == TRACKS:
            tracks += [Node(data, x, y) for n, x, y in elements(data, a, b) if n == 0xAE]
        elif name == TAGS:
            for n, x, y in elements(data, a, b):
                if n == 0x7373:
                    owner = Node(data, x, y).inside(0x63C0).number(0x63C5) or 0
                    tags += [(owner, (pair.text(0x45A3) or "").upper(), pair.text(0x4487)) for i, p, q in elements(data, x, y) if i == 0x67C8 and (pair := Node(data, p, q))]
        elif name == CHAPTERS:
            chapters += sum(1 for n, x, y in elements(data, a, b) if n == 0x45B9 for i, _, _ in elements(data, x, y) if i == 0xB6)
        elif name == FILES:
            for n, x, y in elements(data, a, b):
                mime = Node(data, x, y).text(0x4660) if n == 0x61A7 else None
                cover = cover or (mime if mime and mime.startswith("image/") else None)
    scale, length, unique = 1_000_000, None, None
    if info:
        scale, length = info.number(0x2AD7B1) or 1_000_000, info.real(0x4489)
        unique = info.number(0x73A4) if len(info.raw(0x73A4)) == 16 else None
    seconds = length * scale / 1e9 if length is not None else None
    ms = int(seconds * 1000 + 0.5) if seconds is not None else None
    own = lambda names, owner: next((v for o, n, v in tags if o == owner and n in names and v), None)
    f.many(G, UniqueID=unique, Format="WebM" if kind == "webm" else "Matroska", InternetMediaType="video/x-matroska", Format_Version=version or None)
    f.many(G, Encoded_Application=info.text(0x4D80) if info else None, Encoded_Library=info.text(0x5741) if info else None, IsStreamable="Yes" if streamable else "No", ErrorDetectionType="Per level 1" if sums else None)
    f.many(G, Title=own(("TITLE", "HANDLER_NAME"), 0) or (info.text(0x7BA9) if info else None))
    counts = {A: 0, V: 0}
    for track in tracks:
        role = {1: V, 2: A}.get(track.number(0x83))
        if role is None:
            continue
        pos = counts[role]
        f.many(role, pos, StreamOrder=sum(counts.values()), ID=track.number(0xD7), UniqueID=track.number(0x73C5))
        counts[role] += 1
        code = track.text(0x86)
        f.many(role, pos, Format=CODECS.get(code), CodecID=code)
        (_audio if role == A else _video)(track, code or "", f, pos, seconds, ms)
        name = track.text(0x536E) or own(("TITLE", "HANDLER_NAME"), track.number(0x73C5) or -1)
        default, forced = track.number(0x88), track.number(0x55AA)
        # Without a language element the format's own default stands, which isn't told.
        f.many(role, pos, Language=TWO_LETTERS.get(track.text(0x22B59C) or ""), Title=name, Default="No" if default == 0 else "Yes", Forced="Yes" if forced else "No")
        if role == A and track.number(0x73C5):
            f.put(A, "Encoded_Library", own(("ENCODER",), track.number(0x73C5)) or own(("ENCODER",), 0), pos)
    f.many(G, AudioCount=counts[A] or None, VideoCount=counts[V] or None, MenuCount=1 if chapters else None)
    if cover:
        f.many(G, Cover="Yes", Cover_Type="PNG" if "png" in cover else "JPG" if "jpeg" in cover or "jpg" in cover else "Unknown", Cover_Mime=cover)
    f.many(G, Duration=ms, OverallBitRate=len(data) * 8000 // ms if ms else None, OverallBitRate_Mode="VBR" if ms else None)


def _audio(track: Node, code: str, f: Found, pos: int, seconds: float | None, ms: int | None) -> None:
    put = lambda **values: f.many(A, pos, **values)
    inner, private = track.inside(0xE1), track.raw(0x63A2)
    channels, rate = inner.number(0x9F), inner.real(0xB5)
    opus = private if code == "A_OPUS" and private[:8] == b"OpusHead" else b""
    size = u(private, 0, 4, True) if code == "A_VORBIS" else 0
    vorbis = private[4 : 4 + size] if 4 + size <= len(private) and private[4:11] == b"\x01vorbis" and size >= 16 and not u(private, 11, 4, True) else b""
    if channels is None:
        channels = opus[9] if len(opus) >= 19 else vorbis[11] if vorbis else None
    places = {1: ("Front: C", "M" if code in ("A_OPUS", "A_VORBIS") else "C"), 2: ("Front: L R", "L R")}.get(channels, (None, None))
    put(Channels=channels or None, ChannelPositions=places[0], ChannelLayout=places[1])
    if rate:
        put(SamplingRate=int(rate + 0.5), SamplingCount=int(rate * ms / 1000 + 0.5) if ms is not None else None)
    put(BitDepth=inner.number(0x6264), SamplingRate=(u(opus, 12, 4, True) if len(opus) >= 19 and opus[8] == 1 else u(vorbis, 12, 4, True)) or None)
    if len(vorbis) >= 24:
        most, usual = struct.unpack("<ii", vorbis[16:24])
        put(BitRate_Maximum=most if most > 0 else None, BitRate=usual if usual > 0 else None, BitRate_Mode="CBR" if usual > 0 else "VBR")
    put(Compression_Mode=("Lossless" if code in LOSSLESS else "Lossy") if code in CODECS and code.startswith("A_") else None)
    put(Delay=three(u(opus, 10, 2, True) / 48000 if len(opus) >= 12 else 0.0), Delay_Source="Container", Duration=f"{seconds:.9f}" if seconds is not None else None)


def _video(track: Node, code: str, f: Found, pos: int, seconds: float | None, ms: int | None) -> None:
    put = lambda **values: f.many(V, pos, **values)
    inner, private, each = track.inside(0xE0), track.raw(0x63A2), track.number(0x23E383)
    colour = inner.inside(0x55B0)
    width, height = inner.number(0xB0), inner.number(0xBA)
    shown = inner.number(0x54B0) or width, inner.number(0x54BA) or height
    put(Width=width, Sampled_Width=shown[0], Height=height, Sampled_Height=shown[1])
    if width and height and shown[0] and shown[1]:
        put(PixelAspectRatio=three(shown[0] / width / (shown[1] / height)), DisplayAspectRatio=three(shown[0] / shown[1]))
    put(Duration=f"{seconds:.9f}" if seconds is not None else None)
    if each:
        put(FrameRate_Mode="CFR", FrameRate=three(1e9 / each), FrameCount=int(seconds * 1e9 / each + 0.5) if seconds is not None else None)
    depth = colour.number(0x55B2)
    put(BitDepth=depth)
    if code == "V_AV1" and len(private) >= 4 and private[0] == 0x81:
        profile, level = private[1] >> 5, private[1] & 31
        s = next((s for kind, body in av1_units(private[4:]) if kind == 1 and (s := av1_sequence(body))), None)
        put(BitDepth=s["depth"] if s else 12 if private[2] & 0x20 else 10 if private[2] & 0x40 else 8, ChromaSubsampling=s["chroma"] if s else "4:2:0", Format_Info="AOMedia Video 1")
        name = AV1_PROFILES.get(profile, "Unknown")
        put(Format_Profile=f"{name}@L{AV1_LEVELS[level]}" if level < len(AV1_LEVELS) else name)
    elif code == "V_VP9" and len(private) >= 4:
        put(Format_Profile=private[1], Format_Level=f"{private[2] / 10:.1f}", BitDepth=private[3] >> 4, ChromaSubsampling={2: "4:2:2", 3: "4:4:0"}.get(private[3] >> 1 & 7, "4:2:0"), colour_range="Full" if private[3] & 1 else "Limited")
    elif code == "V_DOLBYVISION/AVC":
        put(HDR_Format="Dolby Vision", HDR_Format_Compatibility="AVC")
    elif code in ("V_DOLBYVISION", "V_DOLBYVISION/HEVC"):
        put(HDR_Format="Dolby Vision", HDR_Format_Compatibility="HDR10")
        if s := hevc_sps(private) if len(private) > 8 else None:
            put(Width=s["width"], Height=s["height"], BitDepth=s["depth"])
    elif code == "V_MPEG4/ISO/AVC" and len(private) >= 4 and private[0] == 1:
        if private[1] in AVC_PROFILES:
            put(Format_Profile=AVC_PROFILES[private[1]], Format_Level=f"{private[3] // 10}.{private[3] % 10:02d}")
        s = avc_sps(private[8 : 8 + u(private, 6, 2)].replace(b"\0\0\3", b"\0\0")) if len(private) >= 8 and private[5] & 31 else None
        if s:
            f.put(V, "Width", s["width"], pos, force=True)
            f.put(V, "Height", s["height"], pos, force=True)
            _stream_colours(s, f, pos)
    elif code == "V_MPEGH/ISO/HEVC" and len(private) >= 23 and private[0] == 1:
        if private[1] & 31 in HEVC_PROFILES:
            put(Format_Profile=HEVC_PROFILES[private[1] & 31])
        level = private[20]
        put(Format_Tier="High" if private[1] & 32 else "Main", Format_Level=f"{level // 30}.0" if level % 10 == 0 else f"{level // 30}.{level % 30 // 3}")
        units, k = [], 23
        for _ in range(private[22]):
            kind, n, k = private[k] & 63 if k < len(private) else 0, u(private, k + 1, 2), k + 3
            for _ in range(n):
                units.append((kind, private[k + 2 : k + 2 + u(private, k, 2)].replace(b"\0\0\3", b"\0\0")))
                k += 2 + u(private, k, 2)
        s = next((s for kind, body in units if kind == 33 and (s := hevc_sps(body))), None)
        if s:
            put(Width=s["width"], Height=s["height"])
            _stream_colours(s, f, pos)
        note = next((body[16:].split(b"\0")[0].decode("utf-8", "replace") for kind, unit in units if kind in (39, 40) for message, body in sei_messages(unit, 2) if message == 5 and len(body) > 16), None)
        put(Encoded_Library=encoder(note)["Encoded_Library"] if note else None)
    put(ColorSpace="YUV", ChromaSubsampling="4:2:0")
    told = {name: colour.number(i) for name, i in (("colour_primaries", 0x55BB), ("transfer_characteristics", 0x55BA), ("matrix_coefficients", 0x55B1), ("colour_range", 0x55B9))}
    if any(v is not None for v in told.values()):
        source = "Container / Stream"
        put(colour_description_present="Yes", colour_description_present_Source=source)
        tables = {"colour_range": {1: "Limited", 2: "Full"}, "colour_primaries": PRIMARIES, "transfer_characteristics": TRANSFERS, "matrix_coefficients": MATRICES}
        for name, table in tables.items():
            if told[name] in table:
                put(**{name: table[told[name]], f"{name}_Source": source})
        dynamic = {16: ("SMPTE ST 2084", "PQ"), 18: ("ARIB STD-B67", "HLG")}.get(told["transfer_characteristics"])
        if dynamic and (V, pos, "HDR_Format", False) not in f.rows:
            put(HDR_Format=dynamic[0], HDR_Format_Compatibility=dynamic[1])


def _stream_colours(s: dict, f: Found, pos: int) -> None:
    if s["primaries"] is not None:
        f.many(V, pos, colour_primaries=PRIMARIES.get(s["primaries"]), transfer_characteristics=TRANSFERS.get(s["transfer"]), matrix_coefficients=MATRICES.get(s["matrix"]), colour_range=None if s["full"] is None else "Full" if s["full"] else "Limited")


KERNELS = {"mkv": mkv}
