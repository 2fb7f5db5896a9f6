"""Video elementary streams and codec configurations (see kernels)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from framelake.operators.kernels import CHROMA, G, V, Bits, Found, nal_units, three, u
from framelake.operators.kernels_audio import leb128

# Colour descriptions by code, as elementary streams have them.
PRIMARIES = {
    1: "BT.709", 4: "BT.470 System M", 5: "BT.470 System B, G", 6: "SMPTE 170M", 7: "SMPTE 240M", 8: "Film", 9: "BT.2020", 10: "SMPTE 428", 11: "DCI P3", 12: "Display P3", 22: "EBU Tech. 3213-E",
}
TRANSFERS = {
    1: "BT.709", 4: "BT.470 System M", 5: "BT.470 System B, G", 6: "SMPTE 170M", 7: "SMPTE 240M", 8: "Linear", 9: "Logarithmic (100:1)", 10: "Logarithmic (316.22777:1)", 14: "BT.2020 (10-bit)", 15: "BT.2020 (12-bit)",
    16: "SMPTE 2084 (PQ)", 17: "SMPTE 428", 18: "HLG",
}
# Profiles by code.
HEVC_PROFILES = {
    0: "Main", 1: "Main 10", 2: "Main Still Picture", 3: "Main 12", 4: "Main 4:2:2 10", 5: "Main 4:2:2 12", 6: "Main 4:4:4 10", 7: "Main 4:4:4 12", 8: "Main Intra", 9: "Main 10 Intra", 10: "Main 12 Intra", 11: "Main 4:2:2 10 Intra",
    12: "Main 4:2:2 12 Intra", 13: "Main 4:4:4 10 Intra", 14: "Main 4:4:4 12 Intra", 16: "Monochrome 12", 17: "Monochrome 16", 18: "Monochrome 12 Intra", 19: "Monochrome 16 Intra",
}
AV1_PROFILES = {0: "Main", 1: "High", 2: "Professional"}
AV1_LEVELS = ("2.0", "2.1", "3.0", "3.1", "4.0", "4.1", "5.0", "5.1", "5.2", "5.3", "6.0", "6.1", "6.2", "6.3")


def colours(f: Found, primaries: int | None, transfer: int | None, pos: int = 0) -> None:
    """What isn't in the tables is unknown; 0 says nothing."""
    if primaries:
        f.put(V, "colour_primaries", PRIMARIES.get(primaries, "Unknown"), pos)
    if transfer:
        f.put(V, "transfer_characteristics", TRANSFERS.get(transfer, "Unknown"), pos)


def encoder(text: str) -> dict[str, str | None]:
    """Library, name, version and settings of an encoder's note, as ``x264 - core 164 r3095 - H.264/... - options: a=1 b=2``."""
    parts = [p.strip() for p in text.split(" - ")]
    settings = next((p.partition(":")[2].strip() for p in parts if p.startswith("options:")), None)
    found = re.match(r"(x26[45])\b", parts[0])
    if not found:
        return {"Encoded_Library": text, "Encoded_Library_Settings": settings}
    version = re.sub(r"^\(build \d+\)$", "", parts[1]).strip() if len(parts) > 1 else ""
    return {
        "Encoded_Library": f"{found[1]} - {version}" if version else found[1], "Encoded_Library_Name": found[1], "Encoded_Library_Version": version or None,
        "Encoded_Library_Settings": " / ".join(settings.split()) if settings else None,
    }


def sei_messages(unit: bytes, skip: int) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of the messages in a unit, after ``skip`` bytes of header."""
    at = skip
    while at + 2 <= len(unit):
        numbers = []
        for _ in range(2):
            value = 0
            while at < len(unit) and unit[at] == 0xFF:
                value, at = value + 255, at + 1
            if at >= len(unit):
                return
            numbers.append(value + unit[at])
            at += 1
        kind, size = numbers
        if at + size > len(unit):
            return
        yield kind, unit[at : at + size]
        at += size


def _profile_tier(b: Bits) -> tuple[int, int, int]:
    b.take(2)
    tier, profile = b.take(1), b.take(5)
    b.take(32 + 4 + 32 + 12)
    return profile, tier, b.take(8)


def _scaling_lists(b: Bits) -> None:
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 else 1):
            if not b.take(1):
                b.ue()
                continue
            if size > 1:
                b.se()
            for _ in range(min(64, 1 << 4 + 2 * size)):
                b.se()


def _reference_sets(b: Bits) -> None:
    sets: list[int] = []
    for k in range(min(b.ue(), 64)):
        if k and b.take(1):
            b.take(1)
            b.ue()
            kept = 0
            for _ in range(sets[-1] + 1):
                used = b.take(1)
                kept += used or b.take(1)
            sets.append(kept)
            continue
        before, after = min(b.ue(), 16), min(b.ue(), 16)
        for _ in range(before + after):
            b.ue()
            b.take(1)
        sets.append(before + after)


def hevc_sps(unit: bytes) -> dict | None:
    """Picture size, depth and colours of a sequence parameter set (with its two bytes of header)."""
    b = Bits(unit[2:])
    b.take(4)
    layers = b.take(3)
    b.take(1)
    profile, tier, level = _profile_tier(b)
    present = [(b.take(1), b.take(1)) for _ in range(layers)]
    if layers:
        b.take(2 * (8 - layers))
    for with_profile, with_level in present:
        if with_profile:
            b.take(88)
        if with_level:
            b.take(8)
    b.ue()
    chroma = b.ue()
    if chroma == 3:
        b.take(1)
    wide, high = b.ue(), b.ue()
    edges = [b.ue() for _ in range(4)] if b.take(1) else [0] * 4
    depth = b.ue() + 8
    if not wide or not high or chroma > 3 or depth > 16 or not b.left:
        return None
    x, y = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1)
    out = {"profile": profile, "tier": tier, "level": level, "chroma": chroma, "depth": depth, "width": wide - x * (edges[0] + edges[1]), "height": high - y * (edges[2] + edges[3]), "primaries": None, "transfer": None, "matrix": None, "full": None}
    b.ue()
    order = b.ue()
    for _ in range(1 if not b.take(1) else layers + 1):
        for _ in range(3):
            b.ue()
    for _ in range(6):
        b.ue()
    if b.take(1) and b.take(1):
        _scaling_lists(b)
    b.take(2)
    if b.take(1):
        b.take(8)
        b.ue()
        b.ue()
        b.take(1)
    _reference_sets(b)
    if b.take(1):
        for _ in range(min(b.ue(), 32)):
            b.take(order + 5)
    b.take(2)
    if b.take(1):
        if b.take(1) and b.take(8) == 255:
            b.take(32)
        if b.take(1):
            b.take(1)
        if b.take(1):
            b.take(3)
            out["full"] = b.take(1)
            if b.take(1):
                out["primaries"], out["transfer"], out["matrix"] = b.take(8), b.take(8), b.take(8)
    return out


def hevc_level(code: int) -> str:
    return f"{code // 30}.{code % 30 // 3}".removesuffix(".0")


def hevc_sei(units: list[bytes], f: Found, pos: int = 0) -> None:
    """High dynamic range and encoder from messages; of a kind the last one counts, of encoders the first."""
    mastering = light = dynamic = None
    note = None
    for unit in units:
        for kind, body in sei_messages(unit, 2):
            if kind == 137 and len(body) >= 24:
                mastering = body
            elif kind == 144 and len(body) >= 4:
                light = body
            elif kind == 4 and body[:4] == b"\xb5\x00\x3c\x04" and len(body) >= 5 and dynamic is None:
                windows = (body[5] >> 5) + 1 if len(body) > 5 else 0
                dynamic = f"HDR10+ ({windows} window{'s' if windows > 1 else ''})" if windows else "HDR10+"
            elif kind == 5 and len(body) > 16 and note is None:
                note = body[16:].split(b"\0")[0].decode("utf-8", "replace") or None
    if mastering:
        r, g, blue, white = ((u(mastering, 4 * k, 2) * 0.00002, u(mastering, 4 * k + 2, 2) * 0.00002) for k in range(4))
        named = ", ".join(f"{n}: ({x:.5f}, {y:.5f})" for n, (x, y) in (("Red", r), ("Green", g), ("Blue", blue), ("White", white)))
        f.many(V, pos, HDR_Format="SMPTE ST 2086", HDR_Format_Compatibility="HDR10", MasteringDisplay_ColorPrimaries=named, MasteringDisplay_Luminance=f"min: {u(mastering, 20, 4) * 0.0001:.4f} cd/m², max: {u(mastering, 16, 4) * 0.0001:.0f} cd/m²")
    if light:
        f.many(V, pos, MaxCLL=f"{u(light, 0, 2)} cd/m²", MaxFALL=f"{u(light, 2, 2)} cd/m²")
    if dynamic:
        f.many(V, pos, HDR_Format="SMPTE ST 2094-40", HDR_Format_Compatibility="HDR10+", HDR_Format_Version=dynamic)
    if note:
        f.many(V, pos, **encoder(note))


def hevc(data: bytes, f: Found) -> bool:
    if data[:4] != b"\0\0\0\1" and data[:3] != b"\0\0\1":
        return False
    units = [n for n in nal_units(bytes(data[: 1 << 20])) if len(n) >= 2]
    sets = [s for n in units if n[0] >> 1 & 63 == 33 and (s := hevc_sps(n))]
    if not sets or not any(n[0] >> 1 & 63 == 32 for n in units):
        return False
    s = sets[-1]
    f.many(V, Format="HEVC", Format_Profile="Main" if s["depth"] <= 8 else HEVC_PROFILES.get(s["profile"], "Unknown"), Format_Level=hevc_level(s["level"]), Format_Tier="High" if s["tier"] else "Main")
    f.many(V, Width=s["width"], Height=s["height"], Sampled_Width=s["width"], Sampled_Height=s["height"], DisplayAspectRatio=three(s["width"] / s["height"]) if s["height"] > 0 else None, PixelAspectRatio="1.000")
    f.many(V, ChromaSubsampling=CHROMA.get(s["chroma"]) or "4:0:0", BitDepth=s["depth"], ColorSpace="YUV")
    hevc_sei([n for n in units if n[0] >> 1 & 63 in (39, 40)], f)
    colours(f, s["primaries"], s["transfer"])
    f.many(G, Format="HEVC", VideoCount=1)
    return True


def vvc(data: bytes, f: Found) -> bool:
    if data[:4] != b"\0\0\0\1" and data[:3] != b"\0\0\1":
        return False
    sps = next((n for n in nal_units(bytes(data[: 1 << 20])) if len(n) >= 6 and n[0] >> 3 == 15 and not (n[0] & 7 or n[1] >> 5)), None)
    if sps is None:
        return False
    b = Bits(sps[2:])
    b.take(11)
    chroma = b.take(2)
    b.take(2)
    profile = b.take(7) if b.take(1) else 0
    f.many(V, Format="VVC", Format_Version="Version 1", Format_Profile={1: "Main 10"}.get(profile, "Unknown"), ChromaSubsampling=CHROMA[chroma] or "4:0:0")
    return True


def av1_sequence(body: bytes) -> dict | None:
    """A sequence header: size, depth and colours."""
    b = Bits(body)
    out = {"profile": b.take(3), "level": 0, "tier": 0, "depth": 8, "chroma": "4:2:0", "primaries": None, "transfer": None, "matrix": None, "full": None}
    b.take(1)
    reduced = b.take(1)
    if reduced:
        out["level"] = b.take(5)
    else:
        model = 0
        if b.take(1):
            b.take(64)
            if b.take(1):
                b.ue()
            if b.take(1):
                model = b.take(5) + 1
                b.take(32 + 5 + 5)
        delay = b.take(1)
        for k in range(b.take(5) + 1):
            b.take(12)
            level = b.take(5)
            tier = b.take(1) if level > 7 else 0
            if k == 0:
                out["level"], out["tier"] = level, tier
            if model and b.take(1):
                b.take(2 * model + 1)
            if delay and b.take(1):
                b.take(4)
    wide, high = b.take(4) + 1, b.take(4) + 1
    out["width"], out["height"] = b.take(wide) + 1, b.take(high) + 1
    if not reduced and b.take(1):
        b.take(7)
    b.take(3)
    if not reduced:
        b.take(4)
        order = b.take(1)
        if order:
            b.take(2)
        force = 2 if b.take(1) else b.take(1)
        if force and not b.take(1):
            b.take(1)
        if order:
            b.take(3)
    b.take(3)
    if not b.left:
        return None
    high_depth = b.take(1)
    out["depth"] = 12 if out["profile"] == 2 and high_depth and b.take(1) else 10 if high_depth else 8
    mono = 0 if out["profile"] == 1 else b.take(1)
    if b.take(1):
        out["primaries"], out["transfer"], out["matrix"] = b.take(8), b.take(8), b.take(8)
    if mono:
        out["full"], out["chroma"] = b.take(1), "4:0:0"
    elif (out["primaries"], out["transfer"], out["matrix"]) == (1, 13, 0):
        out["full"], out["chroma"] = 1, "4:4:4"
    else:
        out["full"] = b.take(1)
        if out["profile"] == 1:
            out["chroma"] = "4:4:4"
        elif out["profile"] == 2:
            x, y = (b.take(1), 0) if out["depth"] == 12 else (1, 0)
            if x and out["depth"] == 12:
                y = b.take(1)
            out["chroma"] = "4:2:0" if x and y else "4:2:2" if x else "4:4:4"
    return out


def av1_units(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of the open bitstream units."""
    at = 0
    while at < len(data):
        head = data[at]
        if head & 0x81:
            return
        body = at + 1 + (head >> 2 & 1)
        try:
            size, body = leb128(data, body) if head & 2 else (len(data) - body, body)
        except (IndexError, ValueError):
            return
        yield head >> 3 & 15, data[body : body + size]
        at = body + size


def av1_fields(f: Found, s: dict, pos: int = 0) -> None:
    name = AV1_PROFILES.get(s["profile"], "Unknown")
    f.many(V, pos, BitDepth=s["depth"], ChromaSubsampling=s["chroma"], Format_Profile=f"{name}@L{AV1_LEVELS[s['level']]}" if s["level"] < len(AV1_LEVELS) else name, Format_Info="AOMedia Video 1", ColorSpace="YUV", ScanType="Progressive")
    colours(f, s["primaries"], s["transfer"], pos)


def av1(data: bytes, f: Found) -> bool:
    data = bytes(data[: 1 << 20])
    if len(data) < 2 or data[0] & 0x81 or data[0] >> 3 & 15 not in (1, 2):
        return False
    found, dynamic = None, False
    for kind, body in av1_units(data):
        if kind == 1 and found is None:
            found = av1_sequence(body)
        elif kind == 5 and body[:1] == b"\4" and body[1:4] == b"\xb5\x00\x3c" and body[6:7] in (b"\4", b""):
            dynamic = True
    if found is None:
        return False
    f.many(V, Format="AV1", Width=found["width"], Height=found["height"])
    av1_fields(f, found)
    if dynamic:
        f.many(V, HDR_Format="SMPTE ST 2094-40", HDR_Format_Compatibility="HDR10+")
    f.many(G, Format="AV1", VideoCount=1)
    return True


def vp8(data: bytes, f: Found) -> bool:
    if len(data) < 10:
        return False
    key = data[0] < 128
    if key and data[3:6] != b"\x9d\x01\x2a":
        return False
    f.many(V, Format="VP8", Codec="VP8", BitDepth=8, ColorSpace="YUV")
    if key:
        f.many(V, Width=u(data, 6, 2, True) & 0x3FFF, Height=u(data, 8, 2, True) & 0x3FFF)
    f.put(G, "Format", "VP8")
    return True


def vp9(data: bytes, f: Found) -> bool:
    if len(data) < 6:
        return False
    b = Bits(data[:32])
    if b.take(2) != 2:
        return False
    profile = b.take(1) | b.take(1) << 1
    if profile == 3 and b.take(1):
        return False
    if b.take(1):
        b.take(3)
    inter, shown, resilient = b.take(1), b.take(1), b.take(1)
    intra = bool(inter and shown and b.take(1))
    if inter and shown and not resilient:
        b.take(1)
    depth, space, full, chroma, size = 8, 0, 0, 3, None
    if not inter or intra:
        if b.take(24) != 0x498342:
            return False
        if not inter or profile:
            if profile > 1:
                depth = 12 if b.take(1) else 10
            space = (2, 5, 1, 6, 7, 9, 2, 0)[b.take(3)]
            if space:
                full = b.take(1)
                if profile in (1, 3):
                    chroma = b.take(2)
                    b.take(1)
            else:
                b.take(1)
        if inter:
            b.take(8)
        size = b.take(16) + 1, b.take(16) + 1
        if b.take(1):
            size = b.take(16) + 1, b.take(16) + 1
    f.many(V, Format="VP9", Format_Profile=profile, BitDepth=depth)
    if size:
        f.many(V, Width=size[0], Height=size[1])
    f.put(V, "ColorSpace", "YUV")
    if space:
        f.many(V, ChromaSubsampling={0: "4:2:0", 1: "4:2:0", 2: "4:2:2", 3: ""}[chroma] if profile in (1, 3) else "", colour_range="Full" if full else "Limited")
    f.put(G, "Format", "VP9")
    return True


def theora(data: bytes, f: Found) -> bool:
    if len(data) < 10 or data[:7] != b"\x80theora":
        return False
    f.many(V, Format="Theora", Codec="Theora")
    if u(data, 7, 3) & 0x030200 == 0x030200:
        width, height, rate, base, x, y, bps = (u(data, at, n) for at, n in ((14, 3), (17, 3), (22, 4), (26, 4), (30, 3), (33, 3), (37, 3)))
        f.many(V, FrameRate=three(rate / base) if rate and base else None, Width=width, Height=height, DisplayAspectRatio=three(width / height * (x / y if x and y else 1.0)) if width and height else None, BitRate_Nominal=bps or None)
    f.put(G, "Format", "Theora")
    return True


# Frame rates by code.
MPEG_RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}
MPEG_ASPECTS = {1: (1, 1), 2: (4, 3), 3: (16, 9), 4: (221, 100)}
VC1_LEVELS = ("Low", "Medium", "High", "L0", "L1", "L2", "L3", "L4")


def mpeg2(data: bytes, f: Found) -> bool:
    if data[:4] != b"\0\0\1\xb3" or len(data) < 11 or not data[10] & 32:
        return False
    head = bytes(data[:256])
    packed = u(head, 4, 7)
    width, height, aspect, code, rate = packed >> 44, packed >> 32 & 0xFFF, packed >> 28 & 15, packed >> 24 & 15, packed >> 6 & 0x3FFFF
    ratio, profile = MPEG_ASPECTS.get(aspect), None
    at = head.find(b"\0\0\1\xb5", 12)
    while at >= 0 and at + 7 < len(head):
        if head[at + 4] >> 4 == 2:
            profile = {0: "SNR Scalable", 1: "Spatially Scalable", 3: "Multiview"}.get(head[at + 4] >> 5 & 3)
        elif head[at + 4] >> 4 == 1 and (body := head[at + 4 : at + 11]):
            after = 4 if body[0] & 1 else 1
            if len(body) >= after + 3:
                x, y = body[after] << 9 | body[after + 1] << 1 | body[after + 2] >> 7, (body[after + 2] & 127) << 5
                if x and y and height and width:
                    k = math.gcd(x * height, y * width)
                    ratio = x * height // k & 0xFFFF, y * width // k & 0xFFFF
        at = head.find(b"\0\0\1\xb5", at + 4)
    fps = MPEG_RATES.get(code)
    f.many(V, Format="MPEG Video", Format_Version="Version 2", Format_Profile=profile, Width=width or None, Height=height or None, FrameRate=three(fps[0] / fps[1]) if fps else three(0), BitRate=rate * 400 or None)
    if ratio and ratio[1]:
        f.put(V, "DisplayAspectRatio", three(ratio[0] / ratio[1]))
        f.put(V, "DisplayAspectRatio/String", f"{ratio[0]}:{ratio[1]}")
    f.put(V, "ScanType", "Interlaced")
    return True


def vc1(data: bytes, f: Found) -> bool:
    if data[:3] != b"\0\0\1" or data[3:4] not in (b"\x0f", b"\x0e", b"\x0d") or len(data) < 8:
        return False
    body = bytes(data[4:32])
    profile = body[0] >> 6
    if profile == 3:
        if len(body) < 10:
            return False
        width, height, inter = u(body, 1, 2), u(body, 3, 2), body[5] >> 7
        rate = (u(body, 6, 2), u(body, 8, 2)) if len(body) >= 12 else (0, 0)
    else:
        packed = u(body, 1, 3)
        width, height, inter, rate = ((packed >> 12) + 1) * 2, ((packed & 0xFFF) + 1) * 2, body[1] >> 7, (0, 0)
        if len(body) >= 8:
            top, below = body[4] >> 4, body[4] & 15
            rate = {1: 24000, 4: 30000, 7: 60000, 2: 24, 3: 25, 5: 30, 6: 50, 8: 60}.get(top, 1 if top else 0), 1001 if below in (1, 4, 7) else 1
    f.many(V, Format="VC-1", Format_Profile=("Simple", "Main", "Complex", "Advanced")[profile], Format_Level=VC1_LEVELS[body[0] >> 3 & 7], Width=width or None, Height=height or None)
    f.many(V, FrameRate=three(rate[0] / rate[1]) if rate[1] else None, ScanType="Interlaced" if inter else "Progressive")
    return True


def h263(data: bytes, f: Found) -> bool:
    head = u(data, 0, 4)
    size = {1: (128, 96), 2: (176, 144), 3: (352, 288), 4: (704, 576), 5: (1408, 1152)}.get(head >> 3 & 7)
    if len(data) < 4 or head >> 10 != 0x80 or not size:
        return False
    f.many(V, Format="H.263", Width=size[0], Height=size[1])
    return True


# Profiles of MPEG-4 Visual by code.
MPEG4_PROFILES = {
    1: "Simple Profile", 2: "Simple Scalable Profile", 3: "Core Profile", 4: "Main Profile", 5: "N-bit Profile", 6: "Scalable Texture Profile", 7: "Simple Face Animation Profile", 8: "Simple FBA Profile", 9: "Basic Animated Texture Profile",
    10: "Hybrid Profile", 11: "Advanced Real Time Simple Profile", 12: "Core Scalable Profile", 13: "Advanced Coding Efficiency Profile", 14: "Advanced Core Profile", 15: "Advanced Scalable Texture Profile",
}


def mpeg4v(data: bytes, f: Found) -> bool:
    at, found = 0, False
    while data[at : at + 3] == b"\0\0\1" and at + 4 <= len(data):
        code, at = data[at + 3], at + 4
        if code == 0xB0:
            if at >= len(data):
                break
            f.many(V, Format="MPEG-4 Visual", Format_Profile=MPEG4_PROFILES.get(data[at], ""))
            found, at = True, at + 1
        elif code == 0xB3 or 0x20 <= code <= 0x2F:
            if at + 9 > len(data):
                break
            f.put(V, "Format", "MPEG-4 Visual")
            found = True
            body = bytes(data[at : at + 32])
            at += 3
            if body[2]:
                # Bytes of the layer's header, one a field; the shape follows the control parameters, if there are any, and
                # the size follows the rate of pictures, with another field where that is fixed.
                shape = 7 + (2 if body[6] else 0)
                size = shape + (9 if u(body, shape + 4, 2) else 7)
                if body[shape : shape + 1] == b"\0" and len(body) >= size + 5:
                    width, height = u(body, size, 2) >> 3 & 0x1FFF, u(body, size + 3, 2) >> 3 & 0x1FFF
                    f.many(V, Width=width or None, Height=height or None)
            break
        elif not 0xB0 <= code <= 0xB7:
            break
    return found


# Names by code.
APV_PROFILES = {33: "422-10", 44: "422-12", 55: "444-10", 66: "444-12", 77: "4444-10", 88: "4444-12", 99: "400-10"}
APV_PRIMARIES = {1: "BT.709", 4: "BT.470 System M", 5: "BT.601 PAL", 6: "BT.601 NTSC", 7: "SMPTE 240M", 8: "Generic film", 9: "BT.2020", 10: "XYZ", 11: "DCI P3", 12: "Display P3"}
APV_TRANSFERS = {
    1: "BT.709", 4: "BT.470 System M", 5: "BT.470 System B/G", 6: "BT.601", 7: "SMPTE 240M", 8: "Linear", 11: "IEC 61966-2-4", 12: "BT.1361", 13: "IEC 61966-2-1", 14: "BT.2020 (10-bit)", 15: "BT.2020 (12-bit)", 16: "PQ", 17: "SMPTE 428M",
    18: "HLG",
}
APV_MATRICES = {0: "Identity", 1: "BT.709", 4: "FCC 73.682", 5: "BT.470 System B/G", 6: "BT.601", 7: "SMPTE 240M", 8: "YCgCo", 9: "BT.2020 non-constant", 10: "BT.2020 constant"}


def apv(data: bytes, f: Found) -> bool:
    if data[4:8] != b"aPv1":
        return False
    at, info, described = 8, None, False
    for _ in range(8):
        if at + 8 > len(data):
            break
        size, kind, body = u(data, at, 4), data[at + 4], at + 8
        if kind in (1, 2, 25, 26, 27):
            info, described = bytes(data[body : body + 17]), True
            break
        if kind == 65:
            info = bytes(data[body + 6 : body + 18]) if u(data, body, 2) else None
            break
        at = body + max(0, size - 4)
    if info is None or len(info) < 12:
        return False
    chroma = info[9] >> 4
    f.put(G, "Format", "APV")
    f.many(V, Format="APV", Format_Profile=f"{APV_PROFILES.get(info[0], info[0])}@{info[1] / 30:.1f}", band_idc=info[2] >> 5, Width=u(info, 3, 3), Height=u(info, 6, 3))
    f.many(V, ColorSpace={0: "YUV", 2: "YUV", 3: "YUV", 4: "YUVA"}.get(chroma, ""), ChromaSubsampling={0: "4:0:0", 2: "4:2:2", 3: "4:4:4", 4: "4:4:4"}.get(chroma, ""), BitDepth=(info[9] & 15) + 8)
    if described and len(info) >= 17:
        b = Bits(info[13:])
        if b.take(1):
            f.many(V, colour_primaries=APV_PRIMARIES.get(b.take(8)), transfer_characteristics=APV_TRANSFERS.get(b.take(8)), matrix_coefficients=APV_MATRICES.get(b.take(8)), colour_range="Full" if b.take(1) else "Limited")
    return True


def prores(data: bytes, f: Found) -> bool:
    if len(data) < 21 or data[4:8] not in (b"icpf", b"apcn", b"apcs", b"apco", b"ap4h", b"prrf"):
        return False
    factor, kind, primaries = data[20] >> 6, data[20] >> 4 & 3, data[22] if len(data) > 22 else 2
    profile = "422 Proxy" if not factor else "4444" if kind else {2: "422 HQ", 3: "4444"}.get(factor, "422")
    maker = {b"apl0": "Apple", b"arri": "Arnold & Richter Cine Technik", b"aja0": "AJA Kona Hardware"}.get(bytes(data[12:16]))
    f.many(V, Format="ProRes", Format_Version=f"Version {u(data, 10, 2)}", Format_Profile=profile, Width=u(data, 16, 2), Height=u(data, 18, 2), ChromaSubsampling="4:4:4" if factor == 3 else "4:2:2", ColorSpace="YUV")
    f.many(V, ScanType={0: "Progressive", 1: "Interlaced", 2: "Interlaced"}.get(kind), Encoded_Library=maker, colour_primaries=("BT.2020" if primaries == 9 else "BT.709") if primaries else None)
    return True


# Kinds of VC-3 by compression id.
VC3_LEVELS = {1256: "444", 1270: "444", 1235: "HQX", 1241: "HQX", 1250: "HQX", 1271: "HQX", 1238: "HQ", 1243: "HQ", 1251: "HQ", 1272: "HQ", 1237: "SQ", 1242: "SQ", 1252: "SQ", 1273: "SQ", 1253: "LB", 1274: "LB"}


def vc3(data: bytes, f: Found) -> bool:
    if len(data) < 44 or data[:4] != b"\0\0\2\x80" or data[4] > 3:
        return False
    lines, samples, inter, kind = u(data, 24, 2), u(data, 26, 2), u(data, 34, 2) >> 2 & 1, u(data, 40, 4)
    profile = "HD" if 1235 <= kind <= 1260 else "RI" if 1270 <= kind <= 1275 else ""
    f.many(V, Format="VC-3", Format_Version=f"Version {data[4]}", Format_Profile=f"{profile}@{VC3_LEVELS.get(kind, '')}", Width=(samples + 15) // 16 * 16 if kind >= 1270 else samples, Height=lines * (1 + inter))
    f.many(V, BitDepth=10 if kind in (1235, 1241, 1250, 1256) else 8, ScanType="Interlaced" if inter else "Progressive", ChromaSubsampling="4:4:4" if kind in (1256, 1270) else "4:2:2", ColorSpace="YUV", BitRate_Mode="CBR")
    return True


def dolby_vision(data: bytes, f: Found) -> bool:
    try:
        page = bytes(data[: 1 << 16]).decode("utf-8").strip()
    except UnicodeDecodeError:
        return False
    if not page.startswith("<") or "DolbyVision" not in page:
        return False
    found = lambda tag: m[1].strip() or None if (m := re.search(rf"<{tag}[^>]*>(.*?)</{tag}", page, re.S)) else None
    major, base = found("dv_version_major"), found("dv_bl_signal_compatibility_id")
    f.many(V, Format="Dolby Vision", HDR_Format="Dolby Vision", HDR_Format_Profile=found("dv_profile"), HDR_Format_Level=found("dv_level"), HDR_Format_Version=f"{major}.{found('dv_version_minor') or ''}" if major else None, HDR_Format_Compatibility=f"BL:{base}" if base else None)
    f.many(V, MasteringDisplay_Luminance_Max=found("max_display_mastering_luminance"), MasteringDisplay_Luminance_Min=found("min_display_mastering_luminance"), MasteringDisplay_ColorPrimaries=found("color_primaries"))
    f.many(V, MaxCLL=found("max_content_light_level"), MaxFALL=found("max_frame_average_light_level"))
    return True


def ffv1(data: bytes, f: Found) -> bool:
    if data[:4] != b"FFV1":
        return False
    f.many(V, Format="FFV1", Format_Version=(data[4] or None) if len(data) >= 7 else None, Compression_Mode="Lossless")
    return True


KERNELS = {
    "hevc": hevc, "vvc": vvc, "av1": av1, "vp8": vp8, "vp9": vp9, "theora": theora, "mpeg2": mpeg2, "vc1": vc1, "h263": h263, "mpeg4v": mpeg4v, "apv": apv, "prores": prores, "vc3": vc3, "dolby_vision": dolby_vision, "ffv1": ffv1,
}
