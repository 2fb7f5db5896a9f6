"""MP4 and QuickTime files, and AVC streams: one walk over the boxes, with the codec configurations in them (see kernels)."""

from __future__ import annotations

import datetime
import math
import re
import struct
from collections.abc import Iterator

from framelake.functions.display import LANGUAGES
from framelake.operators.kernels import ASPECTS, CHROMA, A, G, O, V, Bits, Found, boxes, milliseconds, nal_units, three, u
from framelake.operators.kernels_video import APV_MATRICES as MATRICES
from framelake.operators.kernels_video import APV_PRIMARIES as PRIMARIES
from framelake.operators.kernels_video import APV_TRANSFERS as TRANSFERS
from framelake.operators.kernels_video import AV1_PROFILES, PRIMARIES as STREAM_PRIMARIES, TRANSFERS as STREAM_TRANSFERS
from framelake.operators.kernels_video import encoder, hevc_level, hevc_sps, sei_messages

# Profiles by code.
AVC_PROFILES = {0x42: "Baseline", 0x4D: "Main", 0x58: "Extended", 0x64: "High", 0x6E: "High 10", 0x7A: "High 4:2:2", 0x90: "High 4:4:4", 0xF4: "High 4:4:4"}
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Format Range Extensions"}
AAC_PROFILES = {1: "Main", 2: "LC", 3: "SSR", 4: "LTP", 5: "SBR", 17: "LC ER", 20: "LTP ER", 23: "LC ER", 29: "PS"}
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def avc_sps(unit: bytes) -> dict | None:
    """Size, rate, depth and colours of a sequence parameter set (with its byte of header)."""
    if len(unit) < 5:
        return None
    profile, b = unit[1], Bits(unit[4:])
    out = {"profile": profile, "constrained": bool(unit[2] & 0x40), "level": unit[3], "chroma": 1, "depth": 8, "shape": (1, 1), "rate": None, "fixed": False, "full": None, "primaries": None, "transfer": None, "matrix": None, "location": None}
    b.ue()
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
        out["chroma"] = b.ue()
        if out["chroma"] == 3:
            b.take(1)
        out["depth"] = b.ue() + 8
        b.ue()
        b.take(1)
        if b.take(1):
            for k in range(8 if out["chroma"] != 3 else 12):
                last = after = 8
                for _ in range((16 if k < 6 else 64) if b.take(1) else 0):
                    after = (last + b.se()) % 256 if after else 0
                    last = after or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.take(1)
        b.se()
        b.se()
        for _ in range(min(b.ue(), 255)):
            b.se()
    out["references"] = b.ue()
    b.take(1)
    wide, high, frames = b.ue() + 1, b.ue() + 1, b.take(1)
    if not frames:
        b.take(1)
    b.take(1)
    out["frames"], out["stored"] = bool(frames), (wide * 16, high * 16 * (2 - frames))
    width, height = out["stored"]
    if b.take(1):
        x, y = (1, 1) if out["chroma"] in (0, 3) else (2, 2 if out["chroma"] == 1 else 1)
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
        width, height = width - (left + right) * x, height - (top + bottom) * y * (2 - frames)
    out["width"], out["height"] = width, height
    if b.take(1):
        if b.take(1):
            code = b.take(8)
            out["shape"] = (b.take(16), b.take(16)) if code == 255 else ASPECTS[code - 1] if 1 <= code <= 16 else (1, 1)
        if b.take(1):
            b.take(1)
        if b.take(1):
            b.take(3)
            out["full"] = b.take(1)
            if b.take(1):
                out["primaries"], out["transfer"], out["matrix"] = b.take(8), b.take(8), b.take(8)
        if b.take(1):
            out["location"] = b.ue()
            b.ue()
        if b.take(1):
            unit_, scale = b.take(32), b.take(32)
            out["rate"], out["fixed"] = (scale, 2 * unit_) if unit_ and scale else None, bool(b.take(1))
    return out if width > 0 and height > 0 else None


def avc_pps_cabac(unit: bytes) -> bool:
    b = Bits(unit[1:])
    b.ue()
    b.ue()
    return bool(b.take(1))


def _sei_encoder(units: list[bytes], skip: int) -> dict:
    for unit in units:
        for kind, body in sei_messages(unit, skip):
            if kind == 5 and len(body) > 16 and (note := body[16:].split(b"\0")[0].decode("utf-8", "replace")):
                return encoder(note)
    return {}


def avc(data: bytes, f: Found) -> bool:
    """An AVC stream; of several parameter sets the last one counts."""
    if data[:4] != b"\0\0\0\1" and data[:3] != b"\0\0\1":
        return False
    units = [n for n in nal_units(bytes(data[: 1 << 20])) if n]
    s = next((s for n in reversed(units) if n[0] & 31 == 7 and (s := avc_sps(n))), None)
    if s is None:
        return False
    cabac = next((avc_pps_cabac(n) for n in reversed(units) if n[0] & 31 == 8 and len(n) > 1), None)
    pictures = sum(n[0] & 31 in (1, 5) and len(n) > 1 and n[1] >= 128 for n in units)
    name = AVC_PROFILES.get(s["profile"])
    shape, rate = s["shape"][0] / s["shape"][1] if s["shape"][1] else 1.0, s["rate"]
    f.many(V, Format="AVC", Format_Profile=f"Constrained {name}" if name == "Baseline" and s["constrained"] else name, Format_Level=f"{s['level'] / 10:g}", Format_Settings_CABAC=None if cabac is None else "Yes" if cabac else "No", Format_Settings_RefFrames=s["references"])
    f.many(V, Width=s["width"], Height=s["height"], Sampled_Width=s["stored"][0], Sampled_Height=s["stored"][1], PixelAspectRatio=three(shape), DisplayAspectRatio=three(s["width"] * shape / s["height"]))
    if rate:
        k = math.gcd(*rate)
        f.many(V, FrameRate_Mode="CFR" if s["fixed"] else "VFR", FrameRate=three(rate[0] / rate[1]), FrameRate_Num=rate[0] // k, FrameRate_Den=rate[1] // k)
    f.many(V, FrameCount=pictures or None, ColorSpace="YUV", ChromaSubsampling=CHROMA.get(s["chroma"]), BitDepth=s["depth"])
    f.many(V, colour_primaries=STREAM_PRIMARIES.get(s["primaries"]), transfer_characteristics=STREAM_TRANSFERS.get(s["transfer"]), matrix_coefficients=MATRICES.get(s["matrix"]), ScanType="Progressive" if s["frames"] else "Interlaced")
    note = _sei_encoder([n for n in units if n[0] & 31 == 6], 1)
    f.many(V, **note)
    f.many(G, Format="AVC", VideoCount=1, FrameRate=three(rate[0] / rate[1]) if rate else None, FrameCount=pictures or None, Encoded_Library=note.get("Encoded_Library"), Encoded_Library_Settings=note.get("Encoded_Library_Settings"))
    return True


# Media types and profiles by brand; formats by sample entry; languages that are told.
MIME = {"mp42": "video/mp4", "isom": "video/mp4", "avc1": "video/mp4", "qt  ": "video/quicktime", "3gp4": "video/3gpp", "heic": "image/heif", "mif1": "image/heif"}
BRANDS = {
    "M4A ": "Apple audio with iTunes info", "M4B ": "Apple audio with iTunes info", "M4V ": "Apple video with iTunes info", "M4VH": "Apple video with iTunes info", "M4VP": "Apple video with iTunes info",
    "M4P ": "Apple audio with iTunes info, protected", "qt  ": "QuickTime", "mp41": "Base Media / Version 1", "mp42": "Base Media / Version 2", "avc1": "JVT",
}
CODECS = {
    "avc1": "AVC", "avc3": "AVC", "hvc1": "HEVC", "hev1": "HEVC", "dvh1": "HEVC", "dvhe": "HEVC", "av01": "AV1", "vp08": "VP8", "vp09": "VP9", "mp4v": "MPEG-4 Visual", "apcn": "ProRes", "apch": "ProRes", "apcs": "ProRes", "apco": "ProRes",
    "ap4h": "ProRes", "mp4a": "AAC", "ac-3": "AC-3", "ec-3": "E-AC-3", "Opus": "Opus", "fLaC": "FLAC", "alac": "ALAC", "sowt": "PCM", "twos": "PCM",
}
TWO_LETTERS = {code: next(c for c, n in LANGUAGES.items() if n == name and len(c) == 2) for code, name in LANGUAGES.items() if len(code) == 3}
# Tags by atom, as text, flags, and numbers at an offset.
TEXT_TAGS = {
    "\xa9too": "Encoded_Application", "\xa9cmt": "Comment", "\xa9nam": "Title", "\xa9ART": "Performer", "\xa9alb": "Album", "\xa9day": "Released_Date", "\xa9gen": "Genre", "\xa9wrt": "Composer", "\xa9grp": "Grouping", "\xa9lyr": "Lyrics",
    "tvsh": "TVShow", "tven": "TVEpisode", "\xa9pub": "Publisher", "\xa9enc": "EncodedBy",
}
FLAG_TAGS = {"cpil": "Compilation", "pgap": "Gapless", "hdvd": "HDVideo"}
MEDIA_TYPES = {0: "Movie", 1: "Music", 2: "Audiobook", 6: "Music Video", 9: "Movie", 10: "TV Show", 11: "Booklet", 14: "Ringtone"}
RATINGS = {0: "None", 2: "Clean", 4: "Explicit"}


def _find(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for name in path:
        here = next(((a, b) for n, a, b in boxes(data, at, end) if n == name), None)
        if here is None:
            return None
        at, end = here
    return at, end


def mac_date(seconds: int) -> str | None:
    if not 0 < seconds < 1 << 36:
        return None
    return (datetime.datetime(1904, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S UTC")


def iso6709(value: str) -> str | None:
    """+48.8584+002.2945+330/ as degrees and metres."""
    parts = re.findall(r"[+-][^+-]*", value.rstrip("/"))
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return None
    if len(numbers) < 2 or "".join(parts) != value.rstrip("/"):
        return None
    sides = [f"{abs(x):.4f}°{ends[x < 0]}" for x, ends in zip(numbers, ("NS", "EW"))]
    return " ".join(sides + [f"{x:.3f}m" for x in numbers[2:3]])


def _clocks(data: bytes, at: int) -> tuple[int, int, int, int, int]:
    """Made, changed, ticks a second, length and where the fields end, of mvhd and mdhd, in 32 or 64 bits."""
    n = 8 if data[at] == 1 else 4
    made, changed, scale, length = u(data, at + 4, n), u(data, at + 4 + n, n), u(data, at + 4 + 2 * n, 4), u(data, at + 8 + 2 * n, n)
    return made, changed, scale, length, at + 8 + 3 * n


def _tags(data: bytes, at: int, end: int, f: Found) -> None:
    for name, a, b in boxes(data, at, end):
        value = next((data[x + 8 : min(y, x + 8 + (1 << 16))] for n, x, y in boxes(data, a, b) if n == b"data" and y - x >= 8), None)
        key = name.decode("latin-1")
        if value is None:
            continue
        if key in TEXT_TAGS:
            f.put(G, TEXT_TAGS[key], value.decode("utf-8", "replace") or None)
        elif key in FLAG_TAGS:
            f.put(G, FLAG_TAGS[key], "Yes" if value[:1] == b"\1" else None)
        elif key in ("trkn", "disk") and len(value) >= 6:
            one, whole = ("Track", "Track/Total") if key == "trkn" else ("Part", "Part/Total")
            f.put(G, one, u(value, 2, 2) or None)
            f.put(G, whole, u(value, 4, 2) or None)
        elif key in ("tvsn", "tves") and len(value) >= 4:
            f.put(G, "TVSeason" if key == "tvsn" else "TVEpisodeNumber", u(value, 0, 4))
        elif key == "stik" and value:
            f.put(G, "MediaType", MEDIA_TYPES.get(value[0], "Unknown"))
        elif key == "rtng" and value:
            f.put(G, "ContentRating", RATINGS.get(value[0], "Unknown"))


def _quicktime_tags(data: bytes, at: int, end: int, f: Found) -> None:
    """Tags by key: keys has the names, ilst the values by number."""
    keys, listed = _find(data, at, end, b"keys"), _find(data, at, end, b"ilst")
    if not keys or not listed:
        return
    names, k = [], keys[0] + 8
    while k + 8 <= keys[1] and (size := u(data, k, 4)) >= 8:
        names.append(data[k + 8 : k + size].decode("utf-8", "replace"))
        k += size
    found = {}
    for name, a, b in boxes(data, *listed):
        value = next((data[x + 8 : y].decode("utf-8", "replace") for n, x, y in boxes(data, a, b) if n == b"data" and y - x >= 8), None)
        if value is not None and 1 <= int.from_bytes(name, "big") <= len(names):
            found[names[int.from_bytes(name, "big") - 1]] = value
    own = "com.apple.quicktime."
    make, used = found.get(own + "make"), {own + n for n in ("make", "model", "software", "creationdate", "location.ISO6709")}
    if date := found.get(own + "creationdate"):
        f.put(G, "Recorded_Date", re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", date.replace("T", " ", 1)))
    f.put(G, "Recorded_Location", iso6709(found.get(own + "location.ISO6709", "")))
    for name, value in found.items():
        if name.startswith(own) and name not in used:
            f.put(G, name.replace("-", "").replace(".", "_"), value, extra=True)
    apple = make == "Apple"
    if apple:
        f.many(G, Encoded_Library="Apple QuickTime", Encoded_Library_CompanyName="Apple", Encoded_Library_Name="QuickTime")
    f.many(G, Encoded_Hardware_CompanyName=make, Encoded_Hardware_Name=found.get(own + "model"), Encoded_OperatingSystem_Version=found.get(own + "software"))
    if apple:
        f.many(G, Encoded_OperatingSystem_CompanyName="Apple", Encoded_OperatingSystem_Name="iOS")


def mp4(data: bytes, f: Found) -> bool:
    if data[4:8] != b"ftyp":
        return False
    end, moov, mdat, at = len(data), None, None, 0
    brands: list[str] = []
    while at + 8 <= end:
        size, name, body = u(data, at, 4), bytes(data[at + 4 : at + 8]), at + 8
        if size == 1:
            size, body = u(data, at + 8, 8), at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            break
        f.cut = f.cut or stop > end
        if name == b"ftyp":
            brands = [data[k : k + 4].decode("latin-1") for k in (body, *range(body + 8, min(stop, end) - 3, 4))]
        elif name == b"moov":
            moov = at, body, min(stop, end)
        elif name == b"mdat" and mdat is None:
            mdat = at, stop - at
        at = stop
    major = brands[0] if brands else ""
    f.many(G, Format="MPEG-4", InternetMediaType=MIME.get(major))
    if mdat:
        f.many(G, StreamSize=max(0, end - max(0, mdat[1] - 8)), HeaderSize=mdat[0], DataSize=mdat[1], FooterSize=max(0, end - mdat[0] - mdat[1]), IsStreamable="Yes" if moov and moov[0] < mdat[0] else "No")
    f.put(G, "Format_Profile", BRANDS.get(major, "Base Media") if brands else None)
    movie = (0, 0)
    if moov:
        if listed := _find(data, *moov[1:], b"udta", b"meta"):
            # The box has a version in MP4 and none in QuickTime.
            start = listed[0] + (0 if data[listed[0] + 4 : listed[0] + 8] in (b"hdlr", b"keys") else 4)
            if tags := _find(data, start, listed[1], b"ilst"):
                _tags(data, *tags, f)
        if listed := _find(data, *moov[1:], b"meta"):
            start = listed[0] + (0 if data[listed[0] + 4 : listed[0] + 8] in (b"hdlr", b"keys") else 4)
            _quicktime_tags(data, start, listed[1], f)
        if head := _find(data, *moov[1:], b"mvhd"):
            made, changed, scale, length, _ = _clocks(data, head[0])
            movie = scale, length
            f.many(G, Encoded_Date=mac_date(made), Tagged_Date=mac_date(changed))
    f.many(G, CodecID=major or None, CodecID_Compatible="/".join(dict.fromkeys(b for b in brands if b.strip("\0"))) or None, CodecID_Version="0000.00" if major == "qt  " else None)
    f.put(G, "Duration", milliseconds(movie[1], movie[0]) or None)
    if moov is None:
        return True
    counts, order, metas = {A: 0, V: 0, O: 0}, 0, []
    for number, (a, b) in enumerate(((a, b) for n, a, b in boxes(data, *moov[1:]) if n == b"trak"), 1):
        kind = _track(data, a, b, f, counts, order, number, movie, metas)
        order += kind is not None
    f.many(G, AudioCount=counts[A] or None, VideoCount=counts[V] or None, OtherCount=counts[O] or None, Metas=",".join(map(str, metas)) or None)
    return True


def _track(data: bytes, at: int, end: int, f: Found, counts: dict[int, int], order: int, number: int, movie: tuple[int, int], metas: list[int]) -> int | None:
    handler, media, table = _find(data, at, end, b"mdia", b"hdlr"), _find(data, at, end, b"mdia", b"mdhd"), _find(data, at, end, b"mdia", b"minf", b"stbl")
    if not (handler and media and table):
        return None
    role = bytes(data[handler[0] + 8 : handler[0] + 12])
    kind = {b"soun": A, b"vide": V, b"hint": O, b"meta": O, b"text": O, b"subt": O, b"sbtl": O}.get(role)
    if kind is None:
        return None
    made, changed, scale, length, where = _clocks(data, media[0])
    code = u(data, where, 2)
    t = {"made": made, "changed": changed, "scale": scale, "length": length, "language": TWO_LETTERS.get("".join(chr((code >> s & 31) + 96) for s in (10, 5, 0))), "movie": movie, "id": number, "on": True, "group": 0, "turn": 0}
    name = bytes(data[handler[0] + 24 : handler[1]])
    name = name[1:] if name[:1] and name[0] == len(name) - 1 else name.split(b"\0")[0]
    t["title"] = name.decode("utf-8", "replace").strip("\0") or None
    if head := _find(data, at, end, b"tkhd"):
        n = 8 if data[head[0]] == 1 else 4
        base = head[0] + 4 + 2 * n  # after the dates
        t |= {"id": u(data, base, 4) or number, "on": bool(data[head[0] + 3] & 1) if any(data[head[0] + 1 : head[0] + 4]) else True, "group": u(data, base + 8 + n + 8 + 2, 2)}
        matrix = base + 8 + n + 16
        x, y = (int.from_bytes(data[k : k + 4], "big", signed=True) for k in (matrix, matrix + 4))
        t["turn"] = int(math.degrees(math.atan2(y, x))) % 360 if x or y else 0
    edits = _find(data, at, end, b"edts", b"elst")
    t["edit"] = u(data, edits[0] + 8, 8 if data[edits[0]] == 1 else 4) if edits and u(data, edits[0] + 4, 4) == 1 else None
    t["count"] = t["size"] = None
    if sizes := _find(data, *table, b"stsz"):
        each, t["count"] = u(data, sizes[0] + 4, 4), u(data, sizes[0] + 8, 4)
        known = min(t["count"], (sizes[1] - sizes[0] - 12) // 4)
        t["size"] = each * t["count"] if each else sum(struct.unpack(f">{known}I", data[sizes[0] + 12 : sizes[0] + 12 + 4 * known])) if known > 0 else 0
    entry = _find(data, *table, b"stsd")
    t["entry"] = (entry[0] + 16, min(entry[1], entry[0] + 8 + u(data, entry[0] + 8, 4))) if entry and u(data, entry[0] + 4, 4) else None
    t["codec"] = data[entry[0] + 12 : entry[0] + 16].decode("latin-1") if t["entry"] else None
    t["steps"] = []
    if steps := _find(data, *table, b"stts"):
        n = min(u(data, steps[0] + 4, 4), (steps[1] - steps[0] - 8) // 8, 1 << 16)
        raw = struct.unpack(f">{2 * n}I", data[steps[0] + 8 : steps[0] + 8 + 8 * n]) if n > 0 else ()
        t["steps"] = [(c, d) for c, d in zip(raw[::2], raw[1::2]) if c]
    pos, counts[kind] = counts[kind], counts[kind] + 1
    f.many(kind, pos, StreamOrder=order, ID=t["id"])
    {A: _audio, V: _video, O: _other}[kind](data, t, f, pos, role)
    if role == b"meta":
        metas.append(t["id"])
    if kind != A and not t["on"] and kind == O:
        f.put(kind, "Default", "No", pos)
    f.many(kind, pos, Language=t["language"], Encoded_Date=mac_date(made), Tagged_Date=mac_date(changed), Title=t["title"] if kind != O else None)
    return kind


def _descriptors(raw: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """MPEG-4 descriptors: tag and body; those that hold others are gone into."""
    while at + 2 <= len(raw):
        tag, at, size = raw[at], at + 1, 0
        for _ in range(4):
            byte = raw[at] if at < len(raw) else 0
            size, at = size << 7 | byte & 127, at + 1
            if byte < 128:
                break
        body = raw[at : at + size]
        yield tag, body
        if tag == 3 and len(body) >= 3:
            flags = body[2]
            yield from _descriptors(body, 3 + (2 if flags & 128 else 0) + (1 + body[3] if flags & 64 and len(body) > 3 else 0) + (2 if flags & 32 else 0))
        elif tag == 4:
            yield from _descriptors(body, 13)
        at += size


def _audio(data: bytes, t: dict, f: Found, pos: int, role: bytes) -> None:
    name = CODECS.get(t["codec"])
    kind = object_type = best = most = None
    channels = rate = None
    if t["entry"]:
        a, b = t["entry"]
        channels, rate = u(data, a + 16, 2), u(data, a + 24, 4) >> 16
        start = a + 28 + {1: 16, 2: 36}.get(u(data, a + 8, 2), 0)
        if box := _find(data, start, b, b"esds") or _find(data, start, b, b"wave", b"esds"):
            for tag, body in _descriptors(bytes(data[box[0] : box[1]]), 4):
                if tag == 4 and len(body) >= 13:
                    kind, most, best = body[0], u(body, 5, 4) or None, u(body, 9, 4) or None
                elif tag == 5 and len(body) >= 2:
                    bits = Bits(body)
                    object_type = bits.take(5)
                    index = bits.take(4)
                    rate = bits.take(24) if index == 15 else AAC_RATES[index] if index < len(AAC_RATES) else rate
                    channels = bits.take(4) or channels
    aac = name == "AAC" and (kind in (None, 0x40, 0x66, 0x67, 0x68))
    if name == "AAC" and not aac:
        name = {0x69: "MPEG Audio", 0x6B: "MPEG Audio", 0xA5: "AC-3", 0xA6: "E-AC-3"}.get(kind, "AAC")
    f.many(A, pos, Format=name or t["codec"], Format_AdditionalFeatures=AAC_PROFILES.get(object_type) if aac else None, Format_Settings_SBR="No (Explicit)" if object_type == 2 else None)
    f.put(A, "CodecID", f"mp4a-{kind:x}-{object_type}" if kind is not None and object_type is not None else t["codec"], pos)
    whole, own = milliseconds(t["movie"][1], t["movie"][0]), milliseconds(t["length"], t["scale"])
    bps = best
    if not bps and t["size"]:
        bps = int(t["size"] * 8000 / (whole or own) + 0.5) if whole or own else None
    if bps:
        f.many(A, pos, BitRate_Mode="VBR" if best and most and best != most else "CBR", BitRate=bps, BitRate_Maximum=most if aac and best and most and best != most else None)
    places = {1: ("Front: C", "M" if aac else "C"), 2: ("Front: L R", "L R")}.get(channels, (None, None))
    f.many(A, pos, Channels=channels or None, ChannelPositions=places[0], ChannelLayout=places[1], SamplingRate=rate or None)
    if aac and rate:
        f.many(A, pos, SamplesPerFrame=1024, FrameRate=three(rate / 1024))
    f.put(A, "Compression_Mode", "Lossy" if aac else None, pos)
    units = (whole * rate + 500) // 1000 if rate and whole else t["length"] or None
    if units:
        f.many(A, pos, SamplingCount=units, Duration=milliseconds(units, rate) if rate else None, FrameCount=(units + 512) // 1024 if aac else None)
    if t["count"]:
        f.put(A, "Source_FrameCount", t["count"], pos)
        if aac and rate:
            only = milliseconds(t["count"] * 1024, rate)
            source = own or only
            f.many(A, pos, Source_Duration=source, Source_Duration_LastFrame=source - only or None)
            delay = milliseconds(units, t["scale"]) - source if units and t["scale"] else 0
            if abs(delay) >= 10:
                f.many(A, pos, Source_Delay=delay, Source_Delay_Source="Container")
    f.many(A, pos, Source_StreamSize=t["size"], StreamSize=t["size"], Default="No" if not t["on"] else "Yes" if t["group"] else None, AlternateGroup=t["group"] or None)


def _configuration(data: bytes, t: dict) -> dict:
    """What the boxes in a video sample entry tell."""
    out: dict = {"units": []}
    a, b = t["entry"]
    for name, x, y in boxes(data, a + 78, b):
        body = bytes(data[x:y])
        if name == b"avcC" and len(body) >= 6:
            out["avc"], k, sets = body[1:4], 6, []
            for n in (body[5] & 31, None):
                if n is None:
                    n, k = (body[k], k + 1) if k < len(body) else (0, k)
                for _ in range(n):
                    size = u(body, k, 2)
                    sets.append(body[k + 2 : k + 2 + size])
                    k += 2 + size
            sets = [s.replace(b"\0\0\3", b"\0\0") for s in sets if s]
            out["sps"] = next((s for x in sets if x[0] & 31 == 7 and (s := avc_sps(x))), None)
            out["cabac"] = next((avc_pps_cabac(x) for x in sets if x[0] & 31 == 8 and len(x) > 1), None)
        elif name == b"hvcC" and len(body) >= 23:
            out["hevc"], k = body, 23
            for _ in range(body[22]):
                kind, n, k = body[k] & 63 if k < len(body) else 0, u(body, k + 1, 2), k + 3
                for _ in range(n):
                    size = u(body, k, 2)
                    unit = body[k + 2 : k + 2 + size].replace(b"\0\0\3", b"\0\0")
                    if kind == 33 and "set" not in out:
                        out["set"] = hevc_sps(unit)
                    elif kind in (39, 40):
                        out["units"].append(unit)
                    k += 2 + size
        elif name == b"av1C" and len(body) >= 4:
            out["av1"] = body
        elif name == b"vpcC" and len(body) >= 8:
            out["vp9"] = body[4:]
        elif name in (b"dvcC", b"dvvC", b"dvwC") and len(body) >= 5:
            packed = u(body, 2, 2)
            out["vision"] = packed >> 9, packed >> 3 & 63, packed & 1, body[4] >> 4
        elif name == b"colr" and body[:4] in (b"nclx", b"nclc") and len(body) >= 10:
            out["colour"] = *(u(body, 4 + 2 * k, 2) for k in range(3)), body[10] >> 7 if body[:4] == b"nclx" and len(body) > 10 else None
        elif name == b"pasp" and len(body) >= 8 and u(body, 4, 4):
            out["shape"] = u(body, 0, 4), u(body, 4, 4)
    return out


def _video(data: bytes, t: dict, f: Found, pos: int, role: bytes) -> None:
    c = _configuration(data, t) if t["entry"] else {"units": []}
    put = lambda **values: f.many(V, pos, **values)
    put(Format=CODECS.get(t["codec"], t["codec"]))
    width, height = (u(data, t["entry"][0] + 24, 2) or None, u(data, t["entry"][0] + 26, 2) or None) if t["entry"] else (None, None)
    sps, own = c.get("sps"), c.get("set")
    if "avc" in c:
        profile, compatible, level = c["avc"]
        name = AVC_PROFILES.get(profile)
        cabac = c.get("cabac") if c.get("cabac") is not None else False if profile == 0x42 else None
        put(Format_Profile=f"Constrained {name}" if name == "Baseline" and compatible & 0x40 else name, Format_Settings_CABAC=None if cabac is None else "Yes" if cabac else "No", Format_Level=f"{level / 10:g}", Format_Settings_RefFrames=sps["references"] if sps else None, CodecConfigurationBox="avcC")
        if profile in (0x42, 0x4D, 0x58, 0x64):
            put(ColorSpace="YUV", ChromaSubsampling="4:2:0", BitDepth=8, ScanType="Progressive")
    if "hevc" in c:
        h = c["hevc"]
        put(Format_Profile=HEVC_PROFILES.get(h[1] & 31), Format_Level=hevc_level(h[12]), Format_Tier="High" if h[1] & 32 else "Main", CodecConfigurationBox="hvcC", **_sei_encoder(c["units"], 2))
        put(ColorSpace="YUV", ChromaSubsampling=CHROMA.get(h[16] & 3), BitDepth=(h[17] & 7) + 8, ScanType="Progressive")
    if "av1" in c:
        h = c["av1"]
        put(Format_Profile=AV1_PROFILES.get(h[1] >> 5), CodecConfigurationBox="av1C", ColorSpace="YUV", BitDepth=12 if h[2] & 0x20 else 10 if h[2] & 0x40 else 8, ChromaSubsampling={3: "4:2:0", 2: "4:2:2", 0: "4:4:4"}.get(h[2] >> 2 & 3))
    if "vp9" in c:
        h = c["vp9"]
        put(Format_Profile=h[0], Format_Level=f"{h[1] / 10:.1f}", CodecConfigurationBox="vpcC", ColorSpace="YUV", BitDepth=h[2] >> 4, ChromaSubsampling={0: "4:2:0", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}.get(h[2] >> 1 & 7))
    if "vision" in c:
        profile, level, base, compatible = c["vision"]
        put(Format_Profile=f"Dolby Vision {profile // 10}.{profile % 10}", HDR_Format="Dolby Vision", HDR_Format_Version="1.0", HDR_Format_Level=level, HDR_Format_Compatibility=f"BL:{compatible}" if base else None)
    ms = milliseconds(t["edit"], t["movie"][0]) if t["edit"] is not None and t["movie"][0] else milliseconds(t["length"], t["scale"])
    put(CodecID=t["codec"], Duration=ms or None, Width=width, Height=height, FrameCount=t["count"])
    scale, deltas = t["scale"], [d for _, d in t["steps"]]
    total, ticks = sum(n for n, _ in t["steps"]), sum(n * d for n, d in t["steps"])
    # A last picture that is shown for another time doesn't make the rate variable.
    regular = t["steps"][:-1] if len(t["steps"]) > 1 and t["steps"][-1][0] == 1 else t["steps"]
    constant = regular[0][1] if regular and len({d for _, d in regular}) == 1 and regular[0][1] else None
    if constant and scale:
        k = math.gcd(scale, constant)
        put(FrameRate_Mode="CFR", FrameRate=three(scale / constant), FrameRate_Num=scale // k, FrameRate_Den=constant // k)
    elif total and ticks and scale:
        mean = total * scale / ticks
        mean = next((s for s in (15.0, 23.976, 24.0, 25.0, 29.97, 30.0, 47.952, 48.0, 50.0, 59.94, 60.0, 100.0, 119.88, 120.0) if abs(mean - s) / s < 0.005), mean)
        put(FrameRate_Mode="VFR", FrameRate=three(mean), FrameRate_Num=int(mean * 1000 + 0.5), FrameRate_Den=1000, FrameRate_Minimum=three(scale / max(deltas)), FrameRate_Maximum=three(scale / min(deltas)) if min(deltas) else None)
    elif t["count"] and scale and t["length"]:
        put(FrameRate=three(t["count"] * scale / t["length"]))
    if t["size"] is not None:
        seconds = t["count"] * constant / scale if constant and scale and t["count"] else ms / 1000
        put(StreamSize=t["size"], BitRate=int(t["size"] * 8 / seconds + 0.5) if seconds else None)
    if width and height:
        shape = c["shape"][0] / c["shape"][1] if "shape" in c else 1.0
        sampled = int(width * shape + 0.5)
        put(Sampled_Width=sampled, Sampled_Height=height, PixelAspectRatio=three(shape), DisplayAspectRatio=three(sampled / height))
    put(Rotation=f"{t['turn']}.000")
    stream = sps if sps and sps["primaries"] is not None else own if own and own["primaries"] is not None else None
    told = c.get("colour")
    if told or stream:
        source = "Stream" if not told else "Container / Stream" if sps and sps["primaries"] is not None or "hevc" in c else "Container"
        primaries, transfer, matrix, full = told or (stream["primaries"], stream["transfer"], stream["matrix"], stream["full"])
        range_source = source if told and full is not None else "Stream"
        if full is None:
            full = next((s["full"] for s in (sps, own) if s and s["full"] is not None), 0 if "hevc" in c else None)
        put(colour_description_present="Yes", colour_description_present_Source=source)
        if full is not None:
            put(colour_range="Full" if full else "Limited", colour_range_Source=range_source)
        for field, table, code in (("colour_primaries", PRIMARIES, primaries), ("transfer_characteristics", TRANSFERS, transfer), ("matrix_coefficients", MATRICES, matrix)):
            if code in table:
                put(**{field: table[code], f"{field}_Source": source})
        dynamic = {16: ("SMPTE ST 2084", "PQ"), 18: ("ARIB STD-B67", "HLG")}.get(transfer)
        if dynamic and (V, pos, "HDR_Format", False) not in f.rows:
            put(HDR_Format=dynamic[0], HDR_Format_Compatibility=dynamic[1])
    if sps and height and sps["stored"][1] != height:
        put(Stored_Height=sps["stored"][1])
    if sps and sps["location"] is not None:
        put(ChromaSubsampling_Position=f"Type {sps['location']}")


def _other(data: bytes, t: dict, f: Found, pos: int, role: bytes) -> None:
    put = lambda **values: f.many(O, pos, **values)
    if role == b"hint":
        put(Type="Hint", Format="RTP" if t["codec"] == "rtp " else None, CodecID=t["codec"], FrameCount=t["count"], StreamSize=t["size"])
        return
    timed = t["codec"] == "mebx"
    put(Type={b"text": "Text", b"subt": "Subtitle", b"sbtl": "Subtitle"}.get(role), Format="Timed Metadata Sample" if timed else None, CodecID=t["codec"], Title=t["title"], StreamSize=t["size"], Duration=milliseconds(t["length"], t["scale"]) or None, BitRate_Mode="VBR" if timed else None, FrameCount=t["count"])


KERNELS = {"mp4": mp4, "avc": avc}
