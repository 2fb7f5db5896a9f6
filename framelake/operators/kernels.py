"""Formats that have to be walked: byte kernels for Arrow batches. A kernel gets a blob and fills a ``Found``; it returns
False if the blob isn't of its format after all. Cut-off blobs give what was read before the cut and never raise."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

G, V, A, T, O, I, M = range(7)  # noqa: E741


class Found:
    """Fields of one file in the order of writing; the first write of a field wins unless a later one is forced."""

    def __init__(self) -> None:
        self.rows: dict[tuple[int, int, str, bool], str] = {}
        self.cut = False  # whether the blob ends before what it announces

    def put(self, kind: int, name: str, value, pos: int = 0, extra: bool = False, force: bool = False) -> None:
        key = (kind, pos, name, extra)
        if value is not None and (force or key not in self.rows):
            self.rows[key] = str(value)

    def many(self, kind: int, pos: int = 0, **values) -> None:
        for name, value in values.items():
            self.put(kind, name, value, pos)


def u(data: bytes, at: int, size: int, little: bool = False) -> int:
    """Unsigned integer; 0 where the data end too early."""
    raw = data[at : at + size]
    return int.from_bytes(raw, "little" if little else "big") if len(raw) == size else 0


def text(raw: bytes, encoding: str = "utf-8") -> str | None:
    return raw.split(b"\0")[0].decode(encoding, "replace").strip() or None


def milliseconds(count: int, rate: int) -> int:
    return (count * 1000 + rate // 2) // rate if rate else 0


def three(value: float) -> str:
    return f"{value:.3f}"


def chunks(data: bytes, at: int, end: int, little: bool) -> Iterator[tuple[bytes, int, int]]:
    """RIFF or IFF chunks that lie wholly before ``end``: name, begin and size of the body."""
    while at + 8 <= end:
        size = u(data, at + 4, 4, little)
        if at + 8 + size > end:
            return
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def wav(data: bytes, f: Found) -> bool:
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return False
    size, fmt, data_size, long_size, bext = u(data, 4, 4, True), None, 0, None, None
    end = len(data) if data[:4] == b"RF64" or size in (0, 0xFFFFFFFF) else min(len(data), 8 + size)
    f.cut = data[:4] == b"RIFF" and size not in (0, 0xFFFFFFFF) and 8 + size > len(data)
    at = 12
    while at + 8 <= end:
        name, n, body = data[at : at + 4], u(data, at + 4, 4, True), at + 8
        if name == b"data" and n == 0xFFFFFFFF and long_size is not None:
            n = long_size
        if body + n > end:
            f.cut = f.cut or end == len(data)
            break
        if name == b"ds64":
            long_size = u(data, body + 8, 8, True)
        elif name == b"fmt " and n >= 16:
            fmt = struct.unpack("<HHIIHH", data[body : body + 16])
        elif name == b"data":
            data_size = n
        elif name == b"bext" and n >= 602:
            bext = data[body : body + n]
        at = body + n + n % 2
    if fmt is None:
        return False
    tag, channels, rate, _, align, bits = fmt
    f.many(G, Format="Wave", InternetMediaType="audio/wav", Format_Settings="PcmWaveformat" if tag == 1 else None)
    # Format tags.
    name, little, sign = {1: ("PCM", "Little", "Unsigned" if bits <= 8 else "Signed"), 3: ("PCM", "Little", "Signed"), 6: ("A-law", None, None), 7: ("µ-law", None, None), 0xFFFE: ("PCM", "Little", None)}.get(tag, ("Unknown", None, None))
    f.many(A, Format=name, Format_Settings_Endianness=little, Format_Settings_Sign=sign, CodecID=tag, BitRate_Mode="CBR", BitRate=rate * channels * bits or None)
    f.many(A, Channels=channels, SamplingRate=rate, BitDepth=bits, StreamSize=data_size)
    if align:
        f.many(A, SamplingCount=data_size // align, Duration=milliseconds(data_size // align, rate) if rate else None)
    f.put(G, "AudioCount", 1)
    if bext:
        title, who = text(bext[:256]), text(bext[256:288])
        f.many(G, Format_Commercial="Broadcast Wave" if title or who else None, Title=title, Encoded_Library=who, Encoded_Library_Settings=text(bext[288:320]), Recorded_Date=text(bext[320:330]), Recorded_Time=text(bext[330:338]))
        f.many(G, TimeReference=u(bext, 338, 8, True), Format_Version=u(bext, 346, 2, True))
    return True


def extended(raw: bytes) -> float:
    """80-bit IEEE number."""
    sign, mantissa = u(raw, 0, 2), u(raw, 2, 8)
    return (-1.0 if sign & 0x8000 else 1.0) * mantissa * 2.0 ** ((sign & 0x7FFF) - 16383 - 63) if mantissa else 0.0


def aiff(data: bytes, f: Found) -> bool:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return False
    comm, sound, compressed = None, 0, data[8:12] == b"AIFC"
    for name, at, size in chunks(data, 12, min(len(data), 8 + u(data, 4, 4)), False):
        if name == b"COMM" and size >= 18:
            comm = data[at : at + size]
        elif name == b"SSND":
            sound = max(0, size - 8)
    if comm is None:
        return False
    channels, frames, bits, rate = u(comm, 0, 2), u(comm, 2, 4), u(comm, 6, 2), extended(comm[8:18])
    codec = comm[18:22].decode("latin-1") if compressed else None
    f.put(G, "Format", "AIFF")
    little = codec == "sowt"
    # Codec codes.
    name = {None: "PCM", "NONE": "PCM", "sowt": "PCM", "twos": "PCM", "fl32": "PCM", "FL32": "PCM", "fl64": "PCM", "FL64": "PCM", "alaw": "A-law", "ulaw": "µ-law", "ima4": "ADPCM"}.get(codec, codec)
    f.many(A, Format=name, Format_Settings_Endianness=("Little" if little else "Big") if name == "PCM" else None)
    f.many(A, **({"Format_Settings_Floating": "Float"} if codec and codec[:2].lower() == "fl" else {"Format_Settings_Sign": "Signed"} if name == "PCM" else {}))
    ms = int(frames / rate * 1000 + 0.5) if rate > 0 else None
    f.many(A, Duration=ms, BitRate_Mode="CBR", BitRate=f"{sound * 8000 / ms:.10f}" if ms and sound else None, Channels=channels, SamplingRate=int(rate + 0.5), SamplingCount=frames, BitDepth=bits, StreamSize=sound or None)
    f.put(G, "AudioCount", 1)
    return True


# Positions and layouts by number of channels.
LAYOUTS = {
    1: ("Front: C", "C"), 2: ("Front: L R", "L R"), 3: ("Front: L C R", "L R C"), 4: ("Front: L R, Back: L R", "L R Lb Rb"), 5: ("Front: L C R, Side: L R", "L R C Ls Rs"),
    6: ("Front: L C R, Side: L R, LFE", "L R C LFE Ls Rs"), 7: ("Front: L C R, Side: L R, Back: C, LFE", "L R C LFE Cb Ls Rs"), 8: ("Front: L C R, Side: L R, Back: L R, LFE", "L R C LFE Lb Rb Ls Rs"),
}


def vorbis_comments(raw: bytes) -> tuple[str | None, dict[str, str]]:
    n = u(raw, 0, 4, True)
    vendor, at, out = text(raw[4 : 4 + n]), 4 + n, {}
    for _ in range(min(u(raw, at, 4, True), 4096)):
        at += 4
        n = u(raw, at, 4, True)
        key, eq, value = raw[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if eq:
            out.setdefault(key.upper(), value)
        at += n
    return vendor, out


def flac(data: bytes, f: Found) -> bool:
    if data[:4] != b"fLaC":
        return False
    at, info, vendor, tags, last = 4, None, None, {}, False
    while not last and at + 4 <= len(data):
        kind, size = data[at] & 127, u(data, at + 1, 3)
        last, body = bool(data[at] & 128), data[at + 4 : at + 4 + size]
        if len(body) < size:
            break
        if kind == 0 and size >= 34:
            info = body
        elif kind == 4:
            vendor, tags = vorbis_comments(body)
        at += 4 + size
    if info is None:
        return False
    least, most, packed = u(info, 4, 3), u(info, 7, 3), u(info, 10, 8)
    rate, channels, bits, samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    f.many(G, Format="FLAC", StreamSize=0)
    ms = milliseconds(samples, rate)
    places = LAYOUTS.get(channels, (None, None))
    f.many(A, Format="FLAC", BitRate_Mode="CBR" if least == most != 0 else "VBR", Duration=ms or None, BitRate=(len(data) - at) * 8000 // ms if ms else None, Channels=channels, ChannelPositions=places[0], ChannelLayout=places[1])
    f.many(A, SamplingRate=rate, SamplingCount=samples, BitDepth=bits, Compression_Mode="Lossless", StreamSize=max(0, len(data) - at), Encoded_Library=vendor)
    f.many(G, Encoded_Application=vendor, Track=tags.get("TITLE"), Performer=tags.get("ARTIST"), Album=tags.get("ALBUM"), Recorded_Date=tags.get("DATE"), Genre=tags.get("GENRE"), Description=tags.get("DESCRIPTION"))
    f.put(G, "Track/Position", tags.get("TRACKNUMBER"))
    if any(info[18:34]):
        f.put(A, "MD5_Unencoded", info[18:34].hex().upper())
    f.put(G, "AudioCount", 1)
    return True


def png(data: bytes, f: Found) -> bool:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 29:
        return False
    width, height, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", data[16:29])
    at, overhead, tags, shape = 8, 0, {}, None
    while at + 8 <= len(data):
        size, name = u(data, at, 4), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name in (b"tEXt", b"iTXt", b"zTXt"):
            overhead += size + 12
            key, _, value = body.partition(b"\0")
            if name == b"tEXt" and size <= 1 << 16:
                tags.setdefault(key.decode("latin-1"), value.decode("latin-1"))
            elif name == b"iTXt" and size <= 1 << 16 and value[:1] == b"\0":
                tags.setdefault(key.decode("latin-1"), value[2:].split(b"\0", 2)[-1].decode("utf-8", "replace"))
        elif name == b"pHYs" and size >= 9 and u(body, 0, 4) and u(body, 4, 4):
            shape = u(body, 4, 4) / u(body, 0, 4)
        elif name == b"IEND":
            break
        at += 12 + size
    else:
        f.cut = True
    f.many(G, Format="PNG", ImageCount=1, StreamSize=overhead, Encoded_Application=tags.get("Software"), Title=tags.get("Title"), Performer=tags.get("Author"), Description=tags.get("Description"), Copyright=tags.get("Copyright"), Recorded_Date=tags.get("Creation Time"), Comment=tags.get("Comment"))
    # Colour types.
    space = {0: "Y", 2: "RGB", 3: "RGB", 4: "YA", 6: "RGBA"}.get(colour)
    f.many(I, Format="PNG", Format_Compression="Deflate", Format_Settings_Packing="Linear", Width=width, Height=height, PixelAspectRatio=three(shape or 1.0), DisplayAspectRatio=three(width * (shape or 1.0) / height) if height else None, ColorSpace=space, BitDepth=depth, Compression_Mode="Lossless", StreamSize=len(data) - overhead)
    return True


def jpeg(data: bytes, f: Found) -> bool:
    if data[:2] != b"\xff\xd8":
        return False
    at, overhead, frame, comment, jfif = 2, 0, None, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        mark = data[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark in (0xD9, 0xDA):
            break
        size = u(data, at + 2, 2)
        body = data[at + 4 : at + 2 + size]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and frame is None and len(body) >= 6:
            frame = (mark, body)
        elif mark == 0xFE:
            comment, overhead = comment or text(body), overhead + size + 2
        elif 0xE0 <= mark <= 0xEF:
            overhead += size + 2
            if mark == 0xE0 and body[:5] == b"JFIF\0":
                jfif = f"{body[5]}.{body[6]:02d}"
            elif mark == 0xE1 and body[:6] == b"Exif\0\0":
                exif(body[6:], f)
        at += 2 + max(size, 2)
    if frame is None:
        return False
    mark, body = frame
    n = body[5]
    parts = [body[7 + 3 * k] for k in range(n) if 7 + 3 * k < len(body)]
    sampling = None
    if n == 3 and len(parts) == 3:
        # Sampling factors of the first component against the others.
        sampling = {(0x11, 0x11): "4:4:4", (0x21, 0x11): "4:2:2", (0x22, 0x11): "4:2:0", (0x41, 0x11): "4:1:1", (0x12, 0x11): "4:4:0"}.get((parts[0], parts[1]))
    f.many(G, Format="JPEG", ImageCount=1, StreamSize=overhead, JFIFVersion=jfif)
    f.many(I, Format="JPEG", Width=u(body, 3, 2), Height=u(body, 1, 2), ColorSpace={1: "Y", 3: "YUV", 4: "CMYK"}.get(n), ChromaSubsampling=sampling, BitDepth=body[0], Compression_Mode="Lossless" if mark in (0xC3, 0xC7, 0xCB, 0xCF) else "Lossy", StreamSize=len(data) - overhead, Comment=comment)
    return True


def webp(data: bytes, f: Found) -> bool:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return False
    seen = False
    for name, at, size in chunks(data, 12, len(data), True):
        if name == b"VP8X" and size >= 10:
            f.many(I, Width=u(data, at + 4, 3, True) + 1, Height=u(data, at + 7, 3, True) + 1)
            if data[at] & 16:
                f.put(I, "ColorSpace", "RGBA")
            seen = True
        elif name == b"VP8 " and size >= 10 and data[at + 3 : at + 6] == b"\x9d\x01\x2a":
            f.many(I, Width=u(data, at + 6, 2, True) & 0x3FFF, Height=u(data, at + 8, 2, True) & 0x3FFF, ColorSpace="YUV", Compression_Mode="Lossy")
            seen = True
        elif name == b"VP8L" and size >= 5 and data[at] == 0x2F:
            bits = u(data, at + 1, 4, True)
            f.many(I, Width=(bits & 0x3FFF) + 1, Height=(bits >> 14 & 0x3FFF) + 1, ColorSpace="RGBA" if bits >> 28 & 1 else "RGB", Compression_Mode="Lossless")
            seen = True
    if seen:
        f.many(G, Format="WebP", ImageCount=1)
        f.many(I, Format="WebP", BitDepth=8)
    return seen


def ico(data: bytes, f: Found) -> bool:
    kind, n = u(data, 2, 2, True), u(data, 4, 2, True)
    if data[:2] != b"\0\0" or kind not in (1, 2) or not n or 6 + 16 * n > len(data):
        return False
    f.many(G, Format="ICO" if kind == 1 else "CUR", ImageCount=n)
    for k in range(n):
        at = 6 + 16 * k
        f.many(I, k, Format="ICO" if kind == 1 else "CUR", Width=data[at] or 256, Height=data[at + 1] or 256, BitDepth=(u(data, at + 6, 2, True) or None) if kind == 1 else None, StreamSize=u(data, at + 8, 4, True))
    return True


def tiff(data: bytes, f: Found) -> bool:
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return False
    little = data[:2] == b"II"
    at, tags = u(data, 4, 4, little), {}
    size_of = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
    for k in range(min(u(data, at, 2, little), 4096)):
        row = at + 2 + 12 * k
        tag, kind, n = u(data, row, 2, little), u(data, row + 2, 2, little), u(data, row + 4, 4, little)
        if kind not in size_of or n > 1 << 20:
            continue
        width = size_of[kind] * n
        where = row + 8 if width <= 4 else u(data, row + 8, 4, little)
        if kind == 2:
            tags[tag] = text(data[where : where + n])
        elif kind == 5:
            den = u(data, where + 4, 4, little)
            tags[tag] = u(data, where, 4, little) / den if den else None
        else:
            tags[tag] = u(data, where, size_of[kind], little)
    if 256 not in tags and 257 not in tags:
        return False
    f.many(G, Format="TIFF", ImageCount=1, Encoded_Application=tags.get(305), Encoded_Application_Name=tags.get(305), Make=tags.get(271), Model=tags.get(272), Artist=tags.get(315), Copyright=tags.get(33432), DateTime=tags.get(306), Description=tags.get(270))
    # Compressions and colour interpretations.
    packed = {1: "Raw", 2: "CCITT RLE", 3: "CCITT Group 3", 4: "CCITT Group 4", 5: "LZW", 6: "JPEG", 7: "JPEG", 8: "Deflate", 32773: "PackBits"}.get(tags.get(259, 1))
    space = {0: "Y", 1: "Y", 2: "RGB", 3: "Palette", 5: "CMYK", 6: "YUV", 8: "Lab"}.get(tags.get(262))
    exif(data, f)
    f.many(I, Format=packed, Format_Settings_Endianness="Little" if little else "Big", Width=tags.get(256), Height=tags.get(257), BitDepth=tags.get(258), Compression_Mode="Lossy" if packed == "JPEG" else "Lossless", ColorSpace=space)
    return True


# MPEG audio bit rates in kb/s by (version 1?, layer), sampling rates by version code, versions and channel modes.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
MODES = ("Stereo", "Joint stereo", "Dual mono", "Mono")


def mpeg_frame(data: bytes, at: int) -> tuple[int, int, int, int, int, int, int] | None:
    """(version code, layer, bit rate, sampling rate, samples, size, mode) of the frame at ``at``."""
    head = u(data, at, 4)
    version, layer, rate, sampling, pad, mode = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 12 & 15, head >> 10 & 3, head >> 9 & 1, head >> 6 & 3
    if head >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or sampling == 3:
        return None
    bps, hz = BITRATES[version == 3, layer][rate] * 1000, SAMPLING[version][sampling]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * bps // hz + pad) * 4 if layer == 1 else samples // 8 * bps // hz + pad
    return version, layer, bps, hz, samples, size, mode


def mp3(data: bytes, f: Found) -> bool:
    start = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        start = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + (10 if data[5] & 16 else 0)
    first = mpeg_frame(data, start)
    if not first:
        return False
    at, frames, size, rates = start, 0, 0, set()
    while frame := mpeg_frame(data, at):
        frames, size = frames + 1, size + frame[5]
        rates.add(frame[2])
        at += frame[5]
    version, layer, bps, hz, samples, _, mode = first
    head = data[start : start + 200]
    vbr = len(rates) > 1 or b"Xing" in head or b"VBRI" in head
    f.put(G, "Format", "MPEG Audio")
    rate = size * 8 * hz // (frames * samples) if vbr else bps
    f.many(A, Format="MPEG Audio", Format_Version=f"Version {VERSIONS[version]}", Format_Profile=f"Layer {layer}", Format_Settings_Mode=MODES[mode] if mode else None, BitRate_Mode="VBR" if vbr else "CBR", BitRate=rate, Channels=1 if mode == 3 else 2)
    f.many(A, SamplesPerFrame=samples, SamplingRate=hz, SamplingCount=frames * samples, FrameRate=three(hz / samples), FrameCount=frames, Duration=milliseconds(frames * samples, hz), Compression_Mode="Lossy", StreamSize=size)
    f.many(G, Duration=size * 8000 // rate if rate else None, OverallBitRate_Mode="VBR" if vbr else "CBR", AudioCount=1)
    f.put(G, "StreamSize", start, force=True)
    f.put(G, "OverallBitRate", rate, force=True)
    return True


def ogg(data: bytes, f: Found) -> bool:
    if data[:4] != b"OggS":
        return False
    at, heads, granules = 0, {}, {}
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        serial, segments = u(data, at + 14, 4, True), data[at + 26]
        body = at + 27 + segments
        if data[at + 5] & 2:
            heads[serial] = data[body : body + 64]
        if (granule := u(data, at + 6, 8, True)) < 1 << 63:
            granules[serial] = max(granule, granules.get(serial, 0))
        at = body + sum(data[at + 27 : body])
    f.many(G, Format="Ogg", InternetMediaType="audio/ogg")
    n = v = 0
    for serial, head in heads.items():
        if head[:7] == b"\x01vorbis":
            rate, nominal = u(head, 12, 4, True), u(head, 20, 4, True)
            ms = granules.get(serial, 0) * 1000 // rate if rate else 0
            places = LAYOUTS.get(head[11], (None, None))
            f.many(A, n, Format="Vorbis", ID=serial, BitRate_Mode="VBR", BitRate=nominal or None, Channels=head[11], ChannelPositions=places[0], ChannelLayout=places[1], SamplingRate=rate, SamplingCount=ms * rate // 1000, Duration=ms, StreamSize=nominal * ms // 8000 or None, Compression_Mode="Lossy", Format_Settings_Floor=1)
            n += 1
        elif head[:8] == b"OpusHead":
            ms = max(0, granules.get(serial, 0) - u(head, 10, 2, True)) * 1000 // 48000
            f.many(A, n, Format="Opus", ID=serial, Channels=head[9], SamplingRate=48000, Duration=ms, Compression_Mode="Lossy")
            n += 1
        elif head[:7] == b"\x80theora":
            v += 1
            f.many(V, v - 1, Format="Theora", ID=serial, Width=u(head, 10, 2) * 16, Height=u(head, 12, 2) * 16)
    f.many(G, AudioCount=n or None, VideoCount=v or None)
    return True


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """ISO media boxes: name, begin and end of the body. One that is cut off ends with the data."""
    while at + 8 <= end:
        size, name, body = u(data, at, 4), data[at + 4 : at + 8], at + 8
        if size == 1:
            size, body = u(data, at + 8, 8), at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            return
        yield name, body, min(stop, end)
        at = stop


def vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """EBML number at ``at`` and its length; (0, 0) where there's none."""
    first = data[at] if at < len(data) else 0
    if not first:
        return 0, 0
    size = 9 - first.bit_length()
    raw = u(data, at, size)
    return (raw if keep else raw & (1 << 7 * size) - 1), size


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """EBML elements that lie wholly before ``end``: id, begin and end of the body. A segment may be cut off."""
    while at < end:
        name, a = vint(data, at, True)
        size, b = vint(data, at + a, False)
        begin = at + a + b
        if not a or not b or (begin + size > end and name != 0x18538067):
            return
        yield name, begin, min(begin + size, end)
        at = begin + size


def avi(data: bytes, f: Found) -> bool:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return False
    f.many(G, Format="AVI", InternetMediaType="video/x-msvideo")
    n = {V: 0, A: 0}
    order = 0
    for name, at, size in chunks(data, 12, len(data), True):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, s in chunks(data, at + 4, at + size, True):
                if inner == b"avih" and s >= 40:
                    each, frames = u(data, a, 4, True), u(data, a + 16, 4, True)
                    f.put(G, "Duration", each * frames // 1000 or None)
                elif inner == b"LIST" and data[a : a + 4] == b"strl":
                    _avi_stream(data, a + 4, a + s, f, n, order)
                    order += 1
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for inner, a, s in chunks(data, at + 4, at + size, True):
                # Information chunks.
                field = {b"ISFT": "Encoded_Application", b"IART": "Performer", b"ICMT": "Comment", b"ICOP": "Copyright", b"ICRD": "Recorded_Date", b"IGNR": "Genre", b"INAM": "Title", b"IPRD": "Product", b"ISBJ": "Subject", b"ISRC": "Source"}.get(inner)
                if field:
                    f.put(G, field, text(data[a : a + s]))
    f.many(G, VideoCount=n[V] or None, AudioCount=n[A] or None)
    return True


def _avi_stream(data: bytes, at: int, end: int, f: Found, n: dict[int, int], order: int) -> None:
    head = form = None
    for name, a, s in chunks(data, at, end, True):
        if name == b"strh" and s >= 48:
            head = data[a : a + s]
        elif name == b"strf":
            form = data[a : a + s]
    if head is None or form is None:
        return
    scale, rate, length = u(head, 20, 4, True), u(head, 24, 4, True), u(head, 32, 4, True)
    if head[:4] == b"vids" and len(form) >= 20:
        codec, width, height = form[16:20].decode("latin-1").rstrip("\0"), u(form, 4, 4, True), abs(int.from_bytes(form[8:12], "little", signed=True))
        # Codec codes.
        name = {"XVID": "MPEG-4 Visual", "DIVX": "MPEG-4 Visual", "DX50": "MPEG-4 Visual", "FMP4": "MPEG-4 Visual", "H264": "AVC", "X264": "AVC", "avc1": "AVC", "MJPG": "JPEG", "HFYU": "HuffYUV", "FFV1": "FFV1"}.get(codec, codec or "RGB")
        f.many(V, n[V], StreamOrder=order, ID=order, Format=name, CodecID=codec or None, Width=width, Height=height, DisplayAspectRatio=three(width / height) if height else None, FrameRate=three(rate / scale) if scale else None, FrameCount=length, Duration=length * scale * 1000 // rate if rate else None)
        n[V] += 1
    elif head[:4] == b"auds" and len(form) >= 16:
        tag, channels, hz, per_second, _, bits = struct.unpack_from("<HHIIHH", form)
        name = {1: "PCM", 3: "PCM", 0x50: "MPEG Audio", 0x55: "MPEG Audio", 0xFF: "AAC", 0x2000: "AC-3", 0x2001: "DTS"}.get(tag)
        f.many(A, n[A], StreamOrder=order, ID=order, Format=name, CodecID=f"{tag:X}", Channels=channels, SamplingRate=hz, BitDepth=bits or None, BitRate=per_second * 8 or None)
        n[A] += 1


def y4m(data: bytes, f: Found) -> bool:
    if not data.startswith(b"YUV4MPEG2 "):
        return False
    f.put(G, "Format", "YUV4MPEG2")
    for token in data[10:4096].split(b"\n")[0].decode("latin-1").split():
        key, value = token[0], token[1:]
        if key in "WH" and value.isdecimal():
            f.put(V, {"W": "Width", "H": "Height"}[key], int(value))
        elif key == "F" and value.count(":") == 1 and all(x.isdecimal() and int(x) for x in value.split(":")):
            num, den = map(int, value.split(":"))
            f.put(V, "FrameRate", three(num / den))
        elif key == "C":
            f.put(V, "ChromaSubsampling", {"420": "4:2:0", "422": "4:2:2", "444": "4:4:4", "411": "4:1:1"}.get(value[:3]))
        elif key == "I":
            f.put(V, "ScanType", {"p": "Progressive", "t": "Interlaced", "b": "Interlaced"}.get(value))
    f.put(V, "Format", "YUV")
    return True


def swf(data: bytes, f: Found) -> bool:
    if data[:3] not in (b"FWS", b"CWS", b"ZWS") or len(data) < 8:
        return False
    f.many(G, Format="ShockWave", Format_Version=data[3], FileSize=u(data, 4, 4, True))
    body = data[8:]
    if data[:3] == b"CWS":
        try:
            body = zlib.decompressobj().decompress(body, 64)
        except zlib.error:
            return True
    if data[:3] != b"ZWS" and body:
        bits = body[0] >> 3
        packed = int.from_bytes(body[:32].ljust(32, b"\0"), "big")
        take = lambda k: packed >> (256 - 5 - bits * (k + 1)) & (1 << bits) - 1
        after = (5 + 4 * bits + 7) // 8
        f.many(V, Width=(take(1) - take(0)) // 20, Height=(take(3) - take(2)) // 20, FrameRate=three(u(body, after, 2, True) / 256), FrameCount=u(body, after + 2, 2, True))
        f.put(G, "VideoCount", 1)
    return True


class Bits:
    """Bits from the most significant one on; zeros after the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            self.left = 0
            return 0
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        """Unsigned Exp-Golomb number."""
        zeros = 0
        while self.left and not self.take(1):
            zeros += 1
        return (1 << zeros) - 1 + self.take(zeros) if zeros < 33 else 0

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def nal_units(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """Units between start codes in the first ``limit`` bytes, without emulation prevention."""
    end, at = min(len(data), limit), data.find(b"\0\0\1", 0, limit)
    while at >= 0:
        after = data.find(b"\0\0\1", at + 3, end)
        yield data[at + 3 : after if after >= 0 else end].replace(b"\0\0\3", b"\0\0").rstrip(b"\0")
        at = after


# Chroma formats and the sample aspect ratios of idc 1 to 16.
CHROMA = {0: None, 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
ASPECTS = ((1, 1), (12, 11), (10, 11), (16, 11), (40, 33), (24, 11), (20, 11), (32, 11), (80, 33), (18, 11), (15, 11), (64, 33), (160, 99), (4, 3), (3, 2), (2, 1))


# Sampling rates by index.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def aac_adts(data: bytes, f: Found) -> bool:
    if u(data, 0, 2) >> 4 != 0xFFF or len(data) < 7 or (data[2] >> 2 & 15) >= len(ADTS_RATES):
        return False
    profile, rate, channels = data[2] >> 6, ADTS_RATES[data[2] >> 2 & 15], (data[2] & 1) << 2 | data[3] >> 6
    at = frames = 0
    while u(data, at, 2) >> 4 == 0xFFF and at + 7 <= len(data):
        size = u(data, at + 3, 3) >> 5 & 0x1FFF
        if size < 7:
            break
        at, frames = at + size, frames + 1
    ms = milliseconds(frames * 1024, rate)
    f.many(G, Format="ADTS", AudioCount=1, StreamSize=0, OverallBitRate_Mode="VBR")
    places = LAYOUTS.get(channels, (None, None))
    f.many(A, Format="AAC", Format_Version="2" if data[1] & 8 else "4", Format_AdditionalFeatures={0: "Main", 1: "LC", 2: "SSR", 3: "LTP"}[profile], CodecID=profile + 1, BitRate_Mode="VBR", BitRate=len(data) * 8000 // ms if ms else None)
    f.many(A, Channels=channels or None, ChannelPositions=places[0], ChannelLayout=places[1], SamplesPerFrame=1024, SamplingRate=rate, FrameRate=three(rate / 1024), FrameCount=frames, SamplingCount=frames * 1024, Duration=ms or None, Compression_Mode="Lossy", StreamSize=len(data))
    return True


# Bit rates in kb/s, channels by acmod, sampling rates.
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def ac3(data: bytes, f: Found) -> bool:
    if data[:2] != b"\x0b\x77" or len(data) < 8:
        return False
    b, enhanced = Bits(data[2:16]), data[5] >> 3 > 10
    if enhanced:
        b.take(5)
        frame, code = (b.take(11) + 1) * 2, b.take(2)
        rate, blocks = (0, 6) if code == 3 else ((48000, 44100, 32000)[code], (1, 2, 3, 6)[b.take(2)])
        if code == 3:
            rate = (24000, 22050, 16000, 0)[b.take(2)]
        mode, low, bsid, dialnorm = b.take(3), b.take(1), b.take(5), b.take(5)
        samples = blocks * 256
    else:
        b.take(16)
        code, size, bsid, _, mode = b.take(2), b.take(6), b.take(5), b.take(3), b.take(3)
        if code == 3 or size // 2 >= len(AC3_RATES):
            return False
        rate, samples = (48000, 44100, 32000)[code], 1536
        frame = 2 * (AC3_RATES[size // 2] * 96000 // rate + (size & 1 if code == 1 else 0))
        if mode & 1 and mode != 1:
            b.take(2)
        if mode & 4:
            b.take(2)
        if mode == 2:
            b.take(2)
        low, dialnorm = b.take(1), b.take(5)
    if not rate:
        return False
    bps = frame * 8 * rate // samples if enhanced else AC3_RATES[size // 2] * 1000
    ms = int(len(data) * 8000 / bps + 0.5)
    name = "E-AC-3" if enhanced else "AC-3"
    f.many(G, Format=name, AudioCount=1)
    f.many(A, Format=name, Format_Settings_Endianness="Big", BitRate_Mode="CBR", BitRate=bps, Channels=AC3_CHANNELS[mode] + low, SamplesPerFrame=samples, SamplingRate=rate, FrameCount=len(data) // frame, SamplingCount=(ms * rate + 500) // 1000, FrameRate=three(rate / samples), Duration=ms, Compression_Mode="Lossy", StreamSize=ms * bps // 8000)
    f.many(A, ServiceKind="CM", bsid=bsid, dialnorm=-dialnorm if dialnorm else -31, acmod=mode, lfeon=low)
    return True


# Stream types of program maps.
TS_TYPES = {
    1: (V, "MPEG Video"), 2: (V, "MPEG Video"), 3: (A, "MPEG Audio"), 4: (A, "MPEG Audio"), 6: (None, None), 0x0F: (A, "AAC"), 0x10: (V, "MPEG-4 Visual"), 0x11: (A, "AAC"), 0x1B: (V, "AVC"), 0x24: (V, "HEVC"), 0x80: (A, "PCM"),
    0x81: (A, "AC-3"), 0x82: (A, "DTS"), 0x83: (A, "TrueHD"), 0x87: (A, "E-AC-3"), 0x90: (T, "PGS"), 0xEA: (V, "VC-1"),
}


def _sections(data: bytes, step: int, lead: int, pid: int, limit: int) -> Iterator[bytes]:
    """Tables that begin and end in one packet of a program id."""
    for at in range(lead, min(len(data), limit) - 187, step):
        if data[at] == 0x47 and u(data, at + 1, 2) & 0x5FFF == 0x4000 | pid:
            body = at + 4 + (1 + data[at + 4] if data[at + 3] & 0x20 else 0)
            body += 1 + data[body]
            size = u(data, body + 1, 2) & 0xFFF
            if body + 3 + size <= at + 188:
                yield data[body : body + 3 + size]


def mpeg_ts(data: bytes, f: Found) -> bool:
    step, lead = next(((s, o) for s, o in ((188, 0), (192, 4), (204, 0)) if len(data) >= 16 * s and all(data[o + s * k] == 0x47 for k in range(16))), (0, 0))
    limit = 2 << 20
    pat = next(_sections(data, step, lead, 0, limit), None) if step else None
    if pat is None or pat[0] != 0:
        return False
    f.many(G, Format="BDAV" if step == 192 else "MPEG-TS", InternetMediaType="video/mp2t", ID=u(pat, 3, 2))
    n, menus = {V: 0, A: 0, T: 0}, 0
    for at in range(8, len(pat) - 7, 4):
        program, pid = u(pat, at, 2), u(pat, at + 2, 2) & 0x1FFF
        pmt = next(_sections(data, step, lead, pid, limit), None) if program else None
        if pmt is None or pmt[0] != 2:
            continue
        k, order, formats = 12 + (u(pmt, 10, 2) & 0xFFF), 0, []
        while k + 5 <= len(pmt) - 4:
            code, es, more = pmt[k], u(pmt, k + 1, 2) & 0x1FFF, u(pmt, k + 3, 2) & 0xFFF
            kind, name = TS_TYPES.get(code, (None, None))
            tags, d = {}, k + 5
            while d + 2 <= min(k + 5 + more, len(pmt)):
                tags[pmt[d]] = pmt[d + 2 : d + 2 + pmt[d + 1]]
                d += 2 + pmt[d + 1]
            if code == 6:
                kind, name = next(((kd, nm) for t, kd, nm in ((0x6A, A, "AC-3"), (0x7A, A, "E-AC-3"), (0x7B, A, "DTS"), (0x59, T, "DVB Subtitle"), (0x56, T, "Teletext")) if t in tags), (None, None))
            if kind is not None:
                f.many(kind, n[kind], StreamOrder=f"{menus}-{order}", ID=es, MenuID=program, Format=name, CodecID=code, Language=text(tags[0x0A][:3]) if 0x0A in tags else None)
                n[kind] += 1
                formats.append(name)
            order += 1
            k += 5 + more
        f.many(M, menus, StreamOrder=menus, ID=pid, MenuID=program, Format=" / ".join(formats) or None)
        menus += 1
    f.many(G, VideoCount=n[V] or None, AudioCount=n[A] or None, TextCount=n[T] or None, MenuCount=menus or None)
    return True


def dsf(data: bytes, f: Found) -> bool:
    if data[:4] != b"DSD " or data[28:32] != b"fmt " or len(data) < 80:
        return False
    version, _, kind, channels, rate, bits, samples = struct.unpack("<IIIIIIQ", data[40 : 40 + struct.calcsize("<IIIIIIQ")])
    places = LAYOUTS.get(channels, (None, None))
    f.many(G, Format="DSF", Format_Version=version, AudioCount=1)
    f.many(A, Format="DSD", ChannelPositions=places[0], ChannelLayout=places[1], Channels=channels, SamplingRate=rate, Format_Settings_Endianness="Little" if bits == 1 else "Big", BitDepth=1, SamplingCount=samples, Duration=milliseconds(samples, rate) or None, Compression_Mode="Lossless", BitRate_Mode="CBR", BitRate=rate * channels)
    return True


def caf(data: bytes, f: Found) -> bool:
    if data[:4] != b"caff" or data[8:12] != b"desc" or len(data) < 52:
        return False
    rate, codec = struct.unpack(">d", data[20 : 20 + struct.calcsize(">d")])[0], data[28:32].decode("latin-1")
    _, per_packet, frames, channels, bits = struct.unpack(">IIIII", data[32 : 32 + struct.calcsize(">IIIII")])
    f.many(G, Format="CAF", Format_Version=u(data, 4, 2), AudioCount=1)
    name = {"lpcm": "PCM", "alac": "ALAC", "aac ": "AAC", "ima4": "ADPCM", "ulaw": "µ-law", "alaw": "A-law", ".mp3": "MPEG Audio"}.get(codec, codec)
    f.many(A, Format=name, SamplingRate=int(rate + 0.5) if 0 < rate < 1e9 else None, Channels=channels, BitDepth=bits or None, BitRate=int(rate * per_packet * 8 / frames) if frames and per_packet and 0 < rate < 1e9 else None)
    return True


def dts(data: bytes, f: Found) -> bool:
    if data[:4] != b"\x7f\xfe\x80\x01" or len(data) < 16:
        return False
    b = Bits(data[4:16])
    b.take(7)
    blocks, size, mode, hz, code = b.take(7) + 1, b.take(14) + 1, b.take(6), b.take(4), b.take(5)
    # Sampling rates, bit rates and channels by code.
    rate = {1: 8000, 2: 16000, 3: 32000, 6: 11025, 7: 22050, 8: 44100, 11: 12000, 12: 24000, 13: 48000}.get(hz)
    bps = dict(enumerate((32, 56, 64, 96, 112, 128, 192, 224, 256, 320, 384, 448, 512, 576, 640, 768, 960, 1024, 1152, 1280, 1344, 1408, 1411.2, 1472, 1509))).get(code)
    channels = (1, 2, 2, 2, 2, 3, 3, 4, 4, 5)[mode] if mode < 10 else None
    if not rate or size < 96:
        return False
    b.take(9)
    samples, low = blocks * 32, b.take(2) in (1, 2)
    f.many(G, Format="DTS", AudioCount=1)
    f.many(A, Format="DTS", Format_Settings_Endianness="Big", Format_Settings_Mode=16, BitRate_Mode="CBR", BitRate=int(bps * 1000) if bps else None, Channels=channels + low if channels else None, SamplingRate=rate, SamplesPerFrame=samples, FrameRate=three(rate / samples), SamplingCount=len(data) // size * samples, Duration=milliseconds(len(data) // size * samples, rate), Compression_Mode="Lossy", StreamSize=len(data))
    return True


# Public EXIF tags, by directory.
EXIF_TAGS = {
    254: "SubfileType", 255: "OldSubfileType", 256: "ImageWidth", 257: "ImageHeight", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 266: "FillOrder", 269: "DocumentName", 270: "ImageDescription", 271: "Make",
    272: "Model", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 285: "PageName", 296: "ResolutionUnit", 297: "PageNumber", 305: "Software", 306: "DateTime",
    315: "Artist", 316: "HostComputer", 317: "Predictor", 318: "WhitePoint", 319: "PrimaryChromaticities", 322: "TileWidth", 323: "TileLength", 338: "ExtraSamples", 339: "SampleFormat", 513: "ThumbnailOffset", 514: "ThumbnailLength",
    529: "YCbCrCoefficients", 530: "YCbCrSubSampling", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 18246: "Rating", 18249: "RatingPercent", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram",
    34852: "SpectralSensitivity", 34855: "PhotographicSensitivity", 34864: "SensitivityType", 34865: "StandardOutputSensitivity", 34866: "RecommendedExposureIndex", 34867: "ISOSpeed", 34868: "ISOSpeedLatitudeyyy", 34869: "ISOSpeedLatitudezzz",
    36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime", 36881: "OffsetTimeOriginal", 36882: "OffsetTimeDigitized", 37121: "ComponentsConfiguration", 37122: "CompressedBitsPerPixel",
    37377: "ShutterSpeedValue", 37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue", 37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength",
    37396: "SubjectArea", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 37522: "SubSecTimeDigitized", 37888: "AmbientTemperature", 37889: "Humidity", 37890: "Pressure", 37891: "WaterDepth", 37892: "Acceleration", 37893: "CameraElevationAngle",
    40960: "FlashpixVersion", 40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 40964: "RelatedSoundFile", 41483: "FlashEnergy", 41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution",
    41488: "FocalPlaneResolutionUnit", 41492: "SubjectLocation", 41493: "ExposureIndex", 41495: "SensingMethod", 41728: "FileSource", 41729: "SceneType", 41985: "CustomRendered", 41986: "ExposureMode", 41987: "WhiteBalance",
    41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType", 41991: "GainControl", 41992: "Contrast", 41993: "Saturation", 41994: "Sharpness", 41996: "SubjectDistanceRange", 42016: "ImageUniqueID",
    42032: "CameraOwnerName", 42033: "BodySerialNumber", 42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber", 42080: "CompositeImage", 42240: "Gamma", 50341: "PrintIM",
}
GPS_TAGS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef",
    13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 19: "GPSDestLatitudeRef", 20: "GPSDestLatitude", 21: "GPSDestLongitudeRef", 22: "GPSDestLongitude",
    23: "GPSDestBearingRef", 24: "GPSDestBearing", 25: "GPSDestDistanceRef", 26: "GPSDestDistance", 29: "GPSDateStamp", 30: "GPSDifferential", 31: "GPSHPositioningError",
}
INTEROP_TAGS = {1: "InteropIndex", 2: "InteropVersion"}
APPLE_TAGS = {
    1: "MakerNoteVersion", 4: "AEStable", 5: "AETarget", 6: "AEAverage", 7: "AFStable", 8: "AccelerationVector", 12: "FocusDistanceRange", 17: "ContentIdentifier", 20: "ImageCaptureType", 23: "LivePhotoVideoIndex", 31: "PhotosAppFeatureFlags",
    33: "HDRHeadroom", 39: "SignalToNoiseRatio", 43: "PhotoIdentifier", 45: "ColorTemperature", 46: "CameraType", 47: "FocusPosition",
}
X, N = 7, 12
_EXIF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def directory(data: bytes, at: int, little: bool, names: dict[int, str]) -> tuple[dict[str, object], dict[int, tuple[int, int]], int]:
    """The named values of a TIFF directory, where each tag's bytes lie, and where the next directory begins."""
    order, found, places = "little" if little else "big", {}, {}
    rows = min(u(data, at, 2, little), 512)
    for row in range(at + 2, at + 2 + 12 * rows, 12):
        tag, kind, n = u(data, row, 2, little), u(data, row + 2, 2, little), u(data, row + 4, 4, little)
        width = _EXIF_SIZES.get(kind, 0)
        where = row + 8 if width * n <= 4 else u(data, row + 8, 4, little)
        if not width or not 0 < n <= 1 << 20 or where + width * n > len(data):
            continue
        places[tag] = where, width * n
        if tag not in names or n > 1 << 16:
            continue
        if kind == 2:
            value = text(bytes(data[where : where + n]), "latin-1")
        elif kind in (5, 10):
            pairs = [(int.from_bytes(data[k : k + 4], order, signed=kind == 10), int.from_bytes(data[k + 4 : k + 8], order, signed=kind == 10)) for k in range(where, where + 8 * min(n, 8), 8)]
            value = [a / b if b else 0.0 for a, b in pairs]
        elif kind == 7:
            raw = bytes(data[where : where + min(n, 64)])
            value = raw.decode("ascii").strip("\0 ") or None if raw.isascii() and raw.strip(b"\0").decode("ascii").isprintable() else None
        elif kind in (11, 12):
            value = [float(x) for x in struct.unpack(f"{'<' if little else '>'}{min(n, 8)}{'f' if kind == 11 else 'd'}", data[where : where + width * min(n, 8)])]
        elif kind in (6, 8, 9):
            value = int.from_bytes(data[where : where + width], order, signed=True)
        else:
            value = [float(u(data, k, width, little)) for k in range(where, where + width * min(n, 8), width)] if 1 < n <= 8 else u(data, where, width, little)
        if value is not None:
            found.setdefault(names[tag], value)
    return found, places, u(data, at + 2 + 12 * rows, 4, little)


def _shown(value) -> str:
    return (f"{value[0]:g}" if len(value) == 1 else " ".join(f"{v:g}" for v in value)) if isinstance(value, list) else str(value)


def apple_note(note: bytes, f: Found) -> bool:
    """Apple's maker note: its own directory after 14 bytes, with offsets from its start."""
    if note[:10] != b"Apple iOS\0" or note[12:14] not in (b"MM", b"II"):
        return False
    found, _, _ = directory(note, 14, note[12:14] == b"II", APPLE_TAGS)
    for name, value in found.items():
        f.put(N, name, _shown(value))
    return bool(found)


def lens(found: dict) -> str | None:
    """The lens by its specification (least and largest focal length and their apertures), as 24-70mm f/2.8."""
    spec = found.get("LensSpecification")
    if not isinstance(spec, list) or len(spec) != 4 or not spec[0]:
        return None
    span = lambda a, b: f"{a:g}" if a == b or not b else f"{a:g}-{b:g}"
    return f"{span(spec[0], spec[1])}mm" + (f" f/{span(spec[2], spec[3])}" if spec[2] else "")


def exif(data: bytes, f: Found) -> bool:
    """Fields of a TIFF structure, as JPEG's Exif segment or a TIFF file has them: its first directory with those for Exif,
    positions and interoperability, the thumbnail's, and Apple's maker note. Positions come in degrees as well."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return False
    little = data[:2] == b"II"
    found, places, after = directory(data, u(data, 4, 4, little), little, EXIF_TAGS)
    inner: dict[int, tuple[int, int]] = {}
    for tag, names in ((34665, EXIF_TAGS), (34853, GPS_TAGS)):
        if tag in places:
            more, inside, _ = directory(data, u(data, places[tag][0], 4, little), little, names)
            found = {**more, **found} if tag == 34853 else found | {k: v for k, v in more.items() if k not in found}
            inner |= inside if tag == 34665 else {}
    if 40965 in inner:
        found |= directory(data, u(data, inner[40965][0], 4, little), little, INTEROP_TAGS)[0]
    if after:
        small, _, _ = directory(data, after, little, EXIF_TAGS)
        found |= {k: v for k, v in small.items() if k.startswith("Thumbnail")}
    for name, value in found.items():
        f.put(X, name, _shown(value))
    f.put(X, "LensSpec", lens(found))
    for axis, minus in (("Latitude", "S"), ("Longitude", "W")):
        parts = found.get(f"GPS{axis}")
        if isinstance(parts, list) and len(parts) >= 3:
            f.put(X, f"GPS{axis}Decimal", f"{(parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if found.get(f'GPS{axis}Ref') == minus else 1):.6f}")
    if 37500 in inner:
        apple_note(bytes(data[inner[37500][0] : sum(inner[37500])]), f)
    return bool(found)


#: Kernels by the name of their parser.
KERNELS: dict[str, Callable[[bytes, Found], bool]] = {
    "wav": wav, "aiff": aiff, "flac": flac, "png": png, "jpeg": jpeg, "webp": webp, "ico": ico, "tiff": tiff, "mp3": mp3, "ogg": ogg, "avi": avi, "y4m": y4m, "swf": swf,
    "aac_adts": aac_adts, "ac3": ac3, "mpeg_ts": mpeg_ts, "dsf": dsf, "caf": caf, "dts": dts,
}
