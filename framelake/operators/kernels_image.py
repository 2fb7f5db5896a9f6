"""Images and texts that have to be walked or computed (see kernels)."""

from __future__ import annotations

import re
import struct

from framelake.operators.kernels import G, I, T, Found, boxes, three, u


def _image(f: Found, name: str, **image) -> None:
    f.many(G, Format=name, ImageCount=1)
    f.many(I, Format=name, **image)


# Compression and colour space by image type.
TGA_TYPES = {1: ("Color-mapped", "RGB"), 2: ("Raw", "RGB"), 3: ("Raw", "Y"), 9: ("Color-mapped + RLE", "RGB"), 10: ("RLE", "RGB"), 11: ("RLE", "Y"), 32: ("Huffman", "RGB"), 33: ("Huffman", "RGB")}


def tga(data: bytes, f: Found) -> bool:
    if len(data) < 18:
        return False
    title, mapped, kind, depth, width, height = data[0], data[1], data[2], data[16], u(data, 12, 2, True), u(data, 14, 2, True)
    if kind not in TGA_TYPES or mapped != (kind in (1, 9)) or depth not in (8, 16, 24, 32) or not width or not height:
        return False
    name = bytes(data[18 : 18 + title]).decode("utf-8", "replace").rstrip("\0") if 18 + title <= len(data) else ""
    f.many(G, Format="TGA", Title=name or None, ImageCount=1, Format_Version="Version 2" if len(data) >= 26 and data[len(data) - 18 :] == b"TRUEVISION-XFILE.\0" else None)
    packing, space = TGA_TYPES[kind]
    f.many(I, Format=packing, CodecID=kind, ColorSpace=space, Width=width, Height=height, BitDepth=depth)
    return True


# Colour space and subsampling by descriptor.
DPX_DESCRIPTORS = {
    0: ("User-defined", None), 1: ("Y", None), 2: ("Y", None), 3: ("Y", None), 4: ("A", None), 6: ("Y", None), 7: ("YUV", None), 8: ("YUV", None), 9: ("YUV", None), 50: ("RGB", None), 51: ("RGBA", None), 52: ("ABGR", None),
    100: ("YUV", "4:2:2"), 101: ("YUV", "4:2:2"), 102: ("YUV", "4:4:4"), 103: ("YUV", "4:4:4"),
}


def dpx(data: bytes, f: Found) -> bool:
    mark = data[:4]
    if mark not in (b"SDPX", b"XPDS", b"\x80\x2a\x5f\xd7", b"\xd7\x5f\x2a\x80") or len(data) < 32:
        return False
    little = mark in (b"XPDS", b"\xd7\x5f\x2a\x80")
    end = "Little" if little else "Big"
    if mark not in (b"SDPX", b"XPDS"):
        f.put(G, "Format", "Cineon")
        f.many(I, Format="Cineon", Format_Settings_Endianness=end)
        return True
    if len(data) < 808:
        return False
    version = bytes(data[8:16]).decode("utf-8", "replace").rstrip("\0").strip().lstrip("V") or None
    creator = bytes(data[160:260]).decode("utf-8", "replace").rstrip("\0") or None
    width, height = u(data, 772, 4, little), u(data, 776, 4, little)
    space, chroma = DPX_DESCRIPTORS.get(data[800], (None, None))
    packing = {0: "Packed", 1: "Filled, method A", 2: "Filled, method B"}.get(u(data, 804, 2, little))
    f.many(G, Format="DPX", ImageCount=1, Format_Version=version, Encoded_Library=creator, StreamSize=0)
    f.many(I, Format="DPX", Format_Version=version, Format_Settings_Endianness=end, Format_Settings_Packing=packing, Format_Compression={0: "Raw", 1: "RLE"}.get(u(data, 806, 2, little)), Width=width or None, Height=height or None)
    if width and height:
        f.many(I, PixelAspectRatio="1.000", DisplayAspectRatio=three(width / height))
    f.many(I, ColorSpace=space, ChromaSubsampling=chroma, BitDepth=data[803], Compression_Mode="Lossless", StreamSize=len(data), colour_description_present="Yes", Encoded_Library=creator)
    return True


EXR_COMPRESSIONS = ("raw", "RLZ", "ZIPS", "ZIP", "PIZ", "PXR24", "B44", "B44A")


def exr(data: bytes, f: Found) -> bool:
    if data[:4] != b"\x76\x2f\x31\x01" or len(data) < 8:
        return False
    head, at, found = bytes(data[: 1 << 18]), 8, {}
    while at < len(head) and head[at]:
        row = re.compile(rb"([^\0]{1,1023})\0([^\0]{0,1023})\0(.{4})", re.S).match(head, at)
        if not row or row.end() + (size := u(row[3], 0, 4, True)) > len(head):
            break
        found[row[1].decode("utf-8", "replace"), row[2].decode("utf-8", "replace")] = head[row.end() : row.end() + size]
        at = row.end() + size
    window, packed, shape, rate = (found.get(k, b"") for k in (("displayWindow", "box2i"), ("compression", "compression"), ("pixelAspectRatio", "float"), ("framesPerSecond", "rational")))
    width = height = 0
    if len(window) == 16:
        x0, y0, x1, y1 = struct.unpack("<4i", window)
        width, height = x1 - x0 + 1 & 0xFFFFFFFF, y1 - y0 + 1 & 0xFFFFFFFF
    compression = EXR_COMPRESSIONS[packed[0]] if len(packed) == 1 and packed[0] < 8 else None
    comment = found.get(("comments", "string"))
    f.many(G, Format="EXR", Format_Version=data[4], ImageCount=1, Comment=comment[:4096].decode("utf-8", "replace") if comment else None, StreamSize=0)
    f.many(I, Format="EXR", Format_Version=data[4], Format_Profile="Tile" if data[5] & 2 else "Line", Format_Compression=compression, Width=width or None, Height=height or None, DisplayAspectRatio=three(width / height) if width and height else None)
    if len(shape) == 4:
        f.put(I, "PixelAspectRatio", three(struct.unpack("<f", shape)[0]))
    if len(rate) == 8 and u(rate, 4, 4, True):
        f.put(I, "FrameRate", three(u(rate, 0, 4, True) / u(rate, 4, 4, True)))
    f.many(I, Compression_Mode=("Lossless" if compression in EXR_COMPRESSIONS[:5] else "Lossy") if compression else None, StreamSize=len(data))
    return True


def bpg(data: bytes, f: Found) -> bool:
    if data[:4] != b"BPG\xfb" or len(data) < 6:
        return False

    def number(at: int) -> tuple[int, int]:
        """As many bytes as the first has leading ones, and one more (five at most); the bits after that mark count."""
        if at >= len(data):
            return 0, at
        size = min(5, 9 - (~data[at] & 0xFF).bit_length()) if data[at] != 0xFF else 5
        raw = u(data, at, size)
        return raw & (1 << 8 * size - size) - 1, at + size

    width, at = number(6)
    height, _ = number(at)
    pixel, space = data[4] >> 5, data[5] >> 4
    _image(f, "BPG", Width=width, Height=height, ColorSpace={0: "YUV", 1: "RGB", 2: "YCgCo", 3: "YUV", 4: "YUV"}.get(space), ChromaSubsampling={1: "4:2:0", 2: "4:2:2", 3: "4:4:4", 4: "4:2:0", 5: "4:2:2"}.get(pixel), BitDepth=(data[4] & 15) + 8, colour_primaries={0: "BT.601", 3: "BT.701", 4: "BT.2020"}.get(space))
    return True


def jp2(data: bytes, f: Found) -> bool:
    if data[:2] == b"\xff\x4f":
        width = height = planes = depth = 0
        at, end = 2, min(len(data), 128)
        while at + 4 <= end:
            mark, size = u(data, at, 2), u(data, at + 2, 2)
            if mark == 0xFF51 and at + 45 <= end and at + 2 + size <= end:
                width, height, planes = u(data, at + 6, 4), u(data, at + 10, 4), u(data, at + 38, 2)
                depth = (data[at + 40] & 127) + 1 if planes else 0
                break
            if mark in (0xFF90, 0xFF93, 0xFFD9):
                size = 0
            at += 2 + size
        f.many(I, Format="JPEG 2000", Format_Info="JPEG 2000 codestream (J2K)", Width=width or None, Height=height or None, BitDepth_Planes=planes or None, BitDepth=depth or None)
        return True
    if data[:12] != b"\0\0\0\x0cjP  \r\n\x87\n":
        return False
    head, found = bytes(data[:4096]), None
    for name, a, b in boxes(head, 12, len(head)):
        if name == b"jp2h":
            found = next((head[x:y] for n, x, y in boxes(head, a, b) if n == b"ihdr" and y - x >= 12), found)
    f.put(I, "Format", "JPEG 2000")
    if found is None or found[11] == 7:
        f.put(I, "Format_Info", "JPEG 2000 file format (JP2)")
    if found is not None:
        depth = found[10]
        f.many(I, Width=u(found, 4, 4) or None, Height=u(found, 0, 4) or None, BitDepth_Planes=u(found, 8, 2) or None, BitDepth=(depth & 127) + 1 if depth else None, Format_Settings_Sign="Signed" if depth & 128 else None)
    return True


AMIGA_KINDS = {1: "Disk", 2: "Drawer", 3: "Tool", 4: "Project", 5: "Garbage", 6: "Kick", 8: "AppIcon"}


def amiga_icon(data: bytes, f: Found) -> bool:
    if data[:2] != b"\xe3\x10" or len(data) < 78:
        return False
    raw = bytes(data[: 1 << 18])
    drawer, images, at = u(raw, 66, 4), [], 78
    at += 56 if drawer and at + 56 <= len(raw) else 0
    classic = None
    for k, present in enumerate((u(raw, 22, 4), u(raw, 26, 4))):
        if present and at + 20 <= len(raw):
            width, height, depth = (u(raw, at + 4 + 2 * n, 2) for n in range(3))
            at += 20
            if width and height and 0 < depth <= 8 and (size := (width + 15) // 16 * 2 * height * depth) <= len(raw) - at:
                at += size
            if k == 0:
                classic = width, height, depth
    if classic and classic[0] and classic[1]:
        images.append({"Format": "Raw", "Format_Profile": "Classic", "ColorSpace": "RGB", "Width": classic[0], "Height": classic[1], "BitDepth": classic[2]})
    texts = [u(raw, 50, 4), u(raw, 54, 4), u(raw, 70, 4)]  # default tool, tool types, tool window
    for k, present in enumerate(texts):
        if not present or at + 4 > len(raw):
            continue
        size, at = u(raw, at, 4), at + 4
        if k != 1:
            at = min(len(raw), at + size)
            continue
        for _ in range(max(0, size // 4 - 1)):
            if at + 4 > len(raw):
                break
            length, at = u(raw, at, 4), at + 4
            entry = raw[at : at + length]
            if entry[:4] == b"IM1=" and length >= 9 and len(entry) >= 9 and min(entry[5:7]) > 0x21 and not any(i["Format_Profile"] == "NewIcon" for i in images):
                images.append({"Format": "Raw", "Format_Profile": "NewIcon", "ColorSpace": "RGB", "Width": entry[5] - 0x21, "Height": entry[6] - 0x21})
            at += length
    form = raw.find(b"FORM", at)
    while form >= 0 and raw[form + 8 : form + 12] != b"ICON":
        form = raw.find(b"FORM", form + 1)
    if form >= 0:
        face, picture, argb, p, end = None, None, False, form + 12, min(len(raw), form + 8 + u(raw, form + 4, 4))
        while p + 8 <= end:
            name, size, body = raw[p : p + 4], u(raw, p + 4, 4), p + 8
            if name == b"FACE" and size >= 4:
                face = raw[body] + 1, raw[body + 1] + 1
            elif name == b"IMAG" and size >= 10 and picture is None:
                picture = raw[body + 3], raw[body + 5]
            argb = argb or name == b"ARGB"
            if not size:
                break
            p = body + size + size % 2
        if face and picture:
            images.append({"Format": "RLE" if picture[0] == 1 else "Raw", "Format_Profile": "GlowIcon", "ColorSpace": "RGB", "Width": face[0], "Height": face[1], "BitDepth": picture[1]})
        if face and argb:
            images.append({"Format": "Raw", "Format_Profile": "ARGB", "ColorSpace": "RGBA", "Width": face[0], "Height": face[1], "BitDepth": 32})
    f.many(G, Format="Amiga Icon", Format_Profile=AMIGA_KINDS.get(raw[48]))
    for pos, fields in enumerate(images):
        f.many(I, pos, **fields)
    return True


def gain_map(data: bytes, f: Found) -> bool:
    if len(data) < 5 or data[:3] != b"\0\0\0":
        return False
    f.put(G, "Format", "Gain Map")
    f.many(I, Format="Gain Map", Format_Version=0)
    if len(data) < 22:
        return True

    def ratio(at: int, signed: bool) -> str | None:
        top, below = int.from_bytes(data[at : at + 4], "big", signed=signed), u(data, at + 4, 4)
        return f"{struct.unpack('<f', struct.pack('<f', top / below))[0]:.6f}" if below else None

    many = bool(data[5] & 128)
    f.many(I, WriterVersion=u(data, 3, 2), IsMultichannel="Yes" if many else "No", UseBaseColourSpace="Yes" if data[5] & 64 else "No", BaseHdrHeadroom=ratio(6, False), AlternateHdrHeadroom=ratio(14, False))
    for k in range(3 if many else 1):
        at = 22 + 40 * k
        if at + 40 > len(data):
            break
        for n, (name, signed) in enumerate((("GainMapMin", True), ("GainMapMax", True), ("Gamma", False), ("BaseOffset", True), ("AlternateOffset", True))):
            f.put(I, f"{name}_Channel{k + 1}" if many else name, ratio(at + 8 * n, signed))
    return True


# Categories of Kate streams.
KATE_CATEGORIES = {
    "CC": "Closed caption", "SUB": "Subtitles", "TAD": "Textual audio descriptions", "KTV": "Karaoke", "TIK": "Ticker text", "AR": "Active regions", "NB": "Semantic annotations", "META": "Metadata, mostly machine-readable",
    "TRX": "Transcript", "LRC": "Lyrics", "LIN": "Linguistic markup", "CUE": "Cue points", "K-SLD-I": "Slides, as images", "K-SLD-T": "Slides, as text",
}


def kate(data: bytes, f: Found) -> bool:
    if data[:8] != b"\x80kate\0\0\0" or len(data) < 64:
        return False
    language, category = (bytes(data[a : a + 16]).split(b"\0")[0].decode("utf-8", "replace") for a in (32, 48))
    f.many(G, Format="Kate", TextCount=1)
    f.many(T, Format="Kate", Codec="Kate", Language=language or None, Language_More=KATE_CATEGORIES.get(category, category) or None)
    return True


_PAIR = r"00:..:..:..{0}00:..:..:"


def other_text(data: bytes, f: Found) -> bool:
    """Subtitle texts, told by their first lines."""
    if len(data) < 0x200:
        return False
    body = bytes(data[: 1 << 16])
    try:
        read = body.decode("utf-8")
    except UnicodeDecodeError as e:
        read = body[: e.start].decode("utf-8")
    if len(read.encode()) < 0x100:
        return False
    lines = read.replace("\r\n", "\n").replace("\r", "\n").split("\n")[:32]
    first, second, third = (*lines, "", "", "")[:3]
    pair = lambda line: len(line) > 23 and re.match(r"00:..:..:.. 00:..:..:", line)
    script = first == "[Script Info]"
    # Name, more about it, codec; the first that fits counts.
    rules = (
        (script and {"ScriptType: v4.00", "Script Type: V4.00"} & set(lines) and "[V4 Styles]" in lines, "SSA", "SubStation Alpha", "SSA"),
        (script and {"ScriptType: v4.00+", "Script Type: V4.00+"} & set(lines) and "[V4+ Styles]" in lines, "ASS", "Advanced SubStation Alpha", "ASS"),
        (pair(first), "Adobe encore DVD", None, "Adobe"),
        (re.fullmatch(r"-->> 0.{5}", first) and second, "AQTitle", None, "AQTitle"),
        (len(first) > 28 and re.match(r"00:..:..:.. , 00:..:..:.. . ", first), "Captions 32", None, "Caption 32"),
        (first == "*Timecode type: PAL/EBU" and not second and pair(third), "Captions Inc", None, "Captions Inc"),
        (first[:1] == "*" and len(first) > 1 and "** Caption Number 1" in lines, "Cheeta", None, "Cheeta"),
        (re.match(r"~CPC.{5}~.", first) and len(second) > 8 and re.match(r"00:..:..:", second), "CPC Captioning", None, "CPC Captioning"),
        (first.startswith("<SAMI>"), "SAMI", None, "SAMI"),
    )
    for fits, name, more, codec in rules:
        if fits:
            f.many(G, Format=name, Format_Info=more)
            f.many(T, Format=name, Codec=codec)
            return True
    return False


def crc16(data: bytes) -> int:
    """CRC with the polynomial x^16 + x^12 + x^5 + 1, from 0."""
    value = 0
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x1021 if value & 0x8000 else 0)) & 0xFFFF
    return value


def arib(data: bytes, f: Found) -> bool:
    size = u(data, 3, 2)
    total = 7 + size
    if not size or not data or (data[0] >> 2 & 31) > 8 or total > min(len(data), 4096) or crc16(bytes(data[:total])):
        return False
    f.put(G, "Format", "ARIB STD B24/B37")
    f.put(T, "Format", "ARIB STD B24/B37")
    return True


def timed_text(data: bytes, f: Found) -> bool:
    size = u(data, 0, 2)
    if len(data) < 3 or not size or size + 2 > len(data):
        return False
    try:
        bytes(data[2 : 2 + size]).decode("utf-8")
    except UnicodeDecodeError:
        return False
    f.put(T, "Format", "Timed Text")
    return True


KERNELS = {"tga": tga, "dpx": dpx, "exr": exr, "bpg": bpg, "jp2": jp2, "amiga_icon": amiga_icon, "gain_map": gain_map, "kate": kate, "other_text": other_text, "arib_std_b24_b37": arib, "timed_text": timed_text}
