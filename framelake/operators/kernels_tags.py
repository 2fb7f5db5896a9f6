"""Tags that stand beside a file's own fields: ID3, APE, Lyrics3, XMP, IPTC, ICC, C2PA and property lists (see kernels).

They are looked for once a parser has accepted a file, and give streams of their own kinds where they have one."""

from __future__ import annotations

import re
import struct
from html import unescape

from framelake.model import KINDS
from framelake.operators.kernels import G, Found, u

IPTC, XMP, ICC, C2PA = (KINDS.index(k) for k in ("Iptc", "Xmp", "Icc", "C2pa"))
SCAN = 1 << 20  # bytes at either end that are searched

# Fields by tag.
ID3_FRAMES = {
    "TIT2": "Title", "TPE1": "Performer", "TALB": "Album", "TRCK": "Track/Position", "TPOS": "Part/Position", "TCON": "Genre", "TDRC": "Recorded_Date", "TYER": "Recorded_Date", "TCOM": "Composer", "TPE2": "Album/Performer", "TENC": "EncodedBy",
    "TSSE": "Encoded_Library", "TCOP": "Copyright", "TPUB": "Publisher", "TBPM": "BPM", "TLAN": "Language", "TSRC": "ISRC", "COMM": "Comment", "USLT": "Lyrics", "TT2": "Title", "TP1": "Performer", "TAL": "Album", "TRK": "Track/Position",
    "TCO": "Genre", "TYE": "Recorded_Date", "COM": "Comment",
}
APE_ITEMS = {
    "title": "Title", "artist": "Performer", "album": "Album", "year": "Recorded_Date", "track": "Track/Position", "genre": "Genre", "comment": "Comment", "composer": "Composer", "copyright": "Copyright", "publisher": "Publisher", "isrc": "ISRC",
}
GENRES = (
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae", "Rock", "Techno", "Industrial", "Alternative", "Ska", "Death Metal", "Pranks",
    "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance", "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise",
)
IPTC_SETS = {
    5: "ObjectName", 10: "Urgency", 15: "Category", 25: "Keywords", 30: "ServiceIdentifier", 55: "DateCreated", 60: "TimeCreated", 65: "OriginatingProgram", 80: "Byline", 85: "BylineTitle", 90: "City", 95: "ProvinceState", 100: "CountryCode",
    101: "Country", 105: "Headline", 110: "Credit", 115: "Source", 116: "Copyright", 118: "Contact", 120: "Caption", 122: "CaptionWriter",
}
ICC_CLASSES = {"scnr": "Input Device Profile", "mntr": "Display Device Profile", "prtr": "Output Device Profile", "link": "DeviceLink Profile", "spac": "ColorSpace Conversion Profile", "abst": "Abstract Profile", "nmcl": "NamedColor Profile"}
ICC_INTENTS = ("Perceptual", "Media-Relative Colorimetric", "Saturation", "ICC-Absolute Colorimetric")


def _sized(raw: bytes) -> int:
    """Four groups of seven bits."""
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if len(raw) == 4 else 0


def _decoded(raw: bytes) -> str | None:
    """A text that begins with the code of its encoding."""
    if not raw:
        return None
    body = raw[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1"), "replace")
    return " / ".join(p for p in body.split("\0") if p).strip() or None


def id3v2(data: bytes, f: Found) -> bool:
    if data[:3] != b"ID3" or len(data) < 10:
        return False
    version, end, at = data[3], 10 + _sized(data[6:10]), 10
    if data[5] & 64 and version > 2:
        at += _sized(data[10:14]) if version == 4 else 4 + u(data, 10, 4)
    head = 6 if version == 2 else 10
    while at + head <= min(end, len(data)):
        name = bytes(data[at : at + (3 if version == 2 else 4)]).decode("latin-1")
        size = u(data, at + 3, 3) if version == 2 else _sized(data[at + 4 : at + 8]) if version == 4 else u(data, at + 4, 4)
        if not name.strip("\0") or not size or at + head + size > end:
            break
        body = bytes(data[at + head : at + head + min(size, 1 << 16)])
        field = ID3_FRAMES.get(name)
        if field in ("Comment", "Lyrics") and len(body) > 4:
            wide = body[0] in (1, 2)
            rest = body[4:]
            cut = next((k + 2 for k in range(0, len(rest) - 1, 2) if rest[k : k + 2] == b"\0\0"), 0) if wide else rest.find(b"\0") + 1
            f.put(G, field, _decoded(body[:1] + rest[cut:]))
        elif field:
            value = _decoded(body)
            if field == "Genre" and value and (m := re.fullmatch(r"\(?(\d+)\)?", value)) and int(m[1]) < len(GENRES):
                value = GENRES[int(m[1])]
            f.put(G, field, value)
        elif name in ("APIC", "PIC"):
            f.put(G, "Cover", "Yes")
        at += head + size
    return True


def id3v1(data: bytes, f: Found) -> bool:
    tag = bytes(data[len(data) - 128 :]) if len(data) >= 128 else b""
    if tag[:3] != b"TAG":
        return False
    word = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").strip() or None
    f.many(G, Title=word(3, 33), Performer=word(33, 63), Album=word(63, 93), Recorded_Date=word(93, 97), Comment=word(97, 127), Genre=GENRES[tag[127]] if tag[127] < len(GENRES) else None)
    if not tag[125] and tag[126]:
        f.put(G, "Track/Position", tag[126])
    return True


def ape_tag(data: bytes, f: Found) -> bool:
    """At the end of the file, before an ID3v1 tag if there is one."""
    for end in (len(data), len(data) - 128):
        foot = bytes(data[end - 32 : end]) if end >= 32 else b""
        if foot[:8] != b"APETAGEX":
            continue
        size, n = u(foot, 12, 4, True), u(foot, 16, 4, True)
        at = end - size
        for _ in range(min(n, 1024)):
            length, flags = u(data, at, 4, True), u(data, at + 4, 4, True)
            key, _, _ = bytes(data[at + 8 : at + 8 + 256]).partition(b"\0")
            start = at + 9 + len(key)
            if start + length > end:
                break
            name = key.decode("latin-1")
            if not flags >> 1 & 3 and length <= 1 << 16:
                f.put(G, APE_ITEMS.get(name.lower(), name), bytes(data[start : start + length]).decode("utf-8", "replace").replace("\0", " / ") or None, extra=name.lower() not in APE_ITEMS)
            at = start + length
        return True
    return False


def lyrics3(data: bytes, f: Found) -> bool:
    for end in (len(data), len(data) - 128):
        foot = bytes(data[end - 15 : end]) if end >= 15 else b""
        if foot[6:] == b"LYRICS200" and foot[:6].isdigit():
            block = bytes(data[max(0, end - 15 - int(foot[:6])) : end - 15])
            for m in re.finditer(rb"([A-Z]{3})(\d{5})", block[11:]):
                value = block[11 + m.end() : 11 + m.end() + int(m[2])].decode("latin-1") or None
                f.put(G, {b"LYR": "Lyrics", b"ETT": "Title", b"EAR": "Performer", b"EAL": "Album"}.get(m[1], "Lyrics3"), value, extra=m[1] not in (b"LYR", b"ETT", b"EAR", b"EAL"))
            return True
    return False


def xmp(data: bytes, f: Found) -> bool:
    """The first packet of the file: properties as attributes, elements, and the items of lists."""
    head = bytes(data[:SCAN])
    at = head.find(b"<x:xmpmeta")
    end = head.find(b"</x:xmpmeta>", at)
    if at < 0 or end < 0:
        return False
    packet = head[at:end].decode("utf-8", "replace")
    put = lambda name, value: f.put(XMP, "XMP_" + name.replace(":", "_"), unescape(value.strip()) or None)
    for block in re.findall(r"<rdf:Description\b([^>]*)>", packet):
        for name, value in re.findall(r'([A-Za-z][\w.-]*:[\w.-]+)\s*=\s*"([^"]*)"', block):
            if not name.startswith(("xmlns:", "rdf:")):
                put(name, value)
    for name, body in re.findall(r"<((?!rdf:|x:)[A-Za-z][\w.-]*:[\w.-]+)(?:\s[^>]*)?>(.*?)</\1>", packet, re.S):
        items = re.findall(r"<rdf:li\b[^>]*>(.*?)</rdf:li>", body, re.S)
        plain = [re.sub(r"<[^>]*>", "", x).strip() for x in items] if items else [body] if "<" not in body else []
        put(name, " / ".join(filter(None, plain)))
    return True


def iptc(data: bytes, f: Found) -> bool:
    """Records in the Photoshop resource 0x0404; fields that repeat are joined."""
    head = bytes(data[:SCAN])
    at = head.find(b"8BIM\x04\x04")
    if at < 0:
        return False
    at += 6
    name = head[at] + 1 if at < len(head) else 1
    at += name + name % 2
    end, at = at + 4 + u(head, at, 4), at + 4
    found: dict[str, list[str]] = {}
    while at + 5 <= min(end, len(head)) and head[at] == 0x1C:
        record, kind, size = head[at + 1], head[at + 2], u(head, at + 3, 2)
        if size & 0x8000:
            break
        if record == 2 and kind in IPTC_SETS:
            found.setdefault(IPTC_SETS[kind], []).append(head[at + 5 : at + 5 + size].decode("utf-8", "replace").strip())
        at += 5 + size
    for field, values in found.items():
        f.put(IPTC, field, " / ".join(filter(None, values)) or None)
    return bool(found)


def icc(data: bytes, f: Found) -> bool:
    """The header of the first profile, found by its signature."""
    head = bytes(data[:SCAN])
    at = head.find(b"acsp") - 36
    if at < 0 or at + 128 > len(head):
        return False
    word = lambda k: head[at + k : at + k + 4].decode("latin-1").strip("\0 ") or None
    made = struct.unpack(">6H", head[at + 24 : at + 36])
    f.many(ICC, ProfileSize=u(head, at, 4), ProfileCMMType=word(4), ProfileVersion=f"{head[at + 8]}.{head[at + 9] >> 4}.{head[at + 9] & 15}", ProfileClass=ICC_CLASSES.get(head[at + 12 : at + 16].decode("latin-1")), ColorSpaceData=word(16), ProfileConnectionSpace=word(20))
    f.many(ICC, ProfileDateTime="{:04d}:{:02d}:{:02d} {:02d}:{:02d}:{:02d}".format(*made), PrimaryPlatform=word(40), DeviceManufacturer=word(48), DeviceModel=word(52), RenderingIntent=ICC_INTENTS[intent] if (intent := u(head, at + 64, 4)) < 4 else None, ProfileCreator=word(80))
    return True


def c2pa(data: bytes, f: Found) -> bool:
    """Whether the file carries a content manifest: its JUMBF box and claim are there."""
    head = bytes(data[:SCAN])
    at = head.find(b"jumb")
    if at < 0 or b"c2pa" not in head[at : at + (1 << 16)]:
        return False
    f.many(C2PA, Present="Yes", Labels=" / ".join(dict.fromkeys(x.decode("ascii") for x in re.findall(rb"c2pa\.[a-z0-9_.]+", head[at : at + (1 << 18)]))) or None)
    return True


def property_list(data: bytes, f: Found) -> bool:
    """The texts and numbers of an XML property list at the front."""
    head = bytes(data[: 1 << 16])
    if b"<plist" not in head[:1024]:
        return False
    page = head.decode("utf-8", "replace")
    for name, _, value in re.findall(r"<key>([^<]*)</key>\s*<(string|integer|real|date)>([^<]*)</", page):
        f.put(G, unescape(name), unescape(value) or None, extra=True)
    return True


def spherical(data: bytes, f: Found) -> bool:
    """Spherical video, as the RDF packet of a track tells it."""
    head = bytes(data[:SCAN])
    at = head.find(b"<rdf:SphericalVideo")
    if at < 0:
        return False
    page = head[at : head.find(b"</rdf:SphericalVideo>", at)].decode("utf-8", "replace")
    for name, value in re.findall(r"<GSpherical:(\w+)>([^<]*)<", page):
        f.put(1, f"Spherical_{name}", unescape(value) or None, extra=True)
    return True


#: In this order, after the parser that accepted the file; those before the bar only for the formats named.
AUDIO = frozenset(("mp3", "ape", "mpc", "wvpk", "tak", "aac_adts", "flac", "tta", "mpc_sv8", "la", "aac"))
PICTURES = frozenset(("jpeg", "png", "tiff", "webp", "psd", "jp2", "gif", "cr2", "raf", "mp4", "avi", "wav"))


def tags(parser: str, data: bytes, f: Found) -> None:
    if parser in AUDIO:
        for read in (id3v2, ape_tag, lyrics3, id3v1):
            read(data, f)
    if parser in PICTURES:
        for read in (xmp, iptc, icc, c2pa):
            read(data, f)
    if parser == "mp4":
        spherical(data, f)


#: By name, for callers with bytes at hand.
READERS = {
    "id3v1": id3v1, "id3v2": id3v2, "ape_tag": ape_tag, "lyrics3": lyrics3, "xmp": xmp, "iptc": iptc, "icc": icc, "c2pa": c2pa, "property_list": property_list, "spherical": spherical,
}
