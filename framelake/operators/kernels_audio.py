"""Audio formats and trackers that have to be walked or computed (see kernels)."""

from __future__ import annotations

import re

from framelake.operators.kernels import A, ADTS_RATES, G, Bits, Found, three, u


def _pair(f: Found, name: str, **audio) -> None:
    """The usual frame: one audio stream in a file of the same name."""
    f.many(G, Format=name, AudioCount=1)
    f.many(A, Format=name, **audio)


def _words(raw: bytes, strip: str = " ") -> str | None:
    return raw.decode("utf-8", "replace").strip(strip) or None


def ape(data: bytes, f: Found) -> bool:
    if data[:4] not in (b"MAC ", b"MACF") or len(data) < 38:
        return False
    version = u(data, 4, 2, True)
    if version >= 3980:
        if len(data) < 76:
            return False
        level, block, last, frames, bits, channels, rate = (u(data, at, n, True) for at, n in ((52, 2), (56, 4), (60, 4), (64, 4), (68, 2), (70, 2), (72, 4)))
    else:
        level, flags, channels, rate, frames, last = (u(data, at, n, True) for at, n in ((6, 2), (8, 2), (10, 2), (12, 4), (24, 4), (28, 4)))
        bits = 8 if flags & 1 else 24 if flags & 8 else 16
        block = 73728 * 4 if version >= 3950 else 73728 if version >= 3900 or version >= 3800 and level == 4000 else 9216
        if len(data) < 40 + (0 if flags & 32 else 44) + 4 * u(data, 36, 4, True):
            return False
    samples = (frames - 1) * block + last
    if not (frames and rate and channels and bits and samples):
        return False
    # Compression levels.
    settings = {1000: "Fast", 2000: "Normal", 3000: "High", 4000: "Extra-high", 5000: "Insane"}.get(level)
    number = three(version / 1000)
    f.many(G, Format="Monkey's Audio", Format_Version=number, AudioCount=1, StreamSize=0)
    f.many(A, Format="Monkey's Audio", Format_Version=number, Format_Profile="Float" if data[3:4] == b"F" else None, Encoded_Library_Settings=settings, Codec="APE", Compression_Mode="Lossless", BitRate_Mode="VBR")
    f.many(A, BitDepth=bits, Channels=channels, SamplingRate=rate, SamplingCount=samples, Duration=samples * 1000 // rate)
    return True


def als(data: bytes, f: Found) -> bool:
    rate, samples = u(data, 4, 4), u(data, 8, 4)
    if data[:4] != b"ALS\0" or len(data) < 16 or not rate or not samples * 1000 // rate:
        return False
    _pair(f, "ALS", Codec="ALS", BitDepth=((data[14] >> 2 & 7) + 1) * 8, Channels=u(data, 12, 2) + 1, SamplingRate=rate, SamplingCount=samples, Duration=samples * 1000 // rate, Compression_Mode="Lossless", BitRate_Mode="VBR")
    return True


def amr(data: bytes, f: Found) -> bool:
    head = re.match(rb"#!AMR(-WB)?(\n|_MC1\.0\n)", bytes(data[:16]))
    if not head:
        return False
    wide, size = bool(head[1]), head.end()
    _pair(f, "AMR", Codec="AMR", Format_Profile="Wide band" if wide else "Narrow band", SamplingRate=16000 if wide else 8000, BitDepth=14 if wide else 13, Channels=1 if head[2] == b"\n" else 2)
    f.many(A, Compression_Mode="Lossy", BitRate_Mode="VBR", StreamSize=len(data) - size)
    f.put(G, "StreamSize", size)
    return True


def speex(data: bytes, f: Found) -> bool:
    if data[:8] != b"Speex   " or len(data) < 80:
        return False
    library = bytes(data[8:28]).split(b"\0")[0].decode("utf-8", "replace") or None
    known = u(data, 28, 4, True) == 1
    rate, channels, bps, vbr = (u(data, at, 4, True) for at in (36, 48, 52, 60))
    _pair(f, "Speex", Codec="Speex", Encoded_Library=library)
    if known:
        f.many(A, SamplingRate=rate, Channels=channels, BitRate=bps if bps != 0xFFFFFFFF else None)
    f.many(A, BitRate_Mode="CBR" if known and not vbr else "VBR", Compression_Mode="Lossy")
    return True


# Sampling rates and profiles by index.
MPC_RATES = (44100, 48000, 37800, 32000)
MPC_PROFILES = {
    0: "no profile", 1: "Unstable/Experimental", 5: "Below Telephone (q=0)", 6: "Below Telephone (q=1)", 7: "Telephone (q=2)", 8: "Thumb (q=3)", 9: "Radio (q=4)", 10: "Standard (q=5)",
    11: "Xtreme (q=6)", 12: "Insane (q=7)", 13: "BrainDead (q=8)", 14: "Above BrainDead (q=9)", 15: "Above BrainDead (q=10)",
}


def mpc(data: bytes, f: Found) -> bool:
    frames = u(data, 4, 4, True)
    if data[:3] != b"MP+" or len(data) < 25 or data[3] & 15 != 7 or not frames:
        return False
    rate, encoder = MPC_RATES[data[10] & 3], data[24]
    samples = frames * 1152
    kind = "" if encoder % 10 == 0 else " Beta" if encoder % 2 == 0 else " Alpha"
    f.many(G, Format="Musepack", Format_Version="Version 7", AudioCount=1)
    f.many(A, Format="Musepack", Format_Version="Version 7", Codec="SV7", Codec_Settings=MPC_PROFILES.get(data[10] >> 4), Encoded_Library=f"{encoder / 100:.2f}{kind}" if encoder else None, BitRate_Mode="VBR")
    f.many(A, BitRate=(len(data) - 25) * 8 * rate // frames // 1152, Channels=2, SamplingRate=rate, SamplingCount=samples, BitDepth=16, Duration=samples * 1000 // rate, Compression_Mode="Lossy")
    return True


def la(data: bytes, f: Found) -> bool:
    if data[:2] != b"LA" or len(data) < 45:
        return False
    channels, rate, bits, samples = (u(data, at, n, True) for at, n in ((26, 2), (28, 4), (38, 2), (40, 4)))
    ms = samples // channels * 1000 // rate if channels and rate else 0
    if not ms or bits < 8:
        return False
    version = f"{data[2]}.{data[3]}"
    f.put(G, "Format", "LA")
    f.many(G, Format_Version=version, AudioCount=1)
    f.many(A, Format="LA", Format_Version=version, Codec="LA", Compression_Mode="Lossless", BitRate_Mode="VBR", BitDepth=bits, Channels=channels, SamplingRate=rate, Duration=ms)
    return True


def tak(data: bytes, f: Found) -> bool:
    if data[:4] != b"tBaK":
        return False
    at, info = 4, None
    while at + 4 <= len(data):
        kind, size, body = data[at], u(data, at + 1, 3, True), at + 4
        if not kind or body + size > len(data):
            at = body
            break
        if kind == 1 and size >= 13:
            info = data[body : body + 13]
        at = body + size
    if info is None or not u(info, 6, 3, True):
        return False
    rate, samples = u(info, 6, 3, True) // 16 + 6000, u(info, 2, 4, True) << 2 | info[1] >> 6
    bits = (8, 16, 24, None)[info[9] >> 1 & 3]
    f.many(G, Format="TAK", StreamSize=0, AudioCount=1)
    f.many(A, Format="TAK", Codec="TAK", Compression_Mode="Lossless", BitRate_Mode="VBR", Channels=2 if info[9] & 8 else 1, SamplingRate=rate, BitDepth=bits)
    if samples:
        f.many(A, Duration=samples * 1000 // rate, SamplingCount=samples)
    f.put(A, "StreamSize", len(data) - at)
    return True


WAVPACK_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000, 0)


def wvpk(data: bytes, f: Found) -> bool:
    version, samples, block, flags = u(data, 8, 2, True), u(data, 12, 4, True), u(data, 20, 4, True), u(data, 24, 4, True)
    if data[:4] != b"wvpk" or len(data) < 32 or version >> 8 != 4 or not block:
        return False
    rate, dsd = WAVPACK_RATES[flags >> 23 & 15], bool(flags >> 31)
    if not rate and not dsd:
        return False
    mode = "Lossy" if flags & 8 else "Lossless"
    _pair(f, "WavPack", Format_Profile=f"{version >> 8}.{version & 255:02d}", Codec="Wavpack", BitRate_Mode="VBR", Compression_Mode=mode, Codec_Settings=mode, Channels=1 if flags & 4 else 2, SamplingRate=rate * (8 if dsd else 1))
    f.many(A, **({"Format_Settings_Mode": "DSD", "Format_Settings": "DSD"} if dsd else {"BitDepth": 8 * (flags & 3) + 8}))
    if not u(data, 16, 4, True) and rate and samples not in (0, 0xFFFFFFFF):
        f.put(A, "Duration", samples * 1000 // rate)
    return True


def twin_vq(data: bytes, f: Found) -> bool:
    if data[:4] != b"TWIN":
        return False
    at, comm = 16, None
    while at + 8 <= len(data) and data[at : at + 4] != b"DATA":
        size = u(data, at + 4, 4)
        if data[at : at + 4] == b"COMM" and size >= 16 and at + 24 <= len(data):
            comm = at + 8
        at += 8 + size
    rate = {11: 11025, 22: 22050, 44: 44100}.get(u(data, comm + 8, 4)) if comm else None
    if not rate:
        return False
    _pair(f, "TwinVQ", Codec="TwinVQ", Channels=u(data, comm, 4) + 1, BitRate=u(data, comm + 4, 4) * 1000, SamplingRate=rate, Compression_Mode="Lossy", StreamSize=len(data))
    return True


def extended_module(data: bytes, f: Found) -> bool:
    if data[:17] != b"Extended Module: " or data[37:38] != b"\x1a" or len(data) < 336:
        return False
    channels, patterns, instruments, _, tempo, bpm = (u(data, at, 2, True) for at in range(68, 80, 2))
    f.many(G, Format="Extended Module", Format_Version=f"{data[59]}.{data[58] // 10}{data[58] % 10}", Track=_words(data[17:37]), Encoded_Application=_words(data[38:58]), Tempo=tempo, BPM=bpm, AudioCount=1)
    f.put(A, "Format", "Module")
    for name, value in (("Channels", channels), ("Patterns", patterns), ("Instruments", instruments)):
        f.put(A, f"Sampler, {name}", value)
    return True


def rkau(data: bytes, f: Found) -> bool:
    if data[:3] != b"RKA" or len(data) < 15:
        return False
    size, rate, channels, bits = u(data, 4, 4, True), u(data, 8, 4, True), data[12], data[13]
    ms = size * 1000 // 4 // rate if rate else 0
    if not (ms and channels and bits >= 8):
        return False
    version = f"1.0{chr(data[3])}"
    f.many(G, Format="RKAU", Format_Version=version, AudioCount=1)
    f.many(A, Format="RKAU", Format_Version=version, Compression_Mode="Lossy" if data[14] else "Lossless", BitRate_Mode="VBR", Channels=channels, SamplingRate=rate, BitDepth=bits, Duration=ms)
    return True


# Codecs, sampling rates and channels by code.
OPENMG_CODECS = {0: "ATRAC3", 1: "ATRAC3", 3: "MPEG Audio", 4: "PCM", 5: "WMA"}
OPENMG_RATES = {0: 32000, 1: 44100, 2: 44800, 3: 88200, 4: 96000}
OPENMG_CHANNELS = {
    0: (0, None, None), 1: (1, "Front: C", "C"), 2: (2, "Front: L R", "L R"), 3: (3, "Front: L R, Side: C", "L R S"), 4: (4, "Front: L R, Back: L R", "L R BL BR"), 5: (6, "Front: L C R, Side: L R, LFE", "L R C SL SR LFE"),
    6: (7, "Front: L C R, Side: L R, Back: C, LFE", "L R C SL SR BC LFE"), 7: (8, "Front: L C R, Side: L R, Back: L R, LFE", "L R C SL SR BL BR LFE"),
}


def open_mg(data: bytes, f: Found) -> bool:
    if data[:3] not in (b"EA3", b"ea3") or len(data) < 33:
        return False
    size, codec, b = u(data, 4, 2), data[32], Bits(data[33:36])
    own = codec <= 1
    joint, rate_code, channel_code, frame = (b.take(8) & 1, b.take(3), b.take(3), b.take(10)) if own else (0, 0, 0, 0)
    stream = max(0, len(data) - max(size, 36 if own else 33))
    f.put(G, "Format", "OpenMG")
    f.many(A, Format=OPENMG_CODECS.get(codec), Encryption="SDMI" if codec == 1 else None, StreamSize=stream)
    if own:
        channels, positions, layout = OPENMG_CHANNELS[channel_code]
        rate = OPENMG_RATES.get(rate_code, 0)
        bps = rate * ((frame + codec) << 3) // 256
        f.many(A, Channels=channels, ChannelPositions=positions, ChannelLayout=layout, Format_Settings_Mode="Joint Stereo" if channel_code == 1 and joint else None, SamplingRate=rate or None, BitRate=bps if rate and frame + codec else None, Duration=stream * 8000 // bps if bps else None)
    return True


def module(data: bytes, f: Found) -> bool:
    if len(data) < 1084 or data[1080:1084] not in (b"M.K.", b"M!K!", b"FLT4", b"FLT8", b"6CHN", b"8CHN"):
        return False
    f.many(G, Format="Module", Track=_words(data[:20].rstrip(b"\0 ")), AudioCount=1)
    f.put(A, "Format", "Module")
    return True


def impulse_tracker(data: bytes, f: Found) -> bool:
    if data[:4] != b"IMPM" or len(data) < 192:
        return False
    sixteenths = lambda major, minor: f"{major}.{minor // 16}{minor % 16}"
    f.many(G, Format="Impulse Tracker", Format_Version=f"Version {sixteenths(data[43], data[42])}", Track=_words(data[4:30].split(b"\0")[0]), Encoded_Application=f"Impulse Tracker {sixteenths(data[41], data[40])}", BPM=data[51], AudioCount=1)
    f.many(A, Format="Module", Channels=2 if data[44] & 1 else 1)
    return True


def scream_tracker3(data: bytes, f: Found) -> bool:
    if len(data) < 96 or data[28] != 0x1A or data[44:48] != b"SCRM":
        return False
    major, minor = data[40], data[41]
    f.many(G, Format="Scream Tracker 3", Track=_words(data[:28].split(b"\0")[0]), Encoded_Application=f"Scream Tracker {major}.{minor // 16}{minor % 16}" if major >> 4 == 1 else None, BPM=data[50], AudioCount=1)
    f.put(A, "Format", "Module")
    return True


TRUEHD_RATES = {0: 48000, 1: 96000, 2: 192000, 3: 44100, 4: 88200, 5: 176400}


def truehd(data: bytes, f: Found) -> bool:
    if data[:4] not in (b"\xf8\x72\x6f\xba", b"\xf8\x72\x6f\xbb"):
        return False
    core, head, channels = data[3] == 0xBB, bytes(data[:8192]), 2
    f.many(A, Format="TrueHD", Format_Profile="MLP FBA")
    if len(head) >= 5:
        channels = (head[4] & 15) + 1 if head[4] & 15 <= 7 else 2
        f.many(A, SamplingRate=TRUEHD_RATES.get(head[4] >> 4, 48000), Channels=channels)
    if len(head) >= 6:
        f.put(A, "BitDepth", {1: 16, 2: 20}.get(head[5] >> 4, 24))
    atmos = len(head) >= 8 and (head[6] >> 4 >= 2 or any(head[k : k + 2] == b"\0\3" for k in range(8, len(head) - 1, 8)))
    f.many(A, Format_Commercial="Dolby TrueHD + AC-3" if core else "Dolby TrueHD with Atmos" if atmos else None, Format_AdditionalFeatures="Atmos" if atmos else None, HDR_Format="Dolby Atmos" if atmos and channels >= 6 else None)
    if atmos:
        f.put(A, "Format_Commercial", "Dolby TrueHD with Atmos", force=True)
    f.many(A, BitRate_Mode="VBR", Compression_Mode="Lossless")
    return True


def dsdiff(data: bytes, f: Found) -> bool:
    if data[:4] != b"FRM8" or data[12:16] != b"DSD ":
        return False
    found: dict[str, int | str] = {"Format": "DSD"}

    def walk(at: int, end: int, inside: bool) -> None:
        while at + 12 <= end:
            name, size = data[at : at + 4], min(u(data, at + 4, 8), end - at - 12)
            body = at + 12
            if not inside and name == b"PROP" and data[body : body + 4] == b"SND ":
                walk(body + 4, body + size, True)
            elif not inside and name in (b"DSD ", b"DST "):
                found["StreamSize"] = size
            elif inside and name == b"FS  " and size >= 4:
                found["SamplingRate"] = u(data, body, 4)
            elif inside and name == b"CHNL" and size >= 2:
                found["Channels"] = u(data, body, 2)
            elif inside and name == b"CMPR" and size >= 5:
                found["Format"] = "DST" if data[body : body + 4] == b"DST " else "DSD"
            at = body + size + size % 2

    walk(16, len(data), False)
    f.put(G, "Format", "DSDIFF")
    f.many(A, Format=found["Format"], SamplingRate=found.get("SamplingRate") or None, Channels=found.get("Channels") or None, BitDepth=1, Compression_Mode="Lossless", BitRate_Mode="CBR", StreamSize=found.get("StreamSize") or None)
    f.put(G, "AudioCount", 1)
    return True


def iab(data: bytes, f: Found) -> bool:
    at = 5 + u(data, 1, 4)
    if data[:1] != b"\x01" or len(data) < at + 6 or data[at] != 2 or not u(data, at + 1, 4):
        return False
    f.many(G, Format="IAB", AudioCount=1)
    f.put(A, "Format", "IAB")
    if data[at + 5] == 1 and at + 6 < len(data):
        code = data[at + 6]
        # Frame rates by code.
        rate = {0: "24", 1: "25", 2: "30", 3: "48", 4: "50", 5: "60", 6: "96", 7: "100", 8: "120", 9: "23.976"}.get(code & 15)
        f.many(A, SamplingRate={0: 48000, 1: 96000}.get(code >> 6), BitDepth={0: 16, 1: 24}.get(code >> 4 & 3), FrameRate=rate)
    return True


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the lowest first, and where it ends; raises IndexError where it is cut off."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 56:
            raise ValueError("number too long")


# Codecs of IAMF.
IAMF_CODECS = {b"Opus": "Opus", b"mp4a": "AAC", b"fLaC": "FLAC", b"ipcm": "PCM"}


def _iamf_units(data: bytes):
    """(type, begin of the payload, begin of the next unit)."""
    at = 0
    while at < len(data):
        head = data[at]
        size, body = leb128(data, at + 1)
        start = body
        if head & 2:
            for _ in range(2):
                _, body = leb128(data, body)
        if head & 1:
            extra, body = leb128(data, body)
            body += extra
        yield head >> 3, body, body + size
        if not size:
            return
        at = body + size if not head & 3 else max(body, start) + size


def _iamf_element(data: bytes, at: int) -> dict:
    name, at = leb128(data, at)
    kind = data[at] >> 5
    _, at = leb128(data, at + 1)
    streams, at = leb128(data, at)
    for _ in range(min(streams, 256)):
        _, at = leb128(data, at)
    parameters, at = leb128(data, at)
    for _ in range(min(parameters, 256)):
        _, at = leb128(data, at)
    channels, layout = 0, None
    if kind == 0:
        layers, at = leb128(data, at)
        for _ in range(min(layers, 16)):
            groups, at = leb128(data, at)
            for _ in range(min(groups, 64)):
                _, at = leb128(data, at)
                n, at = leb128(data, at)
                channels, at = channels + n, at + n
        layout = "Mono" if channels <= 1 else "Stereo" if channels <= 2 else f"{channels - 1}.1" if channels <= 6 else f"{channels - 2}.1.{channels // 10}"
    elif kind == 1:
        order = leb128(data, at + 1)[0] if not data[at] >> 7 else 1
        channels, layout = (order + 1) ** 2, f"Ambisonics (Order {order})"
    return {"id": name, "kind": kind, "streams": streams, "channels": channels, "layout": layout}


def iamf(data: bytes, f: Found) -> bool:
    data = bytes(data[: 1 << 20])
    profile, codec, elements = None, None, []
    try:
        for n, (kind, at, _) in enumerate(_iamf_units(data)):
            if n == 0 and (kind != 31 or data[at : at + 4] != b"iamf"):
                return False
            if kind == 31:
                profile, codec, elements = data[at + 4], None, []
            elif kind == 0 and codec is None:
                _, at = leb128(data, at)
                codec = IAMF_CODECS.get(data[at : at + 4], "Unknown"), leb128(data, at + 4)[0]
            elif kind == 1:
                elements.append(_iamf_element(data, at))
    except (IndexError, ValueError):
        pass  # cut off: what was read before stands
    if profile is None:
        return False
    name = {0: "Simple", 1: "Base"}.get(profile, "Unknown")
    f.many(G, Format="IAMF", Format_Commercial_IfAny="Eclipsa Audio", AudioCount=len(elements), Format_Profile=name, CodecID="iamf", InternetMediaType="audio/iamf")
    f.many(A, Format="IAMF", Format_Profile=name, Compression_Mode="Lossy")
    if codec:
        f.many(A, CodecID=codec[0], CodecID_Description=f"IAMF codec: {codec[0]}", SamplesPerFrame=codec[1] or None)
    for pos, e in enumerate(elements):
        if pos == 0:
            f.many(A, Format_Settings={0: "Channel-Based", 1: "Scene-Based (Ambisonics)"}.get(e["kind"], "Unknown"), Channels=e["channels"] or None, ChannelLayout=e["layout"], StreamCount=e["streams"])
        else:
            f.many(A, pos, Format="IAMF", ID=e["id"], Channels=e["channels"] or None)
    return True


def ac4(data: bytes, f: Found) -> bool:
    if data[:2] not in (b"\xac\x40", b"\xac\x41") or len(data) < 6:
        return False
    b = Bits(data[2:4096])
    variable = b.take(1)
    b.take(7)
    size = b.take(16)
    rate = channels = objects = 0
    immersive = joint = False
    loudness = None
    for _ in range(b.take(4)):
        b.take(7)
        rate = {0: 44100, 1: 48000, 2: 96000}.get(b.take(4)) or rate
        mode = b.take(4)
        channels = max(channels, mode + 1 if mode < 8 else 0)
        immersive, joint = bool(b.take(1)), bool(b.take(1))
        if joint:
            objects = b.take(5)
        if b.take(4) == 3:
            loudness = b.take(5)
    name = "Dolby AC-4 Immersive" if immersive or joint else "Dolby AC-4"
    f.many(G, Format="AC-4", Format_Commercial_IfAny=name, AudioCount=1)
    f.many(A, Format="AC-4", Format_Commercial_IfAny=name, BitRate_Mode="VBR" if variable else "CBR", Compression_Mode="Lossy", SamplingRate=rate or None, Channels=channels or None, Format_Settings_CRC="Yes" if data[1] == 0x41 else None)
    # The first write of a field stands, so immersive stereo is told before joint coding.
    f.many(A, Format_Settings="IMS" if immersive else "JOC" if joint else None, Format_AdditionalFeatures="Immersive Stereo" if immersive else f"Joint Object Coding ({objects} objects)" if joint else None)
    f.many(A, FrameCount=len(data) // size or None if size else None, StreamSize=len(data))
    if loudness is not None:
        f.many(A, dialnorm=-(loudness or 31), dialnorm_Average=-(loudness or 31))
    return True


def dat(data: bytes, f: Found) -> bool:
    if len(data) < 5822:
        return False
    a, b = data[5820], data[5821]
    samples, channels, bits = (1440, 1323, 960, 0)[a >> 2 & 3], (2, 4, 0, 0)[a & 3], (16, 12, 0, 0)[b >> 6]
    if a >> 6 or not (samples and channels and bits):
        return False
    f.many(G, Format="DAT", AudioCount=1)
    f.many(A, Format="PCM", BitRate=1411200, BitRate_Mode="CBR", SamplingRate=samples * 100 // 3, Channels=channels, BitDepth=bits, Compression_Mode="Lossless", Format_Settings_Emphasis={0: "off", 1: "50/15 ms"}.get(a >> 4 & 3), StreamSize=len(data) // 5822 * 5760 * 441 // 480)
    return True


# Languages of film sound discs.
APTX_LANGUAGES = {
    "ARB": "ar", "CAN": "yue", "CRO": "hr", "CZC": "cs", "ENGL": "en", "FLM": "nl-BE", "FRN": "fr", "FRNC": "fr-CA", "GERS": "de-CH", "GRK": "el", "ITL": "it", "JAP": "ja", "PORB": "pt-BR",
}
# By number of channels, those played, their layout, settings and the commercial name.
APTX_LAYOUTS = {2: (4, "L C R S", "4:2:4 Matrix", "DTS Stereo"), 5: (6, "L LS C RS R SW", None, "DTS 35 mm"), 6: (6, "L LC C RC R S", None, "DTS 70 mm Special Venue"), 8: (8, "L LS C RS R SW LC RC", None, "DTS 70 mm Special Venue")}


def aptx100(data: bytes, f: Found) -> bool:
    if len(data) < 92 or any(x >= 0x7F or 0 < x < 0x20 for x in data[:75]):
        return False
    word = lambda a, b: bytes(data[a:b]).split(b"\0")[0].decode("ascii")
    title, language, studio = word(0, 60), word(60, 68), word(68, 75)
    disc, (zero, reel, serial, channels) = data[75], (u(data, at, 2, True) for at in (76, 78, 80, 82))

    def time(at: int) -> list[int] | None:
        """Hours, minutes, seconds and hundredths, in binary-coded decimals; minutes and seconds may carry a flag."""
        raw = [data[at + 3], *(x - 0x60 if x > 0x60 else x for x in (data[at + 2], data[at + 1])), data[at]]
        parts = [(x >> 4) * 10 + (x & 15) if x >> 4 < 10 and x & 15 < 10 else 999 for x in raw]
        return parts if all(x <= most for x, most in zip(parts, (23, 59, 59, 99))) else None

    begin, end = time(84), time(88)
    ms = lambda t: ((t[0] * 60 + t[1]) * 60 + t[2]) * 1000 + t[3] * 10
    if not begin or not end or ms(begin) >= ms(end) or disc not in (0, 1, 0x81) or channels not in (2, 3, 4, 5, 6, 8) or zero:
        return False
    last = (ms(end) - 10) // 10
    clock = lambda n: f"{n // 360000:02d}:{n // 6000 % 60:02d}:{n // 100 % 60:02d}:{n % 100:02d}"
    played, layout, settings, name = APTX_LAYOUTS.get(channels, (channels, None, None, "DTS Special Venue"))
    if channels == 5 and serial >= 60000:
        played, layout, settings, name = 7, f"{layout} BS", "ES Matrix", "DTS-ES 35 mm"
    elif channels == 5 and (serial == 1357 and language == "*ENG" or serial in (11131, 12030) or 12074 < serial < 21000):
        name = "DTS 70 mm"
    f.many(G, Format="aptX-100", Movie=title or None, Title=title or None, ProductionStudio=studio if studio not in ("", "none") else None, Part_Position=(disc >> 7) + 1 if disc else None, Reel_Position=reel or None, CatalogNumber=serial or None, AudioCount=1, Format_Commercial_IfAny=name)
    f.many(A, Format="aptX-100", BitRate=44100 * 4 * channels, Format_Commercial_IfAny=name, Format_Settings=settings)
    f.put(A, "Channel(s)", played)
    f.many(A, ChannelLayout=layout, BitRate_Mode="CBR", SamplingRate=44100, Duration=ms(end) - ms(begin), TimeCode_FirstFrame=clock(ms(begin) // 10), TimeCode_LastFrame=clock(last))
    f.many(A, Language=(APTX_LANGUAGES.get(language[1:], language) if language.startswith("*") else language) or None, StreamSize=len(data) - 92 or None)
    return True


def usac(data: bytes, f: Found) -> bool:
    if len(data) < 5 or data[0] != 0xFF or data[1] >> 4 != 15 or data[1] >> 1 & 3:
        return False
    index = data[2] >> 2 & 15
    f.many(A, Format="USAC", Codec="xHE-AAC", Channels=(data[2] & 1) << 2 | data[3] >> 6, SamplingRate=ADTS_RATES[index] if index < 12 else 48000, Format_Profile=("LC", "HE-AAC", "HE-AACv2", "xHE-AAC")[data[2] >> 6])
    return True


def pcm(data: bytes, f: Found) -> bool:
    if len(data) < 16 or u(data, 0, 2, True) not in (1, 0xFFFE):
        return False
    f.many(A, Format="PCM", Channels=u(data, 2, 2, True), SamplingRate=u(data, 4, 4, True), BitDepth=u(data, 14, 2, True), Format_Settings_Endianness="Little", Format_Settings_Sign="Signed")
    return True


def aac(data: bytes, f: Found) -> bool:
    if len(data) < 4 or data[0] != 0xFF or data[1] >> 4 != 15:
        return False
    f.many(A, Format="AAC", Format_Profile=("LC", "HE-AAC", "HE-AACv2", None)[data[2] >> 6])
    return True


def adm(data: bytes, f: Found) -> bool:
    head = bytes(data[: 1 << 16])
    if b"ADM " not in head and b"axml" not in head:
        return False
    f.many(A, Format="ADM", Format_Info="SMPTE ST 2076 Audio Definition Model")
    return True


def pcm_vob(data: bytes, f: Found) -> bool:
    head = bytes(data[:64])
    if b"DVD " not in head and b"LPCM" not in head:
        return False
    f.many(A, Format="PCM", Format_Info="VOB LPCM", Format_Settings_Endianness="Big")
    return True


def celt(data: bytes, f: Found) -> bool:
    if data[:4] != b"CELT" or len(data) < 8:
        return False
    f.many(A, Format="CELT", Format_Info="Ultra-low-delay codec", Format_Version=data[4], Channels=data[5], Format_Settings_Mode=data[7])
    return True


KERNELS = {
    "ape": ape, "als": als, "amr": amr, "speex": speex, "mpc": mpc, "la": la, "tak": tak, "wvpk": wvpk, "twin_vq": twin_vq, "extended_module": extended_module, "rkau": rkau, "open_mg": open_mg, "module": module,
    "impulse_tracker": impulse_tracker, "scream_tracker3": scream_tracker3, "truehd": truehd, "dsdiff": dsdiff, "iab": iab, "iamf": iamf, "ac4": ac4, "dat": dat, "aptx100": aptx100, "usac": usac, "pcm": pcm, "aac": aac,
    "adm": adm, "pcm_vob": pcm_vob, "celt": celt,
}
