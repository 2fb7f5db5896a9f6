"""Documents of a file's metadata: JSON, XML, CSV, text, a summary and seven XML or graph dialects.

A file's fields are gathered in one row, as they are few, and each document is put together in an Arrow batch, those of plain
WAV files in Catalyst; to write many files, write the result with any of Spark's sinks.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.display import ASPECTS, LANGUAGES
from framelake.model import KERNEL_FIELD, KINDS
from framelake.operators.layouts import pcm_fields, pcm_rows
from framelake.sinks.orders import CANONICAL, EXTRA, SHOWN


class Media:
    """One file: its streams by kind, each with fields and extras in order of writing."""

    def __init__(self, path: str, rows: list[dict]):
        self.path = path
        self.kinds: dict[str, list[tuple[dict[str, str], dict[str, str]]]] = {}
        for r in sorted(rows, key=lambda r: (r["kind_id"], r["pos"], r.get("ord", 0))):
            streams = self.kinds.setdefault(KINDS[r["kind_id"]], [])
            while len(streams) <= r["pos"]:
                streams.append(({}, {}))
            streams[r["pos"]][bool(r["is_extra"])].setdefault(r["name"], r["value"])

    def streams(self, *kinds: str) -> Iterator[tuple[str, int, dict[str, str], dict[str, str]]]:
        for kind in kinds or KINDS:
            for pos, (fields, extras) in enumerate(self.kinds.get(kind, [])):
                yield kind, pos, fields, extras


def _escaped(raw: str, *more: tuple[str, str]) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), *more):
        raw = raw.replace(a, b)
    return raw


def _text(raw: str) -> str:
    return _escaped(raw, (">", "&gt;"))


def _seconds(name: str, raw: str) -> str:
    """Whole milliseconds of duration fields as seconds with three places."""
    timed = name in ("Duration", "Source_Duration_LastFrame") or name.endswith(("_Duration", "/Duration"))
    if timed and raw.lstrip("+-").isascii() and raw.lstrip("+-").isdecimal():
        ms = int(raw)
        return f"{'-' if ms < 0 else ''}{abs(ms) // 1000}.{abs(ms) % 1000:03d}"
    return raw


def _ordered(kind: str, fields: dict[str, str], extras: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Fields and extras as written: known ones in their order, then the others as they came."""
    known, moved = CANONICAL.get(kind, ()), EXTRA.get(kind, ())
    main = [n for n in known if n in fields] + [n for n in fields if n not in known and n not in moved]
    aside = [(n, fields[n]) for n in moved if n in fields] + list(extras.items())
    return [(n, _seconds(n, fields[n])) for n in main], [(n, _seconds(n, v)) for n, v in aside]


def to_json(m: Media) -> str:
    quoted = lambda s: json.dumps(s, ensure_ascii=False).replace("\\b", "\\u0008").replace("\\f", "\\u000c")
    tracks = []
    for kind, _, fields, extras in m.streams():
        main, aside = _ordered(kind, fields, extras)
        parts = [f"{quoted(n)}:{quoted(v)}" for n, v in main]
        if aside:
            parts.append('"extra":{' + ",".join(f"{quoted(n)}:{quoted(v)}" for n, v in aside) + "}")
        tracks.append(f'{{"@type":{quoted(kind)}' + ("," + ",\n".join(parts) if parts else "") + "}")
    return '{\n"media":{"@ref":' + quoted(m.path) + ',"track":[' + ",".join(tracks) + "]}\n}\n"


def to_xml(m: Media) -> str:
    line = lambda n, v: f"<{n}>{_text(v)}</{n}>\n"
    space = "https://mediaarea.net/mediainfo"
    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<MediaInfo\n    xmlns="{space}"\n    xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"\n    xsi:schemaLocation="{space} {space}/mediainfo_2_0.xsd"\n    version="2.0">\n']
    out.append(f'<media ref="{_escaped(m.path, (chr(34), "&quot;"), (chr(39), "&apos;"))}">\n')
    for kind, pos, fields, extras in m.streams():
        main, aside = _ordered(kind, fields, extras)
        place = f' typeorder="{pos + 1}"' if len(m.kinds[kind]) > 1 else ""
        out += [f'<track type="{kind}"{place}>\n', *[line(*x) for x in main]]
        if aside:
            out += ["<extra>\n", *[line(*x) for x in aside], "</extra>\n"]
        out.append("</track>\n")
    return "".join([*out, "</media>\n</MediaInfo>\n\n"])


def to_csv(m: Media) -> str:
    cell = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
    out = [f"# {m.path}\n"]
    for kind, streams in ((k, m.kinds[k]) for k in KINDS if k in m.kinds):
        names = list(dict.fromkeys(n for fields, extras in streams for n in (*fields, *extras)))
        if names:
            rows = [["StreamIndex", *names], *[[str(k), *[f.get(n, e.get(n, "")) for n in names]] for k, (f, e) in enumerate(streams)]]
            out += [f"# {kind}\n", *[",".join(map(cell, r)) + "\n" for r in rows], "\n"]
    return "".join(out)


# ---- the text report

# Labels that differ from the field's name with spaces for underscores.
LABELS = {
    "CompleteName": "Complete name", "Format_Version": "Format version", "Format_Info": "Format/Info", "Format_Profile": "Format profile", "CodecID": "Codec ID", "FileSize": "File size", "OverallBitRate": "Overall bit rate",
    "BitRate_Mode": "Bit rate mode", "BitRate_Maximum": "Maximum bit rate", "BitRate": "Bit rate", "FrameRate_Mode": "Frame rate mode", "FrameRate": "Frame rate", "DisplayAspectRatio": "Display aspect ratio", "ColorSpace": "Color space",
    "ChromaSubsampling": "Chroma subsampling", "BitDepth": "Bit depth", "ScanType": "Scan type", "Bits_Pixel_Frame": "Bits/(Pixel*Frame)", "StreamSize": "Stream size", "Channels": "Channel(s)", "ChannelLayout": "Channel layout",
    "SamplingRate": "Sampling rate", "Compression_Mode": "Compression mode", "Encoded_Application": "Writing application", "Encoded_Library": "Writing library", "Encoded_Date": "Encoded date", "Tagged_Date": "Tagged date",
    "Format_Settings_CABAC": "Format settings, CABAC", "Format_Settings_RefFrames": "Format settings, Reference frames", "Format_Settings_GOP": "Format settings, GOP", "Format_Settings_Mode": "Mode",
}
_LANGUAGE = LANGUAGES


def _figures(v: float) -> str:
    return f"{v:.0f}" if v >= 100 else f"{v:.1f}" if v >= 10 else f"{v:.2f}"


def text_size(size: int) -> str:
    for unit, power in (("GiB", 3), ("MiB", 2), ("KiB", 1)):
        if size >= 1024**power:
            return f"{_figures(size / 1024**power)} {unit}"
    return f"{size} Bytes"


def text_duration(raw: str) -> str:
    try:
        ms = int(raw)
    except ValueError:
        try:
            ms = int(abs(float(raw)) * 1000 + 0.5)
        except (ValueError, OverflowError):
            return raw
    s = ms // 1000
    return f"{s // 3600} h {s % 3600 // 60} min" if s >= 3600 else f"{s // 60} min {s % 60} s" if s >= 60 else f"{s} s" if s else f"{ms} ms"


def _rate(bps: int) -> str:
    return f"{_figures(bps / 1e6)} Mb/s" if bps >= 1e6 else f"{_figures(bps / 1e3)} kb/s"


def _grouped(raw: str) -> str:
    return " ".join(raw[::-1][k : k + 3] for k in range(0, len(raw), 3))[::-1]


def _shown(name: str, raw: str, whole: int | None) -> str:
    number = int(raw) if raw.isascii() and raw.isdecimal() else None
    if name in ("Duration", "Source_Duration"):
        return text_duration(raw)
    if name in ("Language",):
        return _LANGUAGE.get(raw, raw)
    if name == "DisplayAspectRatio":
        return ASPECTS.get(raw, raw)
    if name in ("BitRate_Mode", "FrameRate_Mode"):
        return {"CFR": "Constant", "CBR": "Constant", "VFR": "Variable", "VBR": "Variable"}.get(raw, raw)
    if name == "FrameRate":
        return f"{raw} FPS"
    if number is None:
        return raw
    if name in ("FileSize", "StreamSize", "Source_StreamSize"):
        share = f" ({int(number * 100 / whole + 0.5)}%)" if whole and name != "FileSize" else ""
        return text_size(number) + share
    if name in ("BitRate", "OverallBitRate", "BitRate_Maximum"):
        return _rate(number)
    if name in ("Width", "Height"):
        return f"{_grouped(raw)} pixels"
    if name == "BitDepth":
        return f"{raw} bits"
    if name == "Channels":
        return f"{raw} channel{'' if number == 1 else 's'}"
    if name == "SamplingRate":
        khz = f"{number / 1000:.3f}".rstrip("0").rstrip(".") if number % 1000 else f"{number / 1000:.1f}"
        return f"{khz} kHz"
    return raw


def to_text(m: Media, shown: Callable[[str, str, int | None], str] = _shown) -> str:
    general = m.kinds.get("General", [({}, {})])[0][0]
    size = general.get("FileSize", "")
    whole = int(size) if size.isdecimal() else None
    sections = []
    for kind, pos, fields, _ in m.streams():
        fields = {"CompleteName": m.path, **fields} if kind == "General" and m.path else fields
        names = [n for n in SHOWN[kind] if fields.get(n)] if kind in SHOWN else list(fields)
        label = lambda n: LABELS.get(n, n.replace("_", " ")) if kind in SHOWN and kind not in ("Exif", "Iptc") else n  # noqa: E731, B023
        lines = [f"{label(n):<41}: {shown(n, fields[n], whole) if kind in SHOWN else fields[n]}\n" for n in names]
        sections.append(kind + (f" #{pos + 1}" if len(m.kinds[kind]) > 1 else "") + "\n" + "".join(lines))
    return "\n".join(sections)


# ---- the summary


def _values(m: Media, kind: str, name: str) -> list[str]:
    return [f[name] for _, _, f, _ in m.streams(kind) if name in f]


def _whole(values: list[str]) -> list[int]:
    return [int(v) for v in values if v.isascii() and v.isdecimal()]


def summary_size(size: int) -> str:
    k, value = 0, float(size)
    while value >= 1024 and k < 4:
        k, value = k + 1, value / 1024
    return f"{value:.2f} {('Bytes', 'KiB', 'MiB', 'GiB', 'TiB')[k]}" if k else f"{size} Bytes"


def summary_duration(ms: int) -> str:
    s = ms // 1000
    return f"{ms} ms" if ms < 1000 else f"{s // 3600} h {s // 60 % 60} m {s % 60} s" if s >= 3600 else f"{s // 60} m {s % 60} s" if s >= 60 else f"{s} s"


def summary_bitrate(bps: int) -> str:
    return f"{bps / 1e6:.2f} Mb/s" if bps >= 1_000_000 else f"{bps / 1e3:.2f} kb/s" if bps >= 1000 else f"{bps} b/s"


def to_summary(m: Media) -> str:
    out = [f"File: {m.path}\n"]
    for label, name, form in (("Container", "Format", None), ("Size", "FileSize", summary_size), ("Duration", "Duration", summary_duration), ("Overall bit rate", "OverallBitRate", summary_bitrate)):
        for value in _values(m, "General", name)[:1]:
            if form is None:
                out.append(f"{label}: {value}\n")
            elif _whole([value]):
                out.append(f"{label}: {form(int(value))}\n")
    n = [len(m.kinds.get(k, [])) for k in ("Video", "Audio", "Text", "Image")]
    out.append("\nStreams: {} video, {} audio, {} text, {} image\n\n".format(*n))
    for kind in ("Video", "Audio", "Text", "Image"):
        if not m.kinds.get(kind):
            continue
        lines = [("Codec(s)", sorted(set(_values(m, kind, "Format")), key=str.encode))]
        if kind == "Video":
            wide, high = (_whole(_values(m, kind, x)) for x in ("Width", "Height"))
            both = [f"{f(wide)}x{f(high)}" for f in ((min,) if len(m.kinds[kind]) == 1 else (min, max))] if wide and high else []
            lines += [("Resolution", [" - ".join(both)] if both else []), ("Frame rate(s)", sorted(set(_values(m, kind, "FrameRate")))), ("Bit depth(s)", map(str, sorted(set(_whole(_values(m, kind, "BitDepth")))))), ("Scan type(s)", sorted(set(_values(m, kind, "ScanType"))))]
        if kind == "Audio":
            lines += [("Channels", map(str, sorted(set(_whole(_values(m, kind, "Channels")))))), ("Sampling rate(s)", [f"{x} Hz" for x in sorted(set(_whole(_values(m, kind, "SamplingRate"))))]), ("Bit depth(s)", map(str, sorted(set(_whole(_values(m, kind, "BitDepth"))))))]
        if kind in ("Audio", "Text"):
            lines.append(("Language(s)", sorted(set(_values(m, kind, "Language")))))
        if kind == "Image":
            lines.append(("Resolution(s)", [f"{f['Width']}x{f['Height']}" for _, _, f, _ in m.streams(kind) if "Width" in f and "Height" in f]))
        shown = [(label, list(v)) for label, v in lines]
        out += [f"{kind}\n{'-' * len(kind)}\n", *[f"{label}: {', '.join(v)}\n" for label, v in shown if v], "\n"]
    return "".join(out)


# ---- dialects that differ in nothing but their elements

_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
# Head with the path, opening and closing of a stream by its kind, element of a field, end.
DIALECTS: dict[str, tuple[str, str, str, Callable[[str], str], str]] = {
    "ebucore": (
        _XML + '<ebucore:ebuCoreMain xmlns:ebucore="urn:ebu:metadata-schema:ebuCore_2015">\n<ebucore:coreMetadata>\n<ebucore:identifier>{path}</ebucore:identifier>\n',
        '<ebucore:format type="{kind}">\n', "</ebucore:format>\n", lambda n: "ebucore:" + n.lower().replace("_", ""), "</ebucore:coreMetadata>\n</ebucore:ebuCoreMain>\n",
    ),
    "mpeg7": (_XML + '<Mpeg7 xmlns="urn:mpeg:mpeg7:schema:2004">\n<MediaInformation><MediaLocator>{path}</MediaLocator>\n', "<{kind}>\n", "</{kind}>\n", str, "</MediaInformation></Mpeg7>\n"),
    "pbcore": (
        _XML + '<pbcoreDescriptionDocument xmlns="http://www.pbcore.org/PBCore/PBCoreNamespace.html">\n<pbcoreIdentifier source="framelake">{path}</pbcoreIdentifier>\n',
        '<pbcoreInstantiation>\n<pbcoreFormatID source="{kind}"/>\n', "</pbcoreInstantiation>\n", lambda n: "pbcore" + n, "</pbcoreDescriptionDocument>\n",
    ),
    "niso": (_XML + '<niso:metadata xmlns:niso="http://www.niso.org/schemas/z39.87/metadata">\n<niso:identifier>{path}</niso:identifier>\n', '<niso:stream type="{kind}">\n', "</niso:stream>\n", lambda n: "niso:" + n, "</niso:metadata>\n"),
    "fims": (_XML + '<fims:media xmlns:fims="http://www.fims.tv/schemas/2013" version="1.0">\n<fims:location>{path}</fims:location>\n', '<fims:format type="{kind}">\n', "</fims:format>\n", lambda n: "fims:" + n, "</fims:media>\n"),
    "revtmd": (_XML + "<REVTMD>\n<Source>{path}</Source>\n", "", "", str, "</REVTMD>\n"),
}


def _dialect(name: str) -> Callable[[Media], str]:
    head, begin, end, element, tail = DIALECTS[name]

    def make(m: Media) -> str:
        out = [head.replace("{path}", _text(m.path))]
        for kind, _, fields, _ in m.streams("General", "Video", "Audio"):
            out += [begin.replace("{kind}", kind), *[f"<{element(n)}>{_text(v)}</{element(n)}>\n" for n, v in fields.items()], end.replace("{kind}", kind)]
        return "".join([*out, tail])

    return make


def to_graph(m: Media) -> str:
    nodes = [x for kind, _, fields, _ in m.streams("General", "Video", "Audio", "Text", "Image") for x in (f'  "{kind}" [shape=box];\n', *[f'  "{n}";\n' for n in fields])]
    return "".join(["digraph media {\n", *nodes, "}\n"])


FORMS: dict[str, Callable[[Media], str]] = {"json": to_json, "xml": to_xml, "csv": to_csv, "text": to_text, "summary": to_summary, "graph": to_graph} | {n: _dialect(n) for n in DIALECTS}


# ---- many files at once: files with the same fields in the same order share a template


def _xml_path(raw: str) -> str:
    return _escaped(raw, (chr(34), "&quot;"), (chr(39), "&apos;"))


def _json_inner(raw: str) -> str:
    return json.dumps(raw, ensure_ascii=False).replace("\\b", "\\u0008").replace("\\f", "\\u000c")[1:-1]


def _csv_cell(raw: str) -> str:
    return '"' + raw.replace('"', '""') + '"' if any(c in raw for c in ',"\n') else raw


# By form: how a path is written, and how a field's value is, by its name.
_WRITTEN: dict[str, tuple[Callable[[str], str], Callable[[str, str], str]]] = {
    "json": (_json_inner, lambda n, v: _json_inner(_seconds(n, v))), "xml": (_xml_path, lambda n, v: _text(_seconds(n, v))), "csv": (str, lambda n, v: _csv_cell(v)),
    "text": (str, lambda n, v: _shown(n, v, None)), "summary": (str, lambda n, v: v), "graph": (str, lambda n, v: v),
} | {n: (_text, lambda n, v: _text(v)) for n in DIALECTS}
#: Fields whose values the summary doesn't merely copy; it is made once for all files that agree in them.
_SUMMED = frozenset(("Format", "FileSize", "Duration", "OverallBitRate", "Width", "Height", "FrameRate", "BitDepth", "ScanType", "Channels", "SamplingRate", "Language"))
_SHARES = frozenset(("StreamSize", "Source_StreamSize"))
# Private-use characters stand around a value's number in templates. No form changes them; rows that have them are written one by one.
_OPEN, _CLOSE = "\ue0f0", "\ue0f1"
_MARK = re.compile(f"({_OPEN}[0-9]*[a-z]?{_CLOSE})")


def _template(form: str, shape: list[tuple[int, int, str, bool, bool]], with_path: bool) -> list[str | tuple[str, int]]:
    """The parts of a document of files with these fields (kind_id, pos, name, is_extra, empty): literal text, or a value's
    place, or -1 for the path; with "s" where the value is shown in the text report."""
    rows = [{"kind_id": k, "pos": p, "ord": i, "name": n, "value": "" if empty else f"{_OPEN}{i}{_CLOSE}", "is_extra": e} for i, (k, p, n, e, empty) in enumerate(shape)]
    m = Media(f"{_OPEN}{_CLOSE}" if with_path else "", rows)
    made = to_text(m, lambda name, raw, whole: raw.replace(_CLOSE, "s" + _CLOSE)) if form == "text" else FORMS[form](m)
    found = [("s" if x[-2] == "s" else "", int(x[1:-1].rstrip("s") or -1)) if x.startswith(_OPEN) else x for x in _MARK.split(made)]
    return [x for x in found if x]


def _mapped(values: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """A function of each value, called once for equal ones."""
    coded = values.dictionary_encode()
    return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _like(form: str, paths: pa.Array, shape: list[tuple[int, int, str, bool, bool]], column: Callable[[int], pa.Array], with_path: bool) -> pa.Array:
    """The documents of files of one shape. ``column`` gives all files' values of a field by its place."""
    on_path, on_value = _WRITTEN[form]
    if form == "summary":
        used = [i for i, x in enumerate(shape) if x[2] in _SUMMED]
        rows = list(zip(*[column(i).to_pylist() for i in used])) if used else [()] * len(paths)
        made = {}
        for key in set(rows):
            told = dict(zip(used, key))
            fields = [{"kind_id": k, "pos": p, "ord": i, "name": n, "value": told.get(i, ""), "is_extra": e} for i, (k, p, n, e, _) in enumerate(shape)]
            made[key] = to_summary(Media(f"{_OPEN}{_CLOSE}", fields)).split(f"{_OPEN}{_CLOSE}")
        return pa.array([path.join(made[key]) for path, key in zip(paths.to_pylist(), rows)], pa.string())
    size = next((i for i, x in enumerate(shape) if x[:4] == (0, 0, "FileSize", False)), None) if form == "text" else None
    parts: list = []
    for part in _template(form, shape, with_path):
        if isinstance(part, str):
            parts.append(pa.scalar(part))
            continue
        shown, i = part
        name = "CompleteName" if i < 0 else shape[i][2]
        if form == "text" and not shown:
            parts.append(paths if i < 0 else column(i))
        elif i < 0:
            parts.append(_mapped(paths, lambda v: _shown("CompleteName", v, None)) if form == "text" else _mapped(paths, on_path))
        elif size is not None and name in _SHARES:
            sizes = [int(w) if w.isdecimal() else None for w in column(size).to_pylist()]
            parts.append(pa.array([_shown(name, v, w) for v, w in zip(column(i).to_pylist(), sizes)], pa.string()))
        else:
            parts.append(_mapped(column(i), functools.partial(on_value, name)))
    if not any(isinstance(p, pa.Array) for p in parts):
        return pa.array(["".join(p.as_py() for p in parts)] * len(paths), pa.string())
    return pc.binary_join_element_wise(*parts, "")


def _documents(form: str, paths: pa.Array, lists: pa.Array) -> pa.Array:
    """The documents of a batch of files, in its order."""
    paths, offsets, flat = pc.fill_null(paths, ""), lists.offsets.to_numpy(), lists.values
    kinds, places, names, values, extras = (flat.field(n) for n in ("kind_id", "pos", "name", "value", "is_extra"))
    if flat.null_count or any(c.null_count for c in (kinds, places, names, values, extras)) or any(pc.any(pc.match_substring(c, x)).as_py() for c in (paths, names, values) for x in (_OPEN, _CLOSE)):
        return pa.array([FORMS[form](Media(p, rows)) for p, rows in zip(paths.to_pylist(), lists.to_pylist())], pa.string())
    coded = names.dictionary_encode()
    empty = pc.equal(values, "")
    marks = np.stack([kinds.to_numpy(), places.to_numpy(), coded.indices.to_numpy(), extras.to_numpy(zero_copy_only=False), empty.to_numpy(zero_copy_only=False)], axis=1).astype(np.int32)
    no_path = pc.equal(paths, "").to_pylist()
    alike: dict[tuple[bytes, bool], list[int]] = {}
    for k, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        alike.setdefault((marks[a:b].tobytes(), no_path[k]), []).append(k)
    made, order, texts = [], [], coded.dictionary.to_pylist()
    for (_, bare), found in alike.items():
        at = np.array(found)
        start, end = offsets[at[0]], offsets[at[0] + 1]
        shape = [(int(k), int(p), texts[n], bool(e), bool(x)) for k, p, n, e, x in marks[start:end]]
        made.append(_like(form, paths.take(pa.array(at)), shape, lambda i, at=at: values.take(pa.array(offsets[at] + i)), not bare))
        order.append(at)
    if not made:
        return pa.array([], pa.string())
    return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


def _rendered(form: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _documents(form, batch.column(0), batch.column(1))], ["path", "document"])

    return run


# ---- plain WAV files of integer PCM: their documents in Catalyst, as they share one shape


def _pcm_value(form: str, name: str, value: Column | str) -> Column | str:
    """A field's value as a form writes it."""
    if isinstance(value, str):
        return _WRITTEN[form][1](name, value)
    if form in ("json", "xml") and name == "Duration":
        return F.concat(F.call_function("div", value, F.lit(1000)).cast("string"), F.lit("."), F.lpad((value % 1000).cast("string"), 3, "0"))
    return value.cast("string")


def pcm_document(form: str, path: Column, told: Column) -> Column:
    """The document of a file from the numbers of ``settled_pcm``. Its path is written as it is."""
    rows = pcm_rows(told)
    if form == "summary":
        # Numbers that stand for others: the summary writes these as they are.
        marks = {"Channels": "700000001", "SamplingRate": "700000002", "BitDepth": "700000003"}
        shape = [{"kind_id": k, "pos": 0, "ord": i, "name": n, "value": v if isinstance(v, str) else marks.get(n, ""), "is_extra": False} for i, (k, n, v) in enumerate(rows)]
        columns = {marks[n]: v.cast("string") for _, n, v in rows if n in marks} | {f"{_OPEN}{_CLOSE}": path}
        parts = [columns.get(x, x) for x in re.split("(" + "|".join(columns) + ")", to_summary(Media(f"{_OPEN}{_CLOSE}", shape)))]
    else:
        parts = [x if isinstance(x, str) else path if x[1] < 0 else _pcm_value(form, *rows[x[1]][1:]) for x in _template(form, [(k, 0, n, False, False) for k, n, _ in rows], True)]
    # Neighbouring texts go together.
    joined = [[F.lit("".join(found))] if literal else list(found) for literal, found in itertools.groupby(parts, lambda p: isinstance(p, str))]
    return F.concat(*itertools.chain(*joined))


#: What a form may have to escape in a path, and what stands around numbers in templates.
_UNSAFE = "[\\x00-\\x1f\\x7f\"&',<>\\\\\\ue0f0\\ue0f1]"
#: The text report's values have forms of their own, which only Python writes.
_IN_PYTHON = frozenset(("text",))


def _asked(form: str, asked: pa.Array, paths: pa.Array, lists: pa.Array) -> pa.Array:
    """The documents of the files of a batch that are asked for; null for the others."""
    given = asked.to_numpy(zero_copy_only=False)
    if not given.any():
        return pa.nulls(len(asked), pa.string())
    made = _documents(form, paths.filter(asked), lists.filter(asked))
    return made.take(pa.array(np.cumsum(given) - 1, pa.int64(), mask=~given))


@functools.cache
def _renderer(form: str) -> Callable:
    """Made when it is first used, as its type is parsed by a session."""

    def run(asked: pa.Array, paths: pa.Array, lists: pa.Array) -> pa.Array:
        return _asked(form, asked, paths, lists)

    return F.arrow_udf("string")(run)


def export(fields: DataFrame, form: str) -> DataFrame:
    """(path, document): the fields of each path as one of ``FORMS``. ``fields`` is the long table, whose rows are gathered
    by path; or what ``parsed`` makes, a row a file with its fields in it, which needs no shuffle. Of files of which it kept the
    numbers (``keep_pcm``) the documents are put together in Catalyst, but for those with odd paths."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    if "pcm" in fields.columns:
        path, pcm = F.col("path"), F.col("pcm")
        own = pcm.isNotNull() & (path != "") & ~path.rlike(_UNSAFE) if form not in _IN_PYTHON else F.lit(False)
        rows = fields.where("fields is not null or pcm is not null").select("path", "pcm", "fields", F.coalesce(own, F.lit(False)).alias("own"))
        others = F.when(~F.col("own"), F.coalesce("fields", F.when(pcm.isNotNull(), pcm_fields(pcm))))
        if form in _IN_PYTHON:
            return rows.select("path", others.alias("rows")).mapInArrow(_rendered(form), "path string, document string")
        # An empty list, not null: for each row that follows a null list, Spark goes through the batch's lists up to it again.
        made = _renderer(form)(~F.col("own"), F.when(~F.col("own"), path), F.coalesce(others, F.array().cast(f"array<{KERNEL_FIELD}>")))
        return rows.select("path", F.when(F.col("own"), pcm_document(form, path, pcm)).otherwise(made).alias("document"))
    # Python gets a file's fields in the order of writing.
    if "fields" in fields.columns:
        rows = fields.select("path", F.col("fields").alias("rows")).where("rows is not null")
    else:
        own = F.struct("kind_id", "pos", "ord", "name", "value", "is_extra")
        rows = fields.groupBy("path").agg(F.array_sort(F.collect_list(own)).alias("rows"))
    return rows.mapInArrow(_rendered(form), "path string, document string")
