"""From blobs to fields: Catalyst layouts where they suffice, Arrow-batched kernels elsewhere."""

from __future__ import annotations

import functools
import itertools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import display as D
from framelake.model import KERNEL_FIELD, kind_name
from framelake.operators import derived
from framelake.operators.detection import with_candidates
from framelake.operators.layouts import LAYOUTS, NAMES, flac_fields, layout_fields, pcm_fields, plain_flac, plain_pcm, plain_png, plain_wav_fields, png_fields, settled_pcm, turned_pcm
from framelake.operators.registry import IN_LAYOUTS, KERNELS, first_accepting

_FIELD = pa.struct([("kind_id", pa.int32()), ("pos", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("is_extra", pa.bool_())])
_WALKED = pa.struct([("parser", pa.string()), ("fields", pa.list_(_FIELD)), ("truncated", pa.bool_())])


_WALKED_SQL = f"struct<parser: string, fields: array<{KERNEL_FIELD}>, truncated: boolean>"
#: Parsers of which the plainest files are read in the JVM, with the numbers that tell their fields.
_TOLD = {
    "wav": "struct<riff: bigint, channels: bigint, rate: bigint, align: bigint, bits: bigint, size: bigint>",
    "png": "struct<width: bigint, height: bigint, depth: bigint, colour: bigint, size: int>",
    "flac": "struct<even: boolean, most: bigint, form: bigint, low: bigint, md5: binary, size: int>",
}
_TOLD_FIELDS = {"wav": pcm_fields, "png": png_fields, "flac": flac_fields}


def _packed(found: list[tuple[str, list, bool] | None]) -> pa.Array:
    """Results of kernels as one Arrow array."""
    rows = [row for f in found if f for row in f[1]]
    ends = [0, *itertools.accumulate(len(f[1]) if f else 0 for f in found)]
    columns = zip(*rows) if rows else ((),) * len(_FIELD)
    fields = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _FIELD)], fields=list(_FIELD))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
    return pa.StructArray.from_arrays([pa.array([f[0] if f else None for f in found], pa.string()), lists, pa.array([f[2] if f else None for f in found], pa.bool_())], fields=list(_WALKED))


def _walk(candidates: pa.Array, content: pa.Array) -> pa.Array:
    """Tries the kernels in their order on rows that have content; the others stay null."""
    if content.null_count == len(content):
        return pa.nulls(len(content), _WALKED)
    return _packed([first_accepting([n for n in tried if n in KERNELS], blob) if blob is not None else None for tried, blob in zip(candidates.to_pylist(), content.to_pylist())])


#: What stands at the front of blobs that one gate settles, before any other is asked.
_SURE = {b"\x89PNG\r\n\x1a\n": "png", b"fLaC": "flac"}


def _sure_kernel(blob: bytes) -> tuple[str, list, bool] | None:
    """What the kernel of a blob's front says, where no gate before it can accept the blob."""
    name = "flac" if blob[:4] == b"fLaC" else "png" if blob[12:16] == b"IHDR" and b"\x06\x0e\x2b\x34" not in blob[:4096] else None
    return first_accepting([name], blob) if name else None


def _surely(head: pa.Array, length: pa.Array) -> pa.Array:
    """Fields of blobs whose front settles what they are, null for all others: of plain WAV files, of which the first 44 bytes
    come here, and of PNG and FLAC files that their kernels accept. Equal heads are read once a batch."""
    if head.null_count == len(head):
        return pa.nulls(len(head), _WALKED)
    wav = pc.equal(pc.binary_slice(head, 0, 4), pa.scalar(b"RIFF", head.type))
    places: dict[tuple | int | None, int] = {}
    at, found = [], []
    for k, (blob, size) in enumerate(zip(head.to_pylist(), pc.if_else(wav, length, None).to_pylist())):
        place = places.setdefault((blob, size) if size is not None else None if blob is None else k, len(found))
        at.append(place)
        if place == len(found):
            fields = plain_wav_fields(blob, size) if size is not None else None
            found.append(("wav", fields, False) if fields else _sure_kernel(blob) if blob is not None and size is None else None)
    made = _packed(found)
    return made if len(found) == len(at) else made.take(pa.array(at, pa.int32()))


def _sure_head() -> Column:
    """The part of a blob that ``_surely`` needs, null for blobs that the gates have to sort out."""
    c = F.col("content")
    front = lambda mark: F.substring(c, 1, len(mark)) == F.lit(bytes(mark))
    whole = functools.reduce(lambda a, b: a | b, [front(m) for m in _SURE])
    return F.when(front(b"RIFF") & (F.substring(c, 9, 8) == F.lit(b"WAVEfmt ")), F.substring(c, 1, 44)).when(whole, c)


@functools.cache
def _sure():
    """Made when it is first used, as its type is parsed by a session."""
    return F.arrow_udf(_WALKED_SQL)(_surely)


@functools.cache
def _walker():
    """Made when it is first used, as its type is parsed by a session."""
    return F.arrow_udf(_WALKED_SQL)(_walk)


_made: dict[tuple, Column] = {}


def _layouts(name: str, *columns: str) -> Column:
    """The layouts of all parsers as one expression; made once for each JVM, as it has some thousand nodes."""
    key = id(SparkContext._gateway), name, *columns
    if key not in _made:
        _made[key] = layout_fields(*[F.col(c) for c in columns])
    return _made[key]


def parsed(files: DataFrame, policy: str = "compat", parser: str | None = None, keep_length: bool = False, keep_pcm: bool = False) -> DataFrame:
    """(path, [length,] parser, fields, truncated, error): one row for each of ``files`` (path, content), by detection or by one parser
    that is called for all.

    ``fields`` is an array in the order of writing; null, with an error, where nothing accepts the blob. ``truncated`` tells
    of walked blobs whether they end before what they announce. Python gets the content only of blobs whose first
    candidates have to be walked, and the first 44 bytes of a plain WAV file that isn't integer PCM. With ``keep_pcm``, plain WAV
    files of integer PCM have the numbers of ``settled_pcm`` in another column, pcm, instead of their fields."""
    known = parser is None or parser in KERNELS or parser in LAYOUTS or parser in NAMES
    rows = files.select("path", "content")
    if parser in (None, "wav", *_SURE.values()):
        rows = _made_once(rows)
        asked = lambda name, told: told if parser in (None, name) else F.lit(None).cast(_TOLD[name])
        content = F.col("content")
        rows = _made_once(rows.select("path", "content", asked("wav", plain_pcm(content)).alias("wav"), asked("png", plain_png(content)).alias("png"), asked("flac", plain_flac(content)).alias("flac")))
        rows = _made_once(rows.select("path", "content", asked("wav", turned_pcm(F.col("wav"))).alias("wav"), "png", "flac"))
        rows = _made_once(rows.select("path", "content", asked("wav", settled_pcm(F.col("wav"), F.octet_length("content"))).alias("wav"), "png", "flac"))
        rows = rows.withColumn("sure", _sure()(F.when(F.coalesce("wav.size", "png.size", "flac.size").isNull(), _sure_head()), F.octet_length("content")))
        if parser is not None:
            rows = rows.withColumn("sure", F.when(F.col("sure.parser") == parser, F.col("sure")))
    else:
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in _TOLD.items()} | {"sure": F.lit(None).cast(_WALKED_SQL)})
    plain = F.coalesce("wav.size", "png.size", "flac.size").isNotNull() | F.col("sure.parser").isNotNull()
    rows = _made_once(rows.select("path", "content", *_TOLD, "sure", plain.alias("plain")))
    if parser is None:
        rows = with_candidates(rows, policy)
    else:
        rows = rows.withColumn("tried", F.when(F.col("content").isNotNull() & F.lit(known), F.array(F.lit(parser))))
    walked = [n for n in KERNELS if n not in IN_LAYOUTS]
    # The last candidate may need no walk; the others are tried by the kernels before it.
    last = F.get("tried", F.size("tried") - 1)
    rows = rows.withColumn("settled", F.when(~F.col("plain") & ~last.isin(*walked), last))
    walk = ~F.col("plain") & F.get("tried", 0).isin(*walked) & (F.size("tried") > 0)
    # One struct made once for all its uses; only rows to be walked have content in it.
    rows = rows.select("path", "plain", *_TOLD, "sure", "tried", "settled", "content", F.when(F.coalesce(walk, F.lit(False)), F.col("content")).alias("body"))
    rows = rows.withColumn("walked", _walker()(F.coalesce("tried", F.array().cast("array<string>")), "body")) if parser is None or parser in walked else rows.withColumn("walked", F.lit(None).cast(_WALKED_SQL))
    mine = F.col("walked.parser").isNotNull()
    fields, name = F.when(F.lit(False), F.lit(None)), F.when(F.lit(False), F.lit(None))
    for n, made in _TOLD_FIELDS.items():
        here = F.col(n).isNotNull()
        fields, name = fields.when(here, F.lit(None) if keep_pcm and n == "wav" else made(F.col(n))), name.when(here, n)
    fields = fields.when(F.col("plain"), F.col("sure.fields")).when(mine, F.col("walked.fields")).otherwise(_layouts("blob", "settled", "content"))
    name = name.when(F.col("plain"), F.col("sure.parser")).when(mine, F.col("walked.parser")).otherwise(F.col("settled"))
    error = F.when(F.col("content").isNull(), "no content").when(name.isNull(), "no parser accepts the blob")
    length = [F.octet_length("content").cast("long").alias("length")] if keep_length else []
    pcm = [F.col("wav").alias("pcm")] if keep_pcm else []
    return _made_once(rows.select("path", *pcm, *length, name.alias("parser"), fields.alias("fields"), F.coalesce("sure.truncated", "walked.truncated", F.lit(False)).alias("truncated"), error.alias("error")))


def _made_once(rows: DataFrame) -> DataFrame:
    """``rows`` as generated ones: what is built on them refers to their columns instead of repeating the expressions."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def long_fields(rows: DataFrame) -> DataFrame:
    """The long table of what ``parsed`` makes."""
    flat = rows.select("path", F.posexplode("fields").alias("ord", "f"))
    return flat.select("path", "f.kind_id", kind_name(F.col("f.kind_id")).alias("kind"), "f.pos", "f.name", "f.value", "f.is_extra", "ord")


def parse(files: DataFrame, policy: str = "compat", parser: str | None = None) -> DataFrame:
    """The fields of all ``files`` (path, content) as the long table. Blobs that nothing accepts have no rows here; ``parsed``
    tells why."""
    return long_fields(parsed(files, policy, parser))


def stream_maps(rows: DataFrame, kind: int) -> DataFrame:
    """(path, pos, fields): the streams of a kind of what ``parsed`` makes, a map of each one's fields. A file's fields are in
    one row already, so nothing is shuffled."""
    own = F.filter("fields", lambda r: (r["kind_id"] == kind) & ~r["is_extra"])
    flat = _made_once(rows.select("path", own.alias("own"))).select("path", "own", F.explode(F.array_sort(F.array_distinct(F.transform("own", lambda r: r["pos"])))).alias("pos"))
    pairs = F.transform(F.filter("own", lambda r: r["pos"] == F.col("pos")), lambda r: F.struct(r["name"], r["value"]))
    return flat.select("path", "pos", F.map_from_entries(pairs).alias("fields"))


def typed_streams(rows: DataFrame, kind: int, columns: dict[str, str]) -> DataFrame:
    """One row a stream of a kind of what ``parsed`` makes, with named fields cast to types; what can't be cast is null."""
    wanted = F.filter("fields", lambda r: (r["kind_id"] == kind) & ~r["is_extra"])
    flat = _made_once(rows.select("path", wanted.alias("own"))).select("path", "own", F.explode(F.array_sort(F.array_distinct(F.col("own.pos")))).alias("pos"))
    first = F.array_max(F.col("own.pos")) == F.array_min(F.col("own.pos"))
    one = _made_once(flat.select("path", "pos", F.when(first, F.col("own")).otherwise(F.filter("own", lambda r: r["pos"] == F.col("pos"))).alias("own")))
    value = lambda n: F.get(F.col("own.value"), (F.array_position(F.col("own.name"), F.lit(n)) - 1).cast("int"))
    return one.select("path", "pos", *[value(n).try_cast(t).alias(n) for n, t in columns.items()])


def _value(kind: int, name: str) -> Column:
    """A field of the first stream of a kind, as text."""
    return F.get(F.filter("fields", lambda r: (r["kind_id"] == kind) & (r["pos"] == 0) & (r["name"] == name) & ~r["is_extra"]), F.lit(0))["value"]


def with_file_level(rows: DataFrame) -> DataFrame:
    """Adds what a file as a whole has to the fields of what ``parsed`` makes with ``keep_length``: FileSize, Duration,
    OverallBitRate and its mode, FrameRate, FrameCount and StreamSize of General, where the parser told none. The rules are
    those of ``derived.file_level``; nothing is shuffled, and a file's fields are gone through once."""
    own = rows.columns
    first = lambda kind: F.filter("fields", lambda r: (r["kind_id"] == kind) & (r["pos"] == 0) & ~r["is_extra"])
    rows = _made_once(rows.select(*own, *[first(k).alias(f"_{k}") for k in range(3)]))
    at = lambda kind, name: F.get(F.col(f"_{kind}.value"), (F.array_position(f"_{kind}.name", F.lit(name)) - 1).cast("int"))
    needed = [(0, n) for n in ("FileSize", "Duration", "OverallBitRate", "OverallBitRate_Mode", "FrameRate", "FrameCount", "StreamSize")]
    needed += [(2, "Duration"), (2, "BitRate_Mode"), (2, "StreamSize"), (1, "FrameRate_Mode"), (1, "StreamSize"), (1, "FrameRate"), (1, "FrameCount")]
    video = F.exists("fields", lambda r: r["kind_id"] == 1)
    rows = _made_once(rows.select(*own, F.struct(*[at(k, n).alias(f"{k}_{n}") for k, n in needed]).alias("_of"), video.alias("_video")))
    told = lambda kind, name: F.col(f"_of.{kind}_{name}")
    whole = lambda c: c.try_cast("long")
    ms, sound, picture = F.coalesce(whole(told(0, "Duration")), whole(told(2, "Duration"))), whole(told(2, "StreamSize")), F.coalesce(whole(told(1, "StreamSize")), F.lit(0))
    rows = _made_once(rows.select(*own, "_of", "_video", ms.alias("_ms"), F.when(sound.isNotNull(), sound + picture).when(picture > 0, picture).alias("_inner")))
    ms, inner, video = F.col("_ms"), F.col("_inner"), F.col("_video")
    overall = F.when(ms > 0, F.round(F.col("length") * 8.0 * 1000.0 / ms).cast("long"))
    mode = F.when(~video, told(2, "BitRate_Mode")).when(told(1, "FrameRate_Mode") == "VFR", "VBR")
    found = {
        "FileSize": F.col("length"), "Duration": ms, "OverallBitRate": overall, "OverallBitRate_Mode": F.when(ms > 0, mode), "FrameRate": F.when(video, told(1, "FrameRate")), "FrameCount": F.when(video, told(1, "FrameCount")),
        "StreamSize": F.when(inner < F.col("length"), F.col("length") - inner),
    }
    made = [F.struct(F.lit(0).alias("kind_id"), F.lit(0).alias("pos"), F.lit(n).alias("name"), F.when(told(0, n).isNull(), v.cast("string")).alias("value"), F.lit(False).alias("is_extra")) for n, v in found.items()]
    added = F.filter(F.array(*made), lambda r: r["value"].isNotNull())
    fields = F.when(F.col("fields").isNotNull(), F.concat("fields", added))
    return _made_once(rows.select(*[fields.alias(c) if c == "fields" else F.col(c) for c in own]))


def with_computed(rows: DataFrame) -> DataFrame:
    """Adds to the fields of what ``parsed`` makes those that follow from others of the same stream: Bits_Pixel_Frame,
    FrameRate_Mode_Original and Format_Level_Inferred of video, BitRate_Minimum of video and audio, where there are none;
    and the bit rate ranges of the file. Nothing is shuffled."""
    streams = F.array_distinct(F.transform(F.filter("fields", lambda r: r["kind_id"].isin(1, 2)), lambda r: F.struct(r["kind_id"].alias("kind_id"), r["pos"].alias("pos"))))

    def of(s: Column, name: str) -> Column:
        return F.get(F.filter("fields", lambda r: (r["kind_id"] == s["kind_id"]) & (r["pos"] == s["pos"]) & (r["name"] == name) & ~r["is_extra"]), F.lit(0))["value"]

    def row(s: Column, name: str, value: Column) -> Column:
        made = F.struct(s["kind_id"].alias("kind_id"), s["pos"].alias("pos"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(False).alias("is_extra"))
        return F.when(value.isNotNull() & of(s, name).isNull(), made)

    def computed(s: Column) -> Column:
        number = lambda name: of(s, name).try_cast("double")
        video = s["kind_id"] == 1
        return F.array(
            row(s, "Bits_Pixel_Frame", F.when(video, D.bits_pixel_frame(number("Width"), number("Height"), number("FrameRate"), number("BitRate")))),
            row(s, "FrameRate_Mode_Original", F.when(video, of(s, "FrameRate_Mode"))),
            row(s, "BitRate_Minimum", derived.lowest_bitrate(of(s, "BitRate"))),
            row(s, "Format_Level_Inferred", F.when(video & (of(s, "Format") == "AV1"), derived.inferred_av1_level(of(s, "Format_Profile"), number("Width"), number("Height"), number("FrameRate")))),
        )

    every = F.concat("fields", F.array_compact(F.flatten(F.transform(streams, computed))))
    rows = _made_once(rows.withColumn("fields", F.when(F.col("fields").isNotNull(), every)))
    rates = lambda name: F.array_compact(F.transform(F.filter("fields", lambda r: r["kind_id"].isin(1, 2) & (r["name"] == name)), lambda r: r["value"].try_cast("long")))
    top = F.aggregate(rates("BitRate_Maximum"), F.lit(0).cast("long"), lambda a, x: a + x)
    general = {"OverallBitRate_Maximum": F.when(top > 0, top), "OverallBitRate_Minimum": F.array_min(rates("BitRate"))}
    made = [F.when(v.isNotNull() & _value(0, n).isNull(), F.struct(F.lit(0).alias("kind_id"), F.lit(0).alias("pos"), F.lit(n).alias("name"), v.cast("string").alias("value"), F.lit(False).alias("is_extra"))) for n, v in general.items()]
    return _made_once(rows.withColumn("fields", F.when(F.col("fields").isNotNull(), F.concat("fields", F.array_compact(F.array(*made))))))
