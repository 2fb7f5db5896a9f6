"""Queries over the driver's tables, each with the SQL that computes the same from the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import display as D
from framelake.model import KINDS, kind_id
from framelake.operators import derived, diffing, streams, summary
from framelake.operators.detection import detected
from framelake.operators.parsing import parse, parsed, stream_maps, typed_streams, with_file_level
from framelake.plans import blobs, planted
from framelake.sinks import orders
from framelake.sources import media

VIDEO, AUDIO, IMAGE = (KINDS.index(k) for k in ("Video", "Audio", "Image"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WAV = "select 1 + l_linenumber % 2 as ch, case l_orderkey % 3 when 0 then 8000 when 1 then 44100 else 48000 end as hz, l_quantity::bigint as n from lineitem"


@_query(f"""
select hz::varchar as sampling_rate, ch::varchar as channels, count(*) as files, sum(n * ch * 2)::bigint as bytes,
  min((n * 1000 + hz // 2) // hz)::bigint as duration_min, max((n * 1000 + hz // 2) // hz)::bigint as duration_max, max(hz * ch * 16)::bigint as bitrate
from ({_WAV}) group by all""")
def wav_roundtrip_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: build, detect, decode, view typed, aggregate."""
    audio = typed_streams(parsed(blobs.wav_blobs(_table(spark, sf_dir, "lineitem"))), AUDIO, {"SamplingRate": "string", "Channels": "string", "StreamSize": "long", "Duration": "long", "BitRate": "long"})
    return audio.groupBy(F.col("SamplingRate").alias("sampling_rate"), F.col("Channels").alias("channels")).agg(
        F.count("*").alias("files"), F.sum("StreamSize").alias("bytes"), F.min("Duration").alias("duration_min"), F.max("Duration").alias("duration_max"), F.max("BitRate").alias("bitrate")
    )


@_query("""
select 'bmp/' || p_partkey as path, (16 + p_size)::varchar as width, (16 + p_partkey % 1000)::varchar as height,
  case when p_partkey % 2 = 0 then 'RGB' else 'Palette' end as color_space, case when p_partkey % 2 = 0 then '24' else '8' end as bit_depth from part""")
def bmp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = typed_streams(parsed(blobs.bmp_blobs(_table(spark, sf_dir, "part"))), IMAGE, {"Width": "string", "Height": "string", "ColorSpace": "string", "BitDepth": "string"})
    return view.select("path", F.col("Width").alias("width"), F.col("Height").alias("height"), F.col("ColorSpace").alias("color_space"), F.col("BitDepth").alias("bit_depth"))


@_query("""
select 'gif/' || p_partkey as path, case when p_partkey % 3 = 0 then '87a' else '89a' end as profile,
  printf('%.3f', (16 + p_size)::double / (16 + p_partkey % 1000)) as aspect from part""")
def gif_roundtrip_dar(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = typed_streams(parsed(blobs.gif_blobs(_table(spark, sf_dir, "part"))), IMAGE, {"Format_Profile": "string", "DisplayAspectRatio": "string"})
    return view.select("path", F.col("Format_Profile").alias("profile"), F.col("DisplayAspectRatio").alias("aspect"))


@_query("""
select color_space, count(*) as files, max(w)::bigint as width_max, min(h)::bigint as height_min from (
  select case o_orderkey % 5 when 0 then 'Y' when 1 then 'RGB' when 2 then 'RGB' when 3 then 'YA' else 'RGBA' end as color_space, o_orderkey % 4000 + 1 as w, o_custkey % 3000 + 1 as h from orders)
group by all""")
def png_ihdr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = typed_streams(parsed(blobs.png_blobs(_table(spark, sf_dir, "orders"))), IMAGE, {"Width": "long", "Height": "long", "ColorSpace": "string"})
    return view.groupBy(F.col("ColorSpace").alias("color_space")).agg(F.count("*").alias("files"), F.max("Width").alias("width_max"), F.min("Height").alias("height_min"))


@_query("""
select 'elf/' || s_suppkey as path, case when s_suppkey % 2 = 1 then '64' else '32' end as bits, case when (s_suppkey // 2) % 2 = 0 then 'Little' else 'Big' end as endianness,
  ['Relocatable', 'Executable', 'Shared object', 'Core'][s_suppkey % 4 + 1] as profile from supplier""")
def elf_direct_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = parse(blobs.elf_blobs(_table(spark, sf_dir, "supplier")), parser="elf")
    view = streams.typed_view(fields, "General", {"BitDepth": "string", "Format_Settings_Endianness": "string", "Format_Profile": "string"})
    return view.select("path", F.col("BitDepth").alias("bits"), F.col("Format_Settings_Endianness").alias("endianness"), F.col("Format_Profile").alias("profile"))


_BLOBS = "(select 'documents' as t, text from documents union all select 'pages', html from pages union all select 'conversations', text from conversations)"


@_query(f"""
select t as source, case when text is null or text = '' then null when strlen(text) >= 10 and ord(text[1]) >= 128 then 'vp8' when a // 64 = 0 and a // 4 % 4 < 3 and a % 4 < 2 and b // 64 < 2 then 'dat' else 'rle' end as parser, count(*) as blobs
from (select *, ('0x' || nullif(substr(hex(encode(text)), 11641, 2), ''))::int as a, ('0x' || nullif(substr(hex(encode(text)), 11643, 2), ''))::int as b from {_BLOBS}) group by all""")
def detect_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text falls through to the gates that accept nearly anything."""
    files = blobs.text_blobs(*[_table(spark, sf_dir, t) for t in ("documents", "pages", "conversations")])
    return detected(files).groupBy(F.substring_index("path", "/", 1).alias("source"), "parser").agg(F.count("*").alias("blobs"))


@_query(f"select t as source, count(*) as blobs, 0::bigint as known from {_BLOBS} group by all")
def detect_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = blobs.text_blobs(*[_table(spark, sf_dir, t) for t in ("documents", "pages", "conversations")])
    return detected(files, "sane").groupBy(F.substring_index("path", "/", 1).alias("source")).agg(F.count("*").alias("blobs"), F.count_if("ok").alias("known"))


# Planted heads before each conversation's text, by conv_id and turn, so that text formats are met.
_HEADS = ("WEBVTT\n\n", "1\n00:00:01,000 --> 00:00:02,000\n", '<?xml version="1.0"?>\n<!-- c -->\n<tt xmlns="http://www.w3.org/ns/ttml">', "#EXTM3U\n#EXTINF:1,\n", "v=0\no=- 1 1 IN IP4 0.0.0.0\nm=audio 1 RTP/AVP 0\n", "Scenarist_SCC V1.0\n\n", '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011">')
_HEAD_NAMES = ("webvtt", "sub_rip", "ttml", "hls", "sdp", "scc", "dash_mpd")


@_query("select ['webvtt', 'sub_rip', 'ttml', 'hls', 'sdp', 'scc', 'dash_mpd'][((conv_id + turn) % 7 + 1)::int] as parser, count(*) as blobs from conversations group by all")
def text_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), ((F.col("conv_id") + F.col("turn")) % len(_HEADS) + 1).cast("int"))
    files = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return detected(files, "sane").groupBy("parser").agg(F.count("*").alias("blobs"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.lit("General").alias("kind"), F.lit(0).alias("pos"), F.col("event_type").alias("name"), F.lit(False).alias("is_extra"), F.col("value").alias("value"), F.col("event_id").alias("ord"))


@_query("select user_id as path, event_type as name, arg_min(value, event_id) as value, min(event_id) as ord from events group by all")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.first_write_wins(_writes(spark, sf_dir)).select("path", "name", "value", "ord")


@_query("select user_id as path, event_type as name, arg_max(value, event_id) as value, min(event_id) as ord from events group by all")
def force_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_write_wins(_writes(spark, sf_dir)).select("path", "name", "value", "ord")


def _line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Video").when(F.col("l_linenumber") % 3 == 1, "Audio").otherwise("Text")
    pos = F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), kind.alias("kind"), pos.alias("pos"), F.lit("Width").alias("name"), F.col("l_quantity").cast("long").cast("string").alias("value"), F.lit(False).alias("is_extra"), F.lit(0).alias("ord"))


_LINES = "select l_orderkey as path, case l_linenumber % 3 when 0 then 'Video' when 1 then 'Audio' else 'Text' end as kind, (l_linenumber - 1) // 3 as pos, l_quantity::bigint::varchar as value from lineitem"


@_query(f"""
select path, kind, (dense_rank() over (partition by path, kind order by pos) - 1)::int as pos, value
from ({_LINES}) where kind = 'Video' or (kind = 'Audio' and pos = 1)""")
def filter_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.filter_keep(_line_fields(spark, sf_dir), ("Video", "Audio"), (("Audio", 1),)).select("path", "kind", "pos", "value")


@_query(f"select path, kind, max(pos)::int + 1 as streams from ({_LINES}) group by all")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_counts(_line_fields(spark, sf_dir))


@_query("""
select path, kind, pos from (
  select l_orderkey as path, 'Audio' as kind, l_linenumber as pos, row_number() over (partition by l_orderkey, l_returnflag, l_linestatus, l_quantity::bigint % 3 order by l_linenumber) as r from lineitem)
where r > 1""")
def duplicate_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.lit("Audio").alias("kind"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("format"), F.col("l_linestatus").alias("language"),
        F.lit(None).cast("string").alias("width"), (F.col("l_quantity").cast("long") % 3).cast("string").alias("channels"),
    )
    return streams.duplicate_streams(wide)


@_query("""
select l_orderkey as path, string_agg(distinct l_returnflag, ', ' order by l_returnflag) as formats, array_to_string(list_sort(list_distinct(list(l_quantity::bigint))), ', ') as channels,
  case when count(*) = 1 then min(l_quantity::bigint) || 'x' || min(l_linenumber) else min(l_quantity::bigint) || 'x' || min(l_linenumber) || ' - ' || max(l_quantity::bigint) || 'x' || max(l_linenumber) end as resolution
from lineitem group by all""")
def summary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long").cast("string")).withColumn("n", F.col("l_linenumber").cast("string"))
    return rows.groupBy(F.col("l_orderkey").alias("path")).agg(summary.distinct_joined(F.col("l_returnflag")).alias("formats"), summary.distinct_numbers(F.col("q")).alias("channels"), summary.resolution(F.col("q"), F.col("n")).alias("resolution"))


@_query(f"""
select hz::varchar as rate, count(*) as audio_streams, 'PCM' as audio_formats, string_agg(distinct ch::varchar, ', ' order by ch::varchar) as channels,
  'Streams: 0 video, ' || count(*) || ' audio, 0 text, 0 image' as line from ({_WAV}) group by all""")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of all files of a sampling rate, from parsed blobs."""
    wide = stream_maps(parsed(blobs.wav_blobs(_table(spark, sf_dir, "lineitem"))), AUDIO)
    keyed = wide.withColumn("kind", F.lit("Audio")).withColumn("rate", F.col("fields")["SamplingRate"])
    return summary.summarise(keyed, "rate").select("rate", "audio_streams", "audio_formats", "channels", "line")


@_query("""
select o_orderkey as path, size as "FileSize", ms as "Duration", case when ms > 0 then round(size * 8.0 * 1000.0 / ms)::bigint end as "OverallBitRate",
  case when ms > 0 then case when not video then mode when vfr = 'VFR' then 'VBR' end end as "OverallBitRate_Mode", case when video then '25.000' end as "FrameRate", case when video then frames end as "FrameCount",
  case when a + v < size then size - a - v end as "StreamSize"
from (select o_orderkey, floor(o_totalprice * 10)::bigint as size, case when o_orderkey % 5 = 0 then null else o_custkey * 10 end as ms, o_orderkey % 2 = 0 as video, o_orderpriority as mode,
  case when o_orderkey % 4 = 0 then 'VFR' else 'CFR' end as vfr, (o_custkey * 2)::varchar as frames, o_custkey * 1000 as a, case when o_orderkey % 2 = 0 then o_custkey * 500 else 0 end as v from orders)""")
def file_level_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    files = _table(spark, sf_dir, "orders").select(
        key.alias("path"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("file_size"), F.when(key % 5 != 0, (who * 10).cast("string")).alias("general_duration"), F.when(key % 5 == 0, "1.500000000").alias("audio_duration"),
        (who * 1000).cast("string").alias("audio_size"), F.col("o_orderpriority").alias("audio_mode"), F.when(key % 2 == 0, (who * 500).cast("string")).alias("video_size"), F.when(key % 4 == 0, "VFR").otherwise("CFR").alias("video_rate_mode"),
        (key % 2 == 0).alias("has_video"), F.lit("25.000").alias("video_rate"), (who * 2).cast("string").alias("video_frames"),
    )
    return derived.file_level(files)


@_query("select l_orderkey as path, nullif(sum(case when l_linenumber % 2 = 0 then l_partkey end), 0)::bigint as \"OverallBitRate_Maximum\", min(l_suppkey) as \"OverallBitRate_Minimum\" from lineitem group by all")
def bitrate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_suppkey").cast("string").alias("BitRate"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).alias("BitRate_Maximum"))
    return derived.bitrate_ranges(rows)


def _scalar(name: str, table: str, key: str, sql: str, make: Callable[[], Column]) -> None:
    """A query of one scalar function over a table's column."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).select(F.col(key).alias("key"), make().alias("value"))

    f.__name__ = name
    _query(f"select {key} as key, {sql} as value from {table}")(f)


_THREE = "case when {0} >= 100 then printf('%.0f', {0}) when {0} >= 10 then printf('%.1f', {0}) else printf('%.2f', {0}) end"
_BYTES = "(o_orderkey * o_orderkey * 977)::bigint"


def _big() -> Column:
    return F.col("o_orderkey") * F.col("o_orderkey") * 977


def _sizes(units: tuple[str, ...], form: str) -> str:
    arms = [f"when {_BYTES} >= 1024::bigint ** {k} then {form.format(f'({_BYTES} / (1024.0::double ** {k}))')} || ' {u}'" for k, u in reversed(list(enumerate(units, 1)))]
    return f"case {' '.join(arms)} else {_BYTES} || ' Bytes' end"


_scalar("human_size_text", "orders", "o_orderkey", _sizes(("KiB", "MiB", "GiB"), _THREE), lambda: D.text_size(_big()))
_scalar("human_size_summary", "orders", "o_orderkey", _sizes(("KiB", "MiB", "GiB", "TiB"), "printf('%.2f', {0})"), lambda: D.summary_size(_big()))
_MS = "(o_orderkey * o_custkey)"
_scalar(
    "human_duration_text", "orders", "o_orderkey",
    f"case when {_MS} // 3600000 > 0 then {_MS} // 3600000 || ' h ' || ({_MS} // 60000) % 60 || ' min' when {_MS} // 60000 > 0 then {_MS} // 60000 || ' min ' || ({_MS} // 1000) % 60 || ' s' when {_MS} // 1000 > 0 then {_MS} // 1000 || ' s' else {_MS} || ' ms' end",
    lambda: D.text_duration((F.col("o_orderkey") * F.col("o_custkey")).cast("string")),
)
_scalar(
    "human_duration_summary", "orders", "o_orderkey",
    f"case when {_MS} < 1000 then {_MS} || ' ms' when {_MS} // 3600000 > 0 then {_MS} // 3600000 || ' h ' || ({_MS} // 60000) % 60 || ' m ' || ({_MS} // 1000) % 60 || ' s' when {_MS} // 60000 > 0 then {_MS} // 60000 || ' m ' || ({_MS} // 1000) % 60 || ' s' else {_MS} // 1000 || ' s' end",
    lambda: D.summary_duration(F.col("o_orderkey") * F.col("o_custkey")),
)
_BPS = "(l_partkey * l_suppkey * 37)"


@_query(f"""
select b as bps, case when b / 1000.0 >= 1000 then {_THREE.format('(b / 1000.0::double / 1000.0::double)')} || ' Mb/s' else {_THREE.format('(b / 1000.0::double)')} || ' kb/s' end as text,
  case when b >= 1000000 then printf('%.2f', b / 1e6::double) || ' Mb/s' when b >= 1000 then printf('%.2f', b / 1e3::double) || ' kb/s' else b || ' b/s' end as summary
from (select distinct {_BPS} as b from lineitem)""")
def human_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * F.col("l_suppkey") * 37).alias("bps")).distinct()
    return rates.select("bps", D.text_bitrate(F.col("bps")).alias("text"), D.summary_bitrate(F.col("bps")).alias("summary"))


_scalar("thousands_space", "orders", "o_orderkey", "trim(reverse(regexp_replace(reverse((o_orderkey * 1009)::varchar), '(...)', '\\1 ', 'g')))", lambda: D.thousands((F.col("o_orderkey") * 1009).cast("string")))
_ASPECTS = "case v when '1.778' then '16:9' when '1.333' then '4:3' when '1.600' then '16:10' when '2.350' then '2.35:1' when '2.400' then '2.40:1' when '1.850' then '1.85:1' when '0.562' then '9:16' when '0.750' then '3:4' else v end"


@_query(f"select p_partkey as key, {_ASPECTS} as value from (select p_partkey, printf('%.3f', (p_size * 16)::double / (p_partkey % 40 + 1)) as v from part)")
def display_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.fixed((F.col("p_size") * 16).cast("double") / (F.col("p_partkey") % 40 + 1), 3)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), D.display_aspect(raw).alias("value"))


_scalar("language_name", "documents", "doc_id", "case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' else lang end", lambda: D.language_name(F.col("lang")))
_scalar("unix_to_civil", "events", "event_id", "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' UTC'", lambda: D.utc_text(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)))
_scalar("mp4_epoch", "orders", "o_orderkey", "strftime(make_timestamp((o_orderkey * 86399 + 1000)::bigint * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC'", lambda: D.mp4_date(F.col("o_orderkey") * 86399 + 1000 + 2082844800))
_scalar(
    "smpte_to_ms", "lineitem", "l_orderkey", "((l_linenumber * 3600 + (l_orderkey % 60) * 60 + l_partkey % 60) * 25 + l_suppkey % 25) * 1000 // 25",
    lambda: D.timecode_ms(F.format_string("%02d:%02d:%02d:%02d", "l_linenumber", F.col("l_orderkey") % 60, F.col("l_partkey") % 60, F.col("l_suppkey") % 25), F.lit(25)),
)
_LEVELS = " ".join(f"when p <= {a} and p * 30 <= {b} then '{n}'" for n, a, b in D.AV1_LEVELS)


@_query(f"""
select key, case {_LEVELS} end as value from (
  select p_partkey as key, (ceil(s / 16.0) * 16) * (ceil(ceil(s * 9 / 16.0) / 16.0) * 16) as p from (select p_partkey, greatest(p_size * 80, p_partkey % 3000) as s from part))""")
def av1_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), D.av1_level(F.col("p_size") * 80, F.col("p_partkey") % 3000, F.lit(30)).alias("value"))


@_query("""
select p_partkey as key, case when p_size > 0 then printf('%.3f', p_retailprice * 1000 / ((16 + p_size) * (16 + p_partkey % 1000) * 25.0)) end as value from part""")
def bits_pixel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.col("p_size") + 16, F.col("p_partkey") % 1000 + 16
    value = D.bits_pixel_frame(width.cast("double"), height.cast("double"), F.lit(25.0), F.col("p_retailprice") * 1000)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 0, value).alias("value"))


@_query(f"""
select ch, hz, n, printf('%.3f', (((ch * hz * 16 * ((n * 1000 + hz // 2) // hz) * 1000) // 8) // 1000)::double / (n * ch * 2)) as value
from (select distinct * from ({_WAV})) where n > 0 and (n * 1000 + hz // 2) // hz > 0""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*[F.lit(r) for r in blobs.RATES]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2 + 1).alias("ch"), rate.alias("hz"), F.col("l_quantity").cast("long").alias("n")).distinct()
    ms = D.duration_ms(F.col("n"), F.col("hz"))
    value = D.compression_ratio(F.lit(True), F.col("n") * F.col("ch") * 2, ms.cast("double"), F.col("ch").cast("long"), F.lit(16).cast("long"), F.col("hz").cast("long"), F.lit(None).cast("long"))
    return rows.select("ch", "hz", "n", value.alias("value")).where("value is not null")


@_query("""
select r_regionkey as key, ['mp42', 'matroska', 'WAVE', 'qt  ', 'nope'][r_regionkey % 5 + 1] as code, ['video/mp4', 'video/x-matroska', 'audio/wav', 'video/quicktime', null][r_regionkey % 5 + 1] as mime,
  ['Encoded_Application', 'InternetMediaType', 'SamplingRate', 'CodecID', 'Width'][r_regionkey % 5 + 1] as field from region""")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("r_regionkey") % 5 + 1)
    code = pick(("mp42", "matroska", "WAVE", "qt  ", "nope"))
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), code.alias("code"), D.container_mime(code).alias("mime"), D.field_alias(pick(("WritingApplication", "MimeType", "SampleRate", "Codec", "Width"))).alias("field"))


@_query("select n_nationkey as key, case when n_nationkey <= 12 then n_nationkey end as kind_id from nation")
def kind_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.model import KINDS

    name = F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("n_nationkey") + 1), F.lit("none"))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), kind_id(name).alias("kind_id"))


@_query("""
select doc_id as path, line, n from (
  select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id % 2 = 0) group by all
  except select doc_id - 1, line, count(*) from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id % 2 = 1) group by all)""")
def line_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document with an even id that the next one lacks, as often."""
    docs = _table(spark, sf_dir, "documents")
    odd = docs.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)
    return diffing.line_differences(*[d.select(F.col("doc_id").alias("path"), "text") for d in (docs.where("doc_id % 2 = 0"), odd)])


@_query("""
select a.user_id as path, count(*) as total, count(b.event_type) as matched, round(100.0 * count(b.event_type) / count(*), 1) as pct
from (select distinct user_id, event_type from events where event_id % 2 = 0) a left join (select distinct user_id, event_type from events where event_id % 2 = 1) b using (user_id, event_type) group by all""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _writes(spark, sf_dir)
    return diffing.name_coverage(writes.where("ord % 2 = 0"), writes.where("ord % 2 = 1"))


@_query("""
select a.p_partkey || '.mkv' as path, count(b.p_partkey) as sidecars, coalesce(sum(16 + b.p_size), 0)::bigint as bytes
from (select * from part where p_partkey % 2 = 0) a left join (select * from part where p_partkey % 2 = 1) b on a.p_partkey // 8 = b.p_partkey // 8 group by all""")
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their companions: equal folder and stem, another extension. Even keys are films, odd ones companions, eight
    keys share a stem; a folder holds a thousand keys."""
    key = F.col("p_partkey")
    place = [F.floor(key / 1000).cast("string").alias("folder"), F.floor(key / 8).cast("string").alias("stem")]
    part = _table(spark, sf_dir, "part")
    files = part.where(key % 2 == 0).select(F.concat(key, F.lit(".mkv")).alias("path"), *place)
    others = part.where(key % 2 == 1).select(F.concat(key, F.lit(".srt")).alias("sidecar"), *place, (F.col("p_size") + 16).cast("long").alias("length"))
    joined = media.with_sidecars(files, others)
    return joined.groupBy("path").agg(F.count("sidecar").alias("sidecars"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@_query("""
select c_custkey as key, case c_custkey % 4 when 0 then 'HTTP' when 1 then 'MMS' when 2 then 'Directory' else 'File' end as reader from customer""")
def reader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    path = F.when(key % 4 == 0, F.concat(F.lit("https://h/"), key)).when(key % 4 == 1, F.concat(F.lit("mms://h/"), key)).when(key % 4 == 2, F.concat(F.lit("/d/"), key, F.lit("/"))).otherwise(F.concat(F.lit("/d/"), key))
    return _table(spark, sf_dir, "customer").select(key.alias("key"), media.reader_label(path).alias("reader"))


@_query("""
select path, string_agg(name || '=' || value, ';' order by ord) as fields from (
  select user_id as path, event_type as name, printf('%.1f', arg_min(value, event_id)) as value, min(event_id) as ord from events group by all) group by all""")
def streams_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's fields as a map, read back in the order of writing."""
    writes = _writes(spark, sf_dir).withColumn("value", D.fixed(F.col("value"), 1))
    wide = streams.streams_wide(streams.first_write_wins(writes))
    return wide.select("path", F.array_join(F.transform("field_order", lambda n: F.concat(n, F.lit("="), F.element_at("fields", n))), ";").alias("fields"))


@_query("""
select 'mp4/' || p_partkey as path, p_name as title, 'High' as profile, case when (10 + p_partkey % 42) % 10 = 0 then ((10 + p_partkey % 42) // 10)::varchar else ((10 + p_partkey % 42) // 10) || '.' || ((10 + p_partkey % 42) % 10) end as level,
  16 + 16 * p_size as width, 16 + 16 * (p_partkey % 50) as height, printf('%.3f', floor((16 + 16 * p_size) * 4 / 3.0 + 0.5) / (16 + 16 * (p_partkey % 50))) as aspect, '25.000' as rate, (p_size + 1)::bigint as frames, (p_size + 1) * 40::bigint as duration,
  (p_size + 1) * 100::bigint as stream_size, case when p_partkey % 2 = 0 then 'BT.709' else 'BT.2020' end as primaries, 'en' as language from part""")
def mp4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(blobs.mp4_blobs(_table(spark, sf_dir, "part")))
    names = {"Format_Profile": "string", "Format_Level": "string", "Width": "int", "Height": "int", "DisplayAspectRatio": "string", "FrameRate": "string", "FrameCount": "long", "Duration": "long", "StreamSize": "long", "colour_primaries": "string", "Language": "string"}
    video = typed_streams(rows.select("*", F.element_at(F.filter("fields", lambda r: (r["kind_id"] == 0) & (r["name"] == "Title")), 1)["value"].alias("title")).withColumn("path", F.struct("path", "title")), VIDEO, names)
    new = ("profile", "level", "width", "height", "aspect", "rate", "frames", "duration", "stream_size", "primaries", "language")
    return video.select("path.path", "path.title", *[F.col(a).alias(b) for a, b in zip(names, new)])


@_query("""
select 'mkv/' || p_partkey as path, 100 + p_size as width, (100 + p_partkey % 500)::int as height, '25.000' as rate, (1 + p_partkey % 2)::int as channels, 'VP9' as video, 'Opus' as audio, 'de' as language from part""")
def mkv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(blobs.mkv_blobs(_table(spark, sf_dir, "part")))
    of = lambda kind, name: F.get(F.filter("fields", lambda r: (r["kind_id"] == kind) & (r["name"] == name)), F.lit(0))["value"]
    whole = {"width": of(VIDEO, "Width"), "height": of(VIDEO, "Height"), "channels": of(AUDIO, "Channels")}
    text = {"rate": of(VIDEO, "FrameRate"), "video": of(VIDEO, "Format"), "audio": of(AUDIO, "Format"), "language": of(AUDIO, "Language")}
    return rows.select("path", *[c.cast("int").alias(n) for n, c in whole.items()], *[c.alias(n) for n, c in text.items()])


@_query("""
select hz::varchar as sampling_rate, (1 + o_orderkey % 8)::varchar as channels, count(*) as files, min((n * 1000 + hz // 2) // hz)::bigint as duration_min, max((n * 1000 + hz // 2) // hz)::bigint as duration_max, sum(n)::bigint as samples
from (select *, case o_orderkey % 3 when 0 then 8000 when 1 then 44100 else 48000 end as hz, o_custkey * 1000 + 1000 as n from orders) group by all""")
def flac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = typed_streams(parsed(blobs.flac_blobs(_table(spark, sf_dir, "orders"))), AUDIO, {"SamplingRate": "string", "Channels": "string", "Duration": "long", "SamplingCount": "long"})
    sums = [F.count("*").alias("files"), F.min("Duration").alias("duration_min"), F.max("Duration").alias("duration_max"), F.sum("SamplingCount").alias("samples")]
    return view.groupBy(F.col("SamplingRate").alias("sampling_rate"), F.col("Channels").alias("channels")).agg(*sums)


@_query("""
select 'mp3/' || p_partkey as path, [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][(p_partkey % 14 + 1)::int] * 1000 as bit_rate, 1 + p_size % 5 as frames, (((1 + p_size % 5) * 1152 * 1000 + 22050) // 44100)::int as duration from part""")
def mp3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = typed_streams(parsed(blobs.mp3_blobs(_table(spark, sf_dir, "part"))), AUDIO, {"BitRate": "int", "FrameCount": "int", "Duration": "int"})
    return view.select("path", F.col("BitRate").alias("bit_rate"), F.col("FrameCount").alias("frames"), F.col("Duration").alias("duration"))


@_query("select 'jpeg/' || p_partkey as path, p_brand as make, 16 + p_size as width, (16 + p_partkey % 1000)::int as height, '4:2:0' as sampling from part")
def jpeg_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(blobs.jpeg_blobs(_table(spark, sf_dir, "part")))
    of = lambda kind, name: F.get(F.filter("fields", lambda r: (r["kind_id"] == kind) & (r["name"] == name)), F.lit(0))["value"]
    return rows.select("path", of(KINDS.index("Exif"), "Make").alias("make"), of(IMAGE, "Width").cast("int").alias("width"), of(IMAGE, "Height").cast("int").alias("height"), of(IMAGE, "ChromaSubsampling").alias("sampling"))


@_query("""
select 'wav/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || n as path, (44 + n * ch * 2)::bigint as size, ms::bigint as duration, case when ms > 0 then round((44 + n * ch * 2) * 8.0 * 1000.0 / ms)::bigint end as rate,
  case when ms > 0 then 'CBR' end as mode, 44::bigint as stream_size from (select *, (n * 1000 + hz // 2) // hz as ms from
  (select *, 1 + l_linenumber % 2 as ch, case l_orderkey % 3 when 0 then 8000 when 1 then 44100 else 48000 end as hz, l_quantity::bigint as n from lineitem))""")
def file_level_of_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file as a whole has, computed on parsed blobs."""
    rows = with_file_level(parsed(blobs.wav_blobs(_table(spark, sf_dir, "lineitem")), keep_length=True))
    view = typed_streams(rows, 0, {"FileSize": "long", "Duration": "long", "OverallBitRate": "long", "OverallBitRate_Mode": "string", "StreamSize": "long"})
    return view.select("path", F.col("FileSize").alias("size"), F.col("Duration").alias("duration"), F.col("OverallBitRate").alias("rate"), F.col("OverallBitRate_Mode").alias("mode"), F.col("StreamSize").alias("stream_size"))


@_query("""
select p_partkey as key, near, printf('%.1f', scale) as "ScaleFactor35efl", printf('%.3f mm', sqrt(1872.0) / (scale * 1440)) as "CircleOfConfusion", printf('%.1f deg', degrees(2 * atan(36.0 / (2 * near * scale)))) as "FieldOfView",
  printf('%.2f m', near * near / (4 * (sqrt(1872.0) / (scale * 1440)) * 1000)) as "HyperfocalDistance", printf('%.1f', log2(16.0 * 128) - log2(200 / 100.0)) as "LightValue"
from (select p_partkey, 4.25 + p_size % 13 as near, (20.1 + p_partkey % 180) / (4.25 + p_size % 13) as scale from part)""")
def composite_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that follow from Exif."""
    near, film = F.lit(4.25) + F.col("p_size") % 13, F.lit(20.1) + F.col("p_partkey") % 180
    fixed = {"FNumber": F.lit(4.0), "ExposureTime": F.lit(1 / 128), "PhotographicSensitivity": F.lit(200)}
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), near.alias("FocalLength"), film.alias("FocalLengthIn35mmFilm"), *[v.alias(n) for n, v in fixed.items()])
    return derived.composite(rows).select("key", F.col("FocalLength").alias("near"), "ScaleFactor35efl", "CircleOfConfusion", "FieldOfView", "HyperfocalDistance", "LightValue")


_PLANTED = list(planted.PLANTED.items())


def _names(k: int) -> str:
    return "[" + ", ".join("null" if row[k] is None else f"'{row[k]}'" for _, row in _PLANTED) + "]"


@_query(f"select {_names(1)}[p_partkey % {len(_PLANTED)} + 1] as compat, {_names(2)}[p_partkey % {len(_PLANTED)} + 1] as sane, count(*) as blobs from part group by all")
def detect_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted blob of every format, by both policies."""
    files = blobs.planted_blobs(_table(spark, sf_dir, "part"), [row[0] for _, row in _PLANTED])
    both = detected(files).select("path", F.col("parser").alias("compat")).join(detected(files, "sane").select("path", F.col("parser").alias("sane")), "path")
    return both.groupBy("compat", "sane").agg(F.count("*").alias("blobs"))


@_query(f"select {_names(1)}[p_partkey % {len(_PLANTED)} + 1] as parser, count(*) as files, count(*) as with_fields, 0::bigint as errors from part where {_names(1)}[p_partkey % {len(_PLANTED)} + 1] is not null group by all")
def parse_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format gives fields, Format among them."""
    files = blobs.planted_blobs(_table(spark, sf_dir, "part"), [row[0] for _, row in _PLANTED])
    told = F.exists("fields", lambda r: r["name"] == "Format")
    return parsed(files).groupBy("parser").agg(F.count("*").alias("files"), F.count_if(told).alias("with_fields"), F.count_if(F.col("error").isNotNull()).alias("errors"))


# ---- exporters: the documents of WAV files, put together in SQL from the same columns

_EXPORTED = """select concat_ws('/', 'wav', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint) as path, ch, hz, n, ch * 2 * n as size, ch * 16 * hz as bps, (n * 1000 + hz // 2) // hz as ms from
  (select *, 1 + l_linenumber % 2 as ch, case l_orderkey % 3 when 0 then 8000 when 1 then 44100 else 48000 end as hz, l_quantity::bigint as n from lineitem)"""
_GENERAL = (("Format", "'Wave'"), ("InternetMediaType", "'audio/wav'"), ("Format_Settings", "'PcmWaveformat'"), ("AudioCount", "'1'"))
_AUDIO = (
    ("Format", "'PCM'"), ("Format_Settings_Endianness", "'Little'"), ("Format_Settings_Sign", "'Signed'"), ("CodecID", "'1'"), ("BitRate_Mode", "'CBR'"), ("BitRate", "bps"), ("Channels", "ch"), ("SamplingRate", "hz"), ("BitDepth", "'16'"),
    ("StreamSize", "size"), ("SamplingCount", "n"), ("Duration", "ms"),
)


def _by_order(rows: tuple, kind: str) -> list[tuple[str, str]]:
    """Fields in the canonical order, durations in seconds."""
    values = dict(rows) | ({"Duration": "printf('%d.%03d', ms // 1000, ms % 1000)"} if kind == "Audio" else {})
    return [(n, values[n]) for n in orders.CANONICAL[kind] if n in values]


def _sql(*parts: str | tuple[str, ...]) -> str:
    """SQL that joins literal texts (str) and expressions (one-tuples)."""
    quoted = [f"'{p.replace(chr(39), chr(39) * 2)}'" if isinstance(p, str) else f"({p[0]})::varchar" for p in parts]
    return " || ".join(q.replace("\n", "' || chr(10) || '") for q in quoted)


def _tagged(prefix: str, rows, name=lambda n: n) -> list:
    return [x for n, v in rows for x in (f"<{prefix}{name(n)}>", (v,), f"</{prefix}{name(n)}>\n")]


_XML, _PATH = '<?xml version="1.0" encoding="UTF-8"?>\n', ("path",)
_SPACE = "https://mediaarea.net/mediainfo"
_plain = lambda n: n.replace("_", "").lower()
_cell = lambda rows: [x for k, (_, v) in enumerate(rows) for x in ([","] if k else []) + [(v,)]]
_pairs = lambda rows: [x for n, v in rows for x in (",\n" if n != rows[0][0] else "", f'"{n}":"', (v,), '"')]
_label = lambda name: f"{name:<41}: "
_DOCUMENTS = {
    "json": ['{\n"media":{"@ref":"', _PATH, '","track":[{"@type":"General",', *_pairs(_by_order(_GENERAL, "General")), '},{"@type":"Audio",', *_pairs(_by_order(_AUDIO, "Audio")), "}]}\n}\n"],
    "xml": [
        _XML + f'<MediaInfo\n    xmlns="{_SPACE}"\n    xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"\n    xsi:schemaLocation="{_SPACE} {_SPACE}/mediainfo_2_0.xsd"\n    version="2.0">\n<media ref="', _PATH, '">\n',
        '<track type="General">\n', *_tagged("", _by_order(_GENERAL, "General")), '</track>\n<track type="Audio">\n', *_tagged("", _by_order(_AUDIO, "Audio")), "</track>\n</media>\n</MediaInfo>\n\n",
    ],
    "csv": ["# ", _PATH, "\n# General\nStreamIndex," + ",".join(n for n, _ in _GENERAL) + "\n0,", *_cell(_GENERAL), "\n\n# Audio\nStreamIndex," + ",".join(n for n, _ in _AUDIO) + "\n0,", *_cell(_AUDIO), "\n\n"],
    "text": [
        "General\n" + _label("Complete name"), _PATH, "\n" + _label("Format") + "Wave\n\nAudio\n" + _label("Format") + "PCM\n" + _label("Codec ID") + "1\n" + _label("Duration"), ("ms",), " ms\n" + _label("Bit rate mode") + "Constant\n" + _label("Bit rate"),
        ("case when bps >= 1000000 then printf('%.2f Mb/s', bps / 1000000.0) else printf('%.0f kb/s', bps / 1000.0) end",), "\n" + _label("Channel(s)"), ("case when ch = 1 then '1 channel' else ch || ' channels' end",), "\n" + _label("Sampling rate"),
        ("printf('%.1f kHz', hz / 1000.0)",), "\n" + _label("Bit depth") + "16 bits\n" + _label("Stream size"), ("size",), " Bytes\n",
    ],
    "summary": ["File: ", _PATH, "\nContainer: Wave\n\nStreams: 0 video, 1 audio, 0 text, 0 image\n\nAudio\n-----\nCodec(s): PCM\nChannels: ", ("ch",), "\nSampling rate(s): ", ("hz",), " Hz\nBit depth(s): 16\n\n"],
    "ebucore": [
        _XML + '<ebucore:ebuCoreMain xmlns:ebucore="urn:ebu:metadata-schema:ebuCore_2015">\n<ebucore:coreMetadata>\n<ebucore:identifier>', _PATH, '</ebucore:identifier>\n<ebucore:format type="General">\n', *_tagged("ebucore:", _GENERAL, _plain),
        '</ebucore:format>\n<ebucore:format type="Audio">\n', *_tagged("ebucore:", _AUDIO, _plain), "</ebucore:format>\n</ebucore:coreMetadata>\n</ebucore:ebuCoreMain>\n",
    ],
    "mpeg7": [_XML + '<Mpeg7 xmlns="urn:mpeg:mpeg7:schema:2004">\n<MediaInformation><MediaLocator>', _PATH, "</MediaLocator>\n<General>\n", *_tagged("", _GENERAL), "</General>\n<Audio>\n", *_tagged("", _AUDIO), "</Audio>\n</MediaInformation></Mpeg7>\n"],
    "pbcore": [
        _XML + '<pbcoreDescriptionDocument xmlns="http://www.pbcore.org/PBCore/PBCoreNamespace.html">\n<pbcoreIdentifier source="framelake">', _PATH, '</pbcoreIdentifier>\n<pbcoreInstantiation>\n<pbcoreFormatID source="General"/>\n',
        *_tagged("pbcore", _GENERAL), '</pbcoreInstantiation>\n<pbcoreInstantiation>\n<pbcoreFormatID source="Audio"/>\n', *_tagged("pbcore", _AUDIO), "</pbcoreInstantiation>\n</pbcoreDescriptionDocument>\n",
    ],
    "niso": [
        _XML + '<niso:metadata xmlns:niso="http://www.niso.org/schemas/z39.87/metadata">\n<niso:identifier>', _PATH, '</niso:identifier>\n<niso:stream type="General">\n', *_tagged("niso:", _GENERAL),
        '</niso:stream>\n<niso:stream type="Audio">\n', *_tagged("niso:", _AUDIO), "</niso:stream>\n</niso:metadata>\n",
    ],
    "fims": [
        _XML + '<fims:media xmlns:fims="http://www.fims.tv/schemas/2013" version="1.0">\n<fims:location>', _PATH, '</fims:location>\n<fims:format type="General">\n', *_tagged("fims:", _GENERAL),
        '</fims:format>\n<fims:format type="Audio">\n', *_tagged("fims:", _AUDIO), "</fims:format>\n</fims:media>\n",
    ],
    "graph": ['digraph media {\n  "General" [shape=box];\n' + "".join(f'  "{n}";\n' for n, _ in _GENERAL) + '  "Audio" [shape=box];\n' + "".join(f'  "{n}";\n' for n, _ in _AUDIO) + "}\n"],
    "revtmd": [_XML + "<REVTMD>\n<Source>", _PATH, "</Source>\n", *_tagged("", _GENERAL), *_tagged("", _AUDIO), "</REVTMD>\n"],
}


def _export(name: str, make: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        from framelake.sinks import exporters

        return exporters.export(parsed(blobs.wav_blobs(_table(spark, sf_dir, "lineitem")), keep_pcm=True), make)

    f.__name__ = name
    _query(f"select path, {_sql(*_DOCUMENTS[make])} as document from ({_EXPORTED})")(f)


for _form in ("json", "xml", "csv", "text", "summary", "ebucore", "mpeg7", "pbcore", "niso", "fims", "graph", "revtmd"):
    _export(f"export_{_form}", _form)
