"""Fields derived from others, on one row a file or one row a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import display as D


def file_level(files: DataFrame) -> DataFrame:
    """From one row a file with path, file_size, general_duration, audio_duration, audio_size, audio_mode, video_size,
    video_rate_mode, has_video, video_rate, video_frames: what the container as a whole has."""
    whole = lambda c: F.col(c).try_cast("long")
    ms = F.coalesce(whole("general_duration"), whole("audio_duration"))
    overall = F.when(ms > 0, F.round(F.col("file_size") * 8.0 * 1000.0 / ms).cast("long"))
    mode = F.when(~F.col("has_video"), F.col("audio_mode")).when(F.col("video_rate_mode") == "VFR", "VBR")
    audio, video = whole("audio_size"), F.coalesce(whole("video_size"), F.lit(0))
    inner = F.when(audio.isNotNull(), audio + video).when(video > 0, video)
    return files.select(
        "path", F.col("file_size").alias("FileSize"), ms.alias("Duration"), overall.alias("OverallBitRate"), F.when(overall.isNotNull(), mode).alias("OverallBitRate_Mode"),
        F.when(F.col("has_video"), F.col("video_rate")).alias("FrameRate"), F.when(F.col("has_video"), F.col("video_frames")).alias("FrameCount"),
        F.when(inner < F.col("file_size"), F.col("file_size") - inner).alias("StreamSize"),
    )


def bitrate_ranges(streams: DataFrame) -> DataFrame:
    """From one row a stream with path, BitRate and BitRate_Maximum as text: per file the sum of the maxima and the least
    bit rate; null where there is none."""
    top = F.sum(F.col("BitRate_Maximum").try_cast("long"))
    return streams.groupBy("path").agg(F.when(top > 0, top).alias("OverallBitRate_Maximum"), F.min(F.col("BitRate").try_cast("long")).alias("OverallBitRate_Minimum"))


def composite(exif: DataFrame) -> DataFrame:
    """From a typed view of Exif with FocalLength, FocalLengthIn35mmFilm, FNumber, ExposureTime and PhotographicSensitivity as
    numbers: what follows from them, as text; null where something is missing. Other columns stay."""
    near, film, stop, time, speed = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("FocalLength", "FocalLengthIn35mmFilm", "FNumber", "ExposureTime", "PhotographicSensitivity"))
    scale = film / near
    circle = F.sqrt(F.lit(24.0 * 24 + 36 * 36)) / (scale * 1440)
    angle = F.degrees(2 * F.atan(F.lit(36.0) / (2 * near * scale)))
    return exif.withColumns({
        "ScaleFactor35efl": D.fixed(scale, 1), "CircleOfConfusion": F.concat(D.fixed(circle, 3), F.lit(" mm")), "FieldOfView": F.concat(D.fixed(angle, 1), F.lit(" deg")),
        "HyperfocalDistance": F.concat(D.fixed(near * near / (stop * circle * 1000), 2), F.lit(" m")), "LightValue": D.fixed(F.log2(stop * stop / time) - F.log2(speed / 100), 1),
    })


def lowest_bitrate(rate: Column) -> Column:
    """BitRate_Minimum where a stream has none: half its rate."""
    return F.call_function("div", rate.try_cast("long"), F.lit(2))


def format_profile(format_: Column, codec: Column) -> Column:
    return F.when(format_ == "MPEG-4", D.lookup(codec, {"mp42": "Base Media / Version 2", "isom": "Base Media / Version 1", "avc1": "Base Media"}))


def inferred_av1_level(profile: Column, width: Column, height: Column, rate: Column) -> Column:
    """The level that an AV1 picture needs, where its profile names another one (``@L`` and an index)."""
    names = F.array(*[F.lit(n) for n, _, _ in D.AV1_LEVELS])
    told = F.regexp_extract(profile, r"@L(\d+)", 1).try_cast("int")
    need = D.av1_level(width, height, rate)
    return F.when(told.isNotNull() & (F.array_position(names, need) - 1 != told), need)
