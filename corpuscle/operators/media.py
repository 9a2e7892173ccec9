"""Kinds of uploads, backends, and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import suffix

# The extensions that count as audio and as images.
AUDIO = ["wav", "mp3", "m4a", "flac", "ogg", "aac", "wma", "webm", "mp4"]
IMAGE = ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "pbm", "ppm"]


def sniff_kind(name: Column) -> Column:
    """`audio`, `image` or the empty string, by the file name's last extension."""
    ext = suffix(name)
    return F.when(ext.isin(AUDIO), "audio").when(ext.isin(IMAGE), "image").otherwise("")


def resolve_kind(mode: Column, name: Column, mime: Column) -> Column:
    """The mode if it is a kind, else what the name tells, else the MIME type's prefix, else null (refused)."""
    by_mime = F.when(F.startswith(mime, F.lit("audio/")), "audio").when(F.startswith(mime, F.lit("image/")), "image")
    return F.coalesce(F.when(F.lower(mode).isin("audio", "image"), F.lower(mode)), F.nullif(sniff_kind(name), F.lit("")), by_mime)


def backend(wanted: Column, default: str, known: list[str]) -> Column:
    """The backend in lower case, or the default; null if it is not known."""
    name = F.lower(F.coalesce(F.nullif(wanted, F.lit("")), F.lit(default)))
    return F.when(name.isin(known), name)


def language(code: Column) -> Column:
    """Null for a missing, empty or `auto` language."""
    return F.nullif(F.nullif(code, F.lit("")), F.lit("auto"))


def aligner_language(code: Column) -> Column:
    """The aligner's tag of a language; Vietnamese where it has none."""
    return F.when(code == "en", "eng").when(code == "zh", "cmn").otherwise("vie")


def merge_meta(own: Column, of_backend: Column) -> Column:
    """Two string maps in one; the backend's entries win."""
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(of_backend), k))
    return F.map_concat(kept, of_backend)


def speaker_valid(frames: Column, rate: Column, channels: Column) -> Column:
    """A sample of 2 to 10 seconds in one channel."""
    seconds = frames / F.nullif(rate, F.lit(0))
    return F.coalesce((seconds >= 2) & (seconds <= 10) & (channels == 1), F.lit(False))


def expired(ts: Column, now: Column, days: int = 7) -> Column:
    """Whether more than `days` whole days have passed."""
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000) > days


def latest(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row for each key: the values of its last row in order (a dictionary that later entries replace)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_v")).select(key, *(F.col(f"_v.{v}").alias(v) for v in values))


def first_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key in order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n).drop("_n")
