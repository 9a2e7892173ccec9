"""Subtitle times, cues and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import strip


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative counts as zero; halves of a millisecond go to the even one, and carry over."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def cue(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n\n"))


def join_stripped(segments: Column) -> Column:
    """Texts of (start, end, text) segments, each stripped, with spaces between; then the whole stripped."""
    return strip(F.array_join(F.transform(segments, lambda s: strip(F.coalesce(s["text"], F.lit("")))), " "))


def join_plain(segments: Column) -> Column:
    """Texts of segments end to end, the whole stripped."""
    return strip(F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), ""))


def join_spaced(segments: Column) -> Column:
    """Texts of segments with spaces between, missing ones empty; the whole stripped."""
    return strip(F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " "))


FRAGMENTS = "struct<fragments:array<struct<begin:string,end:string,lines:array<string>>>>"


def fragments(json: Column) -> Column:
    """(start, end, text) of an alignment's fragments: a time that is missing is 0; if one is no number, both are 0."""

    def one(f: Column) -> Column:
        begin, end = (F.coalesce(f[k], F.lit("0")).try_cast("double") for k in ("begin", "end"))
        bad = begin.isNull() | end.isNull()
        return F.struct(F.when(bad, 0.0).otherwise(begin).alias("start"), F.when(bad, 0.0).otherwise(end).alias("end"), F.coalesce(F.get(f["lines"], F.lit(0)), F.lit("")).alias("text"))

    parsed = F.from_json(json, FRAGMENTS)["fragments"]
    return F.transform(F.coalesce(parsed, F.array().cast("array<struct<begin:string,end:string,lines:array<string>>>")), one)
