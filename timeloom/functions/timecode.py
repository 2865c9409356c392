"""Times: integer milliseconds of a movie clock, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a time is written in a text.
TIME_RE = r"\b(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)\b"


def parse_time(text: Column) -> Column:
    """'1:42:50', '1:42', '95.5' -> ms, truncated; null for blanks and anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)  # a null part makes the whole null
    return F.when(F.trim(text) != "", (seconds * 1000).try_cast("bigint"))


def fmt(ms: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; negative times as 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    h, m, x = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, x)).otherwise(F.format_string("%d:%02d", m, x))


def fmt_hours(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def fmt_minutes(ms: Column) -> Column:
    """m:ss with minutes that aren't wrapped at an hour."""
    return F.format_string("%d:%02d", F.floor(ms / 60000), F.floor(ms % 60000 / 1000))


def span(start: Column, end: Column) -> Column:
    return F.concat(fmt(start), F.lit("-"), fmt(end))


def find_times(text: Column) -> Column:
    """All times written in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TIME_RE), F.lit(1)), parse_time), lambda t: t.isNotNull())


def keyframe_times(start: Column, end: Column, every: int = 8_000, most: int = 6) -> Column:
    """Centres of equal slices of [start, end), one for each started `every`, at most `most`."""
    d = end - start
    n = F.least(F.greatest(F.ceil(d / every), F.lit(1)), F.lit(most)).cast("int")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (d * (i + F.lit(0.5)) / n).cast("bigint"))
    return F.when(d > 0, times).otherwise(F.array().cast("array<bigint>"))


def frame_name(ms: Column) -> Column:
    return F.format_string("%09d.jpg", ms)


def midpoint(start: Column, end: Column) -> Column:
    """Half of the sum, rounded down, in integers throughout."""
    return F.shiftright((start + end).cast("bigint"), 1)


def parse_time_strict(text: Column) -> Column:
    """parse_time that fails on anything it can't read."""
    t = parse_time(text)
    return F.when(t.isNull(), F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(text, F.lit("null")))).cast("bigint")).otherwise(t)


def parse_time_rounded(text: Column) -> Column:
    """As a player's address bar has it: rounded to the nearest ms instead of truncated."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(F.trim(text) != "", F.floor(seconds * 1000 + 0.5).try_cast("bigint"))


#: Fixed value: how a moment or span is written in brackets.
TAG_RE = r"\[(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[-\x{2013}]\s*\d{1,2}:\d{2}(?::\d{2})?)?)\]"


def time_tags(text: Column) -> Column:
    """Times in brackets, [a] or [a-b]: array of struct(start_ms, end_ms), end null for one time."""
    both = F.transform(F.regexp_extract_all(text, F.lit(TAG_RE), F.lit(1)), lambda x: F.split(x, r"\s*[-\x{2013}]\s*"))
    return F.transform(both, lambda x: F.struct(parse_time_rounded(F.get(x, F.lit(0))).alias("start_ms"), parse_time_rounded(F.get(x, F.lit(1))).alias("end_ms")))


def progress_fraction(out_time_us: Column, duration_ms: Column) -> Column:
    """Share of a job done by its clock in microseconds: 1 at most, null without a duration."""
    return F.when(duration_ms > 0, F.least(out_time_us / 1000 / duration_ms, F.lit(1.0)))


def utc_text(ts: Column) -> Column:
    """A timestamp as ISO-8601 text of whole seconds; for sessions in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
