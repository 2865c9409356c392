"""SRT subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The time line of the format (its point may be a comma), and marks inside a text that aren't shown.
_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
_MARKS = r"<[^>]+>|\{[^}]+\}"


def parse_srt(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """keep, start_ms, end_ms, text, source, reliable: one row a block with a time line and a body; digits after the comma are ms."""
    block = F.explode(F.split(F.replace(F.col(content), F.lit("\r"), F.lit("")), r"\n\s*\n"))
    d = files.select(*keep, block.alias("__b"))
    lines = F.filter(F.transform(F.split("__b", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select(*keep, lines.alias("__l"))
    at = F.coalesce(F.array_position(F.transform("__l", lambda x: x.rlike(_TIME)), True), F.lit(0)).cast("int")
    d = d.select(*keep, "__l", at.alias("__at")).filter("__at > 0")
    part = lambda k: F.regexp_extract(F.element_at("__l", F.col("__at")), _TIME, k).cast("bigint")
    time = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    body = F.trim(F.regexp_replace(F.array_join(F.slice("__l", F.col("__at") + 1, F.size("__l")), " "), _MARKS, ""))
    return d.select(*keep, time(1).alias("start_ms"), time(5).alias("end_ms"), body.alias("text"), F.lit("srt").alias("source"), F.lit(True).alias("reliable")).filter("text <> ''")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("file"))
    return parse_srt(files, "content", ["file"])
