"""Streams: a queue of jobs from files, landed media, replies of models, windows of chunks; `live` has the streams with state of their own.

Sessions and windows with watermarks are additions of this engine; their batch twins are in operators.folds and here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from timeloom.functions.text import valid_file
from timeloom.streaming.scanner import AnswerText

JOB = "video_id STRING, queued_at TIMESTAMP"


def job_queue(spark: SparkSession, landing: str, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """JSON job files in the order they land; restarts go on where the checkpoint ends.

    A job that waits twice is worked once: repeats of the same (video, time) are dropped, and of a batch's jobs for a video the first is kept;
    a video queued again later runs again.
    """
    jobs = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 100).json(landing)
    once = jobs.withWatermark("queued_at", "1 day").dropDuplicatesWithinWatermark(["video_id", "queued_at"])

    def first_of_each(batch: DataFrame, n: int) -> None:
        work(batch.groupBy("video_id").agg(F.min("queued_at").alias("queued_at")).orderBy("queued_at", "video_id"), n)

    return once.writeStream.foreachBatch(first_of_each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_sessions(frames: DataFrame, gap: str = "6 seconds", late: str = "1 minute") -> DataFrame:
    """Addition: runs of frames (video_id, ts) no more than the gap apart; the end is the last frame, not the window's."""
    s = frames.withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("video_id", "first", "last", "n")


def padded_windows(rows: DataFrame, size_ms: int, pad_ms: int) -> DataFrame:
    """rows (video_id, ts_ms, ...) once for each chunk whose padded range holds them: core_ms, own (in the core itself). For streams and batches.

    A row is offered to as many cores as a padding reaches.
    """
    if size_ms <= 0 or pad_ms < 0:
        raise ValueError("windows need a size, and padding can't be negative")
    reach = -(-pad_ms // size_ms)
    core = F.floor(F.col("ts_ms") / size_ms)
    d = rows.withColumn("core_ms", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: (core + k) * size_ms)))
    inside = (F.col("ts_ms") >= F.col("core_ms") - pad_ms) & (F.col("ts_ms") < F.col("core_ms") + size_ms + pad_ms)
    return d.filter(inside).withColumn("own", (F.col("ts_ms") >= F.col("core_ms")) & (F.col("ts_ms") < F.col("core_ms") + size_ms))


def progress_lines(text: Column) -> Column:
    """Last clock and state that a running job has written as key=value lines: struct(out_time_us, ended)."""
    last = lambda key: F.element_at(F.regexp_extract_all(text, F.lit(rf"(?m)^{key}=(\S+)$"), F.lit(1)), -1)
    some = lambda key: F.when(text.rlike(rf"(?m)^{key}=\S+$"), last(key))
    return F.struct(some("out_time_us").try_cast("bigint").alias("out_time_us"), F.coalesce(some("progress") == "end", F.lit(False)).alias("ended"))


def answers_so_far(rows: DataFrame, reply: str) -> DataFrame:
    """rows with `answer`: what could be shown of each reply as far as it is written; null for replies that call a tool."""

    def read(text: str | None) -> str | None:
        stream = AnswerText()
        shown = stream.feed(text or "")
        return shown if stream.is_answer else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(answer=[read(t) for t in b[reply]])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())]))


def reply_pieces(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a model server's NDJSON stream as pieces: piece, done, error; lines that aren't JSON are errors."""
    j = F.from_json(line, "response string, done boolean, error string", {"allowUnquotedControlChars": "true"})
    d = lines.filter(F.trim(line) != "").withColumn("j", j)
    bad = F.col("j").isNull() | (F.col("j.response").isNull() & F.col("j.done").isNull() & F.col("j.error").isNull())
    return d.select(*lines.columns, F.coalesce("j.response", F.lit("")).alias("piece"), F.coalesce("j.done", F.lit(False)).alias("done"), F.coalesce("j.error", F.when(bad, F.concat(F.lit("not a reply: "), F.col(line)))).alias("error"))


def landed_media(spark: SparkSession, landing: str, max_bytes: int) -> DataFrame:
    """Stream of files that land: path, name, length, error (too large, or of an ending that isn't taken); contents aren't read, empty files make no row."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(landing).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    error = F.when(F.col("length") > max_bytes, "too large").when(~valid_file(name), "unknown kind of file")
    return files.select("path", name.alias("name"), "length", error.alias("error"))


def save_parts(rows: DataFrame, root: str, name: str, checkpoint: str) -> StreamingQuery:
    """A stage's rows (with video_id) saved batch by batch as they come; a batch that runs again replaces itself."""

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("part", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "video_id").parquet(f"{root}/{name}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_windows(rows: DataFrame, size: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Addition: counts a tumbling window (the cores of chunks)."""
    return rows.withWatermark("ts", late).groupBy("video_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).select("video_id", F.col("w.start").alias("start"), "n")
