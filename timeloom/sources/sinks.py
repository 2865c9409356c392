"""Writers: artifact tables by video with dynamic overwrite (the commit is the rename), append-only run state, event streams."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.schemas import schema
from timeloom.sources import generations


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace the partitions of the videos in df; others stay. A table in generations gets one more."""
    if number := generations.head(df.sparkSession, root, name):
        generations.commit(df.sparkSession, root, name, {"rows": df}, df.select("video_id"), number)
        return
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{root}/{name}")


def append_run(spark: SparkSession, root: str, video_ids: list[str], stage: str, status: str, seconds: float | None = None, error: str | None = None, fingerprint: str | dict[str, str] | None = None) -> None:
    """One row a video and change of state, one file a call; nothing is read, so concurrent writers lose nothing. fingerprint: one for all, or by video."""
    of = fingerprint if isinstance(fingerprint, dict) else dict.fromkeys(video_ids, fingerprint)
    rows = [(v, stage, status, None, seconds, error, of.get(v)) for v in video_ids]
    d = spark.createDataFrame(rows, schema("stage_runs")).withColumn("updated_at", F.current_timestamp())
    d.coalesce(1).write.mode("append").parquet(f"{root}/stage_runs")


def append_job(spark: SparkSession, root: str, video_id: str, status: str, error: str | None = None) -> None:
    """A change of a job's state: queued, running, done or failed."""
    d = spark.createDataFrame([(video_id, status, error, None)], schema("jobs")).withColumn("updated_at", F.current_timestamp())
    d.coalesce(1).write.mode("append").parquet(f"{root}/jobs")


def compact_runs(spark: SparkSession, root: str, older_than: float = 0.0) -> int:
    """Merge the many small files of run states (of at least so many seconds' age) to the present states, in Spark; returns how many files went.

    The files that are there at the beginning are read and, once their present states are written beside them, deleted one by one: a row
    appended meanwhile is in none of them and stays. A state that is there twice, after a crash before the last deletion, counts once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/stage_runs")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    born = lambda f: f.getModificationTime() / 1000 <= time.time() - older_than
    files = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-") and born(f)]
    if len(files) < 2:
        return 0
    now = latest_runs(spark.read.schema(schema("stage_runs")).parquet(*[f.toString() for f in files])).select(schema("stage_runs").names)
    now.write.mode("append").parquet(f"{root}/stage_runs")
    for f in files:
        fs.delete(f, False)
    return len(files)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Present state of each video and stage."""
    return runs.groupBy("video_id", "stage").agg(F.max_by(F.struct("status", "seconds", "error", "fingerprint", "updated_at"), F.struct("updated_at", "status")).alias("x")).select("video_id", "stage", "x.*")


def stale_files(existing: DataFrame, keep: DataFrame) -> DataFrame:
    """Files of the engine that no keyframe names any more."""
    return existing.join(keep.select("file"), "file", "left_anti")


def sse(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def parse_sse(text: Column) -> Column:
    """Events of a stream's text: array of struct(event, data)."""
    blocks = F.filter(F.split(text, r"\n\n"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: ?(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all(b, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n").alias("data")))
