"""Readers of artifacts: JSON documents a video, Parquet tables by video, images and media probes. No inference of types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.schemas import schema
from timeloom.sources import generations


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An artifact table; absent means empty, with its schema. Filters on video_id prune partitions."""
    path = f"{root}/{name}"
    kind = schema(name)
    if generations.head(spark, root, name):
        return generations.read(spark, root, name, kind)
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


def read_documents(spark: SparkSession, glob: str, kind: T.StructType) -> DataFrame:
    """Whole-file JSON documents, with the file's name; absent means empty."""
    if not _exists(spark, glob):
        return spark.createDataFrame([], kind).withColumn("file", F.lit(""))
    return spark.read.schema(kind).option("multiLine", True).option("allowUnquotedControlChars", True).json(glob).withColumn("file", F.col("_metadata.file_path"))


def load_segments(spark: SparkSession, glob: str) -> DataFrame:
    """Segments of transcripts, one document a chunk: {chunk_id, video_id, segments: [...]}."""
    inner = T.ArrayType(T.StructType([f for f in schema("segments") if f.name not in ("video_id", "chunk_id")]))
    docs = read_documents(spark, glob, T.StructType().add("video_id", "string").add("chunk_id", "string").add("segments", inner))
    return docs.select("video_id", "chunk_id", F.explode("segments").alias("s")).select("video_id", "chunk_id", "s.*")


def load_shots(spark: SparkSession, glob: str) -> DataFrame:
    inner = T.ArrayType(T.StructType([f for f in schema("raw_shots") if f.name not in ("video_id", "chunk_id")]))
    docs = read_documents(spark, glob, T.StructType().add("video_id", "string").add("chunk_id", "string").add("shots", inner))
    return docs.select("video_id", "chunk_id", F.explode("shots").alias("s")).select("video_id", "chunk_id", "s.*")


def load_captions(spark: SparkSession, glob: str) -> DataFrame:
    inner = T.ArrayType(T.StructType([f for f in schema("captions") if f.name not in ("video_id", "chunk_id")]))
    docs = read_documents(spark, glob, T.StructType().add("video_id", "string").add("chunk_id", "string").add("frames", inner))
    return docs.select("video_id", "chunk_id", F.explode("frames").alias("s")).select("video_id", "chunk_id", "s.*")


def list_videos(table: DataFrame) -> DataFrame:
    return table.select("video_id").distinct().orderBy("video_id")


def keyframes(raw_shots: DataFrame) -> DataFrame:
    return raw_shots.select("video_id", "chunk_id", F.explode("keyframes").alias("k")).select("video_id", "chunk_id", "k.*")


def read_binary(spark: SparkSession, glob: str) -> DataFrame:
    """Images or audio as path and content."""
    return spark.read.format("binaryFile").load(glob).select("path", "content", "length")


def probe_media(probes: DataFrame, column: str = "json") -> DataFrame:
    """Facts about media from the JSON of a media probe: the first video stream that isn't cover art, duration in ms, frame rate."""
    stream = "struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,disposition:struct<attached_pic:int>,tags:struct<language:string>>"
    j = F.from_json(column, f"struct<streams:array<{stream}>,format:struct<duration:string,format_name:string,size:string>>")
    d = probes.withColumn("__j", j)
    video = F.get(F.filter("__j.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    audio = F.filter("__j.streams", lambda s: s["codec_type"] == "audio")
    rate = F.split(video["avg_frame_rate"], "/")
    top, low = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    texts = F.array(*map(F.lit, ("subrip", "ass", "ssa", "mov_text", "webvtt", "text")))
    subs = F.transform(F.filter("__j.streams", lambda s: s["codec_type"] == "subtitle"), lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["tags"]["language"].alias("language"), F.array_contains(texts, s["codec_name"]).alias("is_text")))
    return d.select(
        "video_id", (F.col("__j.format.duration").try_cast("double") * 1000).cast("bigint").alias("duration_ms"), video["width"].alias("width"), video["height"].alias("height"),
        F.when(low > 0, F.round(top / low, 3)).alias("fps"), video["codec_name"].alias("video_codec"), F.size(audio).alias("audio_tracks"), F.get(audio, F.lit(0))["codec_name"].alias("audio_codec"),
        subs.alias("subtitle_tracks"), F.col("__j.format.format_name").alias("container"), F.col("__j.format.size").try_cast("bigint").alias("size_bytes"),
    )


def pick_subtitle(tracks: Column) -> Column:
    """The first English text track, else the first text track, else null."""
    first = lambda f: F.get(F.filter(tracks, f), F.lit(0))
    return F.coalesce(first(lambda t: t["is_text"] & F.coalesce(t["language"], F.lit("")).isin("en", "eng")), first(lambda t: t["is_text"]))


def extract_subtitles(tracks: DataFrame, make) -> DataFrame:
    """video_id, srt: text of each video's best subtitle track (video_id, path, subtitle_tracks); null where none is text or it can't be read.

    make() gives, once a task, a function (path, track index) -> text.
    """
    d = tracks.select("video_id", "path", pick_subtitle(F.col("subtitle_tracks"))["index"].alias("track"))

    def one(read, path, track) -> str | None:
        try:
            return None if pd.isna(track) else read(path, int(track))
        except Exception:  # noqa: BLE001 - videos without subtitles are as good
            return None

    def run(batches):
        read = make()
        for b in batches:
            yield pd.DataFrame({"video_id": b["video_id"], "srt": [one(read, p, t) for p, t in zip(b["path"], b["track"], strict=True)]})

    return d.mapInPandas(run, T.StructType([d.schema["video_id"], T.StructField("srt", T.StringType())]))
