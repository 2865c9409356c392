"""Files that are taken in: listed by name, copied to their place by the tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.text import valid_file
from timeloom.sources.layout import Layout
from timeloom.sources.wav import file_system

_PIECE = 8 << 20


def landed_files(spark: SparkSession, landing: str, max_bytes: int) -> DataFrame:
    """path, name, length, error of the files in a folder, empty ones included; contents aren't read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(landing)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isFile()]
    d = spark.createDataFrame(found, "path string, name string, length bigint")
    error = F.when(F.col("length") == 0, "empty file").when(F.col("length") > max_bytes, "too large").when(~valid_file(F.col("name")), "unknown kind of file")
    return d.withColumn("error", error)


def import_media(files: DataFrame, root: str) -> DataFrame:
    """path, video_id, target, length, error of files (path, video_id) copied to media/<video>/original.<ending> under root.

    The copy is made under another name and renamed when it is whole, so a half copy never counts; a video that has an original keeps it and
    nothing is copied. A missing or empty file, or an odd id, is an error row. Of several files of a video in one call any may be the one.
    """

    def put(path: str, video_id: str) -> tuple[str, int]:
        if path is None or video_id is None:
            raise ValueError("a file needs a path and a video")
        folder_fs, folder = file_system(Layout(root).media(video_id, ""))
        folder = folder.rstrip("/")
        there = [x for x in folder_fs.get_file_info(pf.FileSelector(folder, allow_not_found=True)) if x.base_name.startswith("original.") and x.type == pf.FileType.File]
        if there:
            return there[0].path, there[0].size
        fs, source = file_system(path)
        size = fs.get_file_info(source).size
        if not size:
            raise ValueError("missing file" if size is None else "empty file")
        folder_fs.create_dir(folder, recursive=True)
        target = f"{folder}/original{os.path.splitext(source)[1].lower() or '.bin'}"
        draft = f"{folder}/.{uuid.uuid4().hex}"
        try:
            with fs.open_input_stream(source) as a, folder_fs.open_output_stream(draft) as b:
                while piece := a.read(_PIECE):
                    b.write(piece)
            folder_fs.move(draft, target)
        except BaseException:
            if folder_fs.get_file_info(draft).type == pf.FileType.File:
                folder_fs.delete_file(draft)
            raise
        return target, size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, video_id in zip(b["path"], b["video_id"], strict=True):
                try:
                    out.append((path, video_id, *put(path, video_id), None))
                except (OSError, ValueError) as e:
                    out.append((path, video_id, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "video_id", "target", "length", "error"])

    return files.select("path", "video_id").mapInPandas(run, "path string, video_id string, target string, length bigint, error string")
