"""Ranged reads of WAV files: the header's few bytes and the bytes of the samples that are wanted, never a file.

`wav_slices` reads spans of a table; the data source `wav` plans a partition a chunk from the files' headers:

    register(spark)
    spark.read.format("wav").option("chunk_ms", 300_000).option("pad_ms", 5_000).load("/media/*/audio.wav")

Paths are local or URIs that Arrow's file systems know; tasks open them themselves. Samples are 16 kHz mono 16-bit, as floats in [-1, 1).

Defined results: spans are clamped to the file, an empty or reversed one has no samples; a file that ends early, or in half a sample, has the
samples that are there; what isn't such a file is a row with an error (of the data source: one row a file); files over 4 GB and those written by
a pipe, whose header can't give the length, end where they end; a null path or bound is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RATE = 16_000
_PCM, _EXTENSIBLE = 1, 0xFFFE


def file_system(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def sample_range(f: pa.NativeFile) -> tuple[int, int]:
    """(first byte of the samples, number of samples) from the headers of the file's parts."""
    size = f.size()
    head = f.read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, known = 12, False
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", f.read_at(8, at))
        at += 8
        if name == b"fmt ":
            fmt = f.read_at(min(n, 40), at)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt[:16])
            if kind == _EXTENSIBLE and len(fmt) >= 26:
                kind = struct.unpack("<H", fmt[24:26])[0]
            if (kind, rate, channels, bits) != (_PCM, RATE, 1, 16):
                raise ValueError("expected 16 kHz mono 16-bit")
            known = True
        elif name == b"data":
            if not known:
                raise ValueError("samples before their format")
            there = size - at
            whole = there if n == 0xFFFFFFFF or head[:4] == b"RF64" else min(n, there)
            return at, whole // 2
        at += n + (n & 1)
    raise ValueError("no samples in the file")


def read_span(path: str, start_ms: int, end_ms: int) -> np.ndarray:
    """Samples of [start_ms, end_ms)."""
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        first, n = sample_range(f)
        i, j = (min(max(int(t) * RATE // 1000, 0), n) for t in (start_ms, end_ms))
        raw = f.read_at(2 * max(j - i, 0), first + 2 * i)
    return np.frombuffer(raw, "<i2").astype("f4") / np.float32(32768)


def _told(e: Exception) -> str:
    return str(e) or type(e).__name__


def wav_slices(spans: DataFrame) -> DataFrame:
    """path, start_ms, end_ms, samples, error of spans (path, start_ms, end_ms): each is read where it lies."""
    d = spans.select("path", "start_ms", "end_ms")
    out = T.StructType([*d.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (path, start, end) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                samples = error = None
                try:
                    if path is None or start is None or end is None:
                        raise ValueError("a span needs a path and two bounds")
                    samples = read_span(path, start, end)
                except (ValueError, OSError, struct.error) as e:
                    error = _told(e)
                more = [pa.array([samples], pa.list_(pa.float32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, *more], out.names)

    return d.mapInArrow(run, out)


@dataclass
class Chunk(InputPartition):
    path: str
    chunk: int
    start_ms: int
    end_ms: int
    error: str | None = None

    def __post_init__(self):
        super().__init__(self.chunk)


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.chunk_ms, self.pad_ms = options["path"], int(options.get("chunk_ms", 300_000)), int(options.get("pad_ms", 0))
        if self.chunk_ms <= 0 or self.pad_ms < 0:
            raise ValueError("chunks need a length, and padding can't be negative")

    def files(self) -> list[str]:
        """Names alone; a pattern's stars stand for one level."""
        import fnmatch

        fs, where = file_system(self.paths)
        prefix = self.paths[: len(self.paths) - len(where)] if self.paths.endswith(where) else ""
        parts = where.split("/")
        fixed = next((k for k, p in enumerate(parts) if set(p) & set("*?[")), None)
        if fixed is None:
            return [self.paths]
        top = "/".join(parts[:fixed]) or "/"
        found = fs.get_file_info(pf.FileSelector(top, allow_not_found=True, recursive=len(parts) > fixed + 1))
        match = lambda p: len(p.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, p.split("/"), parts))
        return sorted(prefix + x.path for x in found if x.type == pf.FileType.File and match(x.path))

    def partitions(self) -> list[Chunk]:
        out = []
        for path in self.files():
            try:
                fs, where = file_system(path)
                with fs.open_input_file(where) as f:
                    length = -(-sample_range(f)[1] * 1000 // RATE)
            except (ValueError, OSError, struct.error) as e:
                out.append(Chunk(path, 0, 0, 0, _told(e)))
                continue
            for k, core in enumerate(range(0, max(length, 1), self.chunk_ms)):
                out.append(Chunk(path, k, max(core - self.pad_ms, 0), min(core + self.chunk_ms + self.pad_ms, length)))
        return out or [Chunk("", -1, 0, 0)]

    def read(self, part: Chunk) -> Iterator[tuple]:
        if part.chunk < 0:
            return
        samples, error = None, part.error
        if error is None:
            try:
                samples = read_span(part.path, part.start_ms, part.end_ms).tolist()
            except (ValueError, OSError, struct.error) as e:
                error = _told(e)
        yield part.path, part.chunk, part.start_ms, part.end_ms, samples, error


class WavSource(DataSource):
    """path, chunk, start_ms, end_ms, samples, error: a row and a partition a chunk, padded by pad_ms on both sides."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, chunk int, start_ms bigint, end_ms bigint, samples array<float>, error string"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
