"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' words: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
#: The same as a regular expression, for Java and RE2 alike.
WS_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark alone, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders written by `materialise` that still exist, with the session that wrote them.
_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted by `discard` or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._timeloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t._timeloom_path)


@contextmanager
def scope(*keep: str) -> Iterator[None]:
    """What is written inside is deleted at the end, but for tables whose name is in keep: for stages whose own result is written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            if path.rpartition("/")[2].rpartition("-")[0] not in keep:
                _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    """What returned DataFrames still read lives as long as the driver."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session's JVM may be gone already
            return


def fresh(taken: Collection[str], name: str) -> str:
    """name, or name with as many underscores as no column of `taken` has, in any case."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def hot_keys(df: DataFrame, keys: list[str], tasks: int = 4096) -> DataFrame:
    """Keys with more than 1 / tasks of df's rows (and 1000 at least): at most `tasks` of them, so they can be broadcast."""
    counts = materialise(df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1000"), "hot")
    total = counts.agg(F.sum("n")).first()[0]
    return counts.filter(F.col("n") * tasks > total).select(*keys) if total else counts.select(*keys)


def skewed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join to a right side of one row a key, both without nulls in it: hot keys of the left are joined by broadcast, the others by shuffle."""
    hot = F.broadcast(hot_keys(left, [key]))
    by_broadcast = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return by_broadcast.unionByName(left.join(hot, key, "left_anti").join(right, key))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents (first, past last) of about `limit` bytes, one document at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def cut_long(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts with those over `limit` bytes cut before the first white space after each limit, and the text of each part."""
    size = np.diff(offsets)
    extra, more = [], np.ones(len(size), np.int64)
    for k in np.flatnonzero(size > limit).tolist():
        at, end = int(offsets[k]) + limit, int(offsets[k + 1])
        while at < end:
            found = np.flatnonzero(_WS[data[at : min(at + 65536, end)]])
            if not len(found):
                at += 65536
                continue
            extra.append(at + int(found[0]))
            more[k] += 1
            at = extra[-1] + limit
    return np.sort(np.concatenate((offsets, np.array(extra, np.int64)))), np.repeat(np.arange(len(size)), more)


def by_runs(fn, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    """fn(starts, ends) over at most so many runs at a time, concatenated: what it holds by byte stays small."""
    return np.concatenate([np.zeros(0, np.uint64), *[fn(starts[i : i + limit], ends[i : i + limit]) for i in range(0, len(starts), limit)]])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow, as one place to change."""
    return df.mapInArrow(fn, schema)
