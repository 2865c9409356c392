"""Tables in generations: what a commit replaces is written aside, and one rename makes it the present state of all its parts.

A table's folder holds `data/gen=.../part=.../video_id=...`, `manifests/<gen>` (the generation that holds each video) and `_generations/<number>`, a
file that names the manifest; the highest number counts. Readers and a writer that fails at any point see the state before; a second writer
of the same number fails and loses nothing but its work. Videos that a commit doesn't name keep their files: nothing is copied.

Defined results: a table without commits is read as the plain partitioned table it is, and its first commit takes those videos over; a video that
is committed without rows has none; an absent table is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "video_id string, gen string"
PLAIN = "plain"  #: the generation of videos that were written before the first commit


class Conflict(RuntimeError):
    """Another writer committed first."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def head(spark: SparkSession, root: str, name: str) -> int:
    """Number of the present generation; 0 before the first commit."""
    p, fs = _path(spark, f"{root}/{name}/_generations")
    numbers = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n) for n in numbers if n.isdigit()), default=0)


def manifest(spark: SparkSession, root: str, name: str, number: int) -> DataFrame:
    """video_id, gen: where each video's rows are."""
    base = f"{root}/{name}"
    if number:
        gen = spark.read.text(f"{base}/_generations/{number:012d}").first().value
        return spark.read.schema(_MANIFEST).parquet(f"{base}/manifests/{gen}")
    p, fs = _path(spark, f"{base}/video_id=*")
    if not fs.globStatus(p):
        return spark.createDataFrame([], _MANIFEST)
    plain = spark.read.schema("video_id string").option("basePath", base).parquet(f"{base}/video_id=*")
    return plain.select("video_id").distinct().withColumn("gen", F.lit(PLAIN))


def read(spark: SparkSession, root: str, name: str, kind: T.StructType, part: str = "rows", number: int | None = None) -> DataFrame:
    """A part of the table as of a generation (the present one unless a number is given)."""
    number = head(spark, root, name) if number is None else number
    where, base = manifest(spark, root, name, number), f"{root}/{name}"
    gens = [r.gen for r in where.select("gen").distinct().collect()]  # a name a generation that is still in use
    out = spark.createDataFrame([], kind)
    if PLAIN in gens and part == "rows":
        plain = spark.read.schema(kind).option("basePath", base).parquet(f"{base}/video_id=*")
        out = plain.join(where.filter(F.col("gen") == PLAIN).select("video_id"), "video_id", "left_semi").select(kind.names)
    paths = [p for g in gens if g != PLAIN for p in [f"{base}/data/gen={g}/part={part}"] if _exists(spark, p)]
    if paths:
        full = T.StructType([*kind.fields, T.StructField("gen", T.StringType()), T.StructField("part", T.StringType())])
        rows = spark.read.schema(full).option("basePath", f"{base}/data").parquet(*paths)
        rows = rows.join(where, ["gen", "video_id"], "left_semi").select(kind.names)
        out = out.unionByName(rows) if PLAIN in gens and part == "rows" else rows
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def commit(spark: SparkSession, root: str, name: str, parts: dict[str, DataFrame], videos: DataFrame, number: int) -> int:
    """Replace all parts of the videos (video_id) over generation `number`; returns the new number, or raises Conflict."""
    base, gen = f"{root}/{name}", uuid.uuid4().hex
    for part, rows in parts.items():
        rows.write.partitionBy("video_id").parquet(f"{base}/data/gen={gen}/part={part}")
    before, own = manifest(spark, root, name, number), videos.select("video_id").distinct()
    now = before.join(own, "video_id", "left_anti").unionByName(own.withColumn("gen", F.lit(gen)))
    now.write.parquet(f"{base}/manifests/{gen}")
    _switch(spark, f"{base}/_generations", number + 1, gen)
    return number + 1


def _switch(spark: SparkSession, folder: str, number: int, gen: str) -> None:
    """The file of a number appears whole or not at all, and once."""
    jvm = spark._jvm
    draft, fs = _path(spark, f"{folder}/.{gen}")
    out = fs.create(draft, False)
    out.write(bytearray(gen.encode()))
    out.close()
    target, _ = _path(spark, f"{folder}/{number:012d}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
    except Exception as e:
        fs.delete(draft, False)
        raise Conflict(f"generation {number} of {folder} is there already") from e


def clean(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Delete what only generations before the last `keep` name, and what failed commits left; returns how many folders went. For quiet times."""
    base, last = f"{root}/{name}", head(spark, root, name)
    kept, tables = set(), set()
    for n in range(max(1, last - keep + 1), last + 1):
        kept |= {r.gen for r in manifest(spark, root, name, n).select("gen").distinct().collect()}
        tables.add(spark.read.text(f"{base}/_generations/{n:012d}").first().value)
    gone = 0
    for folder, prefix, wanted in ((f"{base}/data", "gen=", kept), (f"{base}/manifests", "", tables)):
        p, fs = _path(spark, folder)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName().removeprefix(prefix) not in wanted:
                fs.delete(s.getPath(), True)
                gone += 1
    if PLAIN not in kept and last:
        p, fs = _path(spark, f"{base}/video_id=*")
        for s in fs.globStatus(p) or []:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone
