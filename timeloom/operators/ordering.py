"""Positions and runs of ordered rows where one key may hold a great part of all rows.

Keys of more than `large` rows, which one aggregate finds, are sorted by range instead of in one task: their rows are written once in ranges
of (key, order), each range is numbered or compared by itself, and what a range needs of those before it (how many rows, the last row) comes
from a table of one row a range. All other keys are ordered by an ordinary window. Both give the same rows; `large=None` spares the
aggregate where keys are small by nature.

Defined results: nulls of the order come first, null keys are a key of their own; rows that tie in the whole order have any of their places.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a key that one task sorts without a second thought.
LARGE = 1_000_000
#: Rows of a range of a large key: many tasks share the key, and each of them has work for seconds.
RANGE = 250_000
_folders: list[tuple[SparkSession, str]] = []


def _settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that ranges are the same to all that read them; gone when the driver ends."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="timeloom-")
    path = f"{shared.rstrip('/')}/ordered-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _folders:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def _equal(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys], F.lit(True))


def split_large(df: DataFrame, keys: list[str], order: list[Column], large: int | None, size: int = RANGE) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small keys, rows of large keys with __range, whose numbers ascend along each key's order; None if there are none)."""
    if large is None:
        return df, None
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > large)
    found = counts.collect()  # at most 1 / large of the rows
    if not found:
        return df, None
    spark = df.sparkSession
    names = [F.col(k).alias(f"__{k}") for k in keys]
    hot = F.broadcast(spark.createDataFrame(found, counts.schema).select(*names, F.lit(True).alias("__hot")))
    same = _equal(keys, df, hot)
    rows = df.join(hot, same, "left_semi")
    parts = max(2, -(-sum(r["__n"] for r in found) // size))
    # rows that tie in the order may be dealt to several ranges by the last, random column
    ranged = rows.withColumn("__r", F.rand(7)).repartitionByRange(parts, *keys, *order, "__r").drop("__r").withColumn("__range", F.spark_partition_id())
    return df.join(hot, same, "left_anti"), _settled(ranged)


def _with_ranges(ranged: DataFrame, keys: list[str], per_range: DataFrame) -> DataFrame:
    """Rows with what the table of ranges says of theirs: a row a range, so it is broadcast."""
    per = per_range.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__own"), *[c for c in per_range.columns if c not in (*keys, "__range")])
    on = _equal(keys, ranged, per) & (ranged["__range"] == per["__own"])
    return ranged.join(F.broadcast(per), on).drop("__own", *[f"__{k}" for k in keys])


def positions(df: DataFrame, keys: list[str], *order: str | Column, large: int | None = LARGE, size: int = RANGE) -> DataFrame:
    """df with __at (place in the key's order, from 0) and __n (rows of the key)."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    small, ranged = split_large(df, keys, by, large, size)
    w = Window.partitionBy(*keys)
    out = small.withColumns({"__at": F.row_number().over(w.orderBy(*by)).cast("bigint") - 1, "__n": F.count("*").over(w)})
    if ranged is None:
        return out
    per = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"__before": before, "__n": F.sum("__c").over(w)}).drop("__c")
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*by)).cast("bigint") - 1
    x = _with_ranges(ranged, keys, per).withColumn("__at", F.col("__before") + own)
    return out.unionByName(x.select(out.columns))


def sessions(df: DataFrame, keys: list[str], at: str, gap: int, *tie: str, large: int | None = LARGE, size: int = RANGE) -> DataFrame:
    """df with `session` (from 1): a new one begins where `at` is more than gap after the row before."""
    by = [F.col(c) for c in (at, *tie)]
    small, ranged = split_large(df, keys, by, large, size)
    new = lambda was: F.when(F.col(at) - was <= gap, 0).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(*by)
    out = small.withColumn("__new", new(F.lag(at).over(w))).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    if ranged is None:
        return out
    own = Window.partitionBy(*keys, "__range").orderBy(*by)
    ranges = Window.partitionBy(*keys).orderBy("__range")
    last = ranged.groupBy(*keys, "__range").agg(F.max(at).alias("__last")).withColumn("__was", F.lag("__last").over(ranges)).drop("__last")
    x = _with_ranges(ranged, keys, last).withColumn("__new", new(F.coalesce(F.lag(at).over(own), F.col("__was"))))
    begun = x.groupBy(*keys, "__range").agg(F.sum("__new").alias("__c"))
    begun = begun.withColumn("__before", F.coalesce(F.sum("__c").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    x = _with_ranges(x, keys, begun).withColumn("session", F.col("__before") + F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return out.unionByName(x.select(out.columns))


def before_in_ranges(ranged: DataFrame, keys: list[str], by: list[Column], value: Column, total: Callable, out: str) -> DataFrame:
    """Rows of `split_large` with `out`: total (F.sum or F.max) of value over the rows before, null for a key's first."""
    d = ranged.withColumn("__v", value)
    ranges = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*keys, "__range").agg(total("__v").alias("__t"))
    per = per.withColumn("__before", total("__t").over(ranges)).drop("__t")
    own = total("__v").over(Window.partitionBy(*keys, "__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    x = _with_ranges(d, keys, per).withColumn("__own", own)
    both = F.col("__before") + F.col("__own") if total is F.sum else F.greatest("__before", "__own")
    return x.withColumn(out, F.coalesce(both, "__before", "__own")).drop("__v", "__before", "__own")
