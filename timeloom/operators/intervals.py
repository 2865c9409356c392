"""Interval joins on half-open [start_ms, end_ms), always keyed by video_id.

Long intervals are dealt out to time buckets, so a join is an equality on (video_id, bucket) with the overlap as a residual test:
one long video spreads over its buckets. A pair is reported only in the first bucket it shares, so nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings
from timeloom.functions.timecode import midpoint


def _deal(df: DataFrame, start: Column, last: Column, width: int) -> DataFrame:
    first = F.floor(start / width)
    return df.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, F.floor(last / width)))))


def overlap_join(a: DataFrame, b: DataFrame, width_ms: int, how: str = "inner") -> DataFrame:
    """Rows of a and b (columns prefixed a_, b_) whose intervals overlap: a.start < b.end and b.start < a.end.

    left_semi: the rows of a that overlap any of b, repeated ones as often as they come; the join is made on a's different intervals.
    """
    if how == "left_semi":
        key = ["video_id", "start_ms", "end_ms"]
        hit = overlap_join(a.select(*key).distinct(), b.select(*key).distinct(), width_ms).select([F.col(f"a_{c}").alias(c) for c in key]).distinct()
        return a.join(hit, key, "left_semi").select([F.col(c).alias(f"a_{c}") for c in a.columns])
    x = _deal(a.select([F.col(c).alias(f"a_{c}") for c in a.columns]), F.col("a_start_ms"), F.col("a_end_ms") - 1, width_ms)
    y = _deal(b.select([F.col(c).alias(f"b_{c}") for c in b.columns]), F.col("b_start_ms"), F.col("b_end_ms") - 1, width_ms)
    x, y = x.withColumnRenamed("__first", "__fa"), y.withColumnRenamed("__first", "__fb").withColumnRenamed("__bucket", "__other")
    on = (F.col("a_video_id") == F.col("b_video_id")) & (F.col("__bucket") == F.col("__other")) & (F.col("a_start_ms") < F.col("b_end_ms")) & (F.col("b_start_ms") < F.col("a_end_ms"))
    return x.join(y, on & (F.col("__bucket") == F.greatest("__fa", "__fb"))).drop("__fa", "__fb", "__bucket", "__other")


def point_join(points: DataFrame, spans: DataFrame, at: str, width_ms: int) -> DataFrame:
    """Left join: each point (column `at`) with the span that holds it, if any; a point lies in one bucket."""
    y = _deal(spans.select([F.col(c).alias(f"b_{c}") for c in spans.columns]), F.col("b_start_ms"), F.col("b_end_ms") - 1, width_ms).drop("__first")
    x = points.withColumn("__at", F.floor(F.col(at) / width_ms))
    on = (F.col("video_id") == F.col("b_video_id")) & (F.col("__at") == F.col("__bucket")) & (F.col("b_start_ms") <= F.col(at)) & (F.col(at) < F.col("b_end_ms"))
    return x.join(y, on, "left").drop("__at", "__bucket", "b_video_id")


def owned_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows whose midpoint lies in the core of the chunk they come from; the last chunk also owns what lies past its core."""
    last = F.col("index") == F.max("index").over(Window.partitionBy("video_id"))
    c = chunks.select("video_id", F.col("id").alias("chunk_id"), "core_start_ms", "core_end_ms", last.alias("is_last"))
    mid = midpoint(F.col("start_ms"), F.col("end_ms"))
    return rows.join(c, ["video_id", "chunk_id"]).filter((mid >= F.col("core_start_ms")) & ((mid < F.col("core_end_ms")) | F.col("is_last"))).drop("core_start_ms", "core_end_ms", "is_last")


def nearest(unplaced: DataFrame, spans: DataFrame, at: Column, width_ms: int) -> DataFrame:
    """For each row the span of its video nearest to `at` (0 inside, else to either edge; the earliest on ties).

    The span that holds the point comes from the bucketed join; of the others only the last to end and the next to begin can be nearest. Those
    are looked for among the edges of the point's own bucket; where it has none on that side, the nearest bucket's edge counts, which
    is carried along a table of one row a bucket: no window sorts a whole video, and no row meets all spans of its video.
    """
    s = spans.select("video_id", "shot", "start_ms", "end_ms")
    x = unplaced.withColumn("__pt", at.cast("bigint"))
    points = x.select("video_id", "__pt").distinct()
    inside = point_join(points, s, "__pt", width_ms).groupBy("video_id", "__pt").agg(F.min("b_shot").alias("__in"))
    bucket = F.floor(F.col("t") / width_ms).alias("bucket")
    edge = lambda c: s.filter(F.col(c).isNotNull()).groupBy("video_id", F.col(c).alias("t")).agg(F.min("shot").alias("shot")).select("video_id", "t", bucket, F.struct("t", "shot").alias("edge"))
    edges = edge("end_ms")
    none = F.lit(None).cast(edges.schema["edge"].dataType)
    marks = points.filter("__pt is not null").select("video_id", F.col("__pt").alias("t")).select("video_id", "t", bucket, none.alias("edge"), F.lit(True).alias("point"))

    def side(c: str, pick, turn, name: str) -> DataFrame:
        """The picked edge (last before, or first after) of each point."""
        every = marks.unionByName(edge(c).withColumn("point", F.lit(False)))
        own = Window.partitionBy("video_id", "bucket").orderBy(turn("t"), "point").rowsBetween(Window.unboundedPreceding, 0)
        along = Window.partitionBy("video_id").orderBy(turn("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.groupBy("video_id", "bucket").agg(pick("edge").alias("best")).withColumn("carried", F.last("best", ignorenulls=True).over(along)).drop("best")
        found = every.withColumn("own", F.last("edge", ignorenulls=True).over(own)).filter("point").join(carried, ["video_id", "bucket"])
        return found.select("video_id", F.col("t").alias("__pt"), F.coalesce("own", "carried").alias(name))

    ended, begun = side("end_ms", F.max, F.asc, "__e"), side("start_ms", F.min, F.desc, "__b")
    near = lambda d, shot: F.when(shot.isNotNull(), F.struct(d.cast("bigint").alias("distance"), shot.alias("shot")))
    best = F.least(near(F.lit(0), F.col("__in")), near(F.col("__pt") - F.col("__e.t"), F.col("__e.shot")), near(F.col("__b.t") - F.col("__pt"), F.col("__b.shot")))
    found = inside.join(ended, ["video_id", "__pt"]).join(begun, ["video_id", "__pt"]).select("video_id", "__pt", best.alias("best"))
    return x.join(found, ["video_id", "__pt"]).filter("best is not null").select(*unplaced.columns, "best.shot", "best.distance")


def shot_end(points: DataFrame, shots: DataFrame, at: str, width_ms: int) -> DataFrame:
    """End of the shot that holds the point, else the point + 2000 ms."""
    return point_join(points, shots.select("video_id", "start_ms", "end_ms"), at, width_ms).withColumn("shot_end_ms", F.coalesce("b_end_ms", F.col(at) + 2000)).drop("b_start_ms", "b_end_ms")


def scene_at(rows: DataFrame, scenes: DataFrame, width_ms: int) -> DataFrame:
    """Scene that holds the midpoint; past the last scene the last one; in a gap null."""
    last = scenes.groupBy("video_id").agg(F.max(F.struct("end_ms", "scene")).alias("last"))
    x = rows.withColumn("__mid", midpoint(F.col("start_ms"), F.col("end_ms")))
    x = point_join(x, scenes.select("video_id", "start_ms", "end_ms", "scene"), "__mid", width_ms).join(last, "video_id", "left")
    return x.withColumn("scene", F.coalesce("b_scene", F.when(F.col("__mid") >= F.col("last.end_ms"), F.col("last.scene")))).drop("b_scene", "b_start_ms", "b_end_ms", "last", "__mid")


def in_window(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that overlap a window, open where a bound is None; an empty window is a second long."""
    if start is not None and end is not None and end <= start:
        end = start + 1000
    for bound in (None if end is None else F.col("start_ms") < end, None if start is None else F.col("end_ms") > start):
        df = df if bound is None else df.filter(bound)
    return df


def clip(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans (video_id, chunk_id, start_ms, end_ms) cut to their chunk's padded window (video_id, id, start_ms, end_ms, duration_ms).

    Empty ones go; clipped_start and clipped_end mark edges that touch the window where the movie goes on.
    """
    w = windows.select("video_id", F.col("id").alias("chunk_id"), F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"), F.col("duration_ms").alias("__d"))
    x = spans.join(w, ["video_id", "chunk_id"]).withColumns({"start_ms": F.greatest("start_ms", "__s"), "end_ms": F.least("end_ms", "__e")}).filter("end_ms > start_ms")
    flags = {"clipped_start": (F.col("start_ms") == F.col("__s")) & (F.col("__s") > 0), "clipped_end": (F.col("end_ms") == F.col("__e")) & (F.col("__e") < F.col("__d"))}
    return x.withColumns(flags).drop("__s", "__e", "__d")


def unverified(citations: DataFrame, evidence: DataFrame, s: Settings = DEFAULTS, asked: DataFrame | None = None, width_ms: int = 600_000) -> DataFrame:
    """Cited times with no evidence within the tolerance, nor inside a span (video_id, start_ms, end_ms) that was asked for, ends included.

    Evidence is bucketed by the tolerance and spans by `width_ms`, so these are equality joins.
    """
    if asked is not None:
        y = _deal(asked.select(F.col("video_id").alias("q_video"), F.col("start_ms").alias("q_start"), F.col("end_ms").alias("q_end")), F.col("q_start"), F.col("q_end"), width_ms)
        inside = (F.col("video_id") == F.col("q_video")) & (F.floor(F.col("ts_ms") / width_ms) == F.col("__bucket")) & (F.col("q_start") <= F.col("ts_ms")) & (F.col("ts_ms") <= F.col("q_end"))
        citations = citations.join(y, inside, "left_anti")
    w = s.citation_tolerance_ms
    e = evidence.select(F.col("video_id").alias("e_video"), F.col("ts_ms").alias("e_ts"), F.explode(F.array(*[F.floor(F.col("ts_ms") / w) + k for k in (-1, 0, 1)])).alias("e_bucket"))
    on = (F.col("video_id") == F.col("e_video")) & (F.floor(F.col("ts_ms") / w) == F.col("e_bucket")) & (F.abs(F.col("ts_ms") - F.col("e_ts")) <= w)
    return citations.join(e, on, "left_anti")
