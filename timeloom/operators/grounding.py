"""Routing of questions and checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings
from timeloom.functions.timecode import find_times
from timeloom.operators.intervals import overlap_join

# Words that ask for the summary, and for people.
SUMMARY = r"\b(genre|plot|story|about|ending|end|ends|theme|themes|summary|summari[sz]e|tone|setting|kind of (movie|film|video)|logline)\b"
PEOPLE = r"\b(who|characters?|names?|people|cast|protagonist|hero|villain|antagonist)\b"


def route(question: Column, s: Settings = DEFAULTS) -> Column:
    """Planned calls: array of struct(action, start_ms, end_ms)."""
    t = find_times(question)
    call = lambda name, a=F.lit(None), b=F.lit(None): F.struct(F.lit(name).alias("action"), a.cast("bigint").alias("start_ms"), b.cast("bigint").alias("end_ms"))
    two = call("get_range", F.least(F.get(t, F.lit(0)), F.get(t, F.lit(1))), F.greatest(F.get(t, F.lit(0)), F.get(t, F.lit(1))))
    one = call("get_range", F.greatest(F.get(t, F.lit(0)) - s.around_ms, F.lit(0)), F.get(t, F.lit(0)) + s.around_ms)
    none = F.array(F.when(question.rlike("(?i)" + SUMMARY), call("get_movie_summary")), F.when(question.rlike("(?i)" + PEOPLE), call("get_characters")))
    return F.filter(F.when(F.size(t) >= 2, F.array(two)).when(F.size(t) == 1, F.array(one)).otherwise(none), lambda x: x.isNotNull())


def pick_sources(items: DataFrame, citations: DataFrame, s: Settings = DEFAULTS, most: int = 6, per_step: int = 3, width_ms: int = 3_600_000) -> DataFrame:
    """Sources of each answer: the items its times cite, else the first of each step; distinct, the first six, numbered (`place`) by start.

    items: answer_id, step, pos, label, start_ms, end_ms. citations: answer_id, ts_ms. Both are dealt to buckets of `width_ms`.
    """
    key = ["answer_id", "start_ms", "end_ms", "label"]
    # the first three of a step are counted before items that came in earlier steps go
    items = items.withColumn("__n", F.row_number().over(Window.partitionBy("answer_id", "step").orderBy("pos")))
    only = lambda d: d.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("step", "pos"))).filter("__k = 1").drop("__k")
    t = s.source_tolerance_ms
    wide = items.select(F.col("answer_id").alias("video_id"), (F.col("start_ms") - t).alias("start_ms"), (F.col("end_ms") + t + 1).alias("end_ms"), "step", "pos", "label").distinct()
    c = citations.select(F.col("answer_id").alias("video_id"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 1).alias("end_ms")).distinct()
    hit = overlap_join(wide, c, width_ms, "left_semi")
    hit = hit.select(F.col("a_video_id").alias("answer_id"), (F.col("a_start_ms") + t).alias("start_ms"), (F.col("a_end_ms") - t - 1).alias("end_ms"), F.col("a_step").alias("step"), F.col("a_pos").alias("pos"), F.col("a_label").alias("label")).distinct()
    cited = only(items.join(hit, [*key, "step", "pos"], "left_semi"))
    fall = only(items.join(cited.select("answer_id").distinct(), "answer_id", "left_anti").filter(F.col("__n") <= per_step))
    out = cited.unionByName(fall).drop("__n")
    out = out.withColumn("__k", F.row_number().over(Window.partitionBy("answer_id").orderBy("step", "pos"))).filter(F.col("__k") <= most).drop("__k")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("start_ms", "step", "pos")))
