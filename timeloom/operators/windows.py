"""Window operators; every order has an explicit last key, as sorts aren't stable here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.ordering import LARGE, positions


def ordinal_rank(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank", large: int | None = LARGE) -> DataFrame:
    """Position by ascending value over n - 1; 0.5 for a single row. Equal values keep apart, unlike percent_rank."""
    x = positions(df, keys, value, tie, large=large)
    return x.withColumn(out, F.when(F.col("__n") == 1, 0.5).otherwise(F.col("__at") / (F.col("__n") - 1))).drop("__at", "__n")


def numbered(df: DataFrame, prefix: str, *order: str, large: int | None = LARGE) -> DataFrame:
    """id: d0001, d0002, ... within each video."""
    return positions(df, ["video_id"], *order, large=large).withColumn("num", F.format_string(f"{prefix}%04d", F.col("__at") + 1)).drop("__at", "__n")


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def tail(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter(F.col("__k") <= n).drop("__k")


def thin(df: DataFrame, keys: list[str], limit: int, *order: str, large: int | None = LARGE) -> DataFrame:
    """Evenly spread rows of each key: the indices floor(i * (n / limit)), if there are more than limit."""
    x = positions(df, keys, *order, large=large)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("__n") / F.lit(float(limit)))))
    return x.filter((F.col("__n") <= limit) | F.array_contains(wanted, F.col("__at"))).drop("__n", "__at")


def boundary_scores(shots: DataFrame, look: Column | None = None) -> DataFrame:
    """Score of the cut after each shot but the last.

    shots: video_id, shot, end_ms, graphic, dialogue_ids, text_ids, mids, first_talk_ms, last_talk_ms. look: distance of the pictures.
    """
    w = Window.partitionBy("video_id").orderBy("shot")
    nxt = lambda c: F.lead(c).over(w)
    look = F.lit(0.5) if look is None else F.coalesce(look, F.lit(0.5))
    x = shots.select("*", *[nxt(c).alias(f"n_{c}") for c in ("shot", "graphic", "dialogue_ids", "text_ids", "mids", "first_talk_ms")])
    x = x.filter("n_shot is not null")
    shared = F.coalesce(F.arrays_overlap("dialogue_ids", "n_dialogue_ids"), F.lit(False))
    talk = shared | F.coalesce(F.col("n_first_talk_ms") - F.col("last_talk_ms") < 2000, F.lit(False))
    near = F.exists(F.concat("mids", "n_mids"), lambda m: F.abs(m - F.col("end_ms")) < 5000)
    text = F.coalesce(F.arrays_overlap("text_ids", "n_text_ids"), F.lit(False))
    score = look + F.when(near, 0.0).otherwise(0.3) - F.when(talk, 0.4).otherwise(0.0) - F.when(text, 0.3).otherwise(0.0)
    score = F.when(F.col("graphic") != F.col("n_graphic"), 2.0).otherwise(score)
    return x.select("video_id", "shot", F.round(score, 3).alias("score"))
