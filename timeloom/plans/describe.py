"""Model answers as tables: prompts to a model once a row, replies made sure of, failures as error rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.config import TAGS
from timeloom.functions import normalise
from timeloom.models import TextModel, call_model


def _asked(prompts: DataFrame, make: Callable[[], TextModel], system: str, read) -> DataFrame:
    """prompts without the prompt, with the fields of `read` (null for failures) and error."""
    kept = [c for c in prompts.columns if c != "prompt"]
    d = call_model(prompts, make, system).withColumnRenamed("error", "failed")
    d = normalise.fields(d, "reply", read, [*kept, "failed"])
    error = F.coalesce("failed", F.when(~F.coalesce("valid", F.lit(False)), F.lit("no JSON")))
    names = [c for c in d.columns if c not in (*kept, "failed", "valid")]
    return d.select(*kept, *[F.when(error.isNull(), F.col(c)).alias(c) for c in names], error.alias("error"))


def describe_scenes(scenes: DataFrame, prompts: DataFrame, texts: DataFrame, make: Callable[[], TextModel], system: str = "scene") -> DataFrame:
    """Scenes (video_id, scene, graphic) described: title cards from their texts without a call, the others by the model."""
    key = ["video_id", "scene"]
    cards = scenes.filter("graphic").select(*key)
    story = _asked(prompts.join(cards, key, "left_anti"), make, system, normalise.scene)
    shown = texts.groupBy(*key, "id").agg(F.min(F.struct("start_ms", "text")).alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x.start_ms", "id", "x.text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), " / ")
    nothing = F.map_from_arrays(F.array(*map(F.lit, TAGS)), F.array(*[F.lit(0.0)] * len(TAGS)))
    told = {"title": F.lit("Title card / credits"), "description": F.coalesce(joined, F.lit("")), "time_of_day": F.lit("unknown"), "tags": nothing, "tag_evidence": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))}
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None if kind == "string" else "").cast(kind)
    types = dict(story.dtypes)
    cards = cards.join(shown, key, "left").select(*[c if c in key else (told[c] if c in told else F.lit(None).cast("string") if c == "error" else F.lit("") if types[c] == "string" else empty(types[c])).alias(c) for c in story.columns])
    return story.unionByName(cards)


def summarise_chapters(prompts: DataFrame, make: Callable[[], TextModel], system: str = "chapter") -> DataFrame:
    return _asked(prompts, make, system, normalise.chapter)


def build_profiles(prompts: DataFrame, chapters: DataFrame, make: Callable[[], TextModel], system: str = "profile") -> DataFrame:
    """Profiles of videos; one all of whose chapters failed isn't asked about."""
    failed = chapters.groupBy("video_id").agg(F.bool_and(F.col("error").isNotNull()).alias("all")).filter("all").select("video_id")
    asked = _asked(prompts.join(failed, "video_id", "left_anti"), make, system, normalise.profile)
    none = [F.lit(None).cast(k).alias(c) for c, k in asked.dtypes if c not in ("video_id", "error")]
    return asked.unionByName(failed.select("video_id", *none, F.lit("all chapter summaries failed").alias("error")))
