"""Aggregations; all have partial sums before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.config import TAGS


def timeline_stats(lines: DataFrame, texts: DataFrame, shots: DataFrame) -> DataFrame:
    """Counts a video: lines by source, reliability and reason, texts and shots."""
    one = lines.groupBy("video_id").agg(
        F.count("*").alias("dialogue"), F.count_if(F.col("source") == "srt").alias("srt"), F.count_if(F.col("source") == "asr").alias("asr"), F.count_if(F.col("reliable")).alias("reliable"),
        F.count_if(F.col("reason") == "other_language").alias("other_language"), F.count_if(F.col("reason") == "low_confidence").alias("low_confidence"),
    )
    two, three = texts.groupBy("video_id").agg(F.count("*").alias("texts")), shots.groupBy("video_id").agg(F.count("*").alias("shots"))
    return one.join(two, "video_id", "full").join(three, "video_id", "full").na.fill(0)


def counts_by_kind(items: DataFrame, kinds: list[str], key: str = "video_id") -> DataFrame:
    """One column a kind, zeros included."""
    return items.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def tag_stats(tags: DataFrame, vocabulary: tuple[str, ...] = TAGS, threshold: float = 0.5) -> DataFrame:
    """Share of a video's scenes (video_id, scene, tag, confidence) with each tag; zeros dropped, best first."""
    n = tags.groupBy("video_id").agg(F.count_distinct("scene").alias("n"))
    hit = tags.filter(F.col("confidence") >= threshold).groupBy("video_id", "tag").agg(F.count_distinct("scene").alias("hits"))
    place = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("tag"))
    return hit.join(n, "video_id").select("video_id", "tag", "hits", F.round(F.col("hits") / F.col("n"), 2).alias("share"), place.alias("place")).filter("share > 0")


def character_rollup(scenes: DataFrame) -> DataFrame:
    """Names of scenes (video_id, scene, start_ms, end_ms, name) by lower case: as written in the first scene, scenes in order with repeats, first and last time."""
    order = F.struct("scene", "start_ms", "name")
    return scenes.filter("trim(name) <> ''").groupBy("video_id", F.lower("name").alias("key")).agg(
        F.min_by("name", order).alias("name"), F.count("*").alias("n_scenes"), F.array_sort(F.collect_list("scene")).alias("scenes"), F.min_by("start_ms", order).alias("first_ms"), F.max("end_ms").alias("last_ms"),
    )


#: A character that a word is made of, for names and lines alike.
WORD_CHAR = r"[\p{L}\p{N}_]"


def mention_counts(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that mention each name (key, lower case) as whole words: an equality join on the name's first word, then the name between word ends.

    names: video_id, key; lines: video_id, id, text. Names without a word are in no line. Words are joined without their lines; only where a name
    has more than its word is the line fetched. Both joins are merges: a table of words is estimated at the size of its compressed file, many
    times too small, and would be broadcast.
    """
    first = F.regexp_extract("key", f"({WORD_CHAR}+)", 1)
    n = names.select("video_id", "key", first.alias("word")).distinct().filter("word <> ''")
    said = lines.select("video_id", "id", F.lower("text").alias("line"))
    w = said.select("video_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(f"{WORD_CHAR}+"), F.lit(0)))).alias("word"))
    met = n.join(w.hint("merge"), ["video_id", "word"])
    plain = met.filter("key = word").select("video_id", "key", "id")  # a name of one word needs no pattern
    edge = F.concat(F.lit(f"(?<!{WORD_CHAR})\\Q"), F.replace(F.col("key"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{WORD_CHAR})"))
    longer = met.filter("key <> word").join(said.hint("merge"), ["video_id", "id"]).filter(F.regexp_like(F.col("line"), edge)).select("video_id", "key", "id")
    hit = plain.unionByName(longer)
    return names.select("video_id", "key").join(hit.groupBy("video_id", "key").agg(F.count_distinct("id").alias("mentions")), ["video_id", "key"], "left").na.fill(0, ["mentions"])


def best_confidence(rows: DataFrame) -> DataFrame:
    """Highest confidence of each (scene, tag) with its evidence; the first on ties."""
    return rows.groupBy("video_id", "scene", "tag").agg(F.max_by(F.struct("confidence", "evidence"), F.struct("confidence", (-F.col("pos")).alias("p"))).alias("best")).select("video_id", "scene", "tag", F.col("best.confidence"), F.col("best.evidence"))


def envelope(shots: DataFrame, group: str) -> DataFrame:
    """Bounds of a group of shots: first start, last end, range of numbers, whether all are graphic, ids of lines in order."""
    return shots.groupBy("video_id", group).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("shot").alias("first"), F.max("shot").alias("last"), F.bool_and("graphic").alias("graphic"), F.array_sort(F.flatten(F.collect_list("dialogue_ids"))).alias("dialogue_ids"))


def best_variant(readings: DataFrame) -> DataFrame:
    """Fullest reading of each text: longest normal form, then most frequent, then first."""
    from timeloom.functions.text import norm

    per = readings.groupBy("video_id", "id", "text").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return per.groupBy("video_id", "id").agg(F.max_by("text", F.struct(F.length(norm(F.col("text"))), F.col("n"), -F.col("pos"))).alias("text"))


def mean_histogram(frames: DataFrame) -> DataFrame:
    """Element-wise mean of the histograms of each shot."""
    bins = frames.select("video_id", "shot", F.posexplode("histogram").alias("bin", "v")).groupBy("video_id", "shot", "bin").agg(F.avg("v").alias("v"))
    return bins.groupBy("video_id", "shot").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda x: x["v"]).alias("histogram"))
