"""Search over items: vectors with keywords, tags, ranges and quotes. Top-k is TakeOrderedAndProject, never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, TAGS, Settings
from timeloom.functions.fuzzy import window_ratio
from timeloom.functions.text import keyword_overlap, keywords, words
from timeloom.functions.vectors import dot, search_score, tag_blend
from timeloom.operators.intervals import in_window, scene_at
from timeloom.operators.ordering import positions
from timeloom.operators.windows import ordinal_rank, thin


TAGS_BROADCAST = 1000


def search_moments(items: DataFrame, query: str, vector: list[float], k: int = 10, kinds: list[str] | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Best items by cosine plus keyword bonus, rounded before the sort as the order depends on it; item position breaks ties.

    The query's vector is a literal: the plan is one scan and a top-k, whatever the size of the index.
    """
    d = items if kinds is None else items.filter(F.col("kind").isin(kinds))
    wrong = F.raise_error(F.concat(F.lit(f"the query has {len(vector)} dimensions, an item "), F.size("embedding").cast("string"))).cast("double")
    sim = F.when(F.size("embedding") == len(vector), dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))).when(F.col("embedding").isNotNull(), wrong)
    d = d.withColumn("__sim", sim).withColumn("similarity", F.round("__sim", 3))
    d = d.withColumn("score", search_score(F.col("__sim"), keyword_overlap(keywords(F.lit(query)), F.coalesce("text", F.lit(""))), s))
    return d.drop("__sim", "embedding").orderBy(F.desc("score"), "pos").limit(k)


def find_by_tag(scenes: DataFrame, scores: DataFrame, tag: str, least: float = DEFAULTS.tag_threshold, vocabulary: tuple[str, ...] = TAGS) -> DataFrame:
    """Story scenes with the score of a tag, the raw confidence where there is no score; place: best first within a video."""
    if tag not in vocabulary:
        raise ValueError(f"unknown tag {tag!r}")
    t = scores.filter(F.col("tag") == tag).select("video_id", "scene", "score")
    d = scenes.filter("error is null and not graphic").join(t, ["video_id", "scene"], "left")
    d = d.withColumn("score", F.coalesce("score", F.try_element_at("tags", F.lit(tag)), F.lit(0.0))).filter(F.col("score") >= least)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "scene")))


def get_range(rows: DataFrame, start: int, end: int, limit: int = DEFAULTS.range_lines) -> DataFrame:
    """Rows of each video that overlap the window, thinned evenly to `limit`."""
    return thin(in_window(rows, start, end), ["video_id"], limit, "start_ms", "id")


def tag_scores(scenes: DataFrame, tags: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Blend of a scene's own confidence with its rank by cosine among the video's scenes, for each tag.

    Up to `TAGS_BROADCAST` tags, a vocabulary, are broadcast; more are crossed partition by partition. No tag is dropped.
    """
    few = tags.limit(TAGS_BROADCAST + 1).count() <= TAGS_BROADCAST
    pairs = scenes.crossJoin(F.broadcast(tags)) if few else scenes.hint("shuffle_replicate_nl").crossJoin(tags)
    x = pairs.select("video_id", "scene", "tag", F.coalesce(F.try_element_at("tags", F.col("tag")), F.lit(0.0)).alias("confidence"), F.round(dot(F.col("embedding"), F.col("tag_embedding")), 6).alias("sim"))
    return ordinal_rank(x, ["video_id", "tag"], "sim", "scene", large=None).withColumn("score", tag_blend(F.col("confidence"), F.col("rank"), s))


def search_dialogue(lines: DataFrame, query: str, k: int = 8, least: float = 0.65, ties: tuple[str, ...] = ()) -> DataFrame:
    """Lines like a quote: 1.0 if it is contained; else the better of word overlap and best window ratio.

    Literal hits are split off first, so that only the rest goes through Python; the threshold takes the score before rounding.
    """
    q = query.lower().strip()
    d = lines.withColumn("__n", F.lower("text"))
    if not q:
        return d.drop("__n").withColumn("score", F.lit(0.0)).limit(0)
    found = d.filter(F.col("__n").contains(q)).withColumn("__s", F.lit(1.0))
    asked = F.array_distinct(words(F.lit(q)))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(F.col("__n")))) / F.size(asked)).otherwise(0.0)
    rest = d.filter(~F.col("__n").contains(q)).withColumn("__s", F.greatest(share, window_ratio(least)(F.lit(q), F.col("__n"))))
    out = found.unionByName(rest).filter(F.col("__s") >= least).withColumn("score", F.round("__s", 2)).drop("__n", "__s")
    return out.orderBy(F.desc("score"), "start_ms", "id", *ties).limit(k)


def build_items(scenes: DataFrame, lines: DataFrame, texts: DataFrame, width_ms: int = 600_000, large: int | None = None) -> DataFrame:
    """Everything worth searching, with positions: scenes that didn't fail, reliable lines, on-screen texts; blank ones are left out.

    scenes: video_id, scene, start_ms, end_ms, error, text (its scene_text); lines and texts: video_id, id, start_ms, end_ms, text.
    Positions go by kind, start, id and scene; a line in several scenes has one for each of them. large: see `ordering.positions`.
    """
    story = scenes.filter("error is null").withColumn("id", F.col("scene").cast("string"))
    placed = lambda d: scene_at(d.select("video_id", F.col("id").cast("string").alias("id"), "start_ms", "end_ms", F.trim("text").alias("text")).filter("text <> ''"), scenes.select("video_id", "scene", "start_ms", "end_ms"), width_ms)
    parts = (("scene", story), ("dialogue", placed(lines.filter("reliable"))), ("text", placed(texts)))
    rows = [d.select("video_id", F.lit(rank).alias("__r"), F.concat(F.lit(f"{kind}:"), F.col("id")).alias("id"), F.lit(kind).alias("kind"), "scene", "start_ms", "end_ms", "text", F.col("id").alias("ref")) for rank, (kind, d) in enumerate(parts)]
    d = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return positions(d, ["video_id"], "__r", "start_ms", "ref", "scene", large=large).withColumn("pos", F.col("__at")).drop("__r", "__at", "__n")
