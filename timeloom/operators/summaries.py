"""Figures and rows of the stages: what each hands to the next one and tells about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings
from timeloom.operators.ordering import LARGE, positions
from timeloom.functions import text as tx
from timeloom.operators.intervals import overlap_join, point_join

STAGES = ("normalize", "chunk", "transcribe", "shots", "caption", "merge", "scenes", "embed", "summarize")


def mean_ms(start: str = "start_ms", end: str = "end_ms") -> Column:
    """Mean length of a group's spans, truncated; 0 for none."""
    return F.coalesce((F.sum(F.col(end) - F.col(start)) / F.count("*")).cast("bigint"), F.lit(0))


def transcript_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.sum(F.size("words")).alias("words"))


def shots_summary(shots: DataFrame) -> DataFrame:
    return shots.groupBy("video_id").agg(F.count("*").alias("shots"), F.sum(F.size("keyframes")).alias("keyframes"), mean_ms().alias("avg_shot_ms"))


def captions_summary(frames: DataFrame) -> DataFrame:
    """frames: video_id, on_screen_text, error, seconds."""
    said = F.coalesce(F.col("on_screen_text"), F.lit("")) != ""
    return frames.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(said).alias("with_text"), F.count("error").alias("errors"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))


def scenes_summary(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("video_id").agg(F.count("*").alias("scenes"), F.count("error").alias("errors"), mean_ms().alias("avg_scene_ms"))


def duration(spans: DataFrame, videos: DataFrame) -> DataFrame:
    """Last end of each video's spans, 0 without any."""
    last = spans.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))
    return videos.select("video_id").join(last, "video_id", "left").na.fill(0, ["duration_ms"])


def objects_seen(frames: DataFrame, key: list[str], most: int = 25) -> DataFrame:
    """The first `most` different objects of each group by name."""
    seen = frames.select(*key, F.explode("objects").alias("o")).groupBy(*key).agg(F.collect_set("o").alias("s"))
    return seen.select(*key, F.slice(F.array_sort("s"), 1, most).alias("objects"))


def overall_progress(stage: Column, fraction: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """Share of all stages done, with a fraction of the present one."""
    done = F.array_position(F.array(*map(F.lit, stages)), stage) - 1
    return (done + F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))) / len(stages)


def all_done(runs: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """video_id, ready: whether every stage's present state (latest_runs) is done."""
    good = F.count_distinct(F.when((F.col("status") == "done") & F.col("stage").isin(*stages), F.col("stage")))
    return runs.groupBy("video_id").agg((good == len(stages)).alias("ready"))


def require_done(runs: DataFrame, stage: str, video_id) -> None:
    """Raises unless the stage's present state is done for the video."""
    if runs.filter((F.col("video_id") == video_id) & (F.col("stage") == stage) & (F.col("status") == "done")).isEmpty():
        raise RuntimeError(f"stage {stage!r} is not done for {video_id!r}")


def queue_positions(jobs: DataFrame, large: int | None = LARGE) -> DataFrame:
    """Waiting jobs (video_id, status, queued_at) with their place in the queue, the first is 1."""
    waiting = jobs.filter("status = 'queued'").select("video_id", "queued_at", F.lit(0).alias("queue"))
    return positions(waiting, ["queue"], "queued_at", "video_id", large=large).select("video_id", (F.col("__at") + 1).alias("queue_position"))


def newest_first(videos: DataFrame) -> DataFrame:
    """Listing by time of creation, those without one last."""
    return videos.orderBy(F.desc_nulls_last("created_at"), "video_id")


def in_time_order(lines: DataFrame, large: int | None = LARGE) -> DataFrame:
    """Rows with their place in a video: by start, then source as it came, then position."""
    return positions(lines, ["video_id"], "start_ms", "source_rank", "pos", large=large).withColumn("place", F.col("__at") + 1).drop("__at", "__n")


def pinned_language(chunks: DataFrame, least: float = DEFAULTS.min_lang_prob) -> DataFrame:
    """Language each chunk (video_id, index, n_segments, lang, lang_prob) is decoded in: the first one found surely in an earlier chunk, else null."""
    sure = F.when((F.col("n_segments") > 0) & (F.col("lang_prob") >= least), F.col("lang"))
    before = Window.partitionBy("video_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("pinned", F.first(sure, ignorenulls=True).over(before))


def dialogue_rows(segments: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Segments as lines: source, mean word probability, why they aren't to be trusted; empty and imagined ones are gone."""
    d = segments.filter((F.trim("text") != "") & ~tx.hallucinated(F.col("no_speech_prob"), F.col("avg_logprob")))
    d = d.withColumn("word_prob", tx.mean_word_probability(F.col("words")))
    d = d.withColumn("reason", tx.unreliable_reason(F.col("lang_prob"), F.col("avg_logprob"), F.col("word_prob"), s))
    return d.withColumns({"source": F.lit("asr"), "reliable": F.col("reason").isNull()})


def subtitled_lines(lines: DataFrame, texts: DataFrame, width_ms: int = 600_000, s: Settings = DEFAULTS) -> DataFrame:
    """lines with `subtitled` (any on-screen text runs beside them); those whose language is then not sure enough are no longer reliable."""
    over = overlap_join(lines.select("video_id", "start_ms", "end_ms").distinct(), texts, width_ms, "left_semi")
    hit = over.select(*[F.col(f"a_{c}").alias(c) for c in ("video_id", "start_ms", "end_ms")], F.lit(True).alias("hit"))
    d = lines.join(hit, ["video_id", "start_ms", "end_ms"], "left").withColumn("subtitled", F.coalesce("hit", F.lit(False))).drop("hit")
    down = F.coalesce(F.col("reliable") & F.col("subtitled") & (F.col("lang_prob") < s.subtitled_lang_prob), F.lit(False))
    return d.withColumns({"reason": F.when(down, "other_language").otherwise(F.col("reason")), "reliable": F.col("reliable") & ~down})


def visual_rows(frames: DataFrame) -> DataFrame:
    """Captions as visuals: cleaned description, whether they are graphic; optional fields are null where they are empty."""
    d = frames.filter("error is null")
    told = lambda c: F.when(F.col(c) != "", F.col(c))
    caption = F.coalesce("caption", F.lit(""))
    return d.select(
        "video_id", "ts_ms", "file", tx.clean_description(caption).alias("description"), F.coalesce("objects", F.array().cast("array<string>")).alias("objects"), tx.is_graphic(caption).alias("graphic"),
        F.when(F.size("people") > 0, F.col("people")).alias("people"), told("setting").alias("setting"), told("mood").alias("mood"), told("shot_type").alias("shot_type"),
    )


def shot_evidence(shots: DataFrame, lines: DataFrame, texts: DataFrame, visuals: DataFrame, width_ms: int = 600_000) -> DataFrame:
    """What boundary_scores needs of each shot: ids and midpoints of its lines, when talk begins and ends, ids of its texts, whether all it shows is graphic."""
    key = ["video_id", "shot"]
    s = shots.select(*key, "start_ms", "end_ms")
    of = lambda d: overlap_join(d.select("video_id", "id", "start_ms", "end_ms"), s, width_ms).withColumnsRenamed({"a_video_id": "video_id", "b_shot": "shot"})
    said = of(lines).groupBy(*key).agg(F.array_sort(F.collect_set("a_id")).alias("dialogue_ids"), F.collect_list((F.col("a_start_ms") + F.col("a_end_ms")) / 2).alias("mids"), F.min("a_start_ms").alias("first_talk_ms"), F.max("a_end_ms").alias("last_talk_ms"))
    shown = of(texts).groupBy(*key).agg(F.array_sort(F.collect_set("a_id")).alias("text_ids"))
    seen = point_join(visuals.select("video_id", "ts_ms", "graphic"), s, "ts_ms", width_ms).filter("b_shot is not null").withColumnRenamed("b_shot", "shot").groupBy(*key).agg(F.bool_and("graphic").alias("graphic"))
    d = shots.select(*key, "start_ms", "end_ms").join(said, key, "left").join(shown, key, "left").join(seen, key, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    ids = dict(d.dtypes)
    return d.select(*key, "start_ms", "end_ms", F.coalesce("graphic", F.lit(False)).alias("graphic"), none("dialogue_ids", ids["dialogue_ids"]), none("text_ids", ids["text_ids"]), none("mids", "array<double>"), "first_talk_ms", "last_talk_ms")


def pending_chunks(chunks: DataFrame, stage: str, outputs: DataFrame) -> DataFrame:
    """Chunks (id, stages map) whose stage isn't marked done or whose output (id, good) is missing or not good."""
    d = chunks.join(outputs.select("video_id", "id", "good"), ["video_id", "id"], "left")
    return d.filter(~(F.coalesce(F.try_element_at("stages", F.lit(stage)) == "done", F.lit(False)) & F.coalesce("good", F.lit(False)))).select("video_id", "id")


def caption_outputs(files: DataFrame, model: str) -> DataFrame:
    """good: complete, by the present model, without failed frames. files: video_id, id, complete, model, errors (count)."""
    return files.select("video_id", "id", (F.coalesce("complete", F.lit(False)) & F.col("model").eqNullSafe(F.lit(model)) & (F.coalesce("errors", F.lit(0)) == 0)).alias("good"))


def printed_once(rows: DataFrame) -> DataFrame:
    """Lines of shots (video_id, shot, id): each only in the first shot that has it."""
    return rows.groupBy("video_id", "id").agg(F.min("shot").alias("shot"))


def map_union(a: Column, b: Column) -> Column:
    """Entries of both maps; b's value where both have a key."""
    rest = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(rest, b)
