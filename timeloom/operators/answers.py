"""What the question loop's tools return, as plans over a video's tables, and the lines, times and labels they are told by.

Each tool gives a DataFrame of rows in an order (`place`); `told` turns it into one line a row with its times and the label that stands for
it among an answer's sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings
from timeloom.functions.text import MASK, cut_text, tags_over
from timeloom.functions.timecode import fmt, span
from timeloom.operators.aggregates import character_rollup, mention_counts
from timeloom.operators.intervals import in_window
from timeloom.operators.windows import thin

#: Rows of the characters answer.
APPEARANCES = 20


def place(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))


def spoken_and_shown(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Reliable lines and on-screen texts with their source, `says` or `on screen`."""
    part = lambda d, source: d.select("video_id", F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), "start_ms", "end_ms", "text")
    return part(lines.filter("reliable"), "says").unionByName(part(texts, "on screen"))


def range_facts(scenes: DataFrame, lines: DataFrame, texts: DataFrame, start: int, end: int, s: Settings = DEFAULTS) -> DataFrame:
    """Scenes, lines and texts of a window: video_id, kind, id, start_ms, end_ms, title, text, mood, characters, tags, reliable, place.

    Scenes are all there, without failed ones; lines and texts are thinned to `range_lines` each; lines in another language are masked.
    """
    none = lambda kind: F.lit(None).cast(kind)
    cols = lambda d, kind, title, text, mood, who, tags, reliable: d.select("video_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "start_ms", "end_ms", title.alias("title"), text.alias("text"), mood.alias("mood"), who.alias("characters"), tags.alias("tags"), reliable.alias("reliable"))
    nothing = [none("string"), none("array<string>"), none("array<string>")]
    found = in_window(scenes.filter("error is null"), start, end).withColumn("id", F.col("scene"))
    parts = [
        cols(found, "scene", F.col("title"), F.col("description"), F.col("mood"), F.col("characters"), tags_over(F.col("tags"), s.tag_threshold), none("boolean")),
        cols(thin(in_window(lines, start, end), ["video_id"], s.range_lines, "start_ms", "id"), "says", none("string"), F.when(F.col("reliable"), F.col("text")).otherwise(MASK), *nothing, F.coalesce("reliable", F.lit(False))),
        cols(thin(in_window(texts, start, end), ["video_id"], s.range_lines, "start_ms", "id"), "on screen", none("string"), F.col("text"), *nothing, none("boolean")),
    ]
    kinds = F.array(*map(F.lit, ("scene", "says", "on screen")))
    return place(reduce(DataFrame.unionByName, parts), F.array_position(kinds, F.col("kind")), "start_ms", "id")


def movie_summary(profiles: DataFrame, video_id) -> DataFrame:
    """The profile of a video; a video without one is an error."""
    found = profiles.filter(F.col("video_id") == video_id)
    if found.isEmpty():
        raise LookupError(f"no summary of {video_id!r}")
    return found


def chapter_summaries(chapters: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chapters in order, those that overlap the window if it has bounds."""
    for bound in (None if start is None else F.col("end_ms") > start, None if end is None else F.col("start_ms") < end):
        chapters = chapters if bound is None else chapters.filter(bound)
    return place(chapters, "start_ms", "chapter")


def appearances(scenes: DataFrame, lines: DataFrame, texts: DataFrame, most: int = APPEARANCES) -> DataFrame:
    """Characters of a video's scenes (video_id, scene, start_ms, end_ms, characters): the `most` with most scenes, then the first seen.

    name as first written, scenes in order, first and last time, reliable lines and texts that mention it.
    """
    names = scenes.filter("error is null").select("video_id", "scene", "start_ms", "end_ms", F.explode("characters").alias("name"))
    per = character_rollup(names)
    per = place(per, F.desc("n_scenes"), "first_ms", "key").filter(F.col("place") <= most)
    said = spoken_and_shown(lines, texts).withColumn("id", F.concat_ws(":", "source", "id"))
    return per.join(mention_counts(per.select("video_id", "key"), said), ["video_id", "key"])


def main_characters(profiles: DataFrame) -> DataFrame:
    return profiles.select("video_id", F.posexplode("characters").alias("pos", "c")).select("video_id", (F.col("pos") + 1).alias("place"), "c.name", "c.role", "c.description")


def chapter_quotes(chapters: DataFrame, lines: DataFrame, texts: DataFrame, s: Settings = DEFAULTS, width_ms: int = 600_000) -> DataFrame:
    """Reliable lines and texts whose midpoint lies in a chapter, in time order, thinned evenly to `chapter_quotes` a chapter."""
    from timeloom.functions.timecode import midpoint
    from timeloom.operators.intervals import point_join

    said = spoken_and_shown(lines, texts).withColumn("mid", midpoint(F.col("start_ms"), F.col("end_ms")))
    rank = F.when(F.col("source") == "says", 0).otherwise(1)
    found = point_join(said, chapters.select("video_id", "chapter", "start_ms", "end_ms"), "mid", width_ms).filter("b_chapter is not null").withColumn("rank", rank)
    return thin(found, ["video_id", "b_chapter"], s.chapter_quotes, "start_ms", "rank", "id").select("video_id", F.col("b_chapter").alias("chapter"), "source", "id", "start_ms", "end_ms", "text")


def title_card_texts(scenes: DataFrame, texts: DataFrame, most: int = 10, width_ms: int = 600_000) -> DataFrame:
    """The first texts that begin in graphic scenes, in the order of scenes and texts."""
    from timeloom.operators.intervals import point_join

    found = point_join(texts, scenes.filter("graphic").select("video_id", "scene", "start_ms", "end_ms"), "start_ms", width_ms).filter("b_scene is not null")
    return place(found, "b_scene", "start_ms", "id").filter(F.col("place") <= most).select("video_id", F.col("b_scene").alias("scene"), "id", "text", "place")


def evidence_rows(scenes: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines and texts that scenes (video_id, scene, dialogue_ids, text_ids) name as evidence; a text's id hides a line's of the same name."""
    ids = scenes.select("video_id", "scene", F.posexplode(F.concat(F.transform("dialogue_ids", lambda i: F.struct(F.lit("says").alias("label"), i.alias("id"))), F.transform("text_ids", lambda i: F.struct(F.lit("text").alias("label"), i.alias("id"))))).alias("pos", "e"))
    rows = lambda d, r: d.select("video_id", "id", F.struct(F.lit(r).alias("r"), "start_ms", "text").alias("x"))
    known = rows(lines, 0).unionByName(rows(texts, 1)).groupBy("video_id", "id").agg(F.max("x").alias("x"))
    return ids.select("video_id", "scene", "pos", "e.label", "e.id").join(known, ["video_id", "id"]).select("video_id", "scene", "pos", "label", "id", "x.start_ms", "x.text")


# How the tools' rows, the labels of sources and the rest of the tools' texts are written.
LINES = {
    "search_moments": "- %s [%s] (score %s) %s",
    "find_scenes_by_tag": "- scene %s [%s] %s (score %s) evidence: %s",
    "get_range": {"scene": "- scene %s [%s] %s: %s", "says": "- says [%s] %s", "on screen": '- on screen [%s] "%s"'},
    "search_dialogue": '- %s [%s] "%s" (match %s)',
    "get_chapter_summaries": "- chapter %s [%s] %s: %s",
    "get_characters": "- %s: scenes %s [%s]%s",
}
LABELS = {"search_moments": "%s: %s", "find_scenes_by_tag": "scene %s: %s", "get_range": "scene %s: %s", "search_dialogue": '%s: "%s"', "get_chapter_summaries": "chapter %s: %s"}
NAMED, MAIN, MAIN_NONE, PEOPLE = ", named in %s lines", "- {} ({}): {}", "- (none)", ("main characters (from the summary):", "people listed per scene:")
NO_LINE, NO_SCENE, NOTHING, WINDOW = "(no matching line)", "(no scenes tagged {})", "(nothing in this window, which may lie outside the video)", "Window {}-{}"
SUMMARY = ("type", "genres", "logline", "plot", "ending", "setting", "tone", "themes", "characters", "tag share of scenes")
CUT = "\n(… cut)"
#: Characters of a text in a line, and in a label.
IN_LINE, IN_LABEL = 300, 90


def _write(form: str, *values) -> Column:
    return F.format_string(form, *[F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")) for v in values])


def told(action: str, rows: DataFrame) -> DataFrame:
    """place, line, start_ms, end_ms, label of a tool's rows; label null for rows that are no source."""
    at = span(F.col("start_ms"), F.col("end_ms"))
    begins = fmt(F.col("start_ms")) if "start_ms" in rows.columns else F.lit("")
    text = F.col("text") if "text" in rows.columns else F.lit("")
    title = F.col("title") if "title" in rows.columns else F.lit("")
    score = F.format_string("%.2f", F.col("score").cast("double")) if "score" in rows.columns else F.lit("")
    short = F.substring(text, 1, IN_LABEL)
    if action == "search_moments":
        line, named = (("kind", at, score, F.substring(text, 1, IN_LINE)), ("kind", short))
    elif action == "find_scenes_by_tag":
        line, named = (("scene", at, title, score, "evidence"), ("scene", title))
    elif action == "search_dialogue":
        line, named = (("source", begins, text, score), ("source", short))
    elif action == "get_chapter_summaries":
        line, named = (("chapter", at, title, "summary"), ("chapter", title))
    elif action == "get_characters":
        rows = rows.withColumns({"start_ms": F.col("first_ms"), "end_ms": F.col("last_ms")})
        listed = F.array_join(F.transform("scenes", lambda x: x.cast("string")), ", ")
        line, named = (("name", listed, at, F.when(F.col("mentions") > 0, _write(NAMED, "mentions"))), None)
    elif action == "get_range":
        forms, scene = LINES[action], F.col("kind") == "scene"
        whole = F.when(scene, _write(forms["scene"], "id", at, title, text))
        for kind in ("says", "on screen"):
            whole = whole.when(F.col("kind") == kind, _write(forms[kind], begins, text))
        return rows.select("place", whole.alias("line"), "start_ms", "end_ms", F.when(scene, _write(LABELS[action], "id", title)).alias("label"))
    else:
        raise ValueError(f"unknown tool {action!r}")
    label = F.lit(None).cast("string") if named is None else _write(LABELS[action], *named)
    return rows.select("place", _write(LINES[action], *line).alias("line"), "start_ms", "end_ms", label.alias("label"))


class Toolbox:
    """The seven tools over one video's tables, each returning (text, evidence times, items) for the question loop."""

    def __init__(self, tables: dict[str, DataFrame], video_id, embed=None, s: Settings = DEFAULTS):
        self.t = {k: d.filter(F.col("video_id") == video_id) for k, d in tables.items()}
        self.video_id, self.embed, self.s = video_id, embed, s

    def tools(self) -> dict:
        return {k: getattr(self, k) for k in ("search_moments", "search_dialogue", "find_scenes_by_tag", "get_range", "get_movie_summary", "get_chapter_summaries", "get_characters")}

    def _tell(self, action: str, rows: DataFrame, head: tuple[str, ...] = (), none: str = "") -> tuple[str, list[int], list[tuple]]:
        found = told(action, rows).orderBy("place").collect()  # a screenful
        lines = [*head, *[r.line for r in found]] or [none]
        times = [t for r in found for t in (r.start_ms, r.end_ms)]
        return "\n".join([*lines, *([none] if head and not found and none else [])]), times, [(r.label, r.start_ms, r.end_ms) for r in found if r.label is not None]

    def search_moments(self, query: str):
        from timeloom.operators.retrieval import search_moments

        return self._tell("search_moments", place(search_moments(self.t["items"], query, self.embed(query), k=8, s=self.s), F.desc("score"), "pos"))

    def search_dialogue(self, query: str):
        from timeloom.operators.retrieval import search_dialogue

        found = search_dialogue(spoken_and_shown(self.t["dialogue"], self.t["on_screen_text"]), query)
        return self._tell("search_dialogue", place(found, F.desc("score"), "start_ms", "id"), none=NO_LINE)

    def find_scenes_by_tag(self, tag: str):
        from timeloom.operators.retrieval import find_by_tag

        found = find_by_tag(self.t["scenes"], self.t["tag_scores"], tag).withColumn("evidence", F.try_element_at("tag_evidence", F.lit(tag)))
        return self._tell("find_scenes_by_tag", place(found, F.desc("score"), "scene"), none=NO_SCENE.format(tag))

    def get_range(self, start_ms: int, end_ms: int):
        end_ms = end_ms if end_ms > start_ms else start_ms + 1000
        clock = lambda ms: f"{ms // 3600000}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}" if ms >= 3600000 else f"{ms // 60000}:{ms // 1000 % 60:02d}"
        rows = range_facts(self.t["scenes"], self.t["dialogue"], self.t["on_screen_text"], start_ms, end_ms, self.s)
        text, times, items = self._tell("get_range", rows, (WINDOW.format(clock(max(start_ms, 0)), clock(max(end_ms, 0))),), NOTHING)
        return text, [*times, start_ms, end_ms], items

    def get_movie_summary(self):
        r = movie_summary(self.t["profiles"], self.video_id).first()
        genres = "; ".join(f"{g.genre} {g.confidence} ({g.evidence})" for g in r.genres or ())
        who = "; ".join(f"{c.name} ({c.role})" for c in r.characters or ())
        share = ", ".join(f"{t} {int(v * 100)}%" for t, v in sorted((r.tag_stats or {}).items(), key=lambda x: -x[1]))
        facts = (r.video_type, genres, r.logline, r.plot, r.ending, r.setting, r.tone, ", ".join(r.themes or ()), who, share)
        return "\n".join(f"{k}: {v}" for k, v in zip(SUMMARY, facts, strict=True)), [], []

    def get_chapter_summaries(self, start_ms: int | None = None, end_ms: int | None = None):
        return self._tell("get_chapter_summaries", chapter_summaries(self.t["chapters"], start_ms, end_ms))

    def get_characters(self):
        main = [MAIN.format(r.name, r.role, r.description) for r in main_characters(self.t["profiles"]).orderBy("place").collect()]
        head = (PEOPLE[0], *(main or [MAIN_NONE]), PEOPLE[1])
        return self._tell("get_characters", appearances(self.t["scenes"], self.t["dialogue"], self.t["on_screen_text"]), head)


def observation(text: Column, s: Settings = DEFAULTS) -> Column:
    """A tool's text as the model is told it."""
    return cut_text(text, s.observation_chars, CUT)
