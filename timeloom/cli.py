"""A thin command line over a root of tables: python -m timeloom.cli ROOT COMMAND [ARGUMENTS]. Exit codes: 0, 1 for errors, 130 if interrupted."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.text import tags_present
from timeloom.functions.timecode import fmt, fmt_hours
from timeloom.operators import answers, grounding, retrieval
from timeloom.plans import agent
from timeloom.plans.agent import parse_ms
from timeloom.plans.prompts import scene_list
from timeloom.session import session
from timeloom.sources.artifacts import list_videos, read_table


def _ms(text: str) -> int:
    if (ms := parse_ms(text)) is None:
        raise argparse.ArgumentTypeError(f"not a time: {text}")
    return ms


def _clock(c: str) -> F.Column:
    return fmt_hours(F.col(c))


def _or_dash(c) -> F.Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise("-")


def _unfold(d: DataFrame, lines: list[F.Column], *order: str) -> DataFrame:
    """A row's lines one under the other; null lines aren't printed."""
    return d.select(*order, F.posexplode(F.array(*lines)).alias("__n", "line")).filter("line is not null").orderBy(*order, "__n").select("line")


def _info(t, a) -> DataFrame:
    return t("media").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("line"))


def _chunks(t, a) -> DataFrame:
    stages = F.array_join(F.sort_array(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    line = F.format_string("%s  %s to %s  (read %s to %s)  %s", "id", _clock("core_start_ms"), _clock("core_end_ms"), _clock("start_ms"), _clock("end_ms"), _or_dash(stages))
    return t("chunks").orderBy("index").select(line.alias("line"))


def _shots(t, a) -> DataFrame:
    frames = F.array_join(F.transform("keyframes", lambda k: k.cast("string")), ", ")
    return t("shots").orderBy("shot").select(F.format_string("%4d  %s to %s  %.1f s  frames: %s", "shot", _clock("start_ms"), _clock("end_ms"), (F.col("end_ms") - F.col("start_ms")) / 1000, _or_dash(frames)).alias("line"))


def _captions(t, a) -> DataFrame:
    text = F.when(F.coalesce("on_screen_text", F.lit("")) != "", F.concat(F.lit("   reads: "), F.col("on_screen_text")))
    more = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"   {name}: "), c)) for name, c in (("place", F.col("setting")), ("mood", F.col("mood")), ("objects", F.array_join("objects", ", ")))]
    failed = F.col("error").isNotNull()
    says = F.when(failed, F.concat(F.lit("   failed: "), F.col("error"))).otherwise(F.concat(F.lit("   "), F.col("caption")))
    return _unfold(t("captions"), [F.format_string("[%s] %s", fmt(F.col("ts_ms")), "file"), says, *[F.when(~failed, c) for c in (text, *(more if a.full else ()))]], "ts_ms", "file")


def _scene(t, a) -> DataFrame:
    d = t("scenes").filter(F.col("scene") == a.number)
    if (own := d.first()) is None:
        raise ValueError(f"there is no scene {a.number}")
    good = F.col("error").isNull()
    tags = F.sort_array(F.transform(F.map_entries(tags_present(F.col("tags"))), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    lines = [
        F.format_string("Scene %d, %s to %s: %s", "scene", _clock("start_ms"), _clock("end_ms"), _or_dash(F.col("title"))),
        F.when(~good, F.concat(F.lit("failed: "), F.col("error"))).otherwise(F.col("description")),
        *[F.when(good, F.concat(F.lit(f"{name}: "), _or_dash(c))) for name, c in (("people", F.array_join("characters", "; ")), ("place", F.col("location")), ("time", F.col("time_of_day")), ("mood", F.col("mood")), ("events", F.array_join("events", "; ")))],
        F.when(good, F.concat(F.lit("tags: "), _or_dash(F.array_join(F.transform(tags, lambda x: F.format_string("%s %.1f", x["k"], -x["v"])), ", ")))),
    ]
    inside = lambda name: t(name).filter((F.col("start_ms") < own.end_ms) & (F.col("end_ms") > own.start_ms))
    told = d.select(F.posexplode(F.array(*lines)).alias("k", "line")).filter("line is not null").select("line", F.col("k").cast("bigint").alias("k"), F.lit(0).alias("part"))
    for n, (name, word) in enumerate((("dialogue", "says"), ("on_screen_text", "reads")), 1):
        more = inside(name).select(F.format_string(f"{word} [%s] %s", fmt(F.col("start_ms")), "text").alias("line"), F.col("start_ms").alias("k"), F.lit(n).alias("part"))
        told = told.unionByName(more)
    return told.orderBy("part", "k", "line").select("line")


def _profile(t, a) -> DataFrame:
    name = lambda c, f: F.array_join(F.transform(c, f), "; ")
    parts = (
        ("kind", F.col("video_type")), ("genres", name("genres", lambda g: F.format_string("%s %.1f (%s)", g["genre"], g["confidence"], g["evidence"]))), ("in a line", F.col("logline")), ("setting", F.col("setting")), ("tone", F.col("tone")),
        ("themes", F.array_join("themes", ", ")), ("plot", F.col("plot")), ("ending", F.col("ending")), ("people", name("characters", lambda c: F.concat_ws(", ", c["name"], c["role"], c["description"]))),
        ("tags", name(F.sort_array(F.map_entries("tag_stats")), lambda e: F.format_string("%s %d%%", e["key"], F.floor(e["value"] * 100)))),
    )
    failed = F.col("error").isNotNull()
    return _unfold(t("profiles"), [F.when(failed, F.concat(F.lit("failed: "), F.col("error"))), *[F.when(~failed, F.concat(F.lit(f"{k}: "), _or_dash(c))) for k, c in parts]], "video_id")


def _models(a: argparse.Namespace):
    """The module named by --models: embed(text) -> list of floats, and text_model()."""
    if not a.models:
        raise ValueError("name a module with embed() and text_model() by --models")
    return importlib.import_module(a.models)


def _search(t, a) -> DataFrame:
    found = retrieval.search_moments(t("items"), a.text, _models(a).embed(a.text), a.top, [a.kind] if a.kind else None)
    return answers.told("search_moments", answers.place(found, F.desc("score"), "pos")).orderBy("place").select("line")


def _ask(t, a) -> DataFrame:
    """Events of the question loop as they come, on the way; the answer's lines as rows."""
    spark, models = SparkSession.getActiveSession(), _models(a)
    names = ("scenes", "dialogue", "on_screen_text", "items", "tag_scores", "profiles", "chapters")
    tools = answers.Toolbox({n: t(n) for n in names}, a.video, models.embed).tools()
    plan = plan_for(spark, a.text)
    for kind, data in agent.ask_events(a.text, plan, tools, models.text_model(), spark=spark):
        if kind == "step":
            print(f"... {agent.described(data)}", flush=True)
        elif kind == "error":
            raise ValueError(data["message"])
        elif kind == "answer":
            lines = [data["answer"], *[f"source: {s['label']} [{agent.clock(s['start_ms'])}]" for s in data["sources"]], *[f"not borne out: {agent.clock(m)}" for m in data["unverified_ms"]]]
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").orderBy("k").select("line")


def plan_for(spark: SparkSession, question: str) -> list[dict]:
    """The calls that a question's wording asks for."""
    row = spark.createDataFrame([(question,)], "question string").select(grounding.route(F.col("question")).alias("calls")).first()
    return [{k: v for k, v in call.asDict().items() if v is not None} for call in row.calls]


SHOWN = {"info": _info, "chunks": _chunks, "shots": _shots, "captions": _captions, "scene": _scene, "profile": _profile, "search": _search, "ask": _ask}


def lines_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A table with the column `line`, in the order to print."""
    t = lambda name: read_table(spark, a.root, name).filter(F.col("video_id") == a.video)
    if a.command == "list":
        return list_videos(read_table(spark, a.root, "media")).select(F.col("video_id").alias("line"))
    if a.command == "scenes":
        return scene_list(t("scenes")).orderBy("scene").select("line")
    if a.command == "chapters":
        d = answers.chapter_summaries(t("chapters"), a.start, a.end).orderBy("place")
        return d.select(F.format_string("%3d  %s-%s  %s", "chapter", fmt_hours(F.col("start_ms")), fmt_hours(F.col("end_ms")), F.coalesce("title", F.lit(""))).alias("line"))
    if a.command == "transcript":
        mark = F.when(F.col("reliable"), " ").otherwise("?")
        return t("dialogue").orderBy("start_ms", "id").select(F.concat(F.lit("["), fmt(F.col("start_ms")), F.lit("] "), mark, F.lit(" "), F.col("text")).alias("line"))
    if a.command in SHOWN:
        return SHOWN[a.command](t, a)
    if a.command == "range":
        d = answers.told("get_range", answers.range_facts(t("scenes"), t("dialogue"), t("on_screen_text"), a.start, a.end))
    elif a.command == "say":
        found = retrieval.search_dialogue(answers.spoken_and_shown(t("dialogue"), t("on_screen_text")), a.text)
        d = answers.told("search_dialogue", answers.place(found, F.desc("score"), "start_ms", "id"))
    else:
        found = retrieval.find_by_tag(t("scenes"), t("tag_scores"), a.text).withColumn("evidence", F.try_element_at("tag_evidence", F.lit(a.text)))
        d = answers.told("find_scenes_by_tag", found)
    return d.orderBy("place").select("line")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="timeloom")
    p.add_argument("root")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("list", "scenes", "chapters", "transcript", "range", "say", "tag", *SHOWN):
        c = commands.add_parser(name)
        if name != "list":
            c.add_argument("video")
        if name in ("say", "tag", "search", "ask"):
            c.add_argument("text")
        if name in ("search", "ask"):
            c.add_argument("--models")
        if name == "search":
            c.add_argument("--top", type=int, default=10)
            c.add_argument("--kind")
        if name == "scene":
            c.add_argument("number", type=int)
        if name == "captions":
            c.add_argument("--full", action="store_true")
        if name in ("range", "chapters"):
            need = None if name == "range" else "?"
            c.add_argument("start", type=_ms, nargs=need)
            c.add_argument("end", type=_ms, nargs=need)
    a = p.parse_args(args)
    try:
        for row in lines_of(SparkSession.getActiveSession() or session("local[*]"), a).toLocalIterator():
            print(row.line)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - told in one line
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
