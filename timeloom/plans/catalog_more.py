"""More registered queries: the question tools, what models return, figures of the stages and single functions, each with its DuckDB twin.

Stand-ins are written once, as SQL that both engines read; twins work out the result from their columns, by another way where there is one.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, TAGS
from timeloom.functions import normalise
from timeloom.functions import text as tx
from timeloom.functions import timecode as tc
from timeloom.functions import vectors as vx
from timeloom.operators import aggregates as ag
from timeloom.operators import answers, intervals, retrieval, summaries, windows
from timeloom.operators.folds import plan_chunks
from timeloom.plans import catalog, prompts
from timeloom.plans.catalog import HOUR, IV, WIDE, query, read, spans
from timeloom.sources import artifacts, sinks
from timeloom.streaming import jobs

#: Tables of the stand-in videos, over iv (video_id, id, start_ms, end_ms, kind, value).
_ROWS = {
    "scenes": "SELECT video_id, id AS scene, start_ms, end_ms, 'S' || CAST(id AS STRING) AS title, 'D' || CAST(id AS STRING) AS description, CASE WHEN id % 3 = 0 THEN 'calm' ELSE '' END AS mood, id % 5 = 0 AS graphic, CASE WHEN id % 13 = 0 THEN 'x' END AS error, CAST(id % 10 AS DOUBLE) / 10 AS t1, CAST(id % 7 AS DOUBLE) / 10 AS t2 FROM iv WHERE kind = 'view'",
    "lines": "SELECT video_id, id, start_ms, end_ms, 'line ' || CAST(id AS STRING) AS text, id % 3 <> 0 AS reliable FROM iv WHERE kind = 'click'",
    "texts": "SELECT video_id, id, start_ms, end_ms, 'text ' || CAST(id AS STRING) AS text FROM iv WHERE kind = 'error'",
}
ROWS = "WITH " + IV + "," + ",".join(f"{k} AS ({v})" for k, v in _ROWS.items())
_SET = dataclasses.replace(DEFAULTS, range_lines=5, chapter_quotes=5)


def rows(spark, sf, name):
    d = spans(spark, sf)
    where = _ROWS[name].split(" WHERE ")[1]
    columns = _ROWS[name].removeprefix("SELECT ").split(" FROM iv ")[0]
    d = d.filter(where).selectExpr(*_split(columns))
    if name == "scenes":
        d = d.withColumns({"tags": F.create_map(F.lit("fight"), "t1", F.lit("dream_or_vision"), "t2"), "characters": F.array("title")})
    return d


def _split(columns: str) -> list[str]:
    """Expressions between commas outside brackets."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:k].strip())
            last = k + 1
    return out


def thin_sql(n: int, limit: int) -> str:
    return f"(n <= {limit} OR list_contains([CAST(floor(i * (n / {float(limit)}::DOUBLE)) AS BIGINT) FOR i IN range(0, {limit})], k))"


# ---------------------------------------------------------------- question tools

_FROM, _TO = 1_704_200_000_000, 1_705_200_000_000
_IN = f"start_ms < {_TO} AND end_ms > {_FROM}"
_FACTS = f"""{ROWS},
l AS (SELECT *, count(*) OVER w2 AS n, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) - 1 AS k FROM lines WHERE {_IN} WINDOW w2 AS (PARTITION BY video_id)),
t AS (SELECT *, count(*) OVER w2 AS n, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) - 1 AS k FROM texts WHERE {_IN} WINDOW w2 AS (PARTITION BY video_id)),
f AS (SELECT video_id, 'scene' AS kind, 1 AS r, CAST(scene AS VARCHAR) AS id, start_ms, end_ms, title, description AS text, concat_ws(',', CASE WHEN t1 >= 0.5 THEN 'fight' END, CASE WHEN t2 >= 0.5 THEN 'dream_or_vision' END) AS tags, CAST(NULL AS BOOLEAN) AS reliable
   FROM scenes WHERE error IS NULL AND {_IN}
 UNION ALL SELECT video_id, 'says', 2, CAST(id AS VARCHAR), start_ms, end_ms, NULL, CASE WHEN reliable THEN text ELSE '{tx.MASK}' END, NULL, reliable FROM l WHERE {thin_sql(0, 5)}
 UNION ALL SELECT video_id, 'on screen', 3, CAST(id AS VARCHAR), start_ms, end_ms, NULL, text, NULL, NULL FROM t WHERE {thin_sql(0, 5)}),
facts AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY r, start_ms, id) AS INTEGER) AS place FROM f)"""


def facts(spark, sf):
    return answers.range_facts(*(rows(spark, sf, k) for k in ("scenes", "lines", "texts")), _FROM, _TO, _SET)


@query("range_facts", _FACTS + " SELECT video_id, kind, id, start_ms, end_ms, title, text, tags, reliable, place FROM facts")
def range_facts(spark, sf):
    return facts(spark, sf).select("video_id", "kind", "id", "start_ms", "end_ms", "title", "text", F.array_join("tags", ",").alias("tags"), "reliable", "place")


_CLOCK = lambda c: f"(CASE WHEN {c} // 3600000 > 0 THEN CAST({c} // 3600000 AS VARCHAR) || ':' || lpad(CAST({c} // 60000 % 60 AS VARCHAR), 2, '0') ELSE CAST({c} // 60000 AS VARCHAR) END || ':' || lpad(CAST({c} // 1000 % 60 AS VARCHAR), 2, '0'))"


@query(
    "tool_items",
    _FACTS + f""" SELECT video_id, place, start_ms, end_ms, CASE WHEN kind = 'scene' THEN 'scene ' || id || ': ' || title END AS label,
  CASE kind WHEN 'scene' THEN '- scene ' || id || ' [' || {_CLOCK("start_ms")} || '-' || {_CLOCK("end_ms")} || '] ' || title || ': ' || text
   WHEN 'says' THEN '- says [' || {_CLOCK("start_ms")} || '] ' || text ELSE '- on screen [' || {_CLOCK("start_ms")} || '] "' || text || '"' END AS line FROM facts""",
)
def tool_items(spark, sf):
    d = facts(spark, sf)
    return d.select("video_id", "place").join(answers.told("get_range", d.withColumn("place", F.struct("video_id", "place"))).select("place.*", "line", "start_ms", "end_ms", "label"), ["video_id", "place"])


@query("chapter_summaries", ROWS + f", c AS (SELECT video_id, scene, start_ms FROM scenes WHERE {_IN}) SELECT video_id, scene AS chapter, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, scene) AS INTEGER) AS place FROM c")
def chapter_summaries(spark, sf):
    return answers.chapter_summaries(rows(spark, sf, "scenes").withColumnRenamed("scene", "chapter"), _FROM, _TO).select("video_id", "chapter", "place")


@query("open_windows", ROWS + f", x AS (SELECT id, start_ms < {_TO} AS before, end_ms > {_FROM} AS after FROM lines) SELECT 'before' AS bound, id FROM x WHERE before UNION ALL SELECT 'after', id FROM x WHERE after UNION ALL SELECT 'none', id FROM x")
def open_windows(spark, sf):
    d = rows(spark, sf, "lines")
    parts = [intervals.in_window(d, *w).select(F.lit(name).alias("bound"), "id") for name, w in (("before", (None, _TO)), ("after", (_FROM, None)), ("none", (None, None)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CONV = r"""c AS (SELECT conv_id AS video_id, turn AS scene, turn * 1000 AS start_ms, turn * 1000 + 900 AS end_ms, text, regexp_extract(text, '^([\p{L}\p{N}_]+)', 1) AS one, regexp_extract(text, '^([\p{L}\p{N}_]+ [\p{L}\p{N}_]+)', 1) AS two FROM conversations),
names AS (SELECT video_id, scene, start_ms, end_ms, unnest([one, two]) AS name FROM c),
per AS (SELECT video_id, lower(name) AS key, arg_min(name, {'s': scene, 'k': start_ms, 'n': name}) AS name, count(*) AS n_scenes, array_to_string(list_sort(list(scene)), ',') AS scenes, arg_min(start_ms, {'s': scene, 'k': start_ms}) AS first_ms, max(end_ms) AS last_ms FROM names WHERE trim(name) <> '' GROUP BY 1, 2),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY n_scenes DESC, first_ms, key) AS INTEGER) AS place FROM per),
said AS (SELECT video_id, 'a' || CAST(scene AS VARCHAR) AS id, lower(text) AS line FROM c WHERE scene % 3 <> 0 UNION ALL SELECT video_id, 'b' || CAST(scene AS VARCHAR), lower(text) FROM c WHERE scene % 2 = 0)"""


@query(
    "characters_answer",
    rf"""WITH {_CONV} SELECT t.video_id, t.key, t.name, t.n_scenes, t.scenes, t.first_ms, t.last_ms, t.place, count(s.id) AS mentions FROM top t LEFT JOIN said s ON s.video_id = t.video_id
  AND regexp_matches(s.line, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(t.key) || '($|[^\p{{L}}\p{{N}}_])') WHERE t.place <= 20 GROUP BY ALL""",
)
def characters_answer(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("scene"), F.col("turn").alias("id"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), "text")
    word = r"[\p{L}\p{N}_]+"
    scenes = c.select("video_id", "scene", "start_ms", "end_ms", F.lit(None).cast("string").alias("error"), F.array(F.regexp_extract("text", f"^({word})", 1), F.regexp_extract("text", f"^({word} {word})", 1)).alias("characters"))
    return answers.appearances(scenes, c.withColumn("reliable", F.col("scene") % 3 != 0), c.filter("scene % 2 = 0")).withColumn("scenes", F.array_join("scenes", ","))


@query(
    "chapter_quotes",
    ROWS + f""", ch AS (SELECT video_id, min(start_ms) + i * {72 * HOUR} AS start_ms, min(start_ms) + (i + 1) * {72 * HOUR} AS end_ms, i AS chapter FROM iv, range(0, 6) r(i) GROUP BY video_id, i),
q AS (SELECT video_id, 'says' AS source, 0 AS r, CAST(id AS VARCHAR) AS id, start_ms, (start_ms + end_ms) // 2 AS mid FROM lines WHERE reliable UNION ALL SELECT video_id, 'on screen', 1, CAST(id AS VARCHAR), start_ms, (start_ms + end_ms) // 2 FROM texts),
j AS (SELECT q.*, chapter, count(*) OVER (PARTITION BY q.video_id, chapter) AS n, row_number() OVER (PARTITION BY q.video_id, chapter ORDER BY q.start_ms, r, id) - 1 AS k FROM q JOIN ch ON ch.video_id = q.video_id AND ch.start_ms <= mid AND mid < ch.end_ms)
SELECT video_id, chapter, source, id, start_ms FROM j WHERE {thin_sql(0, 5)}""",
)
def chapter_quotes(spark, sf):
    zero = spans(spark, sf).groupBy("video_id").agg(F.min("start_ms").alias("zero"))
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))
    chapters = zero.withColumn("chapter", i).select("video_id", "chapter", (F.col("zero") + F.col("chapter") * 72 * HOUR).alias("start_ms"), (F.col("zero") + (F.col("chapter") + 1) * 72 * HOUR).alias("end_ms"))
    return answers.chapter_quotes(chapters, rows(spark, sf, "lines"), rows(spark, sf, "texts"), _SET, 24 * HOUR).select("video_id", "chapter", "source", "id", "start_ms")


@query(
    "title_card_texts",
    ROWS + """, j AS (SELECT s.video_id, s.scene, CAST(t.id AS VARCHAR) AS id, t.text, CAST(row_number() OVER (PARTITION BY s.video_id ORDER BY s.scene, t.start_ms, t.id) AS INTEGER) AS place FROM scenes s JOIN texts t ON s.video_id = t.video_id AND s.graphic AND s.start_ms <= t.start_ms AND t.start_ms < s.end_ms)
SELECT video_id, scene, id, text, place FROM j WHERE place <= 10""",
)
def title_card_texts(spark, sf):
    return answers.title_card_texts(rows(spark, sf, "scenes"), rows(spark, sf, "texts"), 10, 2 * HOUR).withColumn("id", F.col("id").cast("string"))


@query(
    "evidence_rows",
    ROWS + """, e AS (SELECT video_id, scene, 'says' AS label, scene + 1 AS id, 0 AS pos FROM scenes UNION ALL SELECT video_id, scene, 'says', scene + 2, 1 FROM scenes UNION ALL SELECT video_id, scene, 'text', scene + 3, 2 FROM scenes),
b AS (SELECT video_id, id, start_ms, text FROM lines UNION ALL SELECT video_id, id, start_ms, text FROM texts) SELECT e.video_id, scene, pos, label, id, start_ms, text FROM e JOIN b USING (video_id, id)""",
)
def evidence_rows(spark, sf):
    s = rows(spark, sf, "scenes").select("video_id", "scene", F.array(F.col("scene") + 1, F.col("scene") + 2).alias("dialogue_ids"), F.array(F.col("scene") + 3).alias("text_ids"))
    return answers.evidence_rows(s, rows(spark, sf, "lines"), rows(spark, sf, "texts"))


@query(
    "build_items",
    ROWS + """, last AS (SELECT video_id, max({'e': end_ms, 's': scene}) AS m FROM scenes GROUP BY 1),
p AS (SELECT video_id, 'dialogue' AS kind, 1 AS r, CAST(id AS VARCHAR) AS ref, start_ms, end_ms, text FROM lines WHERE reliable UNION ALL SELECT video_id, 'text', 2, CAST(id AS VARCHAR), start_ms, end_ms, text FROM texts),
j AS (SELECT p.video_id, p.kind, p.r, p.ref, p.start_ms, p.end_ms, p.text, coalesce(s.scene, CASE WHEN (p.start_ms + p.end_ms) // 2 >= m.e THEN m.s END) AS scene FROM p LEFT JOIN scenes s ON s.video_id = p.video_id AND s.start_ms <= (p.start_ms + p.end_ms) // 2 AND (p.start_ms + p.end_ms) // 2 < s.end_ms LEFT JOIN last l ON l.video_id = p.video_id),
u AS (SELECT video_id, 'scene' AS kind, 0 AS r, CAST(scene AS VARCHAR) AS ref, start_ms, end_ms, description AS text, scene FROM scenes WHERE error IS NULL UNION ALL BY NAME SELECT * FROM j)
SELECT video_id, kind || ':' || ref AS id, kind, scene, start_ms, text, ref, row_number() OVER (PARTITION BY video_id ORDER BY r, start_ms, ref, scene NULLS FIRST) - 1 AS pos FROM u""",
)
def build_items(spark, sf):
    """The operator's own positions; scenes of the stand-in overlap, so a line may lie in several and has a position in each."""
    d = retrieval.build_items(rows(spark, sf, "scenes").withColumn("text", F.col("description")), rows(spark, sf, "lines"), rows(spark, sf, "texts"), 2 * HOUR)
    return d.select("video_id", "id", "kind", "scene", "start_ms", "text", "ref", "pos")


# ---------------------------------------------------------------- JSON of models

_V = "least(greatest(value / 300 - 0.1, 0.0), 1.0)"
_SCENE_JSON = """'{"title": "  T' || CAST(event_id AS STRING) || ' ", "characters": ["a", " ", 7, "b ", "c", "d", "e", "f", "g"], "mood": 5, "tags": ' ||
 CASE WHEN event_id % 3 = 0 THEN '{"fight": ' || CAST(value / 300 - 0.1 AS STRING) || ', "nope": 1}'
 ELSE '[{"tag": "fight", "confidence": ' || CAST(value / 300 - 0.1 AS STRING) || ', "evidence": "e1"}, {"tag": "fight", "confidence": "0.4", "evidence": "e2"}, {"tag": "sad", "confidence": 1, "evidence": " "}, {"tag": "chase", "confidence": "x", "evidence": "e"}, {"tag": "death", "evidence": "no number"}, 4]' END
 || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END"""


@query(
    "scene_json",
    f"""WITH e AS (SELECT event_id AS id, event_id % 11 <> 0 AS valid, event_id % 3 = 0 AS m, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN {_V} ELSE greatest({_V}, 0.4) END AS fight, {_V} AS v FROM events)
SELECT id, valid, CASE WHEN valid THEN 'T' || CAST(id AS VARCHAR) ELSE '' END AS title, CASE WHEN valid THEN 'a,b,c,d,e,f' ELSE '' END AS characters, '' AS mood, 'unknown' AS time_of_day, round(fight, 2) AS fight, 0.0 AS sad, {len(TAGS)} AS n_tags,
 CASE WHEN NOT valid THEN '' WHEN m THEN 'fight=' WHEN v >= 0.4 THEN 'death=no number,fight=e1' ELSE 'death=no number,fight=e2' END AS reasons FROM e""",
)
def scene_json(spark, sf):
    d = normalise.fields(read(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_SCENE_JSON).alias("j")), "j", normalise.scene, ["id"])
    reasons = F.array_join(F.sort_array(F.transform(F.map_entries("tag_evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return d.select("id", "valid", "title", F.array_join("characters", ",").alias("characters"), "mood", "time_of_day", F.col("tags")["fight"].alias("fight"), F.col("tags")["sad"].alias("sad"), F.size("tags").alias("n_tags"), reasons.alias("reasons"))


#: The words of a turn, in SQL of either engine.
_WORDS_SPARK = "filter(split(translate(text, '\\n\\t', '  '), ' '), w -> w <> '')"
_WORDS_DUCK = "list_filter(string_split(replace(replace(text, chr(10), ' '), chr(9), ' '), ' '), lambda w: w <> '')"


@query(
    "frame_json",
    f"""WITH d AS (SELECT conv_id, turn, text, {_WORDS_DUCK} AS w FROM conversations)
SELECT conv_id, turn, trim(text, ' ') AS caption, CASE WHEN turn % 2 = 0 THEN w[1] ELSE '' END AS on_screen_text, CASE WHEN turn % 3 = 0 THEN 'night' ELSE 'unknown' END AS time_of_day,
 array_to_string(list_transform(w[1:6], lambda x: x || '/' || CASE WHEN turn % 2 = 0 THEN x ELSE '' END || '/'), ',') AS people, array_to_string(w[1:8], ',') AS objects, '' AS shot_type FROM d""",
)
def frame_json(spark, sf):
    """Frames told in the words of turns: people with and without an action, numbers and texts among them, more than are kept."""
    d = read(spark, sf, "conversations").withColumn("w", F.expr(_WORDS_SPARK))
    even = F.col("turn") % 2 == 0
    people = F.transform("w", lambda x: F.struct(F.concat(F.lit(" "), x).alias("description"), F.when(even, x).alias("action"), F.lit("  ").alias("expression")))
    day = F.when(F.col("turn") % 3 == 0, "night ").when(F.col("turn") % 3 == 1, " ")
    j = F.to_json(F.struct(F.concat(F.lit(" "), F.col("text")).alias("caption"), F.when(even, F.get("w", F.lit(0))).alias("on_screen_text"), people.alias("people"), day.alias("time_of_day"), F.col("w").alias("objects"), F.array(F.lit("wide")).alias("shot_type")))
    j = F.replace(F.replace(j, F.lit('"people":['), F.lit('"people":["odd",3,null,[{}],')), F.lit('"objects":['), F.lit('"objects":[7,"",{},'))
    x = normalise.fields(d.select("conv_id", "turn", j.alias("j")), "j", normalise.frame, ["conv_id", "turn"])
    told = F.array_join(F.transform("people", lambda p: F.concat_ws("/", p["description"], p["action"], p["expression"])), ",")
    return x.select("conv_id", "turn", "caption", "on_screen_text", "time_of_day", told.alias("people"), F.array_join("objects", ",").alias("objects"), "shot_type")


_PROFILE_JSON = """'{"video_type": "' || CASE WHEN event_id % 2 = 0 THEN 'trailer' ELSE 'film' END || '", "genres": [{"genre": "drama", "confidence": 0.4, "evidence": "d"}, {"genre": "war", "confidence": ' || CAST(value / 300 AS STRING) || ', "evidence": "w"},
 {"genre": "war", "confidence": 1, "evidence": "again"}, {"genre": "poem", "confidence": 1, "evidence": "p"}, {"genre": "music", "confidence": 1, "evidence": ""}], "themes": ["x", "y"], "plot": " P ", "characters": [{"name": "N", "role": 1}, {"role": "nobody"}]}'"""


@query(
    "profile_json",
    "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'trailer' ELSE 'other' END AS video_type, CASE WHEN least(value / 300, 1.0) > 0.4 THEN 'war,drama' ELSE 'drama,war' END AS genres, round(least(value / 300, 1.0), 2) AS war, 'P' AS plot, 'x,y' AS themes, 'N/' AS characters FROM events",
)
def profile_json(spark, sf):
    d = normalise.fields(read(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_PROFILE_JSON).alias("j")), "j", normalise.profile, ["id"])
    war = F.get(F.filter("genres", lambda g: g["genre"] == "war"), F.lit(0))["confidence"]
    return d.select("id", "video_type", F.array_join(F.transform("genres", lambda g: g["genre"]), ",").alias("genres"), war.alias("war"), "plot", F.array_join("themes", ",").alias("themes"), F.array_join(F.transform("characters", lambda c: F.concat_ws("/", c["name"], c["role"])), ",").alias("characters"))


@query(
    "chapter_json",
    f"""WITH d AS (SELECT conv_id, turn, text, {_WORDS_DUCK} AS w, turn % 5 <> 4 AS valid FROM conversations)
SELECT conv_id, turn, valid, CASE WHEN valid AND turn % 5 <> 3 THEN w[1] ELSE '' END AS title, CASE WHEN valid THEN trim(text, ' ') ELSE '' END AS summary, CASE WHEN valid THEN array_to_string(w[1:8], ',') ELSE '' END AS events,
 CASE WHEN valid AND turn % 5 <> 2 THEN array_to_string(w[3:7], ',') ELSE '' END AS locations, '' AS mood FROM d""",
)
def chapter_json(spark, sf):
    """Chapters told in the words of turns: titles that are numbers, places that are no list, blanks and numbers among events, and replies cut off."""
    d = read(spark, sf, "conversations").withColumn("w", F.expr(_WORDS_SPARK))
    pad = F.transform("w", lambda x: F.concat(F.lit(" "), x, F.lit("  ")))
    events = F.flatten(F.transform(pad, lambda x: F.array(F.lit(" "), x)))
    told = F.to_json(F.struct(F.concat(F.lit("  "), F.get("w", F.lit(0))).alias("title"), F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("summary"), events.alias("events"), F.slice("w", 3, 9).alias("locations")))
    told = F.when(F.col("turn") % 5 == 3, F.regexp_replace(told, '"title":"[^"]*"', '"title":17')).when(F.col("turn") % 5 == 2, F.regexp_replace(told, '"locations":', '"locations":"none","other":')).otherwise(told)
    told = F.when(F.col("turn") % 5 == 4, F.substr(told, F.lit(1), F.length(told) - 1)).otherwise(told)
    x = normalise.fields(d.select("conv_id", "turn", told.alias("j")), "j", normalise.chapter, ["conv_id", "turn"])
    return x.select("conv_id", "turn", "valid", "title", "summary", F.array_join("events", ",").alias("events"), F.array_join("locations", ",").alias("locations"), "mood")


#: Texts of the conversations, with quotes and line feeds, as both engines read them.
_SAID = "replace(text, ',', '\"')"


@query(
    "tolerant_json",
    f"SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN {_SAID} END AS x, CASE WHEN turn % 4 = 1 THEN conv_id END AS n, turn % 4 <> 3 AS valid FROM conversations",
)
def tolerant_json(spark, sf):
    """Whole objects, with raw line feeds and tabs in strings; lists, which have no fields; texts that end too early."""
    escaped = F.replace(F.expr(_SAID), F.lit('"'), F.lit('\\"'))
    whole = F.concat(F.lit('\t{"x":\n"'), escaped, F.lit('", "n": '), F.when(F.col("turn") % 4 == 1, F.col("conv_id").cast("string")).otherwise('"none"'), F.lit("}"))
    cut = F.substr(whole, F.lit(1), (F.length(whole) - 1 - F.col("conv_id") % 9).cast("int"))
    text = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("["), whole, F.lit("]"))).when(F.col("turn") % 4 == 3, cut).otherwise(whole)
    v = normalise.tolerant_json(text)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.try_variant_get(v, "$.x", "string").alias("x"), F.try_variant_get(v, "$.n", "bigint").alias("n"), v.isNotNull().alias("valid"))


# ---------------------------------------------------------------- figures of the stages

@query("stage_summaries", ROWS + """, a AS (SELECT video_id, count(*) AS segments, CAST(sum(id % 4) AS BIGINT) AS words FROM lines GROUP BY 1),
b AS (SELECT video_id, count(*) AS shots, CAST(sum(id % 3) AS BIGINT) AS keyframes, CAST(trunc(avg(end_ms - start_ms)) AS BIGINT) AS avg_shot_ms FROM texts GROUP BY 1),
c AS (SELECT video_id, count(*) AS frames, count(*) FILTER (WHERE id % 5 <> 0) AS with_text, count(*) FILTER (WHERE id % 7 = 0) AS caption_errors, round(avg(CAST(id % 9 AS DOUBLE) / 4), 2) AS avg_seconds FROM texts GROUP BY 1),
d AS (SELECT video_id, count(*) AS scenes, count(error) AS errors, CAST(trunc(avg(end_ms - start_ms)) AS BIGINT) AS avg_scene_ms, max(end_ms) AS duration_ms FROM scenes GROUP BY 1)
SELECT * FROM a JOIN b USING (video_id) JOIN c USING (video_id) JOIN d USING (video_id)""")  # fmt: skip
def stage_summaries(spark, sf):
    lines_, texts_, scenes_ = (rows(spark, sf, k) for k in ("lines", "texts", "scenes"))
    upto = lambda n: F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), n.cast("int"))
    a = summaries.transcript_summary(lines_.withColumn("words", upto(F.col("id") % 4)))
    b = summaries.shots_summary(texts_.withColumn("keyframes", upto(F.col("id") % 3)))
    seconds = (F.col("id") % 9).cast("double") / 4
    c = summaries.captions_summary(texts_.select("video_id", F.when(F.col("id") % 5 != 0, F.col("text")).alias("on_screen_text"), F.when(F.col("id") % 7 == 0, "e").alias("error"), seconds.alias("seconds"))).withColumnRenamed("errors", "caption_errors")
    d = summaries.scenes_summary(scenes_).join(summaries.duration(scenes_, scenes_.select("video_id").distinct()), "video_id")
    return a.join(b, "video_id").join(c, "video_id").join(d, "video_id")


@query(
    "dialogue_rows",
    f"""SELECT event_id AS id, round((CAST(event_id % 10 AS DOUBLE) / 10 + value / 500) / 2, 3) AS word_prob,
 CASE WHEN CAST(event_id % 100 AS DOUBLE) / 100 < {DEFAULTS.min_lang_prob} THEN 'other_language' WHEN -value / 300 < {DEFAULTS.min_logprob} OR round((CAST(event_id % 10 AS DOUBLE) / 10 + value / 500) / 2, 3) < {DEFAULTS.min_word_prob} THEN 'low_confidence' END AS reason FROM events WHERE event_id % 6 <> 0 AND NOT (CAST(event_id % 8 AS DOUBLE) / 8 > 0.6 AND -value / 300 < -1.0)""",
)
def dialogue_rows(spark, sf):
    e = read(spark, sf, "events")
    tenth = (F.col("event_id") % 10).cast("double") / 10
    seg = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 6 == 0, " ").otherwise("said").alias("text"), ((F.col("event_id") % 8).cast("double") / 8).alias("no_speech_prob"), (-F.col("value") / 300).alias("avg_logprob"),
        ((F.col("event_id") % 100).cast("double") / 100).alias("lang_prob"), F.array(F.struct(tenth.alias("prob")), F.struct((F.col("value") / 500).alias("prob")), F.struct(F.lit(None).cast("double").alias("prob"))).alias("words"),
    )
    return summaries.dialogue_rows(seg).select("id", "word_prob", "reason")


@query(
    "subtitled_lines",
    ROWS + f""", s AS (SELECT l.*, EXISTS (SELECT 1 FROM texts t WHERE t.video_id = l.video_id AND l.start_ms < t.end_ms AND t.start_ms < l.end_ms) AS subtitled, CAST(id % 100 AS DOUBLE) / 100 AS lp FROM lines l)
SELECT id, subtitled, reliable AND NOT (subtitled AND lp < {DEFAULTS.subtitled_lang_prob}) AS reliable, CASE WHEN reliable AND subtitled AND lp < {DEFAULTS.subtitled_lang_prob} THEN 'other_language' END AS reason FROM s""",
)
def subtitled_lines(spark, sf):
    d = rows(spark, sf, "lines").withColumns({"lang_prob": (F.col("id") % 100).cast("double") / 100, "reason": F.lit(None).cast("string")})
    return summaries.subtitled_lines(d, rows(spark, sf, "texts"), 2 * HOUR).select("id", "subtitled", "reliable", "reason")


@query(
    "visual_rows",
    r"""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'A logo on black.' ELSE 'A man runs.' END AS description, event_id % 2 = 0 AS graphic, CASE WHEN event_id % 4 <> 0 THEN 'park' END AS setting, CASE WHEN event_id % 3 = 0 THEN 1 END AS n_people, CAST(NULL AS VARCHAR) AS mood FROM events WHERE event_id % 9 <> 0""",
)
def visual_rows(spark, sf):
    person = F.array(F.struct(F.lit("p").alias("description")))
    e = read(spark, sf, "events").select(
        F.col("event_id").alias("video_id"), F.lit(0).alias("ts_ms"), F.lit("f").alias("file"), F.when(F.col("event_id") % 2 == 0, "It shows a logo on black. Overall, the mood is calm.").otherwise("The image shows a man runs.").alias("caption"),
        F.lit(None).cast("array<string>").alias("objects"), F.when(F.col("event_id") % 3 == 0, person).otherwise(F.slice(person, 1, 0)).alias("people"), F.when(F.col("event_id") % 4 != 0, "park").otherwise("").alias("setting"), F.lit("").alias("mood"), F.lit(None).cast("string").alias("shot_type"),
        F.when(F.col("event_id") % 9 == 0, "e").alias("error"),
    )
    return summaries.visual_rows(e).select(F.col("video_id").alias("id"), "description", "graphic", "setting", F.when(F.col("people").isNotNull(), F.size("people")).alias("n_people"), "mood")


@query(
    "shot_evidence",
    catalog.WITH + """, x AS (SELECT s.video_id, s.shot, i.id, i.start_ms, i.end_ms, i.kind FROM shots s JOIN iv i ON i.video_id = s.video_id AND i.start_ms < s.end_ms AND s.start_ms < i.end_ms AND i.kind IN ('click', 'error')),
v AS (SELECT s.video_id, s.shot, bool_and(i.id % 2 = 0) AS graphic FROM shots s JOIN iv i ON i.video_id = s.video_id AND s.start_ms <= i.start_ms AND i.start_ms < s.end_ms AND i.kind = 'view' GROUP BY 1, 2),
a AS (SELECT video_id, shot, count(*) FILTER (WHERE kind = 'click') AS n_lines, count(*) FILTER (WHERE kind = 'error') AS n_texts, min(start_ms) FILTER (WHERE kind = 'click') AS first_talk_ms, max(end_ms) FILTER (WHERE kind = 'click') AS last_talk_ms FROM x GROUP BY 1, 2)
SELECT s.video_id, s.shot, coalesce(n_lines, 0) AS n_lines, coalesce(n_texts, 0) AS n_texts, first_talk_ms, last_talk_ms, coalesce(graphic, false) AS graphic FROM shots s LEFT JOIN a USING (video_id, shot) LEFT JOIN v USING (video_id, shot)""",
)
def shot_evidence(spark, sf):
    e = spans(spark, sf)
    seen = catalog.of_kind(e, "view").select("video_id", F.col("start_ms").alias("ts_ms"), (F.col("id") % 2 == 0).alias("graphic"))
    d = summaries.shot_evidence(catalog.shots(spark, sf), catalog.of_kind(e, "click"), catalog.of_kind(e, "error"), seen, 2 * HOUR)
    return d.select("video_id", "shot", F.size("dialogue_ids").cast("bigint").alias("n_lines"), F.size("text_ids").cast("bigint").alias("n_texts"), "first_talk_ms", "last_talk_ms", "graphic")


@query("best_variant", f"WITH {IV}, r AS (SELECT video_id, kind, CASE WHEN id % 5 = 0 THEN 'Hello, there' WHEN id % 3 = 0 THEN 'hello there!' ELSE 'hello' END AS text, id FROM iv), n AS (SELECT video_id, kind, text, count(*) AS n, min(id) AS pos FROM r GROUP BY 1, 2, 3) SELECT video_id, kind AS id, text FROM n QUALIFY row_number() OVER (PARTITION BY video_id, kind ORDER BY length(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) DESC, n DESC, pos) = 1")
def best_variant(spark, sf):
    text = F.when(F.col("id") % 5 == 0, "Hello, there").when(F.col("id") % 3 == 0, "hello there!").otherwise("hello")
    return ag.best_variant(spans(spark, sf).select("video_id", F.col("kind").alias("id"), text.alias("text"), F.col("id").alias("pos")))


@query("scene_envelope", catalog.WITH + ", g AS (SELECT *, (shot - 1) // 5 AS scene FROM shots) SELECT video_id, scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(shot) AS first, max(shot) AS last, bool_and(kind = 'view') AS graphic, array_to_string(list_sort(list(id)), ',') AS ids FROM g GROUP BY 1, 2")
def scene_envelope(spark, sf):
    d = catalog.shots(spark, sf).withColumns({"scene": F.floor((F.col("shot") - 1) / 5), "graphic": F.col("kind") == "view", "dialogue_ids": F.array("id")})
    return ag.envelope(d, "scene").select("video_id", "scene", "start_ms", "end_ms", "first", "last", "graphic", F.array_join("dialogue_ids", ",").alias("ids"))


@query("mean_histogram", "WITH x AS (SELECT label AS shot, i AS bin, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) SELECT shot, round(sum(v * bin), 6) AS total, count(*) AS bins FROM x GROUP BY 1")
def mean_histogram(spark, sf):
    d = ag.mean_histogram(read(spark, sf, "embeddings").select(F.lit("v").alias("video_id"), F.col("label").alias("shot"), F.transform("embedding", lambda x: x.cast("double")).alias("histogram")))
    total = F.aggregate(F.transform("histogram", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("shot", F.round(total, 6).alias("total"), F.size("histogram").cast("bigint").alias("bins"))


@query(
    "histogram_distance",
    """WITH q AS (SELECT list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS b FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a, b FROM embeddings, q)
SELECT vec_id, round(sqrt(greatest(1 - list_sum(list_transform(range(1, 65), lambda i: sqrt(a[i] * b[i]))) / sqrt(list_sum(a) * list_sum(b)), 0)), 5) AS distance FROM x WHERE vec_id <> 0""",
)
def histogram_distance(spark, sf):
    positive = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    q = F.array(*[F.lit(abs(float(x))) for x in catalog.query_vector(spark, sf)])
    return read(spark, sf, "embeddings").filter("vec_id <> 0").select("vec_id", F.round(vx.histogram_distance(positive("embedding"), q), 5).alias("distance"))


@query("objects_seen", f"WITH {IV}, s AS (SELECT DISTINCT video_id, kind || CAST(id % 9 AS VARCHAR) AS o FROM iv), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY o) AS k FROM s) SELECT video_id, string_agg(o, ',' ORDER BY o) AS objects FROM r WHERE k <= 25 GROUP BY 1")
def objects_seen(spark, sf):
    o = F.array(F.concat("kind", (F.col("id") % 9).cast("string")))
    return summaries.objects_seen(spans(spark, sf).withColumn("objects", o), ["video_id"]).withColumn("objects", F.array_join("objects", ","))


@query("overall_progress", "SELECT event_id AS id, round((event_id % 9 + least(greatest(value / 300 - 0.1, 0.0), 1.0)) / 9, 6) AS overall FROM events")
def overall_progress(spark, sf):
    stage = F.element_at(F.array(*map(F.lit, summaries.STAGES)), (F.col("event_id") % 9 + 1).cast("int"))
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(summaries.overall_progress(stage, F.col("value") / 300 - 0.1), 6).alias("overall"))


# ---------------------------------------------------------------- filters, sets, windows

@query(
    "clip_shots",
    f"WITH {IV}, {catalog._CHUNKS}, w AS (SELECT video_id, id AS chunk_id, greatest(core_start_ms - {WIDE.overlap_ms}, 0) AS s, least(core_end_ms + {WIDE.overlap_ms}, d) AS e, d, zero FROM chunks), x AS (SELECT w.*, iv.id AS row_id, greatest(iv.start_ms - zero, s) AS start_ms, least(iv.end_ms - zero, e) AS end_ms FROM iv JOIN w USING (video_id))"
    " SELECT video_id, chunk_id, row_id, start_ms, end_ms, start_ms = s AND s > 0 AS clipped_start, end_ms = e AND e < d AS clipped_end FROM x WHERE end_ms > start_ms",
)
def clip_shots(spark, sf):
    m = catalog.media(spark, sf)
    c = plan_chunks(m, WIDE).join(m.select("video_id", "duration_ms"), "video_id")
    e = spans(spark, sf).join(m.select("video_id", "zero"), "video_id").select("video_id", F.col("id").alias("row_id"), (F.col("start_ms") - F.col("zero")).alias("start_ms"), (F.col("end_ms") - F.col("zero")).alias("end_ms"))
    # the chunks a span touches: the bucketed join spares the others
    near = intervals.overlap_join(e, c.select("video_id", F.col("id").alias("chunk_id"), "start_ms", "end_ms"), WIDE.chunk_ms)
    d = near.select(F.col("a_video_id").alias("video_id"), F.col("a_row_id").alias("row_id"), F.col("b_chunk_id").alias("chunk_id"), F.col("a_start_ms").alias("start_ms"), F.col("a_end_ms").alias("end_ms"))
    return intervals.clip(d, c).select("video_id", "chunk_id", "row_id", "start_ms", "end_ms", "clipped_start", "clipped_end")


@query("pending_chunks", "SELECT event_id AS id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0)")
def pending_chunks(spark, sf):
    e = read(spark, sf, "events").select(F.lit("v").alias("video_id"), F.col("event_id").alias("id"))
    chunks = e.withColumn("stages", F.create_map(F.lit("caption"), F.when(F.col("id") % 2 == 0, "done").otherwise("running")))
    files = e.filter("id % 3 <> 0").withColumns({"complete": F.lit(True), "model": F.when(F.col("id") % 5 != 0, "m").otherwise("old"), "errors": F.when(F.col("id") % 7 == 0, 2).otherwise(0)})
    return summaries.pending_chunks(chunks, "caption", summaries.caption_outputs(files, "m")).select("id")


@query("valid_names", "SELECT event_id AS id, event_id % 2 = 0 AS valid_id, event_id % 3 < 2 AS valid_file FROM events")
def valid_names(spark, sf):
    e = F.col("event_id")
    name = F.concat(F.lit("a.b/x"), F.when(e % 3 == 0, ".MP4").when(e % 3 == 1, ".mkv").otherwise(".txt"))
    return read(spark, sf, "events").select(e.alias("id"), tx.valid_id(F.concat(F.lit("vid_"), F.when(e % 2 == 0, "x").otherwise("é/"))).alias("valid_id"), tx.valid_file(name).alias("valid_file"))


@query("tags_over", ROWS + " SELECT video_id, scene, concat_ws(',', CASE WHEN t1 >= 0.5 THEN 'fight' END, CASE WHEN t2 >= 0.5 THEN 'dream_or_vision' END) AS over, CASE WHEN t1 >= 0.5 AND t2 >= 0.5 THEN CASE WHEN t2 > t1 THEN 'dream_or_vision,fight' ELSE 'fight,dream_or_vision' END WHEN t1 >= 0.5 THEN 'fight' WHEN t2 >= 0.5 THEN 'dream_or_vision' ELSE '' END AS best FROM scenes")
def tags_over(spark, sf):
    return rows(spark, sf, "scenes").select("video_id", "scene", F.array_join(tx.tags_over(F.col("tags"), 0.5), ",").alias("over"), F.array_join(tx.best_tags(F.col("tags")), ",").alias("best"))


@query(
    "scene_list",
    ROWS + """, t AS (SELECT *, CASE WHEN t1 >= 0.5 AND t2 >= 0.5 AND t1 >= t2 AND NOT t1 = t2 THEN printf('fight %.1f, dream_or_vision %.1f', t1, t2) WHEN t1 >= 0.5 AND t2 >= 0.5 AND t2 > t1 THEN printf('dream_or_vision %.1f, fight %.1f', t2, t1) WHEN t1 >= 0.5 AND t2 >= 0.5 THEN printf('fight %.1f, dream_or_vision %.1f', t1, t2)
  WHEN t1 >= 0.5 THEN printf('fight %.1f', t1) WHEN t2 >= 0.5 THEN printf('dream_or_vision %.1f', t2) ELSE '-' END AS tags, lpad(CAST(scene % 1000 AS VARCHAR), 3, ' ') || '  1:02:03-1:02:04  ' AS head FROM scenes)
SELECT video_id, scene, head || CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error ELSE 'cut=' || printf('%.2f', t1) || '  ' || rpad(title, 32, ' ') || '  [' || mood || ']  ' || tags END AS line FROM t""",
)
def scene_list(spark, sf):
    d = rows(spark, sf, "scenes").withColumns({"number": F.col("scene"), "scene": F.col("scene") % 1000, "start_ms": F.lit(3_723_000), "end_ms": F.lit(3_724_900), "boundary_score": F.col("t1")})
    whole = prompts.scene_list(d.withColumn("video_id", F.struct("video_id", "number")))
    return whole.select("video_id.video_id", F.col("video_id.number").alias("scene"), "line")


@query(
    "scene_text",
    ROWS + """ SELECT video_id, scene, title || '. ' || description || ' Characters: ' || title || '. Location: park (unknown).' || CASE WHEN mood <> '' THEN ' Mood: ' || mood || '.' ELSE '' END ||
 CASE WHEN t1 >= 0.5 AND t2 >= 0.5 AND t2 > t1 THEN ' Tags: dream or vision, fight.' WHEN t1 >= 0.5 AND t2 >= 0.5 THEN ' Tags: fight, dream or vision.' WHEN t1 >= 0.5 THEN ' Tags: fight.' WHEN t2 >= 0.5 THEN ' Tags: dream or vision.' ELSE '' END AS text FROM scenes""",
)
def scene_text(spark, sf):
    none = F.lit(None).cast("string")
    d = rows(spark, sf, "scenes")
    return d.select("video_id", "scene", tx.scene_text(F.col("title"), F.col("description"), F.array().cast("array<string>"), F.col("characters"), F.lit("park"), none, F.col("mood"), F.col("tags")).alias("text"))


@query(
    "tag_queries",
    f"""WITH t AS (SELECT unnest(range(0, {len(TAGS)})) AS k, unnest([{", ".join(f"'{t}'" for t in TAGS)}]) AS tag)
SELECT conv_id, turn, 'a movie scene with ' || replace(CASE WHEN turn % 2 = 0 THEN tag ELSE replace(left(text, 20), ' ', '_') END, '_', ' ') || ': ' || CASE WHEN turn % 2 = 0 AND k % 2 = 0 THEN 'about ' || tag ELSE '' END AS query,
 CASE WHEN length(text) > 200 THEN left(text, 200) || '{answers.CUT}' ELSE text END AS cut FROM conversations JOIN t ON k = conv_id % {len(TAGS)}""",
)
def tag_queries(spark, sf):
    """Tags of the vocabulary, every other one defined, and words of texts as tags; texts cut with the mark."""
    known = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("conv_id") % len(TAGS) + 1).cast("int"))
    tag = F.when(F.col("turn") % 2 == 0, known).otherwise(F.replace(F.substring("text", 1, 20), F.lit(" "), F.lit("_")))
    asked = tx.tag_query(tag, {t: f"about {t}" for t in TAGS[::2]})
    return read(spark, sf, "conversations").select("conv_id", "turn", asked.alias("query"), tx.cut_text(F.col("text"), 200, answers.CUT).alias("cut"))


@query("pinned_language", f"WITH {IV}, c AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) AS INTEGER) AS k, kind, CAST(id % 10 AS DOUBLE) / 10 AS p, id % 4 AS n FROM iv), f AS (SELECT video_id, min(k) AS k FROM c WHERE n > 0 AND p >= 0.5 GROUP BY 1) SELECT c.video_id, c.k AS index, g.kind AS pinned FROM c LEFT JOIN f ON f.video_id = c.video_id AND f.k < c.k LEFT JOIN c g ON g.video_id = f.video_id AND g.k = f.k")
def pinned_language(spark, sf):
    w = catalog.Window.partitionBy("video_id").orderBy("start_ms", "id")
    c = spans(spark, sf).select("video_id", F.row_number().over(w).alias("index"), F.col("kind").alias("lang"), ((F.col("id") % 10).cast("double") / 10).alias("lang_prob"), (F.col("id") % 4).alias("n_segments"))
    return summaries.pinned_language(c).select("video_id", "index", "pinned")


@query("queue_positions", f"WITH {IV} SELECT id AS video_id, CAST(row_number() OVER (ORDER BY start_ms, id) AS INTEGER) AS queue_position FROM iv WHERE kind = 'signup'")
def queue_positions(spark, sf):
    return summaries.queue_positions(spans(spark, sf).select(F.col("id").alias("video_id"), F.when(F.col("kind") == "signup", "queued").otherwise("done").alias("status"), F.col("start_ms").alias("queued_at")))


@query("printed_once", f"WITH {IV} SELECT video_id, id % 50 AS id, min(id // 10) AS shot FROM iv GROUP BY 1, 2")
def printed_once(spark, sf):
    return summaries.printed_once(spans(spark, sf).select("video_id", F.floor(F.col("id") / 10).alias("shot"), (F.col("id") % 50).alias("id")))


@query("in_time_order", f"WITH {IV} SELECT id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, CASE WHEN kind = 'click' THEN 0 ELSE 1 END, id) AS INTEGER) AS place FROM iv")
def in_time_order(spark, sf):
    d = spans(spark, sf).withColumns({"source_rank": F.when(F.col("kind") == "click", 0).otherwise(1), "pos": F.col("id")})
    return summaries.in_time_order(d).select("id", "place")


@query("all_done", f"WITH {IV} SELECT video_id, count(DISTINCT id % 9) FILTER (WHERE kind <> 'error') = 9 AS ready FROM iv GROUP BY 1")
def all_done(spark, sf):
    stage = F.element_at(F.array(*map(F.lit, summaries.STAGES)), (F.col("id") % 9 + 1).cast("int"))
    return summaries.all_done(spans(spark, sf).select("video_id", stage.alias("stage"), F.when(F.col("kind") != "error", "done").otherwise("failed").alias("status")))


@query("latest_runs", f"WITH {IV} SELECT video_id, kind AS stage, arg_max(CASE WHEN id % 2 = 0 THEN 'done' ELSE 'running' END, start_ms * 100000 + id) AS status FROM iv GROUP BY 1, 2")
def latest_runs(spark, sf):
    d = spans(spark, sf).select("video_id", F.col("kind").alias("stage"), F.when(F.col("id") % 2 == 0, "done").otherwise("running").alias("status"), F.lit(1.0).alias("seconds"), F.lit(None).cast("string").alias("error"), F.lit("f").alias("fingerprint"), (F.col("start_ms") * 100000 + F.col("id")).alias("updated_at"))
    return sinks.latest_runs(d).select("video_id", "stage", "status")


@query("reuse_by_key", "SELECT event_id AS id, event_id % 3 <> 0 AND event_id % 5 <> 0 AND (event_id + 1) % 7 <> 0 AND (event_id < 50 OR event_id % 4 <> 0) AS reused FROM events")
def reuse_by_key(spark, sf):
    """Rows of another value, of another note, and rows or notes that weren't there before, run again; the order of columns' sources doesn't matter."""
    from timeloom.plans.stages import Stage, reuse, row_prints

    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("id"), "value", "event_type")
    notes = e.filter("(id + 1) % 7 = 0 or id % 4 = 0").select("video_id", "id", F.lit("note").alias("note"))
    stage = Stage("scenes", ("events", "notes"), lambda t: t["events"], keys=("id",), model="m")
    old_notes = notes.withColumn("note", F.when(F.col("id") < 50, "note").otherwise("other")).filter("(id + 1) % 7 <> 0")
    old = e.withColumn("value", F.when(F.col("id") % 3 == 0, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value"))).filter("id % 5 <> 0")
    marked = reuse(row_prints(stage, {"events": e, "notes": notes}), row_prints(stage, {"events": old, "notes": old_notes}))
    return marked.select(F.get_json_object("row_key", "$.id").cast("bigint").alias("id"), "reused")


@query("stale_files", "SELECT CAST(event_id AS VARCHAR) || '.jpg' AS file FROM events WHERE event_id % 4 = 0")
def stale_files(spark, sf):
    f = read(spark, sf, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("file"))
    return sinks.stale_files(f.select("file"), f.filter("event_id % 4 <> 0").select("file"))


@query(
    "tags_present",
    """SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(string_split(left(text, 80), ' ')), lambda w: length(w) % 4 > 1)), ',') AS tags FROM conversations""",
)
def tags_present(spark, sf):
    """Scenes as they are listed show no tag of confidence 0 (or below, or null): words of turns as tags, by their length."""
    share = lambda w: F.when(F.length(w) % 4 == 0, 0.0).when(F.length(w) % 4 == 1, F.when(F.length(w) > 4, -0.5)).otherwise(0.25)
    words = F.transform(F.array_distinct(F.split(F.substring("text", 1, 80), " ")), lambda w: F.struct(w.alias("k"), share(w).alias("v")))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(F.map_keys(tx.tags_present(F.map_from_entries(words)))), ",").alias("tags"))


@query(
    "map_union",
    """WITH w AS (SELECT conv_id, turn, list_distinct(string_split(left(text, 120), ' ')) AS a, list_distinct(string_split(right(text, 120), ' ')) AS b FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_transform(list_distinct(list_concat(a, b)), lambda k: k || '=' || CASE WHEN list_contains(b, k) THEN length(k) + turn ELSE length(k) END)), ',') AS m FROM w""",
)
def map_union(spark, sf):
    """Maps of the first and of the last words of each turn; where both have a word the second's value counts."""
    pairs = lambda text, more: F.map_from_entries(F.transform(F.array_distinct(F.split(text, " ")), lambda k: F.struct(k.alias("k"), (F.length(k) + more).cast("bigint").alias("v"))))
    m = summaries.map_union(pairs(F.substring("text", 1, 120), F.lit(0)), pairs(F.right("text", F.lit(120)), F.col("turn")))
    listed = F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(listed, ",").alias("m"))


@query("first_texts", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '')[1:turn % 4 + 1], '|') AS t FROM conversations")
def first_texts(spark, sf):
    """The first one to four sentences of each turn."""
    parts = F.split("text", r"\.")
    picked = F.element_at(F.array(*[tx.first_texts(parts, n) for n in (1, 2, 3, 4)]), (F.col("turn") % 4 + 1).cast("int"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(picked, "|").alias("t"))


#: What may stand in a caption: graphics, and what only looks like one.
_PUT = ("a Logo", "logos", "digital  art", "Digital Art.", "digital artist", "an abstract design", "geometric patterns", "(geometric pattern)", "catalogo", "a man")


@query(
    "caption_flags",
    f"""WITH p AS (SELECT unnest(range(0, {len(_PUT)})) AS k, unnest([{", ".join(f"'{w}'" for w in _PUT)}]) AS w)
SELECT conv_id, turn, regexp_matches(left(text, 30) || ' ' || w || ' ' || right(text, 30), '(?i){tx.GRAPHIC.replace("'", "''")}') AS graphic,
 CASE WHEN (conv_id * turn) % 3 = 0 THEN text ELSE '{tx.MASK}' END AS text FROM conversations JOIN p ON k = (conv_id + turn) % {len(_PUT)}""",
)
def caption_flags(spark, sf):
    put = F.element_at(F.array(*[F.lit(w) for w in _PUT]), ((F.col("conv_id") + F.col("turn")) % len(_PUT) + 1).cast("int"))
    caption = F.concat_ws(" ", F.substring("text", 1, 30), put, F.right("text", F.lit(30)))
    return read(spark, sf, "conversations").select("conv_id", "turn", tx.is_graphic(caption).alias("graphic"), tx.masked(F.col("text"), (F.col("conv_id") * F.col("turn")) % 3 == 0).alias("text"))


# ---------------------------------------------------------------- times and streams

@query("time_forms", f"WITH {catalog._MS} SELECT id, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hours, {catalog._FMT} || '-' || {catalog._FMT} AS span, s * 1000 AS strict, s * 1000 + 123 AS rounded, round(least(CAST(id % 100 AS DOUBLE) / 50, 1.0), 4) AS fraction FROM ms")
def time_forms(spark, sf):
    ms = F.col("ms")
    rounded = tc.parse_time_rounded(F.concat(F.floor(ms / 1000).cast("string"), F.lit(".1226")))
    return catalog.durations(spark, sf).select("id", tc.fmt_hours(ms).alias("hours"), tc.span(ms, ms).alias("span"), tc.parse_time_strict(tc.fmt(ms)).alias("strict"), rounded.alias("rounded"), F.round(tc.progress_fraction((F.col("id") % 100) * 20000, F.lit(1000)), 4).alias("fraction"))


@query("time_tags", f"WITH {catalog._MS} SELECT id, CAST(s * 1000 AS VARCHAR) || '-,65000-3723000' AS tags FROM ms")
def time_tags(spark, sf):
    text = F.concat(F.lit("At ["), tc.fmt(F.col("ms")), F.lit("] and [1:05 - 1:02:03], not [7] or [1:2]"))
    return catalog.durations(spark, sf).select("id", F.array_join(F.transform(tc.time_tags(text), lambda t: F.concat(t["start_ms"].cast("string"), F.lit("-"), F.coalesce(t["end_ms"].cast("string"), F.lit("")))), ",").alias("tags"))


@query("utc_text", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS t FROM events")
def utc_text(spark, sf):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    # the text is that of the session's zone, so the instant is shifted to show UTC in any
    zone = F.current_timezone()
    shown = F.from_utc_timestamp(F.timestamp_seconds(seconds), "UTC")
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), tc.utc_text(F.when(zone.isNotNull(), shown)).alias("t"))


@query("sse_round_trip", """SELECT event_id AS id, 'event: ' || event_type || chr(10) || 'data: {"k":' || CAST(event_id AS VARCHAR) || '}' || chr(10) || chr(10) AS wire, event_type AS event, '{"k":' || CAST(event_id AS VARCHAR) || '}' AS data FROM events""")
def sse_round_trip(spark, sf):
    e = read(spark, sf, "events").withColumn("wire", sinks.sse(F.col("event_type"), F.struct(F.col("event_id").alias("k"))))
    back = F.get(sinks.parse_sse(F.concat(F.col("wire"), F.lit("event: ping\ndata: {}\n\n"))), F.lit(0))
    return e.select(F.col("event_id").alias("id"), "wire", back["event"].alias("event"), back["data"].alias("data"))


@query("padded_windows", f"WITH {IV}, x AS (SELECT video_id, start_ms AS ts, unnest([start_ms // {24 * HOUR} - 1, start_ms // {24 * HOUR}, start_ms // {24 * HOUR} + 1]) AS w FROM iv) SELECT video_id, w * {24 * HOUR} AS core_ms, count(*) AS n, count(*) FILTER (WHERE ts >= w * {24 * HOUR} AND ts < (w + 1) * {24 * HOUR}) AS own FROM x WHERE ts >= w * {24 * HOUR} - {HOUR} AND ts < (w + 1) * {24 * HOUR} + {HOUR} GROUP BY 1, 2")
def padded_windows(spark, sf):
    d = jobs.padded_windows(spans(spark, sf).select("video_id", F.col("start_ms").alias("ts_ms")), 24 * HOUR, HOUR)
    return d.groupBy("video_id", "core_ms").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


@query(
    "progress_lines",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE conv_id * 1000 + turn END AS out_time_us, turn % 4 = 2 AS ended FROM conversations""",
)
def progress_lines(spark, sf):
    """Logs with no block yet, with one, with several that have ended, and with a time that is none; a text stands between the lines."""
    block = lambda at, state: F.concat(F.lit("frame="), F.col("turn").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nout_time_us="), at, F.lit(f"\nprogress={state}\n"))
    now = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    logs = (F.concat(F.lit("xout_time_us=7\n"), F.col("text")), block(now, "continue"), F.concat(block(F.lit("12"), "continue"), block(F.lit("N/A"), "continue"), block(now, "end")), F.concat(block(now, "end"), block(F.lit("N/A"), "continue")))
    text = F.element_at(F.array(*logs), (F.col("turn") % 4 + 1).cast("int"))
    return read(spark, sf, "conversations").select("conv_id", "turn", jobs.progress_lines(text).alias("p")).select("conv_id", "turn", "p.*")


#: Replies by shape: answers whole, cut off, with the action last, escaped, of two halves; calls of a tool; something else.
_SHAPES = 7


@query("answer_text", f"""SELECT conv_id, turn, CASE (conv_id + turn) % {_SHAPES} WHEN 0 THEN text WHEN 1 THEN left(text, length(text) // 2) WHEN 2 THEN text WHEN 3 THEN text
  WHEN 4 THEN '😀' || chr(65533) || text WHEN 6 THEN '' END AS answer FROM conversations""")
def answer_text(spark, sf):
    d = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":"|"\}$', ""), F.lit('"'))
    said, text = quoted(F.col("text")), F.col("text")
    escaped = F.regexp_replace(F.regexp_replace(said, "é", r"\\u00E9"), "e", r"\\u0065")
    reply = F.concat(F.lit('{"more": {"answer": "no", "x": [{"action": "no"}]}, "action" :"answer", "answer" : '), said, F.lit("}"))
    half = F.substr(text, F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    shapes = (
        reply,
        F.concat(F.lit('{"action":"answer","answer":'), F.regexp_replace(quoted(half), '"$', "")),
        F.concat(F.lit('{"answer": '), said, F.lit(', "action": "answer"}')),
        F.concat(F.lit('{"action": "\\u0061nswer", "ans\\u0077er": '), escaped, F.lit(', "answer": "second"}')),
        F.concat(F.lit('{"action": "answer", "answer": "\\ud83d\\ude00\\ud83d'), F.substr(said, F.lit(2))),
        F.concat(F.lit('{"action": "search_moments", "answer": '), said, F.lit(', "query": "x"}')),
        F.lit('{"action": "answer", "answer": null, "query": "answer"}'),
    )
    pick = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % _SHAPES + 1).cast("int"))
    return jobs.answers_so_far(d.select("conv_id", "turn", pick.alias("reply")), "reply").select("conv_id", "turn", "answer")


@query(
    "probe_media",
    "SELECT event_id AS video_id, CAST(trunc(round(event_id * 1.5, 1) * 1000) AS BIGINT) AS duration_ms, CASE WHEN event_id % 2 = 0 THEN 23.976 ELSE 25.0 END AS fps, CAST(event_id % 100 + 1 AS INTEGER) AS width, 1 AS audio_tracks, CASE WHEN event_id % 3 = 0 THEN 4 WHEN event_id % 3 = 1 THEN 3 END AS subtitle FROM events",
)
def probe_media(spark, sf):
    e = F.col("event_id")
    rate = F.when(e % 2 == 0, "24000/1001").otherwise("25")
    subs = F.when(e % 3 == 0, '{"index":3,"codec_type":"subtitle","codec_name":"subrip","tags":{"language":"fr"}},{"index":4,"codec_type":"subtitle","codec_name":"ass","tags":{"language":"eng"}}').when(e % 3 == 1, '{"index":3,"codec_type":"subtitle","codec_name":"subrip"}').otherwise('{"index":3,"codec_type":"subtitle","codec_name":"hdmv_pgs_subtitle"}')
    j = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","width":9,"disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","width":'), (e % 100 + 1).cast("string"), F.lit(',"avg_frame_rate":"'), rate, F.lit('"},{"index":2,"codec_type":"audio","codec_name":"aac"},'), subs, F.lit('],"format":{"duration":"'), F.round(e * 1.5, 1).cast("string"), F.lit('"}}'))
    d = artifacts.probe_media(read(spark, sf, "events").select(e.alias("video_id"), j.alias("json")))
    return d.select("video_id", "duration_ms", "fps", "width", "audio_tracks", artifacts.pick_subtitle(F.col("subtitle_tracks"))["index"].alias("subtitle"))


@query("kinds_filter", f"WITH {catalog._Q}, i AS (SELECT vec_id AS pos, embedding AS a, label FROM embeddings), s AS (SELECT pos, {catalog._DOT} AS sim FROM i, q WHERE label IN (1, 3)) SELECT pos, round(sim, 3) AS score FROM s ORDER BY score DESC, pos LIMIT 10")
def kinds_filter(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.lit("").alias("text"), F.col("label").cast("string").alias("kind"))
    return retrieval.search_moments(e, "nothing of it", catalog.query_vector(spark, sf), kinds=["1", "3"]).select("pos", "score")


@query("search_lines", r"WITH l AS (SELECT conv_id, turn, text, 'says' AS source FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, text, 'on screen' FROM conversations WHERE turn % 3 = 0) SELECT conv_id AS video_id, source, CAST(turn AS VARCHAR) AS id FROM l WHERE contains(lower(text), 'the of') OR list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+'), ['the', 'of']) ORDER BY turn * 1000, CAST(turn AS VARCHAR), conv_id, source LIMIT 8")
def search_lines(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("id"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000).alias("end_ms"), "text", (F.col("turn") % 2 == 0).alias("reliable"))
    both = answers.spoken_and_shown(c, c.filter("id % 3 = 0"))
    return retrieval.search_dialogue(both, "the of", least=1.0, ties=("video_id", "source")).select("video_id", "source", "id")
