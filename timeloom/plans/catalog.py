"""The registered queries of the engine's own operators, each with its DuckDB twin where SQL can express it.

The driver's tables have no video, so stand-ins play the parts: events are intervals on a user's clock (user = video), conversations
are lines, documents are captions, embeddings are items with a vector. All queries run over whole tables.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS
from timeloom.functions import text as tx
from timeloom.functions import timecode as tc
from timeloom.functions.vectors import dot, l2_normalise, tag_blend
from timeloom.operators import aggregates as ag
from timeloom.operators import folds, grounding, intervals, many, retrieval, windows
from timeloom.sources.subtitles import parse_srt
from timeloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000
#: Wider settings, as the stand-ins' clock runs over weeks.
WIDE = dataclasses.replace(DEFAULTS, chunk_ms=24 * HOUR, overlap_ms=HOUR, min_last_chunk_ms=6 * HOUR, scene_min_ms=4 * HOUR, scene_max_ms=48 * HOUR, chapter_ms=72 * HOUR)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """events as intervals."""
    e = read(spark, sf, "events")
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), start.alias("start_ms"), F.col("event_type").alias("kind"), "value", "props")
    return e.withColumn("end_ms", F.col("start_ms") + (F.col("value") * 60000).cast("bigint"))


IV = """iv AS (SELECT user_id AS video_id, event_id AS id, epoch_us(ts) // 1000 AS start_ms, event_type AS kind, value, props,
  epoch_us(ts) // 1000 + CAST(trunc(value * 60000) AS BIGINT) AS end_ms FROM events)"""


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles from each event to the next of its user; the last is a minute long."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "id")
    e = spans(spark, sf)
    return e.select("video_id", F.row_number().over(w).alias("shot"), "start_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + 60000).alias("end_ms"), "kind", "id", "value")


SHOTS = """shots AS (SELECT video_id, CAST(row_number() OVER w AS INTEGER) AS shot, start_ms, coalesce(lead(start_ms) OVER w, start_ms + 60000) AS end_ms, kind, id, value
  FROM iv WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id))"""
WITH = f"WITH {IV}, {SHOTS} "
#: In recursive queries.
REC = f"WITH RECURSIVE {IV}, {SHOTS}, "


def of_kind(d: DataFrame, kind: str) -> DataFrame:
    return d.filter(F.col("kind") == kind)


# ---------------------------------------------------------------- chunks and interval joins

_CHUNKS = f"""m AS (SELECT video_id, max(end_ms) - min(start_ms) AS d, min(start_ms) AS zero FROM iv GROUP BY video_id),
n AS (SELECT video_id, d, zero, greatest(1, d // {WIDE.chunk_ms} + CASE WHEN d % {WIDE.chunk_ms} >= {WIDE.min_last_chunk_ms} THEN 1 ELSE 0 END) AS n FROM m),
c0 AS (SELECT video_id, d, n, zero, unnest(range(0, n)) AS k FROM n),
chunks AS (SELECT video_id, 'chunk_' || lpad(CAST(k AS VARCHAR), 4, '0') AS id, CAST(k AS INTEGER) AS index, k * {WIDE.chunk_ms} AS core_start_ms,
  CASE WHEN k = n - 1 THEN d ELSE (k + 1) * {WIDE.chunk_ms} END AS core_end_ms, zero, d FROM c0)"""


def media(spark, sf) -> DataFrame:
    return spans(spark, sf).groupBy("video_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.min("start_ms").alias("zero"))


@query("chunk_plan", f"WITH {IV}, {_CHUNKS} SELECT video_id, id, index, core_start_ms, core_end_ms, greatest(core_start_ms - {WIDE.overlap_ms}, 0) AS start_ms, least(core_end_ms + {WIDE.overlap_ms}, d) AS end_ms FROM chunks")
def chunk_plan(spark, sf):
    return folds.plan_chunks(media(spark, sf), WIDE)


@query(
    "midpoint_ownership",
    f"""WITH {IV}, {_CHUNKS}, r AS (SELECT iv.video_id, iv.id AS row_id, c.id AS chunk_id, iv.start_ms - c.zero AS s, iv.end_ms - c.zero AS e, core_start_ms, core_end_ms,
  index = max(index) OVER (PARTITION BY c.video_id) AS last FROM iv JOIN chunks c USING (video_id)
  WHERE iv.start_ms - c.zero < core_end_ms + {WIDE.overlap_ms} AND iv.end_ms - c.zero > core_start_ms - {WIDE.overlap_ms}),
l AS (SELECT video_id, max(index) AS mx FROM chunks GROUP BY 1)
SELECT r.video_id, row_id, chunk_id FROM r JOIN l USING (video_id) WHERE (s + e) // 2 >= core_start_ms AND ((s + e) // 2 < core_end_ms OR chunk_id = 'chunk_' || lpad(CAST(mx AS VARCHAR), 4, '0'))""",
)
def midpoint_ownership(spark, sf):
    m = media(spark, sf)
    c = folds.plan_chunks(m, WIDE)
    e = spans(spark, sf).join(m.select("video_id", "zero"), "video_id")
    e = e.select("video_id", F.col("id").alias("row_id"), (F.col("start_ms") - F.col("zero")).alias("start_ms"), (F.col("end_ms") - F.col("zero")).alias("end_ms"))
    # not cut to the video: a row of no length at its very beginning overlaps no range that begins with it
    padded = c.select("video_id", F.col("id").alias("chunk_id"), (F.col("core_start_ms") - WIDE.overlap_ms).alias("start_ms"), (F.col("core_end_ms") + WIDE.overlap_ms).alias("end_ms"))
    found = intervals.overlap_join(e, padded, WIDE.chunk_ms)
    rows = found.select(F.col("a_video_id").alias("video_id"), F.col("a_row_id").alias("row_id"), F.col("b_chunk_id").alias("chunk_id"), F.col("a_start_ms").alias("start_ms"), F.col("a_end_ms").alias("end_ms"))
    return intervals.owned_rows(rows, c).select("video_id", "row_id", "chunk_id")


@query("overlap_join", f"WITH {IV} SELECT a.video_id, a.id AS a_id, b.id AS b_id FROM iv a JOIN iv b ON a.video_id = b.video_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms AND a.id < b.id")
def overlap_join(spark, sf):
    e = spans(spark, sf).select("video_id", "id", "start_ms", "end_ms")
    return intervals.overlap_join(e, e, 2 * HOUR).filter("a_id < b_id").select(F.col("a_video_id").alias("video_id"), "a_id", "b_id")


@query("subtitled_semi", f"WITH {IV} SELECT id, EXISTS (SELECT 1 FROM iv b WHERE b.kind = 'view' AND b.video_id = a.video_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms) AS subtitled FROM iv a WHERE kind = 'click'")
def subtitled_semi(spark, sf):
    e = spans(spark, sf).select("video_id", "id", "start_ms", "end_ms", "kind")
    a, b = of_kind(e, "click"), of_kind(e, "view")
    hit = intervals.overlap_join(a, b, 2 * HOUR, "left_semi").select(F.col("a_id").alias("id"), F.lit(True).alias("hit"))
    return a.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("subtitled"))


@query(
    "unplaced_nearest",
    f"""WITH {IV}, s AS (SELECT video_id, id AS shot, start_ms, end_ms FROM iv WHERE kind = 'view'), u AS (SELECT *, (start_ms + end_ms) // 2 AS mid FROM iv a WHERE kind = 'click' AND NOT EXISTS
  (SELECT 1 FROM s WHERE s.video_id = a.video_id AND a.start_ms < s.end_ms AND s.start_ms < a.end_ms)),
d AS (SELECT u.video_id, u.id, s.shot, CASE WHEN s.start_ms <= mid AND mid < s.end_ms THEN 0 ELSE least(abs(mid - s.start_ms), abs(mid - s.end_ms)) END AS distance FROM u JOIN s USING (video_id))
SELECT video_id, id, shot, distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, shot) = 1""",
)
def unplaced_nearest(spark, sf):
    e = spans(spark, sf).select("video_id", "id", "start_ms", "end_ms", "kind")
    a, s = of_kind(e, "click"), of_kind(e, "view").withColumnRenamed("id", "shot")
    placed = intervals.overlap_join(a, s.withColumnRenamed("shot", "id"), 2 * HOUR, "left_semi").select(F.col("a_id").alias("id"))
    return intervals.nearest(a.join(placed, "id", "left_anti").select("video_id", "id", "start_ms", "end_ms"), s, tc.midpoint(F.col("start_ms"), F.col("end_ms")), 2 * HOUR).select("video_id", "id", "shot", "distance")


@query(
    "point_in_interval",
    f"""WITH {IV}, v AS (SELECT video_id, start_ms, max(end_ms) AS end_ms FROM iv WHERE kind = 'view' GROUP BY 1, 2), p AS (SELECT * FROM iv WHERE kind = 'error')
SELECT p.id, v.start_ms AS b_start_ms, coalesce(v.end_ms, p.start_ms + 2000) AS shot_end_ms FROM p LEFT JOIN v ON p.video_id = v.video_id AND v.start_ms <= p.start_ms AND p.start_ms < v.end_ms""",
)
def point_in_interval(spark, sf):
    e = spans(spark, sf)
    v = of_kind(e, "view").groupBy("video_id", "start_ms").agg(F.max("end_ms").alias("end_ms"))
    p = of_kind(e, "error").select("video_id", "id", F.col("start_ms").alias("ts_ms"))
    return intervals.point_join(p, v, "ts_ms", 2 * HOUR).select("id", "b_start_ms", F.coalesce("b_end_ms", F.col("ts_ms") + 2000).alias("shot_end_ms"))


@query(
    "scene_at",
    WITH + """, sc AS (SELECT video_id, shot AS scene, start_ms, end_ms - 30000 AS end_ms FROM shots WHERE end_ms - start_ms > 30000), l AS (SELECT video_id, max({'e': end_ms, 's': scene}) AS last FROM sc GROUP BY 1)
SELECT iv.id, coalesce(sc.scene, CASE WHEN (iv.start_ms + iv.end_ms) // 2 >= l.last.e THEN l.last.s END) AS scene FROM iv LEFT JOIN sc ON iv.video_id = sc.video_id AND sc.start_ms <= (iv.start_ms + iv.end_ms) // 2 AND (iv.start_ms + iv.end_ms) // 2 < sc.end_ms LEFT JOIN l ON iv.video_id = l.video_id""",
)
def scene_at(spark, sf):
    sc = shots(spark, sf).filter("end_ms - start_ms > 30000").select("video_id", F.col("shot").alias("scene"), "start_ms", (F.col("end_ms") - 30000).alias("end_ms"))
    return intervals.scene_at(spans(spark, sf).select("video_id", "id", "start_ms", "end_ms"), sc, 24 * HOUR).select("id", "scene")


# ---------------------------------------------------------------- filters and aggregates

_REASON = f"CASE WHEN lp < {DEFAULTS.min_lang_prob} THEN 'other_language' WHEN lg < {DEFAULTS.min_logprob} OR wp < {DEFAULTS.min_word_prob} THEN 'low_confidence' END"
_LINES = f"""lines AS (SELECT video_id, id, kind, value, (id % 100) / 100.0::DOUBLE AS lp, CASE WHEN id % 7 = 0 THEN NULL ELSE -value / 30 END AS lg, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 37) / 37.0::DOUBLE END AS wp FROM iv)"""


def lines(spark, sf) -> DataFrame:
    d = spans(spark, sf).select("video_id", "id", "kind", "value", "start_ms", "end_ms", (F.col("id") % 100 / F.lit(100.0)).alias("lp"))
    return d.withColumns({"lg": F.when(F.col("id") % 7 != 0, -F.col("value") / 30), "wp": F.when(F.col("id") % 5 != 0, F.col("id") % 37 / F.lit(37.0))})


@query(
    "reliability_flags",
    f"""WITH {IV}, {_LINES}, r AS (SELECT id, lp, {_REASON} AS reason, kind = 'view' AS subtitled, coalesce(wp > 0.6 AND lg < -1.0, false) AS hallucinated FROM lines)
SELECT id, hallucinated, CASE WHEN reason IS NULL AND subtitled AND lp < {DEFAULTS.subtitled_lang_prob} THEN 'other_language' ELSE reason END AS reason, reason IS NULL AND NOT (subtitled AND lp < {DEFAULTS.subtitled_lang_prob}) AS reliable FROM r""",
)
def reliability_flags(spark, sf):
    d = lines(spark, sf).select("id", "lp", tx.unreliable_reason(F.col("lp"), F.col("lg"), F.col("wp")).alias("reason"), (F.col("kind") == "view").alias("subtitled"), tx.hallucinated(F.col("wp"), F.col("lg")).alias("hallucinated"))
    down = F.col("reason").isNull() & F.col("subtitled") & (F.col("lp") < DEFAULTS.subtitled_lang_prob)
    return d.select("id", "hallucinated", F.when(down, "other_language").otherwise(F.col("reason")).alias("reason"), (F.col("reason").isNull() & ~down).alias("reliable"))


@query(
    "timeline_stats",
    f"""WITH {IV}, {_LINES}, l AS (SELECT video_id, {_REASON} AS reason, CASE WHEN kind = 'signup' THEN 'srt' ELSE 'asr' END AS source FROM lines WHERE kind IN ('click', 'signup')),
a AS (SELECT video_id, count(*) AS dialogue, count(*) FILTER (WHERE source = 'srt') AS srt, count(*) FILTER (WHERE source = 'asr') AS asr, count(*) FILTER (WHERE reason IS NULL) AS reliable,
 count(*) FILTER (WHERE reason = 'other_language') AS other_language, count(*) FILTER (WHERE reason = 'low_confidence') AS low_confidence FROM l GROUP BY 1),
b AS (SELECT video_id, count(*) AS texts FROM iv WHERE kind = 'view' GROUP BY 1), c AS (SELECT video_id, count(*) AS shots FROM iv WHERE kind = 'error' GROUP BY 1)
SELECT video_id, coalesce(dialogue, 0) AS dialogue, coalesce(srt, 0) AS srt, coalesce(asr, 0) AS asr, coalesce(reliable, 0) AS reliable, coalesce(other_language, 0) AS other_language, coalesce(low_confidence, 0) AS low_confidence,
 coalesce(texts, 0) AS texts, coalesce(shots, 0) AS shots FROM a FULL JOIN b USING (video_id) FULL JOIN c USING (video_id)""",
)
def timeline_stats(spark, sf):
    d = lines(spark, sf)
    reason = tx.unreliable_reason(F.col("lp"), F.col("lg"), F.col("wp"))
    l = d.filter(F.col("kind").isin("click", "signup")).select("video_id", F.when(F.col("kind") == "signup", "srt").otherwise("asr").alias("source"), reason.alias("reason"), reason.isNull().alias("reliable"))
    return ag.timeline_stats(l, of_kind(d, "view"), of_kind(d, "error"))


@query("counts_by_kind", "SELECT user_id AS video_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("view", "click", "error")) + " FROM events GROUP BY 1")
def counts_by_kind(spark, sf):
    return ag.counts_by_kind(spans(spark, sf), ["view", "click", "error"])


_KINDS = ("view", "signup", "click", "error", "purchase")


@query(
    "tag_stats",
    f"""WITH {IV}, n AS (SELECT video_id, count(DISTINCT id) AS n FROM iv GROUP BY 1), h AS (SELECT video_id, kind AS tag, count(DISTINCT id) AS hits FROM iv WHERE value >= 20 GROUP BY 1, 2)
SELECT video_id, tag, hits, round(CAST(hits AS DOUBLE) / n, 2) AS share, CAST(list_position({list(_KINDS)}, tag) AS BIGINT) AS place FROM h JOIN n USING (video_id) WHERE round(CAST(hits AS DOUBLE) / n, 2) > 0""",
)
def tag_stats(spark, sf):
    return ag.tag_stats(spans(spark, sf).select("video_id", F.col("id").alias("scene"), F.col("kind").alias("tag"), F.col("value").alias("confidence")), _KINDS, 20.0)


_NAMES = r"""n AS (SELECT conv_id AS video_id, turn AS scene, turn * 1000 AS start_ms, turn * 1000 + 900 AS end_ms, regexp_extract(text, '^([\p{L}\p{N}_]+)', 1) AS name FROM conversations)"""


def first_words(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("scene"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), F.regexp_extract("text", r"^([\p{L}\p{N}_]+)", 1).alias("name"))


@query(
    "character_rollup",
    f"""WITH {_NAMES} SELECT video_id, lower(name) AS key, arg_min(name, {{'s': scene, 'k': start_ms}}) AS name, count(*) AS n_scenes, array_to_string(list_sort(list(scene)), ',') AS scenes, min(start_ms) AS first_ms, max(end_ms) AS last_ms
FROM n WHERE trim(name) <> '' GROUP BY video_id, lower(name)""",
)
def character_rollup(spark, sf):
    return ag.character_rollup(first_words(spark, sf)).withColumn("scenes", F.array_join("scenes", ","))


@query(
    "mention_counts",
    rf"""WITH {_NAMES}, k AS (SELECT DISTINCT video_id, lower(name) AS key FROM n WHERE trim(name) <> ''),
w AS (SELECT DISTINCT conv_id AS video_id, turn, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS key FROM conversations)
SELECT video_id, key, count(turn) AS mentions FROM k LEFT JOIN w USING (video_id, key) GROUP BY 1, 2""",
)
def mention_counts(spark, sf):
    names = ag.character_rollup(first_words(spark, sf)).select("video_id", "key")
    return ag.mention_counts(names, read(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("id"), "text"))


@query("best_confidence", f"WITH {IV} SELECT video_id, id // 100 AS scene, kind AS tag, max(value) AS confidence, arg_max(CAST(id AS VARCHAR), {{'c': value, 'p': -id}}) AS evidence FROM iv GROUP BY 1, 2, 3")
def best_confidence(spark, sf):
    return ag.best_confidence(spans(spark, sf).select("video_id", F.expr("id div 100").alias("scene"), F.col("kind").alias("tag"), F.col("value").alias("confidence"), F.col("id").cast("string").alias("evidence"), F.col("id").alias("pos")))


# ---------------------------------------------------------------- windows and folds

_SCORE = "CASE WHEN s.kind = 'error' THEN 2.0 ELSE round((s.id % 100) / 100.0::DOUBLE, 2) END"


def scored(spark, sf) -> DataFrame:
    d = shots(spark, sf)
    return d.withColumns({"score": F.when(F.col("kind") == "error", 2.0).otherwise(F.round(F.col("id") % 100 / F.lit(100.0), 2)), "graphic": F.col("kind") == "view"})


@query(
    "boundary_scores",
    WITH + f""", x AS (SELECT s.*, kind = 'view' AS graphic, [kind, CAST(id % 3 AS VARCHAR)] AS dl, [CAST(id % 7 AS VARCHAR)] AS tl, (start_ms + end_ms) / 2 AS mid FROM shots s),
y AS (SELECT *, lead(shot) OVER w AS nshot, lead(graphic) OVER w AS ng, lead(dl) OVER w AS ndl, lead(tl) OVER w AS ntl, lead(mid) OVER w AS nmid, lead(start_ms) OVER w AS nfirst FROM x WINDOW w AS (PARTITION BY video_id ORDER BY shot))
SELECT video_id, shot, round(CASE WHEN graphic <> ng THEN 2.0 ELSE 0.5 + CASE WHEN abs(mid - end_ms) < 5000 OR abs(nmid - end_ms) < 5000 THEN 0.0 ELSE 0.3 END - CASE WHEN list_has_any(dl, ndl) OR nfirst - (end_ms - 1500) < 2000 AND id % 2 = 0 THEN 0.4 ELSE 0.0 END
 - CASE WHEN list_has_any(tl, ntl) THEN 0.3 ELSE 0.0 END END::DOUBLE, 3) AS score FROM y WHERE nshot IS NOT NULL""",
)
def boundary_scores(spark, sf):
    d = shots(spark, sf)
    d = d.select(
        "video_id", "shot", "start_ms", "end_ms", (F.col("kind") == "view").alias("graphic"), F.array("kind", (F.col("id") % 3).cast("string")).alias("dialogue_ids"), F.array((F.col("id") % 7).cast("string")).alias("text_ids"),
        F.array((F.col("start_ms") + F.col("end_ms")) / 2).alias("mids"), F.col("start_ms").alias("first_talk_ms"), F.when(F.col("id") % 2 == 0, F.col("end_ms") - 1500).alias("last_talk_ms"),
    )
    return windows.boundary_scores(d)


@query(
    "greedy_segment",
    REC + f"""sc AS (SELECT s.*, {_SCORE} AS score, kind = 'view' AS graphic, lead(end_ms) OVER w AS nend, count(*) OVER (PARTITION BY video_id) AS n FROM shots s WINDOW w AS (PARTITION BY video_id ORDER BY shot)),
f AS (SELECT video_id, shot, start_ms AS g, shot AS first, end_ms, score, graphic AS gg, 1 AS grp FROM sc WHERE shot = 1 UNION ALL
 SELECT s.video_id, s.shot, CASE WHEN c THEN s.start_ms ELSE f.g END, CASE WHEN c THEN s.shot ELSE f.first END, s.end_ms, s.score, CASE WHEN c THEN s.graphic ELSE f.gg END, f.grp + CASE WHEN c THEN 1 ELSE 0 END
 FROM (SELECT f.*, f.score >= 2.0 OR (f.score >= {WIDE.scene_cut} AND f.end_ms - f.g >= {WIDE.scene_min_ms}) OR s.end_ms - f.g > {WIDE.scene_max_ms} AS c, s.shot AS ns FROM f JOIN sc s ON s.video_id = f.video_id AND s.shot = f.shot + 1) f JOIN sc s ON s.video_id = f.video_id AND s.shot = f.ns),
g AS (SELECT video_id, grp, min(first) AS first, max(shot) AS last, min(g) AS start_ms, max(end_ms) AS end_ms, bool_or(gg) AS gg FROM f GROUP BY 1, 2),
t AS (SELECT *, lag(gg) OVER w AS pg, grp = max(grp) OVER (PARTITION BY video_id) AND grp > 1 AND end_ms - start_ms < {WIDE.scene_min_ms // 2} AND NOT gg AND NOT lag(gg) OVER w AS short FROM g WINDOW w AS (PARTITION BY video_id ORDER BY grp)),
u AS (SELECT video_id, CASE WHEN short THEN grp - 1 ELSE grp END AS scene, first, last, start_ms, end_ms FROM t)
SELECT video_id, scene, min(first) AS first, max(last) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM u GROUP BY 1, 2""",
)
def greedy_segment(spark, sf):
    return folds.segment(scored(spark, sf), WIDE)


@query(
    "chapter_plan",
    REC + f"""f AS (SELECT video_id, shot, start_ms AS g, shot AS first, end_ms, 1 AS grp FROM shots WHERE shot = 1 UNION ALL
 SELECT s.video_id, s.shot, CASE WHEN f.end_ms - f.g >= {WIDE.chapter_ms} THEN s.start_ms ELSE f.g END, CASE WHEN f.end_ms - f.g >= {WIDE.chapter_ms} THEN s.shot ELSE f.first END, s.end_ms, f.grp + CASE WHEN f.end_ms - f.g >= {WIDE.chapter_ms} THEN 1 ELSE 0 END
 FROM f JOIN shots s ON s.video_id = f.video_id AND s.shot = f.shot + 1),
g AS (SELECT video_id, grp, min(first) AS first, max(shot) AS last, min(g) AS start_ms, max(end_ms) AS end_ms FROM f GROUP BY 1, 2),
u AS (SELECT video_id, CASE WHEN grp = max(grp) OVER (PARTITION BY video_id) AND grp > 1 AND end_ms - start_ms < {WIDE.chapter_ms // 3} THEN grp - 1 ELSE grp END AS chapter, first, last, start_ms, end_ms FROM g)
SELECT video_id, chapter, min(first) AS first, max(last) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM u GROUP BY 1, 2""",
)
def chapter_plan(spark, sf):
    return folds.plan_chapters(shots(spark, sf).withColumnRenamed("shot", "scene"), WIDE)


@query(
    "merge_shots",
    f"""WITH RECURSIVE {IV}, r AS (SELECT video_id, start_ms, end_ms, id % 2 = 0 AS cs, id % 3 <> 0 AS ce, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, id % 2 = 0, id % 3 <> 0, id) AS k FROM iv),
f AS (SELECT video_id, k, start_ms AS s, end_ms AS e, ce, 1 AS grp, start_ms AS kf FROM r WHERE k = 1 UNION ALL
 SELECT r.video_id, r.k, CASE WHEN f.ce AND r.cs AND r.start_ms <= f.e THEN f.s WHEN r.start_ms < f.e AND r.end_ms <= f.e THEN f.s ELSE greatest(r.start_ms, f.e) END,
  CASE WHEN f.ce AND r.cs AND r.start_ms <= f.e THEN greatest(f.e, r.end_ms) WHEN r.start_ms < f.e AND r.end_ms <= f.e THEN f.e ELSE r.end_ms END,
  CASE WHEN f.ce AND r.cs AND r.start_ms <= f.e THEN r.ce WHEN r.start_ms < f.e AND r.end_ms <= f.e THEN f.ce ELSE r.ce END,
  f.grp + CASE WHEN (f.ce AND r.cs AND r.start_ms <= f.e) OR (r.start_ms < f.e AND r.end_ms <= f.e) THEN 0 ELSE 1 END,
  CASE WHEN NOT (f.ce AND r.cs AND r.start_ms <= f.e) AND r.start_ms < f.e AND r.end_ms <= f.e THEN NULL ELSE r.start_ms END FROM f JOIN r ON r.video_id = f.video_id AND r.k = f.k + 1)
SELECT video_id, grp AS shot, max(s) AS start_ms, max(e) AS end_ms, array_to_string(list_sort(list_distinct(list(kf))), ',') AS keyframes FROM f GROUP BY 1, 2""",
)
def merge_shots(spark, sf):
    e = spans(spark, sf).select("video_id", "start_ms", "end_ms", (F.col("id") % 2 == 0).alias("clipped_start"), (F.col("id") % 3 != 0).alias("clipped_end"), F.array("start_ms").alias("keyframes"))
    return folds.merge_shots(e).withColumn("keyframes", F.array_join("keyframes", ","))


@query(
    "gap_collapse",
    f"""WITH {IV}, a AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER w <= {4 * HOUR} THEN 0 ELSE 1 END AS new FROM iv WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY start_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)
SELECT video_id, session, min(start_ms) AS start_ms, max(start_ms) AS last_ms, count(*) AS n FROM b GROUP BY 1, 2""",
)
def gap_collapse(spark, sf):
    return folds.gap_sessions(spans(spark, sf).select("video_id", "id", F.col("start_ms").alias("ts_ms")), 4 * HOUR)


def frames(spark, sf) -> DataFrame:
    """documents as readings of frames: 25 frames of 3 s a video, 5 a shot."""
    d, k = read(spark, sf, "documents"), F.pmod("doc_id", F.lit(25))
    return d.select(F.floor(F.col("doc_id") / 25).alias("video_id"), (k * 3000).alias("ts_ms"), "text", ((F.floor(k / 5) + 1) * 15000).alias("shot_end_ms"))


@query("text_collapse")
def text_collapse(spark, sf):
    return folds.collapse_text(frames(spark, sf)).withColumn("frames", F.array_join("frames", ","))


@query("near_duplicate_notes")
def near_duplicate_notes(spark, sf):
    # 16 notes a scene
    d = read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 16).alias("scene"), F.col("doc_id").alias("pos"), "text")
    return folds.distinct_notes(d, "scene")


@query(
    "even_thin",
    """WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
SELECT conv_id, turn FROM c WHERE n <= 3 OR list_contains([CAST(floor(i * (n / 3.0::DOUBLE)) AS BIGINT) FOR i IN range(0, 3)], k)""",
)
def even_thin(spark, sf):
    return windows.thin(read(spark, sf, "conversations"), ["conv_id"], 3, "turn").select("conv_id", "turn")


@query("numbered_ids", f"WITH {IV} SELECT id, 'd' || lpad(CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) AS VARCHAR), 4, '0') AS num FROM iv")
def numbered_ids(spark, sf):
    return windows.numbered(spans(spark, sf), "d", "start_ms", "id").select("id", "num")


@query("first_per_id", f"WITH {IV} SELECT video_id, kind, id FROM iv QUALIFY row_number() OVER (PARTITION BY video_id, kind ORDER BY start_ms, id) = 1")
def first_per_id(spark, sf):
    return windows.first_per(spans(spark, sf), ["video_id", "kind"], "start_ms", "id").select("video_id", "kind", "id")


@query("tail_n", f"WITH {IV} SELECT video_id, id FROM iv QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start_ms DESC, id DESC) <= 3")
def tail_n(spark, sf):
    return windows.tail(spans(spark, sf), ["video_id"], 3, "start_ms", "id").select("video_id", "id")


@query("progress_changes", f"WITH {IV} SELECT video_id, id, kind FROM iv QUALIFY kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY video_id ORDER BY start_ms, id)")
def progress_changes(spark, sf):
    """The stream's own operator over the rows as one batch; its state carries the row's number along with what is compared."""
    d = spans(spark, sf).select("video_id", F.timestamp_millis("start_ms").alias("ts"), F.lit("running").alias("status"), F.col("kind").alias("state"), F.col("id").alias("place"))
    return live.progress_events(d, tell=("place",)).filter("event = 'progress'").select("video_id", F.col("place").alias("id"), F.col("state").alias("kind"))


# ---------------------------------------------------------------- vectors and retrieval

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"
_Q = "q AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, sf) -> list[float]:
    row = read(spark, sf, "embeddings").filter("vec_id = 0").first()
    return row["embedding"] if row else [0.0] * 64


@query(
    "tag_rank",
    """WITH x AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS v FROM embeddings), n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY v, vec_id) AS k FROM x)
SELECT vec_id, CASE WHEN n = 1 THEN 0.5 ELSE (k - 1) / CAST(n - 1 AS DOUBLE) END AS rank FROM n""",
)
def tag_rank(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("v"))
    return windows.ordinal_rank(e, ["label"], "v", "vec_id").select("vec_id", "rank")


@query(
    "tag_scores",
    f"""WITH t AS (SELECT label AS tag, embedding AS b FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
x AS (SELECT vec_id AS scene, label, tag, round({_DOT}, 6) AS sim FROM (SELECT vec_id, label, embedding AS a FROM embeddings), t),
r AS (SELECT *, (row_number() OVER (PARTITION BY tag ORDER BY sim, scene) - 1) / CAST(count(*) OVER (PARTITION BY tag) - 1 AS DOUBLE) AS rank FROM x)
SELECT scene, tag, round(0.6::DOUBLE * CASE WHEN label = tag THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END + (1 - 0.6::DOUBLE) * rank, 3) AS score FROM r""",
)
def tag_scores(spark, sf):
    e = read(spark, sf, "embeddings")
    tags = windows.first_per(e, ["label"], "vec_id").select(F.col("label").alias("tag"), F.col("embedding").alias("tag_embedding"))
    scenes = e.select(F.lit("v").alias("video_id"), F.col("vec_id").alias("scene"), "embedding", F.create_map(F.col("label"), F.lit(0.9)).alias("tags"))
    return retrieval.tag_scores(scenes, tags).select("scene", "tag", "score")


@query("vector_topk", f"WITH {_Q} SELECT vec_id, round({_DOT}, 6) AS similarity FROM (SELECT vec_id, embedding AS a FROM embeddings), q ORDER BY 2 DESC, 1 LIMIT 10")
def vector_topk(spark, sf):
    v = query_vector(spark, sf)
    return read(spark, sf, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v])), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


_KEYS = "['reaning', 'ention', 'thandand', 'onre']"


@query(
    "search_moments",
    rf"""WITH {_Q}, i AS (SELECT vec_id AS pos, embedding AS a, coalesce(text, '') AS text FROM embeddings JOIN documents ON vec_id = doc_id),
s AS (SELECT pos, {_DOT} AS sim, len(list_intersect({_KEYS}, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_''-]+'), lambda w: lower(w)))) / 4.0::DOUBLE AS o FROM i, q)
SELECT pos, round(sim, 3) AS similarity, round(sim + 0.15::DOUBLE * o, 3) AS score FROM s ORDER BY score DESC, pos LIMIT 10""",
)
def search_moments(spark, sf):
    e, d = read(spark, sf, "embeddings"), read(spark, sf, "documents")
    items = e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("vec_id").alias("pos"), "embedding", F.coalesce("text", F.lit("")).alias("text"), F.lit("text").alias("kind"))
    return retrieval.search_moments(items, "the reaning and ention of thandand onre", query_vector(spark, sf)).select("pos", "similarity", "score")


@query(
    "search_many",
    rf"""WITH q AS (SELECT vec_id AS question_id, embedding AS b, list_filter(list_distinct(list_transform(regexp_extract_all(left(text, 60), '[\p{{L}}\p{{N}}_''-]+'), lambda w: lower(w))), lambda w: length(w) >= 6) AS keys
  FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 50 = 0),
i AS (SELECT vec_id AS pos, embedding AS a, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_''-]+'), lambda w: lower(w)) AS w FROM embeddings JOIN documents ON vec_id = doc_id),
s AS (SELECT question_id, pos, {_DOT} AS sim, CASE WHEN len(keys) > 0 THEN len(list_intersect(keys, w)) / len(keys)::DOUBLE ELSE 0.0::DOUBLE END AS o FROM i, q),
r AS (SELECT question_id, pos, round(sim, 3) AS similarity, round(sim + 0.15::DOUBLE * o, 3) AS score FROM s)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos)::INT AS place, pos, similarity, score FROM r QUALIFY place <= 10""",
)
def search_many(spark, sf):
    """Questions made of the long words that texts begin with; every row whose id is divisible by 50 asks."""
    e, d = read(spark, sf, "embeddings"), read(spark, sf, "documents")
    items = e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("vec_id").alias("pos"), "embedding", F.coalesce("text", F.lit("")).alias("text"))
    begins = F.array_join(F.filter(F.transform(tx.words(F.substring("text", 1, 60)), F.lower), lambda w: F.length(w) >= 6), " ")
    questions = items.filter("pos % 50 = 0").select(F.col("pos").alias("question_id"), begins.alias("query"), F.col("embedding").alias("vector"))
    return many.search_many(items, questions).select("question_id", "place", "pos", "similarity", "score")


@query(
    "find_by_tag",
    """WITH s AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) + 0.5 AS score FROM embeddings WHERE label = 1), e AS (SELECT vec_id, label, vec_id % 11 = 0 AS graphic FROM embeddings)
SELECT e.vec_id AS scene, coalesce(s.score, CASE WHEN e.label = 2 THEN 0.7 END, 0.0) AS score, CAST(row_number() OVER (ORDER BY coalesce(s.score, CASE WHEN e.label = 2 THEN 0.7 END, 0.0) DESC, e.vec_id) AS INTEGER) AS place FROM e LEFT JOIN s USING (vec_id) WHERE NOT graphic AND coalesce(s.score, CASE WHEN e.label = 2 THEN 0.7 END, 0.0) >= 0.5""",
)
def find_by_tag(spark, sf):
    e = read(spark, sf, "embeddings")
    scores = e.filter("label = 1").select(F.lit("v").alias("video_id"), F.col("vec_id").alias("scene"), F.lit("dialogue").alias("tag"), (F.round(F.col("embedding")[0].cast("double"), 6) + F.lit(0.5)).alias("score"))
    tags = F.when(F.col("label") == 2, F.create_map(F.lit("dialogue"), F.lit(0.7))).otherwise(F.create_map(F.lit("action"), F.lit(0.9)))
    scenes = e.select(F.lit("v").alias("video_id"), F.col("vec_id").alias("scene"), F.lit(None).cast("string").alias("error"), (F.col("vec_id") % 11 == 0).alias("graphic"), tags.alias("tags"))
    return retrieval.find_by_tag(scenes, scores, "dialogue").select("scene", "score", "place")


_FROM, _TO = 1_704_200_000_000, 1_705_200_000_000


@query(
    "get_range",
    f"""WITH {IV}, r AS (SELECT video_id, id, start_ms, end_ms, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) - 1 AS k FROM iv WHERE start_ms < {_TO} AND end_ms > {_FROM})
SELECT video_id, id, start_ms, end_ms FROM r WHERE n <= 20 OR list_contains([CAST(floor(i * (n / 20.0::DOUBLE)) AS BIGINT) FOR i IN range(0, 20)], k)""",
)
def get_range(spark, sf):
    return retrieval.get_range(spans(spark, sf), _FROM, _TO, 20).select("video_id", "id", "start_ms", "end_ms")


@query("search_dialogue_literal", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the of') ORDER BY turn, conv_id LIMIT 8")
def search_dialogue_literal(spark, sf):
    c = read(spark, sf, "conversations")
    return c.filter(F.contains(F.lower("text"), F.lit("the of"))).orderBy("turn", "conv_id").limit(8).select("conv_id", "turn")


@query("search_dialogue_fuzzy")
def search_dialogue_fuzzy(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("turn").alias("start_ms"), F.format_string("%06d-%04d", "conv_id", "turn").alias("id"), "text")
    return retrieval.search_dialogue(c, "the reanin of thand", least=0.5).select("id", "score")


@query("normalised_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm FROM embeddings")
def normalised_vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(l2_normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


# ---------------------------------------------------------------- times, text, JSON, sets

_FMT = "CASE WHEN s // 3600 > 0 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"
_MS = "ms AS (SELECT event_id AS id, CAST(trunc(value * 60000) AS BIGINT) AS ms, CAST(trunc(value * 60000) AS BIGINT) // 1000 AS s FROM events)"


def durations(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") * 60000).cast("bigint").alias("ms"))


@query("time_format", f"WITH {_MS} SELECT id, {_FMT} AS clock, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS minutes, lpad(CAST(ms AS VARCHAR), 9, '0') || '.jpg' AS frame FROM ms")
def time_format(spark, sf):
    return durations(spark, sf).select("id", tc.fmt(F.col("ms")).alias("clock"), tc.fmt_minutes(F.col("ms")).alias("minutes"), tc.frame_name(F.col("ms")).alias("frame"))


@query("time_parse", f"WITH {_MS} SELECT id, s * 1000 AS back, CASE WHEN id % 2 = 0 THEN ms // 1000 * 1000 + 500 END AS half FROM ms")
def time_parse(spark, sf):
    d = durations(spark, sf)
    half = F.when(F.col("id") % 2 == 0, F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit(".5"))).otherwise("1:x")
    return d.select("id", tc.parse_time(tc.fmt(F.col("ms"))).alias("back"), tc.parse_time(half).alias("half"))


@query("find_times", f"WITH {_MS} SELECT id, CAST(s * 1000 AS VARCHAR) || ',' || CAST(ms // 60000 % 60 * 60000 + 7500 AS VARCHAR) AS found FROM ms")
def find_times(spark, sf):
    text = F.concat(F.lit("From ["), tc.fmt(F.col("ms")), F.lit("] to "), F.floor(F.col("ms") / 60000 % 60).cast("string"), F.lit(":07.5, not 1:2 or 7"))
    return durations(spark, sf).select("id", F.array_join(F.transform(tc.find_times(text), lambda t: t.cast("string")), ",").alias("found"))


@query(
    "keyframe_times",
    f"""WITH {IV}, n AS (SELECT id, start_ms, end_ms - start_ms AS d, CAST(least(greatest(ceil((end_ms - start_ms) / 600000.0::DOUBLE), 1), 6) AS INTEGER) AS n FROM iv)
SELECT id, CASE WHEN d > 0 THEN array_to_string([start_ms + CAST(trunc(d * (i + 0.5::DOUBLE) / n) AS BIGINT) FOR i IN range(0, n)], ',') ELSE '' END AS times FROM n""",
)
def keyframe_times(spark, sf):
    return spans(spark, sf).select("id", F.array_join(F.transform(tc.keyframe_times(F.col("start_ms"), F.col("end_ms"), 600_000), lambda x: x.cast("string")), ",").alias("times"))


@query(
    "route_question",
    rf"""WITH {_MS}, q AS (SELECT id, s, CASE WHEN id % 4 = 0 THEN 'Who are the characters in the plot?' WHEN id % 4 = 1 THEN 'What happens at ' || {_FMT} || '?' WHEN id % 4 = 2 THEN 'between ' || {_FMT} || ' and 0:30' ELSE 'Is it raining?' END AS t FROM ms)
SELECT id, CASE id % 4 WHEN 0 THEN 'get_movie_summary,get_characters' WHEN 3 THEN '' ELSE 'get_range' END AS actions,
 CASE id % 4 WHEN 1 THEN greatest(s * 1000 - 15000, 0) WHEN 2 THEN least(s * 1000, 30000) END AS start_ms, CASE id % 4 WHEN 1 THEN s * 1000 + 15000 WHEN 2 THEN greatest(s * 1000, 30000) END AS end_ms FROM q""",
)
def route_question(spark, sf):
    k, t = F.col("id") % 4, tc.fmt(F.col("ms"))
    text = F.when(k == 0, "Who are the characters in the plot?").when(k == 1, F.concat(F.lit("What happens at "), t, F.lit("?"))).when(k == 2, F.concat(F.lit("between "), t, F.lit(" and 0:30"))).otherwise("Is it raining?")
    d = durations(spark, sf).select("id", grounding.route(text).alias("plan"))
    return d.select("id", F.array_join(F.transform("plan", lambda x: x["action"]), ",").alias("actions"), F.get("plan", F.lit(0))["start_ms"].alias("start_ms"), F.get("plan", F.lit(0))["end_ms"].alias("end_ms"))


@query(
    "unverified_times",
    f"WITH {IV} SELECT a.id FROM iv a WHERE a.kind = 'click' AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.kind <> 'click' AND b.video_id = a.video_id AND abs(a.start_ms - b.start_ms) <= {HOUR})",
)
def unverified_times(spark, sf):
    e = spans(spark, sf).withColumnRenamed("start_ms", "ts_ms")
    return intervals.unverified(of_kind(e, "click").select("video_id", "id", "ts_ms"), e.filter("kind <> 'click'"), dataclasses.replace(DEFAULTS, citation_tolerance_ms=HOUR)).select("id")


@query(
    "pick_sources",
    f"""WITH {IV}, i AS (SELECT video_id AS answer_id, id % 3 AS step, id AS pos, kind AS label, start_ms, end_ms FROM iv WHERE kind <> 'error'), c AS (SELECT video_id AS answer_id, start_ms AS ts FROM iv WHERE kind = 'error' AND video_id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY answer_id, step ORDER BY pos) AS n FROM i),
h AS (SELECT * FROM n WHERE EXISTS (SELECT 1 FROM c WHERE c.answer_id = n.answer_id AND n.start_ms - 2000 <= ts AND ts <= n.end_ms + 2000)),
f AS (SELECT * FROM n WHERE n <= 3 AND answer_id NOT IN (SELECT answer_id FROM h)),
u AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY answer_id, start_ms, end_ms, label ORDER BY step, pos) = 1),
t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY step, pos) <= 6)
SELECT answer_id, step, pos, label, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY start_ms, step, pos) AS INTEGER) AS place FROM t""",
)
def pick_sources(spark, sf):
    e = spans(spark, sf)
    items = e.filter("kind <> 'error'").select(F.col("video_id").alias("answer_id"), (F.col("id") % 3).alias("step"), F.col("id").alias("pos"), F.col("kind").alias("label"), "start_ms", "end_ms")
    cited = e.filter("kind = 'error' and video_id % 2 = 0").select(F.col("video_id").alias("answer_id"), F.col("start_ms").alias("ts_ms"))
    return grounding.pick_sources(items, cited)


@query("norm_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) AS norm FROM documents")
def norm_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.norm(F.col("text"))).alias("norm"))


_BOILER = "|".join(f"(?:{p})" for p in tx.BOILERPLATE).replace("'", "''")


@query(
    "clean_description",
    rf"""WITH d AS (SELECT doc_id, trim(regexp_replace('The image shows ' || coalesce(text, '') || ' Overall, the mood is calm.', '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' AND NOT regexp_matches(x, '(?i){_BOILER}')) AS k FROM d),
o AS (SELECT doc_id, regexp_replace(trim(array_to_string(k, ' ')), '(?i)^(It|The (image|picture|photo|frame)) (shows|depicts|is) ', '') AS o FROM s)
SELECT doc_id, md5(upper(left(o, 1)) || substr(o, 2)) AS description FROM o""",
)
def clean_description(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.clean_description(F.concat(F.lit("The image shows "), F.coalesce("text", F.lit("")), F.lit(" Overall, the mood is calm.")))).alias("description"))


_OCR = r"""CASE WHEN len(regexp_extract_all(t, '[A-Za-z]{2,}')) >= 2 OR regexp_matches(t, '[A-Za-z]{4,}') THEN t ELSE '' END"""


@query(
    "clean_ocr",
    # whole texts, and the same with every word made one letter, which is to be refused
    rf"""WITH r AS (SELECT doc_id, coalesce(text, '') AS a, regexp_replace(coalesce(text, ''), '[A-Za-z]{{2,}}', 'x', 'g') AS b FROM documents),
d AS (SELECT doc_id, trim(regexp_replace(replace(a, '<s>', ''), '\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(b, '<s>', ''), '\s+', ' ', 'g')) AS b FROM r)
SELECT doc_id, md5({_OCR.replace("(t,", "(a,").replace("THEN t", "THEN a")}) AS ocr, md5({_OCR.replace("(t,", "(b,").replace("THEN t", "THEN b")}) AS poor FROM d""",
)
def clean_ocr(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.clean_ocr(F.col("text"))).alias("ocr"), F.md5(tx.clean_ocr(F.regexp_replace("text", "[A-Za-z]{2,}", "x"))).alias("poor"))


_STOP = "['" + "','".join(tx.STOP_WORDS) + "']"


@query(
    "keywords",
    rf"""SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_''-]+'), lambda w: length(w) >= 3), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w)))), ',')) AS keys FROM documents""",
)
def keywords(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.sort_array(tx.keywords(F.coalesce("text", F.lit("")))), ",")).alias("keys"))


@query(
    "srt_parse",
    "WITH t AS (SELECT event_id AS id, CAST(trunc(value * 1000) AS BIGINT) % 86400000 AS s FROM events) SELECT id, s AS start_ms, s + 1500 AS end_ms, 'line ' || CAST(id AS VARCHAR) AS text FROM t",
)
def srt_parse(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), ((F.col("value") * 1000).cast("bigint") % 86_400_000).alias("s"))
    stamp = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3_600_000), F.floor(c % 3_600_000 / 60_000), F.floor(c % 60_000 / 1000), c % 1000)
    block = F.concat(F.lit("1\n"), stamp(F.col("s")), F.lit(" --> "), stamp(F.col("s") + 1500), F.lit("\n<i>line</i> "), F.col("id").cast("string"), F.lit("\n\n2\nno time here\n"))
    return parse_srt(e.select("id", block.alias("content")), "content", ["id"]).select("id", "start_ms", "end_ms", "text")


@query("json_props", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k BIGINT", {"allowUnquotedControlChars": "true"})["k"].alias("k"))


@query("union_lines", "SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'says' AS label, text FROM conversations UNION ALL SELECT 'on screen', text FROM documents) GROUP BY 1")
def union_lines(spark, sf):
    c, d = (read(spark, sf, t).select(F.lit(label).alias("label"), "text") for t, label in (("conversations", "says"), ("documents", "on screen")))
    return c.unionByName(d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "word_intersect",
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def word_intersect(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("w", "v")).alias("shared"))


@query("pending_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_anti(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("embed_hash")
def embed_hash(spark, sf):
    from timeloom.models import hash_embedding

    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(hash_embedding(F.coalesce("text", F.lit(""))), lambda x: F.round(x, 4).cast("string")), ",").alias("embedding"))


@query("tag_blend", "SELECT event_id AS id, round(0.6::DOUBLE * (event_id % 10) / 10 + (1 - 0.6::DOUBLE) * ((event_id % 7) / 7.0::DOUBLE), 3) AS score FROM events")
def blend(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), tag_blend(F.col("event_id") % 10 / F.lit(10.0), F.col("event_id") % 7 / F.lit(7.0)).alias("score"))


from timeloom.plans import catalog_more  # noqa: E402, F401 - adds its queries
