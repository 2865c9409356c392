"""Boundary cases worked by hand, and folds against plain models."""

import dataclasses
import random

from pyspark.sql import functions as F

from timeloom.config import DEFAULTS
from timeloom.functions import text as tx
from timeloom.functions import timecode as tc
from timeloom.operators import aggregates, folds, grounding, intervals, retrieval, windows
from timeloom.plans.agent import ask, parse_ms, to_call
from timeloom.plans.stages import Stage, run_stages
from timeloom.sources import artifacts, sinks
from timeloom.sources.subtitles import parse_srt


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chunks(spark):
    rows = folds.plan_chunks(spark.createDataFrame([("v", 620000)], "video_id string, duration_ms bigint")).orderBy("index").collect()
    assert [(r.core_start_ms, r.core_end_ms, r.start_ms, r.end_ms) for r in rows] == [(0, 300000, 0, 305000), (300000, 620000, 295000, 620000)]


def test_ownership(spark):
    chunks = spark.createDataFrame([("v", "a", 0, 0, 300000), ("v", "b", 1, 300000, 600000)], "video_id string, id string, index int, core_start_ms bigint, core_end_ms bigint")
    rows = spark.createDataFrame([("v", c, s, e) for c in "ab" for s, e in ((296000, 303000), (299000, 302000), (700000, 700010))], "video_id string, chunk_id string, start_ms bigint, end_ms bigint")
    got = {(r.start_ms, r.chunk_id) for r in intervals.owned_rows(rows, chunks).collect()}
    assert got == {(296000, "a"), (299000, "b"), (700000, "b")}


def test_times(spark):
    for text, want in (("1:42:50", 6170000), ("95.5", 95500), ("x", None), ("", None), ("1:x", None)):
        assert one(spark, tc.parse_time(F.lit(text))) == want
    for ms, want in ((6170000, "1:42:50"), (65000, "1:05"), (-5, "0:00")):
        assert one(spark, tc.fmt(F.lit(ms))) == want
    assert one(spark, tc.keyframe_times(F.lit(0), F.lit(20000))) == [3333, 10000, 16666]


def test_reliability(spark):
    for lp, lg, wp, want in ((0.4, None, None, "other_language"), (0.9, -1.3, None, "low_confidence"), (None, None, 0.3, "low_confidence"), (None, None, None, None)):
        assert one(spark, tx.unreliable_reason(F.lit(lp).cast("double"), F.lit(lg).cast("double"), F.lit(wp).cast("double"))) == want


def test_merge_shots(spark):
    rows = [("v", 0, 305000, False, True, [1]), ("v", 295000, 310000, True, False, [2]), ("v", 309000, 320000, False, False, [3]), ("v", 310500, 311000, False, False, [])]
    d = spark.createDataFrame(rows, "video_id string, start_ms bigint, end_ms bigint, clipped_start boolean, clipped_end boolean, keyframes array<bigint>")
    got = [(r.start_ms, r.end_ms, r.keyframes) for r in folds.merge_shots(d).orderBy("shot").collect()]
    assert got == [(0, 310000, [1, 2]), (310000, 320000, [3])]


def test_segment_hand(spark):
    rows = [("v", i + 1, i * 10000, (i + 1) * 10000, False, s) for i, s in enumerate((0.9, 0.6, 0.1, 2.0, None))]
    d = spark.createDataFrame(rows, "video_id string, shot int, start_ms bigint, end_ms bigint, graphic boolean, score double")
    assert [(r.first, r.last) for r in folds.segment(d).orderBy("scene").collect()] == [(1, 2), (3, 4), (5, 5)]


def model_segment(shots, s):
    groups = [[shots[0]]]
    for before, x in zip(shots, shots[1:]):
        g = groups[-1]
        score = before[3] or 0
        if score >= 2 or (score >= s.scene_cut and before[1] - g[0][0] >= s.scene_min_ms) or x[1] - g[0][0] > s.scene_max_ms:
            groups.append([x])
        else:
            g.append(x)
    if len(groups) > 1 and groups[-1][-1][1] - groups[-1][0][0] < s.scene_min_ms // 2 and not groups[-1][0][2] and not groups[-2][0][2]:
        last = groups.pop()
        groups[-1] += last
    return [(g[0][0], g[-1][1]) for g in groups]


def test_segment_model(spark):
    rng, rows, want = random.Random(1), [], {}
    for v in range(30):
        at, shots = 0, []
        for i in range(rng.randrange(1, 40)):
            end = at + rng.randrange(1000, 60000)
            shots.append((at, end, rng.random() < 0.1, rng.choice([0.1, 0.5, 0.7, 2.0])))
            rows.append((str(v), i + 1, *shots[-1]))
            at = end
        want[str(v)] = model_segment(shots, DEFAULTS)
    d = spark.createDataFrame(rows, "video_id string, shot int, start_ms bigint, end_ms bigint, graphic boolean, score double")
    got = {}
    for r in folds.segment(d).orderBy("video_id", "scene").collect():
        got.setdefault(r.video_id, []).append((r.start_ms, r.end_ms))
    assert got == want


def test_chapters(spark):
    d = spark.createDataFrame([("v", i + 1, i * 250000, (i + 1) * 250000) for i in range(5)], "video_id string, scene int, start_ms bigint, end_ms bigint")
    assert [(r.first, r.last) for r in folds.plan_chapters(d).orderBy("chapter").collect()] == [(1, 3), (4, 5)]


def test_overlap_model(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("xy"), i, s, s + rng.choice([1, 5, 50, 900])) for i in range(n) for s in (rng.randrange(1000),)]
    a, b = make(60), make(60)
    kind = "video_id string, id int, start_ms bigint, end_ms bigint"
    got = sorted((r.a_id, r.b_id) for r in intervals.overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 20).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_rank_and_thin(spark):
    d = spark.createDataFrame([("v", 0, 0.2), ("v", 1, 0.9), ("v", 2, 0.5), ("w", 0, 0.1)], "k string, i int, x double")
    assert sorted((r.k, r.i, r["rank"]) for r in windows.ordinal_rank(d, ["k"], "x", "i").collect()) == [("v", 0, 0.0), ("v", 1, 1.0), ("v", 2, 0.5), ("w", 0, 0.5)]
    e = spark.createDataFrame([("v", i) for i in range(5)], "k string, i int")
    assert sorted(r.i for r in windows.thin(e, ["k"], 3, "i").collect()) == [0, 1, 3]


def test_collapse_text(spark):
    rows = [("v", 0, "Hello there", 12000), ("v", 2000, "Hello there!", 12000), ("v", 10000, "Hello  there", 12000), ("v", 11500, "Other words", 20000)]
    got = folds.collapse_text(spark.createDataFrame(rows, "video_id string, ts_ms bigint, text string, shot_end_ms bigint")).collect()
    assert [(r.start_ms, r.end_ms, r.frames) for r in got] == [(0, 11500, [0, 2000, 10000]), (11500, 15500, [11500])]


def test_route(spark):
    got = one(spark, grounding.route(F.lit("between 1:42:50 and 1:50:00")))
    assert [(x.action, x.start_ms, x.end_ms) for x in got] == [("get_range", 6170000, 6600000)]
    assert [(x.start_ms, x.end_ms) for x in one(spark, grounding.route(F.lit("at 0:45")))] == [(30000, 60000)]


def test_unverified(spark):
    c = spark.createDataFrame([("v", 65000), ("v", 120000)], "video_id string, ts_ms bigint")
    assert [r.ts_ms for r in intervals.unverified(c, spark.createDataFrame([("v", 62000)], "video_id string, ts_ms bigint")).collect()] == [120000]


def test_search_dialogue(spark):
    d = spark.createDataFrame([(0, "a", "Well, hello there friend"), (1, "b", "helo ther frend"), (2, "c", "nothing")], "start_ms int, id string, text string")
    assert [(r.id, r.score) for r in retrieval.search_dialogue(d, "Hello there").collect()][0] == ("a", 1.0)
    assert retrieval.search_dialogue(d, " ").count() == 0


def test_srt(spark):
    text = "1\n00:00:01,500 --> 00:00:03,000\n<i>Hello</i> there\n\n2\n00:00:04.000 --> 00:00:05.000\n{x}\n\nno time\n\n3\n01:00:00,5 --> 01:00:01,000\na 2\nb 2"
    got = parse_srt(spark.createDataFrame([(text,)], "c string"), "c", []).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1500, 3000, "Hello there"), (3600005, 3601000, "a 2 b 2")]


def test_stages_resume(spark, tmp_path):
    root = str(tmp_path)
    rows = [("a", "x", 0, 0, 10, 0, 10, None), ("b", "x", 0, 0, 10, 0, 10, None)]
    from timeloom.schemas import schema

    sinks.write_table(spark.createDataFrame(rows, schema("chunks")), root, "chunks")
    shots = Stage("shots", ("chunks",), lambda t: t["chunks"].select("video_id", F.lit(1).alias("shot"), "start_ms", "end_ms", F.array().cast("array<bigint>").alias("keyframes")))
    assert run_stages(spark, root, [shots]) == {"shots": 2}
    assert run_stages(spark, root, [shots]) == {"shots": 0}
    sinks.write_table(spark.createDataFrame([("b", "x", 0, 0, 20, 0, 20, None)], schema("chunks")), root, "chunks")
    assert run_stages(spark, root, [shots]) == {"shots": 1}
    assert artifacts.read_table(spark, root, "shots").count() == 2
    assert artifacts.read_table(spark, root, "profiles").count() == 0


def test_agent():
    class Model:
        def __init__(self, *replies):
            self.replies = list(replies)

        def generate_json(self, system, prompt):
            return self.replies.pop(0)

    tools = {"search_moments": lambda query: (query, [1000], [(query, 0, 5)])}
    a = ask("q", [], tools, Model({"action": "search_moments", "query": "x"}, {"action": "answer", "answer": "yes"}))
    assert a.text == "yes" and a.times == [1000] and len(a.calls) == 1
    assert to_call({"action": "find_scenes_by_tag", "tag": "nope"}) is None is to_call({"action": "search_dialogue", "query": " "}) is to_call({"action": "answer", "query": "x"})
    assert to_call({"action": "find_scenes_by_tag", "tag": "nope", "query": " x "}) == {"action": "search_moments", "query": "x"}
    assert to_call({"action": "find_scenes_by_tag", "tag": "fight", "query": "x"}) == {"action": "find_scenes_by_tag", "tag": "fight"}
    assert to_call({"action": "get_range", "start": "x"}) is None and to_call({"action": "get_characters"}) == {"action": "get_characters"}
    assert [parse_ms(x) for x in ("1:42:50", "95.5", "x", None, "1e999", "nan")] == [6170000, 95500, None, None, None, None]
    assert to_call({"action": "get_range", "start": "0:10", "end": "x"}) == {"action": "get_range", "start_ms": 10000, "end_ms": 40000}


def test_best_variant(spark):
    d = spark.createDataFrame([("v", "t", "ab", 0), ("v", "t", "abc", 1), ("v", "t", "abd", 2), ("v", "t", "abd", 3)], "video_id string, id string, text string, pos int")
    assert aggregates.best_variant(d).first().text == "abd"


def test_job_stream(spark, tmp_path):
    from timeloom.streaming.jobs import job_queue

    (tmp_path / "in").mkdir()
    for i, v in enumerate("aba"):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"video_id": "{v}", "queued_at": "2024-01-01T00:00:0{i}Z"}}')
    seen = []
    job_queue(spark, str(tmp_path / "in"), str(tmp_path / "c"), lambda d, _: seen.extend(r.video_id for r in d.collect())).awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_entry_and_schemas(spark):
    import __spark_entry__
    from timeloom.schemas import DDL, schema

    assert all(schema(n).names[0] == "video_id" for n in DDL)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert dataclasses.replace(DEFAULTS, chunk_ms=1).chunk_ms == 1


def test_window_ratio_equals_plain_loop():
    import difflib
    import random

    import pandas as pd

    from timeloom.functions.fuzzy import alike, ratio_of, window_ratio

    rng = random.Random(3)
    lines = ["".join(rng.choice("abcé 😀") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    for q in ("abcab é", "a", "b😀b c abca"):
        step, got = max(len(q) // 4, 1), window_ratio(0.5).func(pd.Series([q] * len(lines)), pd.Series(lines))
        for t, g in zip(lines, got, strict=True):
            want = max(difflib.SequenceMatcher(None, q, t[i : i + len(q)]).ratio() for i in range(0, max(len(t) - len(q), 0) + 1, step))
            assert g == want if want >= 0.5 else g < 0.5
    lines += ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(6)]
    lines += [x[:200] + "zz" + x[230:] for x in lines[-6:]]
    for a, b in [*zip(lines, lines[1:], strict=False), *zip(lines[-12:-6], lines[-6:], strict=True)]:
        assert alike(a, b, 0.4) == (ratio_of(a, b) >= 0.4) and alike(a, b, 0.4, strict=True) == (ratio_of(a, b) > 0.4)


def test_tag_scores_more_tags_than_are_broadcast(spark):
    n = retrieval.TAGS_BROADCAST + 200
    tags = spark.range(n).selectExpr("cast(id as string) tag", "array(cast(id as float), 1f) tag_embedding")
    scenes = spark.range(3).selectExpr("'v' video_id", "id scene", "array(1f, cast(id as float)) embedding", "map('1', 0.9d) tags")
    got = retrieval.tag_scores(scenes, tags)
    assert got.count() == 3 * n and got.select("tag").distinct().count() == n
