"""Operators that SQL can't express against plain Python; tools, prompts, models and streams on small tables."""

import difflib
import json
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from timeloom import models
from timeloom.functions import normalise
from timeloom.operators import aggregates, answers, folds, intervals
from timeloom.plans import catalog, describe, prompts
from timeloom.plans.agent import ask
from timeloom.schemas import schema
from timeloom.sources import artifacts, sinks
from timeloom.sources.layout import Layout
from timeloom.streaming import jobs


def plain_form(text):
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", "", text.lower())).strip()


def alike(a, b):
    x, y = plain_form(a), plain_form(b)
    return bool(x and y) and (x in y or y in x or difflib.SequenceMatcher(None, x, y).ratio() >= 0.8)


def plain_collapse(frames):
    """frames of one video: (ts, text, shot end) -> (start, end, text, frames)."""
    spans = []
    for ts, text, shot_end in sorted((t, x.strip(), e) for t, x, e in frames if x and x.strip()):
        last = spans[-1] if spans else None
        if last and (ts - last[0][-1] <= 6000 or shot_end == last[3]) and alike(last[2], text):
            last[0].append(ts)
            last[1].append(text)
            last[3] = shot_end
            if len(plain_form(text)) > len(plain_form(last[2])):
                last[2] = text
        else:
            spans.append([[ts], [text], text, shot_end])
    out = []
    for k, (times, texts, _, shot_end) in enumerate(spans):
        end = min([shot_end, times[-1] + 4000] + [s[0][0] for s in spans[k + 1 : k + 2]])
        ranked = sorted(range(len(texts)), key=lambda i: (-len(plain_form(texts[i])), -texts.count(texts[i]), texts.index(texts[i])))
        out.append((times[0], max(end, times[-1] + 1), texts[ranked[0]], times))
    return out


def test_text_collapse_plain(spark):
    docs = [tuple(r) for r in catalog.frames(spark, SF).collect()]
    got = {}
    for r in catalog.text_collapse(spark, SF).orderBy("video_id", "id").collect():
        got.setdefault(r.video_id, []).append((r.start_ms, r.end_ms, r.text, [int(x) for x in r.frames.split(",")]))
    want = {v: plain_collapse([r[1:] for r in docs if r[0] == v]) for v in {r[0] for r in docs}}
    assert got == {v: x for v, x in want.items() if x}


def test_text_collapse_runs(spark):
    """Readings that drift, come back after a gap, in the same shot or not, with blanks and repeated times."""
    base = ["Hello there", "Hello ther", "hello there my friend", "", "Other words here", "Other words", None, "!!", "zz"]
    rows = [(v, (i * 3 + v * i % 7) * 1000, base[(i * (v + 2) + i // 4) % len(base)], (i // (v % 4 + 2) + 1) * 20000) for v in range(12) for i in range(30)]
    d = spark.createDataFrame(rows, "video_id int, ts_ms bigint, text string, shot_end_ms bigint")
    got = {}
    for r in folds.collapse_text(d).orderBy("video_id", "id").collect():
        got.setdefault(r.video_id, []).append((r.start_ms, r.end_ms, r.text, r.frames))
    assert got == {v: plain_collapse([x[1:] for x in rows if x[0] == v]) for v in range(12)}
    assert folds.collapse_text(d.limit(0)).count() == 0


def test_near_duplicate_notes_plain(spark):
    rows = sorted((r.doc_id // 16, r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = []
    for v in sorted({r[0] for r in rows}):
        kept = []
        for text in (r[2] for r in rows if r[0] == v and r[2]):
            if all(difflib.SequenceMatcher(None, text, k).ratio() <= 0.8 for k in kept):
                kept.append(text)
        if len(kept) > 12:
            kept = [kept[int(i * (len(kept) / 12))] for i in range(12)]
        want += [(v, k + 1, t[:300]) for k, t in enumerate(kept)]
    assert sorted(tuple(r) for r in catalog.near_duplicate_notes(spark, SF).collect()) == want


def test_search_dialogue_fuzzy_plain(spark):
    q = "the reanin of thand"
    lines = [(r.turn, f"{r.conv_id:06d}-{r.turn:04d}", r.text.lower()) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    word = re.compile(r"[\w'-]+")

    def score(t):
        if q in t:
            return 1.0
        best = max(difflib.SequenceMatcher(None, q, t[i : i + len(q)]).ratio() for i in range(0, max(len(t) - len(q), 0) + 1, len(q) // 4))
        asked = set(word.findall(q))
        return max(best, len(asked & set(word.findall(t))) / len(asked))

    want = sorted(((-round(s, 2), turn, i) for turn, i, t in lines if (s := score(t)) >= 0.5))[:8]
    assert [(-r.score, r.id) for r in catalog.search_dialogue_fuzzy(spark, SF).collect()] == [(s, i) for s, _, i in want]


def test_embed_hash_plain(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.embed_hash(spark, SF).collect():
        v = [0.0] * 16
        for w in re.findall(r"[^\W]+(?:['-]|[^\W])*|['-]+(?:['-]|[^\W])*", (rows[r.doc_id] or "").lower()):
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            slot = (h - (1 << 64) if h >> 63 else h) % 32
            v[slot % 16] += 1 if slot < 16 else -1
        n = max(sum(x * x for x in v) ** 0.5, 1e-12)
        assert [float(x) for x in r.embedding.split(",")] == pytest.approx([x / n for x in v], abs=6e-5)


def test_nearest_plain(spark):
    import random

    rng = random.Random(9)
    spans = [(rng.choice("xy"), i, s, s + rng.choice([0, 1, 30, 200])) for i in range(50) for s in (rng.randrange(2000),)]
    points = [(rng.choice("xyz"), i, p, p + 1) for i in range(120) for p in (rng.randrange(-50, 2300),)] + [("x", 500, 7, 7), ("x", 500, 7, 7)]
    kind = "video_id string, {} int, start_ms bigint, end_ms bigint"
    d = intervals.nearest(spark.createDataFrame(points, kind.format("id")), spark.createDataFrame(spans, kind.format("shot")), F.col("start_ms"), 40)
    want = []
    for v, i, p, e in points:
        of = [((0 if s <= p < t else min(abs(p - s), abs(p - t))), k) for w, k, s, t in spans if w == v]
        if of:
            want.append((v, i, p, e, min(of)[1], min(of)[0]))
    assert sorted(tuple(r) for r in d.collect()) == sorted(want)


def test_semi_join_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("v", 1, 0, 10)] * 3 + [("v", 2, 50, 60)], "video_id string, id int, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([("v", 9, 5, 6), ("v", 9, 7, 30)], "video_id string, id int, start_ms bigint, end_ms bigint")
    assert [r.a_id for r in intervals.overlap_join(a, b, 4, "left_semi").collect()] == [1, 1, 1]


def test_folds_are_linear(spark):
    n = 40000
    d = spark.range(n).selectExpr("'v' video_id", "cast(id as int) shot", "id * 1000 start_ms", "id * 1000 + 1000 end_ms", "false graphic", "cast(id % 10 as double) / 10 score")
    began = time.monotonic()
    assert folds.segment(d).count() > 100
    raw = d.selectExpr("video_id", "start_ms", "end_ms + 100 end_ms", "true clipped_start", "shot % 3 <> 0 clipped_end", "array(start_ms) keyframes")
    assert folds.merge_shots(raw).agg(F.sum(F.size("keyframes"))).first()[0] == n
    assert time.monotonic() - began < 60


def test_mentions_of_odd_names(spark):
    lines = ["Dr. Who came", "the dr. whoever", "Ann-Lee and Ann", "ann\\E lee", "É. Zola said", "anna"]
    names = ["dr. who", "ann", "ann-lee", "ann\\e lee", "é. zola", "???", "lee and ann"]
    n = spark.createDataFrame([("v", x) for x in names], "video_id string, key string")
    got = {r.key: r.mentions for r in aggregates.mention_counts(n, spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "video_id string, id int, text string")).collect()}
    assert got == {x: sum(bool(re.search(r"\b" + re.escape(x) + r"\b", t.lower())) for t in lines) for x in names}


def test_words_of_lines_are_not_broadcast(spark, tmp_path):
    """A small file of many words: its size says nothing about theirs, so no join may broadcast the words or carry their lines with them."""
    spark.range(300).selectExpr("'v' video_id", "id", "repeat('Ann Bob and so on ', 200) text").coalesce(1).write.parquet(str(tmp_path / "lines"))
    names = spark.createDataFrame([("v", "ann"), ("v", "ann bob"), ("v", "so off")], "video_id string, key string")
    got = aggregates.mention_counts(names, spark.read.parquet(str(tmp_path / "lines")))
    plan = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not [x for x in plan if "BroadcastHashJoin" in x and "word#" in x]
    assert not [x for x in plan if "Generate explode" in x and "line#" in x.split(")), [")[-1]]
    assert {r.key: r.mentions for r in got.collect()} == {"ann": 300, "ann bob": 300, "so off": 0}


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda name, rows: spark.createDataFrame(rows, schema(name))
    scene = lambda k, a, b, **x: {"video_id": "v", "scene": k, "start_ms": a, "end_ms": b, "graphic": False, "title": f"T{k}", "description": f"D{k}", "characters": ["Ann", "Dr. Who"], "location": "", "time_of_day": "day", "mood": "calm", "events": [], "tags": {"fight": 0.7, "sad": 0.6}, "tag_evidence": {"fight": "blows"}, **x}
    rows = {
        "scenes": [scene(1, 0, 20000), scene(2, 20000, 60000, characters=["ann"], error=None), scene(3, 60000, 90000, error="bad"), scene(4, 90000, 120000, graphic=True, description="", tags={})],
        "dialogue": [{"video_id": "v", "id": f"d{k}", "start_ms": k * 5000, "end_ms": k * 5000 + 2000, "text": t, "reliable": r} for k, (t, r) in enumerate([("Hello there Ann", True), ("bonjour", False), ("Dr. Who is here", True)])],
        "on_screen_text": [{"video_id": "v", "id": "t1", "start_ms": 95000, "end_ms": 99000, "text": "THE END", "frames": [95000]}],
        "tag_scores": [{"video_id": "v", "scene": 2, "tag": "fight", "score": 0.9}],
        "chapters": [{"video_id": "v", "chapter": k, "start_ms": a, "end_ms": a + 60000, "scenes": {"first": 2 * k - 1, "last": 2 * k}, "title": f"C{k}", "summary": f"Sum {k}", "characters": ["Ann"]} for k, a in ((1, 0), (2, 60000))],
        "profiles": [{"video_id": "v", "video_type": "trailer", "genres": [{"genre": "war", "confidence": 0.5, "evidence": "guns"}], "plot": "P", "characters": [{"name": "Ann", "role": "lead", "description": "x"}], "themes": ["a", "b"], "tag_stats": {"sad": 0.25, "fight": 0.5}}],
        "items": [{"video_id": "v", "pos": k, "id": f"scene:{k}", "kind": "scene", "scene": k, "start_ms": k * 1000, "end_ms": k * 1000 + 500, "text": f"text {k}", "embedding": [1.0, float(k)]} for k in range(3)],
    }
    whole = {k: [{f.name: None for f in schema(k)} | r for r in v] for k, v in rows.items()}
    return {k: make(k, [tuple(r[f.name] for f in schema(k)) for r in v]) for k, v in whole.items()}


class Model:
    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def generate_json(self, system, prompt):
        self.asked.append(prompt)
        return self.replies.pop(0)


def test_toolbox_and_grounding(spark, tables):
    box = answers.Toolbox(tables, "v", embed=lambda q: [0.0, 1.0])
    t = box.tools()
    text, times, items = t["get_range"](0, 25000)
    assert text.split("\n") == ["Window 0:00-0:25", "- scene 1 [0:00-0:20] T1: D1", "- scene 2 [0:20-1:00] T2: D2", "- says [0:00] Hello there Ann", "- says [0:05] [speech in another language]", "- says [0:10] Dr. Who is here"]
    assert items == [("scene 1: T1", 0, 20000), ("scene 2: T2", 20000, 60000)] and times[-2:] == [0, 25000] and 12000 in times
    assert t["get_range"](400000, 400000)[0].split("\n") == ["Window 6:40-6:41", "(nothing in this window, which may lie outside the video)"]
    assert t["find_scenes_by_tag"]("fight")[0].split("\n") == ["- scene 2 [0:20-1:00] T2 (score 0.90) evidence: blows", "- scene 1 [0:00-0:20] T1 (score 0.70) evidence: blows"]
    assert t["find_scenes_by_tag"]("death")[0] == "(no scenes tagged death)"
    assert t["search_dialogue"]("hello there")[0] == '- says [0:00] "Hello there Ann" (match 1.00)' and t["search_dialogue"]("bonjour")[0] == "(no matching line)"
    assert t["search_moments"]("x")[2][0] == ("scene: text 2", 2000, 2500)
    assert t["get_chapter_summaries"](60000)[0] == "- chapter 2 [1:00-2:00] C2: Sum 2" and len(t["get_chapter_summaries"]()[2]) == 2
    assert t["get_characters"]()[0].split("\n")[:5] == ["main characters (from the summary):", "- Ann (lead): x", "people listed per scene:", "- Ann: scenes 1, 2, 4 [0:00-2:00], named in 1 lines", "- Dr. Who: scenes 1, 4 [0:00-2:00], named in 1 lines"]
    assert "genres: war 0.5 (guns)" in t["get_movie_summary"]()[0] and "tag share of scenes: fight 50%, sad 25%" in t["get_movie_summary"]()[0]
    with pytest.raises(LookupError):
        answers.Toolbox(tables, "w").get_movie_summary()
    steps = []
    a = ask("q", [{"action": "get_range", "start_ms": 0, "end_ms": 25000}], t, Model({"action": "answer", "answer": "At [0:10] and [9:00]."}), on_step=steps.append, spark=spark)
    assert a.sources == [("scene 1: T1", 0, 20000)] and a.unverified == [540000] and len(steps) == 1
    a = ask("q", [], t, Model({"action": "get_movie_summary"}, {"action": "get_movie_summary"}, {"answer": ""}), spark=spark)
    assert a.text.startswith("I could not") and a.sources == [] and len(a.calls) == 1


def test_prompts(spark, tables):
    s, d, t = tables["scenes"], tables["dialogue"], tables["on_screen_text"]
    in_scene = lambda x, k: x.withColumn("scene", F.lit(k))
    visuals = spark.createDataFrame([("v", 1, 1000, "a man runs fast", ["hat", "car"], False), ("v", 1, 2000, "a man runs fast!", ["car"], False), ("v", 1, 3000, "logo", ["x"], True)], "video_id string, scene int, ts_ms bigint, description string, objects array<string>, graphic boolean")
    base = s.select("video_id", "scene", "start_ms", "end_ms", F.lit(2).alias("n_shots"))
    got = {r.scene: r.prompt for r in prompts.scene_prompts(base, in_scene(d, 1), in_scene(t, 4), visuals).collect()}
    assert got[1] == 'SCENE 1: 0:00 to 0:20 (20 s, 2 shots)\n\nDIALOGUE:\n[0:00] "Hello there Ann"\n[0:05] [speech in another language]\n[0:10] "Dr. Who is here"\n\nON-SCREEN TEXT:\n(none)\n\nVISUAL NOTES (may contain errors):\n[0:01] a man runs fast\n\nOBJECTS SEEN: car, hat'
    assert '"THE END"' in got[4] and "(no dialogue)" in got[4] and "OBJECTS" not in got[4]
    chapters = tables["chapters"].select("video_id", "chapter", "start_ms", "end_ms", "scenes.first", "scenes.last")
    got = {r.chapter: r.prompt for r in prompts.chapter_prompts(chapters, s, d, t).collect()}
    assert got[1].split("\n")[:5] == ["CHAPTER 1: 0:00:00 to 0:01:00 (2 scenes)", "", "SCENES:", "[0:00:00-0:00:20] T1. D1 Mood: calm. Tags: fight, sad.", "[0:00:20-0:01:00] T2. D2 Mood: calm. Tags: fight, sad."]
    assert '[0:00:00] says: "Hello there Ann"' in got[1] and "bonjour" not in got[1]
    assert "(no description)" in got[2] and "Title card / credits: (no text)" in got[2] and 'on screen: "THE END"' in got[2]
    tags = s.filter("error is null and not graphic").select("video_id", "scene", F.explode("tags").alias("tag", "confidence"))
    p = prompts.profile_prompts(tables["chapters"], s, t, aggregates.tag_stats(tags)).first().prompt
    assert p.startswith("VIDEO LENGTH: 0:02:00 (4 scenes, 2 chapters)\n\nCHAPTERS:\nChapter 1 [0:00:00-0:01:00] C1: Sum 1\n  Characters: Ann") and p.endswith("TEXT ON TITLE CARDS: THE END") and "  fight: 100%" in p and "[0:00:20] T2: D2" in p


class Scripted:
    def generate_json(self, system, prompt):
        if "boom" in prompt:
            raise RuntimeError("boom")
        return {"title": " A ", "tags": {"fight": 2}, "summary": prompt, "genres": [{"genre": "war", "evidence": "e"}]}


def test_described(spark, tables):
    scenes = spark.createDataFrame([("v", 1, False), ("v", 2, True), ("v", 3, False)], "video_id string, scene int, graphic boolean")
    asked = spark.createDataFrame([("v", 1, "p"), ("v", 3, "boom")], "video_id string, scene int, prompt string")
    texts = spark.createDataFrame([("v", 2, "b", 5, "two"), ("v", 2, "a", 1, "one"), ("v", 2, "a", 1, "one")], "video_id string, scene int, id string, start_ms bigint, text string")
    got = {r.scene: r for r in describe.describe_scenes(scenes, asked, texts, Scripted).collect()}
    assert (got[1].title, got[1].tags["fight"], got[1].tags["sad"], got[1].error) == ("A", 1.0, 0.0, None) and len(got[1].tags) == 20
    assert (got[2].title, got[2].description, got[2].tags["fight"], got[2].characters) == ("Title card / credits", "one / two", 0.0, [])
    assert got[3].error == "boom" and got[3].title is None
    c = describe.summarise_chapters(spark.createDataFrame([("v", 1, "words")], "video_id string, chapter int, prompt string"), Scripted).first()
    assert c.summary == "words" and c.title == "A" and c.events == []
    chapters = spark.createDataFrame([("v", None), ("w", "bad")], "video_id string, error string")
    p = {r.video_id: r for r in describe.build_profiles(spark.createDataFrame([("v", "x"), ("w", "x")], "video_id string, prompt string"), chapters, Scripted).collect()}
    assert p["v"].video_type == "other" and p["v"].genres[0].genre == "war" and p["w"].error == "all chapter summaries failed" and p["w"].plot is None


def test_normalisers_of_odd_json(spark):
    odd = [None, "", "nope", "[]", "3", '{"tags": 5, "characters": {"a": 1}, "title": ["x"]}', '{"tags": [{"tag": "fight", "confidence": []}, {"tag": null}], "people": [], "genres": {}}', '{"tags": {"fight": true, "sad": null, "death": "1e9"}}']
    d = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, j string")
    s = {r.i: r.s for r in d.select("i", normalise.scene(F.col("j")).alias("s")).collect()}
    assert all(len(x.tags) == 20 and x.title == "" and x.characters == [] and x.time_of_day == "unknown" for x in s.values())
    assert s[6].tag_evidence == {"fight": ""} and (s[7].tags["fight"], s[7].tags["sad"], s[7].tags["death"]) == (1.0, 0.0, 1.0)
    assert [s[i].valid for i in range(8)] == [False, False, False, True, True, True, True, True]
    for f in (normalise.frame, normalise.chapter, normalise.profile):
        assert d.select(f(F.col("j")).alias("x")).count() == len(odd)
    assert d.select(normalise.profile(F.col("j")).alias("x")).filter("x.video_type = 'other' and size(x.genres) = 0").count() == len(odd)


def test_reply_pieces(spark):
    d = spark.createDataFrame([('{"response": "a\nb", "done": false}',), ('{"done": true}',), ("",), ("oops",), ('{"error": "e"}',)], "value string")
    assert [(r.piece, r.done, r.error) for r in jobs.reply_pieces(d).collect()] == [("a\nb", False, None), ("", True, None), ("", False, "not a reply: oops"), ("", False, "e")]


def test_requeued_job_runs_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (v, t) in enumerate([("a", 0), ("a", 0), ("b", 1), ("a", 0)]):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"video_id": "{v}", "queued_at": "2024-01-01T00:00:0{t}Z"}}')
    seen = []
    run = lambda: jobs.job_queue(spark, str(tmp_path / "in"), str(tmp_path / "c"), lambda d, _: seen.extend(r.video_id for r in d.collect())).awaitTermination(120)
    run()
    (tmp_path / "in" / "9.json").write_text('{"video_id": "a", "queued_at": "2024-01-01T00:05:00Z"}')
    run()
    assert seen == ["a", "b", "a"]


def test_landed_media_and_saved_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.mp4", 5), ("b.mkv", 0), ("c.txt", 3), ("d.mov", 99)):
        (tmp_path / "in" / name).write_bytes(b"x" * n)
    d = jobs.landed_media(spark, str(tmp_path / "in"), 50)
    jobs.save_parts(d.withColumn("video_id", F.col("name")), str(tmp_path / "out"), "landed", str(tmp_path / "c")).awaitTermination(120)
    got = {r.name: r.error for r in spark.read.parquet(str(tmp_path / "out" / "landed")).collect()}
    assert got == {"a.mp4": None, "c.txt": "unknown kind of file", "d.mov": "too large"}


def test_models_as_row_functions(spark):
    class Eye:
        def describe(self, images):
            if any(x == b"bad" for x in images):
                raise ValueError("bad image")
            return [{"n": len(x)} for x in images]

    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([b"a", b"bad", b"ccc"])], "k int, content binary").coalesce(1)
    assert sorted((r.k, r.reply, r.error) for r in models.describe_images(rows, Eye).collect()) == [(0, '{"n": 1}', None), (1, None, "bad image"), (2, '{"n": 3}', None)]

    class Ear:
        def transcribe(self, samples, language, offset_ms):
            if language == "xx":
                raise ValueError("no such language")
            return [{"start_ms": offset_ms + k, "end_ms": offset_ms + k + 1, "text": "t", "lang": language, "words": [{"start_ms": 1, "end_ms": 2, "word": "w", "prob": 0.5}]} for k in range(len(samples))]

    s = spark.createDataFrame([("v", "c1", 100, [0.0, 0.0], "en"), ("v", "c2", 0, [0.0], "xx")], "video_id string, chunk_id string, start_ms bigint, samples array<float>, language string")
    got = models.transcribe(s, Ear).orderBy("chunk_id", "start_ms").collect()
    assert [(r.chunk_id, r.start_ms, r.error) for r in got] == [("c1", 100, None), ("c1", 101, None), ("c2", None, "no such language")] and got[0].words[0].prob == 0.5

    class Cutter:
        def detect(self, content, start_ms, end_ms):
            return [(start_ms, start_ms + 5), (start_ms + 5, end_ms)]

    w = spark.createDataFrame([("v", "c", 10, 30, bytearray(b"x"))], "video_id string, chunk_id string, start_ms bigint, end_ms bigint, content binary")
    assert sorted((r.start_ms, r.end_ms) for r in models.detect_shots(w, Cutter).collect()) == [(10, 15), (15, 30)]
    red = models.hsv_histogram(np.full((4, 4, 3), (255, 0, 0)))
    assert len(red) == 288 and red[(0 * 6 + 5) * 4 + 3] == 1.0 and sum(red) == 1.0
    images = spark.createDataFrame([(1, bytearray(b"\x00\x00\xff" * 4)), (2, bytearray(b"x"))], "k int, content binary")
    h = {r.k: r.histogram for r in models.histograms(images, lambda b: np.frombuffer(b, np.uint8).reshape(-1, 1, 3)).collect()}
    assert h[2] is None and h[1][(8 * 6 + 5) * 4 + 3] == 1.0
    with pytest.raises(RuntimeError):
        models.ready(type("M", (), {"check_ready": lambda self: (_ for _ in ()).throw(RuntimeError("down"))})())


def test_artifacts_read_back(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video_id": "v", "chunk_id": "c1", "segments": [{"start_ms": 0, "end_ms": 5, "text": "line\none", "words": []}]}).replace("\\n", "\n"))
    assert [r.text for r in artifacts.load_segments(spark, str(tmp_path / "*.json")).collect()] == ["line\none"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b.json").write_text(json.dumps({"video_id": "v", "chunk_id": "c1", "shots": [{"start_ms": 0, "end_ms": 5, "clipped_start": False, "clipped_end": True, "keyframes": [{"ts_ms": 3, "file": "f"}]}], "frames": [{"ts_ms": 3, "caption": "x", "objects": ["o"]}]}))
    shots = artifacts.load_shots(spark, str(tmp_path / "s" / "*.json"))
    assert [(r.ts_ms, r.file) for r in artifacts.keyframes(shots).collect()] == [(3, "f")]
    assert artifacts.load_captions(spark, str(tmp_path / "s" / "*.json")).first().objects == ["o"]
    assert artifacts.load_captions(spark, str(tmp_path / "none" / "*.json")).count() == 0
    assert [r.video_id for r in artifacts.list_videos(shots).collect()] == ["v"]
    sinks.append_run(spark, str(tmp_path / "r"), ["v"], "shots", "running")
    sinks.append_run(spark, str(tmp_path / "r"), ["v"], "shots", "done", 1.5)
    from timeloom.operators import summaries

    runs = sinks.latest_runs(artifacts.read_table(spark, str(tmp_path / "r"), "stage_runs"))
    summaries.require_done(runs, "shots", "v")
    with pytest.raises(RuntimeError):
        summaries.require_done(runs, "scenes", "v")
    assert Layout("/x").frame("vid_1", 5) == "/x/media/vid_1/frames/000000005.jpg" and Layout("/x").table("scenes") == "/x/scenes"
    with pytest.raises(ValueError):
        Layout("/x").media("../y", "z")
    tracks = spark.createDataFrame([("v", "p", [(3, "subrip", "en", True)]), ("w", "p", [(3, "pgs", "en", False)]), ("x", "bad", [(4, "ass", None, True)])], "video_id string, path string, subtitle_tracks array<struct<index: int, codec: string, language: string, is_text: boolean>>")

    def make():
        def read(path, track):
            if path == "bad":
                raise OSError(path)
            return f"{path}:{track}"

        return read

    assert {r.video_id: r.srt for r in artifacts.extract_subtitles(tracks, make).collect()} == {"v": "p:3", "w": None, "x": None}


def test_wrong_dimension_is_an_error(spark):
    from timeloom.operators.retrieval import search_moments

    d = spark.createDataFrame([(0, "t", "scene", [1.0, 0.0])], "pos int, text string, kind string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        search_moments(d, "q", [1.0, 0.0, 0.0]).collect()


def test_rows_that_are_there_are_not_run_again(spark, tmp_path):
    from timeloom.plans.stages import Stage, run_stages

    root, asked = str(tmp_path), spark.sparkContext.accumulator(0)
    empty = {f.name: None for f in schema("chunks")}
    chunk = lambda k: tuple((empty | {"video_id": "v", "id": str(k), "index": k, "start_ms": k * 10, "end_ms": k * 10 + 10}).values())

    def work(t):
        asked.add(t["chunks"].count())
        return t["chunks"].select("video_id", F.col("index").alias("shot"), "start_ms", "end_ms", F.array().cast("array<bigint>").alias("keyframes"))

    stage = Stage("shots", ("chunks",), work, keys=("start_ms", "end_ms"))
    for n in (2, 5):
        sinks.write_table(spark.createDataFrame([chunk(k) for k in range(n)], schema("chunks")), root, "chunks")
        assert run_stages(spark, root, [stage]) == {"shots": 1}
        assert artifacts.read_table(spark, root, "shots").count() == n and asked.value == n
    assert run_stages(spark, root, [stage]) == {"shots": 0}
    sinks.append_job(spark, root, "v", "queued")
    assert artifacts.read_table(spark, root, "jobs").first().status == "queued"


def test_command_line(spark, tables, tmp_path, capsys):
    from timeloom.cli import main

    for k, d in tables.items():
        sinks.write_table(d, str(tmp_path), k)
    say = lambda *a: (main([str(tmp_path), *a]), capsys.readouterr())
    code, out = say("scenes", "v")
    assert code == 0 and out.out.split("\n")[0].startswith("  1  0:00:00-0:00:20  cut=  - ") and "ERROR: bad" in out.out and out.out.rstrip().endswith("-")
    assert say("range", "v", "0:00", "0:05")[1].out.split("\n")[0] == "- scene 1 [0:00-0:20] T1: D1"
    assert say("say", "v", "hello there")[1].out == '- says [0:00] "Hello there Ann" (match 1.00)\n'
    assert say("chapters", "v", "1:00")[1].out == "  2  0:01:00-0:02:00  C2\n" and "?" in say("transcript", "v")[1].out
    code, out = say("tag", "v", "nonsense")
    assert code == 1 and "unknown tag" in out.err
