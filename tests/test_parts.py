"""Small parts: a model's life in a task, languages of segments, files that are taken in, listings, commands."""

import datetime
import re
import sys
import types

import duckdb
import numpy as np
import pytest

from tests.conftest import SF, same
from tests.test_more import tables  # noqa: F401 - a fixture
from timeloom import models
from timeloom.cli import main
from timeloom.functions import text as tx
from timeloom.operators import summaries
from timeloom.plans import catalog
from timeloom.schemas import schema
from timeloom.sources import media, sinks


class Life:
    def __init__(self, log, fails=()):
        self.log, self.fails = log, fails

    def _step(self, name):
        self.log.append(name)
        if name in self.fails:
            raise RuntimeError(name)

    def load(self):
        self._step("load")

    def warm_up(self):
        self._step("warm_up")

    def unload(self):
        self._step("unload")


def test_models_live_as_long_as_their_task():
    log = []
    with models.loaded(lambda: Life(log, ("warm_up",))) as m:
        m._step("call")
    assert log == ["load", "warm_up", "call", "unload"]
    log.clear()
    with pytest.raises(RuntimeError), models.loaded(lambda: Life(log)) as m:
        m.fails = ("call",)
        m._step("call")
    assert log[-1] == "unload"
    log.clear()
    with pytest.raises(RuntimeError), models.loaded(lambda: Life(log, ("load",))):
        log.append("never")
    assert log == ["load", "unload"]
    with models.loaded(lambda: 5) as five:
        assert five == 5


class Ear:
    """Hears the language by the sign of the sound; a loud sample is too much for it."""

    def detect_language(self, samples):
        if np.abs(samples).max() > 5:
            raise RuntimeError("too loud")
        return ("en", {"en": 0.91234, "fr": 0.1}) if samples.mean() > 0 else ("fr", {"fr": 0.8, "en": 0.2})


def test_languages_of_segments(spark):
    assert models.span_of_segment(10_000, 10_100, 10_000, 160_000) == (0, 16_800)  # two seconds around, clamped
    assert models.span_of_segment(12_000, 18_000, 10_000, 160_000) == (32_000, 128_000)
    assert models.span_of_segment(10_000, 10_100, 10_000, 3_999) is None and models.span_of_segment(99_000, 99_500, 0, 16_000) is None
    kind = "video_id string, chunk_id string, start_ms bigint, samples array<float>, language string, segments array<struct<start_ms: bigint, end_ms: bigint, text: string, lang: string, lang_prob: double>>"
    seg = lambda a, b, t: (a, b, t, "xx", 0.5)
    half = [1.0] * 64_000 + [-1.0] * 64_000
    rows = [
        ("v", "c1", 1000, half, "en", [seg(1000, 4000, "a"), seg(6000, 8000, "b"), seg(60_000, 61_000, "c")]),
        ("v", "c2", 0, [9.0] + half[1:], "fr", [seg(0, 1000, "d"), seg(6000, 7000, "e")]),
        ("v", "c3", 0, None, "en", [seg(0, 1000, "f")]),
        ("v", "c4", 0, half, "en", None),
    ]
    got = {r.text: (r.chunk_id, r.lang, r.lang_prob) for r in models.check_languages(spark.createDataFrame(rows, kind), Ear).collect()}
    assert got == {"a": ("c1", "en", 0.912), "b": ("c1", "fr", 0.2), "c": ("c1", "xx", 0.5), "d": ("c2", "xx", 0.5), "e": ("c2", "xx", 0.5), "f": ("c3", "xx", 0.5)}


def test_files_are_taken_in(spark, tmp_path):
    for name, content in (("a.MP4", b"x" * 100), ("b.mkv", b""), ("c.txt", b"x"), ("d.mov", b"y" * 1000)):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    listed = media.landed_files(spark, str(tmp_path), 500)
    assert {r.name: r.error for r in listed.collect()} == {"a.MP4": None, "b.mkv": "empty file", "c.txt": "unknown kind of file", "d.mov": "too large"}
    assert media.landed_files(spark, str(tmp_path / "none"), 1).count() == 0
    root = str(tmp_path / "root")
    rows = [(str(tmp_path / "a.MP4"), "v1"), (f"file://{tmp_path}/d.mov", "v2"), (str(tmp_path / "b.mkv"), "v3"), (str(tmp_path / "gone.mp4"), "v4"), (str(tmp_path / "a.MP4"), "../x"), (None, "v5")]
    files = lambda *r: spark.createDataFrame(list(r), "path string, video_id string").repartition(2)
    got = {r.video_id: r for r in media.import_media(files(*rows), root).collect()}
    assert got["v1"].target.endswith("media/v1/original.mp4") and got["v1"].length == 100 and got["v2"].length == 1000 and got["v3"].error == "empty file"
    assert got["v4"].error == "missing file" and "not a video id" in got["../x"].error and got["v5"].error
    assert (tmp_path / "root/media/v1/original.mp4").read_bytes() == b"x" * 100
    again = media.import_media(files((str(tmp_path / "d.mov"), "v1")), root).first()  # an original stays
    assert again.target.endswith("original.mp4") and again.length == 100 and len(list((tmp_path / "root/media/v1").iterdir())) == 1


def test_newest_first(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    d = spark.createDataFrame([("a", at(1)), ("c", at(3)), ("b", at(3)), ("z", None), ("y", None)], "video_id string, created_at timestamp").repartition(3)
    assert [r.video_id for r in summaries.newest_first(d).collect()] == ["b", "c", "a", "y", "z"]
    assert summaries.newest_first(d.limit(0)).count() == 0


def test_new_video_ids(spark):
    ids = [r.i for r in spark.range(500).select(tx.new_video_id().alias("i")).collect()]
    assert len(set(ids)) == 500 and all(re.fullmatch(r"vid_[0-9a-f]{8}", i) and re.match(tx.VIDEO_ID, i) for i in ids)


@pytest.mark.parametrize("name", ["tags_present", "tolerant_json", "build_items", "first_texts", "caption_flags", "map_union", "tag_queries", "progress_lines", "chapter_json", "frame_json"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df())


def test_commands(spark, tables, tmp_path, capsys, monkeypatch):  # noqa: F811
    for k, d in tables.items():
        sinks.write_table(d, str(tmp_path), k)
    row = lambda name, **v: tuple(({f.name: None for f in schema(name)} | v).values())
    more = {
        "media": [row("media", video_id="v", duration_ms=60_000, container="mov")],
        "chunks": [row("chunks", video_id="v", id="c1", index=0, core_start_ms=0, core_end_ms=300_000, start_ms=0, end_ms=305_000, stages={"b": "done", "a": "failed"})],
        "shots": [row("shots", video_id="v", shot=1, start_ms=0, end_ms=2500, keyframes=[0, 1250])],
        "captions": [row("captions", video_id="v", ts_ms=5000, file="f.jpg", caption="A man.", on_screen_text="EXIT", mood="calm", objects=["hat", "dog"]), row("captions", video_id="v", ts_ms=9000, file="g.jpg", error="no reply")],
    }
    for name, rows in more.items():
        sinks.write_table(spark.createDataFrame(rows, schema(name)), str(tmp_path), name)
    say = lambda *a: (main([str(tmp_path), *a]), capsys.readouterr())
    lines = lambda *a: say(*a)[1].out.rstrip("\n").split("\n")
    assert '"duration_ms" : 60000' in say("info", "v")[1].out
    assert lines("chunks", "v") == ["c1  0:00:00 to 0:05:00  (read 0:00:00 to 0:05:05)  a=failed, b=done"]
    assert lines("shots", "v") == ["   1  0:00:00 to 0:00:02  2.5 s  frames: 0, 1250"]
    assert lines("captions", "v") == ["[0:05] f.jpg", "   A man.", "   reads: EXIT", "[0:09] g.jpg", "   failed: no reply"]
    assert lines("captions", "v", "--full")[3:5] == ["   mood: calm", "   objects: hat, dog"]
    got = lines("scene", "v", "1")
    assert got[0].startswith("Scene 1, 0:00:00 to 0:00:20: T1") and "D1" in got[1] and any(x.startswith("tags: ") for x in got) and any(x.startswith("says [0:00] Hello there Ann") for x in got)
    code, out = say("scene", "v", "99")
    assert code == 1 and "no scene 99" in out.err
    assert any(x.startswith("plot: ") for x in lines("profile", "v"))
    code, out = say("search", "v", "hello")
    assert code == 1 and "--models" in out.err

    class Teller:
        def generate_json(self, system, prompt):
            return {"action": "answer", "answer": "It is at 0:05."}

    module = types.ModuleType("own_models")
    module.embed, module.text_model = lambda text: [0.0, 1.0], Teller
    monkeypatch.setitem(sys.modules, "own_models", module)
    assert len(lines("search", "v", "hello", "--models", "own_models", "--top", "2")) == 2
    got = lines("ask", "v", "Who is in it?", "--models", "own_models")
    assert got[0] == "... get_characters()" and got[1] == "It is at 0:05."
