"""Stages that run again for changed rows alone, generations of tables, merging of run states."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same
from timeloom.plans import catalog
from timeloom.plans.stages import Stage, run_stages
from timeloom.schemas import schema
from timeloom.sources import artifacts, generations, sinks


def chunks(spark, rows):
    """rows: video, index, end."""
    return spark.createDataFrame([(v, f"c{k}", k, 0, 10, k * 100, end, None) for v, k, end in rows], schema("chunks"))


class Work:
    """Shots of chunks: one a chunk, their length times `factor`; remembers what it was asked for."""

    def __init__(self, factor=1, fail=False):
        self.factor, self.fail, self.asked = factor, fail, []

    def __call__(self, t):
        if self.fail:
            raise RuntimeError("the model is down")
        self.asked += [(r.video_id, r["index"]) for r in t["chunks"].collect()]
        end = F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * self.factor
        return t["chunks"].select("video_id", F.col("index").alias("shot"), "start_ms", end.alias("end_ms"), F.array().cast("array<bigint>").alias("keyframes"))


def shots(spark, root):
    return sorted((r.video_id, r.shot, r.end_ms) for r in artifacts.read_table(spark, root, "shots").collect())


@pytest.mark.parametrize("keys", [(), ("start_ms",)])
def test_what_changed_runs_again(spark, tmp_path, keys):
    root, work = str(tmp_path), Work()
    stage = lambda **more: Stage("shots", ("chunks",), work, keys=keys, **more)
    row = lambda v, k, end: (v, k, end)

    def run(stage, want_videos, want_asked):
        work.asked.clear()
        assert run_stages(spark, root, [stage]) == {"shots": want_videos}
        got = sorted(work.asked)
        assert got == sorted(want_asked) if keys or not want_asked else {v for v, _ in got} == {v for v, _ in want_asked}

    sinks.write_table(chunks(spark, [row("a", 0, 10), row("a", 1, 110), row("b", 0, 10)]), root, "chunks")
    run(stage(), 2, [("a", 0), ("a", 1), ("b", 0)])
    run(stage(), 0, [])
    sinks.write_table(chunks(spark, [row("a", 0, 10), row("a", 1, 120)]), root, "chunks")  # a changed row under the same key
    run(stage(), 1, [("a", 1)])
    assert shots(spark, root) == [("a", 0, 10), ("a", 1, 120), ("b", 0, 10)]
    sinks.write_table(chunks(spark, [row("a", 1, 120), row("a", 2, 230)]), root, "chunks")  # one gone, one new
    run(stage(), 1, [("a", 2)])
    assert shots(spark, root) == [("a", 1, 120), ("a", 2, 230), ("b", 0, 10)]
    work.factor = 2
    for n, more in enumerate(({"version": "2"}, {"version": "2", "model": "m"}, {"version": "2", "model": "m", "prompt": "p"})):
        run(stage(**more), 2, [("a", 1), ("a", 2), ("b", 0)])
        run(stage(**more), 0, [])
        assert shots(spark, root) == [("a", 1, 140), ("a", 2, 260), ("b", 0, 20)]
    work.asked.clear()
    assert run_stages(spark, root, [stage(**more)], force=True) == {"shots": 2} and {v for v, _ in work.asked} == {"a", "b"}


def test_what_other_inputs_say(spark, tmp_path):
    """Rows of the same key count for their row, rows without the key for their video."""
    root, work = str(tmp_path), Work()
    stage = Stage("shots", ("chunks", "raw_shots", "profiles"), work, keys=("start_ms",))
    raw = lambda clipped: spark.createDataFrame([("a", "c", 0, 5, clipped, False, None), ("a", "c", 100, 5, False, False, None)], schema("raw_shots"))
    empty = {f.name: None for f in schema("profiles")}
    profile = lambda tone: spark.createDataFrame([tuple((empty | {"video_id": "a", "tone": tone}).values())], schema("profiles"))
    sinks.write_table(chunks(spark, [("a", 0, 10), ("a", 1, 110)]), root, "chunks")
    for table, rows, want in (("raw_shots", raw(False), [0, 1]), ("raw_shots", raw(True), [0]), ("profiles", profile("x"), [0, 1]), ("profiles", profile("x"), [])):
        sinks.write_table(rows, root, table)
        work.asked.clear()
        run_stages(spark, root, [stage])
        assert sorted(k for _, k in work.asked) == want


def test_crashes_lose_nothing(spark, tmp_path, monkeypatch):
    root, work = str(tmp_path), Work()
    stage = Stage("shots", ("chunks",), work, keys=("start_ms",))
    sinks.write_table(chunks(spark, [("a", 0, 10), ("b", 0, 10)]), root, "chunks")
    run_stages(spark, root, [stage])
    before = shots(spark, root)
    sinks.write_table(chunks(spark, [("a", 0, 20)]), root, "chunks")
    # in the function, after the rows are written, and after the commit
    work.fail = True
    with pytest.raises(RuntimeError):
        run_stages(spark, root, [stage])
    work.fail = False
    assert shots(spark, root) == before

    def crash(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(generations, "_switch", crash)
        with pytest.raises(OSError):
            run_stages(spark, root, [stage])
    assert shots(spark, root) == before
    assert sinks.latest_runs(artifacts.read_table(spark, root, "stage_runs")).filter("stage = 'shots:run'").filter("video_id = 'a'").first().status == "failed"
    with monkeypatch.context() as m:
        m.setattr("timeloom.plans.stages.append_run", lambda spark, root, v, stage, status, *a, **k: crash() if (stage, status) == ("shots", "done") else None)
        with pytest.raises(OSError):
            run_stages(spark, root, [stage])
    after = [("a", 0, 20), ("b", 0, 10)]
    assert shots(spark, root) == after
    work.asked.clear()
    assert run_stages(spark, root, [stage]) == {"shots": 1} and not work.asked  # the state is told again, no row is
    assert shots(spark, root) == after and run_stages(spark, root, [stage]) == {"shots": 0}
    assert generations.clean(spark, root, "shots", keep=1) > 0 and shots(spark, root) == after
    assert generations.clean(spark, root, "shots", keep=1) == 0


def test_generations(spark, tmp_path):
    root, kind = str(tmp_path), schema("shots")
    rows = lambda *r: spark.createDataFrame([(v, k, 0, 1, []) for v, k in r], kind)
    seen = lambda n=None: sorted((r.video_id, r.shot) for r in generations.read(spark, root, "shots", kind, number=n).collect())
    videos = lambda *v: spark.createDataFrame([(x,) for x in v], "video_id string")
    assert seen() == [] and generations.head(spark, root, "shots") == 0
    sinks.write_table(rows(("a", 1), ("b", 1)), root, "shots")  # a plain table
    assert generations.commit(spark, root, "shots", {"rows": rows(("a", 2), ("a", 3))}, videos("a"), 0) == 1
    assert seen() == [("a", 2), ("a", 3), ("b", 1)]
    with pytest.raises(generations.Conflict):  # another writer that read the plain table
        generations.commit(spark, root, "shots", {"rows": rows(("b", 9))}, videos("b"), 0)
    assert seen() == [("a", 2), ("a", 3), ("b", 1)]
    generations.commit(spark, root, "shots", {"rows": rows(("c", 1)), "more": rows(("c", 7))}, videos("c", "a"), 1)
    assert seen() == [("b", 1), ("c", 1)] and seen(1) == [("a", 2), ("a", 3), ("b", 1)]
    assert [r.shot for r in generations.read(spark, root, "shots", kind, "more").collect()] == [7]
    sinks.write_table(rows(("b", 5)), root, "shots")
    assert artifacts.read_table(spark, root, "shots").filter("video_id = 'b'").first().shot == 5
    assert generations.clean(spark, root, "shots", keep=1) > 0 and seen() == [("b", 5), ("c", 1)]


def test_compaction_meets_appends(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for n in range(4):
        sinks.append_run(spark, root, ["a", "b"], "shots", "running" if n % 2 else "queued")
    latest = sinks.latest_runs

    def meanwhile(runs):
        """Another writer, after the files were listed and before they are rewritten."""
        sinks.append_run(spark, root, ["c"], "shots", "done")
        sinks.append_run(spark, root, ["a"], "shots", "done")
        return latest(runs)

    with monkeypatch.context() as m:
        m.setattr(sinks, "latest_runs", meanwhile)
        assert sinks.compact_runs(spark, root) == 4
    state = lambda: {r.video_id: r.status for r in latest(artifacts.read_table(spark, root, "stage_runs")).collect()}
    assert state() == {"a": "done", "b": "running", "c": "done"}
    assert sinks.compact_runs(spark, root, older_than=3600) == 0
    sinks.compact_runs(spark, root)
    assert state() == {"a": "done", "b": "running", "c": "done"}


def test_reuse_by_key(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    same(catalog.QUERIES["reuse_by_key"](spark, SF).toPandas(), con.execute(catalog.ORACLES["reuse_by_key"]).df())
