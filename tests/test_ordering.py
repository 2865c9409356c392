"""Orders of one giant video: equal to the plain windows, in many tasks."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same
from timeloom.operators import folds, intervals, ordering, summaries, windows
from timeloom.plans import catalog


def rows(spark, n, seed=1, spread=500):
    rnd = random.Random(seed)
    data = [(rnd.choices(["hot", "b", None, "c"], [9, 1, 1, 1])[0], rnd.choice([None, *[rnd.randrange(spread)] * 20]), i) for i in range(n)]
    return spark.createDataFrame(data, "video_id string, ts_ms bigint, id int").repartition(5)


def both(f, sort=str):
    """f(large) by the plain window and by ranges."""
    plain, ranged = (sorted(map(tuple, f(n).collect()), key=sort) for n in (None, 20))
    assert plain == ranged and plain
    return ranged


@pytest.mark.parametrize("spread", [1, 7, 500])
def test_ranges_equal_windows(spark, spread, monkeypatch):
    monkeypatch.setattr(ordering, "split_large", lambda df, keys, order, large, size, f=ordering.split_large: f(df, keys, order, large, 37))
    d = rows(spark, 600, spread=spread)
    both(lambda n: ordering.positions(d, ["video_id"], "ts_ms", "id", large=n))
    both(lambda n: ordering.positions(d, ["video_id"], F.desc("id"), large=n))
    both(lambda n: windows.thin(d, ["video_id"], 7, "ts_ms", "id", large=n))
    both(lambda n: windows.numbered(d, "d", "ts_ms", "id", large=n))
    both(lambda n: windows.ordinal_rank(d, ["video_id"], "ts_ms", "id", large=n))
    both(lambda n: folds.gap_sessions(d, 3, large=n))
    both(lambda n: summaries.queue_positions(d.selectExpr("cast(id as string) video_id", "'queued' status", "ts_ms queued_at"), large=n))
    both(lambda n: summaries.in_time_order(d.selectExpr("video_id", "ts_ms start_ms", "id % 3 source_rank", "id pos"), large=n))
    two = d.withColumn("k", F.col("id") % 2)
    both(lambda n: ordering.positions(two, ["video_id", "k"], "ts_ms", "id", large=n))


def test_ties_are_numbered_once(spark):
    d = spark.range(300).selectExpr("'v' video_id", "1 ts_ms")
    got = ordering.positions(d, ["video_id"], "ts_ms", large=20, size=40).collect()
    assert sorted(r["__at"] for r in got) == list(range(300)) and {r["__n"] for r in got} == {300}
    assert ordering.positions(d.limit(0), ["video_id"], "ts_ms", large=20).count() == 0


def test_one_video_of_a_million_rows(spark):
    """Many tasks share it: no range has much more than its part."""
    d = spark.range(1_000_000).selectExpr("'v' video_id", "(id * 7919) % 1000003 ts_ms", "id")
    small, ranged = ordering.split_large(d, ["video_id"], [F.col("ts_ms"), F.col("id")], 500_000, 60_000)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert small.count() == 0 and len(sizes) >= 12 and max(sizes) < 200_000 and sum(sizes) == 1_000_000
    got = ordering.positions(d, ["video_id"], "ts_ms", "id", large=500_000, size=60_000)
    # the numbers multiply to distinct values below the modulus: ascending values have ascending places
    x = got.agg(F.count_distinct("__at").alias("n"), F.min("__at").alias("lo"), F.max("__at").alias("hi"), F.corr("__at", "ts_ms").alias("c")).first()
    assert (x.n, x.lo, x.hi) == (1_000_000, 0, 999_999) and x.c > 0.999999
    assert folds.gap_sessions(d, 0, large=500_000).count() == 1_000_000


def test_nearest_brute(spark):
    rnd = random.Random(4)
    for width in (5, 40, 10_000):
        spans = [(v, k, s, s + rnd.choice([0, 1, 5, 60])) for v in "ab" for k, s in enumerate(rnd.sample(range(-200, 1000), 25))]
        points = [(v, i, rnd.randrange(-400, 1400)) for i, v in enumerate(rnd.choices("abc", k=120))]
        a = spark.createDataFrame([(v, i, t) for v, i, t in points], "video_id string, id int, t bigint")
        b = spark.createDataFrame(spans, "video_id string, shot int, start_ms bigint, end_ms bigint")
        got = {r.id: (r.distance, r.shot) for r in intervals.nearest(a, b, F.col("t"), width).collect()}
        want = {}
        for v, i, t in points:
            far = [(0 if s <= t < e else min(abs(t - s), abs(t - e)) if not s <= t <= e else 0, k) for w, k, s, e in spans if w == v]
            if far:
                want[i] = min(far)
        assert {i: d for i, (d, _) in got.items()} == {i: d for i, (d, _) in want.items()}
        assert got == want


@pytest.mark.parametrize("name", ["unplaced_nearest", "gap_collapse", "even_thin", "numbered_ids", "queue_positions", "tag_rank"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("hard", [0.02, 0.3, 1.0])
def test_scenes_of_a_large_video(spark, hard):
    """Folded between hard cuts and in one piece; tails that join and that don't, videos of one shot and of one scene."""
    rnd = random.Random(int(hard * 100))
    rows = []
    for v in ["hot", "warm", *map(str, range(12))]:
        n, at = {"hot": 700, "warm": 90}.get(v, rnd.randint(1, 6)), 0
        for i in range(n):
            long = rnd.choice([500, 4000, 20_000, 90_000, 400_000] if i < n - 1 else [500, 90_000])
            score = 2.5 if rnd.random() < hard else rnd.choice([None, -0.2, 0.3, 0.7, 0.9])
            rows.append((v, i + 1, at, at + long, rnd.random() < 0.2, score))
            at += long
    d = spark.createDataFrame(rows, "video_id string, shot int, start_ms bigint, end_ms bigint, graphic boolean, score double").repartition(4)
    key = lambda x: sorted(map(tuple, x.collect()))
    plain = key(folds.segment(d, large=None))
    assert plain == key(folds.segment(d, large=50, size=60)) and plain == key(folds.segment(d, large=0, size=60)) and len(plain) > 20


@pytest.mark.parametrize("gap", [0, 1, 30])
def test_shots_of_a_large_video(spark, gap):
    rnd = random.Random(gap)
    rows = []
    for v, n in (("hot", 500), ("a", 3), ("b", 40)):
        at = 0
        for _ in range(n):
            at += rnd.choice([0, 5, 10, gap + 12])
            rows.append((v, at, at + rnd.choice([0, 3, 10, 25]), rnd.random() < 0.4, rnd.random() < 0.4, [at, at + 1]))
    d = spark.createDataFrame(rows, "video_id string, start_ms bigint, end_ms bigint, clipped_start boolean, clipped_end boolean, keyframes array<bigint>").repartition(3)
    key = lambda x: sorted((r.video_id, r.shot, r.start_ms, r.end_ms, tuple(r.keyframes)) for r in x.collect())
    assert key(folds.merge_shots(d, large=None)) == key(folds.merge_shots(d, large=30, size=50)) == key(folds.merge_shots(d, F.lit(10**9), large=0, size=50))
