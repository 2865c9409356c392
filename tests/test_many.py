"""Many questions in one scan: equal to one search each."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same
from timeloom.operators import many, retrieval
from timeloom.plans import catalog

ITEM = "pos bigint, kind string, text string, embedding array<float>"


def unit(rnd, n=8):
    v = [rnd.choice([-1, 0, 0, 1, 2]) for _ in range(n)]
    size = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / size for x in v]


def test_equal_to_single_searches(spark):
    rnd = random.Random(2)
    words = ["fire", "water", "Über", "the", "it's", "so-so", "a", "earth", ""]
    # few different vectors, so scores tie in plenty
    rows = [(i, rnd.choice(["scene", "text"]), " ".join(rnd.choices(words, k=4)), unit(rnd) if i % 17 else None) for i in range(900)]
    items = spark.createDataFrame(rows, ITEM).repartition(4)
    asked = [(f"q{i}", " ".join(rnd.choices(words, k=3)), unit(rnd)) for i in range(12)] + [("empty", "", unit(rnd)), ("none", None, unit(rnd)), ("novector", "fire", None)]
    questions = spark.createDataFrame(asked, "question_id string, query string, vector array<double>")
    for k, kinds, block in ((10, None, 1000), (3, ["text"], 4)):
        got = {}
        for r in many.search_many(items, questions, k, kinds, block=block).collect():
            got.setdefault(r.question_id, []).append((r.place, r.pos, r.similarity, r.score, r.text, r.kind))
        assert set(got) == {q for q, text, v in asked if text is not None and v is not None}
        for q, text, v in asked[:13]:
            # a single search ranks items without an embedding last, and k others stand before them
            want = retrieval.search_moments(items, text, v, k, kinds).collect()
            assert sorted(got[q]) == [(n, r.pos, r.similarity, r.score, r.text, r.kind) for n, r in enumerate(want, 1)]


def test_few_rows_leave_a_task(spark):
    """A thousand questions over the items in one scan; what is scored again is little more than k a question and task."""
    best = many.Best(1000, 10)
    rnd = many.np.random.default_rng(1)
    for n in range(20):
        best.add(rnd.normal(0, 0.3, (500, 1000)), many.np.arange(500.0) + 500 * n, many.np.arange(500) + 500 * n)
    assert max(len(h[0]) for h in best.held) <= 12 and min(len(h[0]) for h in best.held) >= 10


def test_odd_questions(spark):
    items = spark.createDataFrame([(1, "t", "fire", [1.0, 0.0]), (2, "t", None, [0.0, 1.0])], ITEM)
    ask = lambda *q: many.search_many(items, spark.createDataFrame(list(q), "question_id int, query string, vector array<double>"))
    assert ask().count() == 0 and many.search_many(items.limit(0), spark.createDataFrame([(1, "x", [1.0, 0.0])], "question_id int, query string, vector array<double>")).count() == 0
    assert [(r.place, r.pos) for r in ask((1, "fire", [0.0, 1.0])).orderBy("place").collect()] == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="dimensions"):
        ask((1, "fire", [0.0, 1.0, 0.0])).collect()
    with pytest.raises(ValueError, match="different lengths"):
        ask((1, "a", [0.0]), (2, "b", [0.0, 1.0]))


def test_query(spark):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES["search_many"](spark, SF)
    same(got.toPandas(), con.execute(catalog.ORACLES["search_many"]).df())
    assert got.select(F.count_distinct("question_id")).first()[0] > 1


def test_blocks_share_a_scan(spark):
    """Blocks of questions are no scans of their own, and texts don't pass through Python."""
    rnd = random.Random(3)
    items = spark.createDataFrame([(i, "t", "fire water", unit(rnd)) for i in range(30)], ITEM)
    questions = spark.createDataFrame([(i, "fire", unit(rnd)) for i in range(12)], "question_id int, query string, vector array<double>")
    found = many.search_many(items, questions, 3, block=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "text" not in next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert found.count() == 36


def test_frequent_and_rare_keywords(spark):
    """Keywords of nearly all questions go into the product, those of few are added: both as in single searches."""
    rnd = random.Random(5)
    said = ["every", *[f"rare{i}" for i in range(40)]]
    rows = [(i, "t", " ".join(rnd.choices(said, k=5)), unit(rnd)) for i in range(300)]
    items = spark.createDataFrame(rows, ITEM).repartition(3)
    asked = [(i, f"every rare{i} rare{(i + 1) % 40}", unit(rnd)) for i in range(40)]
    got = {}
    for r in many.search_many(items, spark.createDataFrame(asked, "question_id int, query string, vector array<double>"), 5).collect():
        got.setdefault(r.question_id, []).append((r.place, r.pos, r.similarity, r.score))
    for q, text, v in asked[::8]:
        assert sorted(got[q]) == [(n, r.pos, r.similarity, r.score) for n, r in enumerate(retrieval.search_moments(items, text, v, 5).collect(), 1)]
