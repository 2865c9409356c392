"""Answers while they are written and progress with pings: every split of a reply, streams against plain simulations."""

import json
import re
import threading
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.conftest import SF, same
from timeloom import models
from timeloom.config import DEFAULTS
from timeloom.operators.answers import CUT
from timeloom.plans import agent, catalog
from timeloom.streaming import jobs, live
from timeloom.streaming.scanner import AnswerText

TEXT = st.text(st.sampled_from(list('aé"\\/{}[],:\n\t\x01😀 u0d8"')), max_size=12)
VALUE = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | TEXT, lambda x: st.lists(x, max_size=3) | st.dictionaries(TEXT | st.sampled_from(["answer", "action"]), x, max_size=3), max_leaves=5)


def plain(reply, need=True):
    """What one parse of a whole reply shows; lone halves of surrogates are lost."""
    pairs = json.loads(reply, object_pairs_hook=list)
    first = {}
    for k, v in pairs:
        first.setdefault(k, v)
    action, answer = first.get("action"), first.get("answer")
    # the first action that is a string counts
    action = next((v for k, v in pairs if k == "action" and isinstance(v, str)), None)
    answer = next((v for k, v in pairs if k == "answer" and isinstance(v, str)), "")
    return re.sub("[\ud800-\udfff]", "�", answer) if action == "answer" or not need else ""


def split(text, cuts):
    at = sorted({0, len(text), *(c % (len(text) + 1) for c in cuts)})
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["answer", "action", "query", "ans"]) | TEXT, VALUE | st.sampled_from(["answer", "get_range"])), max_size=5), st.booleans(), st.booleans(), st.lists(st.integers(0, 400), max_size=12))
def test_any_split_equals_one_parse(pairs, ascii_, need, cuts):
    body = ", ".join(f"{json.dumps(k, ensure_ascii=ascii_)} : {json.dumps(v, ensure_ascii=ascii_)}" for k, v in pairs)
    reply = "{" + body + "}"
    scanner, out = AnswerText(need), ""
    for piece in split(reply, cuts):
        out += scanner.feed(piece)
        scanner = AnswerText.load(scanner.dump())  # as between two micro-batches
    assert out == plain(reply, need)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([r"\ud83d", r"\ude00", r"é", r"\n", r"\"", r"\\", "a", " ", "é", r"\/"]), max_size=10), st.lists(st.integers(0, 90), max_size=8))
def test_halves_of_surrogates(parts, cuts):
    reply = '{"action":"answer","answer":"' + "".join(parts) + '"}'
    scanner = AnswerText()
    assert "".join(map(scanner.feed, split(reply, cuts))) == plain(reply)


@pytest.mark.parametrize(("raw", "want"), [(r"a\q\ud83d", "aq�"), (r"\u12 x", " x"), (r"\u", ""), (r"\ud800A", "�A"), (r"x\udc00y", "x�y"), (r"\ud800😀", "�😀"), (r"\ud83d\u12z", "�z"), (r"\r\b\f", "\r\b\f")])
def test_bad_escapes(raw, want):
    for size in (1, 2, 100):
        s = AnswerText(False)
        whole = '{"answer":"' + raw + '"}'
        assert "".join(s.feed(whole[i : i + size]) for i in range(0, len(whole), size)) == want
    assert len(s.dump()) < 80


def test_answers_so_far(spark):
    rows = [(0, r'{"action":"answer","answer":"x\udc00y'), (1, None), (2, ""), (3, "[1]"), (4, '{"action":"get_range"}'), (5, '{"action":"answer"}')]
    got = jobs.answers_so_far(spark.createDataFrame(rows, "id int, reply string"), "reply").orderBy("id").collect()
    assert [r.answer for r in got] == ["x�y", None, None, None, None, ""]


def feed(spark, path, batches, kind):
    """A stream that sees one file of rows a micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1 if k < len(batches) - 1 else 0)  # files are taken by their time
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(path))


PIECE = "ask_id string, seq bigint, piece string, done boolean, error string, need_action boolean"


def told(events):
    return [(r.seq, r.event, r.text) for r in sorted(events, key=lambda r: r.seq)]


def test_answer_stream(spark, tmp_path):
    answer = json.dumps({"action": "answer", "answer": 'yes "é" 😀 at 0:10'})
    call, half = '{"action": "get_range", "start": "0:10"}', '{"action": "answer", "answer": "no'
    a = [("a", 0, call, True, None, None), *[("a", 1 + i, c, False, None, True) for i, c in enumerate(answer)], ("a", 1 + len(answer), "", True, None, True)]
    b = [("b", 0, half, False, None, True), ("b", 1, "", True, "broken", True), ("b", 2, '{"answer": "ok"}', True, None, False)]
    c = [("c", 1, "never", False, None, True), (None, 0, "x", True, None, True)]
    rows = a + b + c
    # three batches out of order, with repeats before and after the end
    batches = [[r for r in rows if r[1] % 3 == 1] + a[:1], [r for r in rows if r[1] % 3 == 2] + a[3:6], [r for r in rows if r[1] % 3 == 0], a[-5:]]
    q = live.answer_stream(feed(spark, tmp_path / "in", batches, PIECE), wait_ms=25_000, linger_ms=25_000).writeStream.format("memory").queryName("shown").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 150
        while time.time() < end and not spark.table("shown").filter("ask_id = 'c'").count():
            time.sleep(1)
        while time.time() < end and not (q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0):
            time.sleep(1)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # state, waiting pieces and timers are gone
    finally:
        q.stop()
    got = {}
    for r in spark.table("shown").collect():
        got.setdefault(r.ask_id, []).append(r)
    assert set(got) == {"a", "b", "c"}
    events = told(got["a"])
    assert events[0] == (0, "step", "get_range") and events[-1] == (1 + len(answer), "end", "")
    assert {e for _, e, _ in events[1:-1]} == {"token"} and "".join(t for _, _, t in events[1:-1]) == 'yes "é" 😀 at 0:10'
    assert sorted(told(got["b"])) == sorted([(0, "token", "no"), (1, "reset", "broken"), (2, "token", "ok"), (2, "end", "")])
    assert told(got["c"]) == [(0, "error", "piece 0 didn't come")]


class Handle:
    """What a processor asks of its handle, for one key, in memory."""

    def __init__(self):
        self.timers, self.value = set(), None

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: iter(list(self.timers))

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


class Told(Row):
    pass


ROWS = Row("ts", "status", "state", "place")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abc"), st.sampled_from(["running"] * 6 + ["done", "failed"])), max_size=4)), max_size=12))
def test_progress_against_a_simulation(batches):
    """Time passes in steps; a plain listener that is told of each row in turn hears the same."""
    ping, forget, linger = 15, 60, 30
    handle, p = Handle(), live._Progress(ping, forget, linger)
    p.init(handle)
    got, want = [], []
    now, last, at, sent, heard, over, gone = 0, None, None, None, None, None, True
    for wait, rows in batches:
        for _ in range(wait):
            now += 1
            for t in sorted(x for x in handle.timers if x <= now):
                handle.timers.discard(t)
                got += [(now, r.event, r.state) for r in p.handleExpiredTimer(("v",), Now(now), None)]
            if gone:
                continue
            if over is not None:
                gone = now >= over + linger
            elif now >= sent + ping:
                if now - heard >= forget:
                    gone = True
                else:
                    want.append((now, "ping", None))
                    sent = now
            if gone:
                last = at = over = None
        if not rows:
            continue
        rows = [ROWS(t, status, state, None) for t, state, status in rows]
        got += [(now, r.event, r.state) for r in p.handleInputRows(("v",), iter(rows), Now(now))]
        if gone:
            sent, gone, fresh = now, False, True
        else:
            fresh = False
        heard = now
        for r in sorted(rows, key=lambda r: r.ts):
            if over is not None or (at is not None and r.ts < at):
                continue
            if fresh or r.state != last:
                want.append((now, "progress", r.state))
                sent = now
                if r.status != "running":
                    want.append((now, r.status, r.state))
                    over = now
            last, at, fresh = r.state, r.ts, False
        if over is not None:
            over = now if over == now else over
            # rows after the end put off when it is forgotten
            over = now
    assert got == want


def test_progress_stream(spark, tmp_path):
    kind = "video_id string, t int, status string, state string"
    batches = [[("v", 1, "running", "a"), ("v", 2, "running", "a"), ("v", 3, "running", "b"), ("w", 1, "running", "x"), (None, 1, "running", "x")], [("v", 2, "running", "late"), ("v", 4, "done", "c"), ("v", 5, "running", "d")], [("v", 6, "running", "e")]]
    stream = feed(spark, tmp_path / "in", batches, kind).selectExpr("video_id", "timestamp_seconds(t) ts", "status", "state")
    events = live.progress_events(stream, ping_ms=1500, forget_ms=20_000, linger_ms=15_000)
    q = events.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 120
        while time.time() < end and not (q.lastProgress and q.lastProgress["stateOperators"] and spark.table("progress").count() > 4 and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0):
            time.sleep(1)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()
    got = [(r.video_id, r.event, r.state) for r in spark.table("progress").collect()]
    assert sorted(x for x in got if x[1] != "ping") == [("v", "done", "c"), ("v", "progress", "a"), ("v", "progress", "b"), ("v", "progress", "c"), ("w", "progress", "x")]
    assert ("w", "ping", None) in got


@pytest.mark.parametrize("name", ["progress_changes", "answer_text", "padded_windows"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df())


def test_padding_wider_than_a_window(spark):
    d = spark.createDataFrame([("v", t) for t in (0, 5, 19, 40)], "video_id string, ts_ms bigint")
    got = {(r.ts_ms, r.core_ms, r.own) for r in jobs.padded_windows(d, 10, 25).collect()}
    want = {(t, c, c <= t < c + 10) for t in (0, 5, 19, 40) for c in range(-50, 100, 10) if c - 25 <= t < c + 10 + 25}
    assert got == want
    with pytest.raises(ValueError):
        jobs.padded_windows(d, 10, -1)


class Stream:
    """A model that writes replies in pieces; an exception in its place fails in the middle."""

    def __init__(self, *replies, gate=None):
        self.replies, self.prompts, self.gate = list(replies), [], gate

    def stream_json(self, system, prompt):
        self.prompts.append(prompt)
        reply = self.replies.pop(0)
        text = reply if isinstance(reply, str) else json.dumps(reply)
        for i in range(0, len(text), 3):
            if self.gate is not None and i > len(text) // 2:
                assert self.gate.wait(20)
            yield text[i : i + 3]
        if text.endswith("…"):
            raise OSError("line cut")


TOOLS = {"search_moments": lambda query: ("found " + query, [1000], []), "get_range": lambda start_ms, end_ms: ("z" * 5000, [], [])}


def test_events_come_while_the_answer_is_written():
    gate = threading.Event()
    model = Stream({"action": "search_moments", "query": "dog"}, {"action": "answer", "answer": "It barks at 0:10, twice and loudly."}, gate=gate)
    seen = []
    for kind, data in agent.ask_events("where?", [{"action": "get_range", "start_ms": 0, "end_ms": 5000}], TOOLS, model, ping_s=0.2):
        seen.append((kind, data))
        if kind == "ping":  # the reply stands still in the middle: what was written is here already
            gate.set()
    kinds = [k for k, _ in seen if k != "ping"]
    assert kinds[:3] == ["status", "step", "step"] and kinds[-1] == "answer" and set(kinds[3:-1]) == {"token"}
    assert "".join(d["text"] for k, d in seen if k == "token") == "It barks at 0:10, twice and loudly." == seen[-1][1]["answer"]
    assert seen[-1][1]["sources"] == []


def test_resets_and_forced_answers():
    def run(*replies, plan=()):
        model = Stream(*replies)
        return [(k, d.get("text") if k == "token" else d) for k, d in agent.ask_events("q", list(plan), TOOLS, model)], model

    told_, model = run('{"action": "answer", "answer": "half…', {"answer": "whole"})
    text = [k if k != "token" else d for k, d in told_]
    at = text.index("reset")
    assert "".join(text[1:at]) == "half…" and "".join(text[at + 1 : -1]) == "whole" and text[-1] == "answer"
    assert "must answer now" in model.prompts[-1] and "must answer now" not in model.prompts[0]
    # an answer of white space is shown, then void
    told_, _ = run({"action": "answer", "answer": " "}, {"action": "answer", "answer": " "}, {"action": "answer", "answer": " "}, {"answer": "ok"})
    assert [k for k, _ in told_][-3:] == ["reset", "token", "answer"]
    # a call that repeats itself ends the loop
    told_, model = run({"action": "search_moments", "query": "a"}, {"action": "search_moments", "query": "a"}, {"answer": "ok"})
    assert [k for k, _ in told_] == ["status", "step", "token", "answer"] and len(model.prompts) == 3
    assert run('{"action": "answer…', "[1]")[0][-1][0] == "error"
    told_, _ = run("nonsense", {"answer": None})
    assert told_[-1][1]["answer"] == agent.NOT_FOUND


def test_question_prompt():
    call = {"action": "get_range", "start_ms": 65_000, "end_ms": 3_700_000}
    assert agent.described(call) == "get_range(start=1:05, end=1:01:40)" and agent.described({"action": "search_moments", "query": 'a "b"'}) == 'search_moments(query="a \\"b\\"")'
    first = agent.question_prompt("Who?", [], False)
    assert first.startswith("The question: Who?\n\nNothing") and str(DEFAULTS.max_steps) in first
    later = agent.question_prompt("Who?", [(call, "r1"), ({"action": "get_characters"}, "r2")], True)
    assert "Result 1 of get_range(start=1:05, end=1:01:40)\nr1\n\nResult 2 of get_characters()\nr2\n\n" in later and "must answer now" in later
    model = Stream({"action": "get_range", "start": "0:10"}, {"action": "answer", "answer": "x"})
    agent.ask("q", [], TOOLS, model, on_token=lambda t: None)
    assert model.prompts[1].count("z") == DEFAULTS.observation_chars and CUT in model.prompts[1]


def test_streamed_replies(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "fail"), ("c", "")], "ask_id string, prompt string")

    class Echo:
        def stream_json(self, system, prompt):
            yield from prompt
            if prompt == "fail":
                raise OSError("down")

    got = sorted(map(tuple, models.stream_replies(rows, Echo, "s").collect()))
    assert got == [("a", 0, "x", False, None), ("a", 1, "", True, None), *[("b", i, c, False, None) for i, c in enumerate("fail")], ("b", 4, "", True, "down"), ("c", 0, "", True, None)]
    assert live.answer_stream(models.stream_replies(spark.createDataFrame([("a", '{"action":"answer","answer":"hi"}')], "ask_id string, prompt string"), Echo, "s")).agg(F.concat_ws("", F.sort_array(F.collect_list("text")))).first()[0] == "hi"
