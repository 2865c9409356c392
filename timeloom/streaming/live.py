"""Streams with state of their own: answers while they are written, and progress with pings and an end.

Both run under transformWithState with timers: state is what the next event hangs on, and goes when the last event is out. For a while
afterwards (`linger_ms`) only the mark that all is over stays, so that late or repeated rows start nothing anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timeloom.streaming.scanner import AnswerText

PING_MS = 15_000  # fixed value: silence after which a listener hears a ping
TERMINAL = ("done", "failed")
_SHOWN = Row("ask_id", "seq", "event", "text")
_TOLD = Row("video_id", "ts", "event", "state", "place")
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _ready(df: DataFrame) -> None:
    """Such state needs this store; a session that says nothing of it gets it."""
    spark = df.sparkSession
    assert spark.streams.active is not None  # starts what coordinates the state, which batches need too
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One timer a key: the next thing that happens without rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def wake(self, at_ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)


class _Answers(_Timed):
    def __init__(self, wait_ms: int, linger_ms: int):
        self.wait_ms, self.linger_ms = wait_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.at = handle.getValueState("at", "next bigint, scanner string, shown boolean, over boolean")
        self.waiting = handle.getMapState("waiting", "seq bigint", "piece string, done boolean, error string, need_action boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ask, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        next_, scanner, shown, over = self.at.get() if self.at.exists() else (0, "", False, False)
        text = AnswerText.load(scanner) if scanner else None
        ready = {}
        for r in rows:
            if over or r.seq < next_ or r.seq in ready:
                continue  # a repeat
            ready[r.seq] = (r.piece, r.done, r.error, r.need_action)
        while not over:
            if next_ in ready:
                piece, done, error, need = ready.pop(next_)
            elif self.waiting.exists() and self.waiting.containsKey((next_,)):
                piece, done, error, need = self.waiting.getValue((next_,))
                self.waiting.removeKey((next_,))
            else:
                break
            text = text or AnswerText(need is not False)
            if new := text.feed(piece or ""):
                shown = True
                yield _SHOWN(ask, next_, "token", new)
            if error is not None:
                if shown:
                    yield _SHOWN(ask, next_, "reset", error)
                text, shown = None, False
            elif done:
                over = bool(text.is_answer and shown)
                if over:
                    yield _SHOWN(ask, next_, "end", "")
                elif text.is_answer is False:
                    yield _SHOWN(ask, next_, "step", text.action)
                text, shown = None, False
            next_ += 1
        if over:
            self.waiting.clear()
        else:
            for seq, value in ready.items():
                self.waiting.updateValue((seq,), value)
        self.at.update((next_, "" if text is None or over else text.dump(), shown, over))
        self.wake(now + (self.linger_ms if over else self.wait_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.at.exists():
            next_, _, _, over = self.at.get()
            if not over:
                yield _SHOWN(key[0], next_, "error", f"piece {next_} didn't come")
        self.at.clear()
        self.waiting.clear()


def answer_stream(pieces: DataFrame, wait_ms: int = 60_000, linger_ms: int = 60_000) -> DataFrame:
    """Of a stream of pieces the events to show: ask_id, seq, event, text.

    pieces: ask_id string, seq bigint (from 0, over all model calls of a question), piece string, done boolean (the call is over); and if there
    are such columns error string (the call failed) and need_action boolean (false: the call can only answer). Events: token (more of the
    answer), reset (what was shown of this call is void), step (a tool is called, by name), end, and error where a piece hasn't come for
    wait_ms. Pieces may come in any order and more than once; those ahead of their turn wait in state.
    """
    _ready(pieces)
    more = {"error": F.lit(None).cast("string"), "need_action": F.lit(True)}
    d = pieces.select("ask_id", F.col("seq").cast("bigint").alias("seq"), "piece", "done", *[c if c in pieces.columns else v.alias(c) for c, v in more.items()])
    d = d.filter("ask_id is not null and seq is not null")
    return d.groupBy("ask_id").transformWithState(_Answers(wait_ms, linger_ms), "ask_id string, seq bigint, event string, text string", "Append", "ProcessingTime")


class _Progress(_Timed):
    def __init__(self, ping_ms: int, forget_ms: int, linger_ms: int):
        self.ping_ms, self.forget_ms, self.linger_ms = ping_ms, forget_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # the last state and its time; when the last row came and the last event went out; whether the end is out
        self.last = handle.getValueState("last", "state string, ts bigint, heard bigint, sent bigint, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.last.exists()
        state, at, _, sent, over = self.last.get() if known else (None, None, 0, now, False)
        for r in sorted(rows, key=lambda r: (r.ts, r.place is not None, r.place)):  # of one video and micro-batch
            if over or (at is not None and r.ts < at):
                continue  # late: a later state is out
            if not known or r.state != state:
                yield _TOLD(key[0], r.ts, "progress", r.state, r.place)
                if r.status in TERMINAL:
                    yield _TOLD(key[0], r.ts, r.status, r.state, r.place)
                    over = True
                known, sent = True, now
            state, at = r.state, r.ts
        self.last.update((None if over else state, at, now, sent, over))
        self.wake(now + self.linger_ms if over else sent + self.ping_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.last.exists():
            return
        state, at, heard, _, over = self.last.get()
        if over or now - heard >= self.forget_ms:
            self.last.clear()
            return
        yield _TOLD(key[0], at, "ping", None, None)
        self.last.update((state, at, heard, now, over))
        self.handle.registerTimer(now + self.ping_ms)


def progress_events(rows: DataFrame, ping_ms: int = PING_MS, forget_ms: int = 86_400_000, linger_ms: int = 60_000, tell: tuple[str, ...] = ()) -> DataFrame:
    """Of a stream (video_id, ts, status, state: text of all that is shown; `place` breaks ties of ts, if there is one) the events: video_id, ts, event, state.

    progress where the state differs from the last one, then done or failed if that is the status, and nothing after it; ping after ping_ms without
    an event. Rows older than the state that is out are late and say nothing; repeats neither. A video that isn't heard of for forget_ms is
    forgotten, pings and all. Rows without a video or a time say nothing. tell=("place",): events carry the place of their row, pings null.
    """
    _ready(rows)
    place = F.col("place") if "place" in rows.columns else F.lit(0)
    d = rows.filter("video_id is not null and ts is not null").select("video_id", F.unix_micros("ts").alias("ts"), "status", "state", place.alias("place"))
    kinds = dict(d.dtypes)
    out = f"video_id {kinds['video_id']}, ts bigint, event string, state string, place {kinds['place']}"
    events = d.groupBy("video_id").transformWithState(_Progress(ping_ms, forget_ms, linger_ms), out, "Append", "ProcessingTime")
    return events.select("video_id", F.timestamp_micros("ts").alias("ts"), "event", "state", *tell)
