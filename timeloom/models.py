"""Model calls as row functions behind small protocols, with offline stand-ins that need no weights.

A model is loaded once a task, in the iterator of mapInPandas; failures become error rows, and filters run before the call.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TextModel(Protocol):
    def generate_json(self, system: str, prompt: str) -> dict: ...


class StreamingModel(TextModel, Protocol):
    def stream_json(self, system: str, prompt: str) -> Iterator[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Vision(Protocol):
    def describe(self, images: list[bytes]) -> list[dict]: ...


class Recogniser(Protocol):
    def transcribe(self, samples, language: str | None, offset_ms: int) -> list[dict]: ...


class LanguageDetector(Protocol):
    def detect_language(self, samples) -> tuple[str, dict[str, float]]: ...


class ShotDetector(Protocol):
    def detect(self, content: bytes, start_ms: int, end_ms: int) -> list[tuple[int, int]]: ...


def ready(model: object) -> None:
    """Raises on the driver, before any task runs, if a model says it can't work."""
    check = getattr(model, "check_ready", None)
    if check is not None:
        check()


@contextmanager
def loaded(make: Callable[[], object]) -> Iterator:
    """A task's model, from being made to the task's end: `load` and `warm_up` before the first row, `unload` after the last or after a failure, each if it has one.

    A model that warms up badly works all the same; one that can't be loaded fails the task.
    """
    model = make()
    told = lambda name: getattr(model, name, lambda: None)
    try:
        told("load")()
        with suppress(Exception):
            told("warm_up")()
        yield model
    finally:
        told("unload")()


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """Stand-in embedder: signed counts of word hashes, unit length; built-ins only."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)))
    count = lambda h, k: F.size(F.filter(h, lambda x: x == k)).cast("double")
    bind = F.transform(F.array(slots), lambda h: F.array(*[count(h, k) - count(h, k + dim) for k in range(dim)]))
    from timeloom.functions.vectors import l2_normalise

    return F.get(F.transform(bind, l2_normalise), F.lit(0))


class EchoModel:
    """Stand-in text model: answers with the start of its prompt."""

    def generate_json(self, system: str, prompt: str) -> dict:
        return {"action": "answer", "answer": prompt[:200]}


def call_model(rows: DataFrame, make: Callable[[], TextModel], system: str, prompt: str = "prompt", retries: int = 1) -> DataFrame:
    """rows with `reply` (JSON) and `error`; the model is made once a task."""
    import json

    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]):
        with loaded(make) as model:
            for b in batches:
                replies, errors = [], []
                for p in b[prompt]:
                    reply = error = None
                    for _ in range(retries + 1):
                        try:
                            reply, error = json.dumps(model.generate_json(system, p), sort_keys=True), None
                            break
                        except Exception as e:  # noqa: BLE001 - an error row, as the contract has it
                            error = str(e)
                    replies.append(reply)
                    errors.append(error)
                yield b.assign(reply=replies, error=errors)

    return rows.mapInPandas(run, schema)


def stream_replies(rows: DataFrame, make: Callable[[], StreamingModel], system: str, key: str = "ask_id", prompt: str = "prompt") -> DataFrame:
    """key, seq, piece, done, error: replies in the pieces the model writes, one after the other, for `live.answer_stream` or a table.

    A reply ends with an empty piece that is done, or with an error. Pieces leave the task in batches as they come; no reply is held whole.
    """
    schema = T.StructType([rows.schema[key], T.StructField("seq", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("done", T.BooleanType()), T.StructField("error", T.StringType())])

    def pieces(model: StreamingModel, text: str) -> Iterator[tuple]:
        n = 0
        try:
            for piece in model.stream_json(system, text):
                yield n, piece, False, None
                n += 1
            yield n, "", True, None
        except Exception as e:  # noqa: BLE001 - an error row
            yield n, "", True, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]):
        with loaded(make) as model:
            for b in batches:
                for k, text in zip(b[key], b[prompt], strict=True):
                    told = pieces(model, text)
                    while some := list(itertools.islice(told, 256)):
                        yield pd.DataFrame([(k, *x) for x in some], columns=schema.names)

    return rows.select(key, prompt).mapInPandas(run, schema)


def describe_images(rows: DataFrame, make: Callable[[], Vision], image: str = "content", batch: int = 16) -> DataFrame:
    """rows without the image, with `reply` (JSON) and `error`. Images go to the model in batches, one by one where a batch fails; keys travel with them."""
    import json

    kept = [c for c in rows.columns if c != image]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def one(model: Vision, content: bytes) -> tuple[str | None, str | None]:
        try:
            return json.dumps(model.describe([content])[0], sort_keys=True), None
        except Exception as e:  # noqa: BLE001 - an error row
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]):
        with loaded(make) as model:
            for b in batches:
                found: list[tuple[str | None, str | None]] = []
                for i in range(0, len(b), batch):
                    part = [bytes(x) for x in b[image][i : i + batch]]
                    try:
                        replies = model.describe(part)
                        if len(replies) != len(part):
                            raise ValueError("replies and images differ in number")
                        found += [(json.dumps(r, sort_keys=True), None) for r in replies]
                    except Exception:  # noqa: BLE001 - the bad one is found one by one
                        found += [one(model, x) for x in part]
                yield b[kept].assign(reply=[r for r, _ in found], error=[e for _, e in found])

    return rows.mapInPandas(run, schema)


def _each(rows: DataFrame, kept: list[str], make, call, out: str) -> DataFrame:
    """kept columns and what `call(model, row)` yields, `out` (DDL) and error: one row in, any number out."""
    fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([*[rows.schema[c] for c in kept], *fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]):
        with loaded(make) as model:
            for b in batches:
                found = []
                for row in b.to_dict("records"):
                    key = tuple(row[c] for c in kept)
                    try:
                        found += [(*key, *x, None) for x in call(model, row)]
                    except Exception as e:  # noqa: BLE001 - an error row
                        found.append((*key, *[None] * len(fields), str(e) or type(e).__name__))
                yield pd.DataFrame(found, columns=schema.names)

    return rows.mapInPandas(run, schema)


def transcribe(slices: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """Segments of audio slices (video_id, chunk_id, start_ms, samples, language): one row in, many out; words as structs, times on the movie's clock."""
    ddl = "seg_start_ms bigint, seg_end_ms bigint, text string, avg_logprob double, no_speech_prob double, words array<struct<start_ms: bigint, end_ms: bigint, word: string, prob: double>>, lang string, lang_prob double"
    names = [f.name for f in T.StructType.fromDDL(ddl).fields]

    def call(model, row):
        for s in model.transcribe(row["samples"], row["language"], row["start_ms"]):
            yield tuple(s.get(n.removeprefix("seg_")) for n in names)

    return _each(slices, ["video_id", "chunk_id"], make, call, ddl).withColumnsRenamed({"seg_start_ms": "start_ms", "seg_end_ms": "end_ms"})


def span_of_segment(start_ms: int, end_ms: int, offset_ms: int, n: int, rate: int = 16_000) -> tuple[int, int] | None:
    """Samples around a segment that are listened to: two seconds at least, clamped to the n there are; None under a quarter of a second."""
    mid, half = (start_ms + end_ms) / 2 - offset_ms, max((end_ms - start_ms) / 2, 1000)
    first, past = max(0, int((mid - half) * rate / 1000)), min(n, int((mid + half) * rate / 1000))
    return (first, past) if past - first >= rate // 4 else None


def check_languages(chunks: DataFrame, make: Callable[[], LanguageDetector]) -> DataFrame:
    """Segments of chunks (video_id, chunk_id, start_ms, samples, language, segments) with the language each is heard in: lang, and lang_prob of the chunk's own language.

    Words of another tongue, forced into the chunk's language, look like words of it; the sound tells. A segment too short to judge keeps what
    it had, and so do a chunk's other segments once the detector fails: the check is an extra.
    """
    import numpy as np

    kind = chunks.schema["segments"].dataType.elementType
    schema = T.StructType([chunks.schema["video_id"], chunks.schema["chunk_id"], *kind.fields])

    def run(batches: Iterator[pd.DataFrame]):
        with loaded(make) as model:
            for b in batches:
                out = []
                for row in b.to_dict("records"):
                    sound, works = np.asarray(row["samples"] if row["samples"] is not None else [], np.float32), True
                    for s in row["segments"] if row["segments"] is not None else ():
                        s = dict(s)
                        span = span_of_segment(s["start_ms"], s["end_ms"], row["start_ms"], len(sound)) if works else None
                        if span:
                            try:
                                top, shares = model.detect_language(sound[slice(*span)])
                                s |= {"lang": top, "lang_prob": round(float(dict(shares or {}).get(row["language"], 0.0)), 3)}
                            except Exception:  # noqa: BLE001 - see above
                                works = False
                        out.append((row["video_id"], row["chunk_id"], *[s[n] for n in kind.names]))
                yield pd.DataFrame(out, columns=schema.names)

    return chunks.select("video_id", "chunk_id", "start_ms", "samples", "language", "segments").mapInPandas(run, schema)


def detect_shots(windows: DataFrame, make: Callable[[], ShotDetector]) -> DataFrame:
    """Shots of windows (video_id, chunk_id, start_ms, end_ms, content): one row in, many out."""
    d = windows.withColumnsRenamed({"start_ms": "w_start", "end_ms": "w_end"})
    return _each(d, ["video_id", "chunk_id"], make, lambda model, r: model.detect(r["content"], r["w_start"], r["w_end"]), "start_ms bigint, end_ms bigint")


def hsv_histogram(rgb) -> list[float]:
    """Colour histogram of an image (height x width x 3, bytes) in 12 x 6 x 4 bins of hue, saturation and value, of unit length."""
    import numpy as np

    x = np.asarray(rgb, np.float64).reshape(-1, 3)
    top, low = x.max(axis=1), x.min(axis=1)
    gap = np.where(top > low, top - low, 1.0)
    r, g, b = x.T
    hue = np.where(top == r, (g - b) / gap % 6, np.where(top == g, (b - r) / gap + 2, (r - g) / gap + 4)) * 30  # half degrees
    hue[top == low] = 0
    sat = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)
    bins = [np.minimum((v * n // m).astype(np.int64), n - 1) for v, n, m in ((np.rint(hue) % 180, 12, 180), (np.rint(sat), 6, 256), (top, 4, 256))]
    counts = np.bincount((bins[0] * 6 + bins[1]) * 4 + bins[2], minlength=288).astype(np.float64)
    return (counts / max(float(np.sqrt((counts**2).sum())), 1e-12)).tolist()


def histograms(images: DataFrame, decode: Callable[[bytes], object], image: str = "content") -> DataFrame:
    """images without the content, with `histogram`; null where `decode` (bytes to an RGB array of the size wanted) fails."""
    kept = [c for c in images.columns if c != image]
    schema = T.StructType([*[images.schema[c] for c in kept], T.StructField("histogram", T.ArrayType(T.DoubleType()))])

    def one(content) -> list[float] | None:
        try:
            return hsv_histogram(decode(bytes(content)))
        except Exception:  # noqa: BLE001 - unreadable images have no histogram
            return None

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b[kept].assign(histogram=[one(x) for x in b[image]])

    return images.mapInPandas(run, schema)
