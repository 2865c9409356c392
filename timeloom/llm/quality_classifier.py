"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader (FTRL-proximal).

Words are runs of bytes other than white space. Features, hashed into one table: words and pairs of neighbouring words in
lower case; the shapes of words (runs of capitals, small letters and digits, marks as they are) alone and in pairs; and
whether a word equals the one before. A text's score is the sparse dot product of its feature shares with the weights.

Training takes a bounded sample (`per_class`, `max_bytes`); classes weigh alike in it, and the offset is put right for the
classes' shares among all labelled rows.

Defined results: null and empty texts have no features: the score of the offset. Without labelled rows, or with one label only,
every score is the share of label 1 (0.0 without rows). Other columns are not read. Of very long texts whole arrays by word are held,
but by byte only a few bytes each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, by_runs, chunks, crc_mod, mix64, powers, table, utf8
from timeloom.llm.sampling import labelled_sample


@dataclass(frozen=True)
class Ftrl:
    """Production parameters."""

    buckets: int = 1 << 18
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 6
    per_class: int = 2500
    max_bytes: int = 12_000
    scale: float = 10.0  #: of the feature shares
    chunk_bytes: int = 1 << 20


PARAMS = Ftrl()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[48:58] = 48
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of values."""

    def some(starts, ends):
        lengths = ends - starts
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x = (values[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(lengths.max()))[at]
        return mix64(np.add.reduceat(x, np.cumsum(lengths) - lengths))

    return by_runs(some, starts, ends)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature, and how many words each text has."""
    n = len(offsets) - 1
    inside = np.concatenate((~_SPACE[data], [False]))
    edge = np.zeros(len(inside), bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    text = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(text, minlength=n)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    word = _hashes(_LOWER[data], starts, ends)
    shape = _SHAPE[data]
    new = inside[:-1] & np.concatenate(([True], shape[1:] != shape[:-1]))
    new[starts] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    shape = _hashes(shape[new], upto[starts], upto[ends])
    pair = np.flatnonzero(text[1:] == text[:-1])
    mul = np.uint64(_BASE)
    same = word[pair] == word[pair + 1]
    keys = [word, mix64(word[pair] * mul + word[pair + 1]), mix64(shape + np.uint64(3)), mix64((shape[pair] + np.uint64(5)) * mul + shape[pair + 1]), mix64(np.uint64(7) + same.astype(np.uint64))]
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return (np.concatenate(keys) >> shift).astype(np.int64), np.concatenate((text, text[pair], text, text[pair], text[pair])), n_words


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def fit(texts: list[str], labels: np.ndarray, prior: float = 0.5, p: Ftrl = PARAMS) -> Model:
    """prior: share of label 1 among all labelled rows, as the sample takes classes alike."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(p.buckets), float(np.clip(np.log(max(share, 1e-18) / max(1 - share, 1e-18)), -40, 40)))
    samples = []
    data, offsets = utf8(pa.array(texts, pa.string()))
    for i, j in chunks(offsets, p.chunk_bytes):
        b, text, n_words = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.buckets)
        order = np.argsort(text, kind="stable")
        b, cuts = b[order], np.searchsorted(text[order], np.arange(j - i + 1))
        for k in range(j - i):
            u, c = np.unique(b[cuts[k] : cuts[k + 1]], return_counts=True)
            samples.append((u.astype(np.int32), (p.scale * c / max(n_words[k], 1)).astype(np.float32)))
    share = labels.mean()
    each = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    z, q = np.zeros(p.buckets, np.float32), np.zeros(p.buckets, np.float32)
    z0 = q0 = 0.0
    rng = np.random.default_rng(5)
    for _ in range(p.epochs):
        for i in rng.permutation(len(labels)):
            u, x = samples[i]
            zu, qu = z[u], q[u]
            w = np.where(np.abs(zu) <= p.l1, 0, -(zu - np.sign(zu) * p.l1) / ((p.beta + np.sqrt(qu)) / p.alpha + p.l2))
            w0 = -z0 / ((p.beta + q0**0.5) / p.alpha)
            s = float(w @ x) + w0
            g = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - labels[i]) * each[i]
            gx = np.float32(g) * x
            z[u] = zu + gx - (np.sqrt(qu + gx * gx) - np.sqrt(qu)) / p.alpha * w
            q[u] = qu + gx * gx
            z0 += g - ((q0 + g * g) ** 0.5 - q0**0.5) / p.alpha * w0
            q0 += g * g
    w = np.where(np.abs(z) <= p.l1, 0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(q)) / p.alpha + p.l2))
    w0 = -z0 / ((p.beta + q0**0.5) / p.alpha)
    return Model(w.astype(np.float64) * p.scale, w0 + float(np.log(prior / (1 - prior))))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", p: Ftrl = PARAMS) -> DataFrame:
    """doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        m = held.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            out = [np.zeros(0)]
            for i, j in chunks(offsets, p.chunk_bytes):
                k, text, n = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.buckets)
                s = np.bincount(text, weights=m.weight[k], minlength=j - i) / np.maximum(n, 1) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(s, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return arrow_map(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(crc_mod(F.col("doc_id"), 5) != 0)
    sample, counts = labelled_sample(docs, labels, PARAMS.per_class, PARAMS.max_bytes)
    prior = min(max(counts.get(1, 0) / max(sum(counts.values()), 1), 0.01), 0.99)
    model = fit(sample.column("text").to_pylist(), sample.column("label").to_numpy(), prior)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
