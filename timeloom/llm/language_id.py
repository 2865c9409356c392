"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Scores are softmax probabilities at a temperature fitted on a part of the sample that isn't learned from; the same part sets
the rejection threshold, the lowest score at which at most `max_error` of the accepted predictions are wrong. `rejected` marks
predictions below it, and those of texts without any subword seen in training.

Defined results: a null text, or one without a letter, is `und` with score 0.0 (rejected). Without any labelled row every text is
`und`. Rows with a null id are never learned from; held_out is false for them. Other columns are not read. Very long texts are
summed in parts, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, chunks, crc_mod, table, utf8
from timeloom.llm.sampling import labelled_sample
from timeloom.llm.subwords import averages, bags, softmax, train


@dataclass(frozen=True)
class LanguageId:
    """Production parameters."""

    buckets: int = 1 << 15
    dim: int = 16
    sizes: tuple[int, ...] = (2, 3, 4)
    per_language: int = 600
    max_bytes: int = 8000
    epochs: int = 3
    rate: float = 0.3
    max_error: float = 0.01
    chunk_bytes: int = 1 << 19


PARAMS = LanguageId()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def fit(texts: list[str], languages: list[str], p: LanguageId = PARAMS) -> Model:
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages], np.int64)
    data, offsets = utf8(pa.array(texts, pa.string()))
    samples = []
    for i, j in chunks(offsets, p.chunk_bytes):
        samples += bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.sizes, p.buckets)
    learn = np.arange(len(y)) % 5 != 4
    if not names or not learn.any():
        return Model(names, np.zeros((p.buckets, len(names))), np.zeros(len(names)))
    table_, bias = train([s for s, k in zip(samples, learn, strict=True) if k], y[learn], len(names), p.buckets, p.dim, p.epochs, p.rate)
    model = Model(names, table_.astype(np.float64), bias.astype(np.float64))
    rest = np.flatnonzero(~learn) if (~learn).sum() >= 10 else np.arange(len(y))
    z = np.stack([samples[k][1] @ model.table[samples[k][0]] + model.bias for k in rest])
    grid = 2.0 ** np.arange(-3, 6.01, 0.25)
    loss = [-np.log(softmax(z / t)[np.arange(len(rest)), y[rest]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    s = softmax(z / model.temperature)
    top, right = s.max(axis=1), s.argmax(axis=1) == y[rest]
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(wrong <= p.max_error)
    model.threshold = float(top[order][ok[-1]]) if len(ok) else 1.0
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", p: LanguageId = PARAMS) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), letters.alias("letters"))

    def run(batches):
        m = held.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            data, offsets = utf8(b.column(1))
            pred, score, known = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
            for i, j in chunks(offsets, p.chunk_bytes):
                if not m.languages:
                    pred.append(np.zeros(j - i, np.int64))
                    score.append(np.zeros(j - i))
                    known.append(np.zeros(j - i, bool))
                    continue
                mean, n = averages(m.table, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.sizes)
                s = softmax((mean + m.bias) / m.temperature)
                pred.append(s.argmax(axis=1))
                score.append(s.max(axis=1))
                known.append(n > 0)
            has = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            none = ~has if m.languages else np.ones(len(has), bool)
            pred_, score_ = np.where(none, len(m.languages), np.concatenate(pred)), np.where(none, 0.0, np.concatenate(score))
            rejected = none | (score_ < m.threshold) | ~np.concatenate(known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pred_].tolist(), pa.string()), pa.array(score_), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return arrow_map(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.select("doc_id", "text", F.col("lang").alias("label")).filter(crc_mod(F.col("doc_id"), 4) != 2)
    sample, _ = labelled_sample(learn, None, PARAMS.per_language, PARAMS.max_bytes)
    model = fit(sample.column("text").to_pylist(), sample.column("label").to_pylist())
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
