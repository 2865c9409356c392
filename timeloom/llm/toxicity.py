"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into segments of about `segment` bytes (words stay whole). Each segment is the average of the embeddings of its
words and character n-grams, put through a linear softmax; the document's score is that of its worst segment, so a few
words in a very long text count as much as in a short one. Misspelt words share most n-grams with the words they stand for.

Training, on a bounded sample (`per_class`, `max_bytes`): first whole texts; then segments, where a toxic text
teaches with its worst segment and a clean text with its worst and one more, which finds the words that make texts toxic.
A part of the sample isn't learned from; it sets the cut: the log-odds above which a share `flagged` of its clean texts lies score
0.5 or more. Scores rise with the log-odds but aren't calibrated probabilities.

Defined results: texts without a subword (null and empty ones too) say nothing and score as the median of the clean texts set
aside, below 0.5. Without any labelled row, or with one label only, every score is the share of label 1 (0.0 without rows). Other columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, chunks, crc_mod, cut_long, table, utf8
from timeloom.llm.sampling import labelled_sample
from timeloom.llm.subwords import subwords, text_starts, train


@dataclass(frozen=True)
class Toxicity:
    """Production parameters; sizes, segment, min_docs, refine and flagged are those that toxicity_search returned."""

    buckets: int = 1 << 17
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5, 6, 7)  #: in bytes, of which a letter outside ASCII takes two or more
    segment: int = 8  #: about a word, so that the words around one don't dilute it
    per_class: int = 3000
    max_bytes: int = 6000
    min_docs: int = 3  #: subwords of fewer texts of the sample teach nothing, so that single texts aren't learned by heart
    epochs: int = 5
    rate: float = 0.5
    refine: int = 8  #: rounds over segments
    clean: int = 2  #: clean segments drawn for each worst segment
    held_out: int = 4  #: one in so many of the sample fits the calibration
    flagged: float = 0.003  #: clean texts that may score 0.5 or more
    chunk_bytes: int = 1 << 19


PARAMS = Toxicity()


@dataclass
class Model:
    """weight of each bucket and bias (log-odds), then scale and offset of the calibration; log-odds of texts without subwords."""

    weight: np.ndarray
    bias: float
    scale: float
    offset: float
    empty: float = 0.0

    def score(self, z: np.ndarray) -> np.ndarray:
        z = np.where(np.isnan(z), self.empty, z)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -40, 40)))


def segments(data: np.ndarray, offsets: np.ndarray, p: Toxicity):
    """(bucket, segment) of every subword, ordered by segment; text of each segment. Every text has a segment."""
    b, pos = subwords(data, offsets, p.sizes, p.buckets)
    starts = text_starts(offsets)
    # the word's own start decides, so that its n-grams stay together
    marks = np.zeros(int(starts[-1]) + 2, np.int64)
    n = len(offsets) - 1
    low = np.full(len(marks), True)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    low[place] = _SPACE[data]
    at = np.flatnonzero(low)
    marks[at] = at
    word = np.maximum.accumulate(marks)[pos]
    text = np.searchsorted(starts, pos, side="right") - 1
    per = np.maximum(-(-np.diff(offsets) // p.segment), 1)
    first = np.concatenate(([0], np.cumsum(per)))
    seg = first[text] + np.minimum(np.maximum(word - starts[text], 0) // p.segment, per[text] - 1)
    order = np.argsort(seg, kind="stable")
    return b[order], seg[order], np.repeat(np.arange(n), per)


_SPACE = np.ones(256, bool)
_SPACE[65:91] = _SPACE[97:123] = _SPACE[128:] = False


def worst(weight: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray, p: Toxicity) -> np.ndarray:
    """Highest log-odds of any segment of each text; NaN without subwords. Texts over chunk_bytes are cut at white space, where segments begin anew."""
    parts, owner = cut_long(data, offsets, p.chunk_bytes)
    best = np.full(len(offsets) - 1, -np.inf)
    for i, j in chunks(parts, p.chunk_bytes):
        b, seg, text = segments(data[parts[i] : parts[j]], parts[i : j + 1] - parts[i], p)
        n = np.bincount(seg, minlength=len(text))
        z = np.bincount(seg, weights=weight[b], minlength=len(text)) / np.maximum(n, 1) + bias
        z[n == 0] = -np.inf  # a segment inside a long word: only the word's first one counts
        np.maximum.at(best, owner[i:j], np.maximum.reduceat(z, np.searchsorted(text, np.arange(j - i))))
    return np.where(np.isfinite(best), best, np.nan)


def fit(texts: list[str], labels: np.ndarray, p: Toxicity = PARAMS) -> Model:
    labels = np.asarray(labels, np.int64)
    found = learn(texts, labels, p) if len(labels) and labels.min() < labels.max() else None
    if found is None:  # one label only, or no clean text with a subword: the share of label 1 is all there is
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(p.buckets), 0.0, 0.0, float(np.clip(np.log(max(share, 1e-18) / max(1 - share, 1e-18)), -40, 40)))
    weight, bias, z, y, empty = found
    return Model(weight, bias, *calibrate(z, y, p.flagged), empty)


def learn(texts: list[str], labels: np.ndarray, p: Toxicity = PARAMS) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, float] | None:
    """Weights and bias; log-odds and labels of the texts set aside; log-odds of the median clean text of them."""
    rng = np.random.default_rng(11)
    taught = rng.random(len(labels)) >= 1 / p.held_out
    data, offsets = utf8(pa.array(texts))
    parts = [(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, p.chunk_bytes)]
    # whole texts first, each different subword weighing alike
    bag: list[np.ndarray] = []
    for i, j, d, o in parts:
        b, seg, text = segments(d, o, p)
        cuts = np.searchsorted(text[seg], np.arange(j - i + 1))
        bag += [np.unique(b[x:y]).astype(np.int32) for x, y in itertools.pairwise(cuts.tolist())]
    common = np.bincount(np.concatenate(bag), minlength=p.buckets) >= p.min_docs
    bag = [u[common[u]] for u in bag]
    chosen = np.flatnonzero(taught)
    weight, bias = train([(bag[k], np.full(len(bag[k]), 1 / max(len(bag[k]), 1), np.float32)) for k in chosen], labels[chosen], 2, p.buckets, p.dim, p.epochs, p.rate)
    del bag
    # then segments: of each text the worst one, of clean texts others too; only these are held
    for r in range(p.refine):
        w1, picked, of = weight[:, 1] - weight[:, 0], [], []
        for i, j, d, o in parts:
            b, seg, text = segments(d, o, p)
            n = np.bincount(seg, minlength=len(text))
            z = np.where(n > 0, np.bincount(seg, weights=w1[b], minlength=len(text)) / np.maximum(n, 1), -np.inf)
            order = np.lexsort((z, text))
            pick = order[np.searchsorted(text[order], np.arange(j - i), side="right") - 1]
            clean = np.flatnonzero((labels[i:j] == 0)[text])
            if len(clean):
                pick = np.unique(np.concatenate((pick, rng.choice(clean, min(len(clean), p.clean * (j - i)), replace=False))))
            pick = pick[taught[i + text[pick]]]
            cuts = np.searchsorted(seg, np.stack((pick, pick + 1)))
            for x, y, t in zip(*cuts.tolist(), text[pick].tolist(), strict=True):
                u, c = np.unique(b[x:y], return_counts=True)
                ok = common[u]
                if ok.any():
                    picked.append((u[ok].astype(np.int32), (c[ok] / (y - x)).astype(np.float32)))
                    of.append(labels[i + t])
        weight, bias = train(picked, np.array(of), 2, p.buckets, p.dim, p.epochs, p.rate, seed=13 + r)
    w1, b1 = (weight[:, 1] - weight[:, 0]).astype(np.float64), float(bias[1] - bias[0])
    z = np.concatenate([worst(w1, b1, d, o, p) for _, _, d, o in parts])
    said = ~np.isnan(z)
    clean = next((k for k in (~taught & said & (labels == 0), said & (labels == 0)) if k.any()), None)
    if clean is None:
        return None
    cal = said & (~taught if (~taught & clean).any() else True)
    return w1, b1, z[cal], labels[cal], float(np.median(z[clean]))


def calibrate(z: np.ndarray, y: np.ndarray, flagged: float) -> tuple[float, float]:
    """Scale and offset that put the cut above which a share `flagged` of the clean texts lies at a score of 0.5.

    The scale sets the mean distance from the cut to 2, which needs no fit of heavy tails.
    """
    cut = float(np.quantile(z[y == 0], 1 - flagged, method="higher"))
    scale = 2 / max(float(np.abs(z - cut).mean()), 1e-6)
    return scale, -scale * float(np.nextafter(cut, np.inf))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", p: Toxicity = PARAMS) -> DataFrame:
    """doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        m = held.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(worst(m.weight, m.bias, data, offsets, p)))], ["doc_id", "score"])

    return arrow_map(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(crc_mod(F.col("doc_id"), 5) != 0)
    sample, _ = labelled_sample(docs, labels, PARAMS.per_class, PARAMS.max_bytes)
    model = fit(sample.column("text").to_pylist(), sample.column("label").to_numpy())
    out = score_texts(docs, model)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
