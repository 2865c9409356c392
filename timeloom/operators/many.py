"""Many questions against all items in one scan.

Questions are sent to the tasks 16 blocks at a time (their vectors and keywords are a few megabytes), and for all of them the items stream once,
a batch against a block of questions at a time: vectors are one matrix product with the keywords of many questions, other keywords are added where
they are said. Each task keeps for each question the positions that can be among its best k, with a margin for what floating-point sums of
another order may differ by; of all tasks' positions those that still can be are left. Only their items are fetched again, scored by the same
expressions as a single search, and ranked per question.

Defined results: as `retrieval.search_moments` for each question; an item without an embedding isn't found; a null question finds nothing, one
without keywords is ranked by its vector alone; a vector of another length is an error. Repeated questions need ids of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings
from timeloom.functions.text import keyword_overlap, keywords, words
from timeloom.functions.vectors import dot, search_score

#: More than sums of products of unit length can differ by when they are added in another order.
MARGIN = 1e-7


#: Questions are sent to the tasks so many blocks at a time.
SENT = 16


class Best:
    """For each question the items that may be among its best k: rounded scores as high and as low as can be, and positions."""

    def __init__(self, questions: int, k: int):
        self.k, self.held = k, [(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(questions)]
        self.floor = np.full(questions, -np.inf)

    def add(self, scores: np.ndarray, pos: np.ndarray, row: np.ndarray, first: int = 0) -> None:
        """scores: items x questions, of which the first is number `first`."""
        s, floor = scores.T, self.floor[first : first + scores.shape[1]]
        if len(pos) > self.k and np.isneginf(floor).any():
            # so many items of this batch alone are as good
            floor = np.maximum(floor, np.round(np.partition(s, -self.k, axis=1)[:, -self.k] - MARGIN, 3))
        q, item = np.nonzero(s >= (floor - 0.0006)[:, None])
        score = s[q, item]
        high, low = np.round(score + MARGIN, 3), np.round(score - MARGIN, 3)
        good = high >= floor[q]
        q, item, high, low = q[good], item[good], high[good], low[good]
        asked, start = np.unique(q, return_index=True)
        for n, i, j in zip((asked + first).tolist(), start.tolist(), [*start[1:].tolist(), len(q)], strict=True):
            new = item[i:j]
            h, lo, p, r = (np.concatenate((a, b)) for a, b in zip(self.held[n], (high[i:j], low[i:j], pos[new], row[new]), strict=True))
            if len(h) >= self.k:
                sure = np.lexsort((p, -lo))[self.k - 1]  # the k-th best at worst
                keep = (h > lo[sure]) | (h == lo[sure]) & (p <= p[sure])
                self.floor[n] = lo[sure]
                h, lo, p, r = h[keep], lo[keep], p[keep], r[keep]
            self.held[n] = (h, lo, p, r)


def search_many(items: DataFrame, questions: DataFrame, k: int = 10, kinds: list[str] | None = None, s: Settings = DEFAULTS, block: int = 1000) -> DataFrame:
    """question_id, place (from 1), similarity, score and the items' columns but the embedding. questions: question_id, query, vector."""
    d = items if kinds is None else items.filter(F.col("kind").isin(kinds))
    asked = questions.filter("query is not null and vector is not null").select("question_id", "query", "vector")
    found = None
    rounds = max(1, -(-asked.count() // (block * SENT)))
    numbered = asked.withColumn("__round", F.pmod(F.xxhash64("question_id"), F.lit(rounds)))
    for b in range(rounds):
        mine = numbered.filter(F.col("__round") == b).drop("__round")
        part = _search(d, mine, k, s, block)
        found = part if found is None else found.unionByName(part)
    return found


def _added(said: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items and the keywords they say, by number, each pair once."""
    number = pc.index_in(said.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(said)), np.diff(said.offsets.to_numpy()))
    known = ~np.isnan(number.astype(float))
    pairs = np.unique(item[known] * len(vocabulary) + number[known].astype(np.int64))
    return np.divmod(pairs, max(len(vocabulary), 1))


def _search(items: DataFrame, questions: DataFrame, k: int, s: Settings, block: int) -> DataFrame:
    held = questions.withColumn("keys", keywords(F.col("query"))).toArrow().combine_chunks()  # a few blocks of rows
    ids = held.column("question_id")
    size = set(pc.unique(pc.list_value_length(held.column("vector"))).to_pylist())
    if len(size) > 1:
        raise ValueError("questions have vectors of different lengths")
    matrix = pc.list_flatten(held.column("vector")).to_numpy().astype(float).reshape(len(ids), max(size, default=0))
    keys = held.column("keys").to_pylist()
    names = sorted({w for x in keys for w in x})
    place = {w: i for i, w in enumerate(names)}
    # (keyword, question, share), by keyword within each block of questions
    posted = np.array([(place[w], q, s.keyword_bonus / len(x)) for q, x in enumerate(keys) for w in x]).reshape(-1, 3)
    blocks = []
    for q in range(0, len(ids), block):
        n = min(block, len(ids) - q)
        mine = posted[(posted[:, 1] >= q) & (posted[:, 1] < q + n)]
        mine = mine[np.argsort(mine[:, 0], kind="stable")]
        word, asks, share = mine[:, 0].astype(np.int64), mine[:, 1].astype(np.int64) - q, mine[:, 2]
        times = np.bincount(word, minlength=len(names))
        often = np.flatnonzero(times > max(8, n // 32))  # at most 32 times as many as a question has keywords
        dense = np.zeros((len(often), n))
        loud = np.isin(word, often)
        dense[np.searchsorted(often, word[loud]), asks[loud]] = share[loud]
        count = np.where(np.isin(np.arange(len(names)), often), 0, times)
        blocks.append((q, n, often, np.hstack((matrix[q : q + n], dense.T)), count, np.cumsum(count) - count, asks[~loud], share[~loud]))
    source = items.filter("embedding is not null").select("pos", "embedding", F.coalesce(F.transform(words(F.col("text")), F.lower), F.array().cast("array<string>")).alias("__words"))
    width, total = matrix.shape[1], len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known, kind = Best(total, k), pa.array(names, pa.string()), None
        for b in batches:
            kind = b.column("pos").type
            vectors = b.column("embedding")
            size = np.diff(vectors.offsets.to_numpy())
            if width and len(size) and (size != width).any():
                raise ValueError(f"the questions have {width} dimensions, an item {int(size[size != width][0])}")
            if not len(size) or not total:
                continue
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(size), -1)
            item, word = _added(b.column("__words"), known)
            at = b.column("pos").to_numpy(zero_copy_only=False)
            for q, n, often, weights, count, begin, asks, share in blocks:
                has = np.zeros((len(size), len(often)))
                if len(often):
                    column = np.minimum(np.searchsorted(often, word), len(often) - 1)
                    hit = often[column] == word
                    has[item[hit], column[hit]] = 1
                score = weights @ np.hstack((x, has)).T  # questions x items
                per = count[word]
                # a stretch of pairs at a time, each with few questions
                past = np.cumsum(per)
                for i, j in _stretches(past, 1 << 22):
                    m = per[i:j]
                    post = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[word[i:j]], m)
                    np.add.at(score, (asks[post], np.repeat(item[i:j], m)), share[post])
                best.add(score.T, at.astype(float), at, q)
        out = [(q, h, lo, r) for q, (h, lo, _, r) in enumerate(best.held) if len(r)]
        if out:
            numbers = np.repeat([q for q, *_ in out], [len(r) for *_, r in out])
            high, low, at = (np.concatenate([o[c] for o in out]) for c in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(high), pa.array(low), pa.array(at, kind)], ["__q", "__high", "__low", "pos"])

    few = source.mapInArrow(run, f"__q int, __high double, __low double, pos {dict(items.dtypes)['pos']}")
    mine = Window.partitionBy("__q")
    few = few.withColumn("__n", F.row_number().over(mine.orderBy(F.desc("__low"), "pos")))
    few = few.withColumn("__sure", F.max(F.when(F.col("__n") == k, F.struct("__low", "pos"))).over(mine))
    can = F.col("__sure").isNull() | (F.col("__high") > F.col("__sure.__low")) | ((F.col("__high") == F.col("__sure.__low")) & (F.col("pos") <= F.col("__sure.pos")))
    few = few.filter(can).select("__q", F.col("pos").alias("__pos")).distinct()
    columns = [c for c in items.columns if c != "embedding"]
    numbers = items.sparkSession.createDataFrame(pa.table({"__q": pa.array(range(total), pa.int32()), **{c: held.column(c) for c in ("question_id", "query", "vector")}}))
    x = items.filter("embedding is not null").join(few, F.col("pos") == F.col("__pos")).join(F.broadcast(numbers), "__q").withColumn("__sim", dot(F.col("embedding"), F.col("vector")))
    x = x.withColumn("similarity", F.round("__sim", 3)).withColumn("score", search_score(F.col("__sim"), keyword_overlap(keywords(F.col("query")), F.coalesce("text", F.lit(""))), s))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "pos"))).filter(F.col("place") <= k)
    return x.select("question_id", "place", "similarity", "score", *columns)


def _stretches(past: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges that add up to about `most`, of running sums."""
    i, before = 0, 0
    while i < len(past):
        j = max(i + 1, int(np.searchsorted(past, before + most, side="right")))
        yield i, j
        i, before = j, int(past[j - 1])
