"""Benchmark decontamination by winnowing.

Fingerprints of a word sequence are the minima of the k-gram hashes in each sliding window of w = n - k + 1 k-grams
(n = 13 words, k = 7), the rightmost on ties. Any shared span of n words holds a whole such window, and the same minimum
is chosen on both sides, so each shared span meets a shared fingerprint. Fingerprints of the documents are joined with
those of the benchmark; each hit is extended over the n-word spans that cover it, and a span counts if it equals one of
the benchmark (128 bits of hash). Benchmark items shorter than n words are one span each; they are looked up at every
position, which is winnowing with a window of one.

The documents stream through one Arrow pass without any shuffle, so hot passages and hot sources cost no more than others.
The benchmark is the stated query set: its size is measured first and it is cut into blocks of about `block_bytes` (long items into
pieces that overlap by n - 1 words, equal rows taken once), each broadcast in turn; with several blocks, the documents are numbered and
written once, each block returns only the numbers, masks and items of documents it hits, and these are joined at the end.

Defined results: null or empty texts have no words (n_words 0, not contaminated); benchmark items without words are
ignored; items that share an id count once; a null item id is written as an empty string. Repeated documents get equal
results; an empty benchmark hits nothing. Other columns pass through, whatever their names, or are not read. Of a very long text
whole arrays by word are held, by byte only a few bytes each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.llm.common import arrow_map, by_runs, chunks, materialise, mix64, powers, table, utf8


@dataclass(frozen=True)
class Winnow:
    """Production parameters."""

    n: int = 13  #: words of a span
    k: int = 7  #: words of a hashed gram; n - k + 1 grams make a window
    share: int = 20  #: contaminated if share * n_hit >= n_words
    block_bytes: int = 16_000_000  #: benchmark text broadcast at once
    chunk_bytes: int = 1 << 20  #: document text worked on at once


PARAMS = Winnow()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of each word of the texts."""
    low = _LOWER[data]
    inside = np.concatenate((_IS_WORD[low], [False]))
    edge = np.zeros(len(inside), bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of each word's bytes, finalised."""

    def some(starts, ends):
        lengths = ends - starts
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        value = (low[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(base, int(lengths.max()))[at]
        return mix64(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))

    return by_runs(some, starts, ends)


def gram_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of the words i .. i+k-1 for each i that has so many."""
    m = max(len(h) - k + 1, 0)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * np.uint64(base) + h[j : j + m]
    return mix64(out)


def winnow(grams: np.ndarray, text: np.ndarray, p: Winnow) -> np.ndarray:
    """Positions chosen: the rightmost minimum of every window within one text (text: number of each gram's span start)."""
    w = p.n - p.k + 1
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    whole = text[:m] == text[p.n - 1 : p.n - 1 + m]
    first = np.flatnonzero(whole)
    if not len(first):
        return first
    best, at = grams[first], first.copy()
    for j in range(1, w):
        other = grams[first + j]
        less = other <= best
        best = np.where(less, other, best)
        at = np.where(less, first + j, at)
    chosen = np.zeros(len(grams), bool)
    chosen[at] = True
    return np.flatnonzero(chosen)


class Index:
    """Spans and fingerprints of benchmark items; everything that is looked up is sorted."""

    def __init__(self, items: list[tuple[str, str]], p: Winnow):
        self.p = p
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
        low, starts, ends, text = word_spans(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids = [i for i, _ in items]
        h = [word_hashes(low, starts, ends, b) for b in _BASES]
        n_words = np.bincount(text, minlength=len(items))
        grams = gram_hashes(h[0], p.k, _BASES[0])
        self.fingerprints = np.unique(grams[winnow(grams, text, p)])
        self.spans = {}
        for n in sorted({min(int(x), p.n) for x in n_words if x}):
            m = len(text) - n + 1
            ok = (text[:m] == text[n - 1 :]) & ((n_words[text[:m]] == n) | (n == p.n))
            at = np.flatnonzero(ok)
            one, two = (gram_hashes(x, n, b)[at] for x, b in zip(h, _BASES, strict=True))
            order = np.lexsort((two, one))
            one, two, item = one[order], two[order], text[at][order]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            begin = np.flatnonzero(new)
            self.spans[n] = (one[begin], two[begin], np.concatenate((begin, [len(one)])), item)

    def items_of(self, spans: np.ndarray) -> list[str]:
        """Ids, sorted, of the items that hold any of the spans (length, number)."""
        lists = [self.spans[n][3][self.spans[n][2][k] : self.spans[n][2][k + 1]] for n, k in spans.tolist()]
        return sorted({self.ids[i] for i in np.unique(np.concatenate(lists)).tolist()})


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def find_hits(data: np.ndarray, offsets: np.ndarray, index: Index):
    """n_words of each text; then mask of hit words; then (text, length, number) of the different spans found, by text."""
    p = index.p
    low, starts, ends, text = word_spans(data, offsets)
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    hit = np.zeros(len(starts) + 1, np.int64)
    pairs: list[np.ndarray] = []
    first = word_hashes(low, starts, ends, _BASES[0])
    second = None
    for n, (one, two, _, _) in index.spans.items():
        m = len(text) - n + 1
        if m <= 0:
            continue
        if n == p.n:
            grams = gram_hashes(first, p.k, _BASES[0])
            chosen = winnow(grams, text, p)
            chosen = chosen[_find(index.fingerprints, grams[chosen]) >= 0]
            at = np.unique(chosen[:, None] - np.arange(p.n - p.k + 1)[None, :])  # spans that cover the hit
            at = at[(at >= 0) & (at < m)]
        else:
            at = np.arange(m)
        at = at[text[at] == text[at + n - 1]]
        if not len(at):
            continue
        # hashes of these spans alone: gather their words
        words = at[:, None] + np.arange(n)[None, :] if n == p.n else None
        key = gram_rows(first[words], _BASES[0]) if n == p.n else gram_hashes(first, n, _BASES[0])[at]
        found = _find(one, key)
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):
            continue
        if second is None:
            second = word_hashes(low, starts, ends, _BASES[1])
        check = gram_rows(second[at[:, None] + np.arange(n)[None, :]], _BASES[1])
        while True:  # of spans with one equal hash, the one whose other hash is equal too
            wrong = (two[found] != check) & (found + 1 < len(one))
            wrong &= one[np.minimum(found + 1, len(one) - 1)] == one[found]
            if not wrong.any():
                break
            found = found + wrong
        good = two[found] == check
        at, found = at[good], found[good]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        pairs.append(np.unique(np.stack((text[at], np.full(len(at), n), found), 1), axis=0))
    mask = np.cumsum(hit[:-1]) > 0
    spans = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
    return n_words, mask, spans[np.argsort(spans[:, 0], kind="stable")]


def gram_rows(h: np.ndarray, base: int) -> np.ndarray:
    """gram_hashes for rows of gathered word hashes."""
    out = np.zeros(len(h), np.uint64)
    for j in range(h.shape[1]):
        out = out * np.uint64(base) + h[:, j]
    return mix64(out)


_DIGEST = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
)


def _hits(texts: pa.Array, index: Index):
    """n_words, mask of hit words and ids of the items found of each text in turn; texts that share their spans share the list."""
    p = index.p
    data, offsets = utf8(texts)
    for i, j in chunks(offsets, p.chunk_bytes):
        n_words, mask, spans = find_hits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index)
        cuts, ends = np.searchsorted(spans[:, 0], np.arange(j - i + 1)), np.cumsum(n_words)
        known: dict[bytes, list[str]] = {b"": []}
        for d in range(j - i):
            own = spans[cuts[d] : cuts[d + 1], 1:]
            if (key := own.tobytes()) not in known:
                known[key] = index.items_of(own)
            yield int(n_words[d]), mask[ends[d] - n_words[d] : ends[d]], known[key]


def _digest(rows, p: Winnow) -> list[pa.Array]:
    """Columns of _DIGEST from rows of (n_words, mask, items)."""
    out: list[list] = [[] for _ in range(5)]
    for n_words, mask, items in rows:
        n_hit = int(mask.sum())
        for k, x in enumerate((n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and p.share * n_hit >= n_words)):
            out[k].append(x)
    return [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]


def _judged(docs: DataFrame, rows_of, p: Winnow, only_clean: bool, known: int) -> DataFrame:
    """docs (t, `known` columns for rows_of, then the kept ones) with the digest of rows_of(batch); or the clean rows alone."""
    kept = docs.columns[known:]
    schema = T.StructType([*[docs.schema[c] for c in kept], *([] if only_clean else _DIGEST)])

    def run(batches):
        for b in batches:
            digest = _digest(rows_of(b), p)
            cols = [b.column(c) for c in kept]
            if only_clean:
                clean = pc.invert(digest[4])
                yield pa.RecordBatch.from_arrays([c.filter(clean) for c in cols], kept)
            else:
                yield pa.RecordBatch.from_arrays([*cols, *digest], schema.names)

    return arrow_map(docs, run, schema)


def _merged(b: pa.RecordBatch):
    """rows_of for texts with the masks and items that the blocks found."""
    data, offsets = utf8(b.column("t"))
    n_words = np.bincount(word_spans(data, offsets)[3], minlength=b.num_rows)
    for n, masks, items in zip(n_words.tolist(), b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
        mask = np.zeros(n, bool)
        for m in masks or ():
            mask |= np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)
        yield n, mask, sorted(set(items or ()))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, p: Winnow) -> list[DataFrame]:
    """The benchmark in parts of about block_bytes each, by a measured size; no item or repeated row is longer than an eighth of it."""
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''").distinct()
    w, step = F.regexp_extract_all("text", F.lit(_ANY_CASE), F.lit(0)), max(p.block_bytes // 128, 1)
    bound = F.transform(F.array(w), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - p.n, F.lit(0)), F.lit(step)), lambda s: F.array_join(F.slice(w, s + 1, F.lit(step + p.n - 1)), " ")))
    b = b.select("id", F.explode(F.when(F.octet_length("text") > p.block_bytes // 8, F.get(bound, F.lit(0))).otherwise(F.array("text"))).alias("text"))
    total = b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // p.block_bytes)
    if n <= 1:
        return [b]
    of = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [b.filter(of == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", only_clean: bool = False, p: Winnow = PARAMS) -> DataFrame:
    """Columns `keep` of docs with n_words, n_hit, n_items, items_sha256 and contaminated; only_clean: just the clean rows of docs."""
    keep = docs.columns if keep is None else keep
    assert only_clean or not set(keep) & set(_DIGEST.names), "name the columns to keep: some clash with the results"
    sc, names = docs.sparkSession.sparkContext, [f"c{k}" for k in range(len(keep))]
    d = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    parts = blocks(benchmark, item_col, item_text, p)
    index_of = lambda part: sc.broadcast(Index([(r[0], r[1]) for r in part.collect()], p))
    if len(parts) == 1:
        index = index_of(parts[0])
        out = _judged(d, lambda b: _hits(b.column(0), index.value), p, only_clean, 1)
    else:
        d = materialise(d.select(F.monotonically_increasing_id().alias("r"), "*"), "decontam-docs")
        found = [materialise(_found(d.select("r", "t"), index), "decontam-hits") for index in map(index_of, parts)]
        # a document has one row a block at most
        merged = reduce(DataFrame.unionByName, found).groupBy("r").agg(F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        out = _judged(d.join(merged, "r", "left").select("t", "hits", "items", *names), _merged, p, only_clean, 3)
    return out.toDF(*keep, *([] if only_clean else _DIGEST.names))


def _found(texts: DataFrame, index) -> DataFrame:
    """r, hit (mask of words, a bit each), items of the texts that a block of the benchmark hits."""

    def run(batches):
        for b in batches:
            rows = [(k, np.packbits(mask).tobytes(), items) for k, (_, mask, items) in enumerate(_hits(b.column(1), index.value)) if items]
            at = pa.array([k for k, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([m for _, m, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.list_(pa.string()))], ["r", "hit", "items"])

    return arrow_map(texts, run, "r bigint, hit binary, items array<string>")


def op3(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s+n-1], ' ') AS span FROM
  (SELECT item, w, least(len(w), {PARAMS.n}) AS n, unnest(range(1, len(w) - least(len(w), {PARAMS.n}) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
h AS (SELECT rid, s, n, item FROM (SELECT rid, n, s, array_to_string(w[s:s+n-1], ' ') AS span FROM
  (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= n)) JOIN iw USING (n, span)),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, CAST(s + n AS BIGINT))) AS x FROM (SELECT DISTINCT rid, s, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {PARAMS.share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
