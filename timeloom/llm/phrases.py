"""Phrase collocation mining by hashed bucket counts (PCY, DHP) with Apriori pruning.

Pass n over the texts counts n-grams exactly, and beside them, by buckets of a hash, the (n + 1)-grams of the next pass. An n-gram is
counted only if both its (n - 1)-grams are frequent (Apriori) and its bucket reached the threshold (PCY); an (n + 1)-gram enters the buckets
only if both its n-grams passed those tests (DHP). Both tests are bitmaps of 2^bits buckets, built in Spark slice by slice; their size is
fixed by the parameters, whatever the corpus, so they are broadcast. Both can only let too much through, and exact counts decide afterwards:
too few buckets cost time, never a phrase.

Texts are never shuffled. Tasks count n-grams a chunk at a time by numbers of words, without hashes in place of words, and Spark adds up the chunks'
distinct n-grams. Counts, bounds and scores are joins and aggregates of frequent phrases; nothing gathers a language in one task but its best `top`.

Defined results: a null text is empty; a null language is `und`, as the value `und` is; everything is per language; ties follow the contract (score,
count, phrase in UTF-8 bytes); repeated rows and null ids count as any row. An empty table gives an empty table. Columns other than text and
language are not read. Long texts are counted in parts that overlap by max_words - 1 words, each n-gram in the part its first word begins in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, by_runs, chunks, discard, materialise, mix64, table, utf8
from timeloom.llm.token_output import distinct_words


@dataclass(frozen=True)
class Mining:
    """Production parameters."""

    max_words: int = 3
    min_count: int = 10
    cover_pct: int = 50  #: a phrase is dropped if a longer one has this share of its count
    top: int = 2000  #: reported per language
    bucket_bits: int = 24  #: 2^bits buckets a bitmap: 2 MB each
    slice_bits: int = 16  #: 2^bits buckets travel together
    chunk_bytes: int = 2 << 20


MINING = Mining()

_GAP = np.zeros(256, bool)
_GAP[list(b" \t.,;:!?\n\x0b\x0c\r")] = True
_BREAK = _GAP.copy()
_BREAK[[32, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, the same in every task."""

    def some(a, b):
        n = b - a
        h = mix64(n.astype(np.uint64) * _MUL)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        low = np.concatenate(((np.uint64(1) << (8 * np.arange(8, dtype=np.uint64))) - np.uint64(1), [np.uint64(0xFFFFFFFFFFFFFFFF)]))
        left, k = np.flatnonzero(n > 0), 0
        while len(left):
            h[left] = mix64(h[left] * _MUL + (at[a[left] + k] & low[np.minimum(n[left] - k, 8)]))
            k += 8
            left = left[n[left] > k]
        return h

    return by_runs(some, starts, ends)


class Grams:
    """n-grams of a chunk: at level n, `id` numbers the n-gram that begins at each word (-1: none), `hash` and `count` are by number, `first` is a place of it.

    Only n-grams that begin before byte `own` exist, at any level the tests let through.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, own: int):
        self.data = _LOWER[data]
        gap = _GAP[data]
        inside = np.concatenate((~gap, [False]))
        edge = np.zeros(len(inside), bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        self.starts, self.ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data] | edge[:-1])))
        # a break, or the first byte of a text, between the start of a word (itself not counted) and that of the next
        self.joined = np.append(breaks[self.starts[1:] + 1] == breaks[self.starts[:-1] + 1], False) if len(self.starts) else np.zeros(0, bool)
        self.own = self.starts < own
        text = np.searchsorted(offsets, self.starts, side="right") - 1
        found = distinct_words(self.data, self.starts, self.ends, np.zeros(len(self.starts), np.int64)) if len(self.starts) else (self.starts, self.starts)
        if found is None:
            raw = self.data.tobytes()
            words = np.array([raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], object)
            found = np.unique(words, return_index=True, return_inverse=True)[1:]
        one, self.word = found
        self.spelt = (self.starts[one], self.ends[one])
        lang = langs[text]
        self.lang = lang
        _, first, self.id = np.unique(lang * max(len(one), 1) + self.word, return_index=True, return_inverse=True)
        self.first = first
        self.base = mix64(word_hashes(self.data, *self.spelt)[self.word[first]] + lang_hash[lang[first]] * _MUL)
        self.hash, self.base_id = self.base, self.id
        self.count = np.bincount(self.id[self.own], minlength=len(first))
        self.span = 1  # words of an n-gram

    def test(self, passes: np.ndarray) -> None:
        """Keep the n-grams of this level for which passes holds, by number."""
        self.id = np.where(self.id >= 0, np.where(passes[self.id], self.id, -1), -1) if len(passes) else self.id

    def lengthen(self) -> None:
        """From n-grams to the (n + 1)-grams both of whose n-grams are there."""
        n = len(self.hash)
        at = np.flatnonzero(self.joined[: len(self.id)] & (self.id >= 0) & np.append(self.id[1:] >= 0, False)) if len(self.id) else self.id
        # the n-gram at the next word exists, so no break lies in it
        keys = self.id[at] * n + self.id[at + 1]
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        place = at[first]
        last = self.base[self.base_id[place + self.span]] if len(place) else np.zeros(0, np.uint64)
        self.hash = mix64(self.hash[self.id[place]] * _MUL + last) if len(place) else np.zeros(0, np.uint64)
        out = np.full(len(self.id), -1, np.int64)
        out[at] = number
        self.id, self.first, self.span = out, place, self.span + 1
        owned = self.own & (out >= 0)
        self.count = np.bincount(out[owned], minlength=len(place))

    def phrases(self, keep: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        """lang, phrase, f of the n-grams in keep."""
        place = self.first[keep]
        n = self.span
        offsets = np.concatenate(([0], np.cumsum(self.spelt[1] - self.spelt[0])))
        raw = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], np.diff(offsets)) + np.repeat(self.spelt[0], np.diff(offsets))
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[raw].tobytes()))
        parts = [pc.take(words, pa.array(self.word[place + k])) for k in range(n)]
        phrase = (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]).cast(pa.string())
        return pa.RecordBatch.from_arrays([pc.take(names, pa.array(self.lang[place])), phrase, pa.array(self.count[keep], pa.int64())], ["lang", "phrase", "f"])


def parts_of(data: np.ndarray, offsets: np.ndarray, p: Mining) -> Iterator[tuple[int, int, int, int, int]]:
    """(first text, past last, first byte, past own bytes, past bytes): whole texts, or parts of a long one with the words its last phrases need."""
    for i, j in chunks(offsets, p.chunk_bytes):
        a, end = int(offsets[i]), int(offsets[j])
        if end - a <= 2 * p.chunk_bytes:
            yield i, j, a, end, end
            continue
        while a < end:
            own, step = a + p.chunk_bytes, 1 << 16
            while own < end:  # to the next end of a word
                found = np.flatnonzero(_GAP[data[own : own + step]])
                if len(found):
                    own += int(found[0])
                    break
                own += step
            past, look = min(own, end), 1 << 12
            while past < end:  # and past as many words as a phrase can have after its first
                seen = _GAP[data[own : min(own + look, end)]]
                stops = np.flatnonzero(seen[1:] & ~seen[:-1]) + 1
                if len(stops) >= p.max_words - 1:
                    past = own + int(stops[p.max_words - 2])
                    break
                if own + look >= end:
                    past = end
                look *= 2
            own = min(own, end)
            yield i, j, a, own, past
            a = own


def _bits(bitmap: np.ndarray, h: np.ndarray, p: Mining) -> np.ndarray:
    b = (h >> np.uint64(64 - p.bucket_bits)).astype(np.int64)
    return (bitmap[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1


class Buckets:
    """Counts by bucket, up to the threshold. They travel in slices: plain, or where fewer are filled as 16-bit places and then counts."""

    def __init__(self, p: Mining):
        self.p = p
        self.kind = np.dtype(np.uint8 if p.min_count < 256 else np.uint32)
        self.slice = 1 << min(p.slice_bits, p.bucket_bits)
        self.counts = np.zeros(1 << p.bucket_bits, self.kind)

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        b, at = np.unique((h >> np.uint64(64 - self.p.bucket_bits)).astype(np.int64), return_inverse=True)
        sums = np.bincount(at, weights=n, minlength=len(b)) + self.counts[b]
        self.counts[b] = np.minimum(sums, self.p.min_count).astype(self.kind)

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.counts), self.slice):
            part = self.counts[k : k + self.slice]
            at = np.flatnonzero(part)
            if len(at):
                few = len(at) * (2 + self.kind.itemsize) < part.nbytes
                raw = at.astype(np.uint16).tobytes() + part[at].tobytes() if few else part.tobytes()
                none = pa.nulls(1, pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([0], pa.int64()), pa.array([k // self.slice], pa.int32()), pa.array([raw], pa.binary())], names)

    def add_slice(self, k: int, raw: bytes) -> None:
        part, size = self.counts[k * self.slice : (k + 1) * self.slice], self.kind.itemsize
        if len(raw) == part.nbytes:
            at, more = slice(None), np.frombuffer(raw, self.kind)
        else:
            n = len(raw) // (2 + size)
            at, more = np.frombuffer(raw, np.uint16, n), np.frombuffer(raw[2 * n :], self.kind)
        part[at] = np.minimum(part[at].astype(np.int64) + more, self.p.min_count).astype(self.kind)


_ROWS = "lang string, phrase string, f bigint, slice int, counts binary"


def bitmap(rows: DataFrame, p: Mining) -> np.ndarray:
    """One bit a bucket, set where the sum over rows (slice, counts) reaches min_count: summed in Spark, 2^bits bits to the driver."""

    def run(batches):
        sums, seen = Buckets(p), set()
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums.add_slice(k, c.as_py())
                seen.add(k)
        of = sums.counts.reshape(-1, sums.slice)
        bits = [np.packbits(of[k] >= p.min_count).tobytes() for k in seen]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    out = np.zeros(1 << p.bucket_bits >> 3, np.uint8).reshape(-1, 1 << min(p.slice_bits, p.bucket_bits) >> 3)
    summed = arrow_map(rows.filter("slice is not null").select("slice", "counts").repartition("slice"), run, "slice int, bits binary")
    for k, bits in summed.collect():  # a row a slice, of fixed size
        out[k] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _hash_lang(names: list[str]) -> np.ndarray:
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8) if raw else np.zeros(0, np.uint8)
    return word_hashes(data, ends - np.array([len(x) for x in raw], np.int64), ends)


def counted(docs: DataFrame, n: int, frequent: dict[int, np.ndarray], buckets: np.ndarray | None, p: Mining) -> DataFrame:
    """Pass n: rows (lang, phrase, f) of n-grams, a chunk at a time, and rows (slice, counts) of the buckets of (n + 1)-grams. docs: lang, text."""
    columns = ["lang", "phrase", "f", "slice", "counts"]

    def run(batches):
        following = Buckets(p) if n < p.max_words else None
        for b in batches:
            data, offsets = utf8(b.column(1))
            coded = b.column(0).dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _hash_lang(names.to_pylist())
            for i, j, a, own, past in parts_of(data, offsets, p):
                cut = np.clip(offsets[i : j + 1], a, past) - a
                g = Grams(data[a:past], cut, code[i:j], hashes, own - a)
                for k in range(1, n):
                    g.test(_bits(frequent[k], g.hash, p))
                    g.lengthen()
                passes = np.ones(len(g.hash), bool) if buckets is None else _bits(buckets, g.hash, p)
                keep = np.flatnonzero(passes & (g.count > 0))
                if len(keep):
                    out = g.phrases(keep, names)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.binary())], columns)
                if following is not None:
                    if buckets is not None:
                        g.test(passes)
                    g.lengthen()
                    following.add(g.hash, g.count)
        if following is not None:
            yield from following.rows(columns)

    return arrow_map(docs, run, _ROWS)


def frequent_bitmap(phrases: DataFrame, n: int, p: Mining) -> np.ndarray:
    """Bitmap of the n-word phrases of a table (lang, phrase)."""

    def run(batches):
        out = Buckets(p)
        for b in batches:
            data, offsets = utf8(b.column(1))
            coded = b.column(0).dictionary_encode()
            code, hashes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _hash_lang(coded.dictionary.to_pylist())
            for i, j in chunks(offsets, p.chunk_bytes):
                # every row is a text of n words, which no break parts
                g = Grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], code[i:j], hashes, int(offsets[j] - offsets[i]))
                for _ in range(1, n):
                    g.lengthen()
                out.add(g.hash, np.full(len(g.hash), p.min_count))
        yield from out.rows(["lang", "phrase", "f", "slice", "counts"])

    return bitmap(arrow_map(phrases.select("lang", "phrase"), run, _ROWS), p)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", p: Mining = MINING) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1 to max_words words with f >= min_count, and (lang, n): all words."""
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, totals, buckets, frequent = [], None, None, {}
    for n in range(1, p.max_words + 1):
        rows = materialise(counted(d, n, dict(frequent), buckets, p), f"phrases-{n}")
        exact = rows.filter("phrase is not null")
        if n == 1:
            totals = materialise(exact.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-words")
        found.append(materialise(exact.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= p.min_count), f"phrases-{n}-frequent"))
        if n < p.max_words:
            frequent[n], buckets = frequent_bitmap(found[-1], n, p), bitmap(rows, p)
        discard(rows)
    return found, totals


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", p: Mining = MINING) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    found, totals = frequent_phrases(docs, text_col, lang_col, p)
    every = found[0]
    for t in found[1:]:
        every = every.unionByName(t)
    longer = None
    cuts = None
    for m, t in enumerate(found[1:], 2):
        w = t.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
        part = lambda i, k: F.array_join(F.slice("w", i, k), " ")
        ways = F.array(*[F.struct(F.lit(k).alias("k"), part(1, k).alias("head"), part(k + 1, m - k).alias("tail")) for k in range(1, m)])
        c = w.select("lang", "phrase", "a", F.inline(ways))
        cuts = c if cuts is None else cuts.unionByName(c)
        if m > 2:
            inner = F.array(*[part(i, k) for k in range(2, m) for i in range(1, m - k + 2)])
            c = w.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("cover"))
            longer = c if longer is None else longer.unionByName(c)
    side = lambda key, f: every.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    d = "cast({} as decimal(15,0))"  # products of at most 37 digits
    scored = scored.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * {d.format('a')} * {d.format('a')}) div ({d.format('l')} * {d.format('r')})"))
    # the lowest score, then the smallest k: one long orders both, as scores are at most 10^6 and k is small
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.col("score") * p.max_words + F.col("k")).alias("x"))
    if longer is not None:
        cover = longer.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
        best = best.join(cover, ["lang", "phrase"], "left").filter(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * p.cover_pct))
    best = best.select("lang", "phrase", "a", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
    out = best.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, w[i] || ' ' || w[i + 1] AS phrase, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
s AS (SELECT f2.lang, f2.phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = f2.lang AND y.phrase = w2
  UNION ALL SELECT f3.lang, f3.phrase, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.phrase, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.phrase = w3),
c AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM s),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(f) AS cover FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE m.cover IS NULL OR 100 * m.cover < 50 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000"""
