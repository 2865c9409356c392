"""Token-ID output: Parquet files of token lists in ascending id order, and selective reads of them.

File format, one row a document: doc_id, tokens (list of 32-bit ids, dictionary-encoded), n_tokens, shard, shard_start
(delta-encoded). shard is the number of the file's range of ids; shard_start counts the ids before the document within it,
so metadata and token columns are read apart, and page indexes with small row groups let a reader fetch a few documents.
Offsets over the whole output need only the sums of the shards, taken from the metadata columns.

The texts are range-partitioned by id (one shuffle of the texts, which are smaller than their ids), then encoded where they
land. Rows of one id are ranged by a hash of their text and equal rows by a seeded random number, so an id of very many rows
is dealt to many tasks. With the normaliser and split this module knows (`_KNOWN`), white space ends words and runs of letters and
of marks are split, so each different piece is encoded once a chunk and kept in a bounded table of the worker; the property test
compares with whole-text encoding. Other tokenizers encode whole texts.

Defined results: a null or empty text is just the end id. Rows are ordered by id (null first), then by a hash of the text, so repeated
rows are neighbours. An empty table gives an empty table. Columns other than the id and the text are not read. Texts longer than
`chunk_bytes` are cut at white space while they are encoded; without any, memory grows with the text.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, chunks, cut_long, mix64, scratch, table, utf8


@dataclass(frozen=True)
class TokenFormat:
    """Production parameters."""

    tokenizer: str = "word_bpe_49k.json"  #: name of a public tokenizer, or a path
    end_id: int = 2
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000
    known_words: int = 200_000  #: pieces kept in each of the two generations of a worker's table
    chunk_bytes: int = 2 << 20

    def options(self) -> dict[str, str]:
        plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "shard_start")}
        return plain | {
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",  # delta encoding for the columns without dictionary
            "parquet.enable.dictionary": "true",
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.page.write-checksum.enabled": "true",
        }


FORMAT = TokenFormat()


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes byte b as chr(b) if that is visible, else as the next letter from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return {b: chr(b) if b in visible else chr(next(rest)) for b in range(256)}


# The parts of a tokenizer file that `pieces` and `distinct_words` follow.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class PieceEncoder:
    """ids of pieces as little-endian bytes, one table a worker. A key that starts with a zero byte is a whole word, in raw form."""

    def __init__(self, path: str, keep: int):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.letters = Tokenizer.from_file(path), keep, _byte_letters()
        # the same model for pieces that are normal and apart already: many in one call, each ended by an id of an end of word
        bare = json.loads(self.tokenizer.to_str())
        end = bare["model"].get("end_of_word_suffix")
        self.by_pieces = bool(end) and (bare["normalizer"], bare["pre_tokenizer"]) == _KNOWN
        if not self.by_pieces:
            return
        vocabulary = bare["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith(end)]] = True
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, keys: list[bytes]) -> dict[bytes, bytes]:
        out = {k: np.array(self.tokenizer.encode(k[1:].decode(), add_special_tokens=False).ids, "<i4").tobytes() for k in keys if not k[0]}
        pieces = [k for k in keys if k[0]]
        if pieces:
            letters = b" ".join(pieces).decode("latin1").translate(self.letters).replace(self.letters[32], " ")
            ids = np.array(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<i4")
            last = np.flatnonzero(self.ends[ids]) + 1
            assert len(last) == len(pieces), "a piece isn't one word for this tokenizer"
            raw, cut = ids.tobytes(), [0, *(4 * last).tolist()]
            out.update(zip(pieces, map(raw.__getitem__, map(slice, cut[:-1], cut[1:])), strict=True))
        return out

    def encode(self, keys: list[bytes]) -> list[bytes]:
        """keys: all different."""
        coded = list(map(self.new.get, keys))
        gaps = [i for i, c in enumerate(coded) if c is None]
        if gaps:
            asked = [keys[i] for i in gaps]
            found = list(map(self.old.get, asked))
            fresh = self._learn([k for k, c in zip(asked, found, strict=True) if c is None])
            found = [fresh[k] if c is None else c for k, c in zip(asked, found, strict=True)]
            if len(self.new) + len(found) > self.keep:
                self.old, self.new = self.new, {}
            self.new.update(zip(asked, found, strict=True))
            for i, c in zip(gaps, found, strict=True):
                coded[i] = c
        return coded


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(name: str, keep: int) -> PieceEncoder:
    """The worker's encoder; tasks that follow in the same process find its table filled."""
    key = (name, keep)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders.clear()
        _encoders[key] = PieceEncoder(path, keep)
    return _encoders[key]


# Bytes by what the tokenizer's split does with them: white space, ASCII letters, ASCII marks that stand for themselves; all
# others (digits, apostrophes, angle brackets, controls, UTF-8 but for Latin-1 letters) leave their word to the tokenizer itself.
_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b'!#$%&*+,./:;=?@^_|~()[]{}\\-"')] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, start, end, raw word?) of the runs of letters and of marks, in lower case; words with other bytes whole and raw."""
    space = _SPACE[data]
    inside = np.concatenate((~space, [False]))
    edge = np.zeros(len(inside), bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    first, past = inside & (~before | edge), before & (~inside | edge)
    starts, ends = np.flatnonzero(first), np.flatnonzero(past)
    # U+00C0 to U+00FF but for two signs: C3 and a second byte
    lead = np.concatenate(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7), [False]))[: len(data)]
    second = np.concatenate(([False], lead[:-1]))[: len(data)]
    letter = _LETTER[data] | lead | second
    low = _LOWER[data]
    low[second & (data <= 0x9E)] += 32
    odd = np.concatenate(([0], np.cumsum(~(letter | _MARK[data] | space))))
    raw = odd[ends] > odd[starts]
    delta = np.zeros(len(data) + 1, np.int8)
    delta[starts[raw]] += 1
    delta[ends[raw]] -= 1
    raw = np.cumsum(delta, dtype=np.int8) > 0
    turn = np.zeros(len(inside), bool)
    turn[1 : len(data)] = (letter[1:] != letter[:-1]) & inside[1:-1] & before[1:-1] & ~edge[1:-1] & ~raw[1:-1]
    starts, ends = np.flatnonzero(first | turn), np.flatnonzero(past | turn)
    return np.where(raw[:-1], data, low), starts, ends, raw[starts]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(index of the first of each different word, number of its word for each): by a hash of 8 bytes at a time.

    Words that share a hash are compared by kind, length, first and last 8 bytes; None if any differ.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = 2 * (ends - starts) + kind
    low = np.concatenate(((np.uint64(1) << (8 * np.arange(8, dtype=np.uint64))) - np.uint64(1), [np.uint64(0xFFFFFFFFFFFFFFFF)]))
    n = ends - starts
    first = at[starts] & low[np.minimum(n, 8)]
    h = mix64(first + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero(n > 8), 8
    while len(more):
        h[more] = mix64(h[more] * np.uint64(0xC2B2AE3D27D4EB4F) + (at[starts[more] + k] & low[np.minimum(n[more] - k, 8)]))
        k += 8
        more = more[n[more] > k]
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    last = at[np.maximum(ends - 8, starts)] & low[np.minimum(n, 8)]
    rep = one[number]
    same = (lengths[rep] == lengths) & (first[rep] == first) & (last[rep] == last)
    return (one, number) if same.all() else None


def encode_texts(e: PieceEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, each with the end id, and how many each has. Python sees each different piece of the chunk once."""
    n = len(offsets) - 1
    if not e.by_pieces:
        raw, cuts = data.tobytes(), offsets.tolist()
        ids = [np.array([*x.ids, end_id], np.int32) for x in e.tokenizer.encode_batch([raw[i:j].decode() for i, j in itertools.pairwise(cuts)], add_special_tokens=False)]
        return np.concatenate(ids or [np.zeros(0, np.int32)]), np.array([len(x) for x in ids], np.int64)
    buf, starts, ends, raw = pieces(data, offsets)
    text = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
    found = distinct_words(buf, starts, ends, raw)
    one, number = found if found else np.unique([buf[x:y].tobytes() + bytes([r]) for x, y, r in zip(starts, ends, raw, strict=True)], return_index=True, return_inverse=True)[1:]
    b = buf.tobytes()
    coded = e.encode([b"\0" + b[x:y] if r else b[x:y] for x, y, r in zip(starts[one].tolist(), ends[one].tolist(), raw[one].tolist(), strict=True)])
    flat = np.frombuffer(b"".join(coded), "<i4")
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    place = np.cumsum(sizes) - sizes
    per = sizes[number]
    total = int(per.sum())
    came = np.cumsum(per) - per
    out = np.full(total + n, end_id, np.int32)
    step = np.arange(total)
    out[step + np.repeat(text, per)] = flat[step + np.repeat(place[number] - came, per)]
    return out, np.bincount(text, weights=per, minlength=n).astype(np.int64) + 1


def encode_chunk(e: PieceEncoder, data: np.ndarray, offsets: np.ndarray, p: TokenFormat) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts; a chunk that is one long text goes through it in parts, whose end ids but the last are dropped."""
    parts, _ = cut_long(data, offsets, p.chunk_bytes) if e.by_pieces else (offsets, None)
    if len(parts) == len(offsets):
        return encode_texts(e, data, offsets, p.end_id)
    assert len(offsets) == 2
    ids = [encode_texts(e, data[a:b], np.array([0, b - a]), p.end_id)[0][:-1] for a, b in itertools.pairwise(parts.tolist())]
    values = np.concatenate([*ids, np.array([p.end_id], np.int32)])
    return values, np.array([len(values)])


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: TokenFormat = FORMAT) -> DataFrame:
    """doc_id, tokens, n_tokens, shard_start, shard: in partitions of ascending ids."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({"h": F.xxhash64("text"), "r": F.rand(7)})
    d = d.repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches):
        before, e = 0, encoder(p.tokenizer, p.known_words)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets, p.chunk_bytes):
                values, n = encode_chunk(e, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), tokens, pa.array(n), pa.array(before + ends - n)], ["doc_id", "tokens", "n_tokens", "shard_start"])
                before += int(ends[-1])

    kind = dict(d.dtypes)["doc_id"]
    out = arrow_map(d, run, f"doc_id {kind}, tokens array<int>, n_tokens bigint, shard_start bigint")
    return out.withColumn("shard", F.spark_partition_id())


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", p: TokenFormat = FORMAT) -> None:
    token_rows(docs, id_col, text_col, p).write.options(**p.options()).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, shard_start, n_tokens, start: from the metadata columns alone."""
    meta = spark.read.parquet(path).select("doc_id", "shard", "shard_start", "n_tokens")
    return _with_start(meta, spark, path)


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    sums = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = sums.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("bigint")).alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, tokens; with ids, only the row groups and pages that hold them are read."""
    rows = spark.read.parquet(path).select("doc_id", "tokens")
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
            crc = np.fromiter((zlib.crc32(ids[4 * i : 4 * j]) for i, j in itertools.pairwise(ends.tolist())), np.int64, len(ends) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", "shard", "shard_start", "tokens")
    kind = dict(rows.dtypes)["doc_id"]
    rows = arrow_map(rows, run, f"doc_id {kind}, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: TokenFormat = FORMAT) -> DataFrame:
    """Write the token files to the shared folder and return their digests."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, id_col, text_col, p)
    return digests(spark, path)


def op6(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
