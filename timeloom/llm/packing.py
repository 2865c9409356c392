"""Packing of documents into sequences by order-preserving dynamic programming.

The tokens of the documents, in their order, are a stream that is cut into windows of at most `capacity` tokens, one a sequence. A cut is free
between documents, costs `sentence` after a sentence and `inside` elsewhere; a window costs its padding and `window`. Padding is what a window
lacks of the capacity, nothing for a power of two. The cheapest cuts come from one pass over the possible cuts: the best window ending at a cut
starts at the smallest (cost + position) of the cuts in reach, which a monotone queue holds at its head, or a power of two before. Cuts inside
sentences are offered a full window after a cut where the last sentence in reach leaves much padding, and throughout what has no sentence end.

Blocks of whole documents (`block_bytes`) are packed apart, where the documents lie: one pass, no shuffle, and a task's memory is that of a block. A
sequence never leaves its block, so a lost executor costs its tasks alone. Sequences are numbered by task and within it.

Tokens are those of whole texts. With the split this module knows (byte-level pieces with a space in front), a text falls apart between runs of
white space and others, so each different unit of a block is encoded once and kept in a bounded table of the worker; texts with the end mark of the
vocabulary or with other white space at the edge of a word, and all texts of other tokenizers, are encoded whole.

Defined results: a null or empty text is its end id alone; each row is a document of its own, whatever its id; rows stay in the order they are
read in. An empty table gives an empty table. Columns other than id and text are not read. A text over the block's size is a block of its own: its
memory grows with its ids (8 bytes each), and it is encoded in parts that end before white space.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import _WS as SPACE
from timeloom.llm.common import arrow_map, chunks, table, utf8
from timeloom.llm.token_output import distinct_words


@dataclass(frozen=True)
class Pack:
    """Production parameters; costs are in tokens of padding."""

    tokenizer: str = "byte_bpe_50k.json"  #: name of a public tokenizer, or a path
    end_id: int = 0
    capacity: int = 1024
    sentence: int = 1
    inside: int = 3
    window: int = 2
    block_bytes: int = 4 << 20
    known: int = 200_000  #: units kept in each of the two generations of a worker's table
    known_bytes: int = 64  #: longer units aren't kept


PACK = Pack()

# The parts of a tokenizer file that `units` follows.
_KNOWN = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_ODD, _LETTER, _DIGIT, _MARK, _GAP = range(5)
#: Kinds of bytes: what follows an apostrophe may be one piece with it, and other alphabets aren't told apart here.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[SPACE] = _GAP
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[ord("'")] = _ODD
#: White space beyond ASCII, in UTF-8.
_OTHER_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))]


class UnitEncoder:
    """ids of units as little-endian bytes, in a table of two generations a worker."""

    def __init__(self, path: str, p: Pack):
        from tokenizers import Tokenizer

        self.tokenizer, self.p = Tokenizer.from_file(path), p
        spec = json.loads(self.tokenizer.to_str())
        self.by_units = (spec["normalizer"], spec["pre_tokenizer"]) == _KNOWN
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        #: A mark that stands apart from whatever is beside it.
        apart = [t for t in spec["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.between = (apart[0]["content"].encode(), apart[0]["id"]) if self.by_units and apart else None
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("i", x.ids).tobytes() for x in coded]

    def joined(self, texts: list[bytes]) -> list[bytes]:
        """`whole` of short texts, many in one call with a mark between each two."""
        if self.between is None:
            return self.whole(texts)
        mark, number = self.between
        out = []
        for i in range(0, len(texts), 256):
            few = texts[i : i + 256]
            line = mark.join(few)
            own = sum(line.count(m) for m in self.marks) - (len(few) - 1)
            ids = np.array(self.tokenizer.encode_batch_fast([line.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<i4") if not own else None
            at = (4 * np.flatnonzero(ids == number)).tolist() if not own else []
            if own or len(at) != len(few) - 1:
                out += self.whole(few)  # texts with marks of their own
            else:
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *[x + 4 for x in at]], [*at, len(raw)], strict=True)]
        return out

    def encode(self, keys: list[bytes]) -> list[bytes]:
        """keys: all different."""
        coded = list(map(self.new.get, keys))
        gaps = [i for i, c in enumerate(coded) if c is None]
        if gaps:
            asked = [keys[i] for i in gaps]
            found = list(map(self.old.get, asked))
            fresh = iter(self.joined([k for k, c in zip(asked, found, strict=True) if c is None]))
            found = [next(fresh) if c is None else c for c in found]
            if len(self.new) + len(found) > self.p.known:
                self.old, self.new = self.new, {}
            for i, c in zip(gaps, found, strict=True):
                coded[i] = c
            most = self.p.known_bytes
            self.new.update([x for x in zip(asked, found, strict=True) if len(x[0]) <= most])
        return coded


_encoders: dict[Pack, UnitEncoder] = {}


def encoder(p: Pack) -> UnitEncoder:
    """The worker's encoder; tasks that follow in the same process find its table filled."""
    if p not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = p.tokenizer
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        _encoders.clear()
        _encoders[p] = UnitEncoder(path, p)
    return _encoders[p]


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units that tile the texts: runs of letters, digits or marks (or whole words) with the one space before them, other white space."""
    if not len(data):
        return np.zeros(0, np.int64)
    n = len(data)
    space, edge = SPACE[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    flag = edge.copy()
    starts = np.flatnonzero(~space[1:] & space[:-1] & ~edge[1:n]) + 1
    ends = np.flatnonzero((space[1:] | edge[1:n]) & ~space[:-1]) + 1
    flag[ends] = True
    flag[starts - 1] = True
    flag[starts[data[starts - 1] != 32]] = True  # other white space isn't part of the word after it
    # in words of letters, digits and marks alone every change of kind begins a piece
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    turn = np.flatnonzero((kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1] & ~edge[1:n]) + 1
    word = np.searchsorted(ends, turn, side="right")
    unknown = np.zeros(len(ends) + 1, bool)
    unknown[np.searchsorted(ends, np.flatnonzero(kind == _ODD), side="right")] = True
    flag[turn[~unknown[word]]] = True
    return np.flatnonzero(flag[:n])


def _odd(e: UnitEncoder, data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Texts that must be encoded whole."""
    found = []
    for mark in e.marks:
        at = data.find(mark)
        while at >= 0:
            found.append(at)
            at = data.find(mark, at + 1)
    there = {c for c in {o[0] for o in _OTHER_SPACE} if data.find(c) >= 0}
    for c in _OTHER_SPACE:
        at = data.find(c) if c[0] in there else -1
        while at >= 0:
            after = at + len(c)
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            if at in (0, offsets[text]) or SPACE[data[at - 1]] or after in (len(data), offsets[text + 1]) or SPACE[data[after]] or any(data.startswith(o, after) for o in _OTHER_SPACE):
                found.append(at)
                after = int(offsets[text + 1])  # the rest of the text needn't be looked at
            at = data.find(c, after)
    return np.unique(np.searchsorted(offsets, np.array(found, np.int64), side="right") - 1)


def _sentence_ends(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Units after which a sentence is over: a full stop, question or exclamation mark, perhaps closed by quotes or brackets, or a line feed."""
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, starts)]
    stop = np.isin(last, np.frombuffer(b".!?\n", np.uint8))
    closed = np.isin(last, np.frombuffer(b"\"')]", np.uint8)) & np.isin(before, np.frombuffer(b".!?", np.uint8))
    return stop | closed


def encode_block(e: UnitEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts, each with the end id; where each text ends in them; where sentences end."""
    n, raw = len(offsets) - 1, data.tobytes()
    starts = units(data, offsets) if e.by_units else np.zeros(0, np.int64)
    whole = _odd(e, raw, offsets) if e.by_units else np.arange(n)
    if len(whole):
        # such a text is one unit
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, offsets[whole], 1)
        np.add.at(inside, offsets[whole + 1], -1)
        starts = starts[np.cumsum(inside)[starts] == 0]
        starts = np.unique(np.concatenate((starts, offsets[whole][offsets[whole] < offsets[whole + 1]])))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    text = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
    found = distinct_words(data, starts, ends, np.zeros(len(starts), np.int64)) if len(starts) else (starts, starts)
    if found is None:
        one, number = np.unique(np.array([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], object), return_index=True, return_inverse=True)[1:]
    else:
        one, number = found
    coded = e.encode([raw[x:y] for x, y in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
    flat = np.frombuffer(b"".join(coded), "<i4")
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    place = np.cumsum(sizes) - sizes
    per = sizes[number]
    came = np.cumsum(per) - per
    step = np.arange(int(per.sum()))
    ids = np.full(len(step) + n, end_id, np.int32)
    ids[step + np.repeat(text, per)] = flat[step + np.repeat(place[number] - came, per)]
    docs = np.cumsum(np.bincount(text, weights=per, minlength=n).astype(np.int64) + 1)
    stops = (came + per + text)[_sentence_ends(data, ends, starts)] if len(starts) else starts
    return ids, docs, stops


def encode_long(e: UnitEncoder, data: np.ndarray, p: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """encode_block of one text in parts that end before white space after an ASCII character, so no piece crosses."""
    cut = np.flatnonzero(SPACE[data[1:]] & ~SPACE[data[:-1]] & (data[:-1] < 128)) + 1 if e.by_units else np.zeros(0, np.int64)
    bounds = [0]
    while len(data) - bounds[-1] > p.block_bytes:
        k = int(np.searchsorted(cut, bounds[-1] + p.block_bytes))
        if k == len(cut):
            break
        bounds.append(int(cut[k]))
    bounds.append(len(data))
    raw = data.tobytes()
    if len(bounds) > 2 and len(_odd(e, raw, np.array([0, len(data)]))):
        bounds = [0, len(data)]
    ids, stops, before = [], [], 0
    for a, b in itertools.pairwise(bounds):
        i, _, s = encode_block(e, data[a:b], np.array([0, b - a]), p.end_id)
        ids.append(i[:-1])
        stops.append(s + before)
        before += len(i) - 1
    ids = np.concatenate([*ids, np.array([p.end_id], np.int32)])
    return ids, np.array([len(ids)]), np.concatenate(stops)


def offered(docs: np.ndarray, stops: np.ndarray, p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """Positions where windows may be cut, 0 and the end among them, and what a cut there costs."""
    total = int(docs[-1])
    mark = np.zeros(total + 1, bool)
    mark[0] = mark[docs] = mark[stops] = True
    ends = np.flatnonzero(mark)
    gap = np.diff(ends)
    wide = np.flatnonzero(gap > p.capacity)
    more = (gap[wide] - 1) // p.capacity
    nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    chain = np.repeat(ends[wide], more) + p.capacity * nth
    full = ends[:-1] + p.capacity
    reach = ends[np.searchsorted(ends, full, side="right") - 1]
    full = full[(full < total) & (full - reach > p.inside - p.sentence)]
    price = np.full(total + 1, p.inside, np.int8 if max(p.inside, p.sentence) < 128 else np.int64)
    price[ends], price[docs], price[0] = p.sentence, 0, 0
    mark[chain] = mark[full] = True
    at = np.flatnonzero(mark)
    return at, price[at].astype(np.int64)


def best_cuts(at: np.ndarray, cost: np.ndarray, p: Pack) -> list[int]:
    """The cheapest cuts, first and last position among them."""
    m, capacity = len(at), p.capacity
    powers = [1 << k for k in range(p.capacity.bit_length()) if 1 << k <= p.capacity]
    near, number = [], np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(m)
    for size in powers:
        first = int(np.searchsorted(at, size))
        i = number[at[first:] - size]
        hit = np.flatnonzero(i >= 0)
        near.append(np.stack((hit + first, i[hit])))
    near = np.concatenate(near, 1)
    near = near[:, np.argsort(near[0], kind="stable")]
    later, before = [*near[0].tolist(), m], near[1].tolist()
    pos, price = at.tolist(), (cost + p.window).tolist()
    never = 1 << 60
    total, back = [0] + [never] * (m - 1), [0] * m
    # the queue: places, keys (cost + position) and positions of the cuts that may still be the best start, keys ascending
    queue, keys, places = [0] * m, [0] * m, [0] * m
    head, tail, k, key = 0, 0, 0, 0
    for j in range(1, m):
        if key < never:
            while tail > head and keys[tail - 1] >= key:
                tail -= 1
            queue[tail], keys[tail], places[tail] = j - 1, key, pos[j - 1]
            tail += 1
        here = pos[j]
        reach = here - capacity
        while head < tail and places[head] < reach:
            head += 1
        if head < tail:
            best, start = keys[head] - reach, queue[head]
        else:
            best, start = never, 0
        while later[k] == j:
            if total[before[k]] < best:
                start = before[k]
                best = total[start]
            k += 1
        key = never
        if best < never:
            total[j], back[j] = best + price[j], start
            key = total[j] + here
    cuts, j = [], m - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return [0, *reversed(cuts)]


#: Columns of `pack` beside the document's id.
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, p: Pack = PACK) -> DataFrame:
    """A row a piece of a document: its place in the document and in its sequence, its digest and (with_ids) its token ids."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches):
        e, number = encoder(p), TaskContext.get().partitionId() << 40
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets, p.block_bytes):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, ends, stops = encode_long(e, part, p) if j == i + 1 else encode_block(e, part, cuts, p.end_id)
                windows = np.array(best_cuts(*offered(ends, stops, p), p))
                edges = np.union1d(windows, np.concatenate(([0], ends)))
                first, past = edges[:-1], edges[1:]
                doc = np.searchsorted(ends, first, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                window = np.searchsorted(windows, first, side="right") - 1
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), past.tolist(), strict=True)]
                columns = [first - begin[doc], past - first, np.array(crc, np.int64), (ends - begin)[doc], number + window, first - windows[window]]
                arrays = [pc.take(b.column(0).slice(i, j - i), pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(arrays, names)
                number += len(windows) - 1

    kind = dict(d.dtypes)["doc_id"]
    return arrow_map(d, run, f"doc_id {kind}, {PIECE}{', ids array<int>' * with_ids}")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (of `pack`'s pieces in order), and the lengths of the pieces, for masks that keep documents apart."""
    s = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most `capacity` tokens
    return s.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p.ids", lambda x: F.size(x)).alias("lengths"))


def op12(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
