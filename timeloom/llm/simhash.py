"""SimHash near-duplicates by bit-sliced comparison.

fingerprint -> distinct fingerprints -> cells -> links -> connected components:

1. One Arrow pass gives each text the 64-bit fingerprint of its 4-word shingles (XXH64, seed 42, majority of the bits).
2. Equal fingerprints are aggregated first, so a group of copies of any size is one row from here on.
3. The 64 bits are cut into m blocks. Two fingerprints within `radius` bits agree on at least m - radius whole blocks, so
   every link lies in a cell of fingerprints equal on some choice of m - radius blocks. m is chosen so that a cell holds
   few fingerprints; every m is exact. A cell with more than `max_cell_rows` is cut by the same rule over the bits its members
   need not share (`refine` more blocks than the radius), which thins it unless they truly are alike; a cell that stays
   too large is cut into parts, and each pair of parts is compared by another task: no row is dropped.
4. A cell is compared bit-sliced: plane t holds bit t of 64 fingerprints in a word; XOR with the query's bit gives 64
   mismatch bits at once, added into carry-save counters; words in which all distances exceed the radius are abandoned.
   A cell returns a spanning forest of its links (fewer rows than members), never its pairs.
5. Components come from alternating large-star and small-star steps on those edges, each written to the shared folder. Stars and
   components of very many members, and fingerprints of very many copies, are joined by broadcast of at most a bounded number of
   them, so none is gathered in a task.

Defined results: a null or empty text, or one without words, has fingerprint 0 and is linked like any other. component_id
is the smallest non-null id reachable (null if no row of the component has one). Repeated rows appear as often as
in the input; an empty table gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, discard, materialise, skewed_join, table, utf8

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHash:
    """Production parameters."""

    shingle: int = 4
    seed: int = 42
    radius: int = 4
    cell_target: int = 2048  #: m grows until a cell has about so many fingerprints on average
    max_blocks: int = 8
    min_cell_rows: int = 256  #: a cell is never cut into parts smaller than this
    max_cell_rows: int = 8192  #: ... nor kept whole beyond this
    refine: int = 2  #: a cell too large is cut by so many more blocks of its other bits than the radius


PARAMS = SimHash()
#: Which bits each value of a byte sets, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, p: SimHash = PARAMS) -> int:
    """Fingerprint of one UTF-8 text; bytes.lower() and bytes.split() know ASCII only, as the contract's words do."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(p.shingle, len(words))
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], space + 1))
    ends = np.concatenate((space, [len(joined)]))
    n = len(words) - k + 1
    cut = map(slice, starts[:n].tolist(), ends[k - 1 :].tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(p.seed)), np.uint64, n)
    lanes = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: SimHash = PARAMS) -> DataFrame:
    """doc_id, fp: one row for each row of docs; fp holds the 64 bits as a signed long."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            raw, o = data.tobytes(), offsets.tolist()
            fp = np.fromiter((fingerprint(raw[i:j], p) for i, j in itertools.pairwise(o)), np.uint64, len(o) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = dict(d.dtypes)["doc_id"]
    return arrow_map(d, run, f"doc_id {kind}, fp bigint")


class Forest:
    """Union-find on 0..n-1 whose labels are the smallest members, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        apart = la != lb
        if not apart.any():
            return
        pairs = np.unique(np.stack((np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]), 1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for x, y in pairs.tolist():
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        jump = np.arange(len(self.label))
        for x in list(parent):
            jump[x] = find(x)
        self.label = jump[self.label]


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane t is bit t of fingerprint 64 * w + i."""
    n = -(-len(fp) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fp)] = fp
    return np.stack([np.packbits(((padded >> np.uint64(t)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for t in range(64)])


def link_cells(fp: np.ndarray, ends: np.ndarray, radius: int, at_once: int = 1 << 18) -> np.ndarray:
    """Label (smallest linked index) of each fingerprint; i is compared with i+1 .. ends[i]-1, the rest of its cell.

    Up to `at_once` (query, word) entries are worked on at a time, each the distances of a query to 64 fingerprints.
    """
    forest = Forest(len(fp))
    planes = bit_planes(fp)
    first, last = (np.arange(len(fp)) + 1) // 64, (ends - 1) // 64
    counts = np.where(ends > np.arange(len(fp)) + 1, last - first + 1, 0)
    total = np.concatenate(([0], np.cumsum(counts)))
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once, side="right")) - 1)
        n = counts[lo:hi]
        q = np.repeat(np.arange(lo, hi), n)
        w = first[q] + np.arange(len(q)) - np.repeat(total[lo:hi] - total[lo], n)
        lo = hi
        if not len(q):
            continue
        # dead: positions outside the cell, at or before the query, or too far already
        below, above = np.clip(q + 1 - 64 * w, 0, 64), np.clip(ends[q] - 64 * w, 0, 64)
        low = lambda k: np.where(k >= 64, ONES, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        dead = low(below) | ~low(above)
        c0, c1, c2 = (np.zeros(len(q), np.uint64) for _ in range(3))
        mine = fp[q]
        for t in range(0, 64, 2):
            xa, xb = (planes[t + k][w] ^ (np.uint64(0) - ((mine >> np.uint64(t + k)) & np.uint64(1))) for k in (0, 1))
            half = c0 ^ xa
            carry = (c0 & xa) | (half & xb)
            c0 = half ^ xb
            up = c1 & carry
            c1 ^= carry
            dead |= c2 & up
            c2 ^= up
            if t % 8 == 6:
                dead |= _over(c0, c1, c2, radius)
                alive = dead != ONES
                if not alive.all():
                    q, w, dead, c0, c1, c2, mine = (x[alive] for x in (q, w, dead, c0, c1, c2, mine))
                    if not len(q):
                        break
        if len(q):
            linked = ~(dead | _over(c0, c1, c2, radius))
            some = linked != 0
            q, w, linked = q[some], w[some], linked[some]
            for k in range(0, len(q), 1 << 14):
                row, bit = np.nonzero(np.unpackbits(linked[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                forest.add(q[k : k + (1 << 14)][row], 64 * w[k : k + (1 << 14)][row] + bit)
    return forest.label


def _over(c0, c1, c2, radius: int) -> np.ndarray:
    """Mask of the positions whose counter c2 c1 c0 is over radius (0 to 6)."""
    out = np.zeros(len(c0), np.uint64)
    for v in range(radius + 1, 8):
        out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return out


def block_masks(n: int, p: SimHash) -> list[int]:
    """One mask for each choice of blocks; two fingerprints within the radius are equal under one of them at least."""
    m = p.radius + 1
    while m < p.max_blocks and n / 2 ** (64 * (m - p.radius) // m) > p.cell_target:
        m += 1
    return _blocks(list(range(64)), m, p.radius)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], m: int, radius: int) -> list[int]:
    """One mask for each choice of m - radius of the m blocks that the bits (numbers, ascending) are cut into."""
    cuts = [len(bits) * k // m for k in range(m + 1)]
    blocks = [sum(1 << x for x in bits[a:b]) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, m - radius)]


def _cells(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """fp, m, key for each mask of the row's group (column g: number of the mask that made its cell)."""
    one = lambda g, k, x: F.struct((F.lit(1000 * g + k)).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("key"))
    of = F.array(*[F.array(*[one(g, k, x) for k, x in enumerate(own)]) for g, own in enumerate(masks)])
    return rows.select("fp", F.explode(F.get(of, F.col("g"))).alias("c")).select("fp", "c.m", "c.key")


def _heavy(rows: DataFrame, most: int) -> DataFrame:
    """m, key, k: the cells with more than `most` rows, and how many parts they make."""
    return materialise(rows.groupBy("m", "key").count().filter(F.col("count") > most).select("m", "key", F.ceil(F.col("count") / most).cast("int").alias("k")), "simhash-heavy")


def _parts(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows with k, 1 outside heavy cells; the heaviest cells, at most 4096, are joined by broadcast, so none is gathered in a task."""
    total = heavy.agg(F.sum("k")).first()[0] or 0
    big = F.broadcast(heavy.filter(F.col("k") * 4096 > total))
    rest = rows.join(big.select("m", "key"), ["m", "key"], "left_anti").join(heavy, ["m", "key"], "left")
    return rows.join(big, ["m", "key"]).unionByName(rest).withColumn("k", F.coalesce("k", F.lit(1)))


def edges(fps: DataFrame, n: int, p: SimHash = PARAMS) -> DataFrame:
    """a, b (a > b): a spanning forest of the links in every cell. fps: n distinct values of column fp."""
    spark = fps.sparkSession
    masks = block_masks(n, p)
    rows = _cells(fps.select("fp", F.lit(0).alias("g")), [masks])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(p.max_cell_rows, max(p.min_cell_rows, n * len(masks) // parts))
    heavy = _heavy(rows, most)
    plain = lambda d: d.select("m", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    if heavy.isEmpty():
        cells = plain(rows)
    else:
        # links in a heavy cell lie in cells of its other bits: the group is the mask, so cells of different masks keep apart
        rows = _parts(rows, heavy)
        cells = plain(rows.filter("k = 1"))
        inner = [_blocks([t for t in range(64) if not x >> t & 1], p.radius + p.refine, p.radius) for x in masks]
        deep = _cells(rows.filter("k > 1").select("fp", F.col("m").alias("g")), [[x | y for y in own] for x, own in zip(masks, inner, strict=True)])
        deep = deep.select("fp", (F.col("m") + 1000).alias("m"), "key")
        deep = _parts(deep, _heavy(deep, most)).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k").cast("bigint")).cast("int"))
        deep = deep.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        cells = cells.unionByName(deep.select("m", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp"))
    cells = cells.repartition("m", "key", "x", "y").sortWithinPartitions("m", "key", "x", "y", "fp")

    def compare(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        cell = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(4)])
        fp = t.column(4).to_numpy().view(np.uint64)
        starts = np.concatenate(([0], 1 + np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)), [len(fp)]))
        label = link_cells(fp, np.repeat(starts[1:], np.diff(starts)), p.radius)
        far = np.flatnonzero(label != np.arange(len(fp)))
        a, b = fp[far].view(np.int64), fp[label[far]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the cell that may go on in the next batch, and whole cells before it
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(4)])
            same = (cell == cell[:, -1:]).all(axis=0)
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and not cut and all(held[-1].column(k)[-1] == b.column(k)[0] for k in range(4)):
                held.append(b)
                continue
            if held or cut:
                yield compare([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        if held:
            yield compare(held)

    return arrow_map(cells, run, "a bigint, b bigint").distinct()


def _stars(e: DataFrame, least: DataFrame) -> DataFrame:
    """e (a, b) with the least neighbour m of a. least: a, m, n (rows of a in e); stars with very many rows are joined by broadcast."""
    total = least.agg(F.sum("n")).first()[0] or 0
    big = F.broadcast(least.filter((F.col("n") > 1000) & (F.col("n") * 4096 > total)).select("a", "m"))  # at most 4096
    return e.join(big, "a").unionByName(e.join(big, "a", "left_anti").join(least.select("a", "m"), "a"))


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root: the smallest node of each component, for every node of links (a, b) that isn't a root itself.

    Alternating large-star and small-star steps; each round is four aggregations of at most as many rows as there are links. The
    tables of a round are deleted when the next one is written.
    """
    e = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), name)
        large = materialise(_stars(both, near).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), name)
        far = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        # the star's centre itself (a, m) comes from the aggregate, once a node
        moved = _stars(large, far).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, materialise(moved.unionByName(far.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(last, near, large, far)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: SimHash = PARAMS) -> DataFrame:
    """doc_id, fp (signed long), component_id: one row for each row of docs."""
    each = materialise(fingerprints(docs, id_col, text_col, p), "simhash-fp")
    nodes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = components(edges(nodes.select("fp"), nodes.count(), p))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    labelled = materialise(labelled, "simhash-labels")
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    whole = materialise(skewed_join(labelled, least, "root").select("fp", "component_id"), "simhash-components")
    discard(nodes, labelled)
    return skewed_join(each, whole, "fp").select("doc_id", "fp", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
