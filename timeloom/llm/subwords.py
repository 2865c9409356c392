"""Hashed subwords of whole Arrow batches, in numpy: no Python code per row, word or character.

A text is its lower-cased UTF-8 bytes with every ASCII byte that isn't a letter read as a space. Its subwords are the
byte n-grams without a space inside (a space at either end marks the edge of a word) and, if asked for, whole words.
"""

from __future__ import annotations

import numpy as np

from timeloom.llm.common import chunks, cut_long, mix64, powers

_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once, whatever the length of a text.
PART = 1 << 19


def subwords(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int, words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of every subword; positions ascend within each n-gram size only. buckets: a power of two."""
    # one space before each text, so that n-grams never cross texts
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded[place] = _MAP[data]
    space = padded == 32
    spaces = np.concatenate(([0], np.cumsum(space)))
    out_b, out_p = [], []
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    value = padded.astype(np.uint64) + np.uint64(1)
    h, at = np.zeros(len(padded), np.uint64), 0
    for size in sorted(sizes):
        while at < size:
            m = len(padded) - at
            h = h[:m] * np.uint64(_BASE) + value[at:]
            at += 1
        m = len(h)
        inner = spaces[size - 1 : size - 1 + m] - spaces[1 : 1 + m] if size > 2 else np.zeros(m, np.int64)
        ok = np.flatnonzero((inner == 0) & ~(space[:m] & space[size - 1 : size - 1 + m]))
        out_b.append((mix64(h[ok] + np.uint64(size)) >> shift).astype(np.int64))
        out_p.append(ok)
    if words:
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            lengths = end - start
            first = np.cumsum(lengths) - lengths
            inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            x = value[inside + np.repeat(start, lengths)] * powers(_BASE, int(lengths.max()))[inside]
            out_b.append((mix64(np.add.reduceat(x, first) + np.uint64(77)) >> shift).astype(np.int64))
            out_p.append(start)
    return np.concatenate(out_b), np.concatenate(out_p)


def text_starts(offsets: np.ndarray) -> np.ndarray:
    """Position, in subwords' count, at which each text begins, and the end."""
    return offsets + np.arange(len(offsets))


def bags(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int, words: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text; for training samples."""
    b, p = subwords(data, offsets, sizes, buckets, words)
    text = np.searchsorted(text_starts(offsets), p, side="right") - 1
    order = np.argsort(text, kind="stable")
    b, cuts = b[order], np.searchsorted(text[order], np.arange(len(offsets)))
    out = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        u, c = np.unique(b[i:j], return_counts=True)
        out.append((u, (c / max(j - i, 1)).astype(np.float32)))
    return out


def averages(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean row of table (buckets x k) over the subwords of each text, and how many there are. Texts over `PART` bytes are summed in parts, which no subword crosses."""
    parts, owner = cut_long(data, offsets, PART)
    n, sums = np.zeros(len(offsets) - 1, np.int64), np.zeros((len(offsets) - 1, table.shape[1]))
    for i, j in chunks(parts, PART):
        b, p = subwords(data[parts[i] : parts[j]], parts[i : j + 1] - parts[i], sizes, len(table), words)
        text = owner[i + np.searchsorted(text_starts(parts[i : j + 1] - parts[i]), p, side="right") - 1]
        n += np.bincount(text, minlength=len(n))
        sums += np.stack([np.bincount(text, weights=table[:, k][b], minlength=len(n)) for k in range(table.shape[1])], 1)
    return sums / np.maximum(n, 1)[:, None], n


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int, dim: int, epochs: int, rate: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax learned jointly by stochastic gradient descent; returns (buckets x classes) table and bias.

    Steps are scaled by the root of the squared gradients each bucket has had (one number a bucket), so that rare subwords
    learn as fast as frequent ones. As both maps are linear, only their product is needed to score.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 1 / dim**0.5, (dim, classes)).astype(np.float32)
    seen = np.zeros(buckets, np.float32)
    seen_out = np.float32(1e-3)
    bias = np.zeros(classes, np.float32)
    total, step = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            lr = np.float32(rate * (1 - step / total))
            step += 1
            u, w = samples[i]
            if not len(u):
                continue
            rows = emb[u]
            h = w @ rows
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels[i]] -= 1
            back = out @ g
            size = float(back @ back) / dim
            seen[u] += w * w * size
            emb[u] = rows - (lr * w / np.sqrt(seen[u] + 1e-12))[:, None] * back[None, :]
            grad = np.outer(h, g)
            seen_out += (grad * grad).mean()
            out -= 0.1 * lr * grad / np.sqrt(seen_out)
            bias -= 0.1 * lr * g
    return emb @ out, bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
