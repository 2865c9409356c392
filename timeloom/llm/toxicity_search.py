"""Chooses the settings of the toxicity model from training rows alone: python -m timeloom.llm.toxicity_search SF_DIR [processes [rounds]].

Rows whose crc32(doc_id as text) mod 5 is 0 are held out for good: they are dropped by id before any text or label of theirs is used.
The other remainders are four folds; each setting learns from three and is judged on the fourth, on whole texts of any length that
equal no text it learned from. The rule, fixed before the search: of the settings that flag at most `MOST` of the clean texts, the one
with the highest recall, both pooled over the folds; within `TIE` of it, the one with the fewest n-gram bytes, then the longest segment.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from timeloom.llm.common import utf8
from timeloom.llm.toxicity import PARAMS, Model, Toxicity, calibrate, learn, worst

#: Two rounds; the second looks closer where the first ended: at the shortest segments.
ROUNDS = (
    {"sizes": ((3, 4), (3, 4, 5), (3, 4, 5, 6), (3, 4, 5, 6, 7), (4, 5, 6)), "segment": (12, 16, 24, 32, 48), "min_docs": (5,), "refine": (4,)},
    {"sizes": ((2, 3, 4), (3, 4), (3, 4, 5, 6), (3, 4, 5, 6, 7)), "segment": (8, 12), "min_docs": (3, 5), "refine": (4, 8)},
)
FLAGGED = (0.001, 0.002, 0.003, 0.004, 0.006, 0.008)
MOST, TIE = 0.005, 0.01


def training_rows(sf_dir: str) -> list[tuple[int, str, int]]:
    """(fold, text, label) of the labelled rows that aren't held out."""
    labels = {i: t for i, t in zip(*pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values(), strict=True) if t is not None and i is not None}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in labels}
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"], filters=[("doc_id", "in", [i for i in labels if fold[i]])])
    return [(fold[i], t, labels[i]) for i, t in zip(*docs.to_pydict().values(), strict=True) if t]


def judge(rows: list[tuple[int, str, int]], fold: int, p: Toxicity) -> list[tuple[float, int, int, int, int]]:
    """(flagged setting, toxic texts, found, clean texts, flagged) of one fold."""
    fits = [(t, y) for f, t, y in rows if f != fold and len(t.encode()) <= p.max_bytes]
    texts = list(dict(fits))
    found = learn(texts, np.array([dict(fits)[t] for t in texts]), p)
    rest = [(t, y) for f, t, y in rows if f == fold and t not in set(texts)]
    y = np.array([y for _, y in rest])
    weight, bias, z, known, empty = found
    data, offsets = utf8(pa.array([t for t, _ in rest]))
    z_rest = worst(weight, bias, data, offsets, p)
    out = []
    for share in FLAGGED:
        hit = Model(weight, bias, *calibrate(z, known, share), empty).score(z_rest) >= 0.5
        out.append((share, int((y == 1).sum()), int(hit[y == 1].sum()), int((y == 0).sum()), int(hit[y == 0].sum())))
    return out


def choose(table: list[tuple[Toxicity, float, float]]) -> tuple[Toxicity, float, float]:
    """table: settings, recall, share of clean texts flagged."""
    fair = [x for x in table if x[2] <= MOST] or [min(table, key=lambda x: x[2])]
    top = max(x[1] for x in fair)
    return min((x for x in fair if x[1] >= top - TIE), key=lambda x: (sum(x[0].sizes), -x[0].segment, -x[1]))


def main(sf_dir: str, processes: int = 6, *rounds: int) -> None:
    rows = training_rows(sf_dir)
    settings = [dataclasses.replace(PARAMS, **dict(zip(g, v, strict=True))) for k in rounds or range(len(ROUNDS)) for g in (ROUNDS[k],) for v in itertools.product(*g.values())]
    settings = list(dict.fromkeys(settings))
    jobs = [(p, f) for p in settings for f in (1, 2, 3, 4)]
    with ProcessPoolExecutor(processes) as pool:
        done = list(pool.map(judge, itertools.repeat(rows), [f for _, f in jobs], [p for p, _ in jobs]))
    sums: dict[tuple[Toxicity, float], np.ndarray] = {}
    for (p, _), parts in zip(jobs, done, strict=True):
        for share, *counts in parts:
            sums[(p, share)] = sums.get((p, share), 0) + np.array(counts)
    table = [(dataclasses.replace(p, flagged=share), c[1] / max(c[0], 1), c[3] / max(c[2], 1)) for (p, share), c in sums.items()]
    best = choose(table)
    for p, recall, flagged in sorted(table, key=lambda x: -x[1]):
        print(json.dumps({"sizes": p.sizes, "segment": p.segment, "min_docs": p.min_docs, "refine": p.refine, "flagged": p.flagged, "recall": round(recall, 4), "clean flagged": round(flagged, 4), "chosen": p == best[0]}))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
