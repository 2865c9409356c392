"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A class's draw is cut at one of these bounds of u, each 2 ** -(1 / 8) of the one before.
_STEPS = 400


def _drawn(rows: DataFrame, u: Column, per_class: int, classes: int) -> tuple[DataFrame, dict]:
    """Of rows (label, ...) those of each class with the smallest u, down to the bound that leaves per_class of them at least; counts of the classes.

    u of the rows is binned and counted first, so that only drawn rows travel; classes beyond the `classes` largest are left out.
    """
    bin_ = F.least(F.floor(-8 * F.log2(F.greatest(u, F.lit(2.0**-60)))), F.lit(_STEPS)).cast("int")
    hist = rows.groupBy("label", bin_.alias("bin")).agg(F.count("*").alias("n"))
    largest = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes)
    hist = hist.join(F.broadcast(largest.select("label")), "label")
    least: dict = {}
    counts: dict = {}
    for label, b, n in sorted(map(tuple, hist.collect()), key=lambda r: -r[1]):
        if counts.get(label, 0) < 1.1 * per_class:
            least[label] = b  # bins count down from the smallest u
        counts[label] = counts.get(label, 0) + n
    if not least:
        return rows.limit(0), {}
    bound = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    return rows.filter(bin_ >= F.try_element_at(bound, F.col("label"))), counts


def labelled_sample(docs: DataFrame, labels: DataFrame | None, per_class: int, max_bytes: int, classes: int = 500) -> tuple[pa.Table, dict]:
    """(text, label; rows of each label in all) of at most per_class documents of each label, of texts with 1 to max_bytes bytes, on the driver.

    docs: doc_id, text (and label, without labels); labels: doc_id, label. Rows with a null id, text or label are left out, and labels
    beyond the `classes` most frequent. Labels are drawn by a hash of the id, then their rows by a hash of id and text, so that no id
    of very many rows decides the sample; equal texts of one class are taken once, before they travel.
    """
    hashed = lambda *c: F.xxhash64(*c, F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    short = F.octet_length("text").between(1, max_bytes)
    counts = None
    if labels is None:
        rows = docs.filter("doc_id is not null and label is not null").select("doc_id", "text", "label")
    else:
        named, counts = _drawn(labels.filter("doc_id is not null and label is not null").select("doc_id", "label").distinct(), hashed("doc_id"), 2 * per_class, classes)
        # at most a little over 2 * per_class ids a class
        rows = docs.select("doc_id", "text").filter(short).join(F.broadcast(named), "doc_id")
    # twice as many, as copies fall together
    rows, found = _drawn(rows if labels is not None else rows.filter(short), hashed("doc_id", "text"), 2 * per_class, classes)
    u = F.min(hashed("doc_id", "text")).alias("u")
    t = rows.groupBy("label", "text").agg(u).select("text", "label", "u").toArrow().sort_by([("u", "ascending"), ("text", "ascending")])
    taken: dict = {}
    keep = []
    for k, label in enumerate(t.column("label").to_pylist()):
        if taken.get(label, 0) < per_class:
            taken[label] = taken.get(label, 0) + 1
            keep.append(k)
    return t.take(pa.array(keep, pa.int64())).drop_columns(["u"]), found if counts is None else counts
