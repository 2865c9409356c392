"""Audit of how filters interact, as a relational word pipeline.

Words are exploded and counted by (text, word), then by text, which gives totals and distinct words; the flags of the other filters are
outer-joined to them, and one aggregate makes a conditional count for each of the 32 sets of filters that a document can fail (all, good
and toxic documents). Everything an order of filters can tell follows from these counts, so no order looks at a document again.

Texts are known by 128 bits. Equal texts are merged in the map tasks before their one shuffle, by which all later word aggregates are
already dealt, so copies of any number are exploded once. Rows of a document carry no text; after labels and first ids are joined (by id, and
by text and id, neither of which is hot once equal rows are counted together) they are counted by text and label before the counts by text
meet the word counts, so a text of very many copies comes to a few rows.

Defined results: a null text is empty (it fails A alone, and E where an equal text has a smaller id); a null part is the empty string; null
ids are larger than all others, and rows that share the smallest id of a text don't fail E; repeated rows count as often as they come; several
labels of an id count as good or toxic if any does. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import WS_RE, discard, materialise, table

FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """Production parameters: a document fails A under min_words words, B under distinct_pct % distinct words, C over capital_pct % capitals, D with a mark, E as a copy."""

    min_words: int = 200
    distinct_pct: int = 50
    capital_pct: int = 3
    marks: str = "[#$%&*|]"


LIMITS = Limits()
_TEXT = ("h1", "h2")


def _keyed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return d.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def word_counts(docs: DataFrame) -> DataFrame:
    """h1, h2, n_words, n_distinct of each different text that has a word. docs: h1, h2, text."""
    texts = docs.groupBy(*_TEXT).agg(F.any_value("text").alias("text"))
    lines = texts.select(*_TEXT, F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(*_TEXT, F.explode(F.split("line", WS_RE)).alias("word")).filter("word != ''")
    return words.groupBy(*_TEXT, "word").agg(F.count("*").alias("n")).groupBy(*_TEXT).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", p: Limits = LIMITS) -> DataFrame:
    """part, and arrays n, good, toxic: documents by the set of filters they fail (bit k: filter k of FILTERS)."""
    keyed = _keyed(docs, id_col, text_col, part_col)
    capitals = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * p.capital_pct
    rows = keyed.select("doc_id", "part", *_TEXT, capitals.alias("c"), F.col("text").rlike(p.marks).alias("d"))
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "audit-rows")
    firsts = rows.groupBy(*_TEXT).agg(F.min("doc_id").alias("first_id"), F.max("c").alias("c"), F.max("d").alias("d"))

    w = word_counts(keyed.select(*_TEXT, "text"))
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = (n < p.min_words, distinct * 100 < n * p.distinct_pct, F.col("c"), F.col("d"))
    bits = sum((x.cast("int") * (1 << k) for k, x in enumerate(fails)), F.lit(0))
    per_text = firsts.join(w, list(_TEXT), "left").select(*_TEXT, bits.alias("bits"))

    yes = lambda c: F.coalesce(F.max(c) == 1, F.lit(False)).alias(c)
    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(yes("quality"), yes("toxic"))
    r = rows.join(marked, F.col("doc_id") == F.col("label_id"), "left")
    f = firsts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first_id", F.lit(True).alias("first"))
    r = r.join(f, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    r = r.select("part", *_TEXT, no("quality"), no("toxic"), F.col("first").isNull().alias("e"), "copies")
    r = r.groupBy("part", *_TEXT, "quality", "toxic", "e").agg(F.sum("copies").alias("copies"))

    failed = F.col("bits") + F.col("e").cast("int") * (1 << 4)
    r = r.join(per_text, list(_TEXT)).select("part", "quality", "toxic", "copies", failed.alias("failed"))
    sets = range(1 << len(FILTERS))
    count = lambda only, name: [F.sum(F.when((F.col("failed") == m) & only, F.col("copies")).otherwise(0)).alias(f"{name}{m}") for m in sets]
    wide = r.groupBy("part").agg(*count(F.lit(True), "n"), *count(F.col("quality"), "good"), *count(F.col("toxic"), "toxic"))
    out = materialise(wide.select("part", *[F.array(*[f"{c}{m}" for m in sets]).alias(c) for c in ("n", "good", "toxic")]), "audit")
    discard(rows)
    return out


def _total(counts: str, take) -> Column:
    """Sum over the sets m of failed filters for which take(m) holds, or of count times take(m) if that is a number."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, m: a + F.when(take(m), F.get(counts, m)).otherwise(0))


def orders(counts: DataFrame) -> DataFrame:
    """Every order of the filters and every step of it, from `interactions`' counts."""
    k = len(FILTERS)
    perms = ["".join(o) for o in itertools.permutations(FILTERS)]
    d = counts.select("*", F.explode(F.array(*map(F.lit, perms))).alias("filter_order"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda at: F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.ascii(F.substr("filter_order", at, F.lit(1))) - ord("A") + 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(i)).otherwise(0))
    d = d.withColumns({"own": bit(F.col("step")), "before": before})
    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    removed = lambda m: has(m, "own") & ~has(m, "before")
    # a document that fails f of the filters goes to each of them in 1 / f of the orders; factorial(k) is a multiple of every f
    share = lambda m: F.get("n", m) * F.expr(f"cast(factorial({k}) as long)") / F.bit_count(m)
    shapley = F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(has(m, "own"), share(m).cast("long")).otherwise(0))
    return d.select(
        "part",
        "filter_order",
        "step",
        _total("n", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return orders(interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(ws) < {LIMITS.min_words} AS a, 100 * len(list_distinct(ws)) < {LIMITS.distinct_pct} * len(ws) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {LIMITS.capital_pct} * length(t) AS c,
  regexp_matches(t, '{LIMITS.marks}') AS d, coalesce(w.doc_id > f.first_id, f.first_id IS NOT NULL) AS e
  FROM w JOIN f USING (t) LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, [x.k FOR x IN [{{'k': 'A', 'f': a}}, {{'k': 'B', 'f': b}}, {{'k': 'C', 'f': c}}, {{'k': 'D', 'f': d}}, {{'k': 'E', 'f': e}}] IF x.f] AS failed FROM j),
n AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, i::INT AS step, o[i] AS own, o[:i - 1] AS before FROM o, range(1, 6) r(i)),
g AS (SELECT part, array_to_string(o, '') AS filter_order, step, own,
  sum(CASE WHEN NOT list_contains(failed, own) AND NOT list_has_any(failed, before) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN list_contains(failed, own) AND NOT list_has_any(failed, before) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN list_contains(failed, own) AND list_has_any(failed, before) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = [own] THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN list_contains(failed, own) AND NOT list_has_any(failed, before) THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN list_contains(failed, own) AND NOT list_has_any(failed, before) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g"""
