"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the relative entropy sum q (r ln r - r) under sum(size * r) = target for each source and
r <= max_rate, with base measure q = size^(1 - tilt). The dual has one variable a source, and its solution is the exponential tilt
r = min(max_rate, exp(lambda_source * (size / mean size)^tilt)). tilt 1 weighs documents alike and would empty a reduced
source of its long documents; tilt 0 weighs words alike and is a constant rate; production takes 0.25, a mild tilt.

Newton's iterations are distributed: each sums value and slope of the dual's gradient over the table of (source, size)
counts and updates a table of one row a source; steps are kept inside a bracket, so convergence doesn't depend on the start.

Rounding: copies = floor(r), and one more where u < frac(r) + tau, u a hash of the row's id, source and text. tau is near 0 and chosen
per source from two distributed histograms so that the words taken meet the target to about one document. Equal rows that hold more than
1 / `heavy` of their source's words are numbered, each with a u of its own; fewer equal rows share u.

Everything of one row a source is a table. Up to `max_sources` rows of it are held by the driver between steps and broadcast; beyond, the
same steps write it to the shared folder and join it by shuffle, hot sources apart. Sources are aggregated before any shuffle.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null and repeated ids are as good as others.
Documents without words are kept once (size 0, they take no words). An empty table gives an empty table. In `mix` other columns pass
through, whatever their names; the rows are written once with their sizes, so texts of any length are counted once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.common import WORD_RE, materialise, skewed_join, table


@dataclass(frozen=True)
class Mix:
    """Production parameters."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  #: of the sources in order, repeating
    total: float = 1.5  #: words wanted for each word there is
    max_rate: float = 2.0
    tilt: float = 0.25
    tolerance: float = 1e-6  #: of the target
    max_steps: int = 60
    max_sources: int = 100_000  #: rows of a table of sources that are broadcast; more are joined by shuffle
    bins: int = 1024  #: of each of the two histograms
    heavy: int = 1000


PARAMS = Mix()


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _rate(p: Mix) -> Column:
    """r from columns size, x (lambda; null: at the limit) and mean."""
    tilted = F.col("x") * F.pow(F.col("size") / F.col("mean"), F.lit(p.tilt))
    return F.when(F.col("x").isNull(), F.lit(p.max_rate)).otherwise(F.exp(F.least(tilted, F.lit(math.log(p.max_rate)))))


class _Tables:
    """Tables of one row a source: held and broadcast up to max_sources, else written and joined by shuffle."""

    def __init__(self, spark, n: int, p: Mix):
        self.spark, self.small = spark, n <= p.max_sources

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df with its lineage cut."""
        return self.spark.createDataFrame(df.toArrow(), df.schema) if self.small else materialise(df, name)

    def join(self, rows: DataFrame, per: DataFrame, key: str = "k") -> DataFrame:
        return rows.join(F.broadcast(per), key) if self.small else skewed_join(rows, per, key)


def _ranked(totals: DataFrame, p: Mix) -> DataFrame:
    """totals with k, the place of the source by code point (null last), and its weight: numbered range by range."""
    order = (F.col("source").isNull(), F.col("source"))
    ranged = materialise(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    ahead = ranged.groupBy("part").agg(F.count("*").alias("c"))
    ahead = ahead.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))  # one row a task
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    k = F.col("before") + F.col("i")
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (k % len(p.weights) + 1).cast("int"))
    return own.join(F.broadcast(ahead), "part").select("source", "words", "n", k.alias("k"), weight.alias("weight"))


def targets(sources: DataFrame, p: Mix = PARAMS) -> DataFrame:
    """sources (words, weight, ...) with goal: shares by weight, stopped at max_rate times the words, the excess shared anew.

    Sources that are stopped at one unit of weight stay so at the next, higher one; so a pass over the table finds the next unit.
    """
    most = F.col("words") * p.max_rate
    unit, before = 0.0, -1.0
    while unit > before:
        stopped = F.lit(unit) * F.col("weight") > most
        left, free = sources.agg(F.sum(F.col("words") * p.total) - F.sum(F.when(stopped, most).otherwise(0.0)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not free:
            break
        before, unit = unit, left / free
    return sources.withColumn("goal", F.least(F.lit(unit) * F.col("weight"), most) if unit > 0 else F.lit(0.0))


def _solve(counts: DataFrame, sources: DataFrame, tables: _Tables, p: Mix) -> DataFrame:
    """k, x: lambda of each source with a target; null at the limit. counts: k, size, n."""
    live = sources.filter("goal > 0")
    full = F.col("goal") >= F.col("words") * p.max_rate * (1 - 1e-12)
    start = F.when(~full, F.log(F.col("goal") / F.col("words")))
    state = live.select("k", "goal", "mean", start.alias("x"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), full.alias("done"))
    state = tables.cut(state, "mix-state")
    rate, tilt = _rate(p), F.pow(F.col("size") / F.col("mean"), F.lit(p.tilt))
    words = F.col("n") * F.col("size") * rate
    for _ in range(p.max_steps):
        todo = state.filter("not done")
        if todo.isEmpty():
            break
        sums = counts.join(F.broadcast(todo) if tables.small else todo, "k").groupBy("k").agg(F.sum(words).alias("f"), F.sum(F.when(rate < p.max_rate, words * tilt).otherwise(0.0)).alias("df"))
        x, gap = F.col("x"), F.col("f") - F.col("goal")
        s = state.join(sums, "k", "left").withColumns({"gap": gap, "met": F.col("done") | (F.abs(gap) <= p.tolerance * F.col("goal"))})
        s = s.withColumns({"lo": F.when(F.col("gap") > 0, F.col("lo")).otherwise(x), "hi": F.when(F.col("gap") > 0, x).otherwise(F.col("hi"))})
        s = s.withColumn("new", F.when(F.col("df") > 0, x - F.col("gap") / F.col("df")).otherwise(math.inf))
        middle = F.when(F.abs(F.col("lo") + F.col("hi")) < 1e300, (F.col("lo") + F.col("hi")) / 2).otherwise(x + F.when(F.col("gap") < 0, 2.0).otherwise(-2.0))
        inside = (F.col("lo") < F.col("new")) & (F.col("new") < F.col("hi")) & (F.abs(F.col("new") - x) <= 4)
        x = F.when(F.col("met"), x).when(inside, F.col("new")).otherwise(middle)
        state = tables.cut(s.select("k", "goal", "mean", x.alias("x"), "lo", "hi", F.col("met").alias("done")), "mix-state")
    return state.select("k", F.round("x", 9).alias("x"))


def _numbered(base: DataFrame, sources: DataFrame, tables: _Tables, p: Mix) -> DataFrame:
    """base with u in [0, 1): a hash of h and, for equal rows that are many words of their source, of their number among them.

    They are numbered by the task that wrote them, so a group of any size is dealt to as many tasks.
    """
    u = lambda number: F.xxhash64("h", number, F.lit("mix")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    equal = base.filter("size > 0").groupBy("h", "k", "size").agg(F.count("*").alias("n")).filter("n > 1")
    many = tables.join(equal, sources.select("k", "words")).filter(F.col("n") * F.col("size") * p.heavy > F.col("words"))
    many = materialise(many.groupBy("h").agg(F.lit(1).alias("one")), "mix-equal")  # at most `heavy` a source
    if many.isEmpty():
        return base.withColumn("u", u(F.lit(0).cast("long")))
    own = tables.join(base, many, "h").drop("one")
    before = own.groupBy("h", "pid").agg(F.count("*").alias("c"))
    before = before.select("h", "pid", (F.sum("c").over(Window.partitionBy("h").orderBy("pid")) - F.col("c")).alias("before"))  # a row a task that wrote
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("h", "pid").orderBy("h"))).join(before, ["h", "pid"])
    rest = base.join(F.broadcast(many) if tables.small else many, "h", "left_anti")
    return rest.withColumn("u", u(F.lit(0).cast("long"))).unionByName(own.withColumn("u", u((F.col("before") + F.col("i") - 1).cast("long"))).select(*rest.columns, "u"))


def _key(p: Mix) -> Column:
    """u - frac(r): one more copy where it is below tau; 2 where the limit is reached already."""
    r = _rate(p)
    return F.when(r >= p.max_rate, 2.0).otherwise(F.col("u") - (r - F.floor(r)))


def _taus(rows: DataFrame, sources: DataFrame, tables: _Tables, p: Mix) -> DataFrame:
    """k, tau: threshold of each source for its extra copies, a bound of one of bins^2 cells of [-1, 1). sources: k, goal, mean, x."""
    d = tables.join(rows.filter("size > 0"), sources.filter("x is not null"))
    d = d.select("k", "size", "goal", F.floor(_rate(p)).alias("base"), _key(p).alias("v"))
    d = d.select("k", "size", "goal", "base", F.when(F.col("v") < 1, F.floor((F.col("v") + 1) / 2 * p.bins * p.bins).cast("long")).alias("b"))
    hist = d.groupBy("k", F.floor(F.col("b") / p.bins).alias("c")).agg(F.sum(F.col("size") * F.col("base")).alias("base"), F.sum("size").alias("words"), F.first("goal").alias("goal"))
    w = Window.partitionBy("k")  # at most bins + 1 rows
    upto = F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("words"))).over(w.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = hist.select("k", "c", "words", (F.col("goal") - F.sum("base").over(w)).alias("need"), upto.alias("upto"))
    found = tables.cut(found.filter("c is not null and upto <= need and need < upto + words").select("k", "c", (F.col("need") - F.col("upto")).alias("need")), "mix-cells")
    cells = tables.join(d, found).filter(F.floor(F.col("b") / p.bins) == F.col("c")).groupBy("k", "b").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    # the last cell whose end is nearer to what is needed than its start
    cells = cells.withColumn("upto", F.sum("words").over(w.orderBy("b"))).filter(F.col("upto") - F.col("words") / 2 <= F.col("need"))
    last = found.join(cells.groupBy("k").agg(F.max("b").alias("b")), "k", "left")
    return tables.cut(last.select("k", (F.lit(2.0) * F.coalesce(F.col("b") + 1, F.col("c") * p.bins) / p.bins**2 - 1).alias("tau")), "mix-taus")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", p: Mix = PARAMS, carry: bool = False) -> DataFrame:
    """doc_id, source, size, copies, source_size, target of each row of docs; with carry the row itself as `row`."""
    source, text = F.col(source_col).cast("string"), F.col(text_col)
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(*row, F.col(id_col).alias("doc_id"), source.alias("source"), size_of(text).alias("size"), F.xxhash64(F.col(id_col), source, text).alias("h"), F.spark_partition_id().alias("pid"))
    base = materialise(base, "mix-sizes")
    counts = materialise(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    totals = materialise(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")), "mix-totals")
    tables = _Tables(docs.sparkSession, totals.count(), p)
    sources = targets(tables.cut(_ranked(totals, p), "mix-ranked"), p)
    sources = tables.cut(sources.withColumn("mean", F.greatest(F.col("words") / F.col("n"), F.lit(1e-9))).withColumn("name", F.struct("source")), "mix-goals")
    # a struct of the source, as a null in it equals another
    place = lambda d: tables.join(d.withColumn("name", F.struct("source")), sources.select("name", "k"), "name").drop("name")
    base, counts = place(base), materialise(place(counts).filter("size > 0"), "mix-placed")
    sources = sources.join(_solve(counts, sources, tables, p), "k", "left").withColumn("x", F.when(F.col("goal") > 0, F.col("x")).otherwise(0.0))
    sources = tables.cut(sources.select("k", "words", "goal", "mean", "x"), "mix-rates")
    base = _numbered(base, sources, tables, p)
    per = tables.cut(sources.join(_taus(base, sources, tables, p), "k", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0))), "mix-plan")
    d = tables.join(base, per)
    n = F.floor(_rate(p)) + F.when(_key(p) < F.col("tau"), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 1).otherwise(n).cast("long")
    return d.select(*(["row"] if carry else []), "doc_id", "source", "size", copies.alias("copies"), F.col("words").cast("long").alias("source_size"), F.col("goal").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", p: Mix = PARAMS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; same columns."""
    d = plan(docs, id_col, source_col, text_col, p, carry=True).filter("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    d = plan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
