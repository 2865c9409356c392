"""Line-first quality rules, with DataFrame functions only.

Each line of a text is judged alone by punctuation, navigation, repetition and boilerplate rules; failing lines are
removed; a document that loses more than `max_removed` of the code points of its words, or that fails the base rules,
is rejected. Everything is computed inside one projection over the row: no shuffle, no Python.

Defined results: a null or empty text has no words (all counts 0, base_failed, not kept, clean text ""). Blank lines
are neither judged nor removed. Rows are judged one by one, so repeated rows get equal results and an empty table gives
an empty table. Columns of the input other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import WS_CHARS, WS_RE, table

SYMBOLS_RE = r"[#*$%&|<>]"
#: Phrases that mark a short line as boilerplate.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "log in", "lorem ipsum", "privacy policy", "read more", "share on", "sign in", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Production thresholds."""

    min_words: int = 10  #: base: fewer words fail
    max_repeat_pct: int = 20  #: base: more words than this in repeated 5-word windows fail
    short_line: int = 8  #: a line of fewer words needs an end mark
    end_re: str = r"[.!?\x{2026}:;][\"'\x{201D}\x{2019}\x{00BB})\]]*$"
    min_separators: int = 3  #: navigation: at least so many lone separators ...
    separator_pct: int = 25  #: ... and so many per hundred words
    symbol_pct: int = 50  #: symbols for each hundred words
    exclaim_pct: int = 30  #: exclamation marks for each hundred words, in lines of repeat_line words or more
    shout_pct: int = 70  #: capitals among ASCII letters, in lines of repeat_line words or more
    repeat_line: int = 8
    distinct_pct: int = 25  #: fewer different words than this, in lines of 2 * repeat_line words or more
    boilerplate_words: int = 15  #: a phrase of BOILERPLATE fails lines of up to so many words
    max_removed_pct: int = 50  #: a document that loses more of its word characters is rejected


RULES = LineRules()


def words_of(text: Column) -> Column:
    """Words of a non-null text; [] if there is none."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, wherever the expression ends up."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that the array w holds twice or more.

    Windows are compared by 64-bit hash, in the order of (hash, position), where equal ones are neighbours; only texts
    with such a window sort. Each window then counts the words up to the next one, five at most.
    """
    # words are hashed once, windows from their words' hashes
    grams = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))
    in_order = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    is_dup = lambda s, x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    found = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: is_dup(s, x, k)), lambda x: x["i"]))
    each = lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1), x + 5) - x).cast("long"))
    covered = lambda p: F.aggregate(each(p), F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.lit(0).cast("long")
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(in_order(g), lambda s: let(found(s), covered))).otherwise(none))
    return F.when(F.size(w) >= 6, counted).otherwise(none)


def computed(df: DataFrame, *columns) -> DataFrame:
    """select(), as a generator of one row: Catalyst neither copies its expressions into later steps nor moves filters below it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _pct(part: Column, pct: int, whole: Column) -> Column:
    return part * 100 > whole * pct


def _line_fails(x: Column, r: LineRules) -> Column:
    """x: struct(line, trimmed, words)."""
    line, words = x["trimmed"], x["words"]
    n = F.size(words)
    count = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    lone = F.size(F.filter(words, lambda w: w.isin(*"|>»•·")))
    nav = (lone >= r.min_separators) & (lone * 100 >= n * r.separator_pct)
    phrase = "(?i)(" + "|".join(BOILERPLATE) + ")"
    return (
        F.when((n < r.short_line) & ~line.rlike(r.end_re), True)
        .when(nav, True)
        .when(_pct(count(SYMBOLS_RE), r.symbol_pct, n), True)
        .when((n >= r.repeat_line) & _pct(count("!"), r.exclaim_pct, n), True)
        .when((n >= r.repeat_line) & _pct(count("[A-Z]"), r.shout_pct, count("[A-Za-z]")), True)
        .when((n >= 2 * r.repeat_line) & ~_pct(F.size(F.array_distinct(words)), r.distinct_pct, n), True)
        .when((n <= r.boilerplate_words) & line.rlike(phrase), True)
        .otherwise(False)
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the counts of the base rules, base_failed, kept, n_lines, n_removed_lines, clean_text; then struct `carried` if asked for.

    Arrays used inside lambdas are bound by `let`, and each step is `computed`, so everything is computed once a row whatever
    a caller selects or filters.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(*carry).alias("carried")] if carry else []
    passed = ["carried"] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), *carried)
    judged = F.transform(F.split("t", "\n", -1), lambda s: F.struct(s.alias("line"), F.btrim(s, F.lit(WS_CHARS)).alias("trimmed"), words_of(s).alias("words")))
    judged = F.transform(judged, lambda x: F.struct(x["line"].alias("line"), (x["trimmed"] != "").alias("filled"), F.length(F.array_join(x["words"], "")).alias("chars"), F.when(x["trimmed"] != "", _line_fails(x, rules)).otherwise(False).alias("fails")))
    words = let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated")))
    d = computed(d, "doc_id", "t", *passed, words.alias("w"), judged.alias("lines"))
    filled = F.filter("lines", lambda x: x["filled"])
    kept_lines = F.filter("lines", lambda x: ~x["fails"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    d = computed(
        d,
        "doc_id",
        *passed,
        F.col("w.n").alias("n_words"),
        total(F.col("lines")).alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS_RE, ""))).cast("long").alias("n_symbols"),
        (F.size(filled) - F.size(F.array_distinct(F.transform(filled, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
        F.size(filled).cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_removed_lines"),
        total(kept_lines).alias("kept_chars"),
        F.array_join(F.transform(kept_lines, lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * rules.max_removed_pct
    return d.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)


def op8(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"
    )


def _sql() -> str:
    r = RULES
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    seps = ", ".join(f"'{c}'" for c in "|>»•·")
    end = r.end_re.replace("'", "''")
    count = lambda p: f"(length(x.trimmed) - length(regexp_replace(x.trimmed, '{p}', '', 'g')))"
    words = lambda s: f"regexp_extract_all({s}, '{WS_RE.replace('[', '[^', 1)}')"
    fails = f"""CASE
        WHEN x.trimmed = '' THEN false
        WHEN x.n < {r.short_line} AND NOT regexp_matches(x.trimmed, '{end}') THEN true
        WHEN x.lone >= {r.min_separators} AND x.lone * 100 >= x.n * {r.separator_pct} THEN true
        WHEN {count(SYMBOLS_RE)} * 100 > x.n * {r.symbol_pct} THEN true
        WHEN x.n >= {r.repeat_line} AND {count("!")} * 100 > x.n * {r.exclaim_pct} THEN true
        WHEN x.n >= {r.repeat_line} AND {count("[A-Z]")} * 100 > {count("[A-Za-z]")} * {r.shout_pct} THEN true
        WHEN x.n >= {2 * r.repeat_line} AND x.dist * 100 <= x.n * {r.distinct_pct} THEN true
        WHEN x.n <= {r.boilerplate_words} AND regexp_matches(x.trimmed, '(?i)({"|".join(BOILERPLATE)})') THEN true
        ELSE false END"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {words("t")} AS w, string_split(t, chr(10)) AS lines FROM d),
l0 AS (SELECT rid, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM w),
l AS (SELECT rid, line, trim(line, {ws}) AS trimmed, {words("line")} AS ws FROM l0),
l2 AS (SELECT rid, line, trimmed, len(ws) AS n, len(list_distinct(ws)) AS dist, len(list_filter(ws, lambda v: v IN ({seps}))) AS lone,
         length(array_to_string(ws, '')) AS chars FROM l),
l3 AS (SELECT rid, line, trimmed, chars, {fails} AS fails FROM l2 x),
agg AS (SELECT rid, sum(chars) AS word_chars, sum(CASE WHEN NOT fails THEN chars ELSE 0 END) AS kept_chars,
         count(*) FILTER (WHERE trimmed <> '') - count(DISTINCT line) FILTER (WHERE trimmed <> '') AS n_dup_lines,
         count(*) FILTER (WHERE fails) AS n_removed_lines FROM l3 GROUP BY rid),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 6),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i+4], ' ')) AS c FROM g),
p AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) - i) AS cov FROM g2 WHERE c > 1),
rep AS (SELECT rid, sum(cov) AS n FROM p GROUP BY rid),
r AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '{SYMBOLS_RE}', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(kept_chars AS BIGINT) AS kept_chars, CAST(n_removed_lines AS BIGINT) AS n_removed_lines
      FROM w JOIN agg USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((word_chars - kept_chars) * 100 > word_chars * {r.max_removed_pct}) AS kept, n_removed_lines
FROM b"""


SQL = _sql()
