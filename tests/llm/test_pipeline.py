"""The pipeline stage by stage: against the operators, and against plain versions."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm import plain
from tests.llm.test_operators import brute_targets, whole_ids
from timeloom.llm import common, decontam, quality_rules, simhash
from timeloom.llm import token_output as to
from timeloom.llm.common import materialise, table


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialise(stage(spark, kept, SF), "test")
        if name == "quality rules":
            want = {r.doc_id for r in quality_rules.quality_rules(before).filter("kept").collect()}
            assert {r.doc_id for r in kept.collect()} == want
        if name == "near duplicates":
            rows = simhash.near_duplicates(before).collect()
            assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
        if name == "decontamination":
            clean = decontam.decontaminate(before, table(spark, SF, "benchmark"), keep=["doc_id"]).filter("not contaminated")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in clean.collect())
        if name == "mixing":
            copies = kept.groupBy("doc_id").count()
            assert copies.filter("count > 2").isEmpty() and kept.join(before, "doc_id", "left_anti").isEmpty()
        if name != "token output":
            assert kept.columns == docs.columns
        else:
            assert kept.count() == before.count()


def test_pipeline_odd(spark):
    rows = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "A line of words that ends well and says something new. " * 2, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = materialise(stage(spark, d, SF), "test")
        assert d.count() <= 2


def test_dedup_shared_and_null_ids(spark):
    rng = random.Random(5)
    x, y, z, w = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(7, x, "a"), (7, y, "a"), (3, y, "b"), (None, z, "a"), (None, z, "a"), (None, z, "b"), (None, w, None), (9, w, "a"), (9, w, "a"), (7, x, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.dedup(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(7, x), (3, y), (None, z), (9, w)], key=str)


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, __text string, row string, h string"


def test_pipeline_plain(spark):
    """Rows, texts, copies and token digests of all stages against Python; with clashing columns, null ids, nulls and copies."""
    rng = random.Random(3)
    own = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    sentence = lambda: " ".join(rng.choice(["alder", "birch", "cedar", "damson", "elm", "fir", "gorse", "hazel"]) + str(rng.randrange(999)) for _ in range(12)) + ".\n"
    prose = lambda n: "".join(sentence() for _ in range(n))
    a, b = prose(8), prose(8)
    more = [(9001, a), (9002, a), (9002, b), (9001, b), (None, a), (None, prose(6)), (9003, prose(5) + items[0] + "\n" + "Home | About | Log in\n"), (9004, None), (9005, ""), (9006, prose(400))]
    rows = [(*r, "k", "t", "r", "h") for r in own + [(i, t, "en", rng.choice(["s1", None]), 0) for i, t in more]]
    docs = spark.createDataFrame(rows, KIND)
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        tables.append([tuple(r) for r in docs.collect()])
    cleaned, unique, safe, mixed, tokens = tables
    of = lambda those: Counter(those)
    want = [(i, t, lang, src, len(t), *x) for i, text, lang, src, _, *x in rows if (t := plain.clean(text)) is not None]
    assert of(cleaned) == of(want)
    group = plain.groups([plain.fingerprint(r[1]) for r in want])
    kept = Counter((r[0], r[1]) for r in unique)
    assert sum(kept.values()) == len(set(group))
    for g in set(group):
        mine = [r for r, k in zip(want, group, strict=True) if k == g]
        least = min((r[0] is None, r[0] or 0) for r in mine)
        chosen = [r for r in mine if kept[(r[0], r[1])]]
        assert chosen and all((r[0] is None, r[0] or 0) == least for r in chosen)
    assert of(safe) == of(r for r in unique if not plain.contaminated(r[1], items))
    size = lambda r: len(plain.words(r[1]))
    sizes = Counter()
    for r in safe:
        sizes[r[3]] += size(r)
    goal = brute_targets(dict(sizes))
    copies = of(mixed)
    assert set(copies) <= set(safe) and all(copies[r] <= 2 * n for r, n in of(safe).items())
    for s in sizes:
        mine = [r for r in safe if r[3] == s]
        assert abs(sum(size(r) for r in mixed if r[3] == s) - goal[s]) <= max(map(size, mine))
    ordered = sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array(x, "<u4") for x in whole_ids(to.encoder("word_bpe_49k.json", 50), [r[1] for r in ordered])]
    assert of((t[0], t[2], t[3]) for t in tokens) == of((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(ordered, ids, strict=True))
    tokens.sort(key=lambda t: t[1])
    assert [t[0] for t in tokens] == [r[0] for r in ordered] and [t[1] for t in tokens] == (np.cumsum([t[2] for t in tokens]) - [t[2] for t in tokens]).tolist()


def test_pipeline_empty_with_clashing_columns(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        assert docs.count() == 0 and (name == "token output" or docs.columns == [c.split()[0] for c in KIND.split(", ")])


def test_run_is_all_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
    key = lambda d: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in d.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_nothing_but_the_result_remains(spark):
    before = set(common._written)
    out = corpus_pipeline.run(spark, SF)
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in set(common._written) - before]
    assert left == ["tokens"] and out.count() > 0
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert {p.rpartition("/")[2] for p in common._written} >= {x for x in os.listdir(folder) if x.startswith(("stage-", "mix-", "simhash-", "dedup-", "decontam-", "hot-", "tokens-"))}


def test_scopes_delete_after_failures(spark):
    before = set(common._written)
    with pytest.raises(ValueError), common.scope("kept"):
        materialise(spark.range(3), "kept")
        materialise(spark.range(3), "gone")
        raise ValueError
    assert [p.rpartition("/")[2][:5] for p in set(common._written) - before] == ["kept-"]
