"""Phrase mining, packing and the filter audit against plain Python, and their odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from timeloom.llm import common, filter_audit, packing, phrases

KIND = "doc_id bigint, text string, lang string, word string, phrase string, h1 string, part string, sequence_id string, n string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], KIND)


# packing


def whole_ids(e, text):
    return [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


PARTS = [" ", "  ", "\n", "\t", "a", "The", "é", "ß×÷", "don't", "'s", "12", "½", ".", "!?", "\"", ")", "<|endoftext|>", "\xa0", "　", " ", "\x85", "\x1c", "中文。", "\x00", "_", "I'LL"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), min_size=1, max_size=6))
def test_packing_ids_property(texts):
    e = packing.encoder(packing.PACK)
    data, offsets = common.utf8(pa.array(texts))
    ids, ends, _ = packing.encode_block(e, data, offsets, 0)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [whole_ids(e, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=80).map("".join))
def test_packing_long_texts_property(text):
    e = packing.encoder(packing.PACK)
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _, _ = packing.encode_long(e, data, replace(packing.PACK, block_bytes=7))
    assert ids.tolist() == whole_ids(e, text)


def padding(n, p):
    return 0 if n & (n - 1) == 0 else p.capacity - n


def cheapest(at, cost, p):
    """Every start for every cut."""
    best = [0] + [1 << 60] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= p.capacity:
                best[j] = min(best[j], best[i] + padding(at[j] - at[i], p) + p.window + cost[j])
    return best[-1]


def test_packing_cuts_are_the_cheapest():
    rnd = random.Random(3)
    for _ in range(300):
        p = replace(packing.PACK, capacity=rnd.choice([8, 16, 32]), sentence=rnd.randint(0, 3), inside=rnd.randint(3, 9), window=rnd.randint(0, 3))
        docs = np.cumsum([rnd.choice([1, 2, 5, 20, 70]) for _ in range(rnd.randint(1, 6))])
        stops = np.array(sorted({rnd.randrange(1, int(docs[-1]) + 1) for _ in range(rnd.randint(0, 12))}), np.int64)
        at, cost = packing.offered(docs, stops, p)
        assert {0, *docs.tolist(), *stops.tolist()} <= set(at.tolist())
        cuts = packing.best_cuts(at, cost, p)
        sizes = np.diff(cuts)
        assert cuts[0] == 0 and cuts[-1] == docs[-1] and sizes.min() > 0 and sizes.max() <= p.capacity
        price = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert sum(padding(int(n), p) + p.window for n in sizes) + sum(price[c] for c in cuts) == cheapest(at.tolist(), cost.tolist(), p)


def check_pieces(rows, texts, p=packing.PACK):
    """rows: of pack with ids, texts in any order; every id once, gapless sequences."""
    e, sequences, docs = packing.encoder(packing.PACK), {}, {}
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1]
        assert sum(r.length for r in s) <= p.capacity
    want = {i: sorted(whole_ids(e, t) for _, t in g) for i, g in itertools.groupby(sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0])}
    assert docs.keys() == want.keys()
    for i, pieces in docs.items():
        if len(want[i]) > 1:  # rows that share an id: pieces of all of them
            assert sum(r.length for r in pieces) == sum(map(len, want[i]))
            continue
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want[i][0]
        assert {r.doc_tokens for r in pieces} == {len(want[i][0])}
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
    return sum(padding(sum(r.length for r in s), p) for s in sequences.values()), sum(len(t) for g in want.values() for t in g)


def test_packing_whole_table(spark):
    docs = common.table(spark, SF, "documents")
    pieces = packing.pack(docs)
    waste, total = check_pieces(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert waste * 100 < total
    assert packing.op12(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    s = packing.sequences(pieces).toPandas()
    assert all(sum(x) == len(i) for x, i in zip(s.lengths, s.ids, strict=True)) and s.ids.map(len).sum() == total


def test_packing_odd(spark):
    odd = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "x", "b"), (4, "x", "b"), (5, "word " * 30000, "a"), (None, "x" * 9000, "a"), (6, "<|endoftext|> Ünï\xa0 中文 1", "b")]
    small = replace(packing.PACK, block_bytes=1 << 12)
    for p in (packing.PACK, small):
        check_pieces(packing.pack(rows_of(spark, odd), p=p).collect(), [r[:2] for r in odd])
    assert packing.pack(rows_of(spark, [])).count() == 0


# phrases


def brute_phrases(rows, p):
    """rows: (text, lang). Counts by loops, scores by big integers."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, p.max_words + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= p.min_count}
        kept = []
        for g, a in cand.items():
            inner = lambda q, g=g: any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1))
            if any(len(q) > len(g) and inner(q) and 100 * b >= p.cover_pct * a for q, b in cand.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for k, (s, a, g, l, r) in enumerate(sorted(kept)[: p.top], 1):
            out.append((lang, k, g.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("p", [replace(phrases.MINING, min_count=3, top=7), replace(phrases.MINING, min_count=2, max_words=4, bucket_bits=9, slice_bits=5, chunk_bytes=300), replace(phrases.MINING, min_count=300, max_words=2)])
def test_phrases_brute(spark, p):
    rnd = random.Random(5)
    words = ["a", "B", "c,", "dd.", "é", "x y", "longer-than-eight", "longer-than-eights", "w\x1cv", "e!", "\v", "\r\n", "\t", " "]
    texts = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", None, "und", "", "de"])) for _ in range(400)]
    texts += [(None, "en"), ("", None), (" \n.", "en"), ("one two three four " * 700, "en"), ("same " * 2000, "de")]
    docs = rows_of(spark, [(i, t, g) for i, (t, g) in enumerate(texts)]).repartition(3)
    got = sorted(map(tuple, phrases.mine(docs, p=p).collect()))
    assert got == brute_phrases(texts, p) and got


def test_phrases_empty_and_exact_beyond_64_bits(spark):
    assert phrases.mine(rows_of(spark, [])).count() == 0
    # a * a * 10^6 passes 64 bits
    a, l, r = 10**13, 3 * 10**13 + 7, 2 * 10**13 + 1
    d = "cast({} as decimal(15,0))"
    x = spark.sql(f"select (cast(1000000 as decimal(7,0)) * {d.format(a)} * {d.format(a)}) div ({d.format(l)} * {d.format(r)}) as s").first().s
    assert x == 10**6 * a * a // (l * r)


def test_phrases_one_word_in_many_tasks(spark):
    docs = rows_of(spark, [(i, "the same words again " * 20, "en") for i in range(300)]).repartition(8)
    got = {r.phrase: r.a for r in phrases.mine(docs).collect()}
    assert got == brute_dict([("the same words again " * 20, "en")] * 300)


def brute_dict(rows):
    return {x[2]: x[3] for x in brute_phrases(rows, phrases.MINING)}


# filter audit


def brute_audit(rows, labels):
    """Every order run over every document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = {}
    for i, t, lang in rows:
        t, w = t or "", re.findall("[^ \t\n\v\f\r]+", t or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (i is None or i > first[t])}
        docs.setdefault(lang or "", []).append((fails, *labels.get(i, (0, 0))))
    out = []
    for part, d in docs.items():
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = d
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(gone)
                failing = [x for x in d if x[0][f]]
                lines.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(x[0].values()) == 1 for x in failing), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


def test_audit_brute(spark):
    rnd = random.Random(9)
    pool = ["", "Word " * 250, "some words " * 150, " ".join(f"w{i}" for i in range(260)), "A# " * 10, "plain text here", "SHOUT " + " ".join(f"v{i}" for i in range(300)), "x | y", "\n\n a \v b"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *pool]), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(1000 + i, pool[1], "en") for i in range(400)]
    marks = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 40, 2)]
    kinds = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([*marks, (1, None, None), (None, 1, 1), (1, None, 1)], kinds)
    want = brute_audit(rows, {i: (q, t) for i, q, t in marks} | {1: (0, 1)})
    docs = rows_of(spark, rows).repartition(5)
    got = filter_audit.orders(filter_audit.interactions(docs, labels))
    assert sorted(map(tuple, got.collect())) == want
    assert filter_audit.orders(filter_audit.interactions(rows_of(spark, []), labels)).count() == 0


def test_audit_words_travel_once(spark):
    """The aggregates by word and by text need no shuffle beyond the one of the texts."""
    plan = filter_audit.word_counts(filter_audit._keyed(common.table(spark, SF, "documents"), "doc_id", "text", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "PythonUDF" not in plan


def test_packing_units_go_many_in_a_call():
    """Units between marks are encoded as one by one, those that hold marks themselves too; a call takes hundreds."""
    import public_tokenizers

    e = packing.UnitEncoder(public_tokenizers.path(packing.PACK.tokenizer), packing.PACK)
    texts = [f" w{i}".encode() for i in range(600)] + [b"<|endoftext|>", b"<|endoftext", b"|>", b" ", b"\xff", "é ".encode(), b"a<|endoftext|>b"] + [f"x{i}'s".encode() for i in range(300)]
    want, calls = e.whole(texts), []
    plain, e.whole = e.whole, lambda few: calls.append(len(few)) or plain(few)
    assert e.joined(texts) == want
    assert sum(calls) <= 256  # only the group with marks goes one by one
