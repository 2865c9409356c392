"""The training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF, same
from timeloom.llm import common, decontam, html_extract, language_id, license_scan, mixing, quality_classifier, quality_rules, registry, simhash, toxicity
from timeloom.llm import token_output as to

ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "x", "b"), (4, "x", "b"), (5, "word " * 30000, "a"), (None, "some text here", "a"), (6, "Ünï ñ 中文 1 2", "b")]
KIND = "doc_id bigint, text string, source string, n_words string, kept string, size string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "en") for r in ODD], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df())


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = simhash.op5(spark, SF).toPandas().set_index("doc_id")
    fp = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(int(got.fingerprint[i], 16) == f for i, f in fp.items())
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(got.component_id[i] == find(i) for i in fp)


def test_simhash_links_and_components(spark):
    """Near copies in one dense group, cut into many cells; chains across cells."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(80)}
    fp = np.array(sorted(fps), np.uint64)
    d = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    p = simhash.SimHash(min_cell_rows=16, max_cell_rows=32)
    roots = {r.node: r.root for r in simhash.components(simhash.edges(d, len(fp), p)).collect()}
    label = simhash.link_cells(fp, np.full(len(fp), len(fp)), 4)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = simhash.Forest(len(fp))
    want.add(*np.nonzero(near))
    assert (label == want.label).all()
    mine = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
    groups = lambda v: sorted(sorted(i for i, x in enumerate(v) if x == k) for k in set(v))
    assert groups(mine) == groups(want.label.tolist())


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd)
    assert got.count() == len(ODD) and simhash.near_duplicates(empty).count() == 0
    zero = {r.doc_id for r in got.filter("fp = 0 and component_id = 1").collect()}
    assert zero >= {1, 2, 3}


def test_block_masks_cover():
    p = simhash.SimHash()
    for n in (10, 10**8, 10**12):
        masks = simhash.block_masks(n, p)
        rng = random.Random(n)
        for _ in range(200):
            x = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(not x & m for m in masks)


def test_decontam_odd_and_blocks(spark, odd, empty):
    bench = spark.createDataFrame([(1, "some TEXT here"), (1, "x"), (2, None), (None, "word"), (3, " ".join(f"w{i}" for i in range(20)))], "item_id bigint, text string")
    docs = odd.unionByName(spark.createDataFrame([(9, "a " + " ".join(f"W{i}" for i in range(2, 17)) + " z", "s", "", "", "", "")], KIND))
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(docs, bench, keep=["doc_id"]).collect()}
    assert got >= {(None, 3, 3, 1, True), (4, 1, 1, 1, True), (9, 17, 15, 1, True), (1, 0, 0, 0, False), (5, 30000, 30000, 1, True)}
    small = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(docs, bench, keep=["doc_id"], p=decontam.Winnow(block_bytes=40)).collect()}
    assert small == got
    assert decontam.decontaminate(empty, bench, keep=["doc_id"]).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0), keep=["doc_id"]).filter("contaminated").count() == 0


def test_rules_odd(odd, empty):
    got = quality_rules.quality_rules(odd, carry=tuple(odd.columns))
    assert got.count() == len(ODD) and quality_rules.quality_rules(empty).count() == 0
    five = got.filter("doc_id = 5").first()
    assert five.n_words == 30000 and five.n_repeat_words == 30000 and five.base_failed and not five.kept
    assert got.filter("doc_id = 1").first().n_words == 0


def test_rules_lines(spark):
    good = "This is a clean line of prose that ends well. It has a second sentence too.\n"
    text = good + "Home | About | Contact | Login\n" + "Read more\n" + good.replace("clean", "plain")
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r.n_removed_lines == 2 and "|" not in r.clean_text and "Read more" not in r.clean_text


def whole_ids(e, texts):
    return [x.ids + [2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abAZéÉß×÷ \n\t.,|'`<>’0_-ñ\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=5))
def test_tokens_property(texts):
    e = to.encoder("word_bpe_49k.json", 50)
    data, offsets = common.utf8(pa.array(texts))
    ids, n = to.encode_texts(e, data, offsets, 2)
    cut = np.cumsum(n)
    assert [ids[a - k : a].tolist() for a, k in zip(cut, n, strict=True)] == whole_ids(e, texts)


def test_tokens_round_trip(spark, odd, empty, tmp_path):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = to.op6(spark, SF).toPandas().sort_values("doc_id")
    ids = [np.array(x, "<u4") for x in whole_ids(to.encoder("word_bpe_49k.json", 50), docs.text.tolist())]
    n = np.array([len(x) for x in ids])
    assert (got.n_tokens.values == n).all() and (got.start.values == np.cumsum(n) - n).all()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    path = str(tmp_path / "t")
    to.write_tokens(odd, path)
    assert to.read_tokens(spark, path, [2]).first().tokens == [2]
    assert to.read_index(spark, path).count() == len(ODD) and to.encode_corpus(empty).count() == 0


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), total=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out = total * sum(sizes.values()), {}
    while len(out) < len(sizes):
        free = [s for s in sizes if s not in out]
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
    return out


def check_mix(rows, got, p=mixing.PARAMS):
    """Sizes, targets and totals of a mix against the plain rule. rows: (id, text, source)."""
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = brute_targets(sizes)
    assert sorted(map(str, ((r.doc_id, r.source, r["size"]) for r in got))) == sorted(map(str, ((i, s, size(t)) for i, t, s in rows)))
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) for r in mine)
        assert all(r.copies * r["size"] <= 2 * r["size"] for r in mine)
        largest = max(r["size"] for r in mine)
        assert abs(sum(r.copies * r["size"] for r in mine) - goal[s]) <= max(largest, goal[s] / 200), s


def mixed(spark, rows, p=mixing.PARAMS):
    return mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), p=p).collect()


def test_mixing(spark, odd, empty):
    d = mixing.op10(spark, SF).toPandas()
    assert (d.taken <= 2 * d["size"]).all()
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "source").collect()
    check_mix([tuple(r) for r in docs], mixed(spark, [tuple(r) for r in docs]))
    again = mixing.op10(spark, SF).toPandas()
    assert (again.sort_values("doc_id").taken.values == d.sort_values("doc_id").taken.values).all()
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).columns == odd.columns


def test_mixing_rates_are_tilted(spark):
    """Rates of the solved dual, by a plain bisection: expected copies of documents of one size."""
    rows = [(i, "w " * (1 + i * i % 90), "big" if i % 5 else "small") for i in range(4000)]
    got = mixed(spark, rows)
    check_mix(rows, got)
    own = [r for r in got if r.source == "big"]
    mean = sum(r["size"] for r in own) / len(own)
    rate = lambda x, s: min(2.0, np.exp(x * (s / mean) ** 0.25))
    lo, hi = -5.0, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(r["size"] * rate(mid, r["size"]) for r in own) > own[0].target else (mid, hi)
    for size in (2, 10, 50, 82):
        mine = [r.copies for r in own if r["size"] == size]
        assert abs(sum(mine) / len(mine) - rate(lo, size)) < 5 / len(mine) ** 0.5


def test_mixing_null_repeated_and_equal_rows(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdefgh") * 3 for _ in range(n))
    rows = [(None, words(20), "a") for _ in range(300)] + [(7, words(20), "b") for _ in range(200)] + [(8, "same text " * 5, "b")] * 150 + [(None, "x y", None)] * 400 + [(i, words(30), "c") for i in range(200)] + [(1, None, "c"), (1, "", "d")]
    got = mixed(spark, rows)
    check_mix(rows, got)
    key = lambda rs: sorted(map(str, ((r.doc_id, r.source, r["size"], r.copies) for r in rs)))
    # the same on other partitions, and with tables of sources that are joined by shuffle
    assert key(mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)).collect()) == key(got)
    assert key(mixed(spark, rows, mixing.Mix(max_sources=1))) == key(got)


def crc_part(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = common.table(spark, sf, "documents").select("doc_id", "lang").toPandas()
    d = language_id.op1(spark, sf).toPandas().merge(lang, on="doc_id")
    assert (d.held_out == [crc_part(i, 4, 2) for i in d.doc_id]).all()
    assert (d[d.held_out].lang_pred == d[d.held_out].lang).mean() > 0.97
    labels = common.table(spark, sf, "labels").toPandas()
    q = quality_classifier.op9(spark, sf).toPandas()
    assert len(q) == 1000 and q.score.between(0, 1).all()
    q = q.merge(labels, on="doc_id")
    h = q[q.held_out]
    assert (h.predicted == h.quality).mean() > 0.9


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    bad = ["horribad", "vilescum", "nastygit"]
    rows, y = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        y.append(int(i % 3 == 0))
        if y[-1]:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append(" ".join(t))
    m = toxicity.fit(rows, np.array(y))
    test = ["clean " + " ".join(rng.choice(words) for _ in range(3000)), " ".join(rng.choice(words) for _ in range(500)) + " horribadd", "", None]
    s = [r.score for r in toxicity.score_texts(spark.createDataFrame(list(enumerate(test)), "doc_id int, text string"), m).orderBy("doc_id").collect()]
    assert s[1] >= 0.5 > s[2] and s[2] == s[3] and all(0 <= x <= 1 for x in s)
    assert toxicity.fit([], np.array([])).score(np.zeros(1))[0] < 1e-6
    assert all(not toxicity.fit(["1 2", "3", "4", "horribad"], np.array([0, 0, 0, 1])).score(np.array([z]))[0] >= 0.5 for z in (np.nan, 9.0))  # no clean text has a subword


def test_classifiers_odd(odd, empty):
    m = language_id.fit(["hello world the", "bonjour le monde"] * 10, ["en", "fr"] * 10)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, m).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] in ("en", "fr") and language_id.identify(empty, m).count() == 0
    assert language_id.identify(odd, language_id.fit([], [])).filter("lang_pred <> 'und'").count() == 0
    q = quality_classifier.fit(["good text here", "bad | bad"] * 10, np.array([1, 0] * 10))
    assert quality_classifier.score_texts(odd, q).count() == len(ODD) and quality_classifier.score_texts(empty, q).count() == 0


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use</div><div class="content post-12"><h1>Head &amp; line</h1>
    <p>First  paragraph,<br>with a break. More text here.</p><aside>Side</aside><script>var a="</p>";</script><ul><li>One<li>Two</ul><div class="comments"><p>Nice post!</p></div><form>Search</form></div><footer>F</footer></body></html>"""
    path = html_extract.vote(page)
    assert path[0].endswith("div.content.post-#")
    want = "Head & line\nFirst paragraph,\nwith a break. More text here.\nOne\nTwo"
    assert html_extract.extract(page, frozenset([path[0]])) == want == html_extract.extract(page, frozenset(["other"]))
    assert html_extract.extract(None, frozenset()) == "" == html_extract.extract("<p", frozenset())


def test_html_pages(spark):
    rows = [(1, None, None), (1, "http://www.a.example/x", "<div class=c><p>Some words here. More words.</p></div>"), (2, "http://m.a.example/y", ""), (3, "odd", "plain text")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, ""), (1, "Some words here. More words."), (2, ""), (3, "plain text")]


def test_license_scan(spark, odd, empty):
    t = license_scan.Templates(license_scan.TEMPLATES, license_scan.PARAMS)
    mit = license_scan._MIT_GRANT.replace("free of charge", "free of any charge").replace(", to deal", ",\nto deal")
    text = "Some words.\n" + mit + "\nLICENSED under the apache licence, version 3.1\nLicensed under the Apache License, version 2.1\nmore"
    rows = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert rows.licenses == "Apache-2.0,MIT" and rows.n_matches == 2 and [(x.first_line, x.last_line) for x in rows.spans] == [(1, 2), (4, 4)]
    docs = common.table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = license_scan.op4(spark, SF).toPandas().set_index("doc_id")
    for i, x in zip(docs.doc_id, docs.text, strict=True):
        want = license_scan.scan_text(x, None, t)  # every line, every run
        assert got.n_matches[i] == len(want) and got.licenses[i] == ",".join(sorted({w[1] for w in want}))
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


def test_license_scan_whole_texts(spark, tmp_path):
    full = {k: license_scan.TEMPLATES[k][-1] for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    (tmp_path / "Made-up-1.0.txt").write_text(" ".join(f"clause{'abcdefghij'[i % 10]}{'klmnop'[i % 6]} holds" for i in range(400)))
    templates = license_scan.read_templates(spark, str(tmp_path))
    texts = [("Copyright 2021 A. Person.\n" + t.replace(". ", ".\n") + "\nThe program follows.", k) for k, t in full.items()] + [("x " + templates["Made-up-1.0"][0] + " y", "Made-up-1.0")]
    texts += [(t, k) for k in ("GPL", "LGPL", "AGPL") for t in (license_scan.TEMPLATES[k][0],)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string"), templates=templates).collect()}
    assert [(got[i].licenses, round(got[i].best_score, 6)) for i in range(len(texts))] == [(k, 1.0) for _, k in texts]


def brute_matches(text, t):
    """Every run of words against every template."""
    w = license_scan.words_of(text)
    apart = lambda ranked: [x for i, x in enumerate(ranked) if i in _apart([(y[2], y[3]) for y in ranked])]
    found = []
    for name, b in t.all:
        own = [(license_scan.bigrams(w[i:j]), i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        runs = [((g & b).total(), s, i, j, name) for g, i, j in own if (s := license_scan.dice(g, b)) >= t.p.threshold]
        found += apart(sorted(runs, key=lambda x: (-x[1], x[2] - x[3], x[2])))
    return [(x[1], x[4]) for x in sorted(apart(sorted(found, key=lambda x: (-x[0], -x[1], *x[2:]))), key=lambda x: x[2])]


def _apart(runs):
    out = []
    for k, (i, j) in enumerate(runs):
        if all(j <= runs[m][0] or runs[m][1] <= i for m in out):
            out.append(k)
    return out


def test_license_scan_within_lines(spark):
    mit = license_scan._MIT_GRANT
    rows = [
        (1, "Copyright 2023 Acme Corp. All rights reserved.", "Proprietary", 1.0, [(0, 0)]),
        (2, "Parser module by Ann Lee. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1.0, [(0, 0)]),
        (3, "We thank all who helped. " * 30 + mit + " And so the story went on." * 30, "MIT", 1.0, [(0, 0)]),
        (4, "word " * 5000 + "all rights reserved " + "word " * 5000 + "Released under the MIT License. " + "word " * 5000, "MIT,Proprietary", 1.0, [(0, 0), (0, 0)]),
        (5, "One line.\nBy Ann Lee, licensed under the\nApache License, Version 2.0, in 2020", "Apache-2.0", 1.0, [(1, 2)]),
        (6, "all rights were reserved, licensed under the sea", "", 0.0, []),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    for i, _, names, score, lines in rows:
        assert (got[i].licenses, got[i].best_score, [(x.first_line, x.last_line) for x in got[i].spans], got[i].n_matches) == (names, score, lines, len(lines))


def test_license_scan_brute():
    t = license_scan.Templates(license_scan.TEMPLATES | {"One": ("Copyleft",)}, license_scan.PARAMS)
    rng = random.Random(1)
    short = [x for v in license_scan.TEMPLATES.values() for x in v if len(x) < 130]
    texts = []
    for _ in range(25):
        w = []
        for _ in range(3):
            x = rng.choice(short).split()
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice(["foo", "the", "License", "copyleft"])
            w += x + rng.choices(["foo", "the", "a", "license"], k=rng.randrange(4))
        texts.append(" ".join(w))
    data, offsets = common.utf8(pa.array(texts))
    near = license_scan.candidates(data, offsets, t)
    for k, x in enumerate(texts):
        got = license_scan.scan_text(x, near.get(k, []), t)
        assert [(s, n) for s, n, _, _ in got] == brute_matches(x, t) and got == license_scan.scan_text(x, None, t)


PROSE = "A sentence that says something new. " * 8


def own_text(page):
    v = html_extract.vote(page)
    return html_extract.extract(page, frozenset([v[0]] if v else []))


@pytest.mark.parametrize("cls", ["content with-sidebar", "has-header", "no-sidebar page", "widget", "notice"])
def test_html_wrappers_named_by_parts(cls):
    assert own_text(f'<body><nav><a href=x>Menu</a></nav><div class="{cls}"><p>{PROSE}</p></div></body>') == PROSE.strip()


def test_html_parts_inside_article():
    page = f"""<article><h1>T</h1><p>{PROSE}</p><section id="related-work"><h2>Related work</h2><p>Earlier work is here.</p></section><h2 id="search">Search</h2>
    <p class="notice">Mind this.</p><section id="comments"><h2>Comments</h2><p>They begin with a hash sign.</p></section><div title="the hidden cost" data-x='class="ad"'>Cost text.</div>
    <div class="related"><a href=x>Other page</a></div><div class="share">Share</div><div class="ad">Buy this now.</div><div class="post-comments"><p>Nice post! {PROSE * 3}</p></div><div hidden>Unseen.</div></article>"""
    assert own_text(page).split("\n") == ["T", PROSE.strip(), "Related work", "Earlier work is here.", "Search", "Mind this.", "Comments", "They begin with a hash sign.", "Cost text."]


def test_html_fallbacks():
    assert own_text(f"<form id=aspnetForm><div class=search>Search</div><div><p>{PROSE}</p></div></form>") == PROSE.strip()
    assert own_text("<div class=notice>Only this</div>") == "Only this" and own_text("<nav>x</nav>") == ""


HEAD, LEAD, BODY = "A headline of some fifty characters for this page", "The lead says what it is about. " * 6, "\n".join([PROSE.strip()] * 10)


@pytest.mark.parametrize(
    "page",
    [
        "<nav><a href=x>Home</a></nav><article><h1>{h}</h1><p>{l}</p><div class='entry-content'>{b}</div></article>",
        "<nav>{n}</nav><div class=page><h1>{h}</h1><p>{l}</p><div class='entry-content'>{b}</div></div><footer>{n}</footer>",
        "<body><nav>{n}</nav><h1>{h}</h1><p>{l}</p><div class=text>{b}</div><div><ul><li><a href=x>Other page of the site</a></ul></div>",
        "<main><h1>{h}</h1><p>{l}</p><article><div>{b}</div></article></main><div><p>A teaser. It is short.</p></div>",
        "<article><header><h1>{h}</h1></header><section><p>{l}</p></section><section><div>{b}</div></section></article>",
    ],
)
def test_html_headline_and_lead_outside_body(page):
    page = page.format(h=HEAD, l=LEAD, b="".join(f"<p>{x}</p>" for x in BODY.split("\n")), n="<a href=x>Menu</a> " * 40)
    text = own_text(page).split("\n")
    assert text[:12] == [HEAD, LEAD.strip(), *BODY.split("\n")]
    assert not any("Menu" in x or "teaser" in x for x in text)


def test_html_frame_of_links_stays_out():
    rest = "<div><a href=x>One</a></div><div><a href=x>Another page</a></div><footer>Imprint of the firm</footer><p>Made here.</p>"
    page = f"<body><div class=text><h1>{HEAD}</h1><p>{PROSE}</p></div>{rest}"
    assert own_text(page) == f"{HEAD}\n{PROSE.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="wrap has-sidebar"><p>{p}</p></div>', '<div class="post comments-open"><p>{p}</p></div>', '<div id="search-content"><p>{p}</p></div>',
        "<form id=aspnetForm action=/x><article><p>{p}</p></article></form>", '<p title=5">{p}</p><p class="">', "<div data-x=a=\"b><p it's>{p}</p></div>", "<a href='/x?a=\"1'></a><p>{p}</p>",
    ],
)
def test_html_wrapped_and_odd_quotes(page):
    assert own_text("<body>" + page.format(p=PROSE) + "</body>") == PROSE.strip()


def test_html_deep_nesting_is_linear():
    import time

    def seconds(n):
        page = "".join(f'<div class="ad x{i}">Some text here. <b>More</b></section>' if i % 7 == 0 else "<div class=a>Some text here.</em>" for i in range(n))
        began = time.process_time()
        assert "Some text here." in own_text(page)
        return time.process_time() - began

    assert seconds(12000) < 12 * max(seconds(2000), 0.05)


def test_html_odd_tables(spark):
    kind = "page_id bigint, url string, html string, host string, paths string, text string"
    good = f"<div class=c><p>{PROSE}</p></div><div class=d><p>Less of it.</p></div>"
    rows = [(i, f"http://a.example/{i}", good, "h", "p", "t") for i in (1, 1, None, 2)] + [(3, "//B.example:80/x", f"<div class=c>{PROSE}</div>", "h", "p", "t"), (3, "//b.example/y", f"<div class=d>{PROSE}</div>", "h", "p", "t")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, kind)).collect()
    assert sorted(str((r.page_id, r.text)) for r in got) == sorted(str((r[0], PROSE.strip())) for r in rows)
    assert html_extract.extract_pages(spark.createDataFrame([], kind)).count() == 0
    shuffled = html_extract.extract_pages(spark.createDataFrame(rows, kind), p=html_extract.Extract(broadcast_hosts=0)).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_html_every_page_by_the_winners(spark):
    """The query against votes and winners worked out in Python."""
    got = {r.page_id: r.text for r in html_extract.op2(spark, SF).collect()}
    assert got == texts_of_hosts([(r.page_id, r.url, r.html) for r in common.table(spark, SF, "pages").collect()])


def texts_of_hosts(pages):
    """page_id: text, with everything about hosts in plain Python. pages: (page_id, url, html)."""
    import re
    from collections import Counter, defaultdict

    host = lambda u: re.sub(r"^(?:www\d*|m|amp|mobile)\.(?=.*\.)", "", (re.match(r"(?:\w+:)?//([^/:]*)", u or "") or ["", ""])[1].lower())
    votes, scores, parts = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for _, url, page in pages:
        whole = html_extract.Page(page)
        if v := html_extract.vote(page):
            votes[host(url)][v[0]] += 1
            scores[host(url)][v[0]] += v[1]
        for path, text in whole.repeats():
            parts[host(url)][path][text].add(tuple(t for t, _, _ in whole.voting))
    want, gone = {}, {}
    for h, c in votes.items():
        ranked = sorted(c, key=lambda p: (-c[p], -round(scores[h][p], 3), p))
        want[h] = frozenset([p for p in ranked if c[p] >= 0.2 * c.total()][:4])
    for h, by_path in parts.items():
        counts = {p: [len(x) for x in texts.values()] for p, texts in by_path.items()}
        gone[h] = frozenset(p for p, n in counts.items() if max(n) >= 2 and 2 * max(n) >= sum(n))
    return {i: html_extract.extract(page, want.get(host(url), frozenset()), gone.get(host(url), frozenset())) for i, url, page in pages}


LETTER = "Subscribe to our weekly letter today. It is full of good advice for all readers."
BESIDE_NAMES = ["sidebar", "sidebar widget-area", "notice", "header", "site-header", "footer", "menu", "related", "widget", "disclaimer", "banner", "share", "cookie-notice", "newsletter", "comment", "user-reviews discussion"]


@pytest.mark.parametrize("cls", BESIDE_NAMES)
@pytest.mark.parametrize("frame", ["{a}{b}", "<div class=page>{a}{b}</div>", "<div class=page>{b}{a}</div>", "<div class=page><main>{a}</main>{b}</div>"])
def test_html_named_parts_with_sentences_beside_the_article(cls, frame):
    a, b = f'<div class="content"><h1>{HEAD}</h1><p>{PROSE}</p></div>', f'<div class="{cls}"><p>{LETTER}</p></div>'
    assert own_text(f"<body>{frame.format(a=a, b=b)}</body>") == f"{HEAD}\n{PROSE.strip()}"


def test_html_comments_heading_and_headline_in_a_header():
    article = f"<div class=content><p>{PROSE}</p></div>"
    assert own_text(f'<body><h1>{HEAD}</h1>{article}<div id="comments"><h3>Comments</h3><div class=comment>Nice.</div></div></body>') == f"{HEAD}\n{PROSE.strip()}"
    assert own_text(f'<div class=page><div class="header"><h1>{HEAD}</h1><p>{LEAD}</p></div>{article}</div>').split("\n") == [HEAD, LEAD.strip(), PROSE.strip()]


def test_html_hosts_decide_on_parts_inside(spark):
    """Ten pages a host: what stands in the article under a name goes if it is the same on other pages, and stays if it is the page's own."""
    body = lambda i: "".join(f"<p>Page {i} tells of thing {k}, and says what there is to say about it.</p>" for k in range(6))
    page = lambda i, cls, note: f'<body><div class=page><div class="content"><h1>Title {i}</h1>{body(i)}<div class="{cls}"><p>{note}</p></div></div></div></body>'
    own = lambda i: f"This holds for page {i} alone. Mind it well, reader {i}."
    rows = []
    for h, cls in enumerate(["notice", "widget", "banner", "disclaimer"]):
        rows += [(f"http://same{h}.example/{i}", page(i, cls, LETTER)) for i in range(10)]
        rows += [(f"http://own{h}.example/{i}", page(i, cls, own(i))) for i in range(10)]
        rows += [(f"http://copies{h}.example/{i}", page(7, cls, own(7))) for i in range(10)]
        rows += [(f"http://beside{h}.example/{i}", page(i, "x", own(i)).replace("</div></div></body>", f'</div><div class="{cls}"><p>{own(i)}</p></div></div></body>')) for i in range(10)]
    rows = [(i, u, x) for i, (u, x) in enumerate(rows)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == texts_of_hosts(rows)
    for i, url, _ in rows:
        kind, k = url.split("//")[1].split("/")[0].rstrip(".example").rstrip("0123"), int(url.rsplit("/", 1)[1])
        k = 7 if kind == "copies" else k
        lines = [f"Title {k}", *[f"Page {k} tells of thing {j}, and says what there is to say about it." for j in range(6)]]
        assert got[i].split("\n") == lines + ([] if kind == "same" else [own(k)]), (url, got[i])


# ---------------------------------------------------------------- hot keys and odd tables

LINE = "a line of plain words that says one thing and ends here. "


def test_hot_copies_and_hot_ids(spark):
    """100,000 copies of a text under different ids, 100,000 different texts under one id: every row comes out, whole."""
    n = 100_000
    copies = spark.range(n).selectExpr("id doc_id", f"'{LINE * 3}' text")
    one_id = spark.range(n).selectExpr("cast(-5 as bigint) doc_id", "concat('text number ', id, ' of one id') text")
    d = copies.unionByName(one_id).unionByName(spark.createDataFrame([(n + 1, LINE * 3), (n + 2, None)], "doc_id bigint, text string"))
    got = simhash.near_duplicates(d)
    groups = got.groupBy("doc_id").agg({"component_id": "max", "*": "count"}).filter(f"doc_id >= {n} or doc_id = -5 or doc_id < 3").collect()
    assert got.count() == 2 * n + 2
    per = {r.doc_id: (r["max(component_id)"], r["count(1)"]) for r in groups}
    assert per[0] == per[1] == per[n + 1] == (0, 1) and per[n + 2] == (n + 2, 1) and per[-5][1] == n
    rows = to.token_rows(d)
    sizes = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert sum(sizes) == 2 * n + 2 and max(sizes) < 0.55 * (2 * n + 2)
    assert rows.filter("doc_id = -5").select("shard").distinct().count() > 1
    digest = to.encode_corpus(d)
    order = digest.orderBy("start").select("doc_id", "start", "n_tokens").toPandas()
    assert (order.start.values == np.cumsum(order.n_tokens.values) - order.n_tokens.values).all() and order.doc_id.is_monotonic_increasing


def test_stars_of_one_centre(spark):
    n = 20_000
    links = spark.range(1, n).selectExpr("id a", "cast(0 as bigint) b").unionByName(spark.range(1, 500).selectExpr(f"id + {n} a", f"id + {n} - 1 b"))
    roots = simhash.components(links)
    assert roots.filter("root = 0").count() == n - 1 and roots.filter(f"root = {n}").count() == 499


def test_samples_of_repeated_ids(spark):
    """An id with most of the rows neither floods the sample nor takes its label away; equal texts come once; bounds hold."""
    from timeloom.llm.sampling import labelled_sample

    hot = spark.range(60_000).selectExpr("cast(7 as bigint) doc_id", "concat('hot ', id % 30000) text", "'en' label")
    few = spark.range(2_000).selectExpr("id + 100 doc_id", "concat('few ', id) text", "case when id % 2 = 0 then 'fr' end label")
    docs = hot.unionByName(few)
    t, counts = labelled_sample(docs, None, 300, 1000)
    by = {k: [x for x, y in zip(t["text"].to_pylist(), t["label"].to_pylist(), strict=True) if y == k] for k in ("en", "fr")}
    assert counts == {"en": 60_000, "fr": 1_000} and len(by["fr"]) == 300 and 150 < len(by["en"]) <= 300 and len(set(by["en"])) == len(by["en"])
    labels = spark.createDataFrame([(7, 1), (None, 1), (9, None), *[(100 + i, i % 2) for i in range(900)]], "doc_id bigint, label int")
    t, counts = labelled_sample(docs.select("doc_id", "text"), labels, 200, 1000)
    y = t["label"].to_pylist()
    assert counts == {0: 450, 1: 451} and y.count(0) == 200 == y.count(1) and len(set(t["text"].to_pylist())) == 400
    again, _ = labelled_sample(docs.select("doc_id", "text").repartition(5), labels, 200, 1000)
    assert again["text"].to_pylist() == t["text"].to_pylist()
    assert len(labelled_sample(docs.limit(0).select("doc_id", "text"), labels, 5, 10)[0]) == 0 == len(labelled_sample(docs, None, 5, 1)[0])


def test_classifier_queries_on_odd_tables(spark, tmp_path):
    """op1, op7 and op9 as queries: empty tables, null and repeated ids, nulls, clashing columns; every row comes out."""
    rng = random.Random(2)
    words = {"en": "the and of house water", "fr": "le et maison eau de"}
    rows = [(i % 190, " ".join(rng.choices(words[k].split(), k=12)) + (" vilescum" if i % 7 == 0 else ""), k, "s", "clash", "clash", "clash") for i in range(200) for k in (("en", "fr")[i % 2],)]
    rows += [(None, "the house", "en", None, "", "", ""), (201, None, "en", "s", "", "", ""), (202, "", None, "s", "", "", ""), (203, "1 2 3", "fr", "s", "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, label string, score string, u string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(190)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for name, d, l in (("full", docs, labels), ("none", docs, labels.limit(0)), ("empty", docs.limit(0), labels)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        l.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for run, cut in ((language_id.op1, None), (toxicity.op7, 0.5), (quality_classifier.op9, 0.3)):
            got = run(spark, f"{tmp_path}/{name}").collect()
            assert len(got) == (0 if name == "empty" else len(rows)) and all(0 <= r.score <= 1 for r in got)
            for r in got:
                mod, k = (4, 2) if cut is None else (5, 0)
                assert r.held_out == (r.doc_id is not None and crc_part(r.doc_id, mod, k))
                assert cut is None or r.predicted == int(r.score >= cut)
                assert cut is not None or (r.lang_pred == "und") == (r.doc_id in (201, 202, 203))


def plain_bags(text, sizes, buckets):
    """Hashed subwords of one text, character by character in Python."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    padded, shift, out = b" " + raw + b" ", 64 - buckets.bit_length() + 1, []
    for n in sizes:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if b" " in gram[1:-1] or gram[0] == gram[-1] == 32:
                continue
            h = 0
            for b in gram:
                h = (h * 0x9E3779B97F4A7C15 + b + 1) & mask
            out.append(mix(h + n & mask) >> shift)
    for word in raw.split():
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & mask
        out.append(mix(h + 77 & mask) >> shift)
    return out


def test_subword_scores_plain(spark):
    """Language scores of whole texts, very long ones too, against sums over plain subwords."""
    rng = np.random.default_rng(5)
    p = language_id.LanguageId(buckets=1 << 12)
    m = language_id.Model(["a", "b", "c"], rng.normal(size=(p.buckets, 3)), rng.normal(size=3), 0.7, 0.0)
    texts = ["Héllo, wörld of words", "x", "don't stop 12 me-now ÀÉ", "long words " * 70000, "中文 text", "a" * 700000 + " b"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), m, p=p).collect()}
    for i, t in enumerate(texts[:5]):
        whole = t if len(t) < 1000 else None
        b = plain_bags(whole, p.sizes, p.buckets) if whole else plain_bags("long words " * 7, p.sizes, p.buckets)
        z = (m.table[b].mean(axis=0) + m.bias) / 0.7
        s = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == m.languages[s.argmax()] and got[i].score == pytest.approx(s.max())
    assert 0 < got[5].score <= 1


def test_quality_scores_plain(spark):
    """Quality scores against a plain sum over words, pairs, shapes and repeats, with the same hashes of single strings."""
    rng = np.random.default_rng(6)
    p = quality_classifier.Ftrl(buckets=1 << 12)
    m = quality_classifier.Model(rng.normal(size=p.buckets), 0.1)

    def one(text):  # features of one or two words alone, from which longer texts are put together
        data, offsets = common.utf8(pa.array([text]))
        return sorted(quality_classifier.features(data, offsets, p.buckets)[0].tolist())

    for t in ("One two  two, three! 3x3", "word", "", "A\tb\nc " * 400, "é É x"):
        w = t.encode().split()
        ones = [one(x.decode()) for x in w]
        pairs = [sorted(one(f"{a.decode()} {b.decode()}")) for a, b in zip(w, w[1:], strict=False)]
        want = [k for x in ones for k in x]
        for (a, b), pair in zip(zip(ones, ones[1:], strict=False), pairs, strict=True):
            rest = list(pair)
            for k in (*a, *b):
                rest.remove(k)
            want += rest
        z = m.weight[want].sum() / max(len(w), 1) + 0.1
        got = quality_classifier.score_texts(spark.createDataFrame([(1, t)], "doc_id int, text string"), m, p=p).first().score
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def test_toxicity_scores_plain(spark):
    """Worst segment of each text against plain subwords dealt to segments by the word they belong to."""
    rng = np.random.default_rng(7)
    p = toxicity.Toxicity(buckets=1 << 12, chunk_bytes=400)
    weight = rng.normal(size=p.buckets)
    texts = ["some words here and there, vilescum!", "", "1 2", "x", "a longer text of many small words " * 8, "Ünï çödé words"]
    data, offsets = common.utf8(pa.array(texts))
    got = toxicity.worst(weight, 0.3, data, offsets, p)
    for t, g in zip(texts, got, strict=True):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
        per = max(-(-len(raw) // p.segment), 1)
        segs = {}
        for n in (*p.sizes, 0):
            padded = b" " + raw + b" "
            for i in range(len(padded)):
                gram = padded[i : i + n]
                word = n == 0 and padded[i] != 32 and padded[i - 1] == 32
                if word:
                    gram = padded[i:].split(b" ")[0]
                elif n == 0 or len(gram) < n or b" " in gram[1:-1] or gram[0] == gram[-1] == 32:
                    continue
                start = max(k for k in range(i + 1) if padded[k] == 32)  # the space before the word
                segs.setdefault(min(start // p.segment, per - 1), []).append((gram, word))
        if not segs:
            assert np.isnan(g)
            continue
        score = lambda gram, word: weight[_hash(gram, word, p.buckets)]
        assert g == pytest.approx(max(np.mean([score(a, w) for a, w in x]) for x in segs.values()) + 0.3)


def _hash(gram, word, buckets):
    mask = (1 << 64) - 1
    if word:
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(gram)) + 77 & mask
    else:
        h = 0
        for b in gram:
            h = (h * 0x9E3779B97F4A7C15 + b + 1) & mask
        h = h + len(gram) & mask
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & mask
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & mask
    return (h ^ h >> 31) >> 64 - buckets.bit_length() + 1


def test_decontam_clashing_names_and_long_items(spark):
    item = " ".join(f"u{i}" for i in range(3000))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (3, "u5 u6")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(700, 730)), "a", "b"), (2, "x u5 u6 y", "a", "b"), (2, "x u5 u6 y", "a", "b"), (None, "clean words", "a", "b")], "doc_id bigint, text string, __text string, t string")
    for p in (decontam.PARAMS, decontam.Winnow(block_bytes=8000)):
        got = decontam.decontaminate(docs, bench, p=p)
        assert got.columns[:4] == docs.columns
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()) == [("1", 30, 30, 2, True), ("2", 4, 2, 1, True), ("2", 4, 2, 1, True), ("None", 2, 0, 0, False)]
        assert decontam.decontaminate(docs, bench, only_clean=True, p=p).collect() == docs.filter("doc_id is null").collect()


def test_other_tokenizers_encode_whole_texts(spark):
    import os

    import public_tokenizers

    own = public_tokenizers.path("word_bpe_49k.json")
    for path in sorted(x for x in (os.path.join(os.path.dirname(own), n) for n in os.listdir(os.path.dirname(own))) if x.endswith(".json") and x != own)[:2]:
        try:
            e = to.PieceEncoder(path, 50)
        except Exception:  # noqa: BLE001 - not a tokenizers file
            continue
        texts = ["Hello, World!  two", "", "é中\n x"]
        data, offsets = common.utf8(pa.array(texts))
        ids, n = to.encode_chunk(e, data, offsets, to.FORMAT)
        cut = np.cumsum(n)
        assert [ids[a - k : a].tolist() for a, k in zip(cut, n, strict=True)] == whole_ids(e, texts)
