"""Main text of web pages by consensus paths of their hosts.

1. Each page is cut into text blocks; a block's text belongs to its container elements. A container's generalised path is the
   chain of its ancestors as tag.class (digits in classes read as #, hosts without www. or m.). Containers are scored by the
   text they hold in sentences, against the text in links, forms and parts named like menus, notices or comments. The best one is
   widened to the article element around it and to containers that add more text than links and skipped parts, as a headline and lead.
2. Spark aggregates the scores by (host, path), after a partial sum in each task, so a hot host costs no more; each page gives one
   vote, to its best container, so the table has at most as many rows as there are pages. The winner has the most votes.
3. Pages are read again with their host's winning paths (as many as `paths` with `min_share` of the votes), which are broadcast up to
   `broadcast_hosts` hosts; a page that has none of them falls back on its own best container.

Inside the chosen containers the text is that of all blocks but those in parts that are never main text (scripts, styles,
navigation, headers and footers of the page, asides, forms, hidden elements, and elements with a class, id or role that is as a whole
the name of an advert, menu, notice, share bar or reader comments). Such names alone prove little, so a named part (or form) that holds
most of the page's sentence text stays, unless it is of reader comments or an advert beside an article element; and a page all of whose text has
such names is read as if it had none. Named parts have no vote. A part named like a sidebar, menu, header, notice, search or list of
related pages goes if it stands beside the best container (or the article around it) instead of in it, but for one with the page's only
headline, or if most of its text is links, list items or labels; in it, the host decides: a part goes if its text is the same on at least two different
pages and on half of those that have a part of its path. An id that repeats its heading is a mark to link to, and counts as such a name. Character references are decoded, white space inside
a block is one space, blocks are trimmed and joined by a line feed; nothing else is dropped or cut.

Defined results: a null or empty page has the text "" (n_chars 0); a page without any container too. A null or odd URL is the host "".
Repeated pages vote each and get equal texts; an empty table gives an empty table. Equal votes go to the higher score, then to the first
path by code point. Other columns are not read, whatever their names. Work on a page grows with its length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import arrow_map, discard, hot_keys, materialise, table

# Element names of HTML, by how this module treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select button datalist xmp noembed noframes".split())
#: Never part of an article.
SKIP = frozenset("nav footer aside form menu dialog head fieldset search".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that can hold an article.
CONTAINER = frozenset("article main section div td body blockquote".split())
#: An opening tag of the key closes an open one of the values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where one of these begins.
ENDS_P = BLOCK - {"br"}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Words that name parts around an article: reader comments; adverts and offers; parts that are known by their links or lists.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
OWN = frozenset("ad ads consent cookie cookies gdpr login modal newsletter popup signup subscribe".split())
NAMED = frozenset(
    "banner breadcrumb breadcrumbs disclaimer discussion discussions footer header masthead menu nav navbar navigation notice pagination pager recommended related reviews search share sharing sidebar skip "
    "social toolbar topbar widget".split()
)
#: Words that may stand beside them; any other word (with-sidebar, no-header, related-work) makes it another name.
BESIDE = frozenset(
    "a area bar block body bottom box btn button buttons byline cat center column container count customer desktop div form global group holder home icon icons inner item items js label large left level link links list "
    "main middle mobile module outer overlay panel page pages picks policy posts primary reader readers right row secondary section show site slot small sub text thread to top unit user users wrap wrapper".split()
)
#: Words before a name that isn't of a headline's place or of a layout.
BEFORE = frozenset("article content entry in post story".split())
#: Elements whose names say nothing about the text (these only if they name adverts or comments by class).
TEXTUAL = frozenset("p pre blockquote figure figcaption dt dd".split())
NEVER_PART = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")
_PROSE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f]")
# a quote opens a value only right after the equals sign; elsewhere it is a letter like others
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[(.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'>][^\s>]*)?)*)(?:>|$))", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Extract:
    """Production parameters."""

    min_share: float = 0.2  #: of a host's votes a path needs
    paths: int = 4  #: winning paths of a host at most
    depth: int = 8  #: last steps of a path
    broadcast_hosts: int = 200_000  #: hosts whose winners are broadcast; more are joined by shuffle, hot hosts apart


PARAMS = Extract()


@dataclass(eq=False)
class Node:
    tag: str
    steps: tuple[str, ...]  #: last steps of the path
    parent: Node | None
    skip: bool
    link: bool
    article: bool = False  #: in an article or main element, or one itself
    box: Node | None = None  #: innermost container, the node itself included
    kind: str = ""  #: of a part: comments, own, named or form
    part: Node | None = None  #: innermost part, the node itself included
    name: str = ""  #: id of a part that only its id names
    label: str = ""  #: of a part: its own step
    first: str | None = None
    chars: int = 0
    prose: int = 0
    marked: bool = False  #: a part with text of an article or main element
    score: float = 0.0

    @property
    def path(self) -> str:
        return ">".join(self.steps)

    @property
    def outer(self) -> Node | None:
        """The part around a part."""
        return self.parent.part


@lru_cache(1 << 16)
def _kind(token: str) -> str:
    """Kind of part that a class, id or role names as a whole, or ""."""
    words = _LETTERS.findall(_CAMEL.sub("-", token).lower())
    kinds = ["comments" if w in COMMENTS else "own" if w in OWN or w.startswith(("advert", "promo", "sponsor")) else "named" if w in NAMED else "" for w in words]
    before = BEFORE if words and kinds[-1] and words[-1] not in ("header", "sidebar") else frozenset()
    if not any(kinds) or any(not k and w not in BESIDE and w not in before for w, k in zip(words, kinds, strict=True)):
        return ""
    return next(k for k in ("comments", "own", "named") if k in kinds)


def _kinds(text: str) -> str:
    found = {_kind(x) for x in text.split()}
    return next((k for k in ("comments", "own", "named") if k in found), "")


def _step(tag: str, cls: str) -> str:
    words = sorted(set(re.sub(r"\d+", "#", cls.lower()).split()))
    return ".".join([tag, *words])


def parse(page: str, depth: int = PARAMS.depth) -> tuple[list[list[tuple[str, Node]]], list[Node], list[tuple[Node, int]]]:
    """(raw text, innermost element) of each piece of each block in page order; the parts, outer before inner; element and length of skipped text."""
    root = Node("", (), None, False, False)
    stack, out, pieces, parts, skipped = [root], [], [], [], []
    opened: Counter[str] = Counter()
    at, raw_end = 0, None
    lower = None

    def flush():
        if pieces:
            out.append(pieces.copy())
            pieces.clear()

    def push(text):
        node = stack[-1]
        if text and not node.skip:
            pieces.append((text, node))
        elif text:
            skipped.append((node, len(text.strip())))

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            push(page[at:])
            break
        push(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            push(m[1].replace("&", "&amp;"))
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:  # end tag
            k = len(stack) - 1 if opened[tag] else 0
            stop = tag not in BLOCK
            while k > 0 and stack[k].tag != tag:
                if stop and stack[k].tag in BLOCK:
                    k = 0  # inline ends don't close blocks
                    break
                k -= 1
            if tag in BLOCK:
                flush()
            if k > 0:
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k].tag
                    if t == "p" or t in CLOSES.get(tag, ()):
                        opened.subtract(x.tag for x in stack[k:])
                        del stack[k:]
                        break
                    if t in BLOCK:
                        break
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            if len(lower) != n:  # some capitals change length
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                raw_end = end.start() if end else n
            else:
                raw_end = _end_of(lower, tag, at)
            close = page.find(">", raw_end)
            at = n if raw_end >= n or close < 0 else close + 1
            continue
        up = stack[-1]
        found: dict[str, str] = {}
        if m[4]:
            for a in _ATTR.finditer(m[4]):
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")  # the first of a name counts
        cls = found.get("class", "")
        hidden = bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None)
        steps = (*up.steps, _step(tag, cls))[-depth:] if tag in CONTAINER or tag in SKIP or tag == "header" else up.steps
        article = up.article or tag in ("article", "main")
        node = Node(tag, steps, up, up.skip or hidden or tag in SKIP and tag != "form" or tag == "header" and not article, up.link or tag == "a", article, up.box, part=up.part)
        if tag in CONTAINER:
            node.box = node
        if not node.skip:
            node.kind = _part(tag, found, node)
            if node.kind:
                node.part, node.label = node, _step(tag, cls or found.get("id", ""))
                parts.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return out, parts, skipped


def _part(tag: str, found: dict[str, str], node: Node) -> str:
    if tag in NEVER_PART or not found:
        return "form" if tag == "form" else ""
    kind = _kinds(f"{found.get('class', '')} {found.get('role', '')}")
    if tag in TEXTUAL:
        return kind if kind in ("comments", "own") else ""
    if not kind and (kind := _kinds(found.get("id", ""))):
        node.name = found["id"]
    return "form" if tag == "form" and kind != "comments" else kind


def _plain(pieces: list[tuple[str, Node]]) -> tuple[str, bool]:
    """Text of a block, and whether most of it is links."""
    text = _SPACES.sub(" ", html.unescape("".join(t for t, _ in pieces))).strip()
    return text, sum(len(t) for t, n in pieces if n.link) * 2 > sum(len(t) for t, _ in pieces)


def part_path(x: Node) -> str:
    return f"{x.path}|{x.label}"


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


class Page:
    """Blocks of a page, (text, innermost element, mostly links?), as the vote and the extraction see them."""

    def __init__(self, page: str | None, gone: frozenset[str] = frozenset()):
        """gone: paths of parts that the host says are no text."""
        raw, self.parts, self.skipped = parse(page or "")
        self.raw = [(*_plain(pieces), pieces) for pieces in raw]
        parts = self.parts
        if parts:
            self._judge(parts)
        #: Parts that may hold no vote, and those that are no text.
        self.silent = {id(x) for x in parts if x.kind}
        self.dropped = {id(x) for x in parts if x.kind in ("comments", "own", "form") or x.kind and (2 * x.prose < x.chars or gone and part_path(x) in gone)}
        self.text = self._blocks(self.dropped)
        if not self.text:  # names said that all of the page is something else
            forms = {id(x) for x in parts if x.kind == "form"}
            self.silent, self.dropped, self.text = forms, forms, self._blocks(forms)
        self.voting = (self._blocks(self.silent) if self.silent != self.dropped else self.text) or self.text
        self._leave_beside()
        if self.dropped:
            out = self._within(self.dropped)
            self.skipped += [(n, len(t.strip())) for _, _, pieces in self.raw for t, n in pieces if id(n.part) in out]

    def _left(self) -> list[Node]:
        """Named parts that are still text."""
        return [x for x in self.parts if x.kind == "named" and id(x) in self.silent and id(x) not in self.dropped]

    def _leave_beside(self) -> None:
        """Drop the named parts that stand beside the best container, or the article around it."""
        left = self._left()
        if not left or not (best := containers(self.voting)) or best[0][0] <= 0:
            return
        host = next((x for x in _up(best[0][1]) if x.tag == "article"), best[0][1])
        around, known = {id(x) for x in _up(host)}, {}
        inside = lambda n: _around(n, {id(host)}, known) is not None
        heads = [n for _, _, pieces in self.raw for _, n in pieces if n.tag == "h1"]
        titled = set() if any(map(inside, heads)) else {id(u) for n in heads for u in _up(n)}
        beside = {id(x) for x in left if id(x) not in around and id(x) not in titled and not inside(x)}
        if beside:
            self.dropped = self.dropped | beside
            self.text = self._blocks(self.dropped)

    def repeats(self) -> set[tuple[str, int]]:
        """(path, hash of the text) of the named parts that are text."""
        left = {id(x): [] for x in self._left()}
        if not left:
            return set()
        for text, _, pieces in self.raw:
            x = pieces[0][1].part if text else None
            while x is not None:
                if id(x) in left:
                    left[id(x)].append(text)
                x = x.outer
        return {(part_path(x), xxhash.xxh64_intdigest("\n".join(left[id(x)])) >> 1) for x in self.parts if left.get(id(x))}

    def _within(self, those: set[int]) -> set[int]:
        """Those parts and all inside them."""
        out: set[int] = set()
        for x in self.parts:
            if id(x) in those or id(x.outer) in out:
                out.add(id(x))
        return out

    def _blocks(self, without: set[int]) -> list[tuple[str, Node, bool]]:
        out, gone = [], self._within(without)
        for text, linked, pieces in self.raw:
            if gone and any(id(n.part) in gone for _, n in pieces):
                pieces = [(t, n) for t, n in pieces if id(n.part) not in gone]
                text, linked = _plain(pieces)
            if text:
                owner = pieces[0][1]
                while owner.tag in INLINE:
                    owner = owner.parent
                out.append((text, owner, linked))
        return out

    def _judge(self, parts: list[Node]) -> None:
        """What the text of parts says about them: kind "" for those that are none."""
        for text, _, pieces in self.raw:
            x = pieces[0][1].part if text else None
            while x is not None and x.first is None:  # the parts around one that has a first text have one
                x.first, x = text, x.outer
        slug = lambda v: "".join(c for c in v.lower() if c.isalnum())
        for x in parts:
            if x.name and x.kind != "form" and slug(x.name) == slug(x.first or ""):
                x.kind = "named"
        of_comments = self._within({id(x) for x in parts if x.kind == "comments"})
        total, marked = 0, False
        for text, linked, pieces in self.raw:
            prose = not linked and (len(text) >= 40 or _PROSE.search(text) is not None)
            for t, n in pieces:
                size = 0 if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else len(t.strip())
                if not size or id(n.part) in of_comments:
                    continue
                told = size if prose and not n.link else 0
                total += told
                marked = marked or n.article
                if n.part is not None:
                    x = n.part
                    x.marked, x.chars, x.prose = x.marked or n.article, x.chars + size, x.prose + told
        for x in reversed(parts):
            if x.outer is not None:
                x.outer.marked, x.outer.chars, x.outer.prose = x.outer.marked or x.marked, x.outer.chars + x.chars, x.outer.prose + x.prose
        for x in parts:
            beside = x.kind == "own" and marked and not x.marked  # an advert longer than the article
            if x.kind != "comments" and 2 * x.prose > total and not beside:
                x.kind = ""


def _end_of(lower: str, tag: str, at: int) -> int:
    while (k := lower.find(f"</{tag}", at)) >= 0:
        after = lower[k + len(tag) + 2 : k + len(tag) + 3]
        if not after or after in " \t\n\r\f/>":
            return k
        at = k + 1
    return len(lower)


def containers(blocks: list) -> list[tuple[float, Node]]:
    """Score of each container that holds text: its own blocks in full, those of inner containers in part."""
    found: dict[int, Node] = {}
    for text, node, linked in blocks:
        points = -0.5 * len(text) if linked else len(text) + 20 * sum(text.count(c) for c in ".!?,")
        box, new = node.box, []
        if box is None:
            continue
        x = box
        while x is not None and id(x) not in found:  # containers around a known one are known
            x.score = 0.0
            found[id(x)] = x
            new.append(x)
            x = x.parent.box
        box.score += points
    inner: dict[int, int] = Counter(id(x.parent.box) for x in found.values() if x.parent.box is not None)
    ready = [x for k, x in found.items() if k not in inner]
    while ready:  # from the innermost out
        x = ready.pop()
        up = x.parent.box
        if up is not None:
            up.score += x.score * (1.0 if x.tag in ("td", "blockquote") else 0.6)
            inner[id(up)] -= 1
            if not inner[id(up)]:
                ready.append(up)
    return sorted(((x.score * (1.3 if x.tag in ("article", "main") else 1.0), x) for x in found.values()), key=lambda x: -x[0])


def _around(node: Node | None, those: set[int], known: dict[int, Node | None]) -> Node | None:
    """The innermost of those elements around a node, itself included; known: what was found before."""
    seen = []
    while node is not None and id(node) not in those and id(node) not in known:
        seen.append(id(node))
        node = node.parent
    out = known[id(node)] if id(node) in known else node
    known |= dict.fromkeys(seen, out)
    return out


def widen(host: Node, whole: Page) -> Node:
    """The article around the best container, then the outermost container that adds more text than links and skipped parts.

    Skipped parts don't count where the headline is added; from an article or main element only a headline or main leads out.
    """
    host = next((x for x in _up(host) if x.tag == "article"), host)
    above = [x for x in _up(host.parent) if x.tag in CONTAINER]
    if not above:
        return host
    rings = {id(x) for x in (host, *above)}
    plain, bare, heads = Counter(), Counter(), set()  # by innermost ring
    known: dict[int, Node | None] = {}
    for text, node, linked in whole.text:
        ring = _around(node, rings, known)
        if ring is not None:
            plain[id(ring)] += -len(text) if linked else len(text)
            if node.tag == "h1":
                heads.add(id(ring))
    for node, size in whole.skipped:
        ring = _around(node, rings, known)
        if ring is not None:
            bare[id(ring)] += size
    best, gain, lost, head = host, 0, 0, False
    for x in above:
        gain, lost, head = gain + plain[id(x)], lost + bare[id(x)], head or id(x) in heads and id(host) not in heads
        if gain > (0 if head else lost) and (head or x.tag == "main" or host.tag not in ("article", "main")):
            heads |= {id(host)} if head else set()
            best, gain, lost, head = x, 0, 0, False
    return best


def vote(page: str | None) -> tuple[str, float] | None:
    """(path, score) of the page's best container, widened."""
    return _vote(Page(page))


def _vote(whole: Page) -> tuple[str, float] | None:
    best = containers(whole.voting)
    return (widen(best[0][1], whole).path, best[0][0]) if best and best[0][0] > 0 else None


def extract(page: str | None, paths: frozenset[str], gone: frozenset[str] = frozenset()) -> str:
    """Main text of a page by its host's winning paths, without the parts the host says are none."""
    whole = Page(page, gone)
    if not whole.text:
        return ""

    def within(wanted) -> list[str]:
        chosen: dict[int, bool] = {0: False}

        def inside(node) -> bool:
            seen = []
            while (key := id(node) if node is not None else 0) not in chosen:
                seen.append(key)
                if wanted(node):
                    chosen[key] = True
                    break
                node = node.parent
            chosen.update(dict.fromkeys(seen, chosen[key]))
            return chosen[key]

        return [text for text, node, _ in whole.text if inside(node)]

    text = within(lambda n: n.tag in CONTAINER and n.path in paths) if paths else []
    if not text:
        best = containers(whole.voting)
        host = widen(best[0][1], whole) if best else None
        text = within(lambda n: n is host) if best else [t for t, _, _ in whole.text]
    return "\n".join(text)


def host_of(url) -> F.Column:
    """Host in lower case, without user, port and a leading www., m., amp. or mobile.; "" for anything else."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(name, r"^(?:www\d*|m|amp|mobile)\.(?=.*\.)", "")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", p: Extract = PARAMS) -> DataFrame:
    """page_id, url, text. The pages are parsed twice: for the votes, and for the texts."""
    url = F.col(url_col).cast("string")
    d = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col(html_col).alias("html"))

    def votes(batches):
        """A vote a page (part null), and a row for each part whose text the host is asked about."""
        for b in batches:
            rows = []
            for k, x in enumerate(b.column(1)):
                whole = Page(x.as_py())
                if v := _vote(whole):
                    rows.append((k, *v, None, None))
                if asked := whole.repeats():
                    this = xxhash.xxh64_intdigest("\n".join(t for t, _, _ in whole.voting)) >> 1
                    rows += [(k, path, 0.0, h, this) for path, h in asked]
            host = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([host, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds)]], ["host", "path", "score", "part", "page"])

    counted = arrow_map(d.select("host", "html"), votes, "host string, path string, score double, part bigint, page bigint")
    counted = materialise(counted.groupBy("host", "path", "part", "page").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "html-votes")
    ballots = counted.filter("part is null")
    whole = ballots.groupBy("host").agg(F.sum("votes").alias("all"))
    # at most 1 / min_share paths a host are left to be ranked
    best = ballots.join(whole, "host").filter(F.col("votes") >= p.min_share * F.col("all"))
    hosts = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.round("score", 3)).alias("s"), "path"))).alias("ranked"))
    chosen = F.transform(F.slice("ranked", 1, p.paths), lambda x: x["path"])
    # copies of a page say nothing: a text counts once for each different page
    same = counted.filter("part is not null").groupBy("host", "path", "part").agg(F.count("*").alias("n"))
    same = same.groupBy("host", "path").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter((F.col("most") >= 2) & (2 * F.col("most") >= F.col("n")))
    gone = same.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("gone"))
    winners = materialise(hosts.select("host", chosen.alias("paths")).join(gone, "host", "full"), "html-paths")
    discard(counted)
    if winners.count() <= p.broadcast_hosts:
        joined = d.join(F.broadcast(winners), "host", "left")
    else:
        hot = F.broadcast(hot_keys(d.select("host"), ["host"]))
        few = F.broadcast(hot.join(winners, "host", "left"))
        joined = d.join(few, "host").unionByName(d.join(hot, "host", "left_anti").join(winners, "host", "left"))

    def texts(batches):
        for b in batches:
            told = zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            out = [extract(x.as_py(), frozenset(y or ()), frozenset(z or ())) for x, y, z in told]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = dict(d.dtypes)["page_id"]
    return arrow_map(joined.select("page_id", "url", "html", "paths", "gone"), texts, f"page_id {kind}, url string, text string")


def op2(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
