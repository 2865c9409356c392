"""Plain Python versions of the pipeline's stages: a word, line, window or pair at a time, sharing no code with the operators."""

import re

import xxhash

PHRASES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "privacy policy", "read more",
    "share on", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
)
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")


def line_fails(line):
    w, t = words(line), line.strip(SPACE)
    n = len(w)
    if not n:
        return False
    if n < 8 and not re.search("[.!?…:;][\"'”’»)\\]]*$", t):
        return True
    lone = sum(x in list("|>»•·") for x in w)
    if lone >= 3 and lone * 100 >= n * 25:
        return True
    if sum(c in "#*$%&|<>" for c in t) * 100 > n * 50:
        return True
    if n >= 8 and t.count("!") * 100 > n * 30:
        return True
    letters = [c for c in t if c.isascii() and c.isalpha()]
    if n >= 8 and sum(c.isupper() for c in letters) * 100 > len(letters) * 70:
        return True
    if n >= 16 and not len(set(w)) * 100 > n * 25:
        return True
    return n <= 15 and any(p in t.lower() for p in PHRASES)


def clean(text):
    """Text without failing lines, or None if the document is rejected."""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    repeated = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    if len(w) < 10 or len(repeated) * 100 > len(w) * 20:
        return None
    lines = (text or "").split("\n")
    kept = [x for x in lines if not line_fails(x)]
    chars = lambda those: sum(len(x) for y in those for x in words(y))
    return "\n".join(kept) if (chars(lines) - chars(kept)) * 100 <= chars(lines) * 50 else None


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Number of the component of each fingerprint: links of at most 4 bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def contaminated(text, items):
    take = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit = take(text), set()
    windows = {}
    for item in map(take, items):
        n = min(len(item), 13)
        for i in range(len(item) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(item[i : i + n]))
    for n, those in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in those:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)
