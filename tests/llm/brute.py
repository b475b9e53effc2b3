"""Plain Python statements of the operators' results, and odd inputs."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def groups(docs, k, percent):
    """{doc_id: (set size, component, kept)} from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[tuple(sorted((own[x], own[y])))] += 1
    u = Union()
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            u.link(a, b)
    return {i: (len(s), u.find(i), u.find(i) == i) for i, s in sets.items()}


def top_products(rows, k, scale=1024):
    """Sorted (query id, rank, id, score), in Python's integers; a row is left out of its own candidates only."""
    import math

    low, high = -(2**63), 2**63 - 1
    bound = lambda x: min(max(x, low), high)
    good = [(i, [bound(math.floor(scale * x)) if math.isfinite(scale * x) else (high if x > 0 else low) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-bound(sum(a * b for a, b in zip(v, w, strict=False))), j) for r, (j, w) in enumerate(good) if r != q)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def page_text(page):
    """Text of the pages of the test tables: all of the article element."""
    m = re.search(r"<article[^>]*>(.*?)(</article>|\Z)", page or "", re.DOTALL)
    body = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", " ", m[1] if m else "", flags=re.DOTALL)
    blocks = re.split(r"</?(?:p|h\d|br|div|li|ul)\b[^>]*>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def base_spans(text):
    t = text or ""
    assign = [m for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.IGNORECASE | re.ASCII) if len(m[1]) >= 6]
    access = [m for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    hexes = [m for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    kinds = [assign, access, hexes]
    spans = sorted((m.start(), k, m.end()) for k, found in enumerate(kinds) for m in found)
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, kinds), sha256(listed.encode()).hexdigest(), listed)


def leaks(docs, items, coverage=0.6, run=12, run_equal=8):
    """{(document, item): matched places of the item} over all alignments that count; texts and items are word lists."""
    out = {}
    for d, text in docs.items():
        for i, item in items.items():
            n, places = len(item), set()
            for shift in range(1 - n, len(text)):
                at = [k for k in range(n) if 0 <= shift + k < len(text) and text[shift + k] == item[k]]
                enough = len(at) == n if n < 5 else 100 * len(at) >= 100 * coverage * n
                if enough or any(b - a < run for a, b in zip(at, at[run_equal - 1 :], strict=False)):
                    places |= set(at)
            if places and (len(places) == n if n < 5 else len(places) >= coverage * n):
                out[d, i] = len(places)
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """{source: target} by refilling until no source is above twice its size. sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    open_ = set(order)
    while open_:
        level = (left - sum(full.values())) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not above:
            return full | {s: level * w[s] for s in open_}
        full |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return full


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
