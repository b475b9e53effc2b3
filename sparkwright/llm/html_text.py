"""Main text of HTML pages by equivalence-class template deduction.

Tokens of a page are its tags, told apart by their path from the root, and its pieces of text, told apart by path and
wording. Over all pages of a host, a token's occurrence vector says how often it stands on each page. Tokens with equal
vectors form an equivalence class. A class is valid if it stands on at least MIN_PAGES pages, on more than one kind of
page, and has a tag and at least one other token.

Valid classes are nested by the paths of their tags: a class lies in the slot of the container tag above it. The host's
article slot is found by going down that nesting from the page's root: of the valid classes' container tags that stand
once on each of their pages, the deepest that still holds SLOT_SHARE of the host's running text (a named article ends
the descent). What stands in that slot is extracted from each page; the text that belongs to valid classes (a heading
such as "Read this next", a licence line, a cookie notice) is part of the template and is not.

Vectors are never built: a token carries the exclusive or of a hash of (page, count), so equal vectors have equal
signatures, and the sum is combined map-side. Pages without the host's slot, and hosts without a template, give their
named articles, or else all of their text. In all of them, what stands inside an element that holds no article (menus,
forms, adverts and the like) is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import textkernel as K
from sparkwright.llm.toxicity import _parts
from sparkwright.llm.workspace import Workspace, trimmed

#: Pages that a class, and distinct pages that a host must have for a template.
MIN_PAGES = 5
#: Share of a host's running text that its article slot holds at least.
SLOT_SHARE = 0.7
#: Template tokens of all hosts up to which they are broadcast.
BROADCAST_TOKENS = 1_000_000

# fixed values: elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_ARTICLE_TAGS = frozenset("head nav header footer aside form button select option menu dialog svg canvas object template figure-ad".split())
NOT_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead header footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus reply replies "
    "respond related recommended share sharing social widget toolbar pagination pager search hidden".split()
)
#: Words that say where a part is or what form it has; a name of such words and at least one of the above is a role.
NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right primary secondary post entry article user reader box list bar area block section container wrapper wrap inner outer slot unit "
    "item items form links link content body title thread text js the".split()
)
#: Elements that can be an article slot, and those that are never left out.
CONTAINERS = frozenset("body div section article main td center".split())
NEVER_OUTSIDE = frozenset(("html", "body"))
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")


def is_role(name: str) -> bool:
    """Whether one class name or id says that an element is no part of an article: "site-footer" does, "no-sidebar" not."""
    words = _WORD.findall(name)
    return any(w in NOT_ARTICLE_WORDS for w in words) and all(w in NOT_ARTICLE_WORDS or w in NEUTRAL_WORDS for w in words)


class Element(NamedTuple):
    """What the element of a path is: path hash, left out by its tag or role, left out by its names, names an article,
    can be a slot."""

    path: int
    tagged: bool
    named: bool
    article: bool
    container: bool


class Paths:
    """Elements by their paths, remembered per worker."""

    def __init__(self) -> None:
        self._known: dict[tuple, Element] = {}

    def of(self, parent: int, tag: str, attributes: str) -> Element:
        key = (parent, tag, attributes)
        got = self._known.get(key)
        if got is None:
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
            role, names = found.get("role", ""), f"{found.get('class', '')} {found.get('id', '')}".split()
            tagged = tag in NOT_ARTICLE_TAGS or role in NOT_ARTICLE_ROLES or "hidden" in found
            article = not tagged and (tag in ("article", "main") or role in ("main", "article"))
            named = tag not in NEVER_OUTSIDE and any(map(is_role, names))
            kind = " ".join((tag, found.get("class", ""), role))
            got = Element(xxhash.xxh64_intdigest(kind, seed=parent), tagged, named, article, tag in CONTAINERS)
            if len(self._known) < 200_000:
                self._known[key] = got
        return got


class Frame(NamedTuple):
    """An open element: tag, path hash, depth, and of its content: left out since the page's start, since the innermost
    named article, since the host's slot; in a named article, in a slot, in a link."""

    tag: str
    path: int
    depth: int
    out: bool
    out_article: bool
    out_slot: bool
    article: bool
    slot: bool
    link: bool


def parse(page: str, paths: Paths, slot: int | None = None, names: bool = True):
    """Yield ("tag", element, parent frame), ("break",) and ("text", frame, raw text), in page order.

    A closing tag closes the nearest open element of its name and all inside it; one without an open element is ignored.
    Elements that are never closed stay open to the end. Contents of scripts, styles and the like are skipped. Without
    ``names``, the names of elements around an article or a slot say nothing.
    """
    stack = [Frame("", 0, 0, False, False, False, False, False, False)]
    opened: Counter = Counter()
    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond, so none is looked for there
    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        end = m.start() if m else page.find("<!--", at) % (n + 1)  # a comment that is never closed ends the text
        if end > at:
            yield ("text", stack[-1], page[at:end])
        if not m:
            return
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            return
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if tag not in INLINE:
            yield ("break",)
        if closing:
            while opened[tag]:
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag == "p" and stack[-1].tag == "p":
            stack.pop()
            opened["p"] -= 1
        top = stack[-1]
        own = paths.of(top.path, tag, attributes)
        yield ("tag", own, top)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at, last)
            at = close.end() if close else n
        elif tag not in VOID and not attributes.endswith("/"):
            here = own.path == slot
            without = own.tagged or (own.named and not own.article and not here and (names or top.article or top.slot))
            # an article in a part that is left out, such as a menu or a comment, is none
            article = own.article and not top.out_article
            stack.append(
                Frame(
                    tag,
                    own.path,
                    top.depth + 1,
                    top.out or without,
                    not article and (top.out_article or without),
                    not here and (top.out_slot or (without and top.slot)),
                    top.article or article,
                    top.slot or here,
                    top.link or tag == "a",
                )
            )
            opened[tag] += 1


def text_token(path: int, raw: str) -> int | None:
    own = _SPACE.sub(" ", raw).strip()
    return xxhash.xxh64_intdigest(own, seed=path ^ 0x9E3779B97F4A7C15) if own else None


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_OCCURRENCES = "host string, token long, kind int, vector long, pages long, low long, high long, times long, chars long, depth int, article int"


def _page_tokens(page: str, content: int, paths: Paths) -> dict[tuple[int, int], list]:
    """{(token, kind): [count, characters of running text below, depth, names an article]}. Kind 0 is a text, 1 a tag
    that can be no slot, 2 one that can, 3 the page's content."""
    found: dict[tuple[int, int], list] = {(content, 3): [1, 0, 0, 0]}
    above: list[list] = [[-1, found[(content, 3)], 0]]  # open containers: depth of their parents, entry, characters so far

    def close(depth: int) -> None:
        while above[-1][0] >= depth:
            _, entry, chars = above.pop()
            entry[1] += chars
            above[-1][2] += chars

    for event in parse(page, paths):
        if event[0] == "tag":
            _, own, top = event
            close(top.depth)
            entry = found.setdefault((own.path, 2 if own.container else 1), [0, 0, top.depth, int(own.article)])
            entry[0] += 1
            if own.container:
                above.append([top.depth, entry, 0])
        elif event[0] == "text":
            _, top, raw = event
            token = text_token(top.path, raw)
            if token is None:
                continue
            found.setdefault((token, 0), [0, 0, 0, 0])[0] += 1
            if not top.out and not top.link:
                close(top.depth)
                above[-1][2] += len(raw.strip())
    close(0)
    found[(content, 3)][1] = above[0][2]
    return found


def _occurrences(batches):
    """Tokens of the pages of a batch, combined by host and token."""
    paths = Paths()
    for b in batches:
        for part in _parts(b):
            seen: dict[tuple, list] = {}
            for page_id, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not page:
                    continue
                host, content = host_of(url), xxhash.xxh64_intdigest(page)
                row = content ^ xxhash.xxh64_intdigest(str(page_id))
                for (token, kind), (count, chars, depth, article) in _page_tokens(page, content, paths).items():
                    vector = _mix((row + count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                    got = seen.get((host, token, kind))
                    if got is None:
                        seen[(host, token, kind)] = [vector, 1, content, content, count, chars, depth, article]
                    else:
                        got[0] ^= vector
                        got[1] += 1
                        got[2] = min(got[2], content)
                        got[3] = max(got[3], content)
                        got[4] += count
                        got[5] += chars
            rows = list(seen.items())
            u = lambda values: _signed(np.array(values, dtype=np.uint64))
            i = lambda k, t: pa.array([v[k] for _, v in rows], t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), u([k[1] for k, _ in rows]), pa.array([k[2] for k, _ in rows], pa.int32()), u([v[0] for _, v in rows]), i(1, pa.int64()), u([v[2] for _, v in rows]), u([v[3] for _, v in rows]), i(4, pa.int64()), i(5, pa.int64()), i(6, pa.int32()), i(7, pa.int32())],
                names=[x.split(" ")[0] for x in _OCCURRENCES.split(", ")],
            )


def _mix(x: int) -> int:
    """K.mix of one value, in Python integers."""
    full = 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
    return x ^ (x >> 31)


def host_templates(ws: Workspace, pages: DataFrame) -> DataFrame:
    """(host, slot, tokens): the path of the article slot (null if none) and the text tokens in valid classes. Pages
    are (id, url, html)."""
    seen = pages.mapInArrow(trimmed(_occurrences), _OCCURRENCES)
    tokens = seen.groupBy("host", "token", "kind").agg(
        F.bit_xor("vector").alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "times", "chars")), F.min("low").alias("low"), F.max("high").alias("high"), F.max("depth").alias("depth"), F.max("article").alias("article")
    )
    # tokens of one or a few pages can be in no valid class; contents are counted for the host
    tokens = ws.keep(tokens.where((F.col("kind") == 3) | (F.col("pages") >= MIN_PAGES)), "tokens")
    hosts = tokens.where("kind = 3").groupBy("host").agg(F.count("*").alias("contents"), F.sum("chars").alias("all_chars")).where(F.col("contents") >= MIN_PAGES)
    own = tokens.where((F.col("kind") < 3) & (F.col("low") != F.col("high"))).join(ws.keep(hosts, "hosts"), "host")
    of_class = ["host", "vector", "pages"]
    classes = own.groupBy(*of_class).agg(F.sum((F.col("kind") > 0).cast("int")).alias("tags"), F.count("*").alias("size"))
    valid = ws.keep(own.join(classes.where("tags > 0 and size > 1"), of_class), "valid")
    # container tags that hold this share of the text lie one in the other, so the deepest ends the descent
    holds = valid.where((F.col("kind") == 2) & (F.col("times") == F.col("pages")) & (F.col("chars") >= SLOT_SHARE * F.col("all_chars")) & (F.col("chars") > 0))
    slots = holds.groupBy("host").agg(F.max_by("token", F.struct("article", F.when(F.col("article") == 1, -F.col("depth")).otherwise(F.col("depth")), "token")).alias("slot"))
    texts = valid.where("kind = 0").groupBy("host").agg(F.collect_list("token").alias("tokens"))
    return ws.keep(slots.join(texts, "host", "full"), "templates")


def main_text(page: str, template: set[int], paths: Paths, slot: int | None = None) -> str:
    """The text in the host's slot, else in the page's named articles, else all of it; less the parts that hold no
    article and the template's text. Blocks are joined by one space. If nothing is left so, names of elements that may
    be around the article don't count."""
    return _main_text(page, template, paths, slot, True) or (_main_text(page, template, paths, slot, False) if page else "")


def _main_text(page: str, template: set[int], paths: Paths, slot: int | None, names: bool) -> str:
    whole: list = []
    in_slot, in_article = False, False
    for event in parse(page, paths, slot, names):
        if event[0] == "tag":
            continue
        if event[0] == "break":
            whole.append(None)
            continue
        _, top, raw = event
        in_slot, in_article = in_slot or top.slot, in_article or (top.article and not top.out_article)
        if not template or text_token(top.path, raw) not in template:
            whole.append((raw, top))
    if in_slot:
        takes = lambda top: top.slot and not top.out_slot
    elif in_article:
        takes = lambda top: top.article and not top.out_article
    else:
        takes = lambda top: not top.out
    kept = [x and ((x[0], x[1].link) if takes(x[1]) else None) for x in whole]
    return " ".join(_blocks([k for k, x in zip(kept, whole, strict=True) if k or not x], drop_links=not (in_slot or in_article)))


def _blocks(pieces, drop_links: bool = False) -> list[str]:
    out, own = [], []
    for piece in (*pieces, None):
        if piece is not None:
            own.append(piece)
            continue
        if own:
            text = _SPACE.sub(" ", html.unescape("".join(raw for raw, _ in own))).strip()
            linked = sum(len(raw.strip()) for raw, link in own if link)
            if text and not (drop_links and 2 * linked > len(text)):
                out.append(text)
            own = []
    return out


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extract(templates):
    """Batches of page_id, url, html; also slot and tokens, unless the templates of all hosts are given."""
    paths = Paths()

    def run(batches):
        for b in batches:
            known = templates.value if templates is not None else {}
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = []
                for i, (url, page) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    host = host_of(url)
                    if templates is None and host not in known:
                        slot, tokens = part.column(3)[i].as_py(), part.column(4)[i]
                        known[host] = _template(slot, tokens.values if tokens.is_valid else None)
                    slot, tokens = known.get(host, (None, frozenset()))
                    texts.append(main_text(page or "", tokens, paths, slot))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _template(slot: int | None, tokens) -> tuple[int | None, frozenset]:
    own = frozenset() if tokens is None else frozenset(np.asarray(tokens, dtype=np.int64).view(np.uint64).tolist())
    return None if slot is None else slot & 0xFFFFFFFFFFFFFFFF, own


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (empty if the page has no article text), n_chars (code points).

    Null and empty html give an empty text. Pages without a host (null or odd urls) share the host "". Hosts with fewer
    than MIN_PAGES distinct pages have no template: their pages give their named articles, or all that is not in a part
    that holds no article. Rows that repeat a page get equal texts. Character references are decoded as HTML says. Other
    columns are not read. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "html")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = host_templates(ws, own)
    held = templates.agg(F.sum(1 + F.greatest(F.size("tokens"), F.lit(0)))).first()[0] or 0
    if held <= BROADCAST_TOKENS:  # sent to each worker once; beyond that, joined to the pages of each host
        rows = templates.toArrow()
        known = {h: _template(s, t.values if t.is_valid else None) for h, s, t in zip(rows["host"].to_pylist(), rows["slot"].to_pylist(), rows["tokens"], strict=True)}
        texts = own.mapInArrow(trimmed(_extract(spark.sparkContext.broadcast(known))), _TEXTS)
    else:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
        texts = own.withColumn("host", host).join(templates, "host", "left").select("id", "url", "html", "slot", "tokens").mapInArrow(trimmed(_extract(None)), _TEXTS)
    return texts.withColumnsRenamed({"page_id": id_col, "url": url_col})
