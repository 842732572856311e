"""Main text of web pages by equivalence-class template deduction (operator 1).

Pages of one host share a template. Each page is read as a sequence of tokens in their
roles: a block element with its path, and a text block with its path. A token's
occurrence vector over the host's pages is kept as a mergeable signature (a sum of
hashes of page and count), so vectors of hosts with any number of pages are compared
without being collected. Tokens with equal vectors form an equivalence class; classes
of enough tokens on enough pages are valid, and the paths nest them into the host's
template. Its slots are what varies between its tokens:

- a text that stands in (nearly) all places of its path is the template's, not a slot;
- a nested class that repeats within a page is a list of records (comments, teasers):
  the slot that holds nothing else is left out;
- of the remaining slots the article is found from the root down: while all that varies
  lies in containers and one of them holds it but for scraps, the slot is inside that one.

Elements, roles and class names that say what a part is (menus, forms, adverts) come on
top of that, and article or main elements decide where shares are close. They are all
there is for a host of a few pages, where nothing can be deduced.

(host, token) sums are pre-aggregated inside each batch and again before the shuffle;
only tokens on a share of the host's pages are gathered, a number that the size of a page
bounds. Pages meet their host's template in an equi-join whose page side adaptive
execution can split; the html travels compressed. Reading a page is linear in its length,
however it is nested or broken.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table
from .url_filter import split_url

#: A token on this share of a host's pages may belong to its template.
SHARE = 0.3
#: Tokens of a valid class, and pages that its tokens are on, at least.
CLASS_TOKENS, CLASS_PAGES = 3, 5
#: A text on this share of the pages that have its path is the template's.
FIXED = 0.8
#: A slot with this share of the text is descended into, unless another one beside it holds more than a scrap.
DESCEND, SCRAP = 0.7, 0.05
#: A list of records goes if it holds less than this share of the text (else it is the article).
RECORDS = 0.5

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_INSIDE_TAG = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
#: One attribute, by its whole name, and its value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Fixed: elements whose content isn't text of the page.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe svg math select textarea object canvas".split()}

#: Fixed: block elements of HTML; other elements are inside a block.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the listed kinds.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block elements that don't end an open paragraph when they start.
INSIDE_P = frozenset(("button",))
#: Elements that, without class or id, are told apart by their place among such siblings.
PLACED = frozenset("div section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main div section td body blockquote center table tbody tr details fieldset".split())
#: Fixed: elements, roles and words of class names and ids that mark what isn't article.
NOT_ARTICLE = frozenset("nav header footer aside form button head title menu dialog search legend option fieldset".split())
#: Elements that hold a whole article, and their bit in a node.
WHOLE = {"article": 1, "main": 2}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adbox adslot banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup social share sharing shares related recommended recommendations teaser teasers sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar comment comments commentlist disqus respond replies reply widget widgets login search toolbar skip copyright disclaimer paywall outbrain taboola".split()
)
#: Of these, words that also name parts of an article: inside an article element they mark only where nothing else is in the name but ``PLAIN`` words.
WEAK = frozenset("notice notices alert alerts related recommended recommendations teaser teasers menu menus nav footer header masthead reply replies widget widgets search skip copyright disclaimer banner banners overlay promotion login".split())
PLAIN = frozenset("area bar block box button buttons container content inner item items link links list outer panel post posts section unit wrap wrapper".split())
_NAME_PARTS = re.compile(r"[A-Za-z]+")


@dataclass(slots=True)
class Node:
    """A block element's path: its parent's token, its element, whether it is marked as no article, the ``WHOLE`` elements around it, whether it is told by its place, its count."""

    parent: int
    tag: str
    marked: bool
    inside: int
    placed: bool = False
    count: int = 0


@dataclass(slots=True)
class Block:
    """A text block: its path's token, its text, how much of it is links, and whether a marked element holds it."""

    path: int
    text: str
    links: int
    marked: bool


@lru_cache(maxsize=20_000)
def _attributes(source: str) -> tuple[str, frozenset, bool, str, bool]:
    """(label, name words, whether a name says nothing but what isn't article, role, hidden) of a tag's attributes; digits in names don't count."""
    label, words, bare, role, hidden = "", set(), False, "", False
    for m in _ATTRIBUTE.finditer(source):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            label += ("." if key == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split()))
            for name in value.split():
                own = {w.lower() for w in _NAME_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))}
                bare |= bool(own & NAMES) and own <= NAMES | PLAIN
                words |= own
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
    return label, frozenset(words), bare, role, hidden


def _scan(source: str) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text, element, whether it ends, attributes) of each piece of html: text has no element.

    A tag without an end is text. Quotes that never close don't count; how far that is
    known is kept, so a page is gone through a fixed number of times at most.
    """
    at, n, loose_until = 0, len(source), 0
    while at < n:
        lt = source.find("<", at)
        if lt != at:
            yield source[at : lt if lt >= 0 else n], None, False, ""
            if lt < 0:
                return
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt + 9)
            yield html_lib.escape(source[lt + 9 : end if end >= 0 else n]), None, False, ""
            at = end + 3 if end >= 0 else n
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        m = _NAME.match(source, lt)
        end = -1
        if m:
            if lt >= loose_until:
                end = _INSIDE_TAG.match(source, m.end()).end()
                if end == n or source[end] != ">":
                    # Up to a quote that never closes, or to the end of the page, quotes tell nothing.
                    loose_until, end = max(end, lt + 1), -1
            if end < 0:
                end = source.find(">", m.end())
        if end < 0:
            if m and source.find(">", lt) < 0:  # no tag ends any more
                yield source[lt:].replace("<", "&lt;"), None, False, ""
                return
            yield "&lt;", None, False, ""
            at = lt + 1
            continue
        name, attributes = m[2].lower(), source[m.end() : end]
        at = end + 1
        if name in RAW and not m[1]:
            if not (name in ("svg", "math") and attributes.endswith("/")):
                close = RAW[name].search(source, at)
                at = close.end() if close else n
            continue
        yield "", name, bool(m[1]), attributes


_PATHS: dict[tuple[int, str, str, bool, int, int], tuple[int, bool, int]] = {}


def _path(parent: int, name: str, attributes: str, marked: bool, inside: int, place: int) -> tuple[int, bool, int]:
    """(token, marked, inside) of a block element below a path; a token is a hash of the path, so paths of any depth cost the same."""
    key = (parent, name, attributes, marked, inside, place)
    if key not in _PATHS:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        label, words, bare, role, hidden = _attributes(attributes) if attributes else ("", frozenset(), False, "", False)
        own = marked or hidden or role in ROLES
        if not own and name not in ("html", "body", "main", "article"):
            # In an article, a name like entry-header or recommended-reading is a part of it.
            named = bare or bool(words & (NAMES - WEAK)) if inside else bool(words & NAMES)
            own = (name in NOT_ARTICLE and not (name == "header" and inside)) or named
        elif not own and name == "article":
            own = bool(words & {"comment", "comments", "teaser", "teasers", "related", "ad", "ads", "sponsored", "promo"})
        token = xxhash.xxh64_intdigest(parent.to_bytes(8, "little") + f"/{name}{label}{place or ''}".encode("utf-8", "surrogatepass")) >> 1
        _PATHS[key] = token, own, inside | WHOLE.get(name, 0)
    return _PATHS[key]


def parse(source: str | None) -> tuple[list[Block], dict[int, Node]]:
    """The text blocks of a page in order, and its paths by token, parents first; token 0 is the page."""
    blocks: list[Block] = []
    nodes: dict[int, Node] = {0: Node(-1, "", False, 0, False, 1)}
    # (element, token, marked, inside, nameless children so far by element) of the open block elements
    stack: list[tuple[str, int, bool, int, dict[str, int]]] = [("", 0, False, 0, {})]
    places: dict[str, list[int]] = defaultdict(list)  # of each open element in the stack
    text: list[str] = []
    links, linked = 0, False

    def close() -> None:
        nonlocal links
        if text:
            flat = " ".join(html_lib.unescape("".join(text)).split())
            if flat:
                blocks.append(Block(stack[-1][1], flat, links, stack[-1][2]))
            text.clear()
            links = 0

    def leave(size: int) -> None:
        while len(stack) > size:
            places[stack.pop()[0]].pop()

    for piece, name, ending, attributes in _scan(source or ""):
        if name is None:
            text.append(piece)
            links += len(piece) * linked
            continue
        if name not in BLOCKS:
            if name == "a":
                linked = not ending
            elif name in ("br", "img", "input"):
                text.append(" ")
            continue
        close()
        if ending:
            # A stray end tag doesn't close what stands around it.
            around = max((places[x][-1] for x in ("article", "main", "body", "td") if places[x]), default=0) if name in ("p", "li") else 0
            if places[name] and places[name][-1] > around:
                leave(places[name][-1])
            continue
        linked &= name in ("p", "div", "h1", "h2", "h3", "h4", "li")
        if name not in INSIDE_P and stack[-1][0] == "p":
            leave(len(stack) - 1)
        while stack[-1][0] in ENDS.get(name, ()):
            leave(len(stack) - 1)
        if name in ("body", "head") and stack[-1][0] == "head":
            leave(len(stack) - 1)
        _, parent, marked, inside, nameless = stack[-1]
        place = 0
        if name in PLACED and not (attributes and _attributes(attributes)[0]):
            place = nameless[name] = nameless.get(name, 0) + 1
        token, marked, inside = _path(parent, name, attributes, marked, inside, place)
        node = nodes.get(token)
        if node is None:
            node = nodes[token] = Node(parent, name, marked, inside, place > 0)
        node.count += 1
        if name not in VOID:
            places[name].append(len(stack))
            stack.append((name, token, marked, inside, {}))
    close()
    return blocks, nodes


def _text_token(block: Block) -> int:
    return xxhash.xxh64_intdigest(block.path.to_bytes(8, "little") + block.text.encode("utf-8", "surrogatepass")) >> 1


def _masses(blocks: list[Block], nodes: dict[int, Node]) -> tuple[dict[int, int], dict[int, int]]:
    """(own, whole) text of each path: characters that aren't links and aren't marked, its own and with all below it."""
    own: dict[int, int] = defaultdict(int)
    for x in blocks:
        if not x.marked:
            own[x.path] += max(0, len(x.text) - 2 * x.links)
    whole: dict[int, int] = defaultdict(int, own)
    for token in reversed(nodes):
        if token:
            whole[nodes[token].parent] += whole[token]
    return own, whole


def _tokens(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Pages to (host, token, parent, tag, flags, pages, total, vector, mass, own): summed inside the batch. A text's tag is null, its parent its path."""
    sums: dict[tuple[str, int], list] = {}

    def emit() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["host", "token", "parent", "tag", "flags", "pages", "total", "vector", "mass", "own"])

    for b in batches:
        for url, source in zip(b.column("url"), b.column("html")):
            source = source.as_py()
            if not source:
                continue
            host, (blocks, nodes) = split_url(url.as_py())[0], parse(source)
            page = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")).to_bytes(8, "little")
            own, whole = _masses(blocks, nodes)
            rows = [(t, x.parent, x.tag, x.inside, x.count, whole[t], own[t]) for t, x in nodes.items()]
            texts: dict[int, list[int]] = {}
            for x in blocks:
                if not x.marked:
                    held = texts.setdefault(_text_token(x), [x.path, 0, 0])
                    held[1] += 1
                    held[2] += max(0, len(x.text) - 2 * x.links)
            rows += [(t, path, None, 0, n, mass, mass) for t, (path, n, mass) in texts.items()]
            for token, parent, tag, flags, n, mass, alone in rows:
                sum_ = sums.setdefault((host, token), [parent, tag, flags, 0, 0, 0, 0, 0])
                sum_[3] += 1
                sum_[4] += n
                sum_[5] += xxhash.xxh64_intdigest(page + n.to_bytes(4, "little")) >> 33
                sum_[6] += mass
                sum_[7] += alone
            if len(sums) > most:
                yield emit()
    if sums:
        yield emit()


@dataclass(slots=True)
class Token:
    """A token's sums over a host's pages: ``total`` occurrences on ``pages`` pages, signature of its vector, text below it and its own."""

    token: int
    parent: int
    tag: str | None
    flags: int
    pages: int
    total: int
    vector: int
    mass: int
    own: int


def deduce(tokens: list[Token]) -> dict:
    """A host's template: the article's ``slot`` (a path's token), the elements right in it (``holds``), ``fixed`` texts' tokens and the slots that are ``lists`` of records."""
    nodes = {t.token: t for t in tokens if t.tag is not None}
    classes: dict[tuple[int, int], list[Token]] = defaultdict(list)
    for t in tokens:
        classes[t.vector, t.pages].append(t)
    valid = {key for key, members in classes.items() if len(members) >= CLASS_TOKENS and key[1] >= CLASS_PAGES}

    def above(token: int) -> Iterator[int]:
        while token in nodes:
            yield token
            token = nodes[token].parent

    @lru_cache(maxsize=None)
    def nested_in(token: int) -> tuple[int, int] | None:
        """The innermost valid class around a path."""
        return next((key for x in above(token) if (key := (nodes[x].vector, nodes[x].pages)) in valid), None)

    mass, own = {t: x.mass for t, x in nodes.items()}, {t: x.own for t, x in nodes.items()}

    def leave_out(token: int, amount: int) -> None:
        for x in above(token):
            mass[x] -= amount

    # Texts of the template: tokens of a valid class, or constant in a slot of one.
    # An element that stands once a page and doesn't always say the same (a byline) is a field of the article.
    def varies(t: Token) -> bool:
        around = nodes[t.parent]
        return around.total == around.pages > t.pages

    fixed = []
    for t in tokens:
        if t.tag is None and t.parent in nodes and varies(t):
            continue
        if t.tag is None and t.parent in nodes and t.pages >= CLASS_PAGES and t.pages >= FIXED * nodes[t.parent].pages and ((t.vector, t.pages) in valid or nested_in(t.parent)):
            fixed.append(t.token)
            leave_out(t.parent, t.mass)
            own[t.parent] -= t.own
    # Nested classes that repeat within a page are records; the slot around them goes if it holds nothing else.
    whole, lists = max(1, mass.get(0, 0)), set()
    for key in valid:
        members = {t.token: t for t in classes[key] if t.tag is not None}
        for t in members.values():
            if len(members) < CLASS_TOKENS or t.parent in members or t.total <= t.pages or t.tag not in RECORD_TAGS:
                continue
            around, held = t.parent, mass[t.token]
            if around in nodes and held >= FIXED * mass[around] and 0 < mass[around] < RECORDS * whole:
                while (up := nodes[around].parent) in nodes and held >= FIXED * mass[up] and mass[up] < RECORDS * whole:
                    around = up
                lists.add(around)
    for x in lists:
        if not any(y in lists for y in above(nodes[x].parent)):
            leave_out(x, mass[x])
    slot = _descend(nodes, mass, own)
    holds = sorted({x.tag for x in nodes.values() if x.parent == slot and 2 * x.pages >= nodes[slot].pages})
    return {"slot": slot, "holds": holds, "fixed": sorted(fixed), "lists": sorted(lists)}


#: Elements that a record (a comment, a teaser) may be; rows of tables and paragraphs aren't.
RECORD_TAGS = frozenset("article div section li blockquote details".split())


def _descend(nodes: dict[int, Token], mass: dict[int, int], own: dict[int, int]) -> int:
    """The slot of the article, from the root down."""
    children: dict[int, list[int]] = defaultdict(list)
    for t, x in nodes.items():
        if x.parent in nodes and mass[t] > 0:
            children[x.parent].append(t)
    at = 0
    while True:
        kids = [c for c in children[at] if 2 * nodes[c].pages >= nodes[at].pages]
        inner = [c for c in kids if nodes[c].tag in CONTAINERS or nodes[c].tag in ("html", "body")]
        # Prose that varies right here is part of the article.
        if 100 * own[at] >= mass[at] or any(c not in inner for c in kids):
            return at
        best = max(inner, key=mass.get, default=None)
        if best is None:
            return at
        named = [c for c in inner if nodes[c].tag in WHOLE and 2 * mass[c] >= mass[at]]
        beside = [c for c in children[at] if c != best]
        scraps = all(mass[c] < SCRAP * mass[at] and not any(nodes[k].tag in HEADINGS for k in children[c]) for c in beside)
        if named:
            best = named[0]
        elif mass[best] < DESCEND * mass[at] or not scraps:
            return at
        at = best


def _page_slot(nodes: dict[int, Node], whole: dict[int, int]) -> int:
    """The article or main element that holds most of a page's text; else the page."""
    for kind in WHOLE:
        own = [t for t, x in nodes.items() if x.tag == kind and 2 * whole[t] >= whole[0] > 0]
        if own:
            return max(own, key=whole.get)
    return 0


def extract(source: str | None, template: dict | None) -> str:
    """The article of a page under its host's template.

    A page that lacks the template's slot, and one without template, is read by itself:
    its article or main elements, else all that isn't marked or a list of links.
    """
    blocks, nodes = parse(source)
    free = [b for b in blocks if not b.marked]
    fixed, lists = set((template or {}).get("fixed", ())), set((template or {}).get("lists", ()))
    slot = (template or {}).get("slot", 0)
    deduced = slot in nodes and template is not None
    if deduced:
        if nodes[slot].placed:
            # A part that this page has more or less than others moves the places: the one that is built like the slot is meant.
            built = {x.parent for x in nodes.values() if x.tag in template["holds"]}
            if slot not in built and template["holds"]:
                whole_of = _masses(free, nodes)[1]
                slot = max((t for t, x in nodes.items() if x.placed and x.parent == nodes[slot].parent and x.tag == nodes[slot].tag), key=lambda t: (t in built, t == slot, whole_of[t]))
        within, out = {0: slot == 0}, {0: 0 in lists}
        for t, x in nodes.items():
            if t:
                within[t] = t == slot or within[x.parent]
                out[t] = t in lists or out[x.parent]
        own = [b for b in free if not out[b.path]]
        whole = WHOLE.get(nodes[slot].tag)
        # Where an article element is the slot, all of the page's are.
        own = [b for b in own if nodes[b.path].inside & whole] if whole else [b for b in own if within[b.path]]
        deduced = bool(own)
    if not deduced:
        slot = _page_slot(nodes, _masses(blocks, nodes)[1])
        whole = WHOLE.get(nodes[slot].tag)
        # Without either, what is mostly links is a menu; a paragraph only if it is nothing else.
        own = [b for b in free if (nodes[b.path].inside & whole if whole else 2 * b.links < len(b.text) or nodes[b.path].tag == "p" and 5 * b.links < 4 * len(b.text))]
    varying = [b for b in own if not fixed or _text_token(b) not in fixed]
    # A host whose pages are copies of one page has only fixed text: then it is the article.
    return "\n".join(b.text for b in varying or own)


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template as JSON) of every host."""
    token = pages.select("url", "html").mapInArrow(_tokens, "host string, token long, parent long, tag string, flags int, pages long, total long, vector long, mass long, own long")
    summed = ["pages", "total", "vector", "mass", "own"]
    sums = token.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("tag").alias("tag"), F.max("flags").alias("flags"), *(F.sum(c).alias(c) for c in summed))
    hosts = sums.where("token = 0").select("host", F.col("pages").alias("of"))
    # Texts of one page are in no template; the rest is as many as a page holds, over SHARE.
    often = sums.where("tag is not null or pages >= 2").join(hosts, "host").where(F.col("pages") >= SHARE * F.col("of"))
    gathered = often.groupBy("host").agg(F.max("of").alias("of"), F.collect_list(F.struct("token", "parent", "tag", "flags", *summed)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [json.dumps(deduce(sorted((Token(**t) for t in tokens.as_py()), key=lambda t: t.token))) for tokens in b.column("tokens")]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(made, pa.string())], names=["host", "template"])

    # A host of few pages has no valid class, and its pages are read by themselves.
    return gathered.where(F.col("of") >= CLASS_PAGES).mapInArrow(run, "host string, template string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null and empty html give the empty text; null and malformed URLs share the host "".
    Repeated rows stay, each with its text. An empty table gives an empty result; other
    columns are ignored. Nothing of an article is cut off, however long.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            hosts = [split_url(u)[0] for u in b.column("url").to_pylist()]
            packed = [None if s is None else press.compress(s.encode("utf-8", "surrogatepass")) for s in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(hosts), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, known = zstandard.ZstdDecompressor(), lru_cache(maxsize=256)(json.loads)
        for b in batches:
            texts = [
                "" if p.as_py() is None else extract(open_.decompress(p.as_py()).decode("utf-8", "surrogatepass"), known(t.as_py()) if t.as_py() else None)
                for p, t in zip(b.column("packed"), b.column("template"))
            ]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    packed = pages.select("page_id", "url", "html").mapInArrow(shrink, f"page_id {kind}, url string, host string, packed binary")
    return packed.join(host_templates(pages), "host", "left").select("page_id", "url", "packed", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
