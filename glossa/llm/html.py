"""Main text of web pages by tag-path ratios.

Every text block has a tag path from the root. Text without links, and punctuation, are
aggregated per path. A path's own ratio is smoothed twice: over the blocks in page order,
and up the path, over all text below each of its prefixes. Fused with the first it says
which paths are content: they choose the container of the article, and what else is part
of it. Fused with the second it says which paths of the container stay, so that short
blocks beside long ones do and lists of links don't. A heading goes with the blocks that
it heads.

Tags and names are weights of the fused scores: where an element that they speak against
holds most of the page's text, and not beside an article, they don't count. Menus have no
weight of their own, as their text is links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
CONTROLS = frozenset("button select textarea option optgroup label legend".split())
FRAME = frozenset("footer aside dialog form fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br label".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open p (HTML's own rule), and elements that end an open one of the same kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDED = frozenset().union({"p"}, *ENDS.values())
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer blockquote form".split())
#: Words in class or id that speak against an element, if a name has no words but these and NEUTRAL ones: "has-sidebar" and "comments-open" don't.
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner sidebar sidebars aside comment comments commentlist discussion discussions disqus respond "
    "reply replies footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations teaser teasers trending widget widgets search alert".split()
)
#: The same of link lists, which no heading brings back.
MENUS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar skip skiplink".split())
NEUTRAL = frozenset(
    "area bar block bottom box button buttons center col column container content device form frame google group header icons inner item items left link links list main mobile outer page panel post "
    "posts primary reader readers right row secondary section site slot stories sticky text thread title top unit user users visitor visitors wrap wrapper".split()
)
ROLES = frozenset("banner contentinfo complementary search dialog alertdialog alert".split())
MENU_ROLES = frozenset("navigation menu menubar toolbar".split())
#: Openings of headings over lists of other pages, in the languages of the corpus.
ELSEWHERE = re.compile(r"(?:more|related|read (?:more|also|next)|see also|also read|latest|most read|popular|trending|recommended|mehr|weitere|lesen sie|lire aussi|à lire|plus d|más|relacionad|lea también|ver también)\b", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
DEPTH = 512  # deeper elements count as part of the last
WEIGHT = 0.02
SIGMA = 1.0
SHARE, LEAST = 0.3, 0.05  # the thresholds on content paths and in their container, of the mean score of the page's text
FADES, OWN = 0.75, 0.25  # of a prefix one step further up; the exponent of a path's own ratio there
HOLDS, MOST = 0.85, 0.5
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    depth: int
    path: int
    number: int = 0
    last: int = 0  # the number of the last element inside
    against: bool = False
    barred: bool = False
    linked: bool = False
    menu: bool = False
    tops: int = 0
    articles: int = 0
    text: float = 0.0
    mass: float = 0.0
    weight: float = 1.0

    def upwards(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


@dataclass
class Block:
    element: Element
    parts: list = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    text: str = ""


def named(attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a name in class or id has one of the words, and no others but NEUTRAL ones."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        found = [w.lower() for w in _NAME.findall(name)]
        if not words.isdisjoint(found) and all(w in words or w in NEUTRAL for w in found):
            return True
    return False


def speaks_against(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in FRAME or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").strip().lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower() or named(attrs, AGAINST)


def is_menu(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("nav", "menu") or attrs.get("role", "").strip().lower() in MENU_ROLES or tag not in ("html", "body", "article", "main") and named(attrs, MENUS)


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")}


class Markup:
    """Reads a page from start to end, once: what an unclosed tag or comment holds goes, as in a browser."""

    def feed(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0 or lt + 1 == size:
                return self.handle_data(unescape(html[at:]))
            after = html[lt + 1]
            if not (after in "!?/" or after.isascii() and after.isalpha()):  # a "<" of the text
                more = html.find("<", lt + 1)
                more = size if more < 0 else more
                self.handle_data(unescape(html[at:more]))
                at = more
                continue
            if lt > at:
                self.handle_data(unescape(html[at:lt]))
            if html.startswith("<!--", lt):
                end = lt + 3 if html.startswith("<!-->", lt) else html.find("-->", lt + 4 - html.startswith("<!--->", lt))
                if end < 0:
                    return
                at = html.find(">", end) + 1
            elif tag := _TAG.match(html, lt):
                at = self.tag(html, tag)
            elif after.isalpha() or html[lt + 2 : lt + 3].isalpha() and after == "/":
                return
            else:  # <!doctype>, <?x>, </>
                at = html.find(">", lt) + 1
                if not at:
                    return

    def tag(self, html: str, tag: re.Match) -> int:
        """Handles a tag; where what follows it begins."""
        name, at = tag[2].lower(), tag.end()
        if tag[1]:
            self.handle_endtag(name)
            return at
        attrs: dict[str, str] = {}
        for key, value in _ATTRIBUTE.findall(tag[3]):
            attrs.setdefault(key.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        self.handle_starttag(name, attrs)
        if tag[3].endswith("/") and name in ("svg", "iframe", "script"):
            self.handle_endtag(name)
        elif name in RAW:
            end = RAW[name].search(html, at)
            stop = end.start() if end else len(html)
            if name in ("textarea", "title"):
                self.handle_data(unescape(html[at:stop]))
            return stop
        return at


class Blocks(Markup):
    """The text blocks of a page: maximal runs of text without a block element's border between."""

    barring = HIDDEN | CONTROLS

    def __init__(self):
        self.paths: dict[tuple, int] = {}
        self.parents: list[int] = [0]  # of paths
        self.root = Element("#root", None, 0, 0)
        self.open = [self.root]
        self.elements = [self.root]  # each after those around it
        self.count: dict[str, int] = defaultdict(int)  # open elements by tag
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.skipped = 0  # open elements beyond DEPTH

    def close_block(self) -> None:
        if self.block is not None:
            self.block.text = " ".join("".join(self.block.parts).split())
            if self.block.text:
                self.blocks.append(self.block)
            self.block = None

    def pop_to(self, index: int) -> None:
        gone = self.open[index:]
        if any(e.tag not in INLINE for e in gone):
            self.close_block()
        for e in gone:
            self.count[e.tag] -= 1
        del self.open[index:]

    def end_open(self, tags) -> None:
        """Ends the innermost element of one of the tags, if it is in scope."""
        if any(self.count[t] for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    return self.pop_to(i)
                if self.open[i].tag in SCOPE:
                    return

    def handle_starttag(self, tag: str, given: dict[str, str]) -> None:
        if tag == "br":
            if self.block is not None:
                self.block.parts.append(" ")
            return
        if tag not in INLINE:
            self.close_block()
        if self.count["head"] and tag not in IN_HEAD:  # an open head ends where the body's elements begin
            if (at := next((i for i, e in enumerate(self.open) if e.tag == "head"), 0)) and at == len(self.open) - 1:
                self.pop_to(at)
        if tag in ENDS_P:
            self.end_open(("p",))
        if tag in ENDS:
            self.end_open(ENDS[tag])
        if tag in VOID:
            return
        if len(self.open) > DEPTH:
            self.skipped += 1
            return
        parent = self.open[-1]
        names = tuple(given["class"].split()) if "class" in given else ()
        path = self.paths.setdefault((parent.path, tag, names), len(self.parents))
        if path == len(self.parents):
            self.parents.append(parent.path)
        e = Element(tag, parent, len(self.open), path, len(self.elements), barred=parent.barred or tag in self.barring, linked=parent.linked or tag == "a")
        if not e.barred:
            e.against = speaks_against(tag, given, bool(self.count["article"] or self.count["main"]))
            e.menu = parent.menu or is_menu(tag, given)
        e.tops, e.articles = int(tag in ("h1", "main")), int(tag == "article")
        self.count[tag] += 1
        self.open.append(e)
        self.elements.append(e)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", {})
        if self.skipped and tag not in VOID:
            self.skipped -= 1
            if tag not in INLINE:
                self.close_block()
            return
        if self.count[tag]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    return self.pop_to(i)
                if tag in INLINE and self.open[i].tag in SCOPE:
                    return

    def handle_data(self, data):
        e = self.open[-1]
        if e.barred:
            return
        if self.block is None:
            if not data.strip():
                return
            at = e
            while at.tag in INLINE and at.parent is not None:
                at = at.parent
            self.block = Block(at)
        self.block.parts.append(data)
        n = len(data.strip())
        self.block.chars += n
        self.block.link_chars += n * e.linked


def parsed(html: str | None, kind=Blocks) -> Blocks:
    parser = kind()
    parser.feed(html or "")
    parser.close_block()
    return parser


def _weigh(page: Blocks) -> None:
    """Weights of the elements: those that something speaks against count less, but for one that holds most of the text."""
    for b in page.blocks:
        b.element.text += b.chars - b.link_chars
    for e in reversed(page.elements):
        e.last = max(e.last, e.number)
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.tops += e.tops
            e.parent.articles += e.articles
            e.parent.last = max(e.parent.last, e.last)
    root = page.root
    for e in page.elements[1:]:
        e.weight = e.parent.weight
        if e.against:
            share = e.text / max(1.0, root.text)
            beside = root.tops - e.tops + root.articles - e.articles  # headlines and articles that aren't in it
            if not (share >= MOST and e.tops or share >= HOLDS and (not beside or e.articles == root.articles > 0)):
                e.weight *= WEIGHT


@dataclass
class Ratios:
    """Of each path its own ratio, the smoothed one of its surroundings, and the best one of its prefixes."""

    own: dict[int, float]
    smooth: dict[int, float]
    above: dict[int, float]


def path_ratios(paths: list[int], chars: list[int], marks: list[int], linked: list[float], weights: list[float], parents: list[int]) -> Ratios:
    """One entry of the lists a block, in page order; parents: the path above each path.

    A path's own ratio is the mean text without links of its blocks, times the root of
    one more than their mean punctuation marks. Smoothed are the weighted ratios of all
    blocks by a Gaussian over five; a path has the mean of its blocks. A prefix has the
    mean ratio of the text below it, which fades by FADES for each step up.
    """
    nodes, text, points = (defaultdict(float) for _ in range(3))
    for p, c, m, k in zip(paths, chars, marks, linked):
        nodes[p] += 1
        text[p] += c - k
        points[p] += m
    own = {p: text[p] / nodes[p] * (1 + points[p] / nodes[p]) ** 0.5 for p in nodes}
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    line = np.array([own[p] * w for p, w in zip(paths, weights)])
    around = np.convolve(np.pad(line, 2, "edge"), kernel / kernel.sum(), "valid")
    smooth: dict[int, float] = defaultdict(float)
    for p, x in zip(paths, around.tolist()):
        smooth[p] += x / nodes[p]
    mass, rated, above = defaultdict(float), defaultdict(float), {}
    for p, c, k, w in zip(paths, chars, linked, weights):
        mass[p] += (c - k) * w
        rated[p] += (c - k) * w * own[p]
    for p in range(len(parents) - 1, 0, -1):  # a path's number is greater than its parent's
        mass[parents[p]] += mass[p]
        rated[parents[p]] += rated[p]
    most = max(own.values(), default=0.0)
    for p in nodes:
        best, at, fade = 0.0, p, 1.0
        while True:
            if mass[at] > 0:
                best = max(best, fade * rated[at] / mass[at])
            if at == 0 or fade * most <= best:
                break
            at, fade = parents[at], fade * FADES
        above[p] = best
    return Ratios(own, smooth, above)


def main_text(html: str | None) -> str:
    page = parsed(html)
    if not page.blocks:
        return ""
    _weigh(page)
    if all(b.element.weight < MOST for b in page.blocks):  # everything is spoken against: then it says nothing
        for e in page.elements:
            e.weight = 1.0
    return "\n".join(b.text for b in content(page))


def content(page: Blocks) -> list[Block]:
    blocks, parents = page.blocks, page.parents
    paths, weights = [b.element.path for b in blocks], [b.element.weight for b in blocks]
    chars = [len(b.text) for b in blocks]
    linked = [b.link_chars / max(1, b.chars) * n for b, n in zip(blocks, chars)]
    ratios = path_ratios(paths, chars, [len(PUNCTUATION.findall(b.text)) for b in blocks], linked, weights, parents)
    of_text = 1 - np.bincount(paths, linked) / np.maximum(1, np.bincount(paths, chars))  # the share of a path's text that isn't links
    score = np.array([w * (ratios.own[p] * ratios.smooth[p]) ** 0.5 for p, w in zip(paths, weights)])
    inner = np.array([w * of_text[p] * ratios.own[p] ** OWN * ratios.above[p] ** (1 - OWN) for p, w in zip(paths, weights)])
    mass = np.array([(n - k) * w for n, k, w in zip(chars, linked, weights)])
    mean = float((mass * score).sum() / mass.sum()) if mass.sum() > 0 else 0.0
    chosen, stays = (score >= SHARE * mean) & (score > 0), (inner >= LEAST * mean) & (inner > 0)
    if not (mass * chosen).any():  # links alone
        mass, chosen = np.array(chars, np.float64), np.array(weights) >= MOST
        stays = chosen
    for b, m in zip(blocks, mass * chosen):
        b.element.mass += float(m)
    for e in reversed(page.elements[1:]):
        e.parent.mass += e.mass
    # The deepest element that holds nearly all of the chosen text; its article or, without one, its main element.
    total = float((mass * chosen).sum())
    container = max((b.element for b, c in zip(blocks, chosen) if c), key=lambda e: e.mass)
    container = next((e for e in container.upwards() if e.mass >= HOLDS * total), container)
    above = list(container.upwards())
    whole = next((e for tag in ("article", "main") for e in above if e.tag == tag and e.weight >= MOST), None)
    if whole is not None:
        container = whole
    elif container.tag in HEADINGS | {"p", "li", "td", "blockquote", "pre"} and container.parent is not None:
        container = container.parent

    within = [container.number <= b.element.number <= container.last for b in blocks]
    own_title = any(x and b.element.tag == "h1" for x, b in zip(within, blocks))
    kept, started, titled = np.zeros(len(blocks), bool), False, False
    for i, (b, inside) in enumerate(zip(blocks, within)):
        started |= inside
        if inside:
            kept[i] = stays[i]
        else:  # what scores like the article, and before it its title, with what stands between
            titled |= b.element.tag == "h1" and not own_title
            kept[i] = chosen[i] or titled and not started and stays[i]
    # A heading in the article over blocks none of which stays brings its links back, or goes with them.
    heads = [i for i, b in enumerate(blocks) if b.element.tag in HEADINGS]
    for i, end in zip(heads, [*heads[1:], len(blocks)]):
        below = [j for j in range(i + 1, end) if within[j]]
        if blocks[i].element.tag != "h1" and kept[i] and below and not kept[below].any():
            back = [j for j in below if weights[j] >= MOST and not blocks[j].element.menu]
            kept[back] = not ELSEWHERE.match(blocks[i].text)
            kept[i] = kept[back].any()
    return [b for b, k in zip(blocks, kept) if k]


class Visible(Blocks):
    """The text blocks of a page, boilerplate included."""

    barring = HIDDEN


def visible_text(html: str | None) -> str:
    """All visible text, block by block, boilerplate included."""
    return "\n".join(b.text for b in parsed(html, Visible).blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    text has the blocks of the main content in page order, joined by a newline; runs of
    white space inside a block are one space. Null and empty html, and pages without any
    content, give an empty text. n_chars counts code points. Repeated and null ids and
    null urls stay as they are; extra columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
