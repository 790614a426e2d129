"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block-level tags and their classes. Per path,
text length (without links) and punctuation are aggregated and divided by the path's number of blocks. Along the page
these ratios are smoothed with a Gaussian and fused into one score; the score of a path is the mean over its blocks,
times what its elements tell: an article or main element counts for it, an element or a class name that is used for
menus, headers, footers, sidebars, notices, adverts, forms or comments counts against it, the more the plainer it is.
Paths that reach half of the best score are content.

The smallest element with 85 % of their text (or the article element around it) is the container. In it, weak
paths are kept between content (headings, list items, short lines), unless their elements speak against them or they are
mostly links. A headline before the container belongs to it.

The scanner follows HTML's tokenisation and never goes back, so its time is proportional to the page.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTED = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
PLAIN = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
RAW = {t: re.compile(f"</{t}", re.I) for t in "script style textarea title noscript iframe template xmp noembed noframes".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address nav header footer aside form fieldset details summary center hgroup dialog menu search".split())
UNSEEN = frozenset("head button select option svg math object canvas audio video map datalist".split())  # no text of the page
CLOSES_P = BLOCK - frozenset("html body td th caption".split())
#: Start tags that end open elements: the group's elements, up to one of its bounds.
GROUPS = {"li": ("li", "ul ol menu"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table")}
ENDS = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td"}
MEMBERS = {g: (frozenset(a.split()), frozenset(b.split())) for g, (a, b) in GROUPS.items()}
GROUPS_OF = {t: [g for g, (a, b) in MEMBERS.items() if t in a | b] for t in "li ul ol menu dt dd dl tr td th table".split()}

ARTICLE, AGAINST, LAYOUT, MILD = 3.0, 0.02, 0.05, 0.6  # factors of a path's score
ELEMENTS = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class names and ids. Those of the last kind also name the head of an article.
WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist discussion thread reply replies respond disqus pagination pager copyright".split())
LAYOUT_WORDS = frozenset("footer sidebar sidebars notice notices alert widget widgets related recommended share sharing social toolbar disclaimer".split())
#: Words that name the page's frame alone or beside words of layout, but with other words often a topic: share-price, discussion-of-results.
TOPICS = frozenset("discussion thread share sharing social alert notice notices related recommended promotion copyright disclaimer menu menus sponsor sponsors".split())
FRAME = frozenset("area articles author bar block body bottom box btn button buttons card cards center col column container content count cta date desktop for grid group heading icon icons inner item items label left link links list lists main meta mobile module more name news outer panel policy post posts read reading right row section sections site slot sticky stories story tab tabs text this time title toggle top trail unit user view wrap wrapper you".split())
HEAD_WORDS = frozenset("header masthead banner".split())
ABOUT, NOT = frozenset("article post entry story title".split()), frozenset("has with without no is".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER = HEADINGS | frozenset("p li ul ol dl dt dd tr tbody thead tfoot table blockquote pre figure figcaption caption address hgroup summary center".split())
LISTED = frozenset("li dt dd td th caption pre blockquote figcaption".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")
SMOOTH = [math.exp(-(i * i) / 2) for i in range(-2, 3)]
SEED, COVER, LINKED = 0.5, 0.85, 0.6  # share of the best score; of the content's text in the container; of links in a path


@dataclass
class Page:
    """Blocks in page order, and the elements and paths that they refer to."""

    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters in links
    element: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    # by element, parents before children
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    factor: list[float] = field(default_factory=lambda: [1.0])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)  # (parent path, tag and classes) -> path


def _name_factor(tag: str, value: str) -> float:
    """What class names or an id say. In a paragraph only whole names count, in a heading none.

    A name that may be a topic only weighs a little: then the score of its path decides.
    """
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return 1.0
    out = 1.0
    for name in value.split():
        words = {name.lower()} if tag == "p" else {w.lower() for w in NAME.findall(name)} | {name.lower()}
        if words & NOT:
            continue
        said = words & (WORDS | LAYOUT_WORDS)
        topic = {w for w in words - said - FRAME - {name.lower()} if not w.isdigit()} or tag == "p" and not said & WORDS
        if said and said <= TOPICS and topic:
            out = min(out, MILD)
        elif words & WORDS:
            out = min(out, AGAINST)
        elif words & LAYOUT_WORDS or words >= {"side", "bar"} or words & HEAD_WORDS and not words & ABOUT:
            out = min(out, LAYOUT)
    return out


def _element(tag: str, attributes: str) -> tuple[str, float, bool]:
    """Label in paths, factor, and whether the element is not shown."""
    label, factor, unseen = tag, AGAINST if tag in ELEMENTS else 1.0, tag in UNSEEN
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                label += f".{value}" if name == "class" else ""
                factor = min(factor, _name_factor(tag, value))
            elif name == "role" and value.lower() in ROLES:
                factor = min(factor, AGAINST)
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                unseen = unseen or tag not in ("html", "body")
    return label, factor, unseen


class Scanner:
    """Cuts a page into blocks."""

    def __init__(self, page: str):
        self.page, self.out = page, Page()
        # open block-level and unseen elements: tag, element, path, is it unseen, is it in an article
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        self.open: dict[str, int] = {}
        self.groups: dict[str, list[int]] = {g: [] for g in GROUPS}
        self.held: list[str] = []
        self.link, self.in_links, self.unseen = 0, 0, 0  # depth at which a link began, its characters; open unseen elements

    def flush(self):
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held.clear()
            if text:
                _, element, path, _, _ = self.stack[-1]
                self.out.texts.append(text)
                self.out.linked.append(min(self.in_links, len(text)))
                self.out.element.append(element)
                self.out.path.append(path)
        self.in_links = 0

    def text(self, part: str):
        if part and not self.unseen:
            part = html.unescape(part) if "&" in part else part
            self.held.append(part)
            if self.link:
                self.in_links += len(part.strip())

    def push(self, tag: str, attributes: str):
        label, factor, unseen = _element(tag, attributes)
        _, above, path, _, article = self.stack[-1]
        if tag == "header" and not article:
            factor = min(factor, LAYOUT)
        if tag in ("article", "main") and not article:
            factor, article = factor * ARTICLE, True
        out = self.out
        out.parent.append(above)
        out.tag.append(tag)
        out.factor.append(out.factor[above] * factor)
        at = len(self.stack)
        for g in GROUPS_OF.get(tag, ()):
            self.groups[g].append(at)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.unseen += unseen
        self.stack.append((tag, len(out.parent) - 1, out.paths.setdefault((path, label), len(out.paths) + 1), unseen, article))

    def pop(self, at: int):
        """Closes the element at a place of the stack and all that are open in it."""
        self.flush()
        for tag, _, _, unseen, _ in self.stack[at:]:
            self.open[tag] -= 1
            self.unseen -= unseen
            for g in GROUPS_OF.get(tag, ()):
                self.groups[g].pop()
        del self.stack[at:]
        if self.link > len(self.stack):
            self.link = 0

    def close(self, tag: str):
        if self.open.get(tag):
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.pop(at)

    def start(self, tag: str, attributes: str):
        if tag == "a":
            self.link = len(self.stack)
        elif tag in ("br", "hr"):
            self.flush()
        elif tag not in VOID and (tag in BLOCK or tag in UNSEEN or "hidden" in attributes or "display" in attributes or self.unseen):
            if tag in CLOSES_P and self.stack[-1][0] == "p":
                self.pop(len(self.stack) - 1)
            if tag in ENDS:
                own, _ = MEMBERS[ENDS[tag]]
                ended = None
                for at in reversed(self.groups[ENDS[tag]]):
                    if self.stack[at][0] not in own:
                        break
                    ended = at
                if ended is not None:
                    self.pop(ended)
            closed = attributes.endswith("/") and tag not in BLOCK
            if not closed and (tag in BLOCK or _element(tag, attributes)[2] or self.open.get(tag)):
                if tag in BLOCK:
                    self.flush()
                self.push(tag, attributes)

    def scan(self) -> Page:
        page, at, n = self.page, 0, len(self.page)
        last, cdata, tags = page.rfind(">"), True, QUOTED
        while at < n:
            mark = page.find("<", at)
            if mark < 0 or mark > last:
                self.text(page[at:])
                break
            self.text(page[at:mark])
            follows = page[mark + 1]
            if follows == "!" or follows == "?" or follows == "/" and not page[mark + 2].isalpha():
                end = -1
                if page.startswith("<!--", mark):
                    end = page.find("-->", mark + 2)
                    at = n if end < 0 else end + 3
                    continue
                if cdata and page.startswith("<![CDATA[", mark):
                    end = page.find("]]>", mark)
                    cdata = end >= 0
                    if cdata:
                        self.text(page[mark + 9 : end].replace("&", "&amp;"))
                        at = end + 3
                        continue
                at = page.find(">", mark) + 1
                continue
            m = tags.match(page, mark + 1)
            if not m and tags is QUOTED and follows in "/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
                tags = PLAIN  # quotes do not close: from here on a tag ends at the next >
                m = tags.match(page, mark + 1)
            if not m:
                self.text("<")
                at = mark + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "a":
                    self.link = 0
                else:
                    self.close(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = RAW[tag].search(page, at)
                    at = end.start() if end else n
            else:
                self.start(tag, m[3])
        self.flush()
        return self.out


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        part = [(w, values[i + d]) for d, w in zip(range(-2, 3), SMOOTH) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in part) / sum(w for w, _ in part))
    return out


def path_scores(page: Page) -> dict[int, float]:
    """The fused score of each path that has text."""
    length, marks, count = ({p: 0 for p in page.path} for _ in range(3))
    for text, linked, path in zip(page.texts, page.linked, page.path):
        length[path] += max(0, len(text) - linked)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    fused = [a * (1 + b) for a, b in zip(smoothed([length[p] / count[p] for p in page.path]), smoothed([marks[p] / count[p] for p in page.path]))]
    score = {p: 0.0 for p in page.path}
    for path, element, f in zip(page.path, page.element, fused):
        score[path] += f * page.factor[element] / count[path]
    return {p: s if length[p] else 0.0 for p, s in score.items()}


def content_blocks(page: Page) -> list[int]:
    """Places of the blocks that are the main text."""
    score = path_scores(page)
    best = max(score.values(), default=0.0)
    seeds = {p for p, s in score.items() if s > 0 and s >= SEED * best}
    if not seeds:
        return []
    weight = [0] * len(page.parent)
    size, links = {p: 0 for p in score}, {p: 0 for p in score}
    for text, linked, element, path in zip(page.texts, page.linked, page.element, page.path):
        size[path] += len(text)
        links[path] += linked
        if path in seeds:
            weight[element] += max(0, len(text) - linked)
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    container = max(e for e, w in enumerate(weight) if w >= COVER * weight[0])
    while page.tag[container] in INNER:
        container = page.parent[container]
    around = container
    while around and page.tag[around] != "article":
        around = page.parent[around]
    container = around or container
    whole = page.tag[container] == "article"
    inside = [e == container for e in range(len(weight))]
    for e in range(container + 1, len(weight)):
        inside[e] = inside[page.parent[e]]
    own = [i for i, e in enumerate(page.element) if inside[e]]
    strong = [i for i in own if page.path[i] in seeds]
    first, last = strong[0], strong[-1]
    kept = []
    for i in own:
        path, element = page.path[i], page.element[i]
        tag = page.tag[element]
        if path in seeds:
            kept.append(i)
        elif page.factor[element] < MILD * page.factor[container] or links[path] > LINKED * size[path] and tag not in ("h1", "h2", "h3"):
            continue
        elif whole or first < i < last or i < first and tag in HEADINGS or i > last and tag in LISTED:
            kept.append(i)
    if page.tag[page.element[kept[0]]] not in ("h1", "h2") and not any(page.tag[page.element[i]] == "h1" for i in kept):
        ancestors, e = set(), page.parent[container]
        while e > 0:
            ancestors.add(e)
            e = page.parent[e]
        before = [i for i in range(kept[0]) if page.tag[page.element[i]] == "h1" and page.factor[page.element[i]] >= min(1.0, page.factor[container])]
        if before and not inside[page.element[before[-1]]] and (page.parent[page.element[before[-1]]] in ancestors or page.tag[page.parent[page.element[before[-1]]]] in ("header", "hgroup", "div")):
            kept.insert(0, before[-1])
    return kept


def main_text(page: str) -> str:
    """The content blocks, joined by newlines."""
    found = Scanner(page).scan()
    return "\n".join(found.texts[i] for i in content_blocks(found))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Null and empty pages, and pages without content, have the text ''. Repeated rows stay; an empty table
    gives an empty result; other columns are not read. Pages are handled one by one, whole, however long: time and
    memory grow in proportion to the page.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op2_tag_path_ratios(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
