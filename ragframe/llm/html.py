"""Main text of web pages by tree scoring.

The page is read into a tree. Each paragraph passes points to the elements around it: one for being there, one per
comma, up to three for its length, all of it to its parent and less the further away an ancestor is, discounted by the
share of its text that lies in links. The container with the most points is the article; siblings with a fair part of
its points are kept, and so is the container around it where it gathers more. Elements that by kind or by the words of
their class, id or role are no part of an article (menus, footers, notices, comments ...) neither give points nor text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, raw_text, text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img".split()
)
# Elements that are no text of an article, whatever stands around them.
LEFT_OUT = frozenset(
    "head title script style noscript template iframe object embed applet svg math canvas audio video map nav footer"
    " aside form button select textarea datalist fieldset menu dialog".split()
)
# An open paragraph ends before these.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# An element of the first kind ends an open one of the second kinds, unless one of the third is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements whose own text counts as a paragraph.
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main figcaption body html center".split())
CONTAINERS = frozenset("article main section div td blockquote body html center figure table tbody tr ul ol dl".split())
# Points that an element has before any paragraph.
GIVEN = {"article": 25.0, "main": 15.0, "blockquote": 3.0, "div": 5.0, "td": 3.0}
# Groups that go if more than half of their text is links.
LISTS = frozenset("ul ol dl div section table".split())

# Words of class, id or role that tell what is no article, and what is one.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments"
    " commentlist complementary consent contentinfo cookie cookies disqus disclaimer footer gdpr hidden login masthead"
    " menu menus meta modal nav navbar navigation navigationbar newsletter notice notices notification outbrain overlay"
    " pager pagination paywall popup promo promoted promotion recommended related replies reply respond responses rss"
    " share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola teaser"
    " teasers toolbar topbar tracking warning widget widgets search alert".split()
)
NATIVE = frozenset("article main content post entry story text body".split())
_SAYING = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_AFTER_WITH = re.compile(r"\b(?:has|with|without|no)[-_]+[a-z]+")


class Element:
    __slots__ = ("tag", "parent", "children", "out", "given", "size", "linked", "commas", "points", "words")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.out = parent is not None and parent.out
        self.given = GIVEN.get(tag, 0.0)
        self.size = self.linked = self.commas = 0
        self.points = 0.0
        self.words: frozenset[str] = frozenset()


class Tree(HTMLParser):
    """Elements in the order of the page; text as strings among the children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None)
        self.elements, self.stack = [self.root], [self.root]

    def _open(self, names: set[str], bounds: set[str]) -> int | None:
        """Place of the nearest open element with one of the names."""
        for place in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[place].tag
            if tag in names:
                return place
            if tag in bounds:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in BLOCKS and (place := self._open({"p"}, {"td", "th", "article", "section", "div", "li"})) is not None:
            del self.stack[place:]
        if tag in ENDS and (place := self._open(*ENDS[tag])) is not None:
            names, bounds = ENDS[tag]
            while place is not None:
                del self.stack[place:]
                place = self._open(names, bounds)
        around = self.stack[-1]
        if tag in VOID:
            if tag not in INLINE:
                around.children.append(" ")
            return
        element = Element(tag, around)
        around.children.append(element)
        self.elements.append(element)
        if attrs and not element.out:
            self._described(element, attrs)
        if tag in LEFT_OUT or (tag == "header" and self._open({"article", "main"}, set()) is None):
            element.out = True
        self.stack.append(element)

    def _described(self, element: Element, attrs: list) -> None:
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs) or any(
            k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs
        ):
            element.out = True
        if said and element.tag not in ("body", "article", "main"):
            names = _AFTER_WITH.sub(" ", _CAMEL.sub(" ", said).lower())
            element.words = frozenset(_SAYING.findall(names))
            if element.words & FOREIGN:
                element.out = True
            elif element.words & NATIVE:
                element.given += 15

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ("br", "p") and self._open({tag}, set()) is None:
            self.stack[-1].children.append(" ")
            return
        bounds = BLOCKS if tag in INLINE else {"table"} if tag not in ("table", "article", "main", "body") else set()
        place = self._open({tag}, bounds - {tag})
        if place is not None:
            del self.stack[place:]

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)

    def unknown_decl(self, data: str) -> None:
        """Marked sections of other kinds are no text."""


def parsed(html: str) -> Tree:
    tree = Tree()
    # a tag that the page's end cuts off is no text
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and re.match(r"</?[a-zA-Z]|<!", html[cut:]):
        html = html[:cut]
    tree.feed(html)
    tree.close()
    return tree


def _measured(tree: Tree) -> None:
    """Size of the text below each element, of its part in links, and commas of its own text."""
    for element in reversed(tree.elements):
        if element.out:
            continue
        for child in element.children:
            if isinstance(child, str):
                size = len("".join(child.split()))
                element.size += size
                element.commas += child.count(",") + child.count("،") + child.count("、") + child.count("，")
            elif not child.out:
                element.size += child.size
                element.linked += child.size if child.tag == "a" else child.linked
                if child.tag in INLINE:
                    element.commas += child.commas


def _own_size(element: Element) -> int:
    """Text that is not in blocks below."""
    blocks = sum(c.size for c in element.children if isinstance(c, Element) and not c.out and c.tag not in INLINE)
    return element.size - blocks


def _link_share(element: Element) -> float:
    return element.linked / element.size if element.size else 0.0


def _scored(tree: Tree) -> None:
    for element in tree.elements:
        if element.out or not element.size or element.tag not in PARAGRAPHS:
            continue
        size = _own_size(element)
        if not size:
            continue
        points = min(1.0, size / 25) + element.commas + min(size / 100, 3.0)
        points *= 1 - min(1.0, element.linked / size if element.linked < size else _link_share(element))
        above, share = element if element.tag not in ("p", "li", "td", "dd") else element.parent, 1.0
        steps = 0
        while above is not None:
            above.points += points * share
            steps += 1
            share = 0.5 if steps == 1 else 1 / (3 * steps)
            above = above.parent


def _gathered(element: Element) -> float:
    return element.points * (1 - _link_share(element))


def _best(tree: Tree) -> Element:
    """The container with the most points; the first of equals, but rather the inner one."""
    best, most = tree.root, -1.0
    for element in tree.elements:
        if element.out or element.tag not in CONTAINERS or not element.points:
            continue
        total = (element.points + element.given) * (1 - _link_share(element))
        if total > most or (total == most and element.parent is best):
            best, most = element, total
    # a container around it that gathers more text than the best one alone
    above = best.parent
    while best.tag not in ("article", "main") and above is not None and above.tag not in ("html", "body"):
        if _gathered(above) < 0.75 * _gathered(best):
            break
        best, above = above, above.parent
    return best


def _kept(best: Element) -> list[Element]:
    """The best container and the siblings that belong to it, in order."""
    if best.parent is None:
        return [best]
    least = max(4.0, 0.2 * _gathered(best))
    titled = any(isinstance(c, Element) and c.tag == "h1" for c in best.children)
    kept, before = [], True
    for child in best.parent.children:
        if child is best:
            before = False
            kept.append(child)
        elif isinstance(child, str) or child.out:
            continue
        elif child.tag == "p":
            if child.size >= 40 and _link_share(child) < 0.25:
                kept.append(child)
        elif child.tag == "h1":
            if before and not titled:
                kept.append(child)
        elif child.tag in CONTAINERS and best.tag not in ("article", "main") and _gathered(child) >= least:
            kept.append(child)
    return kept


def _menu(element: Element) -> bool:
    """A list or group with several links that is mostly links."""
    if element.tag not in LISTS or 2 * element.linked <= element.size:
        return False
    links, left = 0, list(element.children)
    while left and links < 2:
        child = left.pop()
        if isinstance(child, Element):
            links += child.tag == "a"
            left.extend(child.children)
    return links > 1


def main_text(html: str) -> str:
    """The article of a page; empty if there is none."""
    if not html.strip():
        return ""
    tree = parsed(html)
    _measured(tree)
    _scored(tree)
    parts: list[str] = []
    left: list = list(reversed(_kept(_best(tree))))
    while left:
        node = left.pop()
        if isinstance(node, str):
            parts.append(node)
        elif not node.out and not _menu(node) and not (node.tag == "header" and _no_title(node)):
            if node.tag in INLINE:
                left.extend(reversed(node.children))
            else:
                parts.append(" ")
                left.append(" ")
                left.extend(reversed(node.children))
    return " ".join("".join(parts).split())


def _no_title(header: Element) -> bool:
    """Of an article's header only its headings are text; others are taken out here."""
    left = list(header.children)
    header.children = [c for c in _inside(left) if isinstance(c, Element) and c.tag in HEADINGS]
    return not header.children


def _inside(left: list) -> list[Element]:
    found, left = [], list(reversed(left))
    while left:
        node = left.pop()
        if isinstance(node, Element) and not node.out:
            found.append(node)
            if node.tag not in HEADINGS:
                left.extend(reversed(node.children))
    return found


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty html, and pages without text, give an empty text. Whole pages are read, nothing is cut. Repeated rows
    are rows of their own; other columns are ignored.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(h.decode("utf-8", "replace")) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", raw_text("html").alias("raw"))
    return text_batches(rows, run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")
