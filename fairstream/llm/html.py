"""Main text of web pages by paths that the pages of a host agree on.

A page's containers are scored by the text of their blocks; each page votes for the
generalised path (tags and classes, digits as ``#``) of its best one. Spark counts the votes of
each host. In a second pass a page takes the path with most votes that it has, and its own
best container only if it has none of them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.llm.urls import host_of
from fairstream.plans.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: kinds of elements and what their names say
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog embed fieldset footer form head iframe input label legend menu "
    "nav noembed noframes noscript object option script select style svg template textarea title video audio".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form login menu menus modal "
    "nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription toolbar topbar widget widgets".split()
)
# fixed value: words that say nothing more about a box than that it is one, or where
FILLERS = frozenset(
    "area bar block blocks bottom box boxes button buttons center container controls count cta div entries field group inner "
    "item items js label layer left line link links list loop main mobile module outer page panel post posts primary "
    "right row section secondary site slot sub tag title top unit wrap wrapper zone".split()
)
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
# start tags that end an open paragraph, and elements that end another of their kind
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_LIKE = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("article aside body button div fieldset figure footer form header html main nav ol section table td th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|[^<>]*>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MIN_SHARE = 0.1
# so many boxes of one class with so much of a container's text are a list
BOXES, LIKE_BOXES, MOSTLY = frozenset("article div li section".split()), 3, 0.8
# what is marked as the article needs so much of the best score
LEAST_ARTICLE = 0.02
# a box put out by its name only is kept from so much of the page's unlinked text; the first share needs the headline too
MOST, NEARLY_ALL = 0.5, 0.9


class Element:
    __slots__ = ("tag", "path", "parent", "out", "named_out", "hinted", "article", "score", "bonus")

    def __init__(self, tag: str, classes: list[str], parent: Element | None, out: bool, article: bool, bonus: float, named_out: bool = False, hinted: bool = False):
        step = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in classes})])
        self.tag, self.parent, self.out, self.article, self.bonus = tag, parent, out, article, bonus
        self.named_out, self.hinted = named_out, hinted
        self.path = f"{parent.path}>{step}" if parent else step
        self.score = 0.0


def _attributes(rest: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(rest.rstrip(">")):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _element(tag: str, rest: str, parent: Element | None) -> Element:
    attributes = _attributes(rest) if "=" in rest or "hidden" in rest else {}
    classes = attributes.get("class", "").split()
    names = [{w.lower() for w in NAME_PARTS.findall(c)} for c in [*classes, attributes.get("id", "")]]
    words = set().union(*names)
    inside = parent is not None and parent.article
    article = inside or tag in ("article", "main")
    out = tag in LEFT_OUT and tag != "form" or attributes.get("role", "").lower() in LEFT_OUT_ROLES
    out = out or (not inside and tag == "header")
    telling = LEFT_OUT_WORDS if inside else LEFT_OUT_WORDS | {"header"}
    # a name tells if all of it does; a part of one is a hint, for which the links in the box decide.
    # Inside a line names say nothing
    judged = tag not in INLINE and tag not in ("html", "body", "article", "main")
    named_out = tag == "form" or judged and any(n & telling and n <= telling | FILLERS for n in names)
    hinted = judged and not named_out and bool(words & telling)
    out = out or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
    bonus = 2.0 if tag in ("article", "main") else 1.3 if words & ARTICLE_WORDS else 1.0
    return Element(tag, classes, parent, out or (parent is not None and parent.out), article, bonus, named_out, hinted)


def _without_named_out(blocks: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """The blocks outside of forms and of boxes named as no part of an article.

    A box with only a hint of that in its name is one of them if most of its text is in links. Such
    a box is a wrapper, and stays, if it holds a ``main``, the longest ``article`` of the page,
    most of the page's unlinked text with its first ``h1``, or nearly all of that text.
    """
    size: dict[int, list[int]] = {}
    hints: dict[int, Element] = {}
    for element, text, linked in blocks:
        while element.parent is not None:
            if element.hinted:
                hints[id(element)] = element
                held = size.setdefault(id(element), [0, 0])
                held[0], held[1] = held[0] + len(text), held[1] + linked
            element = element.parent
    for key, element in hints.items():
        element.named_out = 2 * size[key][1] > size[key][0]
    above: list[list[Element]] = []
    free: dict[int, int] = {}
    named: dict[int, Element] = {}
    articles: dict[int, Element] = {}
    mains: list[Element] = []
    headline = None
    for element, text, linked in blocks:
        chain = []
        while element.parent is not None:
            if element.named_out or element.tag in ("article", "main"):
                chain.append(element)
                free[id(element)] = free.get(id(element), 0) + len(text) - linked
                if element.named_out:
                    named[id(element)] = element
                elif element.tag == "main":
                    mains.append(element)
                else:
                    articles[id(element)] = element
            elif element.tag == "h1" and headline is None:
                headline = element
            element = element.parent
        above.append(chain)
    if not named:
        return blocks
    # of nested articles of one length the outer one
    longest = max(articles.values(), key=lambda e: (free[id(e)], -len(e.path)), default=None)
    wrappers, with_headline = set(), set()
    for held, into in ((mains, wrappers), ([longest], wrappers), ([headline], with_headline)):
        for element in held:
            while element is not None and id(element) not in into:
                into.add(id(element))
                element = element.parent
    total = sum(len(text) - linked for _, text, linked in blocks)
    for key in named:
        least = MOST if headline is None or key in with_headline else NEARLY_ALL
        if total and free[key] > least * total:
            wrappers.add(key)
    return [b for b, chain in zip(blocks, above) if all(not e.named_out or id(e) in wrappers for e in chain)]


def parse(html: str) -> list[tuple[Element, str, int]]:
    """Blocks of text in page order: container, text and how much of it is in links.

    A block ends where an element that is not inline starts or ends. White space is one space,
    character references are decoded, what never belongs to an article is left out.
    """
    blocks: list[tuple[Element, str, int]] = []
    stack: list[Element] = [Element("", [], None, False, False, 1.0)]
    pieces: list[str] = []
    linked, anchors = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            # white space first: a no-break space that was written as a reference is space too
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                at = stack[-1]
                while at.tag in INLINE and at.parent is not None:
                    at = at.parent
                blocks.append((at, text, min(linked, len(text))))
        linked = 0

    def close(upto: int) -> None:
        nonlocal anchors
        if any(e.tag not in INLINE for e in stack[upto:]):
            flush()
        anchors -= sum(e.tag == "a" for e in stack[upto:])
        del stack[upto:]

    at, lower = 0, None
    while at < len(html):
        match = TOKEN.search(html, at)
        end = match.start() if match else len(html)
        if end > at and not stack[-1].out:
            text = html[at:end]
            pieces.append(text)
            if anchors:
                linked += len(text)
        if match is None:
            break
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        tag = name.lower()
        if match["close"]:
            if tag == "br":
                pieces.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                # the end of an inline element does not end the block around it
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not stack[-1].out:
                pieces.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            ends = ENDS_LIKE.get(tag, frozenset())
            if tag in ENDS_PARAGRAPH:
                ends = ends | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
            flush()
        elif tag == "a" and anchors and stack[-1].tag == "a":
            close(len(stack) - 1)
        element = _element(tag, match["rest"], stack[-1])
        if tag in RAW:
            if lower is None:
                lower = html.lower()
            closing = lower.find(f"</{tag}", at)
            at = len(html) if closing < 0 else closing
            if closing >= 0:
                shut = html.find(">", closing)
                at = len(html) if shut < 0 else shut + 1
            continue
        if not match["rest"].endswith("/>") or tag not in ("svg", "path", "rect", "use", "circle"):
            stack.append(element)
            anchors += tag == "a"
    flush()
    return _without_named_out(blocks)


def _like_boxes(blocks: list[tuple[Element, str, int]]) -> dict[int, float]:
    """Which share of its text a container has in three or more boxes of one class, as readers' comments are."""
    whole: dict[int, int] = {}
    boxes: dict[tuple[int, str], dict[int, int]] = {}
    for element, text, _ in blocks:
        while element.parent is not None:
            parent = element.parent
            whole[id(parent)] = whole.get(id(parent), 0) + len(text)
            if element.tag in BOXES and element.path[len(parent.path) :].count("."):
                own = boxes.setdefault((id(parent), element.path), {})
                own[id(element)] = own.get(id(element), 0) + len(text)
            element = parent
    found: dict[int, float] = {}
    for (parent, _), own in boxes.items():
        if len(own) >= LIKE_BOXES:
            found[parent] = max(found.get(parent, 0.0), sum(own.values()) / whole[parent])
    return found


def best_path(blocks: list[tuple[Element, str, int]]) -> str | None:
    """Path of the container with the best score; text counts less the farther out, links not at all.

    A container that is mostly a list of like boxes counts half. If the best of those that are or
    lie in an ``article`` or ``main`` is no mere list and has a share of the best score, it is taken.
    """
    seen: dict[int, Element] = {}
    for element, text, linked in blocks:
        weight = (len(text) - linked) * (1 - linked / len(text))
        step = 1.0
        at = element
        if at.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "dd") and at.parent is not None:
            at = at.parent
        while at is not None:
            seen.setdefault(id(at), at)
            at.score += weight * step * at.bonus
            step *= 0.6
            at = at.parent
    lists = {key for key, share in _like_boxes(blocks).items() if share > MOSTLY}
    for key in lists & seen.keys():
        seen[key].score *= 0.5
    best = max(seen.values(), key=lambda e: e.score, default=None)
    if best is None or best.score <= 0:
        return None
    inside = [e for e in seen.values() if e.article and id(e) not in lists and not _one_of_many(e, lists)]
    marked = max(inside, key=lambda e: e.score, default=None)
    if not best.article and marked is not None and marked.score >= LEAST_ARTICLE * best.score:
        best = marked
    return _whole(best, blocks).path


def _one_of_many(element: Element, lists: set[int]) -> bool:
    while element is not None:
        if element.parent is not None and id(element.parent) in lists and element.tag in BOXES:
            return True
        element = element.parent
    return False


def _whole(best: Element, blocks: list[tuple[Element, str, int]]) -> Element:
    """The article around the best container: that element, else the box with its headline and lead.

    Without an ``article`` or ``main``, an ancestor is taken whose further blocks are headings or
    mostly unlinked text, if it is named as an article or has a further heading; of ``body`` only
    if they stand before the end of the container.
    """
    for tag in ("article", "main"):
        at = best
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None:
            return at
    # an ancestor's blocks are one run of the page, so only those at its two ends are further
    within: dict[int, list[int]] = {}
    for i, (element, _, _) in enumerate(blocks):
        while element is not None:
            within.setdefault(id(element), [i, i])[1] = i
            element = element.parent
    first, last = within[id(best)]
    found, heading, at = best, False, best.parent
    while at is not None and at.parent is not None:
        low, high = within[id(at)]
        further = [*blocks[low:first], *blocks[last + 1 : high + 1]]
        if any(2 * linked > len(text) for _, text, linked in further):
            break
        if at.tag in ("html", "body") and high > last:
            break
        heading = heading or any(e.tag in HEADINGS for e, _, _ in further)
        if further and (heading or at.bonus > 1):
            found, heading = at, False
        first, last, at = low, high, at.parent
    return found


def _inside(element: Element, path: str) -> bool:
    while element is not None:
        if element.path == path:
            return True
        element = element.parent
    return False


def main_text(html: str | None, paths: list[str]) -> str:
    """Blocks of the first of ``paths`` that has text here, else of the page's own best one."""
    blocks = parse(html or "")
    own = best_path(blocks)
    for path in [*paths, *([] if own is None else [own])]:
        texts = [text for element, text, _ in blocks if _inside(element, path)]
        if texts:
            return "\n\n".join(texts)
    return ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [best_path(parse(h.as_py() or "")) for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h.as_py(), p.as_py() or []) for h, p in zip(batch.column(2), batch.column(3))]
        columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


BROADCAST_ROWS = 50_000


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: per host the path with most votes and those with a tenth of them or more, most votes first.

    Of equal votes the first path counts. Votes are counted by host and path before they meet by
    host, where sums and a maximum suffice, so a host with very many paths is no large group.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string")
    counts = stored(votes.filter("path IS NOT NULL").groupBy("host", "path").count(), "host-votes")
    best = F.min(F.struct((-F.col("count")).alias("n"), "path"))
    hosts = counts.groupBy("host").agg(F.sum("count").alias("votes"), best["path"].alias("most"))
    kept = counts.join(hosts, "host").filter((F.col("count") >= MIN_SHARE * F.col("votes")) | (F.col("path") == F.col("most")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "path")))
    return stored(kept.groupBy("host").agg(order.alias("o")).select("host", F.col("o.path").alias("paths")), "host-paths")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> ``page_id, url, text, n_chars``, one row per row.

    The whole page is read, however long. A null or empty page, or one without an article, has an
    empty text. Pages without a host (also those with a null URL) vote together. Of paths with equal
    votes the first by name counts, of containers with equal scores the first of the page.
    Repeated rows vote and come out as often as they are; an empty table gives an empty result;
    other columns are not read.
    """
    paths = host_paths(pages)
    paths = paths.select(F.col("host").alias("path_host"), "paths")
    paths = F.broadcast(paths) if paths.count() <= BROADCAST_ROWS else paths
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    met = rows.join(paths, rows["host"] == paths["path_host"], "left").select("page_id", "url", "html", "paths")
    return met.mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
