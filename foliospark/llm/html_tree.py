"""Web pages as trees of their block elements, tidied as browsers do: left-out end tags are supplied, stray ones ignored.

Elements inside a line are no nodes; their text belongs to the block around
them. An element's label is its tag and its classes without digits; words of
its class, id and role that speak for boilerplate or for the article are part
of it, too.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An element of this tag ends an open one of these, up to the tag that bounds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

# What is not the article's, by tag and by words of class, id and role.
SKIP_TAGS = frozenset("nav footer header aside form button menu dialog object audio video canvas input fieldset search head".split()) | RAW
SKIP_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar aside complementary rail menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer contentinfo comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup signin login register search share sharing social follow related recommended recommendations teaser widget toolbar pagination pager skip hidden copyright disclaimer".split()
)
MAIN_WORDS = {"article": 3, "post": 2, "story": 2, "entry": 2, "main": 2, "content": 1}
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: Deeper elements are part of the one at this depth, as in browsers.
DEPTH = 128

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Node:
    label: str
    tag: str
    skip: bool
    main: int  # how much speaks for the article, 0: nothing
    inline: bool = False
    items: list = field(default_factory=list)  # nodes and (raw text, whether it is a link's)


@lru_cache(4096)
def _about(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Label, whether it is boilerplate, and weight as the article, by tag and attributes."""
    said: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        said.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    classes = sorted({re.sub(r"\d+", "", c) for c in said.get("class", "").split()} - {""})
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(said.get(k, "") for k in ("class", "id", "role"))).lower()
    words = set(re.findall(r"[a-z]+", named))
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", ""), re.I)
    skip = tag not in ("html", "body", "article", "main") and bool(tag in SKIP_TAGS or words & SKIP_WORDS or hidden) or tag == "article" and bool(words & {"comment", "comments", "related", "teaser", "promo", "ad"})
    main = 0
    if not skip and tag not in INLINE and tag not in ("html", "body"):
        main = max([{"article": 3, "main": 2}.get(tag, 0), *(MAIN_WORDS.get(w, 0) for w in words if tag in ("div", "section", "td", "main", "article"))])
        if said.get("itemprop", "").lower() == "articlebody":
            main = 4
    marks = sorted(words & (SKIP_WORDS | MAIN_WORDS.keys())) + ["hidden"] * bool(hidden) + ["articlebody"] * (main == 4)
    return re.sub(r"[^\w.-]", "_", ".".join([tag, *dict.fromkeys(marks), *classes])), skip, main


def parse(page: str) -> Node:
    """The page's tree. Linear in its length."""
    root = Node("", "", False, 0)
    path, open_tags, links, at = [root], {}, 0, 0
    size = len(page)

    def pop() -> None:
        open_tags[path.pop().tag] -= 1

    def text(raw: str) -> None:
        path[-1].items.append((raw, links > 0))

    find = _MARKUP.search
    while at < size:
        m = find(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            continue  # a comment or a declaration
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if closing:
                if path[-1].inline and path[-1].tag == tag:
                    pop()
                continue
            if not attributes or attributes == "/":
                continue
            label, skip, _ = _about(tag, attributes)
            if skip and len(path) < DEPTH:
                node = Node(label, tag, True, 0, inline=True)
                path[-1].items.append(node)
                path.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if closing:
            if open_tags.get(tag):
                if open_tags.get("table") and tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot"):
                    own = next(n.tag for n in reversed(path) if n.tag in ("table", "td", "th", tag))
                    if own != tag:  # a cell's content does not end what is around the table
                        continue
                while path[-1].tag != tag:
                    pop()
                pop()
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end.start()
            if tag in ("textarea", "select"):
                path[-1].items.append(Node(tag, tag, True, 0, inline=True))
            if end is not None:
                close = page.find(">", at)
                at = size if close < 0 else close + 1
            continue
        while path[-1].inline:
            pop()
        if path[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        if tag in CLOSES_P and open_tags.get("p") and path[-1].tag == "p":
            pop()
            links = 0
        if tag in ENDS:
            ended, bound = ENDS[tag]
            if any(open_tags.get(t) for t in ended):
                i = len(path) - 1
                while i > 0 and path[i].tag not in bound and path[i].tag not in ended:
                    i -= 1
                while i > 0 and path[i].tag in ended:
                    while len(path) > i:
                        pop()
                    i -= 1
        label, skip, main = _about(tag, attributes)
        node = Node(label, tag, skip, main)
        path[-1].items.append(node)
        if tag not in VOID and not attributes.endswith("/") and len(path) < DEPTH:
            path.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _line(pieces: list[str]) -> str:
    return " ".join("".join([html.unescape(p) if "&" in p else p for p in pieces]).split())


def blocks(node: Node, dropped: set[int] | None = None) -> list[str]:
    """The texts of the blocks in the node, without boilerplate and without the nodes whose id() is dropped."""
    out: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            if line := _line(pieces):
                out.append(line)
            pieces.clear()

    def walk(at: Node, only: frozenset[str] | None) -> None:
        for x in at.items:
            if type(x) is tuple:
                if only is None or at.tag in only:
                    pieces.append(x[0])
                continue
            inside = only
            if x.skip or (dropped and id(x) in dropped):
                if "header" not in x.label.split("."):
                    continue
                inside = HEADINGS  # of the article's own header its headings stay
            if not x.inline:
                flush()
            walk(x, None if inside is not None and x.tag in inside else inside)
            if not x.inline:
                flush()

    walk(node, None)
    flush()
    return out
