"""Main text of web pages by wrappers: union-free expressions that all pages of a host match.

A page's tree, without its texts, is an expression already: text slots, fixed
elements, and groups that are repeated where the same siblings come again.
Two expressions are aligned item by item; what only one has becomes optional,
a sequence that the other has as a repeated group is folded into it. Aligning
a host's different expressions, in a fixed order, makes its wrapper. The
wrapper, not the single page, says which element is the article: one that
calls itself so, or else the one in which the slots' texts are, links and
texts that are the same on all pages left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .html_tree import Node, blocks, parse

OPTIONAL, REPEATED = 1, 2
_SIGNS = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}
_BACK = {v: k for k, v in _SIGNS.items()}
#: Longest group of siblings that is looked for as repeated.
LONGEST_GROUP = 6
MOST_UNLIKE = 12
#: Parts that a host's different expressions are dealt to, by their hash, before the parts' wrappers are aligned.
SALTS = 16
#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 16 << 20
_CONTAINERS = frozenset("html body div section article main center table tbody thead tr td th form span blockquote figure details dl ul ol fieldset header".split())


@dataclass(slots=True)
class Item:
    """label: an element's, "#" of a text slot, or "(a b)" of a repeated group. mark: s boilerplate, 1-4 weight as the article."""

    label: str
    mark: str = ""
    times: int = 0
    items: list[Item] = field(default_factory=list)

    def written(self) -> str:
        inside = " ".join([x.written() for x in self.items])
        head = f"{self.label if self.label[0] != '(' else ''}{'!' + self.mark if self.mark else ''}"
        return f"{head}{'{' + inside + '}' if inside or not head else ''}{_SIGNS[self.times]}"


def read(text: str) -> Item:
    """The expression that was written."""
    top = Item("")
    path, at = [top], 0
    while at < len(text):
        c = text[at]
        if c == " ":
            at += 1
        elif c == "{":
            if at == 0 or text[at - 1] in " {":
                path[-1].items.append(Item("("))
            path.append(path[-1].items[-1])
            at += 1
        elif c == "}":
            done = path.pop()
            if done.label == "(":
                done.label = _group_label(done.items)
            at += 1
        elif c in "?+*":
            path[-1].items[-1].times = _BACK[c]
            at += 1
        else:
            stop = at
            while stop < len(text) and text[stop] not in " {}?+*":
                stop += 1
            label, _, mark = text[at:stop].partition("!")
            path[-1].items.append(Item(label, mark))
            at = stop
    return top.items[0]


def _group_label(items: list[Item]) -> str:
    return "(" + " ".join(x.label for x in items) + ")"


def expression(node: Node) -> Item:
    """The page's own expression. Boilerplate without an article in it is a leaf; elements without any text slot stay."""
    items: list[Item] = []
    text = False
    for x in node.items:
        if type(x) is tuple:
            if not text and x[0] and not x[0].isspace():
                items.append(Item("#"))
                text = True
            continue
        if x.inline:
            continue
        text = False
        items.append(expression(x))
    out = Item(node.label or "page", "s" if node.skip else str(node.main) if node.main else "", 0, squeezed(items))
    if node.skip and not _articles(out):
        out.items = []
    return out


def _articles(item: Item) -> bool:
    return any(x.mark.isdigit() or _articles(x) for x in item.items)


def _inside(item: Item) -> set[str]:
    return set().union(*(_inside(x) if x.label[0] == "(" else {x.label} for x in item.items))


def alike(a: Item, b: Item) -> bool:
    """Whether two elements may be one of the wrapper's: the same label, and half of the labels inside in common."""
    if a.label != b.label:
        return False
    x, y = _inside(a), _inside(b)
    return 2 * len(x & y) >= max(len(x), len(y)) if x and y else (x | y) <= {"#"}


def squeezed(items: list[Item]) -> list[Item]:
    """Siblings in a row that are alike, and sequences of them in a row, as repeated groups.

    Of one label in a row, more than MOST_UNLIKE that are not alike are one
    repeated group, too: a wrapper does not grow with what a host's pages lack
    in common.
    """
    out: list[Item] = []
    row = [x.label for x in items]
    if len(row) > MOST_UNLIKE:
        crowded = {label for label in set(row) if any(row[i : i + MOST_UNLIKE + 1] == [label] * (MOST_UNLIKE + 1) for i in range(len(row)))}
    else:
        crowded = set()
    for x in items:
        if out and out[-1].label == x.label and (x.label in crowded or alike(out[-1], x)):
            out[-1] = merged(out[-1], x)
            out[-1].times |= REPEATED
        else:
            out.append(x)
    for k in range(2, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * k <= len(out):
            n = 1
            while i + (n + 1) * k <= len(out) and all(alike(out[i + j], out[i + n * k + j]) for j in range(k)):
                n += 1
            if n > 1:
                group = out[i : i + k]
                for j in range(1, n):
                    group = [merged(a, b) for a, b in zip(group, out[i + j * k : i + (j + 1) * k])]
                out[i : i + n * k] = [Item(_group_label(group), "", REPEATED, group)]
            i += 1
    return out


def _folded(items: list[Item], other: list[Item]) -> list[Item]:
    """items with each sequence that is a group of the other's as that group."""
    for g in other:
        if g.label[0] != "(" or any(x.label == g.label for x in items):
            continue
        names = [x.label for x in g.items]
        i = 0
        while i + len(names) <= len(items):
            if [x.label for x in items[i : i + len(names)]] == names:
                items = [*items[:i], Item(g.label, "", REPEATED, items[i : i + len(names)]), *items[i + len(names) :]]
            i += 1
    return items


def merged(a: Item, b: Item) -> Item:
    """An expression for all that one of two of the same label matches."""
    return Item(a.label, a.mark or b.mark, a.times | b.times, aligned(a.items, b.items))


def aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """Two sequences as one: a longest common subsequence of what is alike stays, the rest is optional."""
    if not a and not b:
        return []
    if [x.label for x in a] != [x.label for x in b]:
        a, b = _folded(a, b), _folded(b, a)
    head, most = 0, min(len(a), len(b))
    while head < most and alike(a[head], b[head]):
        head += 1
    tail = 0
    while tail < most - head and alike(a[-1 - tail], b[-1 - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [merged(p, q) for p, q in zip(a[:head], b[:head])]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if alike(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and alike(x[i], y[j]):
            out.append(merged(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append(Item(x[i].label, x[i].mark, x[i].times | OPTIONAL, x[i].items))
            i += 1
        else:
            out.append(Item(y[j].label, y[j].mark, y[j].times | OPTIONAL, y[j].items))
            j += 1
    out += [merged(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]
    return squeezed(out) if any(p.label == q.label for p, q in zip(out, out[1:])) else out


# Matching a page


class Wrapper:
    """An expression with what it says of the article."""

    def __init__(self, top: Item, slots: dict[int, tuple[int, int, int, int, bool]] | None = None):
        """slots: per slot the number of pages, texts, characters, those of links, and whether all texts are the same."""
        self.nodes: list[Item] = []
        self.kids: list[dict[str, list[int]]] = []  # by label, in order
        self.again: list[bool] = []  # whether the node may come again
        self._number(top)
        self.slots = slots or {}
        self.mains = self._explicit()
        self.mass: list[int] | None = None
        if not self.mains:
            self.mass = self._mass()
            self.mains = self._region()

    def _number(self, item: Item, again: bool = False) -> int:
        at = len(self.nodes)
        self.nodes.append(item)
        self.kids.append({})
        self.again.append(again or bool(item.times & REPEATED))
        self._children(at, item, False)
        return at

    def _children(self, at: int, item: Item, again: bool) -> None:
        for x in item.items:
            if x.label[0] == "(":
                self._children(at, x, again or bool(x.times & REPEATED))
            else:
                self.kids[at].setdefault(x.label, []).append(self._number(x, again))

    def children(self, at: int) -> list[int]:
        return sorted(k for group in self.kids[at].values() for k in group)

    def _explicit(self) -> set[int]:
        """The outermost elements that call themselves the article, by the strongest word; those in boilerplate only if there are no others."""
        found: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
        todo = [(0, False)]
        while todo:
            at, skipped = todo.pop()
            mark = self.nodes[at].mark
            skipped = skipped or mark == "s"
            if mark.isdigit():
                found[skipped].append((int(mark), at))
            todo += [(k, skipped) for k in self.children(at)]
        own = found[False] or found[True]
        best = max((m for m, _ in own), default=0)
        return {at for m, at in own if m == best}

    def _mass(self) -> list[int]:
        """Characters below each node that are neither links', boilerplate nor (unless all are) the same on all pages."""
        for same_counts in (False, True):
            sums = [0] * len(self.nodes)
            for at in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
                _, _, chars, linked, same = self.slots.get(at, (0, 0, 0, 0, False))
                if self.nodes[at].label == "#":
                    sums[at] = chars if (same_counts or not same) and 2 * linked <= chars else 0
                elif self.nodes[at].mark != "s":
                    sums[at] = sum(sums[k] for k in self.children(at))
            if sums[0]:
                break
        return sums

    def _region(self) -> set[int]:
        """Where the slots' texts are: from the top down as long as one container has three quarters of them."""
        at = 0
        while self.mass[0]:
            heavy = [k for k in self.children(at) if self.nodes[k].label.split(".")[0] in _CONTAINERS and 4 * self.mass[k] >= 3 * self.mass[0]]
            if not heavy:
                break
            at = heavy[0]
        return {at}

    def _covers(self, at: int, node: Node, known: dict[tuple[int, int], bool]) -> bool:
        """Whether the wrapper's node has all that the page's node has below it."""
        if (at, id(node)) not in known:
            inside = [x for x in node.items if type(x) is not tuple and not x.inline]
            text = any(type(x) is tuple and x[0] and not x[0].isspace() for x in node.items)
            fits = (not text or "#" in self.kids[at]) and all(any(self._covers(k, x, known) for k in self.kids[at].get(x.label, ())) for x in inside)
            known[at, id(node)] = self.nodes[at].mark == "s" or fits
        return known[at, id(node)]

    def match(self, page: Node) -> dict[int, tuple[int, Node]]:
        """id() of each of the page's nodes that the wrapper has -> its number there.

        Of several elements of one label the next in order that has all that
        the page's has below it.
        """
        found: dict[int, tuple[int, Node]] = {id(page): (0, page)}
        known: dict[tuple[int, int], bool] = {}
        todo = [(0, page)]
        while todo:
            at, node = todo.pop()
            kids, last = self.kids[at], -1
            for x in node.items:
                if type(x) is tuple or x.inline:
                    continue
                options = kids.get(x.label)
                if options:
                    if len(options) > 1:
                        options = [k for k in options if self._covers(k, x, known)] or options
                    last = next((k for k in options if k > last or (k == last and self.again[k])), options[-1])
                    found[id(x)] = (last, x)
                    todo.append((last, x))
        return found

    def slot_texts(self, page: Node) -> Iterator[tuple[int, str, bool]]:
        """(slot, text, whether most of it is links') of each run of text in the page's blocks that the wrapper has."""
        for at, node in self.match(page).values():
            slots = self.kids[at].get("#")
            if not slots:
                continue
            pieces: list[tuple[str, bool]] = []
            for x in [*node.items, Node("", "", False, 0)]:
                if type(x) is tuple:
                    pieces.append(x)
                elif not x.inline and pieces:
                    text = " ".join("".join(p for p, _ in pieces).split())
                    if text:
                        yield slots[0], text, 2 * sum(len(p) for p, link in pieces if link) > len(text)
                    pieces = []

    def text(self, page: Node) -> str | None:
        """The article's blocks; None where the page has none of the wrapper's articles."""
        found = self.match(page)
        tops = {key for key, (at, _) in found.items() if at in self.mains}
        if not tops:
            return None
        dropped = {key for key, (at, _) in found.items() if self.mass and self.mass[0] and not self.mass[at] and self._texts(at)}
        out: list[str] = []
        todo = [page]
        while todo:  # in page order
            node = todo.pop()
            if id(node) in tops:
                out += blocks(node, dropped)
            else:
                todo += [x for x in reversed(node.items) if type(x) is not tuple]
        return "\n".join(out)

    def _texts(self, at: int) -> bool:
        return at in self.slots or any(self._texts(k) for k in self.children(at))


def extract_text(page: str, wrapper: Wrapper | None) -> str:
    """Main text of a page. One that has none of the wrapper's articles is taken by itself."""
    tree = parse(page)
    found = wrapper.text(tree) if wrapper else None
    if found is None:
        top = expression(tree)
        own = Wrapper(top)
        if own.mass:
            own = Wrapper(top, _counted(own, tree))
        found = own.text(tree)
    return found or ""


def _counted(wrapper: Wrapper, tree: Node) -> dict[int, tuple[int, int, int, int, bool]]:
    out: dict[int, tuple[int, int, int, int, bool]] = {}
    for slot, text, link in wrapper.slot_texts(tree):
        _, n, chars, linked, _ = out.get(slot, (1, 0, 0, 0, False))
        out[slot] = (1, n + 1, chars + len(text), linked + len(text) * link, False)
    return out


# Spark jobs


def host_of(url: Column) -> Column:
    """The host in small letters; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], None] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            seen[host, expression(parse(page)).written()] = None
        yield pa.RecordBatch.from_pydict({"host": [h for h, _ in seen], "expression": [e for _, e in seen]}, pa.schema([("host", pa.string()), ("expression", pa.string())]))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a (host, salt) as one; only the expression so far is held."""
    schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("expression", pa.string())])
    key, top = None, None
    for batch in batches:
        out = []
        for host, salt, text in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "expression"))):
            if (host, salt) != key:
                if top is not None:
                    out.append({"host": key[0], "salt": key[1], "expression": top.written()})
                key, top = (host, salt), read(text)
            else:
                top = merged(top, read(text))
        yield pa.RecordBatch.from_pylist(out, schema)
    if top is not None:
        yield pa.RecordBatch.from_pylist([{"host": key[0], "salt": key[1], "expression": top.written()}], schema)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression) of (host, html) pages with a host.

    A host's different expressions, not its pages, are shuffled and aligned,
    in 16 parts by their hash and then the parts, each in the order of the
    expressions: so the result depends neither on how pages lie nor on one
    task for a host with very many.
    """
    ddl = "host string, salt int, expression string"
    seen = pages.select("host", "html").mapInArrow(_expressions, "host string, expression string").distinct()
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("expression"), F.lit(SALTS)).cast("int"))
    order = ("host", "salt", F.length("expression"), "expression")
    parts = salted.repartition("host", "salt").sortWithinPartitions(*order).mapInArrow(_align, ddl)
    whole = parts.repartition("host").sortWithinPartitions("host", "salt").withColumn("salt", F.lit(0)).mapInArrow(_align, ddl)
    return whole.select("host", "expression")


@lru_cache(256)
def _wrapper(text: str, slots: tuple = ()) -> Wrapper:
    return Wrapper(read(text), {s[0]: tuple(s[1:]) for s in slots})


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("pages", pa.int64()), ("texts", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("low", pa.string()), ("high", pa.string())])
    for batch in batches:
        held: dict[tuple[str, int], list] = {}
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "expression"))):
            of_page = set()
            for slot, words, link in _wrapper(text).slot_texts(parse(page)):
                digest = hashlib.md5(words.encode()).hexdigest()
                x = held.setdefault((host, slot), [0, 0, 0, 0, digest, digest])
                x[0] += slot not in of_page
                of_page.add(slot)
                x[1] += 1
                x[2] += len(words)
                x[3] += len(words) * link
                x[4], x[5] = min(x[4], digest), max(x[5], digest)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*k, *v))) for k, v in held.items()], schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, text, slots in zip(*(batch.column(c).to_pylist() for c in ("html", "expression", "slots"))):
            of_host = _wrapper(text, tuple(tuple(s.values()) for s in slots or ())) if text else None
            texts.append(extract_text(page, of_host) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """Pages beside their host's wrapper: broadcast if all wrappers are few bytes, else a join whose frequent hosts Spark can split."""
    size = wrappers.agg(F.sum(F.length("expression") + 200)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", how)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html, and pages without an article, have an empty text.
    Pages without a host in their url are taken by themselves. Repeated rows
    and rows without an id stay; an empty table gives an empty one. Pages are
    read whole, however long; elements deeper than 128 count to the one at that
    depth. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    hosted = plain.where("host IS NOT NULL AND html <> ''").select("host", "html")
    found = materialize(infer_wrappers(hosted), "wrappers")
    vague = found.where(~F.col("expression").rlike(r"![1-4]"))  # no element calls itself the article
    if not vague.isEmpty():
        ddl = "host string, slot int, pages long, texts long, chars long, linked long, low string, high string"
        counted = _with_wrappers(hosted, vague, "inner").mapInArrow(_slot_rows, ddl).groupBy("host", "slot")
        sums = counted.agg(*(F.sum(c).alias(c) for c in ("pages", "texts", "chars", "linked")), ((F.min("low") == F.max("high")) & (F.sum("pages") > 1)).alias("same"))
        slots = sums.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "pages", "texts", "chars", "linked", "same"))).alias("slots"))
        found = materialize(found.join(slots, "host", "left"), "wrappers")
    else:
        found = found.withColumn("slots", F.lit(None).cast("array<struct<slot:int,pages:long,texts:long,chars:long,linked:long,same:boolean>>"))
    out = _with_wrappers(plain, found, "left").select("page_id", "url", "html", "expression", "slots").mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
