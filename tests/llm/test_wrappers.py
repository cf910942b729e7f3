"""Wrappers and main texts: hosts written by hand, a plain reading of the given pages, and pages that are broken."""

import html
import os
import random
import re

import pytest

from foliospark.llm.html_tree import blocks, parse
from foliospark.llm.wrappers import Item, Wrapper, aligned, expression, extract_text, main_texts, merged, read

SCHEMA = "page_id long, url string, html string, host string, text int, slots string, expression int"
GIVEN = "/root/testdata/sf0.001/pages.parquet"


def texts(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_texts(table).collect()), key=repr)


def only(spark, host_pages):
    return [r[2] for r in texts(spark, [(i, f"https://Site.example.org:80/{i}?q#f", p) for i, p in enumerate(host_pages)])]


def test_given_pages(spark):
    if not os.path.exists(GIVEN):
        pytest.skip("needs the driver's tables")
    got = {r["page_id"]: r["text"] for r in main_texts(spark.read.parquet(GIVEN)).collect()}
    for r in spark.read.parquet(GIVEN).collect():
        inside = re.sub("</?b>", "", re.search("<article>(.*?)</article>", r["html"], re.S)[1]).replace("<br>", " ")
        lines = (" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inside))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def test_article_without_its_surroundings(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>Title&nbsp;%d &lt;b&gt;</h1><!-- no <p>x</p> --><script>if (a < b) "</p>"</script>
    <p>First   <b>bold</b>
      <a href=x>link</a>, 1 < 2 &amp;amp; more<br>next<p>Second<ul><li>one<li>two</ul><aside>Read also</aside><div class="ad">Buy</div>
    <form><input value=1>Your mail <button>Send</button></form><table><tr><td>cell<td>other</table><section class="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
    <aside id=sidebar><ul><li>Latest</ul></aside><footer>&copy; Site</footer></body></html>"""
    want = "Title %d <b>\nFirst bold link, 1 < 2 &amp; more next\nSecond\none\ntwo\ncell\nother"
    assert only(spark, [page % i for i in range(3)]) == [want % i for i in range(3)]


def test_region_is_learned_where_no_element_says_it(spark):
    """The text of a host's pages is where their slots differ; links and what is the same everywhere are left out."""
    words = "the quick brown fox jumps over many lazy dogs and some more".split()
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(words) for _ in range(40)) + "."
    made = [[prose() for _ in range(rng.randint(2, 5))] for _ in range(6)]
    pages = []
    for k, paragraphs in enumerate(made):
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in rng.sample(words, 3 + k % 3))
        extra = "<div><p>On sale now, only today, do not miss it</p></div>" if k % 2 else ""
        pages.append(f"<body><div><ul>{menu}</ul></div>{extra}<div><h2>Head {k}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div>All rights are reserved by the owners of this site</div></div><div>Imprint and contact</div></body>")
    assert only(spark, pages) == ["\n".join([f"Head {k}", *p]) for k, p in enumerate(made)]


def test_awkward_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [
        (1, None, "<article>no host</article>"), (2, "https://a.org/", None), (3, "https://a.org/", ""), (4, "not a url", "plain text, no tags"),
        (5, "https://a.org/x", long), (5, "https://a.org/x", long), (None, "https://a.org/y", "<article><p>one</article>"), (6, "https://a.org/z", "<p>no article here"),
        (7, "https://b.org/1", "<body><p>same"), (8, "https://b.org/2", "<body><p>same"), (9, "https://c.org/", "<" * 5000), (10, "https://d.org/", "<div>" * 5000 + "deep" + "</div>" * 5000),
    ]
    got = texts(spark, rows)
    assert len(got) == len(rows)
    found = {r[0]: r[2] for r in got}
    assert (found[1], found[2], found[3], found[4]) == ("no host", "", "", "plain text, no tags")
    assert found[5] == "\n".join(["word & word"] * 20_000) and found[None] == "one" and found[6] == "no article here"
    assert found[7] == found[8] == "same" and found[10] == "deep"
    assert all(r[3] == len(r[2]) for r in got)
    assert texts(spark, []) == []


def test_alignment_makes_optional_and_repeated_groups():
    one = lambda s: expression(parse(s)).items
    shown = lambda items: " ".join(x.written() for x in items)
    assert shown(one("<p>a<p>b<p>c")) == "p{#}+"
    assert shown(one("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "dl{{dt{#} dd{#}}+}"
    assert shown(aligned(one("<h1>a</h1><p>b"), one("<h1>a</h1><div>x</div><p>b<p>c"))) == "h1{#} div{#}? p{#}+"
    assert shown(aligned(one("<dl><dt>a<dd>b</dl>"), one("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))) == "dl{{dt{#} dd{#}}+}"
    assert shown(aligned(one("<p>a</p>"), one("<div>b</div>"))) in ("p{#}? div{#}?", "div{#}? p{#}?")


def _matches(wrapper: Item, page: Item) -> bool:
    """Whether the page's expression is one that the wrapper allows, by brute force over the children's sequence."""

    def seq(items, labels):
        if not items:
            return not labels
        x, *rest = items
        if x.times & 1 and seq(rest, labels):
            return True
        names = x.items if x.label[0] == "(" else [x]
        if x.label[0] == "(":
            heads = [k for k in range(1, len(labels) + 1) if seq([Item(y.label, y.mark, y.times, y.items) for y in names], labels[:k])]
        else:
            heads = [1] if labels and labels[0].label == x.label and _matches(x, labels[0]) else []
        return any(seq(rest, labels[k:]) or (x.times & 2 and seq([Item(x.label, x.mark, x.times & ~1, x.items), *rest], labels[k:])) for k in heads)

    return seq(wrapper.items, page.items)


def _flat(node):
    text, out = False, []
    for x in node.items:
        if type(x) is tuple:
            if not text and x[0].strip():
                out.append(Item("#"))
                text = True
        else:
            text = False
            out.append(_flat(x))
    return Item(node.label, "", 0, out)


@pytest.mark.parametrize("seed", range(40))
def test_every_page_matches_its_wrapper(seed):
    rng = random.Random(seed)

    def some(depth):
        kids = [rng.choice(["p", "h2", "ul", "div"]) for _ in range(rng.randint(0, 4))]
        return "".join(f"<{k}>{'x' if k in ('p', 'h2') or depth == 0 else some(depth - 1)}</{k}>" for k in kids)

    pages = [parse(some(2)) for _ in range(6)]
    top = expression(pages[0])
    for p in pages[1:]:
        top = merged(top, expression(p))
    assert read(top.written()).written() == top.written()
    for p in pages:
        assert _matches(top, _flat(p)), (top.written(), _flat(p).written())
        wrapper = Wrapper(top)
        inside = [p, *(n for n in _all(p))]
        assert all(id(n) in wrapper.match(p) for n in inside)


def _all(node):
    for x in node.items:
        if type(x) is not tuple:
            yield x
            yield from _all(x)


@pytest.mark.parametrize("seed", range(60))
def test_broken_pages_do_no_harm(seed):
    rng = random.Random(seed)
    bits = ["<p>", "</p>", "<div", ">", "</div>", "<b>", "<table>", "<td>", "</table>", "<li>", "<a href='", "\"", "<!--", "-->", "&amp", "&#x41;", "text ", "<script>", "</script>", "<article>", "</article>", "<br/>", "</", "<select>", "<span class=ad>", "</span>", "é\x00", "<p class='x{}+?'>"]
    page = "".join(rng.choice(bits) for _ in range(200))
    tree = parse(page)
    assert blocks(tree) == [x for x in (" ".join(b.split()) for b in blocks(tree)) if x]
    top = expression(tree)
    assert read(top.written()).written() == top.written()
    extract_text(page, Wrapper(read(merged(top, top).written())))


def test_time_is_linear():
    import time

    def took(n):
        page = ("<div><p class=a>x<td>" + "<li>y</b></i></p>") * n
        start = time.perf_counter()
        extract_text(page, None)
        return time.perf_counter() - start

    took(100)
    assert took(8000) < 12 * took(1000) + 0.5
