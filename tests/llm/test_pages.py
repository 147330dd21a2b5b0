"""Wrapper induction: planted pages with known texts, tree matching against brute force, and the counting against plain Python."""

import random
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from barloom.llm import dom, wrappers

SCHEMA = "page_id long, url string, html string, text string, host string, blocks int, n_chars long"


def layout(i, title, paragraphs, extra=""):
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p><article>x";</script></head><body>'
            f'<header><h1>Site {i}</h1></header><nav><ul>{"".join(f"<li><a href=/{k}>topic {k * i}</a>" for k in range(i % 5 + 2))}</ul></nav>'
            f'<div class="cookie-banner">We use cookies {i}</div><article class="post comment-count-{i}"><h1>{title}</h1>'
            + "".join(f"<p>{p}\n" for p in paragraphs) + f'<div class="ad slot{i}"><p>Buy {i}</p></div>{extra}</article><aside>more {i}</aside>'
            f'<section id="comments"><article class="comment"><p>First! {i}</article></section><form><p>mail {i}</p></form><footer>&copy; {i}</footer>')


def plain(i, title, paragraphs):
    """A page of a host without an article element: what is constant in it belongs to the template."""
    return (f"<body><div class=top><p>Daily Gazette of the Valley</p></div><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>"
            + (f"<table><tr><td>figure {i}<td>table {i * 7}</table>" if i % 3 == 0 else "") + "<div class=end><p>All reports are checked twice.</p></div></body>")


def made():
    r = random.Random(2)
    say = lambda: " ".join(r.choice("amber brook cedar dune ember fjord".split()) for _ in range(r.randint(3, 30)))
    rows, want = [], {}
    for i in range(30):
        title, paras = f"Story {i}", [say() + f" {i}" for _ in range(r.randint(1, 6))]
        rows.append((i, f"http://a.example/{i}", layout(i, title, paras), None))
        want[i] = "\n".join([title, *paras])
    for i in range(100, 130):
        title, paras = f"Report {i}", [say() + f" {i}" for _ in range(r.randint(1, 4))]
        rows.append((i, f"https://B.example:80/{i}", plain(i, title, paras), None))
        want[i] = "\n".join([title, *paras, *([f"figure {i}", f"table {i * 7}"] if i % 3 == 0 else [])])
    odd = {
        200: (None, ""), 201: ("", ""), 202: ("no markup &amp; more &amp&lt;b&gt; &eacute;&#233;&#x1F600; &am", "no markup & more &<b> éé😀 &am"),
        203: ("<p>one<p><b>two <i>bold</i><br>line<p>three</b> end", "one\ntwo bold line\nthree end"), 204: ("<div>" * 3000 + "deep" + "</div>" * 3000 + "after", "deep\nafter"),
        205: ("<script>only()", ""), 206: ("<main><p>in main</main><p>outside", "in main"), 207: ("<p>" + "long text " * 20000, ("long text " * 20000).strip()),
        208: ("<ul><li>a<li>b<ul><li>c</ul></ul><dl><dt>t<dd>d</dl>", "a\nb\nc\nt\nd"), 209: ("<p>x <span class='ad'>buy</span> y<!-- no --> z  w", "x\ny z w"),
        210: ("<div class='page has-sidebar'><p>kept</div><article></article><div role=navigation>go</div>", "kept"), 211: ("<P>UPPER</P><bad <p>t", "UPPER\nt"),
    }
    for i, (html, text) in odd.items():
        rows.append((i, None if i % 2 else f"http://[odd{i}", html, None))
        want[i] = text
    return [(*row, "h", 3, 9) for row in rows], want


@pytest.fixture(scope="module")
def pages(spark):
    rows, _ = made()
    return spark.createDataFrame([*rows, rows[3], (None, "http://a.example/none", "<p>no id", None, None, None, None)], SCHEMA).repartition(5).cache()


def test_main_text(pages):
    want = made()[1]
    got = wrappers.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert Counter(r.page_id for r in rows) == Counter([*want, 3, None])
    for r in rows:
        assert r.text == want.get(r.page_id, "no id") and r.n_chars == len(r.text)
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_constants_by_brute_force(pages):
    """Per host: texts in a slot of the most frequent skeleton that 90 of 100 different pages share, counted in plain Python."""
    hosts = defaultdict(dict)
    for r in pages.collect():
        if host := wrappers.host_of(r.url):
            skeleton, blocks = wrappers.parsed_page(r.html)
            hosts[host][skeleton, tuple(blocks)] = blocks
    want = set()
    for host, found in hosts.items():
        shapes = Counter(s for s, _ in found)
        top = max(shapes.values())
        counts = Counter()
        reference = min((s for s in shapes if shapes[s] == top), key=len)
        for (s, _), blocks in found.items():
            slots = dom.simple_tree_matching(s, reference)
            counts.update({(slots[n], t) for n, t in blocks if slots[n] >= 0})
        if len(found) >= wrappers.PAGES:
            want |= {(host, t) for (_, t), n in counts.items() if n >= 0.9 * len(found)}
    known = wrappers.parsed(pages)
    template = wrappers.constants(known)
    got = known.join(template, ["host", "shape"]).select("host", F.explode("blocks").alias("b"), "template").filter(
        F.array_contains("template", F.struct(F.col("b.node").alias("node"), F.xxhash64("b.text").alias("value")))).select("host", "b.text").distinct().collect()
    assert {tuple(r) for r in got} == want
    assert {t for _, t in want} == {"Daily Gazette of the Valley", "All reports are checked twice."}


def brute_matching(a, b):
    sa, ca = dom.tree(a)
    sb, cb = dom.tree(b)

    @cache
    def nodes(i, j):
        return 1 + lists(tuple(ca[i]), tuple(cb[j])) if sa[i] == sb[j] else 0

    @cache
    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), lists(x[1:], y[1:]) + nodes(x[0], y[0]) if nodes(x[0], y[0]) else 0)

    return nodes(0, 0)


def test_simple_tree_matching():
    r = random.Random(7)

    def grow(depth):
        kids = [grow(depth - 1) for _ in range(r.randint(0, 3))] if depth else []
        return r.choice("abc") + (f"({''.join(kids)})" if kids else " ")

    for _ in range(300):
        a, b = "#(" + grow(3) + grow(3) + ")", "#(" + grow(3) + grow(3) + ")"
        found = dom.simple_tree_matching(a, b)
        pairs = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert len(pairs) == brute_matching(a, b)
        (sa, ca), (sb, cb) = dom.tree(a), dom.tree(b)
        above_a = {c: i for i, k in enumerate(ca) for c in k}
        above_b = {c: i for i, k in enumerate(cb) for c in k}
        assert all(sa[i] == sb[j] and (not i or found[above_a[i]] == above_b[j]) for i, j in pairs)
        assert [j for _, j in pairs] == sorted({j for _, j in pairs})


def test_skeleton_takes_neighbours_together():
    page = dom.read("<ul><li>a<li><b>x</b><p>y</p><li><p>z<div>w</div></ul><p>1<p>2<div class='n12 m'>3</div><p>4")
    assert dom.skeleton(page.root) == "#(ul(li(p div ))p div.m.n# p )"
    assert [(node.slot, text) for node, text, *_ in page.blocks] == [
        (2, "a"), (2, "x"), (3, "y"), (3, "z"), (4, "w"), (5, "1"), (5, "2"), (6, "3"), (7, "4")]
