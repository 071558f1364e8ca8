"""Main content of pages: known pages, broken ones, and random trees against a recursive version."""

import random
import re
import xml.etree.ElementTree as ET

import pytest

from plumbline.functions import content
from plumbline.functions.content import AROUND, BODY, CLOSED, LETTERS, LINKED, NO_CONTENT, main_content, scraped
from plumbline.plans.registry import queries

LONG = "Zinc lozenges shorten colds by a day or two in most trials"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None),
        ("", None),
        (" \n ", None),
        ("no markup at all, but a sentence.", "no markup at all, but a sentence."),
        ("<p>a</p>", None),
        (f"<nav>{LONG}</nav>", None),
        (f"<p>{LONG}", LONG),
        (f"<p>{LONG}<p>Second one.</div></p></p>", f"{LONG}\nSecond one."),
        (f"<div class='side sidebar'>{LONG}</div><p>Short but closed.</p>", "Short but closed."),
        (f"<p>{LONG} <a href=x>see</a></p><p><a href=x>{LONG}</a> now</p>", f"{LONG} see"),
        (f"<ul><li><a>{LONG}</a></li><li>x</li></ul><p>{LONG}</p>", LONG),
        (f"<h1>Colds</h1><h2>Nothing</h2><h2>Zinc</h2><p>{LONG}</p><h2>Last</h2>", f"Colds\nNothing\nZinc\n{LONG}"),
        (f"<article class='ad-free comments'><p>{LONG}</p></article>", LONG),
        (f"<p>a &lt;b&gt; &amp; c&nbsp;d: {LONG}<br>next</p>", f"a <b> & c d: {LONG} next"),
        (f"<script>var x='<p>{LONG}</p>'</script><!-- <p>{LONG}</p> --><p>{LONG}", LONG),
        (f"<p>{LONG}</p><script>never ends", LONG),
        ("<div>" * 5000 + LONG + "</div>" * 5000, LONG),
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div>An aside of its own, short.</div>", f"{LONG}\n{LONG}\n{LONG}"),
        (f"<p>{LONG} <a href=x>open link <p>{LONG}", f"{LONG} open link"),  # the link goes on in the next block
    ],
)
def test_main_content(html, want):
    assert main_content(html) == want


def test_names_that_mark_surroundings():
    assert all(AROUND.search(x) for x in ("ad", "ads top", "nav-main", "cookie_banner", "x related", "navbar"))
    assert not any(AROUND.search(x) for x in ("head", "reading", "shared-text", "adult", "main", "commentary"))


def by_recursion(html):
    """The same for well-formed trees: each element knows its text, its links and its children."""
    inline = {"a", "b"}

    def runs(e, linked, out, chain):
        """Runs of text in order, as [chain of blocks, text, letters in links]."""
        if e.tag not in inline:
            chain = [*chain, e]
            out.append([chain, "", 0])

        def add(text, in_link):
            if text:
                out[-1][1] += text
                out[-1][2] += len(re.sub(r"\s+", " ", text).strip()) if in_link else 0

        add(e.text, linked or e.tag == "a")
        for c in e:
            runs(c, linked or e.tag == "a", out, chain)
            if c.tag not in inline:
                out.append([chain, "", 0])
            add(c.tail, linked or e.tag == "a")

    every = []
    runs(ET.fromstring(html), False, every, [])
    every = [(chain, re.sub(r"\s+", " ", t).strip(), n) for chain, t, n in every]
    every = [(chain, t, min(n, len(t))) for chain, t, n in every if t]
    bad = set()

    def named(e):
        return e.tag in NO_CONTENT or (e.tag not in ("html", "body", "main", "article") and AROUND.search(e.get("class") or "") is not None)

    def judge(e):
        size = linked = 0
        for c in e:
            if c.tag not in inline:
                s, k = judge(c)
                size, linked = size + s, linked + k
        for chain, t, n in every:
            if chain[-1] is e:
                size, linked = size + len(t), linked + n
        if e.tag != "html" and (named(e) or linked > LINKED * size):
            bad.add(e)
            return 0, 0
        return size, linked

    root = ET.fromstring(html)
    every.clear()
    runs(root, False, every, [])
    every[:] = [(chain, re.sub(r"\s+", " ", t).strip(), n) for chain, t, n in every]
    every[:] = [(chain, t, min(n, len(t))) for chain, t, n in every if t]
    judge(root)
    left = [(chain, t) for chain, t, n in every if not bad.intersection(chain) and n <= LINKED * len(t)]
    at = root
    while True:
        weight = lambda e: sum(len(t) for chain, t in left if e in chain)
        inner = [c for c in at if c.tag not in inline]
        best = max(inner, key=weight, default=None)
        if best is None or not weight(best) or weight(best) < BODY * weight(at) or best.tag in ("p", "li", "td", "pre"):
            break
        at = best
    out, heads = [], []
    for chain, t in left:
        if at in chain:
            if re.fullmatch("h[1-6]", chain[-1].tag):
                heads.append(t)
            elif len(t) >= LETTERS or t.endswith(CLOSED):
                out, heads = [*out, *heads, t], []
    return "\n".join(out) or None


def random_tree(draw, depth=0):
    words = lambda n: " ".join(draw.choice(["zinc", "shortens", "colds", "in", "trials."]) for _ in range(n))
    if depth and draw.random() < 0.45:
        tag = draw.choice(["p", "p", "li", "h2", "td"])
        link = f"<a>{words(draw.randint(0, 9))}</a>" if draw.random() < 0.4 else ""
        return f"<{tag}>{words(draw.randint(0, 12))} {link} {words(draw.randint(0, 4))}</{tag}>"
    tag = draw.choice(["div", "section", "article", "ul", "nav", "footer"]) if depth else "html"
    name = f' class="{draw.choice(["ad", "menu top", "text", "sidebar", "lead"])}"' if draw.random() < 0.3 and depth else ""
    inner = "".join(random_tree(draw, depth + 1) + (words(draw.randint(1, 5)) if draw.random() < 0.2 else "") for _ in range(draw.randint(1, 5))) if depth < 5 else words(8)
    return f"<{tag}{name}>{inner}</{tag}>"


def test_against_recursion():
    draw = random.Random(3)
    seen = set()
    for _ in range(400):
        html = random_tree(draw)
        want = by_recursion(html)
        assert main_content(html) == want, html
        seen.add(want is None)
    assert seen == {True, False}


def test_scraped(spark):
    html = f'<meta property="article:published_time" content="2024-03-01T10:00:00Z"><p>{LONG}</p>'
    rows = [(1, "https://www.WHO.int/a", html), (2, "https://b.org/x.pdf", f"[[PDF_TEXT]] {LONG} "), (3, "https://b.org", "<nav>x</nav>"), (4, None, None), (5, "https://b.org", "[[PDF_TEXT]]"), (6, None, html)]
    table = spark.createDataFrame([(i, u, h, "mine", 7) for i, u, h in rows], "page_id long, url string, html string, content string, _at int")
    got = {r.page_id: r for r in scraped(table).collect()}
    assert [got[i].content for i in range(1, 7)] == [LONG, LONG, None, None, None, LONG]
    assert [got[i].source for i in range(1, 7)] == ["who.int", "b.org", None, None, None, None]
    assert str(got[1].published_at) == "2024-03-01 10:00:00" and got[2].published_at is None and got[4]._at == 7
    assert scraped(table.limit(0)).count() == 0


def test_query_over_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r.content for r in queries()["ul16_main_content"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: main_content(h) for i, h in pages.items()}
    text = re.compile(r"<article>(.*?)</article>", re.S)
    for i, html in pages.items():
        inner = text.search(html or "")
        if inner and got[i]:
            bare = content.SPACE.sub("", re.sub("<[^>]+>", "", inner.group(1)))
            kept = content.SPACE.sub("", got[i])
            assert len(kept) >= 0.9 * len(re.sub("&[a-z]+;", "x", bare))
