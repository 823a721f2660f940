"""Main text of pages labelled by hand, in layouts that the generator of training pages doesn't make.

A leading `+` marks the blocks that are main text; it is taken off before the page is read.
"""

from __future__ import annotations

import pytest

from winnow.llm import html_text

#: 144 words; two of them make 20,736 names.
DEEP = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "qi", "ra", "so", "tu", "ve", "wi", "zo") for b in ("bel", "dor", "fin", "gam", "hul", "jas", "kem", "lip", "mon", "nar", "pus", "ret")]

NEWS = """<!doctype html><html><head><title>x</title><link rel="stylesheet" href="a.css"></head><body class="story-page">
<header class="masthead"><a class="logo" href="/">The Daily Lantern</a><nav aria-label="Sections"><a href="/w">World</a> <a href="/b">Business</a> <a href="/s">Sport</a></nav></header>
<div id="cookie-banner"><p>We use cookies to improve your visit. By staying you agree.</p><button>Accept</button></div>
<main><article itemscope><h1>+Harbour bridge reopens after nine months of repairs</h1>
<p>+The old harbour bridge carried its first cars on Tuesday, nine months after cracks were found in two of its pillars.</p>
<p>+&ldquo;We tested every bolt,&rdquo; said the engineer in charge, &ldquo;and then we tested them again.&rdquo;</p>
<aside class="related-links"><h4>Related</h4><ul><li><a href="/1">Ferry fares to rise in spring</a></li><li><a href="/2">A walk along the docks</a></li></ul></aside>
<p>+Traffic was light at first, and by noon the queue reached the market square.</p></article></main>
<section id="comments" class="comment-thread"><h3>12 comments</h3><div class="comment"><p>Joe</p><p>About time they finished it, my commute has doubled.</p></div></section>
<footer class="site-footer"><p>&copy; 2021 The Daily Lantern. All rights reserved.</p></footer></body></html>"""

BLOG = """<html><body><div id="wrap"><div id="header"><h1><a href="/">kitchen notes</a></h1><p>cooking, mostly slowly</p></div>
<div class="sidebar widget-area"><h3>Archive</h3><ul><li><a href="/05">May</a></li><li><a href="/04">April</a></li></ul></div>
<div class="post hentry"><h2>+Bread without a machine</h2><div class="entry-content"><p>+Flour, water, salt and a little yeast are all that is needed, and a bowl that is large enough.</p>
<ol><li>+Mix everything in the evening.</li><li>+Fold the dough twice before bed.</li><li>+Bake it in a hot pot in the morning.</li></ol>
<blockquote>+Patience is the fifth ingredient, as my aunt used to say.</blockquote>
<p>+It keeps for three days, if nobody finds it.</p></div><ul class="share-buttons"><li><a href="#">Tweet</a></li><li><a href="#">Pin it</a></li></ul></div>
<form class="newsletter-signup"><p>Get new recipes by mail</p><input type="email"><button>Join</button></form>
<div id="footer">Powered by patience and a small server &copy; kitchen notes</div></div></body></html>"""

MANUAL = """<html><body><nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li></ul></nav>
<main class="doc-content"><h1>+Getting started</h1><p>+Unpack the archive into any folder that you can write to.</p><pre>+tar xf tool.tar.gz
cd tool</pre><table><tr><th>+Option</th><th>+Meaning</th></tr><tr><td>+--fast</td><td>+skips the slow checks</td></tr></table>
<h2>+Configure</h2><p>+Settings are read from a file in the same folder, one to a line.</p></main>
<footer>Copyright the authors</footer></body></html>"""

FORUM = """<html><body><div class="topbar"><a href="/">forum</a> <a href="/login">log in</a> <a href="/register">register</a></div>
<div class="breadcrumbs"><a href="/">home</a> &raquo; <a href="/garden">garden</a></div>
<div class="article-body"><h1>+Tomatoes that survived the frost</h1><p>+Last winter we left six plants outside by mistake, and two of them lived until March.</p>
<p>+They stood against the south wall, under a sheet that the wind had blown over them.</p></div>
<div class="replies"><div class="reply"><p>marta</p><p>Same here, but mine were under the stairs.</p></div><div class="reply"><p>old_sam</p><p>Which kind were they?</p></div></div>
<div class="ad sponsored"><p>Greenhouses at half price, this week only!</p></div></body></html>"""


@pytest.mark.parametrize("page", [NEWS, BLOG, MANUAL, FORUM], ids=["news", "blog", "manual", "forum"])
def test_pages_labelled_by_hand(page):
    want = [b.text.replace("+", "") for b in html_text.blocks(page) if "+" in b.text]
    got = html_text.main_text(page.replace("+", ""), html_text.trained_field()).split("\n")
    assert got == want


def test_blocks_that_the_layouts_are_told_by():
    """At most one block of these pages may go wrong with a field that is trained on fewer and other pages."""
    model = html_text.train([(html_text.features(html_text.blocks(p)), labels) for p, labels in html_text.labelled_pages(500, seed=3)])
    wrong = total = 0
    for page in (NEWS, BLOG, MANUAL, FORUM):
        marked = html_text.blocks(page)
        told = model.decode(html_text.features(html_text.blocks(page.replace("+", ""))))
        wrong += sum(("+" in b.text) != bool(t) for b, t in zip(marked, told, strict=True))
        total += len(marked)
    assert total > 50 and wrong <= 1


@pytest.mark.parametrize(
    "page",
    [
        "".join(f'<div class="{a}{b} name{a}">text {a} {b}' for a in DEEP for b in DEEP),
        "".join(f'<div class="content sidebar {a}{b}"><b>text {a} {b}' for a in DEEP for b in DEEP),
        "<ul>" + "<b>" * 20_000 + "<li>one</li>" * 20_000,
        "<i>" * 20_000 + "</u>" * 20_000 + "<p>text" * 20_000,
        '<div class="' + "alpha " * 20_000 + '">' + "<p>text</p>" * 20_000,
    ],
)
def test_deep_pages_take_linear_time_and_memory(page):
    """20,000 unclosed elements, each with names of its own; end tags of nothing; items far from their list."""
    import time
    import tracemalloc

    model = html_text.Field({"bias": 1.0, "name:content": 0.5, "name:sidebar": -0.2, "near:content": 0.1, "tag:div": 0.3})
    began = time.process_time()
    text = html_text.main_text(page, model)
    assert time.process_time() - began < 3 and len(text.split("\n")) >= 1
    tracemalloc.start()
    assert html_text.main_text(page, model) == text
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
