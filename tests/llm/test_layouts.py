"""Extraction from hand-made layouts: every wrapper of an article with every kind of what is not the article."""

import itertools

import pytest

from terravow.llm import html_extract

PROSE = [
    "The council met on Tuesday, and after three hours of debate it agreed to repair the old bridge before winter.",
    "Engineers had warned that two of the piers were worn; nobody disputed their report, though some disputed the price.",
    "Work begins in May.",
    "A second bridge, further up the river, is to be looked at next year, when the money for it has been found.",
]
TRUTH = "\n".join(["Bridge to be repaired", *PROSE])
ARTICLE = "<h1>Bridge to be repaired</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
WRAPPERS = [
    "<article>{}</article>",
    "<main>{}</main>",
    '<div class="wrap">{}</div>',
    '<div class="layout with-sidebar">{}</div>',
    '<div class="side-by-side">{}</div>',
    '<div class="page no-ads">{}</div>',
    '<div class="share price report">{}</div>',
    '<section class="post comments-open">{}</section>',
    '<div id="notice"><div class="inner">{}</div></div>',
    '<div class="sidebar-layout"><div class="content">{}</div></div>',
    '<body class="has-sidebar hide-footer">{}',
]
BESIDE = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul></nav>',
    '<div class="nav-primary"><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Weather</a></div>',
    "<footer>All rights reserved by the paper. Nothing here may be printed again without leave, in whole or in part.</footer>",
    '<div class="site-footer"><p>Written and printed in the town, every day but Sunday, since 1901.</p></div>',
    '<div class="ad">Buy two pairs of boots this week, and a third pair is yours for nothing at all.</div>',
    '<aside><h3>Most read</h3><p>Mayor opens new library, and says that more are to follow in the next years.</p></aside>',
    '<div class="comments-list"><p>I walked over it yesterday, and it shook. High time that something is done about it.</p><p>First!</p></div>',
    '<ol class="commentlist"><li>They said the same ten years ago, and nothing came of it then, as everybody knows.</li></ol>',
    '<div class="cookie-banner">We keep cookies on your device. <button>Fine</button> You may read more about it in our policy.</div>',
    '<form><label>Your name</label><input><textarea>Say something</textarea></form>',
    '<div role="complementary"><p>Our newsletter brings you the news of the week, every Friday, free of charge.</p></div>',
    '<div class="share-box">Tell your friends about this page.</div>',
    '<script>var x = "<p>not text</p>";</script><style>p{}</style><noscript>Turn it on.</noscript>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("first", [True, False])
def test_article_comes_out_whole_and_alone(wrapper, first):
    for beside in BESIDE:
        parts = [beside, wrapper.format(ARTICLE)] if first and "body" not in wrapper else [wrapper.format(ARTICLE), beside]
        page = "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"
        assert html_extract.main_text(page) == TRUTH, (wrapper, beside)


def test_all_at_once():
    for wrapper, inside in itertools.product(WRAPPERS[:-1], (BESIDE[4], BESIDE[11], BESIDE[6])):
        held = ARTICLE.replace("<p>Work", f"{inside}<p>Work")
        page = "<body>" + "".join(BESIDE[:4]) + wrapper.format(held) + "".join(BESIDE[5:]) + "</body>"
        assert html_extract.main_text(page) == TRUTH, (wrapper, inside)


def test_flow_decides_against_the_threshold(monkeypatch):
    """A line in the article that says nothing for itself, and prose among the comments, go by their surroundings."""
    ran = []
    flow = html_extract._max_flow
    monkeypatch.setattr(html_extract, "_max_flow", lambda *x: ran.append(1) or flow(*x))
    page = f"<body><article>{ARTICLE}<p><a href='/x'>See the plan</a></p><p>{PROSE[0]}</p></article>{BESIDE[6]}</body>"
    assert html_extract.main_text(page) == f"{TRUTH}\nSee the plan\n{PROSE[0]}"
    assert ran
