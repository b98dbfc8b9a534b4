"""HTML extraction on pages of several makes, the operators' SQL, and the pipeline against its stages' brute force."""

from __future__ import annotations

import hashlib
import math

import compare
import corpus_pipeline
import numpy as np
import pytest

from folioflow.llm import html_text, queries
from folioflow.llm.common import shared_folder

SF = f"{compare.DATA}/sf0.001"
LONG = "A paragraph of some length that holds an article's words, as articles do, and goes on for a good while."
PAGES = {
    f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p>{LONG}<p>Short.<script>x('</p>')</script><footer>by</footer></article><aside>{LONG}</aside></body></html>": f"Head & line\n{LONG}\nShort.",
    f"<body class='has-sidebar'><div id=header>Site name</div><div class=content><h2>Title</h2><p>{LONG}</p><div class='ad-box'>Buy</div><ul><li>one thing<li>two</ul><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div></body>": f"Title\n{LONG}\none thing\ntwo\n{LONG}",
    f"<main><header><h1>T</h1></header><p>{LONG}</p><form><p>{LONG}</p></form><article class=comment><p>{LONG}</p></article></main>": f"T\n{LONG}",
    f"<div role=alert><p>{LONG}</p></div><p>a &lt; b<br>c\n\t d</p>": "a < b c d",
    "plain  words": "plain words",
    "<nav>only</nav>": "",
    "": "",
    "<p": "<p",  # a tag that the page breaks off in is text to the parser
    "</b></p><p>x<b>y</p><p>z": "xy\nz",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert html_text.main_text(html) == PAGES[html]


OTHER = LONG.replace("article", "second piece")
IN_MAIN = {
    f"<body><nav>Home</nav><main><article><h1>T</h1><p>{LONG}</p><p>End.</p></article></main></body>": f"T\n{LONG}\nEnd.",
    f"<main><section><h1>T</h1><article><p>{LONG}</p></article></section></main><p>{OTHER}</p>": f"T\n{LONG}",
    f"<main><article><p>{LONG}</p></article><article><h2>S</h2><p>{OTHER}</p></article></main>": f"{LONG}\nS\n{OTHER}",
    f"<main><article><p>{LONG * 9}</p></article><hr><hr><hr><hr><article><p>Short.</p></article></main>": f"{LONG * 9}\nShort.",
    f"<main><article><p>{LONG}</p><article><p>{OTHER}</p></article></article></main>": LONG,
    f"<main><article class=post><p>{LONG}</p></article><article class=teaser><p>{OTHER}</p></article></main>": LONG,
    f"<main><article class=promo><p>{LONG}</p></article></main>": LONG,
    f"<article><article><p>{LONG}</p></article></article>": LONG,
    f"<main><p>Search here</p></main><article><p>{LONG}</p><p>{LONG}</p></article>": f"{LONG}\n{LONG}",
}


@pytest.mark.parametrize("html", IN_MAIN)
def test_articles_in_main(html):
    assert html_text.main_text(html) == IN_MAIN[html]


IN_PARTS = {
    f"<body><div class=post><section><h2>A</h2><p>{LONG * 3}</p></section><section><h2>B</h2><p>{OTHER}</p></section></div></body>": f"A\n{LONG * 3}\nB\n{OTHER}",
    f"<body><div><h4>Head</h4><ul><li>one</ul><blockquote>said</blockquote><p>{LONG * 9}</p><p>{LONG * 9}</p><h2>End</h2><p>Short.</p><h2>None</h2></div></body>": f"Head\none\nsaid\n{LONG * 9}\n{LONG * 9}\nEnd\nShort.",
    f"<article><p>{LONG * 3}</p></article><article><h2>B</h2><p>{OTHER}</p></article>": f"{LONG * 3}\nB\n{OTHER}",
    f"<div><section><p>{LONG * 20}</p></section><section><h2>B</h2><p>{OTHER}</p></section></div>": f"{LONG * 20}\nB\n{OTHER}",
    f"<div><p>{LONG * 3}</p></div><nav>menu</nav><div>{OTHER}</div>": f"{LONG * 3}\n{OTHER}",
    f"<div><p>{LONG * 20}</p></div><nav>menu</nav><div>{OTHER}</div>": LONG * 20,
}


@pytest.mark.parametrize("html", IN_PARTS)
def test_article_in_uneven_parts(html):
    assert html_text.main_text(html) == IN_PARTS[html]


LINKS = "".join(f"<li><a href=/{i}>Another piece of ours, number {i}</a></li>" for i in range(5))
NAMED = {
    f"<body><div class=content><p>{LONG}</p><p>Short.</p></div><div class='footer-content'><p>{LONG}</p></div><div class='cookie-text'>{LONG}</div></body>": f"{LONG}\nShort.",
    f"<body class='nav-open'><div id='content-sidebar-wrap'><div class='main nav-open'><p>{LONG}</p></div><div class='widget-area'>{LONG}</div></div></body>": LONG,
    f"<main class=content><div><article><h1>T</h1><p>{LONG}</p></article></div><p>Read more here</p></main>": f"T\n{LONG}",
    f"<main><article><p>{LONG}</p><ul>{LINKS}</ul><p>{OTHER} See <a href=/x>this</a>.</p></article></main>": f"{LONG}\n{OTHER} See this.",
    f"<article><p>{LONG * 2}</p></article><article><a href=/y>{OTHER * 5}</a></article>": LONG * 2,
    f"<div><p>{LONG * 3}</p><p>{OTHER * 3}</p></div><article><h3><a href=/z>Card</a></h3><p>Few words.</p></article>": f"{LONG * 3}\n{OTHER * 3}",
    f"<article class='post comments-open'><p>{LONG}</p></article>": LONG,
    "<div><ul><li><a>Only</a><li><a>links</a><li><a>here</a></ul></div>": "Only\nlinks\nhere",
}


@pytest.mark.parametrize("html", NAMED)
def test_names_links_and_cards(html):
    assert html_text.main_text(html) == NAMED[html]


def unmarked_pages(n=60):
    """Pages whose menus, teasers and small print say nothing of their kind, and their articles."""
    rng = np.random.default_rng(5)
    text = lambda k: " ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 9))) for _ in range(k))
    short = lambda: "".join(f"<div><span>{text(3)}</span> <b>{text(1)}</b></div>" for _ in range(rng.integers(5, 9)))
    for _ in range(n):
        blocks = [text(int(rng.integers(40, 90))) for _ in range(rng.integers(3, 7))]
        yield f"<body><div>{short()}</div><div>{''.join(f'<p>{b}</p>' for b in blocks)}</div><div>{short()}</div></body>", "\n".join(blocks)


def test_ratios_decide(monkeypatch):
    pages = list(unmarked_pages())
    assert sum(html_text.main_text(h) == t for h, t in pages) == len(pages)
    rng = np.random.default_rng(6)
    for noise in (lambda r, *_: rng.random(len(r)), lambda r, *_: np.ones(len(r)), lambda r, *_: np.zeros(len(r))):
        monkeypatch.setattr(html_text, "smooth", noise)
        assert sum(html_text.main_text(h) == t for h, t in pages) < len(pages) / 2


def test_smoothing_and_threshold_by_hand():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 40):
        ratio = rng.random(n) * 100 * (rng.random(n) > 0.5)
        level = []
        for i in range(n):
            near = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(n, i + 3))}
            level.append(sum(w * ratio[j] for j, w in near.items()) / sum(near.values()))
        mean = sum(level) / n
        least = 0.5 * math.sqrt(sum((x - mean) ** 2 for x in level) / n)
        assert np.allclose(html_text.smooth(ratio), level)
        assert html_text.content_lines(ratio).tolist() == [x >= least for x in level]


def test_ratio_of_lines_by_hand():
    page = html_text.Collector()
    page.feed("<div><p>ab <b>cd</b> <a href=x>ef</a></p>gh<br>ij</div>")
    page.close()
    assert [("".join(x.parts).split(), x.tags, x.linked) for x in page.lines if x.parts] == [(["ab", "cd", "ef"], 5, 2), (["gh", "ij"], 2, 0)]


def test_extract(spark):
    rows = spark.createDataFrame([(1, None, "old"), (1, "<p>x &eacute;</p>", None), (2, "<p>" + "w " * 40000, "c")], "page_id long, html string, text string")
    found = html_text.extract(rows).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(1, ""), (1, "x é"), (2, ("w " * 40000).strip())]
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE)
def test_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), queries.ORACLE[name], compare.connection(SF)) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        path = f"{shared_folder(spark, 'stages')}/{number}"
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and after and kept.count() == len(after)
        if number < 4:
            assert set(kept.columns) == set(docs.columns)
        if number in (1, 3, 4):
            assert after == before
    assert after < set(every)
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == after
    assert whole.where("decoded_sha256 is null or n_tokens * 4 <> length(ids)").isEmpty()
    intact = {hashlib.sha256(r.text.encode()).hexdigest() for r in every.values()}
    assert {r.decoded_sha256 for r in whole.collect()} & intact


DOUBTED = ("related-work", "search-history", "dialog", "notice-of-death", "social-history", "widget-theory", "menu-of-the-day", "recommended-reading", "comment-on-method")


@pytest.mark.parametrize("name", DOUBTED)
def test_names_in_articles_exclude_only_low_ratios(name, monkeypatch):
    """A part of an article keeps its text whatever its class says; the same element full of links goes, by its ratio alone."""
    page = "<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{0}</p><p>{0}</p><section class='{1}'><h2>Head</h2>{2}</section><p>{0}</p></article></body>"
    part, links = f"<p>{OTHER * 2}</p><p>{OTHER}</p>", "<ul><li><a href=/1>One story</a></li><li><a href=/2>Other story</a></li></ul>"
    whole = f"T\n{LONG * 3}\n{LONG * 3}\nHead\n{OTHER * 2}\n{OTHER}\n{LONG * 3}"
    less = f"T\n{LONG * 3}\n{LONG * 3}\n{LONG * 3}"
    assert html_text.main_text(page.format(LONG * 3, name, part)) == whole
    assert html_text.main_text(page.format(LONG * 3, name, links)) == less
    # With noise instead of smoothed ratios some of both come out otherwise.
    changed = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        monkeypatch.setattr(html_text, "smooth", lambda ratio, *_, rng=rng: rng.random(len(ratio)))
        changed += html_text.main_text(page.format(LONG * 3, name, part)) != whole
        changed += html_text.main_text(page.format(LONG * 3, name, links)) != less
    assert changed > 10


def test_parts_of_other_kinds_go():
    page = "<article><h1>T</h1><p>{0}</p><div class='{1}'>{2}</div><p>{0}</p></article>"
    for name in ("ad", "ad-box", "comment-list", "comments", "cookie-notice", "newsletter-signup", "sidebar-left", "promo"):
        assert html_text.main_text(page.format(LONG * 2, name, f"<p>{OTHER}</p>")) == f"T\n{LONG * 2}\n{LONG * 2}"


def test_sources_stay_and_teasers_go():
    sources = "<h2>Sources</h2><ul><li><a href=/1>One source</a></li><li><a href=/2>Two sources</a></li><li><a href=/3>Three</a></li></ul>"
    teaser = f"<div class='more'><article><h2>Another</h2><p>{OTHER}</p></article></div>"
    found = html_text.main_text(f"<body><article><h1>T</h1><p>{LONG * 2}</p><p>{LONG}</p>{sources}</article>{teaser}</body>")
    assert found == f"T\n{LONG * 2}\n{LONG}\nSources\nOne source\nTwo sources\nThree"


def test_pages_with_clashing_columns(spark):
    rows = [(1, f"<article><p>{LONG}</p></article>", "a", "b", 7), (None, None, None, None, None), (1, "", "a", "b", 7)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string, url string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars or 0, r.text) for r in found) == [(0, "", 0, ""), (1, "b", 7, ""), (1, "b", 7, LONG)]
