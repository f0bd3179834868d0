"""HTML extraction: the parser on hand-made pages, the cut against all labellings, the classifier on pages held out."""

import html as entities
import itertools
import random
import re
import time

import numpy as np
import pytest

from lacuna.llm import html_samples, main_text
from lacuna.llm.html_blocks import parse

CASES = [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b<br>c<b>d</b>e", ["a", "b cde"]),
    ("<p>a &lt;b&gt; &#233;&nbsp;x &am", ["a <b> é x &am"]),
    ("<script>var t='</p><p>no';</script><p>yes</p><style>p{}</style>", ["yes"]),
    ("<SCRIPT>x</SCRIPT ><!-- <p>no</p> --><p>y</p><!-- open <p>no", ["y"]),
    ("a < b and <3 <p>c</p>", ["a < b and <3", "c"]),
    ('<div title="a > b" class=\'x\'>t</div>', ["t"]),
    ("<ul><li>one<li>two<ul><li>in</ul>rest</ul>", ["one", "two", "in", "rest"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
    ("<p>a<select><option>no</select> b<button>no</button></p>", ["a b"]),
    ("<p>x <svg><text>no</text></svg>y</p></div></p></body>z", ["x y", "z"]),
    ("<p>a <button>left open", ["a left open"]),
    ("<p>cut <a hre", ["cut"]),
    ("<dl><dt>t<dd>d</dl><hr>e<?php x ?><!doctype html>", ["t", "d", "e"]),
    ("x\x00y <p>퟿</p>", ["x\x00y", "퟿"]),
]


@pytest.mark.parametrize("page, want", CASES)
def test_blocks(page, want):
    assert parse(page).texts == want


def test_links_and_owners():
    page = parse('<div id=a><p>one <a href="/x">two</a> <a name=y>three</a></p><a href=z><p>all</p></a></div><p>none</p>')
    assert page.texts == ["one two three", "all", "none"] and page.linked == [3, 3, 0]
    assert [page.tags[k] for k in page.owners] == ["p", "p", "p"] and page.names[1] == "a"


def energy(odds, joined, label):
    return sum(max(0, -u) if y else max(0, u) for u, y in zip(odds, label)) + sum(w for a, b, w in joined if label[a] != label[b])


def test_cut_against_all_labellings():
    r = random.Random(4)
    for case in range(400):
        n = r.randrange(1, 10)
        scale = r.choice([0.3, 1.0, 4.0])
        odds = [r.choice([0.0, r.gauss(0, scale), float(r.randrange(-2, 3))]) for _ in range(n)]
        joined = [(a, b, r.choice([1.0, r.random(), 0.0])) for a in range(n) for b in range(a + 1, n) if r.random() < r.choice([0.3, 0.9])]
        best = min(energy(odds, joined, x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(odds, joined, main_text.minimum_cut(odds, joined)) - best) < 1e-9, case


def test_classifier_on_pages_held_out():
    weights = np.array(main_text.classifier())
    for clear, precision, recall in ((1.0, 0.99, 0.98), (0.5, 0.85, 0.95)):
        hit = wrong = missed = 0
        for html, labels in html_samples.labelled_pages(200, seed=77, clear=clear):
            for text, kept in main_text.labelled(html, weights):
                hit, wrong, missed = hit + (kept and labels[text]), wrong + (kept and not labels[text]), missed + (not kept and labels[text])
        assert hit >= precision * (hit + wrong) and hit >= recall * (hit + missed)


def kept(html):
    return [t for t, y in main_text.labelled(html, np.array(main_text.classifier())) if y]


WORDS = "The council voted on Tuesday to repair the old bridge over the river, which has been closed since the storm."


def test_layouts():
    more = [f"{WORDS} Part {k} of the report." for k in range(4)]
    paragraphs = "".join(f"<p>{x}</p>" for x in more)
    comments = "".join(f"<li class='comment'><article><footer>User {k}</footer><p>I think that {WORDS} Reply {k}.</p></article></li>" for k in range(6))
    blog = f"""<body class="single has-sidebar"><div id="page"><header class="site-header"><h1><a href="/">My site</a></h1><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav></header>
      <div id="content"><main><article class="post"><header class="entry-header"><h1>Bridge to be repaired</h1></header><div class="entry-content">{paragraphs}<ul><li>First point<li>Second point</ul><div class="ad-slot">Buy now!</div><p>Short end.</p></div></article>
      <section id="comments" class="comments-area"><h2>6 comments</h2><ol>{comments}</ol><form><p>Leave a reply</p><textarea>x</textarea></form></section></main>
      <aside class="widget"><h3>Recent posts</h3><ul><li><a href="/p">Other news of the day</a></ul></aside></div><footer>© 2024 My site. All rights reserved.</footer></div></body>"""
    assert kept(blog) == ["Bridge to be repaired", *more, "First point", "Second point", "Short end."]
    old = f"""<body><form action=x><div class=menu><a href=1>One</a> | <a href=2>Two</a></div><div class="cookie-banner"><p>We use cookies to give you the best experience.</p></div>
      <table><tr><td><h1>Bridge</h1>{paragraphs}</td></tr></table><div class=footer>Copyright 2024</div></form></body>"""
    assert kept(old) == ["Bridge", *more]
    bare = f"<body><h1>Bridge</h1>{paragraphs}<p style='display: none'>secret words that nobody sees, at some length, in a paragraph</p></body>"
    assert kept(bare) == ["Bridge", *more]
    assert kept("<nav><a href=1>One</a></nav><footer>© x</footer>") == []


def test_query_on_the_table(spark):
    """The table's pages have one layout, whose article regular expressions can cut out."""
    from lacuna.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op11_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        want = "\n\n".join(x for x in parts if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_edges(spark):
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (1, "u", "", "b"), (2, None, "<p>" + WORDS * 3, "c"), (None, "u", "<article><p>é</p></article>", "d")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(2)
    got = sorted(map(tuple, main_text.extract(pages).collect()), key=repr)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, None, WORDS * 3, 3 * len(WORDS)), (None, "u", "é", 1)], key=repr)
    assert main_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("html", ["<div>" * 300_000, "<li>x" * 200_000, "<a '" * 300_000, '<p class="' * 200_000, "a" * 5_000_000, "<p>x</p><div>" * 100_000, "<p " + "x" * 3_000_000 + ">y", "<button>" * 300_000, "&" * 2_000_000, "<!--" * 500_000, "</p><svg>" * 200_000, "<p>word one two</p><div class=ad>x</div>" * 30_000])
def test_work_grows_with_the_length(html):
    start = time.process_time()
    main_text.labelled(html, np.array(main_text.classifier()))
    assert time.process_time() - start < 40
