from __future__ import annotations

import html
import re

import pytest

from sparkloom.llm import extraction
from sparkloom.llm.queries import op7_extraction, table


@pytest.fixture(scope="module")
def model():
    return extraction.fit()


def article(source):
    """The text of the article element, the plain way; these tables' pages hold all content in one."""
    inside = re.search(r"<article>(.*?)</article>", source or "", re.S)
    text = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", inside[1]) if inside else ""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", text)).split())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = op7_extraction(spark, sf).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert sum(r.text == article(pages[r.page_id].html) for r in rows) >= 0.99 * len(rows)


def test_held_out_layouts(model):
    wrong = total = 0
    for source in extraction.labelled_pages(150, seed=77):
        nodes = extraction.tree(source)
        good = [extraction.MARK in x.text for x in nodes]
        for x in nodes:
            x.text = x.text.replace(extraction.MARK, "")
        extraction.measured(nodes)
        for x, g, p in zip(nodes, good, extraction.marginals(nodes, *model)):
            if x.tag == "#text":
                total += 1
                wrong += g != (p >= 0.5)
    assert wrong / total < 0.02


def test_marginals_equal_brute_force(model):
    """Sum-product on a small tree against the sum over all labellings."""
    import itertools
    import math

    nodes = extraction.tree("<div class=content><p>One two, three.<a href=x>four</a></p></div>")
    extraction.measured(nodes)
    weights, ties = model
    live = [i for i in range(1, len(nodes)) if nodes[i].tag != "#space"]
    own = {i: sum(weights[k] * v for k, v in extraction.features(nodes[i], nodes[nodes[i].parent])) for i in live}
    total, on = 0.0, dict.fromkeys(live, 0.0)
    for labels in itertools.product((0, 1), repeat=len(live) + 1):
        y = dict(zip([0, *live], labels))
        w = math.prod(math.exp(own[i] * y[i]) * ties[extraction.kind_of(nodes[i], nodes[nodes[i].parent])][2 * y[nodes[i].parent] + y[i]] for i in live)
        total += w
        for i in live:
            on[i] += w * y[i]
    p = extraction.marginals(nodes, weights, ties)
    assert all(abs(p[i] - on[i] / total) < 1e-6 for i in live)


def test_shapes(model):
    page = "<html><head><title>no</title></head><body><header>Site name</header><nav><a href=/>Home</a></nav><article><h1>Ti&amp;tle</h1><p>First\n  para <b>bo</b>ld, with a comma.<br>next<script>x</script><p>Second &eacute; para, longer text here.</p></article><div class='comments'><p>I disagree with this.</p></div><footer>&copy; all</footer>"
    assert extraction.main_text(page, model) == "Ti&tle First para bold, with a comma. next Second é para, longer text here."


def test_edges(spark, model):
    deep = "<div>" * 3000 + "<p>deep text, really.</p>" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<<<>>> </p></p><"), (4, "u", "<article><p>" + "long text, yes. " * 50_000), (5, "u", deep), (5, "u", deep), (None, "u", "<script>var x"), (6, "u", "<!-- open <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "3 as n_chars")
    got = [(r.page_id, r.text) for r in extraction.extract(df, model=model).collect()]
    by = dict(got)
    assert len(got) == len(rows) and by[1] == by[2] == by[None] == by[6] == "" and len(by[4]) == 16 * 50_000 - 1
    assert extraction.extract(df.limit(0), model=model).collect() == []


def test_time_grows_with_the_length_of_malformed_pages():
    import time

    model = extraction.fit(20, 20)
    half = 500_000
    for piece in ("<a ", "<a \"", "<a '>\" ", "<!", "<!--", "<button>", "</b", "<div>", "<i></x>", "<svg></svg ", "<p><b>", "<", "<td><i>", "a < b & ", "<script"):
        start = time.monotonic()
        extraction.main_text("<p>Some words of text.</p>" + piece * (half // len(piece)), model)
        assert time.monotonic() - start < 20, piece
    assert extraction.main_text("<article><p>One two, three.</p><p title='a > b'>Four < five.</p></article><a ", model).startswith("One two, three. Four < five.")


CONTAINERS = ['div class="sidebar"', "aside", "footer", "nav", 'div id="comments"', 'div class="comments"', 'section class="comments"', 'div class="cookie-banner"', 'div class="advert"', "form", 'section class="related"']
SAID = "Our visitors say, quite often, that these few lines are useful. They name the hours, the places and the people; they also tell, in short, what comes next. Read them twice, and ask us, if anything in them seems odd or old."


@pytest.mark.parametrize("container", CONTAINERS)
def test_boilerplate_in_nested_wrappers(model, container):
    """Prose in a container of boilerplate is left out, whatever wrappers stand between and wherever the container stands."""
    long = ["First the river, then the road: both run north, past fields and old mills, until the hills begin to rise.", "Later, when the rain had stopped, the men went down to the bridge, and there they waited for the boat to come."]
    inner, outer = [f"<p>{x}</p>" for x in long], " ".join(long)
    for wrappers in ("", "div", "section", "li", "article", "div section", "section div", "div div div", "div article div", "li div section"):
        said = f"<p>{SAID}</p>"
        for w in reversed(wrappers.split()):
            said = f"<{w}>{said}</{w}>"
        junk = f"<{container}>{said}</{container.split()[0]}>"
        for page in (f"{junk}<article>{''.join(inner)}</article>", f"<article>{''.join(inner)}</article>{junk}", f"<article>{inner[0]}{junk}{inner[1]}</article>"):
            assert extraction.main_text(f"<html><body>{page}</body></html>", model) == outer, (wrappers, page)


@pytest.mark.parametrize("depth", [400, 600, 5000])
def test_deep_pages_are_read_alike(model, depth):
    page = "<article><p>One, two, three and four: a text, with words.</p></article>" + "<div>" * depth + "</div>" * depth + f'<div class="sidebar"><p>{SAID}</p></div>'
    assert extraction.main_text(f"<body>{page}</body>", model) == "One, two, three and four: a text, with words."
    inside = "<div>" * depth + f'<div class="sidebar"><p>{SAID}</p></div>' + "</div>" * depth
    assert extraction.main_text(f"<body><article><p>One, two, three and four: a text, with words.</p></article>{inside}</body>", model) == "One, two, three and four: a text, with words."
