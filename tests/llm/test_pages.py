"""Labels of whole pages against brute force, and what the minimum cut and names decide."""

import itertools
import random

import numpy as np
import pytest

from paylens.llm import html_extract as he

ARTICLE = "<p>This is the first sentence of the article. It goes on for a while with words.</p><p>Another paragraph follows here. It has several sentences, with many words. And more.</p>"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
REMARK = "<p>I read this with interest. It is a rather long remark by a reader.</p>"
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def weights(spark):
    return he.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", ["comments", "comment-list", "advert", "cookie-notice", "sidebar", "related", "newsletter"])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="post">%s</div>', "<div>%s</div>", "%s"])
def test_named_boilerplate_goes(weights, name, wrap):
    page = f'<html><body>{NAV}{wrap % (ARTICLE * 2)}<div class="{name}">{REMARK}</div><footer>&copy; me</footer></body></html>'
    got = he.extract(page, weights)
    assert "remark by a reader" not in got and got.count("first sentence") == 2 and "Home" not in got
    inside = f'<html><body>{NAV}<article>{ARTICLE * 2}<div class="{name}">{REMARK}</div></article></body></html>'
    assert "remark by a reader" not in he.extract(inside, weights)


def test_the_cut_keeps_blocks_that_the_classifier_alone_would_lose(weights):
    page = f"""<html><body><div><a href=/>Home</a> <a href=/b>News</a></div><div><h1>Title of the page</h1>{ARTICLE}<blockquote>A quoted remark, without end</blockquote>
      <ul><li>first point of it</li><li>second point</li></ul><p>Some words follow. They close the article, with a few more words.</p></div><div><a href=/x>Imprint</a></div></body></html>"""
    parsed = he.parse(page)
    alone, labels = [o > 0 for o in he.own_odds(parsed, weights)], he.label(parsed, weights)
    changed = [b.text for b, a, now in zip(parsed.blocks, alone, labels) if a != now]
    assert changed == ["A quoted remark, without end", "first point of it", "second point"]
    assert he.extract(page, weights).split("\n\n")[0] == "Title of the page" and "Imprint" not in he.extract(page, weights)


def least_cost(odds, edges, n):
    """Least cost of labelling the blocks, over all labels of blocks and containers."""
    best = {}
    for x in itertools.product([False, True], repeat=n):
        cost = sum(max(-o, 0.0) if x[k] else max(o, 0.0) for k, o in enumerate(odds)) + sum(c for a, b, c in edges if x[a] != x[b])
        key = x[: len(odds)]
        best[key] = min(best.get(key, np.inf), cost)
    return best


def test_labels_of_small_pages_are_of_least_cost(weights):
    rng = random.Random(3)
    pieces = ["<p>One sentence here. And another one.</p>", "<li>a point</li>", "<h2>Head</h2>", "<div><a href=/>x</a></div>", "<div>some words</div>", "<nav>m</nav>", '<div class="ad">Buy. Now.</div>']
    flipped = 0
    for _ in range(60):
        inner = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
        page = he.parse(f"<html><body><div>{inner}</div>{rng.choice(pieces)}<section>{rng.choice(pieces)}{rng.choice(pieces)}</section></body></html>")
        edges, n = he.ties(page)
        odds = he.own_odds(page, weights)
        if n > 14:
            continue
        costs, labels = least_cost(odds, edges, n), tuple(he.label(page, weights))
        assert costs[labels] == pytest.approx(min(costs.values()))
        flipped += sum((o > 0) != x for o, x in zip(odds, labels))
    assert flipped > 0


def test_pages_of_the_table_give_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    n = 0
    for r in he.extract_pages(rows).join(rows, "page_id").select("html", "text", "n_chars").collect():
        marked = "\n\n".join(b.text for b in he.parse(r.html or "").blocks if b.mark > 0)
        assert r.n_chars == len(r.text)
        n += r.text == marked
    assert n >= 0.98 * rows.count()


def test_clashing_columns_and_long_pages(spark):
    long = "<article>" + "<p>A paragraph of the page. It is one of many, with some words.</p>" * 5000 + "</article>" + f"<div class=comments>{REMARK * 500}</div>"
    rows = [(1, "u", NAV + long, 1, "t"), (None, None, None, None, None), (1, "u", NAV + long, 1, "t")]
    df = spark.createDataFrame(rows, SCHEMA + ", n_chars int, text string")
    got = he.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.text.count("one of many"), r.text.count("remark")) for r in got) == [(0, 0, 0), (1, 5000, 0), (1, 5000, 0)]
