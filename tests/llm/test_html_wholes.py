import random
import time

import pytest

from ndspark.llm import html

PROSE = [f"Paragraph {i}, with some words, tells of a long way, and of what came after it, in the end." for i in range(10)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize("mark", ['class="content with-sidebar"', 'class="site has-sidebar"', 'class="no-comments"', 'class="post share-enabled"', 'id="community"', 'class="social"'])
def test_wrappers_are_not_dropped_for_a_word(mark):
    for tag in ("article", "main", "div"):
        page = f"<body><div {mark}><{tag}>{BODY}</{tag}></div><div class='sidebar'><p>Aside, a, b, c.</p></div></body>"
        assert html.main_text(page).split("\n") == PROSE


def test_comments_stay_out():
    page = f"<body><article>{BODY}</article><div class='comments'><article><p>{'Yes, I think so, too. ' * 90}</p></article></div></body>"
    assert html.main_text(page).split("\n") == PROSE


def test_attributes_are_read_by_name():
    page = f'<article>{BODY}<p title="a hidden gem">See <a href="/hidden-valley">the valley</a> there.</p><p data-id="comments">Last one.</p><p hidden>No.</p><p aria-hidden=true>No.</p></article>'
    assert html.main_text(page).split("\n") == [*PROSE, "See the valley there.", "Last one."]


def test_text_split_over_sections():
    page = f"<body><div><div>{BODY}</div><h2>Next</h2><ul><li>one</li></ul><blockquote>Quote</blockquote><pre>code</pre><div><p>A short one.</p></div></div></body>"
    assert html.main_text(page).split("\n") == [*PROSE, "Next", "one", "Quote", "code", "A short one."]
    deep = f"<body><div><section><h2>One</h2><div>{BODY}</div></section><section><h2>Two</h2><div><p>A short one.</p></div></section></div></body>"
    assert html.main_text(deep).split("\n") == ["One", *PROSE, "Two", "A short one."]


def test_references_in_the_article_stay():
    page = f"<body><ul><li><a href=a>Home</a></li></ul><article>{BODY}<p><a href=b>A paper on it</a></p><ol><li><a href=c>A book</a></li></ol></article></body>"
    assert html.main_text(page).split("\n") == [*PROSE, "A paper on it", "A book"]


def test_short_parts_and_links_stay():
    assert html.main_text(f"<body><article>{BODY}<p><a href=x>one link</a></p></article></body>").split("\n") == [*PROSE, "one link"]
    assert html.main_text("<body><div>Short one.</div><div>Short two.</div><div>Short three.</div></body>").split("\n") == ["Short one.", "Short two.", "Short three."]
    for mark in ("print", "copyright-law"):
        page = f"<body><article><div class='{mark}'>{BODY}</div><p>Last.</p></article></body>"
        assert html.main_text(page).split("\n") == [*PROSE, "Last."]
    page = f"<body><article>{BODY}<div class='share-tools'><p>Share it, now.</p></div></article></body>"
    assert html.main_text(page).split("\n") == PROSE


def _tree(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        words = ", ".join(rng.choice(["a few words", "one", "of it", "x" * rng.randrange(1, 200)]) for _ in range(rng.randrange(1, 8)))
        return ("p", words, rng.random() < 0.15)
    return (rng.choice(["div", "section", "article", "blockquote", "ul"]), [_tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))])


def _source(x):
    if x[0] == "p":
        return f"<p><a href=l>{x[1]}</a></p>" if x[2] else f"<p>{x[1]}</p>"
    return f"<{x[0]}>{''.join(map(_source, x[1]))}</{x[0]}>"


def _scores(x, out):
    """(points by distance, characters, linked ones) of a subtree; scores of its containers."""
    if x[0] == "p":
        return [] if x[2] else [(1 + x[1].count(",") + min(len(x[1]) / 100, 3), 1)], 0 if x[2] else len(x[1])
    points, chars = [], 0
    for child in x[1]:
        own, n = _scores(child, out)
        points += own
        chars += n
    if points:
        out.append(round(html.START.get(x[0], 0.0) + sum(p / d for p, d in points), 6))
    return [(p, d + 1) for p, d in points], chars


@pytest.mark.parametrize("seed", range(60))
def test_scores_equal_their_definition(seed):
    tree = ("body", [_tree(random.Random(seed), 5)])
    want = []
    points, _ = _scores(tree, want)
    if points:
        want.append(round(sum(p / d for p, d in points), 6))  # the page itself
    got = [round(score, 6) for _, score in html._scored(html._blocks(f"{_source(tree)}"))]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("part, end", [("<div>", "<p>text, here</p>"), ("<div class=ad><p>t, x</p>", ""), ("<div><p>t, x</p>", ""), ("<b>", "x" + "</i>" * 20000), ("<a href='", ""), ("<ul><li>", "")])
def test_time_is_linear_in_nesting(part, end):
    took = []
    for n in (5000, 20000):
        began = time.process_time()
        html.main_text(part * n + end)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_empty_tables_ties_and_null_keys(spark):
    kinds = "page_id long, url string, html string, text int"
    assert html.extract_text(spark.createDataFrame([], kinds)).count() == 0
    page = f"<body><div>{BODY}</div></body>"
    rows = [(None, None, page, 1), (7, "u", page, 1), (7, "u", page, 1), (8, "u", "<p>" + "word, " * 200_000, 1)]
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html.extract_text(spark.createDataFrame(rows, kinds)).collect()))
    n = len("\n".join(PROSE))
    assert got == [(0, n), (7, n), (7, n), (8, 1_200_000 - 1)]
