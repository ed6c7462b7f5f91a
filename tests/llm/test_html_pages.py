"""HTML extraction on pages as they are found: odd end tags, teasers, forms, names, deep nesting, sites without articles."""

import time

import numpy as np
import pytest

from velograph.llm import op09_html
from velograph.llm.op09_html import CHROME, MAIN, NEUTRAL


def _main(page):
    return " ".join(t for k, t in op09_html.blocks(page) if k == MAIN)


def _text(page):
    return " ".join(t for k, t in op09_html.blocks(page) if k != CHROME)


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "iframe", "svg", "noscript", "template"])
@pytest.mark.parametrize("end", ["</{}>", "</{} >", "</{}/>", "</{} foo>", "</{}\n x='1'>"])
def test_end_tags_with_more_in_them(tag, end):
    assert _main(f"<article><p>a</p><{tag}>1{end.format(tag)}<p>b</p></article>") == "a b"


def test_an_end_tag_of_another_name_ends_nothing():
    assert _main("<article><p>a</p><script>1</scripts>2</script><p>b</p></article>") == "a b"


@pytest.mark.parametrize(
    "page,want",
    [
        ('<main>story</main><aside class="sidebar"><article class="teaser">Other story</article></aside>', "story"),
        ('<main>story</main><nav><article class="card">Other</article></nav>', "story"),
        ("<main>story</main><aside><aside>x</aside><article>Other</article></aside><aside>y</aside>", "story"),
        ("<header><article>Top story</article></header><main>story</main>", "story"),
        ("<nav>menu<main>story</main><nav>more</nav>", "story"),  # the first nav is left open
        ("<aside>side<article>story</article><nav>x</nav>", "story"),
        ('<form id="aspnetForm"><div>menu</div><article>story</article></form>', "story"),
        ('<form><input name=q>search</form><article>story<form>reply</form></article>', "story"),
        ('<body aria-hidden="true"><article>story</article></body>', "story"),
        ("<html hidden><body hidden><main>story</main>", "story"),
        ('<body><div aria-hidden="true"><article>no</article></div><article>story</article></body>', "story"),
    ],
)
def test_what_is_around_an_article(page, want):
    assert _main(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ('<section id="share">All there is</section>', "All there is"),
        ('<div class="legal"><p>All</p><p>there is</p></div>', "All there is"),
        ('<div class="social">All</div><section class="menu">there is</section>', "All there is"),
        ("<form><div>All there is</div></form>", "All there is"),
        ("<aside><article>All there is</article></aside>", "All there is"),
        ('<div class="legal">no</div><p>Something else</p>', "Something else"),
        ("<nav>no</nav><footer>no</footer>", ""),
        ("<script>no</script>", ""),
    ],
)
def test_a_name_does_not_take_all_text(page, want):
    assert _text(page) == want


@pytest.mark.parametrize("part,end", [("<article><p>a ", ""), ("<div><p>", "</span>"), ("<nav><aside>x", "<article>y"), ("<section class=menu><b>z", "</section"), ("<form><table><td>", "</form>")])
def test_deep_pages_take_time_by_their_length(part, end):
    began = time.perf_counter()
    op09_html.blocks((part + end) * 50_000)
    assert time.perf_counter() - began < 6


def _site(spark, pages):
    """A site of divs alone: a menu, an article in one div, a notice that differs by a word, a footer; and quoted passages."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    say = lambda n: " ".join(rng.choice(words, n))
    menu, footer, notice = say(30), say(25), say(14)
    quotes = [say(40) for _ in range(5)]
    rows, want = [], {}
    for k in range(pages):
        story = [say(int(rng.integers(30, 120))) for _ in range(int(rng.integers(2, 6)))] + ([quotes[k % 5]] if k % 3 == 0 else [])
        want[k] = " ".join(story)
        body = "".join(f"<p>{p}</p>" for p in story)
        rows.append((k, f"http://s.example/{k}", f"<html><body><div><a>{menu}</a></div><div class='w'>{body}</div><div>{notice} n{k}</div><div>{footer}</div></body></html>"))
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), want


def test_a_site_without_articles_is_decided_by_its_array(spark):
    pages, want = _site(spark, 120)
    results = []
    for tokens in (10**6, 6000, 900):
        got = op09_html.extract(pages, op09_html.Boilerplate(shard_tokens=tokens)).collect()
        results.append(sorted(map(tuple, got)))
        found = {r.page_id: r.text.split() for r in got}
        hits = sum(sum(1 for w in found[k] if w in set(t.split())) for k, t in want.items())
        assert hits / sum(map(len, found.values())) > 0.98 and hits / sum(len(t.split()) for t in want.values()) > 0.98
    assert results[0] == results[1] == results[2]  # in every column, whatever the shards
    assert {k for k, _ in op09_html.blocks(pages.first().html)} == {NEUTRAL}
