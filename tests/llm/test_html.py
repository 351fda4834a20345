"""Main text: the best run against all runs, long broken pages, tables and short blocks."""

import random
import re
import time

import pytest

from evalgrain.llm import html_region
from evalgrain.llm.labelled_pages import RICH

SCORE = html_region.weights()


def test_best_run_against_all_runs():
    rng = random.Random(5)
    kinds = ["text", "p", "/p", "div", "/div", "td", "!text", "-text", "unknown", "body"]
    for _ in range(400):
        tokens = []
        for _ in range(rng.randrange(0, 14)):
            kind = rng.choice(kinds)
            tokens.append((kind, "word " * rng.randrange(1, 9) if kind.endswith("text") else ""))
        value = [SCORE.get(kind, -2.0 if kind[0] in "!-" else -0.5) * (len(text.split()) if text else 1)
                 for kind, text in tokens]
        sums = [sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1)]
        start, end = html_region.region(tokens, SCORE)
        assert sum(value[start:end]) == pytest.approx(max([0.0, *sums]))


@pytest.mark.parametrize("page", [
    "<a x" * 250_000 + "'", '<a x="' * 160_000, "<a x='b" * 140_000 + '"', "<div>" * 90_000 + "</p>" * 130_000,
    "<head><body>" * 80_000, "<a " + "=" * 1_000_000, "<a " + ("=" + " " * 1000) * 1000, "<" * 1_000_000,
    "<!--" * 250_000, "<script>" * 120_000, "<div class='x y'>" * 60_000], ids=range(11))
def test_long_broken_pages(page):
    start = time.time()
    html_region.main_text(page, SCORE)
    assert time.time() - start < 3


def test_quotes_open_values_only():
    page = "<article><p title=it's>The miller's house <b data-x=\"a>b\">stood</b> by the 'old' river</p></article>"
    assert html_region.main_text(page, SCORE) == "The miller's house stood by the 'old' river"
    assert html_region.main_text("<article><p title=\"open>Some words of text here</p></article>", SCORE) \
        == "Some words of text here"


def test_text_goes_on_after_tables_and_short_blocks():
    before = "The council met in the evening and heard the report on the state of the roads."
    after = "Repairs begin in spring, and the bridge is closed to carts until the work is done."
    for inner in ("<table><tr><td>north</td><td>south</td></tr></table>", "<pre>a;b;c</pre>", "<dl><dt>x</dt><dd>y</dd></dl>",
                  "<table>" + "<tr><td>1</td><td>2</td><td>3</td></tr>" * 30 + "</table>", "<hr><p>So.</p><hr>"):
        page = (f"<html><body><nav><a href='/'>home</a></nav><div id=content><p>{before}</p>{inner}<p>{after}</p></div>"
                "<footer>imprint</footer></body></html>")
        want = re.sub(r"<[^>]*>", " ", f"{before} {inner} {after}").split()
        assert html_region.main_text(page, SCORE).split() == want, inner


def test_labelled_pages_with_tables_come_out_whole():
    for page in RICH:
        inner = page[page.index("[[") + 2:page.index("]]")]
        got = html_region.main_text(page.replace("[[", "").replace("]]", ""), SCORE)
        assert "".join(got.split()) == "".join(re.sub(r"<[^>]*>", "", inner).split())
