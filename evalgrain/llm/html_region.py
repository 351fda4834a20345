"""Main text of HTML pages by the maximum-scoring subsequence.

Method: a page is a sequence of words and tags. Words score positive and tags negative, both with weights learned from
labelled pages: a tag or word kind scores the logarithm of how much more often it stands inside the main text than
outside. Words of class, id and role are learned too; text in an element that they speak against scores negative.
One linear scan finds the contiguous run with the highest sum, the content region. What stands in the region but inside an
element of another purpose by name, role or a whole class or id (adverts, forms, comments) is left out; the rest is cut
into blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from evalgrain.llm.common import map_batches, whole_text
from evalgrain.llm.labelled_pages import CLOSE, NAMED, OPEN, PAGES, RICH

# A quote opens a value only after `=`; one that is never closed is an ordinary character. Possessive, so that a tag is
# read once, and no alternative fails after its first characters.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements whose content is never shown as text; they run to their own end tag.
RAW = frozenset("script style noscript template svg math iframe object select textarea title head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
# Elements of another purpose than the article: by name, by role, and by a whole class or id.
ASIDE = frozenset("nav aside footer form button menu dialog".split())
ROLES = frozenset("navigation complementary banner contentinfo search form menu menubar toolbar dialog alertdialog".split())
MARKS = frozenset("ad ads advert adverts advertisement comments".split())
MAIN = frozenset("article main".split())


def hints(attributes: str) -> frozenset[str]:
    """Words of an element's class, id and role."""
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            found.update(w.lower() for w in re.split(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])", "".join(values)) if w)
    return frozenset(found)


def purpose(name: str, attributes: str) -> bool:
    """Whether an element says by itself that it serves something else than the main text."""
    if name in ASIDE or re.search(r"(?i)\bhidden\b(?!\s*=\s*[\"']?false)", attributes):
        return True
    if not attributes or name in ("body", "html", *MAIN):
        return False
    values = [(n.lower(), "".join(v).lower().split()) for n, *v in ATTRIBUTE.findall(attributes)]
    return any(not (ROLES if n == "role" else MARKS).isdisjoint(v) for n, v in values if n in ("class", "id", "role"))


def elements(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[int, frozenset[str], int]]]:
    """(kind, text, element) of a page, and its elements with words of class, id or role: (parent, words, text words).

    A kind is that of a tag, with no text, or of a run of words; `!name` for what has another purpose. The element is the
    innermost one with words of class, id or role, or -1; its text words are all that stand in it, at any depth.

    Unclosed and wrongly nested elements: an end tag closes up to its own start tag if there is one, block elements end
    an open advert or menu only by their own end tags, and an article's start ends all that is open.
    """
    out: list[tuple[str, str, int]] = []
    named: list[tuple[int, frozenset[str]]] = []
    held: list[int] = []
    stack: list[tuple[str, bool, int]] = []  # name, of another purpose, the innermost named element before it
    opened: Counter[str] = Counter()  # names on the stack
    at, skip, inner = 0, 0, -1  # skip: open elements of another purpose
    endless = False  # no further end tag of a head

    def text(upto: int) -> None:
        if upto > at:
            out.append(("!text" if skip else "text", page[at:upto], inner))
            if inner >= 0:
                held[inner] += len(page[at:upto].split())

    position = 0
    while match := TOKEN.search(page, position):
        text(match.start())
        position = at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            aside, own = False, inner
            if opened[name]:
                while True:
                    own = inner
                    closed, aside, inner = stack.pop()
                    opened[closed] -= 1
                    skip -= aside
                    if closed == name:
                        break
            out.append(("!/" + name if skip or aside else "/" + name, "", own))
            continue
        if name in RAW:
            end = None
            if name != "head" or not endless:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, position)
            if name == "head" and not end:
                endless = True
                end = re.compile(r"(?=<body\b)", re.I).search(page, position)
            position = at = end.end() if end else len(page)
            continue
        within = any(opened[n] for n in MAIN)
        if name in MAIN and not within:
            stack, skip, inner = [], 0, -1
            opened.clear()
        header = name == "header" and not within
        aside = header or purpose(name, match[3])
        kind = "!" + name if skip or aside else name
        if name in VOID or match[3].rstrip().endswith("/"):
            out.append((kind, "", inner))
        else:
            stack.append((name, aside, inner))
            opened[name] += 1
            skip += aside
            if name not in ("body", "html", *MAIN) and (words := hints(match[3])):
                named.append((inner, words))
                held.append(0)
                inner = len(named) - 1
            out.append((kind, "", inner))
    text(len(page))
    for k in range(len(named) - 1, -1, -1):  # a parent stands before its children
        if named[k][0] >= 0:
            held[named[k][0]] += held[k]
    return out, [(*element, n) for element, n in zip(named, held)]


def sequence(page: str, score: dict[str, float]) -> list[tuple[str, str]]:
    """(kind, text) of a page; kind `-name` in elements whose class, id or role words weigh against them.

    An element that holds more than half of the page's words is a wrapper, whatever it is called.
    """
    tokens, named = elements(page)
    total = sum(len(text.split()) for _, text, _ in tokens)
    against: list[bool] = []
    for parent, words, n in named:
        own = 2 * n <= total and sum(score.get("." + w, 0.0) for w in words) < 0
        against.append(own or (parent >= 0 and against[parent]))
    return [("-" + kind if k >= 0 and against[k] and kind[0] != "!" else kind, text) for kind, text, k in tokens]


def log_odds(pages: list[list[tuple[str, str, list[str]]]]) -> dict[str, float]:
    """Logarithm of how much more often each kind stands inside the main text, of (tag, words, its kinds)."""
    inside, outside = Counter(), Counter()
    for tokens in pages:
        now = outside
        for name, words, kinds in tokens:
            name = name.lstrip("!-/")
            if name == "content-start":
                now = inside
            elif name == "content-end":
                now = outside
            else:
                now.update(dict.fromkeys(kinds, len(words.split()) if words else 1))
    return {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside | outside}


def weights() -> dict[str, float]:
    """Score of every kind, learned from the labelled pages; a word's kind is that of its run.

    `.word` is that of a class, id or role word: by the text words inside the main text and outside that stand in
    elements with it. These come first, as the kinds of tags and words depend on them.
    """
    def marked(page: str) -> str:
        return page.replace(OPEN, "<content-start/>").replace(CLOSE, "<content-end/>")

    pages = []
    for page in (*PAGES, *RICH, *NAMED):
        tokens, named = elements(marked(page))
        around: list[frozenset[str]] = []
        for parent, words, _ in named:
            around.append(words | (around[parent] if parent >= 0 else frozenset()))
        pages.append([(kind, text, ["." + w for w in around[k]] if text and k >= 0 else []) for kind, text, k in tokens])
    learned = log_odds(pages)
    kinds = log_odds([[(kind, text, [kind]) for kind, text in sequence(marked(page), learned)]
                      for page in (*PAGES, *RICH)])
    for kind, value in kinds.items():
        if kind.endswith("text"):
            learned[kind] = 1.0 if value > 0 else -1.0  # words of one kind weigh alike
        else:
            # Tags cost at least a little; those that stand outside cost several words.
            learned[kind] = min(-0.2, 4.0 * value)
    return learned


def region(tokens: list[tuple[str, str]], score: dict[str, float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum; of equal ones the first.

    Inside an article element, what has another purpose weighs nothing: it is left out of the text, and must not cut off
    what follows it. Nor does what a class speaks against weigh there; its words are text if the run goes on after them.
    """
    best, span, total, start, main = 0.0, (0, 0), 0.0, 0, False
    for k, (kind, text) in enumerate(tokens):
        if kind.lstrip("/") in MAIN:
            main = kind in MAIN
        value = 0.0 if main and kind[0] in "!-" else score.get(kind, -2.0 if kind[0] in "!-" else -0.5)
        if text:
            value *= len(text.split())
        if total <= 0:
            total, start = 0.0, k
        total += value
        if total > best:
            best, span = total, (start, k + 1)
    return span


def main_text(page: str, score: dict[str, float]) -> str:
    """The main text: blocks in page order, joined by line ends, white space inside a block as one space."""
    tokens = sequence(page, score)
    start, end = region(tokens, score)
    blocks, words = [], []

    def close() -> None:
        block = " ".join(html.unescape("".join(words)).split())
        if block:
            blocks.append(block)
        words.clear()

    for kind, text in tokens[start:end]:
        if kind in ("text", "-text"):
            words.append(text)
        elif kind.lstrip("!-/") in BLOCKS:
            close()
        elif kind in ("br", "-br"):
            words.append(" ")
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html).

    Null or empty html, and pages without a word: empty text. Repeated rows: one row each. Pages that break off in a
    tag, comment or script lose only that. Nothing is dropped or capped in the region but what has another purpose.
    """
    score = weights()

    def run(batches):
        for batch in batches:
            texts = [main_text(x, score) for x in batch.column("__html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                   "n_chars": list(map(len, texts))}

    kind = dict(pages.dtypes)["page_id"]
    return map_batches(pages.select("page_id", "url", whole_text("html").alias("__html")), run,
                       f"page_id {kind}, url string, text string, n_chars bigint")
