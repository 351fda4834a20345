"""The operators against brute force, on literal rows and on the small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrain.llm import best_fit, html_region, kmeans_tree, license_index, ppm_language, simhash_pivot
from evalgrain.llm import spaced_seed, suffix_levels, token_transducer, url_model
from evalgrain.llm.common import components, prepare, table
from evalgrain.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, row string, label int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    prepare(spark)
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up five dozen jugs "
    rows = [
        (1, prose * 3, "en", "a"), (1, prose * 3, "en", "a"), (2, (prose * 3).upper(), "en", None), (3, "", "en", "a"),
        (4, None, "en", "a"), (5, " \t\n ", None, "a"), (6, "12 34 !?", "en", "a"), (None, prose + "one more", "en", "a"),
        (None, None, None, None), (7, "x" * 250_000, "en", "b"), (8, (prose + "\n") * 2000, "en", "b"),
        (9, "Released under the MIT License. mit license", "en", "b"), (10, "größe straße über für", "de", "b"),
        (11, "naïve café 漢字 😀 \u00a0 <s> <|endoftext|>", "fr", "b"), (12, "a", "en", "b"),
        (13, "a  b\r\n\tc  ", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "u", "r", 1) for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, SMALL, "documents").collect()]


# 1 SimHash

def brute_fingerprint(text):
    words = [w for w in text.encode().translate(simhash_pivot.LOWER).split()]
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest position reachable over pairs within two bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups_match_brute_force(spark):
    docs = sorted(small(spark))
    prints = [brute_fingerprint(t) for _, t in docs]
    want = {d: (f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, brute_groups(prints))}
    assert {r[0]: (r[1], r[2]) for r in QUERIES["op1_simhash_groups"](spark, SMALL).collect()} == want


@pytest.mark.parametrize("crowd", [simhash_pivot.CROWD, 3])
def test_links_reach_what_pairs_reach(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash_pivot, "CROWD", crowd)
    draw = random.Random(4)
    prints = set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(25):
            prints.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(5))}))
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash_pivot.signed(p),) for p in prints], "fp bigint")
    root = {r.node: r.root for r in components(simhash_pivot.links(frame)).collect()}
    found = defaultdict(set)
    for p in prints:
        found[root.get(simhash_pivot.signed(p), simhash_pivot.signed(p))].add(p)
    want = defaultdict(set)
    for p, g in zip(prints, brute_groups(prints)):
        want[g].add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(odd, none):
    got = simhash_pivot.groups(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.fingerprint == "0" * 16 and r.doc_id is not None]
    assert {r.doc_id for r in empty} == {3, 4, 5} and {r.component_id for r in empty} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}  # only A-Z differ
    assert simhash_pivot.groups(none).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, odd, none):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    base = [[draw.choice(words) for _ in range(300)] for _ in range(12)]
    rows = []
    for b, text in enumerate(base):
        rows.append((b * 100, " ".join(text)))
        for c in range(3):  # five words changed: similarity above 0.8
            other = list(text)
            for k in draw.sample(range(300), 5):
                other[k] = "changed"
            rows.append((b * 100 + c + 1, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_pivot.keep_first(docs).collect()) == [b * 100 for b in range(12)]
    kept = simhash_pivot.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 5").collect()) == [1, 3, 4]
    assert simhash_pivot.keep_first(none).count() == 0


def test_crowds_lose_no_link(spark, monkeypatch):
    """Many variants of a few texts that share most samples: small crowds give the groups of all pairs."""
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    template, texts = [draw.choice(words) for _ in range(400)], []
    for _ in range(12):  # families that are too far from each other, and variants inside one that are near
        family = list(template)
        for k in draw.sample(range(400), 20):
            family[k] = draw.choice(words)
        for _ in range(5):
            text = list(family)
            for k in draw.sample(range(400), 3):
                text[k] = draw.choice(words)
            texts.append(" ".join(text))
    draw.shuffle(texts)
    sets = [set(simhash_pivot.shingle_hashes(x.encode(), simhash_pivot.STAGE_WORDS).tolist()) for x in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a)
            if len(sets[a] & sets[b]) >= simhash_pivot.SIMILARITY * len(sets[a] | sets[b])]
    root = list(range(len(texts)))
    for a, b in near * len(texts):
        root[a] = root[b] = min(root[a], root[b])
    assert 5 < len(set(root)) < 30
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    monkeypatch.setattr(simhash_pivot, "PAIRED", 3)
    got = {r.row: r.root for r in simhash_pivot.near_duplicates(docs).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == root


def test_short_rows_of_a_crowd_that_share_one_sample(spark, monkeypatch):
    """Small crowds give the groups of all rows paired up, also for short texts that agree in one sample only."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    texts = []
    for _ in range(15):  # eight words, and the same with one more: four of five shingles, not near each other
        base = [draw.choice(words) for _ in range(8)]
        texts += [" ".join([*base, draw.choice(words)]) for _ in range(20)] + [" ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    groups = []
    for paired in (10_000, 3):
        monkeypatch.setattr(simhash_pivot, "PAIRED", paired)
        groups.append(sorted((r.row, r.root) for r in simhash_pivot.near_duplicates(docs).collect()))
    assert len(groups[0]) > 200
    assert groups[0] == groups[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 4), (20, 21), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
           if r.node != r.root}
    assert got == {2: 1, 3: 1, 4: 1, 9: 7, 8: 7, 21: 20}


# 2 language

def test_language_accuracy_and_code_lengths(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = ppm_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[0] > 0.99 and right[1] > 200
    texts = [("en", "the cat sat on the mat"), ("en", "that is the thing"), ("de", "das ist der hut und die maus")]
    labelled = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    trees = ppm_language.train(labelled)
    for probe in (b"the mouse", b"das", b"\xff\x00z", "große".encode() * 300):
        want = [brute_code_length([t.encode() for lang, t in texts if lang == own], probe) for own in ("de", "en")]
        assert np.allclose(ppm_language.code_lengths(trees, [probe])[0], want, rtol=1e-5)


def brute_code_length(texts, probe):
    counts = defaultdict(Counter)
    for text in texts:
        text = ppm_language.START + text
        for i in range(3, len(text)):
            for order in range(4):
                counts[text[i - order:i]][text[i]] += 1
    total, probe = 0.0, ppm_language.START + probe
    for i in range(3, len(probe)):
        for order in (3, 2, 1, 0, -1):
            seen = counts.get(probe[i - order:i]) if order >= 0 else None
            if order < 0:
                total += 8
            elif seen:
                n, d = sum(seen.values()), len(seen)
                if probe[i] in seen:
                    total += np.log2((n + d) / seen[probe[i]])
                    break
                total += np.log2((n + d) / d)
    return total


def test_language_odd_rows(odd, none, spark):
    got = ppm_language.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id == 1} == {zlib.crc32(b"1") % 4 == 2}
    assert ppm_language.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in ppm_language.identify(unlabelled).collect()} == {"und"}
    kept = ppm_language.accept(odd)
    assert kept.columns == odd.columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}


# 3 token counts

def test_token_counts_match_the_library(spark, odd, none, monkeypatch):
    import sentencepiece

    path = best_fit.tokenizer_path(token_transducer.TOKENIZER)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (table(spark, SMALL, "documents"), odd):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = sorted(((d, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for d, t in texts), key=repr)
        assert rows_of(token_transducer.token_counts(docs)) == want
    assert token_transducer.token_counts(none).count() == 0
    counter, draw = token_transducer.Counter(token_transducer.Transducer.load(path)), random.Random(6)
    alphabet = [*" ▁ \n\tabcdeth<s>éü漢字😀0129.,-", "  ", "the", "ing", " of", "\n\n", " \n"]
    for _ in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
        monkeypatch.setattr(token_transducer, "CHUNK", draw.choice([1, 3, 7, 20, 1000]))
        assert counter.text(text) == len(library.encode(text)), repr(text)


# 4 main text

def test_main_text(spark):
    score = html_region.weights()
    page = ("<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><a href='/'>Home</a></nav><div "
            "class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>One  two\n three<p>Four <b>five</b> six seven"
            "<div class=ad>Ad in the text</div><p>Eight&nbsp;nine ten eleven</article><div class=comments>first!</div>"
            "<footer>&copy; me</footer>")
    assert html_region.main_text(page, score) == "A & B\nOne two three\nFour five six seven\nEight nine ten eleven"
    for labelled in html_region.PAGES:
        inner = labelled[labelled.index("[[") + 2:labelled.index("]]")]
        want = [" ".join(x.split()) for x in __import__("re").split(r"<[^>]*>", inner) if x.strip()]
        plain = labelled.replace("[[", "").replace("]]", "")
        assert html_region.main_text(plain, score).replace("\n", " ").split() == " ".join(want).split()
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>word", 3), (4, "u", "<p", 4), (5, "u", "<!-- <p>x", 5),
            (6, "u", "<p>" + "many words " * 100_000, 6)]
    got = {r.page_id: r for r in html_region.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()}
    assert [got[k].text for k in (1, 2, None, 4, 5)] == ["", "", "word", "", ""]
    assert got[6].n_chars == 11 * 100_000 - 1 == len(got[6].text)


def test_names_do_not_decide_what_is_text():
    score = html_region.weights()
    prose = "The old mill by the river was sold to a young couple who want to grind their own flour there."

    def text(page):
        return html_region.main_text(page, score).replace("\n", " ")

    for name in ("site has-sidebar", "sticky-header", "page-with-menu", "no-widget layout"):
        page = f'<html><body><div class="{name}"><h1>Mill</h1><p>{prose} One</p><p>{prose} Two</p></div></body></html>'
        assert text(page) == f"Mill {prose} One {prose} Two"
    page = (f'<article><div class="article-header"><h1>Mill</h1><p>{prose}</p></div><div class="elementor-widget-text-editor"><p>{prose}'
            f'</p></div><div class="ad">Buy</div><div role="navigation">Next</div><div class="footer-style"><p>Note</p></div>'
            f'<p>{prose}</p></article><div class="comments">first</div>')
    assert text(page) == f"Mill {prose} {prose} Note {prose}"
    # boxes beside the text: the scan leaves them by what their names weigh
    for name in ("sidebar", "related posts", "cookie-notice", "copyright"):
        box = f'<div class="{name}"><p>{prose}</p></div>'
        assert text(f"<body>{box}<div><p>{prose} One</p><p>{prose} Two</p></div>{box}</body>") == f"{prose} One {prose} Two"


def test_articles_of_all_pages(spark):
    import html
    import re

    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r.text for r in QUERIES["op4_main_text"](spark, "/root/testdata/sf0.01").collect()}
    for page in pages:
        article = page.html[page.html.index("<article"):].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", article)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", p)).split()) for p in parts)
        assert got[page.page_id] == "\n".join(t for t in texts if t)


# 5 decontamination

def test_benchmark_items_are_found_with_substitutions(spark, odd, none):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(15, 60)))) for i in range(30)]
    items += [(90, "tiny pair"), (91, ""), (92, None), (93, "!?")]
    docs, want = [], set()
    for d in range(120):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(0, 200))]
        if d % 3 == 0:
            item, text = draw.choice(items[:30])
            words = text.split()
            for k in draw.sample(range(len(words)), int(len(words) * draw.choice([0, 0.1, 0.15]))):
                words[k] = "zz"
            at = draw.randint(0, len(body))
            body[at:at] = words
        docs.append((d, " ".join(body).title()))
    docs.append((500, "x Tiny, pair. y"))
    for d, text in docs:
        words = spaced_seed.WORD.findall(text.lower())
        for item, body in items:
            target = spaced_seed.WORD.findall((body or "").lower())
            for start in range(-len(target), len(words)) if target else ():
                if sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(target)) >= 0.8 * len(target):
                    want.add((d, item))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in spaced_seed.contamination(frame, bench).collect()} == want and len(want) > 30
    assert spaced_seed.contamination(frame, bench.where("false")).count() == 0
    assert spaced_seed.contamination(none, bench).count() == 0
    own = spark.createDataFrame([(1, "brown fox jumps over the lazy dog while seven wizards")], "item_id bigint, text string")
    kept = spaced_seed.decontaminate(odd, own)
    assert kept.columns == odd.columns
    assert not {1, 2, 8} & {r.doc_id for r in kept.collect()} and kept.where("doc_id IS NULL").count() == 1


def test_all_benchmark_passages(spark):
    items = {r.item_id: spaced_seed.WORD.findall(r.text.lower()) for r in table(spark, SMALL, "benchmark").collect()}
    want = set()
    for d, text in small(spark):
        words = " " + " ".join(spaced_seed.WORD.findall(text.lower())) + " "
        want |= {(d, i) for i, item in items.items() if f" {' '.join(item)} " in words}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_contamination"](spark, SMALL).collect()}
    assert want <= got


# 6 nearest neighbours

def test_recall_against_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in sorted(QUERIES["op6_nearest"](spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        own = x[ids == q][0]
        score = (x @ own) / np.linalg.norm(x, axis=1) / np.linalg.norm(own)
        score[ids == q] = -9
        want = ids[np.lexsort((ids, -score))[:5]]
        hits += len(set(want) & {v for _, v, _ in got[q]})
        total += 5
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[ids == v][0]) < 1e-12 for _, v, s in got[q])
    assert hits >= 0.9 * total


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [2.0, 0.0]), (7, [1.0, 0.0]), (5, [1.0, 0.0]), (50, [0.0, 1.0]),
            (1, None), (2, [0.0, 0.0]), (4, [nan, 1.0]), (6, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]),
            (100, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = kmeans_tree.nearest(frame).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [3, 5, 7, 50]
    assert [r.vec_id for r in got if r.query_id == 50] == [0, 3, 5, 7]
    assert kmeans_tree.nearest(frame.where("false")).count() == 0


def test_a_task_hands_on_the_best_of_each_query(spark, monkeypatch):
    draw = np.random.default_rng(5)
    found = [(draw.integers(0, 9, 50), draw.integers(0, 30, 50), draw.integers(0, 4, 50) / 4) for _ in range(3)]
    rows = sorted(zip(*(np.concatenate(p).tolist() for p in zip(*found))), key=lambda r: (r[0], -r[2], r[1]))
    want = [r for i, r in enumerate(rows) if sum(x[0] == r[0] for x in rows[:i]) < 4]
    assert list(zip(*(p.tolist() for p in kmeans_tree.best_rows(found, 4)))) == want
    frame = table(spark, SMALL, "embeddings")
    whole = sorted(kmeans_tree.nearest(frame).collect())
    monkeypatch.setattr(kmeans_tree, "HELD", 20)  # cuts and hands on after nearly every block
    assert sorted(kmeans_tree.nearest(frame).collect()) == whole


def test_parallel_vectors_keep_the_smallest_ids(spark):
    """Multiples of one vector have equal cosines, in whatever order and number they stand in a block."""
    draw = np.random.default_rng(9)
    one = draw.integers(-8, 9, 16).astype(float)
    for keep in (1, 6, 50):
        x = np.concatenate([np.outer(2.0 ** draw.permutation(40), one), draw.normal(size=(20, 16))])
        q, seen = np.concatenate([one[None], draw.normal(size=(5, 16))]), []
        for who, some, score in kmeans_tree.scored(q, x, keep):
            seen += zip(who.tolist(), some.tolist(), score.tolist())
        cosine = (x[None] * q[:, None]).sum(axis=2) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1)))
        for a in range(len(q)):
            want = sorted(range(len(x)), key=lambda b: (-cosine[a, b], b))[:keep]
            assert sorted((b for w, b, _ in seen if w == a), key=lambda b: (-cosine[a, b], b))[:keep] == want
    rows = [(100 - k, (one * 2.0 ** k).tolist()) for k in range(60)] + [(0, one.tolist()), (200, (-one).tolist())]
    for order in (rows, rows[::-1]):
        got = kmeans_tree.nearest(spark.createDataFrame(order, "vec_id bigint, embedding array<double>").coalesce(1))
        found = [r.vec_id for r in got.orderBy("query_id", "rank").collect() if r.query_id == 0]
        assert found == [41, 42, 43, 44, 45]


# 7 suffix arrays

def brute_cut(texts):
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                covered[i] += 1
                covered[i + 200] -= 1
        gone = np.cumsum(covered)[:len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("few", [2, suffix_levels.SMALL])
def test_repeats_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(suffix_levels, "SMALL", few)
    draw = random.Random(3)
    base = ["".join(draw.choice("abcd ") for _ in range(1200)) for _ in range(3)]
    texts = []
    for _ in range(40):
        part = list(draw.choice(base)[draw.randint(0, 700):][:draw.randint(150, 600)])
        for _ in range(draw.randint(0, 3)):
            part[draw.randrange(len(part))] = draw.choice("xyz")
        texts.append("".join(draw.choice("efg") for _ in range(draw.randint(0, 90))) + "".join(part))
    texts += ["ab" * 300, "a" * 199, "a" * 200, "a" * 201, "", None, texts[0], "é" * 150, "日本" * 200]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, uid string, run int")
    got = {r[0]: tuple(r[1:]) for r in suffix_levels.report(frame).collect()}
    assert [got[k] for k in range(len(texts))] == brute_cut([(t or "").encode() for t in texts])


def test_repeats_of_the_small_table_and_odd_rows(spark, odd, none):
    docs = small(spark)
    want = dict(zip([d for d, _ in docs], brute_cut([t.encode() for _, t in docs])))
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op7_suffix_dedup"](spark, SMALL).collect()} == want
    assert suffix_levels.report(odd).count() == odd.count() and suffix_levels.report(none).count() == 0
    kept = suffix_levels.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[1].text == "" and texts[1].n_chars == 0 and texts[4].text is None and texts[7].text == ""
    assert texts[9].text.startswith("Released")


# 8 URLs

def test_url_rules_and_model(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://x.net/", "http://x.net", "ftp://example.com/de/", "http://b.org/fr/#a",
            "https://notexample.com/de/x", None, "example.net/en/", "http://www.casino-win.example.com/en/1",
            "http://therin.example.com/en/1", "http://a://b/", "://h/p", "http://h?q/fr/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: r for r in url_model.filter_urls(pages).collect()}
    assert [(got[k].host, got[k].path) for k in (0, 2, 7, 10, 11, 12)] == [
        ("a.example.net", "/en/1"), ("x.net", ""), ("", ""), ("a:", "//b/"), ("h", "/p"), ("h", "")]
    assert [got[k].rule for k in range(8)] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None]
    assert [got[k].verdict for k in (0, 1, 3, 4, 6, 7, 8, 9)] == [
        "allow", "block", "block", "allow", "allow", "allow", "block", "allow"]
    assert url_model.filter_urls(pages.where("false")).count() == 0
    plan = url_model.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_url_model_on_pages(spark):
    got = QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.01").where("rule IS NULL")
    right = got.agg(F.avg((F.col("host").contains("-") == (F.col("verdict") == "block")).cast("double"))).first()[0]
    assert right > 0.9


# 9 licences

def test_license_base_columns(spark, odd, none):
    import re

    def want(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().translate(license_index.UPPER))
        places = sorted((k, label) for phrase, label in license_index.BASE.items() for k in range(len(words))
                        if words[k:k + len(phrase.split())] == [w.encode() for w in phrase.split()])
        starts = [k for k, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({label for _, label in places})))

    for docs in (table(spark, SMALL, "documents"), odd):
        got = sorted((tuple(r)[:6] for r in license_index.license_scan(docs).collect()), key=repr)
        assert got == sorted(((r.doc_id, *want(r.text or "")) for r in docs.collect()), key=repr)
    assert license_index.license_scan(none).count() == 0


def test_license_templates(spark):
    texts = ["x y Licensed under CC BY-NC 4.0. z", "Permission is hereby granted, free of charge, to any person who got a "
             "copy of this software and documentation files", "we licensed nothing under the bridge", "All rights reserved",
             "GNU Lesser General Public License", "mit license and Apache License"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_index.license_scan(frame).collect()}
    assert [got[k].labels for k in range(6)] == ["cc-by-nc", "mit", "", "proprietary", "gpl,lgpl", "apache,mit"]
    assert got[5].n_base == 2 and got[5].first_word == 0 and got[5].last_word == 3 and got[2].score == 0.0


# 10 packing

def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit.tokenizer_path(best_fit.TOKENIZER))
    tokenizer.encode_special_tokens = True
    for docs in (table(spark, SMALL, "documents"), odd):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = []
        for d, text in texts:
            ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = best_fit.pack(docs).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(held) <= 1 + 1.02 * -(-sum(w[3] for w in want) // 2048)
    assert best_fit.pack(none).count() == 0


def test_encoder_on_odd_white_space():
    from tokenizers import Tokenizer

    path = best_fit.tokenizer_path(best_fit.TOKENIZER)
    tokenizer, encode = Tokenizer.from_file(path), best_fit.Encoder(path)
    tokenizer.encode_special_tokens = True
    draw = random.Random(1)
    alphabet = [*"abcé漢😀 \n\t\r\u00a0\u3000\x1f'.,0", "  ", "'s", "'ll", " the", "\n\n", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == ids, repr(text)


def test_added_tokens_in_texts(spark, monkeypatch):
    """The query and the pipeline give the ids of the tokenizers library as it is."""
    import corpus_pipeline
    from evalgrain.llm import queries
    from tokenizers import Tokenizer

    path = best_fit.tokenizer_path(best_fit.TOKENIZER)
    tokenizer, encode, draw = Tokenizer.from_file(path), best_fit.Encoder(path, added=True), random.Random(3)
    assert np.frombuffer(encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    alphabet = [*"aé漢 \n<|>", "  ", " the", "<|endoftext|>", "<|endoftext", "endoftext|>"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    texts.append("<|endoftext|>" * 3000)
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    for got in (queries.op10_packing(spark, SMALL), dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, SMALL)):
        held = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got.collect()}
        for d, ids in enumerate(want):
            ids = [*ids, 0]
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                assert held.pop((d, k)) == (b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        assert not held


def test_plan_is_best_fit_decreasing():
    draw = random.Random(5)
    for _ in range(20):
        lengths = Counter(draw.randint(1, 100) for _ in range(draw.randint(1, 400)))
        gaps = []
        for n in sorted(lengths.elements(), reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                gaps.append(100 - n)
            else:
                gaps.remove(fit)
                gaps.append(fit - n)
        runs = best_fit.plan(lengths, 100)
        assert max(first + count for _, _, count, first, _ in runs) == len(gaps)
        assert Counter({n: sum(r[2] for r in runs if r[0] == n) for n in lengths}) == lengths


# the pipeline

def test_pipeline_rows(spark, odd):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == ids and 0 < len(ids) < docs.count()
    leaked = {r.doc_id for r in spaced_seed.contamination(kept, table(spark, SMALL, "benchmark")).collect()}
    assert not leaked
    stage = dict(corpus_pipeline.STAGES)["best-fit packing"]
    assert stage(spark, odd, SMALL).count() >= odd.count()
