"""Near-duplicates by MinHash against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrain.llm import minhash_bands
from evalgrain.llm.common import prepare

DOCS = "doc_id bigint, text string, row string, n int, root string"


def plain(docs, width=4):
    """Components by comparing all pairs of sets of strings."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    named = [least.get(find(i)) for i in range(len(docs))]
    return sorted(((d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(docs, sets, named)), key=repr)


def found(spark, docs, partitions=4):
    prepare(spark)
    df = spark.createDataFrame([(d, t, "r", 1, "x") for d, t in docs], DOCS).repartition(partitions)
    out = minhash_bands.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def varied(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("paired", [16, 1])
def test_components_match_all_pairs(spark, monkeypatch, paired):
    """Chains, copies, crowds of a template, short texts; also with every shared band taken as a crowd."""
    monkeypatch.setattr(minhash_bands, "PAIRED", paired)
    rng = random.Random(5)
    docs, bases = [], [" ".join(f"b{i}x{j}" for j in range(n)) for i, n in enumerate((12, 30, 80, 300, 9, 45))]
    for i, base in enumerate(bases):
        chain = base
        for _ in range(12):
            docs += [varied(rng, base, len(base.split()) // 25), base, base.upper()]
            chain = varied(rng, chain, max(1, len(base.split()) // 40))
            docs.append(chain)
    docs += ["one two", "ONE  two\n", "one", "two", "one two three four", "one two three four five"] * 2
    docs = [(i * 7 % 1000, t) for i, t in enumerate(docs)]
    docs += [(None, bases[1]), (None, "only null"), (None, "only null"), (None, None), (2000, None), (2001, ""),
             (2001, ""), (2002, " \t\n\x0b\x0c\r "), (2003, "a b   c"), (5, bases[2]), (2004, "Ä ä É é"),
             (2005, "ä ä É é")]
    assert found(spark, docs) == plain(docs)


def test_long_texts_and_no_rows(spark):
    long = " ".join(f"t{i % 5003}q{i % 11}" for i in range(60_000))
    docs = [(1, long), (2, long + " tail"), (3, "x" * 300_000), (4, "x" * 300_000 + "y")]
    assert found(spark, docs) == plain(docs)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (1, "")]) == [(1, 0, 1, True)] * 2


def test_signatures_count_differing_minima(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (2, 128)).astype(np.uint8)
    y[::3] = x[::3]
    row = spark.createDataFrame([(x.view("<i8").tolist(), y.view("<i8").tolist())], "x array<bigint>, y array<bigint>")
    assert row.select(minhash_bands.different_bytes("x", "y")).first()[0] == int((x != y).sum())


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    a, b = minhash_bands.multipliers()
    agree = []
    for n in (8, 40, 9000):
        for _ in range(40):
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            cut = n // 10
            x, y = minhash_bands.minima(u[cut:], a, b), minhash_bands.minima(u[:n - cut], a, b)
            agree.append((x == y).mean() - (n - 2 * cut) / n)
    assert abs(np.mean(agree)) < 0.02
