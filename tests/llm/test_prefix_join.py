"""Similar sets by prefix filtering against all pairs, and the work in crowds of a template."""

import random

import pytest

from evalgrain.llm import common, minhash_bands, prefix_join, simhash_pivot
from evalgrain.llm.common import prepare


def jaccard_fits(x, y, percent):
    return 100 * len(x & y) >= percent * len(x | y)


def noted_tables(monkeypatch):
    """The folders of all scratch tables written from now on."""
    paths, folder = [], common.scratch_folder

    def noted(spark, label):
        paths.append(folder(spark, label))
        return paths[-1]

    monkeypatch.setattr(common, "scratch_folder", noted)
    return paths


def sizes(spark, paths):
    return {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: spark.read.parquet(p).count() for p in paths}


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_no_similar_pair_is_left_out(spark, percent):
    prepare(spark)
    rng = random.Random(percent)
    sets = [set(range(-5, -4))]
    for base in range(0, 4000, 1000):
        for _ in range(25):
            kept = rng.sample(range(base, base + 40), rng.randint(25, 40))
            sets.append({*kept, *(rng.randrange(10**6, 10**6 + 500) for _ in range(rng.randint(0, 12)))})
    sets += [{7}, {7}, {7, 8}, {10**9 + i for i in range(1000)}, {10**9 + i for i in range(800)}, {10**9 + i for i in range(799)}]
    roots = [i // 3 for i in range(len(sets))]
    df = spark.createDataFrame([(i, r, list(s)) for i, (r, s) in enumerate(zip(roots, sets))],
                               "row bigint, root bigint, shingles array<bigint>").repartition(5)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and jaccard_fits(sets[i], sets[j], percent)}
    near = prefix_join.near_sets(df, percent)
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near.collect()}
    assert want and want <= got
    assert all(roots[a] != roots[b] for a, b in got)
    sure = prefix_join.similar(near, df, percent).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in sure} == want
    assert all((r.ra, r.rb) == (roots[r.a], roots[r.b]) for r in sure)


def test_groups_of_a_crowd_are_joined_through_any_pair(spark):
    """Two groups of one crowd that only one pair links, which is neither of a hub nor of the smallest row."""
    prepare(spark)
    ends = {0: list(range(20)), 50: list(range(6, 26))}
    sets = {r: ends[0 if r < 50 else 50] + [1000 * r + i for i in range(10)] for r in range(100)}
    sets[31], sets[77] = list(range(30)), list(range(1, 31))
    df = spark.createDataFrame(list(sets.items()), "row bigint, shingles array<bigint>")
    crowds = spark.createDataFrame([(1, r) for r in range(100)], "key int, row bigint")
    grouped = spark.createDataFrame([(r, r // 50 * 50) for r in range(100)], "row bigint, root bigint")
    joined = {r.row: r.root for r in prefix_join.join_crowds(crowds, grouped, df, 80).collect()}
    assert joined == dict.fromkeys(range(100), 0)


def test_crowd_below_the_threshold_is_not_paired_up(spark, monkeypatch):
    """300 pages of a template that share bands but are all too different: they are not paired up across components."""
    prepare(spark)
    paths = noted_tables(monkeypatch)
    words = [f"t{i}" for i in range(80)]
    docs = [(i, " ".join(words + [f"d{i}x{j}" for j in range(18)])) for i in range(300)]
    got = minhash_bands.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(300)]
    rows = sizes(spark, paths)
    assert rows["loose"] > 300 and rows["across"] <= 300, rows


def test_near_duplicate_stage_does_not_pair_up_such_a_crowd(spark, monkeypatch):
    """Similarity 0.79: collisions in a sketch of 1024 bits would let a fifth of the pairs pass."""
    prepare(spark)
    paths = noted_tables(monkeypatch)
    words = [f"t{i}" for i in range(87)]
    docs = [(i, " ".join(words + [f"d{i}x{j}" for j in range(11)])) for i in range(300)]
    found = simhash_pivot.near_duplicates(spark.createDataFrame(docs, "row bigint, text string")).collect()
    assert not found
    rows = sizes(spark, paths)
    assert rows["loose"] > 300 and rows.get("across", rows.get("crowd_candidates")) <= 300, rows
