"""Nearest neighbours: how leaves are walked and dealt out, and what a task holds."""

import numpy as np
import pytest

from evalgrain.llm import kmeans_tree
from evalgrain.llm.common import prepare

KINDS = ("double", "float")


def frame(spark, x, kind="double"):
    prepare(spark)
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id bigint, embedding array<{kind}>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("leaves", [1, 2, 40, 200])
@pytest.mark.parametrize("equal", [False, True])
def test_the_visited_leaves_are_the_first_of_the_queue(leaves, equal):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 8))
    tree = kmeans_tree.Tree(kmeans_tree.unit(x), leaves)
    queries = kmeans_tree.unit(draw.normal(size=(50, 8)))
    if equal:  # small whole numbers: many nodes are equally near, and products have no rounding
        tree.centres, queries = np.rint(3 * tree.centres), np.rint(3 * queries)
    for visits in (1, 2, 7, leaves // 2, leaves - 1, leaves):
        found = tree.visited(queries, max(1, visits))
        for q, own in zip(queries, found):
            assert {tree.leaves[i] for i in np.flatnonzero(own)} == set(tree.visit(q, max(1, visits)))


def test_parts_hold_a_bounded_number_of_vectors():
    counts = np.array([3, 4, 0, 25, 1, 9, 10, 2, 0])
    first, number, place = kmeans_tree.dealt(counts, 10)
    assert list(number) == [1, 1, 1, 3, 1, 1, 1, 1, 1]
    held = {}
    for leaf, count in enumerate(counts):
        for part in range(first[leaf], first[leaf] + number[leaf]):
            held.setdefault(part, []).append((place[leaf], count / number[leaf]))
    assert sorted(held) == list(range(len(held)))
    for leaves in held.values():
        assert [p for p, _ in leaves] == list(range(len(leaves))) and sum(n for _, n in leaves) <= 10


def test_rows_of_a_shuffle_are_short():
    for length, kind, most in ((64, "<f4", kmeans_tree.ROW), (64, "<f8", kmeans_tree.ROW), (5000, "<f8", 40_000)):
        x = np.zeros((300, length), kind)
        rows = kmeans_tree.packed(3, 1, np.arange(300), x, np.zeros((300, 2), np.uint8))
        assert max(map(len, rows["vectors"])) <= most and b"".join(rows["ids"]) == np.arange(300).tobytes()
        assert b"".join(rows["vectors"]) == x.tobytes()
        assert [len(b) // 2 for b in rows["leaves"]] == [len(b) // 8 for b in rows["ids"]]


@pytest.mark.parametrize("kind", KINDS)
def test_results_do_not_depend_on_the_parts(spark, monkeypatch, kind):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 6)).astype("<f4")
    x[200:260] = x[0] + draw.normal(size=(60, 6)) * 1e-3  # one full leaf
    x[300:310] = x[0]
    whole = rows_of(kmeans_tree.nearest(frame(spark, x, kind), every=10, recall=1.0))
    unit = kmeans_tree.unit(x.astype(float))
    for query, rank, other, score in whole:
        assert abs(unit[query] @ unit[other] - score) < 1e-12
    near = unit[::10] @ unit.T
    near[np.arange(150), np.arange(0, 1500, 10)] = -2
    want = -np.sort(-near, axis=1)[:, :5]
    assert np.mean(np.abs(want.ravel() - np.array([r[3] for r in whole])) < 1e-12) > 0.97
    for name, value in (("PART", 900), ("PASSING", 3), ("WALKED", 7)):
        monkeypatch.setattr(kmeans_tree, name, value)
    assert rows_of(kmeans_tree.nearest(frame(spark, x, kind), every=10, recall=1.0)) == whole


def test_a_task_does_not_hold_a_vector_for_each_visit(spark, monkeypatch, tmp_path):
    """1000 queries visit most of 200 leaves: as numbers in lists, a vector for each visit takes over 200 MB."""
    monkeypatch.setattr(kmeans_tree, "LEAF", 20)
    plain, folder = kmeans_tree.map_batches, str(tmp_path)

    def measured(df, function, schema):
        def run(batches):
            import tracemalloc
            import uuid

            tracemalloc.start()
            try:
                yield from function(batches)
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                    file.write(str(tracemalloc.get_traced_memory()[1]))
            finally:
                tracemalloc.stop()

        return plain(df, run, schema)

    monkeypatch.setattr(kmeans_tree, "map_batches", measured)
    x = np.random.default_rng(3).normal(size=(4000, 64))
    assert kmeans_tree.nearest(frame(spark, x), every=4).count() == 5000
    peaks = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(peaks) > 3 and max(peaks) < 64 << 20
