"""Codes and clusters of vectors against plain computations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrain.llm import cover_tree, kmeans_tree, va_file
from evalgrain.llm.common import prepare
from evalgrain.llm.oracles import centroids_sql, vector_codes_sql
from tests.oracle import connect

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, v string, cluster string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, wrong lengths, non-finite and huge components, copies, repeated rows and clashing columns."""
    prepare(spark)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64)).round(3)
    rows = [(i, [float(x) for x in v], i % 3 if i % 5 else None) for i, v in enumerate(base)]
    rows += [(100 + i, rows[7][1], 1) for i in range(70)] + [rows[7], rows[7]]
    rows += [(None, rows[3][1], 2), (None, rows[4][1], None)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 63, 1), (203, [None] * 64, 1),
             (204, [float("nan")] * 64, 1), (205, [float("inf")] + [0.0] * 63, 1), (206, [3e38] * 64, 1)]
    return spark.createDataFrame([(*r, "v", "c", 1) for r in rows], VECTORS)


def kept(df, scale):
    out = []
    for r in df.collect():
        x = r.embedding
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) and abs(c) < va_file.LIMIT / scale for c in x):
            out.append((r.vec_id, r.label, [int(np.floor(scale * c)) for c in x]))
    return out


def lloyd(x, book, rounds):
    """Plain integer Lloyd: (final book, codes, distances)."""
    for _ in range(rounds):
        near = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        book = np.array([x[near == i].sum(axis=0) // (near == i).sum() if (near == i).any() else b
                         for i, b in enumerate(book)])
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    return book, d.argmin(axis=1), d.min(axis=1)


def digest(x):
    return hashlib.sha256(",".join(map(str, np.ravel(x).tolist())).encode()).hexdigest()


@pytest.mark.parametrize("block, leaf", [(2048, 24), (50, 1)])
def test_codes_match_plain_rounds(odd, monkeypatch, block, leaf):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    rows = kept(odd, 4096)
    x = np.array([v for _, _, v in rows])
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:16]
    parts = [lloyd(p, p[first], 6) for p in np.split(x, 8, axis=1)]
    error = sum(p[2] for p in parts)
    by_label = {}
    for (_, label, _), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    sha = digest([p[0] for p in parts])
    want = [(i, "".join(f"{p[1][n]:02x}" for p in parts), int(error[n]), by_label[label], sha)
            for n, (i, label, _) in enumerate(rows)]
    assert rows_of(cover_tree.codes(odd)) == sorted(want, key=repr)


def test_clusters_match_plain_rounds(odd):
    rows = kept(odd, 256)
    x = np.array([v for _, _, v in rows])
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", v) for i, _, v in rows)[:40]
    book, near, far = lloyd(x, np.array([v for _, v in first]), 5)
    want = [(i, int(c), int(d), int(far[near == c].sum()), int(far.sum()), digest(book[c]))
            for (i, _, _), c, d in zip(rows, near, far)]
    assert rows_of(va_file.clusters(odd)) == sorted(want, key=repr)


def test_few_and_no_vectors(odd):
    few = odd.where("vec_id < 3")
    assert [r[1:3] for r in rows_of(va_file.clusters(few))] and va_file.clusters(few).where("distance <> 0").isEmpty()
    assert cover_tree.codes(few).where("error <> 0").isEmpty() and cover_tree.codes(few).count() == 3
    for rows in (odd.where("false"), odd.where("vec_id IN (200, 201, 203, 204, 205, 206)")):
        assert cover_tree.codes(rows).collect() == [] == va_file.clusters(rows).collect()
    assert cover_tree.codes(odd.where("false")).columns == cover_tree.codes(few).columns
    assert va_file.clusters(odd.where("false")).columns == va_file.clusters(few).columns


def test_a_tree_covers_its_points_and_separates_its_children():
    x = np.random.default_rng(1).integers(-500, 500, (700, 3))
    x[100:300] = x[5]
    tree = cover_tree.CoverTree.build(x)
    assert sorted(tree.order.tolist()) == list(range(700)) and (tree.points == x[tree.order]).all()
    for n in range(len(tree.start)):
        own = tree.points[tree.start[n]:tree.end[n]]
        assert (((own - tree.centre[n]) ** 2).sum(axis=1) <= tree.radius[n] ** 2 * (1 + 1e-9)).all()
        below = np.arange(tree.first[n], tree.first[n] + tree.children[n])
        if len(below):
            assert (tree.centre[below[0]] == tree.centre[n]).all()
            assert tree.start[below[0]] == tree.start[n] and tree.end[below[-1]] == tree.end[n]
            apart = cover_tree.squared(tree.centre[below], tree.centre[below]) + np.eye(len(below), dtype=int) * 10**9
            assert (4 * apart > (tree.radius[n] * (1 - 1e-9)) ** 2 - 4).all()


def test_most_subtrees_of_clear_groups_are_assigned_whole():
    rng = np.random.default_rng(2)
    centres = rng.integers(-10**6, 10**6, (16, 8))
    x = (centres[rng.integers(0, 16, 2000)] + rng.integers(-500, 500, (2000, 8)))
    tree = cover_tree.CoverTree.build(x)
    codes, sums, counts, compared = tree.assign(centres)
    assert (codes == cover_tree.squared(tree.points, centres).argmin(axis=1)).all()
    assert counts.sum() == 2000 and (sums.sum(axis=0) == x.sum(axis=0)).all() and compared < 200


def test_cells_bound_all_distances():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (500, 5))
    x[:, 2] = 7
    marks = np.array([[p.min(), *np.quantile(p, np.arange(1, 16) / 16, method="lower").astype(int), p.max() + 1] for p in x.T])
    cells = va_file.cells_of(x, marks)
    assert (va_file.unpacked(va_file.packed(cells), 500, 5) == cells).all()
    lookup = va_file.Lookup(rng.integers(-900, 900, (9, 5)), marks)
    exact = cover_tree.squared(x, lookup.centroids)
    low = sum(lookup.lower[j, cells[:, j]] for j in range(5))
    high = sum(lookup.upper[j, cells[:, j]] for j in range(5))
    assert (low <= exact).all() and (exact <= high).all()
    near, fetched = lookup.assign(cells, x)
    assert (near == exact.argmin(axis=1)).all() and fetched < 500


@pytest.mark.parametrize("function, sql", [(cover_tree.codes, vector_codes_sql), (va_file.clusters, centroids_sql)])
def test_sql_agrees(spark, function, sql):
    ours = function(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    theirs = connect(SMALL).execute(sql()).fetchall()
    assert rows_of(ours) == sorted(theirs, key=repr)


@pytest.mark.parametrize("size", [1e-200, 1e200, 1.0])
def test_cosines_of_very_large_and_small_components(size):
    x = np.random.default_rng(6).normal(size=(20, 8))
    plain = [s for _, _, s in kmeans_tree.scored(x[:4], x, 20)]
    found = np.concatenate([s for _, _, s in kmeans_tree.scored(x[:4] * size, x * size, 20)])
    assert np.isfinite(found).all() and np.allclose(found, np.concatenate(plain), rtol=0, atol=1e-12)
