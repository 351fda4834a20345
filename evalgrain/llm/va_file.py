"""Clusters of integer vectors around centroids with a VA-file.

Method: every component is compressed to a cell of BITS bits; the marks between the cells of a dimension are quantiles of
all vectors. In each round lookup tables give, for every centroid, dimension and cell, the least and the largest squared
difference, and their sums over a vector's cells bound its distance to each centroid. A vector whose least upper bound
lies below all other lower bounds is assigned by its cells alone; for the others the full vector is fetched and compared
exactly with the centroids whose intervals overlap. Cells and full vectors stand side by side in blocks, so a fetch
stays in its task. Tasks hand on one sum per centroid; centroids are the only thing that is collected.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import map_batches, materialize

BITS = 4
CELLS = 1 << BITS
LIMIT = 1 << 26  # of a component's size as an integer: squared distances then fit 64 bits


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """All columns, and `v`: floor(scale * x) of every component, for vectors whose components are finite and not null.

    A component of LIMIT or more as an integer has squares beyond 64 bits; its vector is left out like one that is not finite.
    """
    x = F.col("embedding").cast("array<double>")
    small = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / scale))
    return vectors.where(F.col("embedding").isNotNull()).where(small).withColumn(
        "v", F.transform(x, lambda c: F.floor(c * scale).try_cast("int")))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest hashes of `salt` and id; null ids come last, equal ids by their vectors."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select(order.alias("o"), "v").orderBy(F.asc_nulls_last("o"), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cell_marks(kept: DataFrame, dims: int) -> np.ndarray | None:
    """(dims, CELLS + 1): marks between the cells of each dimension, from the least to beyond the largest component."""
    shares = [c / CELLS for c in range(CELLS + 1)]
    row = kept.agg(*(F.percentile_approx(F.col("v")[j], shares, 1000).alias(f"q{j}") for j in range(dims)),
                   *(F.min(F.col("v")[j]).alias(f"l{j}") for j in range(dims)),
                   *(F.max(F.col("v")[j]).alias(f"h{j}") for j in range(dims))).first()
    if row["l0"] is None:
        return None
    return np.array([[row[f"l{j}"], *row[f"q{j}"][1:-1], row[f"h{j}"] + 1] for j in range(dims)], dtype=np.int64)


def cells_of(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The cell of every component: marks[cell] <= component < marks[cell + 1]."""
    return np.stack([np.searchsorted(marks[j, 1:-1], x[:, j], side="right") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def packed(cells: np.ndarray) -> bytes:
    """Two cells in a byte; an odd number of dimensions is filled up with a zero."""
    if cells.shape[1] % 2:
        cells = np.pad(cells, ((0, 0), (0, 1)))
    return (cells[:, 0::2] | cells[:, 1::2] << BITS).tobytes()


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    pairs = np.frombuffer(data, np.uint8).reshape(rows, -1)
    return np.stack([pairs & (CELLS - 1), pairs >> BITS], axis=2).reshape(rows, -1)[:, :dims]


class Lookup:
    """Bounds of the squared difference of every centroid, dimension and cell."""

    def __init__(self, centroids: np.ndarray, marks: np.ndarray):
        self.centroids = centroids
        low, high = marks[:, :-1, None], marks[:, 1:, None] - 1
        c = centroids.T[:, None, :]
        self.lower = np.maximum(np.maximum(low - c, c - high), 0) ** 2
        self.upper = np.maximum(np.abs(c - low), np.abs(high - c)) ** 2

    def assign(self, cells: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
        """(nearest centroid of every row, the smaller number at a tie; number of vectors that were fetched)."""
        lower = np.zeros((len(cells), len(self.centroids)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(cells.shape[1]):
            lower += self.lower[j, cells[:, j]]
            upper += self.upper[j, cells[:, j]]
        possible = lower <= upper.min(axis=1, keepdims=True)
        near = possible.argmax(axis=1)
        open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
        if len(open_rows):
            row, c = np.nonzero(possible[open_rows])
            exact = np.full((len(open_rows), len(self.centroids)), np.iinfo(np.int64).max)
            exact[row, c] = ((x[open_rows].astype(np.int64)[row] - self.centroids[c]) ** 2).sum(axis=1)
            near[open_rows] = exact.argmin(axis=1)
        return near, len(open_rows)


def file_blocks(kept: DataFrame, marks: np.ndarray) -> DataFrame:
    """One row per block: (ids, cells, vectors), the VA-file beside the vectors it stands for."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist(), dtype=np.int64)
                yield {"ids": [batch.column("vec_id").to_pylist()], "cells": [packed(cells_of(x, marks))],
                       "vectors": [x.astype("<i4").tobytes()]}

    kind = dict(kept.dtypes)["vec_id"]
    return map_batches(kept.select("vec_id", "v"), run, f"ids array<{kind}>, cells binary, vectors binary")


def read_block(batch, i: int, dims: int) -> tuple[list, np.ndarray, np.ndarray]:
    ids = batch.column("ids")[i].as_py()
    x = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(len(ids), dims)
    return ids, unpacked(batch.column("cells")[i].as_py(), len(ids), dims), x


def moved(blocks: DataFrame, centroids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The exact floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    dims = centroids.shape[1]

    def run(batches):
        lookup = Lookup(centroids, marks)
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, cells, x = read_block(batch, i, dims)
                near, _ = lookup.assign(cells, x)
                np.add.at(sums, near, x)
                n += np.bincount(near, minlength=len(n))
        used = np.flatnonzero(n)
        yield {"cluster": used, "n": n[used], "sums": [s.tolist() for s in sums[used]]}

    parts = map_batches(blocks, run, "cluster int, n bigint, sums array<bigint>")
    wide = "decimal(38,0)"
    rows = (parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place")
            .agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("s").cast(wide)).alias("s")).collect())
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.place] = int(r.s) // int(r.n)
    return out


def whole_number(x: int) -> int | None:
    """x, or null beyond 64 bits."""
    return x if x < 1 << 63 else None


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64,
             salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dims` components.

    Vectors that are null, of another length, or hold null or non-finite components (or such beyond LIMIT) take no part.
    Equal distances go to the smaller centroid. Fewer than k vectors: as many centroids. Repeated rows and null ids are
    rows like others; null ids start no centroid while others are left. A sum beyond 64 bits is null. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    sized = vectors.select("vec_id", "embedding").where(F.size("embedding") == dims)
    kept = integer_vectors(sized, scale).select("vec_id", "v")
    marks = cell_marks(kept, dims)
    if marks is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    blocks = materialize(file_blocks(kept, marks), "va_file")
    centroids = first_centroids(kept, k, salt)
    for _ in range(rounds):
        centroids = moved(blocks, centroids, marks)

    def run(batches):
        lookup = Lookup(centroids, marks)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, cells, x = read_block(batch, i, dims)
                near, _ = lookup.assign(cells, x)
                yield {"vec_id": ids, "cluster": near,
                       "distance": ((x.astype(np.int64) - centroids[near]) ** 2).sum(axis=1)}

    assigned = materialize(map_batches(blocks, run, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = whole_number(sum(int(r.s) for r in per))
    # One row per centroid, k at most.
    report = spark.createDataFrame(
        [(r.cluster, whole_number(int(r.s)), total,
          hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in per],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(report), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
