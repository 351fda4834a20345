"""Product codes of vectors: Lloyd's rounds over partition-local cover trees.

Method: vectors are cut into parts, and every block of vectors gets a cover tree for each part position: a node's points
lie within its radius of its centre, the centres of its children are points more than half that radius apart, the first
of them the node's own, and each child's points lie within that half. A tree's points stand in tree order, so a node is
a range of them and its sum a difference of cumulative sums. With d1 and d2 the distances of a node's centre to its
nearest and second entry, d1 + radius < d2 - radius gives the whole subtree to the nearest entry (triangle inequality);
only ambiguous nodes descend, and points of ambiguous leaves are compared exactly. Trees are built once and written;
rounds hand on one sum per task, part and entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import map_batches, materialize
from evalgrain.llm.va_file import integer_vectors

BLOCK = 2048  # vectors of a block
LEAF = 24  # points up to which a node has no children


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a and of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class CoverTree:
    """Arrays: points in tree order with their order, and start, end, first child, children, centre, radius of nodes."""

    def __init__(self, order, points, nodes, radius):
        self.order, self.points, self.radius = order, points.astype(np.int64), radius
        self.start, self.end, self.first, self.children = nodes[:, :4].T.astype(np.int64)
        self.centre = nodes[:, 4:].astype(np.int64)
        self.sums = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=self.sums[1:])

    @classmethod
    def build(cls, x: np.ndarray) -> CoverTree:
        x = x.astype(np.int64)
        order = np.arange(len(x))
        nodes, radius = [[0, len(x), 0, 0, *x[0]]], [0.0]
        todo = 0
        while todo < len(nodes):
            start, end, _, _, *centre = nodes[todo]
            own = order[start:end]
            far = ((x[own] - centre) ** 2).sum(axis=1)
            # Rounded up, so that rounding never takes a point out of the ball.
            radius[todo] = float(np.sqrt(far.max())) * (1 + 1e-12)
            if far.max() > 0 and end - start > LEAF:
                reach = far.max() // 4  # the square of half the radius
                group, best, heads = np.zeros(len(own), np.int64), far.copy(), [np.array(centre)]
                while best.max() > reach:
                    heads.append(x[own[best.argmax()]])
                    d = ((x[own] - heads[-1]) ** 2).sum(axis=1)
                    nearer = d < best
                    group[nearer], best[nearer] = len(heads) - 1, d[nearer]
                order[start:end] = own[np.argsort(group, kind="stable")]
                sizes = np.bincount(group, minlength=len(heads))
                nodes[todo][2:4] = len(nodes), len(heads)
                edge = start
                for head, size in zip(heads, sizes.tolist()):
                    nodes.append([edge, edge + size, 0, 0, *head])
                    radius.append(0.0)
                    edge += size
            todo += 1
        return cls(order, x[order], np.array(nodes), np.array(radius))

    def nodes(self) -> np.ndarray:
        return np.column_stack([self.start, self.end, self.first, self.children, self.centre])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(codes in tree order, sums and counts per entry, exact comparisons of points); ties go to the lower index."""
        codes = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        active, compared = np.zeros(1, np.int64), 0
        while len(active):
            d = squared(self.centre[active], book)
            near = d.argmin(axis=1)
            root = np.sqrt(d)
            nearest = root[np.arange(len(active)), near]
            root[np.arange(len(active)), near] = np.inf
            second, r = root.min(axis=1), self.radius[active]
            # Strictly nearer by more than the rounding of the roots; copies of one point are settled by the exact minimum.
            sure = (r == 0) | (nearest + r < (second - r) - 1e-9 * (nearest + r + 1))
            whole, entry = active[sure], near[sure]
            np.add.at(sums, entry, self.sums[self.end[whole]] - self.sums[self.start[whole]])
            np.add.at(counts, entry, self.end[whole] - self.start[whole])
            codes[places(self.start[whole], self.end[whole])] = np.repeat(entry, self.end[whole] - self.start[whole])
            rest = active[~sure]
            leaf = rest[self.children[rest] == 0]
            own = places(self.start[leaf], self.end[leaf])
            entry = squared(self.points[own], book).argmin(axis=1)
            codes[own] = entry
            np.add.at(sums, entry, self.points[own])
            counts += np.bincount(entry, minlength=len(book))
            compared += len(own)
            inner = rest[self.children[rest] > 0]
            active = places(self.first[inner], self.first[inner] + self.children[inner])
        return codes, sums, counts, compared


def tree_blocks(kept: DataFrame, parts: int) -> DataFrame:
    """One row per block of BLOCK vectors: ids, labels, and one tree per part position."""
    types = dict(kept.dtypes)

    def block(ids, labels, x):
        trees = [CoverTree.build(p) for p in np.split(x, parts, axis=1)]
        return {"ids": [ids], "labels": [labels],
                "order": [[t.order.astype("<i4").tobytes() for t in trees]],
                "points": [[t.points.astype("<i4").tobytes() for t in trees]],
                "nodes": [[t.nodes().astype("<i4").tobytes() for t in trees]],
                "radius": [[t.radius.astype("<f8").tobytes() for t in trees]]}

    def run(batches):
        ids, labels, held = [], [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            labels += batch.column("label").to_pylist()
            held += batch.column("v").to_pylist()
            while len(held) >= BLOCK:
                yield block(ids[:BLOCK], labels[:BLOCK], np.array(held[:BLOCK], np.int64))
                ids, labels, held = ids[BLOCK:], labels[BLOCK:], held[BLOCK:]
        if held:
            yield block(ids, labels, np.array(held, np.int64))

    return map_batches(kept.select("vec_id", "label", "v"), run,
                       f"ids array<{types['vec_id']}>, labels array<{types['label']}>, order array<binary>, "
                       "points array<binary>, nodes array<binary>, radius array<binary>")


def read_trees(batch, i: int, width: int) -> list[CoverTree]:
    columns = [batch.column(name)[i].as_py() for name in ("order", "points", "nodes", "radius")]
    return [CoverTree(np.frombuffer(o, "<i4"), np.frombuffer(p, "<i4").reshape(-1, width),
                      np.frombuffer(n, "<i4").reshape(-1, 4 + width), np.frombuffer(r, "<f8"))
            for o, p, n, r in zip(*columns)]


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, component) after a round: exact floors of means; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, tree in enumerate(read_trees(batch, i, width)):
                    _, s, n, _ = tree.assign(books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        yield {"part": part, "entry": entry, "n": counts[part, entry], "sums": [s.tolist() for s in sums[part, entry]]}

    found = map_batches(blocks, run, "part int, entry int, n bigint, sums array<bigint>")
    wide = "decimal(38,0)"
    rows = (found.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
            .groupBy("part", "entry", "place")
            .agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("s").cast(wide)).alias("s")).collect())
    out = books.copy()
    for r in rows:
        out[r.part, r.entry, r.place] = int(r.s) // int(r.n)
    return out


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components (or such beyond va_file.LIMIT) are dropped; so are those
    whose length is not the commonest one that `parts` divides (of equally common ones the shortest), as they share no
    codebook. Codebooks start with the smallest ids; null ids come last, equal ids by their vectors. Fewer vectors than
    entries: as many entries. Repeated rows are rows like others. Null labels are one label. A sum beyond 64 bits is null.
    An empty table gives no rows. Other columns are ignored. At most 256 entries, as a code has two hex digits a part.
    """
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    kept = integer_vectors(vectors.select("vec_id", "label", "embedding"), scale).select("vec_id", "label", "v")
    size = (kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("d")).count()
            .orderBy(F.desc("count"), "d").first())
    if size is None:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, code string, error bigint, label_error bigint, "
                                         "codebooks_sha256 string")
    kept = kept.where(F.size("v") == size["d"])
    blocks = materialize(tree_blocks(kept, parts), "cover_trees")
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(blocks, books)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].as_py()
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(read_trees(batch, i, books.shape[2])):
                    near, _, _, _ = tree.assign(books[p])
                    code[tree.order, p] = near
                    error[tree.order] += ((tree.points - books[p][near]) ** 2).sum(axis=1)
                yield {"vec_id": ids, "label": batch.column("labels")[i].as_py(),
                       "code": [c.tobytes().hex() for c in code], "error": error}

    coded = materialize(map_batches(blocks, run, f"vec_id {types['vec_id']}, label {types['label']}, code string, "
                                                 "error bigint"), "codes")
    per = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(
        F.col("label").alias("of"), F.col("s").try_cast("bigint").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(per, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
