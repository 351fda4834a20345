"""Approximate nearest neighbours by cosine over a hierarchical k-means tree.

Method: a tree of k-means centres is fitted on a bounded sample and every vector is put into the leaf that a greedy
descent reaches. A query walks the tree best bin first: a priority queue holds the nodes seen, nearest centre first;
leaves leave the queue in that order, and the visit goes on until as many leaves are read as the calibration asks for.
The calibration widens the visits until sampled queries reach the wanted recall against brute force on the sample.

Equal vectors are indexed once, with the smallest ids that a result of k rows can need, so copies cannot overfill a
leaf. The leaves are counted and dealt into parts of bounded size; a large leaf is many parts. A query goes once to each
part in which it visits a leaf. The task of a part holds the part's vectors, as packed numbers, and the queries pass by,
so the memory of a task depends neither on the number of leaves nor on that of the queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evalgrain.llm.common import map_batches, materialize

SAMPLE = 20_000  # bound of the vectors that the tree and the calibration see
BRANCHES = 16
LEAF = 200  # vectors a leaf should hold; the number of leaves is bounded by the sample
RECALL = 0.97
PART = 1 << 25  # bytes of vectors that a task holds while queries pass by
PARTS, PART_ROWS = 48, 4096  # so many parts at least, unless they would have fewer vectors than this
ROW = 1 << 14  # bytes of vectors in one row of a shuffle, one vector at least
GATHERED = 1 << 22  # bytes of vectors that are put into leaves at once
WALKED = 256  # queries that walk the tree at once
PASSING = 1024  # queries that are compared with a part at once
PRODUCTS = 1 << 20  # components of candidates, or products of vectors, that are made at once
HELD = 200_000  # found rows that a task keeps before it cuts them to the best of each query


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors that can be compared: not null, not zero, all components finite.

    Vectors of another length than most have no cosine with them and take no part; a tie goes to the shorter length.
    """
    inf = F.lit(float("inf"))
    rows = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
            .where("vec_id IS NOT NULL AND embedding IS NOT NULL")
            .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
            .where(F.exists("embedding", lambda x: x != 0)))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def near_one(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: cosines stay, squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centres, nearest centre of each row)."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), empty.sum())]
        centres = unit(sums)
    return centres, (x @ centres.T).argmax(axis=1)


class Tree:
    """Nodes in arrays: centre, children (none: a leaf)."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children = [np.zeros(sample.shape[1])], [[]]
        self.leaves: list[int] = []
        queue = [(0, np.arange(len(sample)), leaves)]
        while queue:
            node, rows, want = queue.pop()
            k = min(BRANCHES, want, len(rows))
            if k < 2:
                self.leaves.append(node)
                continue
            centres, near = kmeans(sample[rows], k, rng)
            for c in range(k):
                own = rows[near == c]
                self.children[node].append(len(self.centres))
                queue.append((len(self.centres), own, round(want * len(own) / len(rows))))
                self.centres.append(centres[c])
                self.children.append([])
        self.centres = np.array(self.centres)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf a greedy descent reaches."""
        out = np.zeros(len(x), dtype=np.int64)
        queue = [(0, np.arange(len(x)))]
        while queue:
            node, rows = queue.pop()
            if not self.children[node] or not len(rows):
                out[rows] = node
                continue
            near = (x[rows] @ self.centres[self.children[node]].T).argmax(axis=1)
            queue += [(child, rows[near == c]) for c, child in enumerate(self.children[node])]
        return out

    def visit(self, query: np.ndarray, leaves: int, root: int = 0) -> list[int]:
        """The first leaves that leave the priority queue, of those below a node."""
        queue, out = [(-1.0, root)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            children = self.children[node]
            if not children:
                out.append(node)
                continue
            for child, near in zip(children, (self.centres[children] @ query).tolist()):
                heapq.heappush(queue, (-near, child))
        return out

    def visited(self, queries: np.ndarray, leaves: int) -> np.ndarray:
        """For each query (row), which of `self.leaves` (column) are among the first that leave its priority queue.

        A leaf leaves the queue by the least nearness on its way from the root: of two leaves the one whose least is
        larger comes first. Leaves with the same least share the node that has it, and only the last such node, from
        which not all leaves are taken, is searched with a queue.
        """
        own = np.array(self.leaves)
        if leaves >= len(own):
            return np.ones((len(queries), len(own)), bool)
        near = self.centres @ queries.T
        least, place = np.full(near.shape, np.inf), np.zeros(near.shape, np.int32)
        for node, children in enumerate(self.children):
            if children:
                below = slice(children[0], children[-1] + 1)
                least[below] = np.minimum(least[node], near[below])
                place[below] = np.where(near[below] < least[node], np.arange(below.start, below.stop)[:, None], place[node])
        least, place = least[own].T, place[own].T
        last = np.partition(least, len(own) - leaves, axis=1)[:, len(own) - leaves, None]
        out, equal = least > last, least == last
        more = leaves - out.sum(axis=1)
        column = {node: i for i, node in enumerate(self.leaves)}
        for i in range(len(queries)):
            nodes = place[i, equal[i]]
            if len(nodes) == more[i]:
                out[i] |= equal[i]
            elif (nodes == nodes[0]).all():
                out[i, [column[x] for x in self.visit(queries[i], more[i], int(nodes[0]))]] = True
            else:  # equal centres
                out[i] = False
                out[i, [column[x] for x in self.visit(queries[i], leaves)]] = True
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 300) -> int:
        """Leaves to visit so that the sample's own queries find `recall` of their k nearest in the sample."""
        leaf = self.leaf_of(sample)
        chosen = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
        near = sample[chosen] @ sample.T
        near[np.arange(len(chosen)), chosen] = -2
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.leaves)
        wanted = leaf[np.argpartition(-near, k - 1, axis=1)[:, :k]]
        # The rank at which each wanted neighbour's leaf is visited; enough visits cover `recall` of them.
        ranks = []
        for query, goals in zip(sample[chosen], wanted):
            order = {node: i for i, node in enumerate(self.visit(query, len(self.leaves)))}
            ranks += [order[g] for g in goals]
        return int(np.quantile(ranks, recall, method="higher")) + 1


def best_rows(found: list[tuple], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, ids, scores) of the `keep` best rows of every query: highest score, then smallest id."""
    query, own, score = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((own, -score, query))
    query, own, score = query[order], own[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return tuple(part[place < keep] for part in (query, own, score))


def scored(q: np.ndarray, x: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of x, cosines), for some queries at a time: all that may be among a query's `keep` best rows."""
    return reaching(near_one(q), unit(q), np.full(len(q), -np.inf), near_one(x), keep)


def reaching(q: np.ndarray, units: np.ndarray, least: np.ndarray, x: np.ndarray, keep: int
             ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`scored`, for rows that near_one has scaled and units = unit(q), without cosines that must lie below `least`.

    A product of unit vectors picks them; it and the cosine are each within `slack` of the true value, so what lies more
    than four times that below the `keep`-th best product, or below a cosine that `keep` rows reach (`least`), cannot
    have a cosine as high as that.
    """
    slack = (x.shape[1] + 16) * np.finfo(float).eps
    near, floor = units @ unit(x).T, least - 4 * slack
    some_reach = np.flatnonzero(near.max(axis=1) >= floor)
    near, floor = near[some_reach], floor[some_reach]
    if len(x) > keep:
        many = np.flatnonzero((near >= floor[:, None]).sum(axis=1) > keep)
        ranked = np.partition(near[many], len(x) - keep, axis=1)[:, len(x) - keep]
        floor[many] = np.maximum(floor[many], ranked - 4 * slack)
    who, some = np.nonzero(near >= floor[:, None])
    who = some_reach[who]
    # Queries whose candidates are scored together: up to PRODUCTS components, one query at least.
    ends = np.cumsum(np.bincount(who, minlength=len(q)))
    at = 0
    while at < len(who):
        first = who[at]
        last = max(np.searchsorted(ends, at + PRODUCTS // x.shape[1], side="right"), first + 1)
        part = slice(at, ends[last - 1])
        a, b = q[who[part]], x[some[part]]
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        yield who[part], some[part], score
        at = ends[last - 1]


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gathered(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """Embeddings as rows, and other columns, of batches together, about GATHERED bytes of vectors at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([matrix(batch.column("embedding")),
                         *(batch.column(name).to_numpy(zero_copy_only=False) for name in names)])
            size += held[-1][0].nbytes
            if size >= GATHERED:
                yield [np.concatenate(part) for part in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(part) for part in zip(*held)]


def dealt(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first part, number of parts, place in its part) of each leaf: parts of about `most` vectors at most.

    Neighbouring leaves share a part; a leaf of more vectors has parts of its own.
    """
    first, number, place = (np.zeros(len(counts), np.int64) for _ in range(3))
    part, size, leaves = 0, 0, 0  # of the part that is being filled
    for leaf, count in enumerate(counts.tolist()):
        number[leaf] = max(1, -(-count // most))
        if leaves and size + count > most:
            part, size, leaves = part + 1, 0, 0
        first[leaf], place[leaf] = part, leaves
        size, leaves = size + count, leaves + 1
        if number[leaf] > 1:
            part, size, leaves = part + number[leaf], 0, 0
    return first, number, place


PACKED = "part int, query int, ids binary, vectors binary, leaves binary"


def packed(part: int, query: int, ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray) -> dict[str, list]:
    """Rows of PACKED, each with ROW bytes of vectors: ids, vectors, and what is said of their leaves."""
    step = max(1, ROW // vectors[0].nbytes)
    cuts = [slice(i, i + step) for i in range(0, len(ids), step)]
    return {"part": [part] * len(cuts), "query": [query] * len(cuts),
            **{name: [np.ascontiguousarray(a[c]).tobytes() for c in cuts]
               for name, a in (("ids", ids.astype("<i8")), ("vectors", vectors), ("leaves", leaves))}}


class Part:
    """Vectors of some leaves, ordered by leaf, that queries are compared with."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, place: np.ndarray):
        order = np.argsort(place, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.searchsorted(place[order], np.arange(place.max() + 2))

    def best(self, q: np.ndarray, visited: np.ndarray, keep: int, limit: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of q, ids, scores): the `keep` best of each query among the leaves (columns) that it visits.

        Found rows are cut to the best beyond `limit`, or once they have doubled, and the last of the best says what later
        leaves must reach.
        """
        least = np.full(len(q), -np.inf)
        held, size = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, float))], 0
        most, units, q = min(limit, keep * len(q) // 2), unit(q), near_one(q)
        for leaf, (start, end) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            who = np.flatnonzero(visited[:, leaf])
            step = max(1, PRODUCTS // max(1, len(who)))
            for at in range(start, end if len(who) else start, step):
                own = slice(at, min(at + step, end))
                x = near_one(self.vectors[own].astype(float))
                for a, b, score in reaching(q[who], units[who], least[who], x, keep):
                    held.append((who[a], self.ids[own][b], score))
                    size += len(score)
                    if size > most:
                        held = [best_rows(held, keep)]
                        query, _, scores = held[0]
                        size = len(query)
                        most = max(most, 2 * size)
                        last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
                        full = last[np.bincount(query, minlength=len(q))[query[last]] == keep]
                        least[query[full]] = scores[full]
        return best_rows(held, keep)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec_id, embedding, ids): one row per different vector with its `keep` smallest ids.

    The limit on row_number is applied in every task before the shuffle, so a vector with very many copies stays small.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    # In the window, and not by groupBy, which would deal all vectors out once more.
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (first.withColumn("ids", F.collect_list("vec_id").over(every)).where("n = 1")
            .select("vec_id", "embedding", "ids"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL,
            sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query (vec_id divisible by `every`).

    Candidates are all other rows. Nearness is the cosine in double precision, ties go to the smaller vec_id. Null
    ids, null or zero vectors and those with a null or non-finite component take no part. A repeated id counts with
    each of its vectors as a query; of equal rows one counts. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    # Floats travel as floats: as doubles they are the same numbers.
    small = dict(vectors.dtypes)["embedding"] == "array<float>"
    number = "<f4" if small else "<f8"
    rows = usable(vectors)
    rows = materialize(rows.withColumn("embedding", F.col("embedding").cast("array<float>")) if small else rows, "vectors")
    index = materialize(distinct_vectors(rows, k + 1), "distinct_vectors")
    n = index.count()
    sample = np.array([r[0] for r in index.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(
        sample_rows).collect()], dtype=np.float64)
    if not n:
        kind = dict(vectors.dtypes)["vec_id"]
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample, length = unit(sample), sample.shape[1]
    tree = Tree(sample, max(1, min(n // LEAF, len(sample) // 4)))
    visits = tree.calibrate(sample, k, recall)
    shared = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaves))

    def load() -> tuple[Tree, np.ndarray]:
        tree = Tree.__new__(Tree)
        tree.centres, tree.children, tree.leaves = shared.value
        column = np.zeros(len(tree.children), np.int64)
        column[tree.leaves] = np.arange(len(tree.leaves))
        return tree, column

    def count(batches):
        tree, column = load()
        counts = np.zeros(len(tree.leaves), np.int64)
        for x, in gathered(batches):
            counts += np.bincount(column[tree.leaf_of(unit(x.astype(float)))], minlength=len(counts))
        yield {"leaf": np.flatnonzero(counts), "n": counts[counts > 0]}

    counts = np.zeros(len(tree.leaves), np.int64)
    for r in map_batches(index.select("embedding"), count, "leaf bigint, n bigint").groupBy("leaf").agg(
            F.sum("n").alias("n")).collect():
        counts[r.leaf] = r.n
    most = min(max(n // PARTS, PART_ROWS), max(1, PART // (length * int(number[-1]))))
    first, number_of, place_of = dealt(counts, most)
    parts = int((first + number_of).max())
    # Leaves of a part: those whose parts begin at or before it and do not end before it.
    ends = first + number_of
    leaves_of = [slice(int(np.searchsorted(ends, part, side="right")), int(np.searchsorted(first, part, side="right")))
                 for part in range(parts)]

    def place(batches):
        tree, column = load()
        for x, ids, h in gathered(batches, "vec_id", "h"):
            leaf = column[tree.leaf_of(unit(x.astype(float)))]
            part = first[leaf] + h % number_of[leaf]
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for own in np.split(order, cuts):
                yield packed(int(part[own[0]]), 0, ids[own], x[own], place_of[leaf[own]].astype("<i4"))

    def walk(batches):
        tree, _ = load()
        for vectors_of, ids_of in gathered(batches, "vec_id"):
            for at in range(0, len(ids_of), WALKED):
                x, ids = vectors_of[at:at + WALKED], ids_of[at:at + WALKED]
                visited = tree.visited(unit(x.astype(float)), visits)
                for part, own in enumerate(leaves_of):
                    who = np.flatnonzero(visited[:, own].any(axis=1))
                    if len(who):
                        yield packed(part, 1, ids[who], x[who], np.packbits(visited[who, own], axis=1))

    def compare(batches):
        # The vectors of a part come first, then its queries. A task hands on the best k + 1 of each query in the part.
        def joined(rows):
            return [b"".join(column) for column in zip(*rows)]

        def numbers(ids, x):
            return np.frombuffer(ids, "<i8"), np.frombuffer(x, number).reshape(-1, length)

        def flush():
            ids, x, bits = joined(passing)
            own, q = numbers(ids, x)
            q, visited = q.astype(float), np.frombuffer(bits, np.uint8).reshape(len(q), -1)
            visited = np.unpackbits(visited, axis=1).astype(bool)
            for at in range(0, len(q), PASSING):
                who, found, score = held.best(q[at:at + PASSING], visited[at:at + PASSING], k + 1, HELD)
                yield {"query_id": own[at:at + PASSING][who], "vec_id": found, "score": score}

        at, held, coming, passing, size = None, None, [], [], 0
        for batch in batches:
            for part, query, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if part != at:
                    if passing:
                        yield from flush()
                    at, held, coming, passing, size = part, None, [], [], 0
                if not query:
                    coming.append(row)
                    continue
                if coming:
                    ids, x, places = joined(coming)
                    coming = []  # the rows go before the vectors are put in order
                    held = Part(*numbers(ids, x), np.frombuffer(places, "<i4"))
                    del ids, x, places
                if held:
                    passing.append(row)
                    size += len(row[0]) // 8
                    if size >= PASSING:
                        yield from flush()
                        passing, size = [], 0
        if passing:
            yield from flush()

    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    own = map_batches(index.select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("h")), place, PACKED)
    walked = map_batches(queries, walk, PACKED)
    pairs = own.unionByName(walked).repartitionById(parts, "part").sortWithinPartitions("part", "query")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = (map_batches(pairs, compare, "query_id bigint, vec_id bigint, score double")
             .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1))
    # The copies of a vector come back with it.
    full = (found.join(index.select("vec_id", "ids"), "vec_id")
            .select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct())
    return (full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
