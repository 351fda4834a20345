"""Removal of long repeated byte strings with a logarithmic family of sampled suffix arrays.

Method: texts are added in batches. A batch gets a sampled suffix array; it is merge-scanned against the arrays of the
levels that exist, which finds the long matches between old and new texts, and becomes a level itself. Two levels of
equal size merge into one of twice the size, so there are logarithmically many.

Sampling loses nothing. Of the GRAM-byte strings inside a window of LENGTH bytes the one with the smallest hash is the
window's anchor; equal windows have equal anchors. An array holds the suffixes that start at anchors, in the order of the
hash of their first GRAM bytes, once per such hash. Neighbouring windows share an anchor and form a run; a window can
only be repeated if its anchor's string is, so the scan hands on the runs of repeated anchors, and these are decided
exactly: runs with equal bytes around the anchor are repeated as a whole, and where they differ window by window.

Copies of a whole text are one text in the index. Texts are written once, bucketed by their digest, and meet the small
tables that speak about them without being shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.llm.common import map_batches, materialize, scratch_folder, whole_text

LENGTH = 200
GRAM = 64
BATCHES = 4
BLOCK = 1 << 18  # window starts handled at once
SMALL = 1 << 15  # differing surroundings of an anchor up to which they are compared in one call: about 10 MB
HALF = (LENGTH - GRAM) // 2

_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Hashes of any part of a block in constant time."""

    def __init__(self):
        self.up, self.down = powers(BLOCK + 2 * LENGTH + 1)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))

    def runs(self, n: int) -> tuple[np.ndarray, ...]:
        """(anchor's hash, first window, last window, anchor) of every run of windows of the loaded block of n bytes."""
        start = np.arange(n - GRAM + 1)
        grams = self.part(start, start + GRAM)
        least = (grams & ~_LOW) | start.astype(np.uint64)  # of equal hashes the leftmost
        width = 1
        while 2 * width <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = LENGTH - GRAM + 1 - width
        least = np.minimum(least[:-rest], least[rest:]) if rest else least
        anchor = (least & _LOW).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], cut])
        return grams[anchor[first]], first, np.concatenate([cut - 1, [len(anchor) - 1]]), anchor[first]


def block_of(text: bytes, k: int) -> np.ndarray:
    return np.frombuffer(text, np.uint8, min(len(text) - k * BLOCK, BLOCK + LENGTH - 1), k * BLOCK)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(texts: DataFrame, batches: int) -> DataFrame:
    """(g, uid, run, batch): every run; `run` packs its first window, how far right of it the anchor is, and its size."""
    def run(incoming):
        hasher = Hasher()
        for batch in incoming:
            uids, found = [], []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                for k in range(-(-(len(text) - LENGTH + 1) // BLOCK)):
                    data = block_of(text, k)
                    hasher.load(data)
                    g, first, last, anchor = hasher.runs(len(data))
                    found.append((signed(g), ((first + k * BLOCK) << 16) + ((anchor - first) << 8) + last - first))
                    uids += [uid] * len(g)
            if found:
                yield {"g": np.concatenate([x[0] for x in found]), "uid": uids,
                       "run": np.concatenate([x[1] for x in found])}

    rows = map_batches(texts.where(F.length("text") >= LENGTH).select("uid", "text"), run,
                       "g bigint, uid bigint, run bigint")
    return rows.withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int"))


class Levels:
    """The family of arrays (g, uid, run, again): one suffix per anchor hash; `again` if more than one has occurred."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []  # (uid, run) of repeated anchors

    def add(self, batch: DataFrame) -> None:
        first = F.min(F.struct("uid", "run")).alias("first")
        array = materialize(batch.groupBy("g").agg(first, (F.count("*") > 1).alias("again"))
                            .select("g", "first.uid", "first.run", "again"), "array")
        met = None
        for _, level in self.levels:  # the merge scan
            part = level.join(array.select("g"), "g", "left_semi")
            met = part if met is None else met.unionByName(part)
        grams = array.where("again").select("g")
        if met is not None:
            met = materialize(met, "met")
            self.matches.append(met.where("NOT again").select("uid", "run"))
            grams = grams.unionByName(met.select("g")).distinct()
            array = array.join(met.select("g", F.lit(True).alias("hit")).distinct(), "g", "left").select(
                "g", "uid", "run", (F.col("again") | F.coalesce("hit", F.lit(False))).alias("again"))
        self.matches.append(materialize(batch.join(grams, "g", "left_semi").select("uid", "run"), "matches"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            array = (array.unionByName(old).groupBy("g").agg(first, F.max("again").alias("again"))
                     .select("g", "first.uid", "first.run", "again"))
            size *= 2
        self.levels.append((size, array))

    def keep(self) -> None:
        """Write the newest level in the order of its suffixes."""
        size, array = self.levels.pop()
        self.levels.append((size, materialize(array.repartitionByRange("g").sortWithinPartitions("g"), "level")))


def surroundings(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """(uid, run, g, around, near): hashes of the anchor, of all bytes of its run, and of those on either side of it.

    A repeated window holds the HALF bytes left or right of the anchor, so `near` has the hashes of these strings, null
    where the run has no such window.
    """
    def run(incoming):
        hasher = Hasher()
        for batch in incoming:
            for uid, text, packed in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "runs"))):
                packed = np.array(packed, np.int64)
                first, left, more = packed >> 16, packed >> 8 & 255, packed & 255
                for k in np.unique(first // BLOCK):
                    some = first // BLOCK == k
                    data = block_of(text, int(k))
                    hasher.load(data)
                    s, a, n = first[some] - k * BLOCK, (first + left)[some] - k * BLOCK, more[some]
                    around = hasher.part(s, s + n + LENGTH) ^ ((left[some] << 8) + n).astype(np.uint64) * _MIX
                    has = a - s >= HALF, a - s - n <= HALF
                    sides = (signed(hasher.part(np.where(has[0], a - HALF, a), a + GRAM)),
                             signed(hasher.part(a, np.where(has[1], a + GRAM + HALF, a + GRAM))))
                    yield {"uid": [uid] * len(s), "run": packed[some], "g": signed(hasher.part(a, a + GRAM)),
                           "around": signed(around), "near": [
                               [x if p else None, y if q else None] for x, y, p, q in zip(
                                   sides[0].tolist(), sides[1].tolist(), has[0].tolist(), has[1].tolist())]}

    runs = matches.groupBy("uid").agg(F.collect_set("run").alias("runs"))
    return map_batches(texts.select("uid", "text").join(runs, "uid"), run,
                       "uid bigint, run bigint, g bigint, around bigint, near array<bigint>")


def edge_windows(context: bytes, packed: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset before the anchor, hash) of every window of a run, given the bytes of the run."""
    left, more = packed >> 8 & 255, packed & 255
    start = np.arange(more + 1)
    hasher = Hasher.__new__(Hasher)
    hasher.up, hasher.down = _SMALL_POWERS
    hasher.load(np.frombuffer(context, np.uint8))
    return left - start, hasher.part(start, start + LENGTH)


_SMALL_POWERS = powers(2 * LENGTH + 1)


def window_spans(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, start, end) of single windows repeated among differing surroundings of one anchor.

    edges: (uid, run, g, n), one row per anchor and surroundings. Those of an anchor with few come together in one
    call; those of the others are compared as one row per window, so no anchor is gathered in one task.
    """
    def cut(incoming):
        for batch in incoming:
            out = defaultdict(list)
            for uid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "runs"))):
                for r in runs:
                    first = r["run"] >> 16
                    for name, value in (("uid", uid), ("run", r["run"]), ("g", r["g"]), ("many", r["many"]),
                                        ("n", r["n"]), ("bytes", text[first:first + LENGTH + (r["run"] & 255)])):
                        out[name].append(value)
            if out:
                yield out

    def compare(members):
        found = [edge_windows(context, packed) for _, packed, _, context in members]
        key = np.concatenate([h ^ (o.astype(np.uint64) * _MIX) for o, h in found])
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        again, k, out = times[at] > 1, 0, {"uid": [], "start": [], "end": []}
        for (uid, packed, n, _), (o, _) in zip(members, found):
            hit = again[k:k + len(o)]
            k += len(o)
            if n == 1 and hit.any():
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                out["uid"] += [uid] * int((edge == 1).sum())
                out["start"] += ((packed >> 16) + np.flatnonzero(edge == 1)).tolist()
                out["end"] += ((packed >> 16) + np.flatnonzero(edge == -1) - 1 + LENGTH).tolist()
        return out

    def together(incoming):
        now, members = None, []
        for batch in incoming:
            for g, *member in zip(*(batch.column(c).to_pylist() for c in ("g", "uid", "run", "n", "bytes"))):
                if g != now and members:
                    yield compare(members)
                    members = []
                now = g
                members.append(member)
        if members:
            yield compare(members)

    def apart(incoming):
        for batch in incoming:
            for uid, packed, g, n, context in zip(*(batch.column(c).to_pylist() for c in ("uid", "run", "g", "n", "bytes"))):
                o, h = edge_windows(context, packed)
                yield {"uid": [uid if n == 1 else None] * len(o), "start": (packed >> 16) + np.arange(len(o)),
                       "key": signed((h ^ (o.astype(np.uint64) * _MIX)) + np.uint64(g * int(_MIX) % (1 << 64)))}

    sizes = edges.groupBy("g").agg((F.count("*") > SMALL).alias("many"))
    runs = (edges.join(sizes, "g").groupBy("uid")
            .agg(F.collect_list(F.struct("run", "g", "many", "n")).alias("runs")))
    parts = materialize(map_batches(texts.select("uid", "text").join(runs, "uid"), cut,
                                    "uid bigint, run bigint, g bigint, many boolean, n bigint, bytes binary"), "edges")
    few = parts.where("NOT many").select("g", "uid", "run", "n", "bytes").repartition("g").sortWithinPartitions("g")
    spans = map_batches(few, together, "uid bigint, start bigint, end bigint")
    windows = map_batches(parts.where("many").select("uid", "run", "g", "n", "bytes"), apart,
                          "uid bigint, start bigint, key bigint")
    again = windows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    return spans.unionByName(windows.where("uid IS NOT NULL").join(again, "key", "left_semi").select(
        "uid", "start", (F.col("start") + LENGTH).alias("end")))


def digest(text: Column) -> Column:
    """64 bits; among a billion different texts any two collide with a probability of 3 %."""
    return F.xxhash64(text)


def written_texts(docs: DataFrame) -> DataFrame:
    """(uid, text, copies): the different texts as bytes, written once and bucketed by digest."""
    spark = docs.sparkSession
    text = whole_text().cast("binary")
    rows = docs.select(digest(text).alias("uid"), text.alias("text")).groupBy("uid").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    (rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")
     .option("path", scratch_folder(spark, "texts")).saveAsTable(name))
    return spark.table(name)


def repeated_spans(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(uid, start, end): spans that cover exactly the bytes of repeated LENGTH-byte strings of different texts."""
    found = materialize(anchors(texts, batches), "anchors")
    levels = Levels()
    for k in range(batches):
        levels.add(found.where(F.col("batch") == k))
        if k < batches - 1:
            levels.keep()
    matches = levels.matches[0]
    for more in levels.matches[1:]:
        matches = matches.unionByName(more)
    rows = materialize(surroundings(texts, matches), "surroundings")
    kinds = materialize(rows.groupBy("g", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("uid", "run", "near")).alias("one")), "kinds")
    whole = rows.join(kinds.where("n > 1").select("g", "around"), ["g", "around"], "left_semi").select(
        "uid", F.shiftright("run", 16).alias("start"),
        (F.shiftright("run", 16) + F.col("run").bitwiseAND(255) + LENGTH).alias("end"))
    # Differing surroundings can share a window only if they share the bytes on one side of the anchor.
    sides = kinds.select("g", "around", F.posexplode("one.near").alias("side", "h")).where("h IS NOT NULL")
    shared = sides.groupBy("g", "side", "h").agg(F.count("*").alias("c")).where("c > 1").select("g", "side", "h")
    alive = sides.join(shared, ["g", "side", "h"], "left_semi").select("g", "around").distinct()
    edges = materialize(kinds.join(alive, ["g", "around"], "left_semi").select("one.uid", "one.run", "g", "n"), "alive")
    return whole.unionByName(window_spans(texts, edges))


def cut_texts(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """(uid, n_bytes, n_removed, n_spans, kept_sha256 or kept): texts without the bytes their spans cover."""
    def run(incoming):
        for batch in incoming:
            out = defaultdict(list)
            for uid, text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "copies", "spans"))):
                if copies > 1 and len(text) >= LENGTH:
                    spans = [{"start": 0, "end": len(text)}]
                kept, at, runs, removed = [], 0, 0, 0
                for span in sorted(spans or (), key=lambda s: s["start"]):
                    if span["start"] > at or not runs:
                        kept.append(text[at:span["start"]])
                        runs += 1
                        removed -= span["start"]
                        removed += span["end"]
                        at = span["end"]
                    elif span["end"] > at:
                        removed += span["end"] - at
                        at = span["end"]
                rest = b"".join([*kept, text[at:]])
                for name, value in (("uid", uid), ("n_bytes", len(text)), ("n_removed", removed), ("n_spans", runs),
                                    ("kept", rest if with_text else hashlib.sha256(rest).hexdigest())):
                    out[name].append(value)
            yield out

    grouped = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = "binary" if with_text else "string"
    return map_batches(texts.select("uid", "text", "copies").join(grouped, "uid", "left"), run,
                       f"uid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kind}")


def report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents (doc_id, text).

    A byte goes if a 200-byte string that covers it also starts anywhere else, in the same document or another; strings
    are judged on the input. Null text: empty. Shorter texts lose nothing. Copies and repeated rows of 200 bytes or more
    lose all. An empty table gives no rows.
    """
    texts = written_texts(docs)
    cut = cut_texts(texts, repeated_spans(texts, batches), False)
    return (docs.select("doc_id", digest(whole_text().cast("binary")).alias("uid")).join(cut, "uid")
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256")))


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without their repeated strings; `n_chars` follows, other columns stay, no row is dropped.

    Bytes of a character that was cut apart go with it. A null text stays null.
    """
    texts = written_texts(docs)
    cut = cut_texts(texts, repeated_spans(texts, batches), True)

    def decode(incoming):
        for batch in incoming:
            yield {"__uid": batch.column("uid"),
                   "__kept": [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]}

    kept = map_batches(cut.where("n_removed > 0").select("uid", "kept"), decode, "__uid bigint, __kept string")
    joined = (docs.withColumn("__uid", digest(whole_text().cast("binary"))).join(kept, "__uid", "left")
              .withColumn("__text", F.coalesce("__kept", "text")))
    return joined.select(*(
        F.col("__text").alias("text") if c == "text" else
        F.length("__text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
