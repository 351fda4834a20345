"""Benchmark decontamination by spaced seeds.

Method: fixed masks slide over the word sequence of benchmark items and of documents. A mask keeps some positions and
ignores the others, so a hash of the kept words survives substitutions at ignored positions. Hashes of both sides are
joined, and each hit proposes a place of an item in a document, which is verified word by word: an item is found where
at least `share` of its words stand at their places, whatever stands in the others.

The item's hashes also go to all tasks as a bit array of fixed size (4 MB), two bits each, so that only document hashes
that can match are shuffled; a larger benchmark makes the filter weaker, never the broadcast larger, and never loses a hit.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import map_batches, materialize, whole_text

# Fixed masks of weight five: 1 keeps a position.
MASKS = ("11111", "1101011", "11010011", "10111001")
SHARE = 0.8
SPAN = min(map(len, MASKS))
FILTER_BITS = 25
WORD = re.compile(r"\w+")
MEMORY = 400_000  # words whose hash a task remembers; only speed depends on it
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of the words of texts: lower case, letters and digits only."""

    def __init__(self):
        import xxhash

        self.digest, self.known = xxhash.xxh64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > MEMORY:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.digest(word.encode("utf-8", "replace"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, hash) for every mask that the sequence is long enough for."""
    out = []
    for m, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        if n > 0:
            h = np.full(n, m + 1, np.uint64)
            for k in (k for k, keep in enumerate(mask) if keep == "1"):
                h = (h ^ words[k:k + n]) * _MIX
                h ^= h >> np.uint64(31)
            out.append((np.arange(n), h))
    return out


def short_seed(words: np.ndarray) -> int:
    """The hash of a whole short item; documents give the same for every run of as many words."""
    h = np.uint64(len(words) + 100)
    for word in words:
        h = (h ^ word) * _MIX
        h ^= h >> np.uint64(31)
    return int(h.view(np.int64))


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """short_seed of every run of `size` words."""
    n = len(words) - size + 1
    h = np.full(max(n, 0), size + 100, np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ words[k:k + n]) * _MIX
        h ^= h >> np.uint64(31)
    return h


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, words, seeds): hashed words of an item, and (start, hash) of its seeds. Items without words are none."""
    def run(batches):
        hashed = Words()
        for batch in batches:
            out = {"item_id": [], "words": [], "seeds": []}
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = hashed(text)
                if not len(words):
                    continue
                found = [(int(s), int(h)) for start, h in seeds(words) for s, h in zip(start, h.view(np.int64))]
                out["item_id"].append(item)
                out["words"].append(words.view(np.int64))
                out["seeds"].append([{"start": s, "hash": h} for s, h in found or [(0, short_seed(words))]])
            yield out

    kind = dict(items.dtypes)["item_id"]
    return map_batches(items.select("item_id", whole_text().alias("text")), run,
                       f"item_id {kind}, words array<bigint>, seeds array<struct<start: int, hash: bigint>>")


def slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in the filter."""
    return (hashes >> 7) & (1 << FILTER_BITS) - 1, (hashes >> 38) & (1 << FILTER_BITS) - 1


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bit array of 2**FILTER_BITS bits in which every hash has set its two; built in Spark, merged as 64-bit words."""
    slot = F.explode(F.array(*(F.shiftright("hash", k).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for k in (7, 38))))
    got = (hashes.select(slot.alias("slot"))
           .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
           .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())  # at most 2**FILTER_BITS / 64 rows
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)  # little-endian: bit k of a word is bit k % 8 of its byte k // 8


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes whose two bits are set."""
    first, second = slots(hashes)
    at = np.flatnonzero(bits[first >> 3] >> (first & 7).astype(np.uint8) & 1)
    second = second[at]
    return at[bits[second >> 3] >> (second & 7).astype(np.uint8) & 1 == 1]


def groups(texts: list[str], size: int = 1 << 20):
    """(from, to) of neighbouring texts of about `size` characters together; a longer text stands alone."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def clusters(docs: DataFrame, filtered, reach: int, short: list[int]) -> DataFrame:
    """(row, cluster, first, words, hits): runs of neighbouring hits of a document with the words around them.

    Texts are hashed in groups, as one sequence of words; a seed that runs over the end of its text is no seed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filtered)

    def run(batches):
        bits, hashed = shared.value, Words()
        for batch in batches:
            out = defaultdict(list)
            rows, texts = batch.column("row").to_pylist(), batch.column("text").to_pylist()
            for low, high in groups(texts):
                parts = [hashed(text) for text in texts[low:high]]
                words = np.concatenate(parts)
                ends = np.cumsum([len(part) for part in parts])
                tried = [(len(MASKS[m]), h) for m, (_, h) in enumerate(seeds(words))]
                tried += [(n, runs_of(words, n)) for n in short]
                at, hash_ = [], []
                for span, h in tried:
                    h = h.view(np.int64)
                    start = passing(h, bits)
                    start = start[start + span <= ends[np.searchsorted(ends, start, "right")]]
                    at.append(start)
                    hash_.append(h[start])
                if not sum(map(len, at)):
                    continue
                at, hash_ = np.concatenate(at), np.concatenate(hash_)
                order = np.argsort(at, kind="stable")
                at, hash_ = at[order], hash_[order]
                text_of = np.searchsorted(ends, at, "right")
                cut = [0, *(np.flatnonzero((np.diff(at) > reach) | (np.diff(text_of) > 0)) + 1).tolist(), len(at)]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    text = int(text_of[a])
                    begin, end = int(ends[text]) - len(parts[text]), int(ends[text])
                    first = max(begin, int(at[a]) - reach)
                    out["row"].append(rows[low + text])
                    out["cluster"].append(k)
                    out["first"].append(first - begin)
                    out["words"].append(words[first:min(end, int(at[b - 1]) + reach)].view(np.int64))
                    out["hits"].append([{"at": x, "hash": h}
                                        for x, h in zip((at[a:b] - begin).tolist(), hash_[a:b].tolist())])
            if out:
                yield out

    return map_batches(docs.select("row", whole_text().alias("text")), run,
                       "row bigint, cluster int, first int, words array<bigint>, "
                       "hits array<struct<at: int, hash: bigint>>")


def overlaps(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(row, item_id, n_equal, n_words, start): the best place of every item found in a row (row, text).

    n_equal of the item's n_words stand at their places from word `start` on, at least `share` of them. Of equally good
    places the first counts. An item cut off by a text's begin or end is found if so many of its words are there.
    """
    spark = docs.sparkSession
    table = materialize(item_seeds(items), "items")
    index = table.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.start", "s.hash")
    size = table.agg(F.max(F.size("words"))).first()[0]
    short = [r[0] for r in table.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect()]
    kind = dict(items.dtypes)["item_id"]
    if size is None:
        return spark.createDataFrame([], f"row bigint, item_id {kind}, n_equal int, n_words int, start int")
    found = materialize(clusters(docs, bit_filter(index), size + max(map(len, MASKS)), short), "clusters")
    places = (found.select("row", "cluster", F.explode("hits").alias("h")).select("row", "cluster", "h.at", "h.hash")
              .join(index, "hash").select("row", "cluster", "item_id", (F.col("at") - F.col("start")).alias("start"))
              .distinct())
    # Words before and after what a cluster holds lie outside the text or out of every item's reach.
    offset = F.col("start") - F.col("first")
    equal = F.size(F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda k: F.coalesce(
        F.get("words", F.when(offset + k >= 0, offset + k)) == F.get("item", k), F.lit(False))))
    best = F.max(F.struct("n_equal", (-F.col("start")).alias("s"), "n_words")).alias("b")
    return (places.join(found.select("row", "cluster", "first", "words"), ["row", "cluster"])
            .join(table.select("item_id", F.col("words").alias("item")), "item_id")
            .select("row", "item_id", "start", equal.alias("n_equal"), F.size("item").alias("n_words"))
            .where(F.col("n_equal") >= share * F.col("n_words"))
            .groupBy("row", "item_id").agg(best)
            .select("row", "item_id", "b.n_equal", "b.n_words", (-F.col("b.s")).alias("start")))


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_equal, n_words, overlap, start) of documents (doc_id, text) and items (item_id, text).

    Words are runs of letters and digits in lower case. Null texts are empty and never found; items without a word
    neither. Of repeated ids each document and each item counts once, with its best place. Empty tables: no rows.
    """
    doc = dict(docs.dtypes)["doc_id"]
    if doc != "bigint":
        raise ValueError("doc_id must be a bigint")
    found = overlaps(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), "text"),
                     items.where("item_id IS NOT NULL"), share)
    return found.select(F.col("row").alias("doc_id"), "item_id", "n_equal", "n_words",
                        (F.col("n_equal") / F.col("n_words")).alias("overlap"), "start")


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents in which no item is found; the columns stay as they are. Null ids are looked at like others.

    A text is known by its 64-bit digest; equal texts share the verdict.
    """
    text = F.xxhash64(whole_text())
    found = overlaps(docs.select(text.alias("row"), "text"), items, share).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", text).join(found, "__row", "left_anti").select(*docs.columns)
