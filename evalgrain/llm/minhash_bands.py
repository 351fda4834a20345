"""Near-duplicates by MinHash: banded minima, signature verification, exact confirmation, star components.

Method: a document's set holds its different shingles of WORDS words. HASHES universal hash functions (multiply and shift)
each give the minimum over the set; documents whose minima agree in a whole band of ROWS are candidates. At similarity
0.8 a pair shares one of the 32 bands but for 5e-8 of the cases. Candidates are verified on signatures (one byte of each
minimum: more than MAX_DIFFERENT of 128 differ in 1e-8 of the cases at 0.8), then confirmed on their full sets, and the
links are joined to components by alternating large and small stars.

Documents of equal sets are one class, so copies cost one row. A band value that up to PAIRED classes share is paired up.
More are a crowd: all are first compared with the smallest; components that this leaves apart are joined by an exact
prefix join on full sets (`prefix_join`), so no pair that could link two components is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.llm.common import components, map_batches, materialize, whole_text
from evalgrain.llm.prefix_join import join_crowds, similar

WORDS, PERCENT = 4, 80
HASHES, ROWS = 128, 4
MAX_DIFFERENT = 53
PAIRED = 16
CHUNK = 4096  # shingles that are hashed by all functions at once
LONGS = HASHES // 8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; the whole sequence if there are fewer words; empty without words."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh3_64_intdigest, max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + width])) for i in range(n)), np.uint64, n))


def multipliers(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, HASHES, 1), dtype=np.uint64)
    return a | np.uint64(1), b


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash function over the set, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (a * hashes[i:i + CHUNK] + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(row, same, n, bands, signature) of every row (row, text).

    `same` is equal for equal sets, n their size, bands one key per band, signature one byte per minimum in longs; the
    last two are null for an empty set.
    """
    import hashlib

    import xxhash

    def run(batches):
        a, b = multipliers()
        for batch in batches:
            out = {"row": batch.column("row"), "same": [], "n": [], "bands": [], "signature": []}
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, width)
                out["same"].append(hashlib.md5(hashes.tobytes()).digest())
                out["n"].append(len(hashes))
                if not len(hashes):
                    out["bands"].append(None)
                    out["signature"].append(None)
                    continue
                least = minima(hashes, a, b)
                out["bands"].append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=k) - (1 << 63)
                                     for k, band in enumerate(least.reshape(-1, ROWS))])
                # The last bytes of minima depend on all bits below 32 of the products.
                out["signature"].append((least & np.uint32(255)).astype(np.uint8).view("<i8"))
            yield out

    return map_batches(docs.select("row", whole_text().cast("binary").alias("text")), run,
                       "row bigint, same binary, n bigint, bands array<bigint>, signature array<bigint>")


def full_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(row, shingles): the whole sets of rows (row, text)."""
    def run(batches):
        for batch in batches:
            yield {"row": batch.column("row"),
                   "shingles": [shingle_set(x, width).view(np.int64) for x in batch.column("text").to_pylist()]}

    return map_batches(docs.select("row", whole_text().cast("binary").alias("text")), run,
                       "row bigint, shingles array<bigint>")


def sizes_fit(x: str, y: str) -> Column:
    """Sets of such sizes can be similar enough."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def different_bytes(x: str, y: str) -> Column:
    """In how many minima's bytes two signatures differ, with integer operations on longs of eight bytes."""
    def longs(i: int) -> Column:
        d = F.get(F.col(x), F.lit(i)).bitwiseXOR(F.get(F.col(y), F.lit(i)))
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda s, i: s + longs(i), range(1, LONGS), longs(0))


def candidates(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes (row, n, bands, signature), a < b, that pass the signatures; and crowds (key, row)."""
    keyed = single.select("row", F.posexplode("bands").alias("band", "value")).select(
        "row", F.struct("band", "value").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("first")).where("c > 1")
    shared = materialize(keyed.join(sizes, "key"), "bands")
    few, many = shared.where(F.col("c") <= PAIRED), shared.where(F.col("c") > PAIRED)
    pairs = few.select("key", F.col("row").alias("a")).join(few.select("key", F.col("row").alias("b")), "key").where(
        "a < b").select("a", "b")
    stars = many.where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    return verified(pairs.unionByName(stars).distinct(), single), many.select("key", "row")


def verified(pairs: DataFrame, single: DataFrame) -> DataFrame:
    x = single.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    y = single.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    return (pairs.join(x, "a").join(y, "b").where(sizes_fit("na", "nb"))
            .where(different_bytes("sa", "sb") <= MAX_DIFFERENT).select(*pairs.columns))


def class_components(single: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(row, root) of the classes that are linked with another; root is the smallest row reachable."""
    pairs, crowds = candidates(single)
    pairs = materialize(pairs, "candidates")
    asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).unionByName(
        crowds.select("row")).distinct()
    sets = materialize(full_sets(docs.join(asked, "row", "left_semi"), width), "sets")
    grouped = materialize(components(similar(pairs, sets, PERCENT)).select(F.col("node").alias("row"), "root"), "grouped")
    return join_crowds(crowds, grouped, sets, PERCENT)


def near_duplicates(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text).

    Documents are linked if 100 * intersection >= PERCENT * union of their sets of shingles; component_id is the smallest
    doc_id reachable. Null texts and texts without words have an empty set and are linked with nothing. Repeated rows are
    rows like others; null ids are never the smallest while there are others, and a component of null ids alone has a null
    id and is not kept. An empty table gives no rows. Other columns are ignored. Sets are held as 64-bit hashes.
    """
    rows = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "documents")
    signed = materialize(signatures(rows, width), "signatures")
    # Empty sets are classes of their own rows.
    classes = signed.where("n > 0").groupBy("same").agg(F.min("row").alias("first"))
    single = materialize(signed.join(classes.select(F.col("first").alias("row")), "row", "left_semi"), "classes")
    grouped = class_components(single, rows.select("row", "text"), width)
    member = (signed.where("n > 0").select("row", "n", "same").join(classes, "same")
              .join(grouped.select(F.col("row").alias("first"), "root"), "first", "left")
              .select("row", "n", F.coalesce("root", "first").alias("root"))
              .unionByName(signed.where("n = 0").select("row", "n", F.col("row").alias("root"))))
    named = materialize(member.join(rows.select("row", "doc_id"), "row"), "members")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
