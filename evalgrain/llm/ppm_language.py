"""Language identification by prediction by partial matching.

Method: one variable-order byte context tree per language. A context of three bytes predicts the next byte from its
counts and escapes to the context that is a byte shorter when the byte is new there, down to single bytes and at last
to a uniform code (escape method C: c/(n+d) for a byte seen c times, d/(n+d) for an escape, with n counts and d distinct
bytes in the context). Statistics are frozen after training, so a text's code length is exact: a sum of table entries,
one per byte. The language with the shortest code wins.

The trees of all languages are one table: a row per context seen in training, a column per byte and language.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.llm.common import map_batches, whole_text

ORDER = 3
# Bound of the training sample: about so many whole texts per language, chosen by hash.
SAMPLE = 300
START = b"\n" * ORDER  # stands before every text
BLOCK = 1 << 19  # bytes scored at once
UNKNOWN = "und"


class Trees(NamedTuple):
    """Code lengths in bits. `symbols` numbers the bytes; `longest` is the row of the longest known context."""

    languages: list[str]
    symbols: np.ndarray
    longest: np.ndarray
    bits: np.ndarray

    def score(self, data: np.ndarray) -> np.ndarray:
        """Bits per byte and language of data[ORDER:], each byte after the ORDER bytes before it."""
        s, n = self.symbols[data].astype(np.int64), int(self.symbols.max()) + 1
        context = (s[:-3] * n + s[1:-2]) * n + s[2:-1]
        return self.bits[self.longest[context] * n + s[3:]]


def sample(labelled: DataFrame, rows: int, most: int = 1000) -> DataFrame:
    """About `rows` texts of each language, or all it has; chosen by a hash, so every run takes the same.

    More than `most` different languages are an error: the trees hold one column for each.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], rows / r["n"]))) if counts else None
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(part < shares[F.col("lang")] if counts else F.lit(False)).select("lang", "text")


def grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n): how often ORDER bytes and the next one occur, as one big-endian number."""
    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                b = np.frombuffer(START + text, np.uint8).astype(np.int64)
                gram, n = np.unique((((b[:-3] << 8) + b[1:-2] << 8) + b[2:-1] << 8) + b[3:], return_counts=True)
                yield {"lang": [lang] * len(gram), "gram": gram, "n": n}

    rows = map_batches(texts.select("lang", F.col("text").cast("binary").alias("text")), run,
                       "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, rows: int = SAMPLE) -> Trees | None:
    """Trees from labelled texts (doc_id, text, lang); None without any.

    The driver gets the distinct four-byte strings of the bounded sample.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counted = grams(sample(labelled, rows)).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return None
    gram = counted["gram"].to_numpy(np.int64)
    seen = np.unique(np.concatenate([gram >> (8 * k) & 255 for k in range(ORDER + 1)]))
    symbols = np.full(256, len(seen), np.int16)
    symbols[seen] = np.arange(len(seen))
    n = len(seen) + 1  # the last number stands for all bytes never seen
    digits = [symbols[gram >> (8 * k) & 255].astype(np.int64) for k in range(ORDER, -1, -1)]
    column = np.searchsorted(languages, counted["lang"].to_numpy(str))
    weight = counted["n"].to_numpy(float)

    table = np.full((1, n, len(languages)), 8.0, np.float32)  # uniform over bytes
    contexts, levels = np.zeros(1, np.int64), []
    for order in range(ORDER + 1):
        context = np.zeros(len(gram), np.int64)
        for digit in digits[ORDER - order:ORDER]:
            context = context * n + digit
        if order:  # every context starts as its suffix, one byte shorter
            known = np.unique(context)
            table = table[np.searchsorted(contexts, known % n ** (order - 1))]
            contexts = known
        entry, at = np.unique(np.stack([context, digits[ORDER], column]), axis=1, return_inverse=True)
        count = np.bincount(at.ravel(), weight)
        row = np.searchsorted(contexts, entry[0])
        place = row * len(languages) + entry[2]
        size = len(contexts) * len(languages)
        total, distinct = np.bincount(place, count, size), np.bincount(place, minlength=size)
        escape = np.zeros(size)
        used = total > 0
        escape[used] = np.log2((total[used] + distinct[used]) / distinct[used])
        table = table + escape.reshape(-1, 1, len(languages)).astype(np.float32)
        table[row, entry[1], entry[2]] = np.log2((total[place] + distinct[place]) / count)
        levels.append((contexts, table))
    # Rows of all orders below each other; each possible context points at its longest known suffix.
    starts = np.cumsum([0, *(len(c) for c, _ in levels)])
    longest = np.zeros(1, np.int32)
    for order, (known, _) in enumerate(levels):
        if order:
            longest = np.tile(longest, n)
        longest[known] = starts[order] + np.arange(len(known), dtype=np.int32)
    bits = np.concatenate([t.reshape(-1, len(languages)) for _, t in levels])
    return Trees([str(x) for x in languages], symbols, longest, bits)


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language; the work is cut into blocks, texts are not."""
    out = np.zeros((len(texts), len(trees.languages)))
    batch, size = [], 0

    def flush() -> None:
        if batch:
            data = np.frombuffer(b"".join(START + texts[k] for k in batch), np.uint8)
            # The bytes of START at each text's begin are scored too and left out of the sums.
            bits = trees.score(data)
            ends = np.cumsum([len(texts[k]) + ORDER for k in batch])
            starts = ends - [len(texts[k]) for k in batch]
            marks = np.stack([starts, ends], 1).ravel() - ORDER
            sums = np.add.reduceat(np.concatenate([bits, np.zeros_like(bits[:1])]), marks, axis=0, dtype=np.float64)
            out[batch] = sums[::2]
            batch.clear()

    for k, text in enumerate(texts):
        if len(text) > BLOCK:
            data = np.frombuffer(START + text, np.uint8)
            for i in range(0, len(text), BLOCK):
                out[k] += trees.score(data[i:i + BLOCK + ORDER]).sum(axis=0, dtype=np.float64)
        elif text:
            if size + len(text) > BLOCK:
                flush()
                size = 0
            batch.append(k)
            size += len(text)
    flush()
    return out


def predict(docs: DataFrame, trees: Trees | None, *keep: str | Column) -> DataFrame:
    """(kept columns, lang_pred, score): from the whole text alone.

    Null text or a text without a letter: `und`, score 0; so is every text if there was nothing to learn from. The
    score is the winner's share if each language's probability is two to the minus its code length. Ties go to the
    first language by name. Repeated rows: one row each.
    """
    kept = docs.select(*keep).columns
    rows = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).cast("binary").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(trees and tuple(trees))

    def run(batches):
        trees = shared.value and Trees(*shared.value)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            some = [k for k, x in enumerate(texts) if x is not None]
            if trees and some:
                bits = code_lengths(trees, [texts[k] for k in some])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for k, i, s in zip(some, best.tolist(), share.tolist()):
                    lang[k], score[k] = trees.languages[i], s
            yield {**{c: batch.column(c) for c in kept}, "lang_pred": lang, "score": score}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{schema}, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    """Rows whose language is never learned from; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents (doc_id, text, lang)."""
    trees = train(docs.where(~held_out()), rows)
    return predict(docs, trees, "doc_id", held_out().alias("held_out"))


def accept(docs: DataFrame, least: float = 0.5, rows: int = SAMPLE) -> DataFrame:
    """Documents whose language is known: the shortest code has a share of `least`; the columns stay as they are."""
    trees = train(docs.where(~held_out()), rows)
    judged = predict(docs, trees, *docs.columns)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
