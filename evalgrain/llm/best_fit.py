"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Method: bulk-synchronous best fit. Documents and gaps are ordered by size; in each superstep a sweep over the sizes
gives every document the smallest gap that holds it, documents that ask for the same gaps are served by rank, gaps
shrink, and the sweep repeats on what is left. Documents of one length are interchangeable and so are gaps of one size,
so a superstep works on two histograms of `capacity` counters, however many documents there are. It yields runs
("documents of length L with ranks a to b go to sequences s, s+1, ... at offset o"); ranks are computed by Spark and the
runs are applied to the rows in parallel.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evalgrain.llm.common import map_batches, materialize, whole_text

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
# Distinct pre-tokens whose ids a task remembers before it starts afresh; only speed depends on it.
MEMORY = 400_000


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> id of a byte-level BPE file, whose ids follow the order of its merges."""
    from tokenizers import Tokenizer

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if set(token) <= byte.keys()}


def added_tokens(path: str) -> dict[str, bytes]:
    """String of each added token of the file -> its id as little-endian uint32 bytes."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} is not matched as it stands")
    return {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    A byte-level BPE first cuts a text by a fixed pattern and encodes each part by itself. Where all white space is
    single spaces and line ends, the pattern cuts before each of them, so the ids of units (" word," or "\\nWord") are
    remembered. A text's unknown units are encoded in one call; a new one begins where a token begins with white space.
    With `added`, texts are first split at the file's added tokens, which get their own ids, as the tokenizers library
    does by default; without it such strings are ordinary text (its encode_special_tokens). The merges run in tiktoken on
    the vocabulary of the file; the tests hold the ids against those of the library.
    """

    def __init__(self, path: str, added: bool = False):
        import public_tokenizers
        import tiktoken

        ranks = byte_ranks(path)
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks=ranks).encode_ordinary
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[i for token, i in ranks.items() if token[:1] in (b" ", b"\n")]] = True
        self.units: dict[str, bytes] = {}
        self.added = added_tokens(path) if added else {}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def learn(self, units: list[str]) -> None:
        ids = np.array(self.encode("".join(units)), "<u4")
        starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
        raw = ids.tobytes()
        self.units.update(zip(units, [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])], strict=True))

    def __call__(self, text: str) -> bytes:
        if not self.cut:
            return self.plain(text)
        return b"".join([self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.cut.split(text))])

    def plain(self, text: str) -> bytes:
        if " ".join(text.split()) != text.replace("\n", " "):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *units = text.replace(" ", "\r ").replace("\n", "\r\n").split("\r")
        if len(self.units) > MEMORY:
            self.units.clear()
        known = self.units
        if new := list(dict.fromkeys([u for u in units if u not in known])):
            self.learn(new)
        return np.array(self.encode(first), "<u4").tobytes() + b"".join([known[u] for u in units])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, added: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, part, rank).

    A document is its token ids and `end_id`. A longer one than `capacity` is cut so that only its first piece is
    shorter. `rank` counts pieces of one length inside the task `part` that made them; both are fixed once written.
    """
    def run(batches):
        encode, part, seen = Encoder(path, added), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"), (
                            doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]), part, seen[b - a])):
                        out[name].append(value)
                    seen[b - a] += 1
            if out:
                yield out

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", whole_text().alias("text")), run,
                       f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that pack `lengths` (length -> number of pieces).

    A superstep per length, longest first. Its sweep looks for the successor among the gaps, the smallest one that
    holds the length, and fills all gaps of that size or as many as there are pieces, by rank; the gaps shrink and the
    sweep repeats. If no gap holds the length, just as many sequences are opened as the pieces left need.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> (first sequence, number of sequences)
    there = np.zeros(capacity + 1, dtype=bool)
    runs, sequences = [], 0
    for length in sorted((n for n, c in lengths.items() if c), reverse=True):
        rank, left = 0, lengths[length]
        while left:
            gap = length + int(there[length:].argmax())
            if not there[gap]:
                gap, count = capacity, -(-left // (capacity // length))
                gaps[gap].append((sequences, count))
                sequences += count
            first, size = gaps[gap].pop()
            count = min(size, left)
            runs.append((length, rank, count, first, capacity - gap))
            if size > count:
                gaps[gap].append((first + count, size - count))
            gaps[gap - length].append((first, count))
            there[gap], there[gap - length] = bool(gaps[gap]), gap > length
            rank, left = rank + count, left - count
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
         added: bool = False) -> DataFrame:
    """Pack documents (doc_id, text): (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    `added`: strings of the tokenizer's added tokens in a text are these tokens, as in the tokenizers library by default.
    Null text: empty, one piece with the end id alone. Repeated rows are packed each for itself. Null ids stay null.
    Empty table: no rows. Other columns are ignored. Sequence ids are arbitrary; offsets in a sequence leave no gap.
    """
    path = path or tokenizer_path(TOKENIZER)
    rows = materialize(pieces(docs, path, capacity, end_id, added), "pieces")
    counts = materialize(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    # At most `capacity` rows reach the driver.
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    placed = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)

    def run(batches):
        # One searchable number per (length, rank); a rank stays below 2**48.
        keys = (placed[:, 0] << 48) + placed[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            rank = rank + batch.column("before").to_numpy(zero_copy_only=False)
            at = placed[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            yield {**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                   "sequence_id": at[:, 3] + rank - at[:, 1], "offset": at[:, 4]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(rows.join(before, ["length", "part"]), run,
                       f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                       "sequence_id bigint, offset bigint")
