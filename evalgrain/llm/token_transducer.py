"""Exact token counts by a compiled finite-state transducer.

Method: the byte-pair tokenizer is compiled into a deterministic transducer over characters. What later characters can
still change after a prefix is bounded by the vocabulary: a state holds, for every suffix of the prefix that some token
may continue, the last token before that suffix and the count there. A transition takes one character and emits the
change of the token count. States are built when a text first reaches them, as in a lazy automaton, and kept per task.

The transducer returns to its start state before every space that follows another character, so the map of a chunk of
text is: what its first partial word does to the state it is entered in, the tokens emitted between, and the partial
word it ends in. These maps compose associatively; a text is the composition of its chunks by a balanced scan.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import map_batches, whole_text

TOKENIZER = "piece_bpe_32k.model"
OVER = 4096
SPACE = "▁"
CHUNK = 1 << 16  # characters of a text that are read at once
# Entries that a task remembers before it starts afresh; only speed depends on them.
STATES, WORDS = 300_000, 400_000
Map = tuple[str, int, str | None]  # head, tokens between, tail (None: no boundary inside, all is head)


class Transducer:
    """Counts tokens of `▁`-started words for a vocabulary of (piece, score), unknown characters as bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pieces = {p for p in scores if self.merge(p) == [p]}  # the others are never left standing
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    @classmethod
    def load(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def reset(self) -> None:
        start = (("", None, 0),)
        self.ids, self.states, self.moves = {start: 0}, [start], [{}]

    def merge(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union scores best, the leftmost first, until none is a piece."""
        get, none = self.scores.get, float("-inf")
        parts = list(text)
        unions = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while unions and (best := max(unions)) > none:
            i = unions.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del unions[i]
            if i:
                unions[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(unions):
                unions[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def stands(self, left: str | None, right: str) -> bool:
        """Whether two tokens next to each other stay as they are; tokens of a text do exactly if all neighbours do."""
        if left is None:
            return True
        if (left, right) not in self.pairs:
            self.pairs[left, right] = self.merge(left + right) == [left, right]
        return self.pairs[left, right]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Build the transition: next state, and by how much the count of the prefix changes."""
        entries = self.states[state]
        if char not in self.scores:  # nothing merges over it; each of its bytes is a token
            emitted, after = len(char.encode("utf-8", "replace")), (("", None, 0),)
        else:
            for suffix, before, count in entries:
                token, emitted = suffix + char, count + 1
                if token in self.pieces and self.stands(before, token):
                    break
            after = (*((suffix + char, before, count - emitted) for suffix, before, count in entries
                       if suffix + char in self.prefixes), ("", token, 0))
        if after not in self.ids:
            self.ids[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        move = self.moves[state][char] = self.ids[after], emitted
        return move

    def count(self, word: str) -> int:
        """Tokens of a word that starts in the start state."""
        if len(self.states) > STATES:
            self.reset()
        state = total = 0
        for char in word:
            move = self.moves[state].get(char) or self.step(state, char)
            state = move[0]
            total += move[1]
        return total


class Counter:
    """Maps of chunks and their composition, with the counts of frequent words remembered."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.known = transducer, {}
        self.opening = (SPACE, "\n", "")  # what a word given with its beginning can start with

    def word(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > WORDS:
                self.known.clear()
            got = self.known[word] = self.transducer.count(word if word[:1] in self.opening else SPACE + word)
        return got

    def chunk(self, text: str) -> Map:
        """The map of a chunk of normalized text (spaces are ▁). A boundary is a ▁ after another character."""
        first = re.search(f"(?<=[^{SPACE}]){SPACE}", text)
        if not first:
            return text, 0, None
        at = text.rindex(SPACE)
        while at and text[at - 1] == SPACE:
            at -= 1
        return text[:first.start()], self.body(text[first.start():at]), text[at:]

    def body(self, text: str) -> int:
        """Tokens of whole words, each with its spaces before it."""
        if SPACE * 2 in text or SPACE + "\n" in text or "\n" in self.transducer.scores:
            return sum(map(self.word, re.findall(f"{SPACE}+[^{SPACE}]*", text)))
        # No token reaches over a line end, so the start state is back there too.
        known, word = self.known, self.word
        words = text.replace("\n", SPACE + "\n").split(SPACE)
        return sum([known[w] if w in known else word(w) for w in words[1:]])

    def compose(self, left: Map, right: Map) -> Map:
        (h1, n1, t1), (h2, n2, t2) = left, right
        open_end = h1 if t1 is None else t1
        if open_end and open_end[-1] != SPACE and h2[:1] == SPACE:  # the seam is a boundary
            done = 0 if t1 is None else self.word(t1)
            if t2 is None:
                return h1, n1 + done, h2
            return h1, n1 + done + self.word(h2) + n2, t2
        joined = open_end + h2
        if t1 is None:
            return joined, n2, t2
        if t2 is None:
            return h1, n1, joined
        return h1, n1 + self.word(joined) + n2, t2

    def scan(self, maps: list[Map]) -> Map:
        """Compose neighbours pairwise until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)  # the library's only normalization
        head, count, tail = self.scan([self.chunk(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return self.word(head) + count + (self.word(tail) if tail else 0)


def token_counts(docs: DataFrame, path: str | None = None, over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, without begin, end or other special tokens.

    Null and empty text: no bytes, no tokens. Repeated rows and null ids: one row each. Other columns are ignored.
    """
    from evalgrain.llm.best_fit import tokenizer_path

    path = path or tokenizer_path(TOKENIZER)

    def run(batches):
        counter = Counter(Transducer.load(path))
        for batch in batches:
            out = defaultdict(list)
            out["n_tokens"] = [counter.text(x) for x in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **out,
                   "over_limit": [n > over for n in out["n_tokens"]]}

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", whole_text().alias("text"),
                        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"))
    return map_batches(texts, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
