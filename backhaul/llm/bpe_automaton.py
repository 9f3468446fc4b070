"""BPE by a deterministic automaton over tokens, compiled one merge after the other.

The automaton accepts exactly the token sequences that BPE produces. It begins as one
state with a loop for every base symbol, which accepts a word's symbols as they stand.
The gadget of the merge a b -> c changes it so that a followed by b becomes c:

* all a-arcs are led to a copy of their target that has no b-arc;
* wherever an a-arc leaves, a c-arc is added, to where a and then b led before;
* for a = b the copy gets neither an a-arc nor a c-arc (three a are c a, never a c).

At any time all arcs of one label lead to the same state, so a transition table has one
target per token, plus the question whether a state has an arc of that label. A copy
differs from its original by the arcs it lost, and both get later arcs by the same rule
(a c-arc where there is an a-arc), so a state is stored as (original, when copied, arcs
lost). Table entries are worked out from that when first needed and kept, as the whole
table would have billions.

Encoding a word walks the automaton over its symbols: at a position, the tokens of a trie
that the state has arcs for, the longest first, going back where no way on is left. The
automaton is unambiguous, so a position is entered in one state only, and each is left
for good after its tokens were tried once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .byte_bpe import byte_letters
from .common import small_batches, table
from .words import Pieces, batches, has_unknown, split

MAX_WORDS = 3 << 17
MAX_ARCS = 1 << 21
START = 0


class MergeAutomaton:
    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: int):
        """``base``: ids of symbols; ``merges``: (a, b, c) in order; ``size``: number of ids."""
        self.target = [START] * size  # state that a token's arcs lead to
        self.left = [-1] * size  # first half of a merged token
        self.made = [-1] * size  # the merge that made it
        self.original, self.copied, self.lost = [START], [-1], [()]
        self.known = [False] * size
        for token in base:
            self.known[token] = True
        for when, (a, b, c) in enumerate(merges):
            if self.known[c]:
                raise ValueError("every merge has to make a new token")
            self.known[c], self.left[c], self.made[c] = True, a, when
            before = self.target[a]
            self.original.append(before)
            self.copied.append(when)
            self.lost.append((a, c) if a == b else (b,))
            self.target[c] = before if a == b else self.target[b]
            self.target[a] = len(self.original) - 1
        self.size = size
        self.arcs: dict[int, int] = {}
        self._number_copies()

    def _number_copies(self) -> None:
        """Copies form a tree. Intervals of a preorder tell who descends from whom, and
        ``jump`` (to some ancestor further up) finds an ancestor in logarithmic time."""
        n = len(self.original)
        below = [1] * n
        for s in range(n - 1, 0, -1):
            below[self.original[s]] += below[s]
        self.enter, free = [0] * n, [1] * n
        depth, self.jump = [0] * n, [0] * n
        for s in range(1, n):
            p = self.original[s]
            self.enter[s] = free[p]
            free[s] = free[p] + 1
            free[p] += below[s]
            depth[s] = depth[p] + 1
            up = self.jump[p]
            even = depth[p] - depth[up] == depth[up] - depth[self.jump[up]]
            self.jump[s] = self.jump[up] if even else p
        losses: dict[int, list[tuple[int, int]]] = {}
        for s in range(1, n):
            for token in self.lost[s]:
                losses.setdefault(token, []).append((self.enter[s], self.enter[s] + below[s]))
        # No state loses an arc twice, so the intervals of one token's losers are disjoint
        self.losers = {token: tuple(zip(*sorted(spans))) for token, spans in losses.items()}

    def step(self, state: int, token: int) -> int:
        """State after ``token``, or -1 without such an arc."""
        key = state * self.size + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > MAX_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self.target[token] if self._has_arc(state, token) else -1
        return found

    def _has_arc(self, state: int, token: int) -> bool:
        while True:
            if spans := self.losers.get(token):
                k = bisect_right(spans[0], self.enter[state]) - 1
                if k >= 0 and self.enter[state] < spans[1][k]:
                    return False  # lost by this state or one it is a copy of
            when = self.made[token]
            if when < 0:
                return True
            # The arc was added where there was one of its first half, when the merge was made
            while self.copied[state] > when:
                up = self.jump[state]
                state = up if self.copied[up] > when else self.original[state]
            token = self.left[token]


class WordBpe:
    """Encodes as the tokenizers library does with this kind of file: NFC, lower case,
    words, bytes, BPE whose last symbol carries an end-of-word mark; no decoder, so
    decoding joins tokens by a space."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path))
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a.removesuffix(end) + b if a.endswith(end) else a + b]) for a, b in pairs]
        made = {c for _, _, c in merges}
        base = {i: word for word, i in vocab.items() if i not in made}
        self.size = max(vocab.values()) + 1
        self.automaton = MergeAutomaton(list(base), merges, self.size)
        self.label = [""] * self.size
        for word, i in vocab.items():
            self.label[i] = word
        letters = byte_letters()
        inner = {word: b for word, b in letters.items()}
        self.trie: dict[int, int] = {}
        self.at: list[int] = [-1]
        for word, i in vocab.items():
            final = word.endswith(end)
            symbols = [inner[x] for x in (word.removesuffix(end) if final else word)]
            if final:
                symbols[-1] += 256
            node = 0
            for symbol in symbols:
                key = node * 512 + symbol
                if key not in self.trie:
                    self.trie[key] = len(self.at)
                    self.at.append(-1)
                node = self.trie[key]
            self.at[node] = i
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[str, int] = {}
        self.counts: list[int] = []
        self.id_text: list[str] = []
        self.token_text: list[str] = []

    def encode_word(self, word: str) -> list[int]:
        symbols = list(word.encode())
        symbols[-1] += 256
        n, trie, at, size = len(symbols), self.trie, self.at, self.size
        arcs, step = self.automaton.arcs, self.automaton.step
        tried: list[list[tuple[int, int]] | None] = [None] * (n + 1)
        path, i, state = [], 0, START
        while i < n:
            open_ = tried[i]
            if open_ is None:  # reached for the first time, and by the unambiguity never from elsewhere
                open_, node = [], 0
                for j in range(i, n):
                    node = trie.get(node * 512 + symbols[j], -1)
                    if node < 0:
                        break
                    if at[node] >= 0:
                        open_.append((j + 1, at[node]))
                tried[i] = open_
            while open_:
                end, token = open_.pop()  # the longest that was not tried
                to = arcs.get(state * size + token)
                if to is None:
                    to = step(state, token)
                if to >= 0 and (end == n or tried[end] is None):
                    path.append((i, state, token))
                    i, state = end, to
                    break
            else:
                i, state, _ = path.pop()
        return [token for _, _, token in path]

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) + len(words) > MAX_WORDS:
            self._empty()
        slot = self.slot
        for word in words:
            if word not in slot:
                ids = self.encode_word(word)
                slot[word] = len(self.counts)
                self.counts.append(len(ids))
                self.id_text.append(" ".join(map(str, ids)))
                self.token_text.append(" ".join([self.label[i] for i in ids]))
        return np.fromiter(map(slot.__getitem__, words), np.int64, len(words))

    def _odd(self, text: str) -> bool:
        return any(s in text for s in self.special) or has_unknown(text)

    def _plain(self, text: str) -> str:
        # lower() looks at what surrounds a capital sigma, the library does not
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_and_decode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text."""
        for part in batches(texts):
            found = texts[part]
            odd = {i for i, t in enumerate(found) if self._odd(t)}
            pieces = split(["" if i in odd else self._plain(t) for i, t in enumerate(found)], spaces_join=False)
            slots = self._slots(pieces.words)
            counts = np.array(self.counts, np.int64)[slots][pieces.index] if len(slots) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(counts)])
            n_tokens = np.diff(upto[pieces.bounds])
            joined = [self._joined([kept[s] for s in slots], pieces) for kept in (self.id_text, self.token_text)]
            for i, text in enumerate(found):
                if i in odd:
                    yield self._by_parts(text)
                else:
                    yield int(n_tokens[i]), joined[0][i], joined[1][i]

    @staticmethod
    def _joined(of_words: list[str], pieces: Pieces) -> list[str]:
        """The texts of a batch's pieces, joined by a space within each text."""
        if pieces.index.size > 1 << 26:  # one enormous text: beyond Arrow's 32-bit offsets
            ends = zip(pieces.bounds[:-1], pieces.bounds[1:])
            return [" ".join([of_words[i] for i in pieces.index[a:b]]) for a, b in ends]
        each = pa.array(of_words, pa.string()).take(pa.array(pieces.index, pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array(pieces.bounds, pa.int32()), each)
        return pc.binary_join(lists, " ").to_pylist()

    def _by_parts(self, text: str) -> tuple[int, str, str]:
        """Text with special tokens or unknown code points: the library cuts the words, the automaton encodes them."""
        ids = []
        while text:
            at, special = min(((text.find(s), s) for s in self.special if s in text), default=(len(text), ""))
            part = self.library.normalizer.normalize_str(text[:at])
            letters = byte_letters()
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                ids += self.encode_word(bytes(letters[x] for x in word).decode())
            if special:
                ids.append(self.special[special])
            text = text[at + len(special) :]
        names = {i: s for s, i in self.special.items()}
        return len(ids), " ".join(map(str, ids)), " ".join([names.get(i) or self.label[i] for i in ids])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Nothing is shuffled; a worker holds a batch of about four million characters and a
    bounded memory of words. Defined cases: a null text is the empty text, which has no
    tokens and decodes to the empty text. Repeated rows and null ids stay. An empty
    table gives an empty result. Other columns are not read.
    """

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer)
        for batch in frames:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [
                (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for n, ids, decoded in encoder.encode_and_decode(texts)
            ]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return small_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(work, schema)


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
