"""Token ids of whole texts under a byte-level BPE vocabulary, a batch of texts at a time."""

from __future__ import annotations

import base64
import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .words import batches, has_unknown, split

MAX_WORDS = 1 << 18
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids as the file's library gives them, without adding special tokens.

    Every different word is encoded once and remembered (up to MAX_WORDS, then the
    memory starts anew). Texts with a special token's string, or with code points that
    this Python does not know, go through the library whole.
    """

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):  # ranks alone: no special tokens, and no library but this one
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(word): int(i) for word, i in map(bytes.split, lines)}
            self.special = []
        else:
            with open(path) as file:
                spec = json.load(file)
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
            halves = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
            merged = [ranks[bytes(letters[c] for c in a + b)] for a, b in halves]
            if merged != sorted(merged):
                raise ValueError("ids have to follow the order of the merges")
            self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self._empty()

    @functools.cached_property
    def _library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def _whole(self, text: str) -> list[int]:
        if self.path.endswith(".tiktoken"):
            return self.words.encode_ordinary(text)
        return self._library.encode(text, add_special_tokens=False).ids

    def _empty(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.counts = array("I"), array("q"), array("q")

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) + len(words) > MAX_WORDS:
            self._empty()
        slot = self.slot
        for word in words:
            if word not in slot:
                ids = self.words.encode_ordinary(word)
                slot[word] = len(self.starts)
                self.starts.append(len(self.ids))
                self.counts.append(len(ids))
                self.ids.extend(ids)
        return np.fromiter(map(slot.__getitem__, words), np.int64, len(words))

    def _odd(self, text: str) -> bool:
        return any(s in text for s in self.special) or has_unknown(text)

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, dict[int, list[int]], np.ndarray, np.ndarray]]:
        """By batches: number of texts, ids of odd texts, slots of all pieces, bounds of the texts' pieces."""
        for part in batches(texts):
            found = texts[part]
            odd = {i: self._whole(t) for i, t in enumerate(found) if self._odd(t)}
            pieces = split(["" if i in odd else t for i, t in enumerate(found)], spaces_join=True)
            slots = self._slots(pieces.words)
            yield len(found), odd, slots[pieces.index] if len(slots) else slots, pieces.bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text t has ids[bounds[t]:bounds[t + 1]]."""
        each = []
        for n, odd, slots, bounds in self._parts(texts):
            counts = np.frombuffer(self.counts, np.int64)[slots]
            upto = np.concatenate([[0], np.cumsum(counts)])
            begin = np.frombuffer(self.starts, np.int64)[slots] - upto[:-1]
            ids = np.frombuffer(self.ids, np.uint32)[np.repeat(begin, counts) + np.arange(upto[-1])]
            own = [ids[a:b] for a, b in zip(upto[bounds[:-1]], upto[bounds[1:]])]
            for i, whole in odd.items():
                own[i] = np.array(whole, np.uint32)
            each += own
        bounds = np.cumsum([0, *map(len, each)])
        return np.concatenate([np.zeros(0, np.uint32), *each]), bounds

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text, without making them."""
        each = []
        for _, odd, slots, bounds in self._parts(texts):
            upto = np.concatenate([[0], np.cumsum(np.frombuffer(self.counts, np.int64)[slots])])
            own = np.diff(upto[bounds])
            for i, whole in odd.items():
                own[i] = len(whole)
            each.append(own)
        return np.concatenate([np.zeros(0, np.int64), *each])


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)
