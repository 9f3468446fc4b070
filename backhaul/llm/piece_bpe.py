"""Token ids of whole texts under a sentencepiece BPE vocabulary, a batch of texts at a time."""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece

MAX_WORDS = 1 << 18
LONG = 100  # bytes of a word above which it is not remembered
MARK = "▁"  # stands for a space


class PieceBpe:
    """Ids as the library gives them for a text, which it puts a space before.

    No piece has a space behind anything else, so no merge crosses the place before a run of
    spaces: texts are cut there, and every different word is encoded once and remembered (up to
    MAX_WORDS and 16 ids for each, then the memory starts anew). With a vocabulary for which that does not hold,
    texts are encoded whole.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = self.model.piece_to_id(MARK)
        plain = self.model.encode("a  b", out_type=str)
        self.by_words = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and not self.model.is_unknown(self.space)
            and "".join(plain).replace(MARK, " ") == " a  b"  # spaces are kept, and one is put before
        )
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts, self.counts = array("I"), array("q"), array("q")

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that begin with a space: the library puts that one there itself."""
        found = self.model.encode([w[1:] for w in words], num_threads=1) if words else []
        return [[self.space] if w == " " else ids for w, ids in zip(words, found)]

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self.starts) + len(words) > MAX_WORDS or len(self.ids) > 16 * MAX_WORDS:
            self._empty()
        new = [w for w in words if w not in self.slot]
        for word, ids in zip(new, self._words(new)):
            self.slot[word] = len(self.starts)
            self.starts.append(len(self.ids))
            self.counts.append(len(ids))
            self.ids.extend(ids)
        found = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > LONG:  # its ids stay until the memory starts anew, its text does not
                del self.slot[word]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text t has ids[bounds[t]:bounds[t + 1]]. Texts are not empty."""
        marked = [t for t in texts if MARK in t] if self.by_words else texts
        if marked:  # the sign for a space in a text is one to the library, so words end elsewhere
            whole = iter(self.model.encode(marked, num_threads=1))
            ids, bounds = self.encode([t for t in texts if MARK not in t]) if self.by_words else (np.zeros(0, np.int64), [0])
            plain = iter(ids[x:y] for x, y in zip(bounds, bounds[1:]))
            each = [np.array(next(whole), np.int64) if not self.by_words or MARK in t else next(plain) for t in texts]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        if not texts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data = [b" " + t.encode() for t in texts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        whole = b"".join(data)
        blank = np.frombuffer(whole, np.uint8) == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        begins = np.cumsum(lengths) - lengths
        start[begins] = True
        at = np.flatnonzero(start)
        offsets = np.append(at, len(whole)).astype(np.int32)
        numbered = pa.StringArray.from_buffers(at.size, pa.py_buffer(offsets), pa.py_buffer(whole)).dictionary_encode()
        slots = self._slots(numbered.dictionary.to_pylist())[numbered.indices.to_numpy(zero_copy_only=False)]
        counts = np.frombuffer(self.counts, np.int64)[slots]
        upto = np.concatenate([[0], np.cumsum(counts)])
        shift = np.frombuffer(self.starts, np.int64)[slots] - upto[:-1]
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(shift, counts) + np.arange(upto[-1])]
        return ids.astype(np.int64), upto[np.append(np.searchsorted(at, begins), at.size)]


@functools.cache
def piece_bpe(path: str) -> PieceBpe:
    """One per Python worker."""
    return PieceBpe(path)
