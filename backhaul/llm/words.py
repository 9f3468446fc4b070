"""Splitting texts into the pieces tokenizers work on, a batch of texts at a time.

Both public tokenizers here cut at changes between letters, numbers, white space and
everything else, apart from English contractions and the space before a word. Cutting
a batch is arithmetic on arrays of code points. Its pieces are then numbered, so that
whatever is done for a piece is done once for each different piece.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# Unicode's White_Space
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def kinds() -> np.ndarray:
    """Kind of every code point; unknown where this Python's Unicode has no entry, and beyond plane 3."""
    by_category = {"L": LETTER, "N": NUMBER}
    found = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
    for code in range(0x33500):  # what comes after is private, tags or not assigned
        category = unicodedata.category(chr(code))
        found[code] = UNKNOWN if category == "Cn" else by_category.get(category[0], OTHER)
    found[WHITE_SPACE] = SPACE
    return found


@dataclass
class Pieces:
    """``index`` numbers the pieces of all texts in order, text t has those from bounds[t] to bounds[t + 1]."""

    words: list[str]
    index: np.ndarray
    bounds: np.ndarray


def _contractions(codes: np.ndarray, start: np.ndarray, ends: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll at the start of a piece are pieces."""
    at = np.flatnonzero((codes == ord("'")) & start)
    if not at.size:
        return
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    end = ends[np.searchsorted(ends, at, side="right")]
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(x) for x in "stmd"]) & (at + 1 < end)
    long = np.zeros(at.size, bool)
    for pair in ("re", "ve", "ll"):
        long |= (one == ord(pair[0])) & (two == ord(pair[1]))
    long &= at + 2 < end
    for hit, length in ((short, 2), (long & ~short, 3)):
        p = at[hit]
        start[p + 1] = False
        if length == 3:
            start[p + 2] = False
        after = p + length
        start[after[after < codes.size]] = True


def split(texts: list[str], spaces_join: bool) -> Pieces:
    """Pieces of each text. ``spaces_join``: a space joins the word after it, and other white
    space is kept; otherwise white space is dropped and every number is a piece of its own."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    data = whole.encode()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = codes.size
    if not n:
        return Pieces([], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    kind = kinds()[codes]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = (ends - lengths)[lengths > 0]
    start[first] = True
    if spaces_join:
        last_white = np.zeros(n, bool)
        last_white[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE)
        last_white[ends[lengths > 0] - 1] = False
        start |= last_white
        joined = np.flatnonzero(last_white & (codes == 0x20)) + 1
        start[joined] = False
    else:
        start |= kind == NUMBER
    _contractions(codes, start, ends)
    start[first] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(data)).astype(np.int32)
    if len(data) > n:  # positions of code points become positions of bytes
        more = (codes >= 0x80).view(np.uint8)
        if codes.max() >= 0x800:
            more = more + (codes >= 0x800) + (codes >= 0x10000)
        offsets[:-1] += np.cumsum(more, dtype=np.int32)[at] - more[at]
    pieces = pa.StringArray.from_buffers(at.size, pa.py_buffer(offsets), pa.py_buffer(data))
    starts_of_texts = np.concatenate([[0], ends])
    if not spaces_join:
        solid = kind[at] != SPACE
        pieces = pieces.filter(pa.array(solid))
        at = at[solid]
    numbered = pieces.dictionary_encode()
    bounds = np.searchsorted(at, starts_of_texts)
    return Pieces(numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False), bounds)


def has_unknown(text: str) -> bool:
    return not text.isascii() and bool((kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any())


def batches(texts: list[str], chars: int = 4_000_000) -> list[slice]:
    """Slices of about this many characters; a longer text is a slice of its own."""
    found, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            found.append(slice(begin, i))
            begin, held = i, 0
        held += len(text)
    return [*found, slice(begin, len(texts))] if texts else []
