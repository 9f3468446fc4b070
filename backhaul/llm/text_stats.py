"""Numbers that describe how a text is made, whatever its language, a batch of texts at a time.

Everything is sums over characters, words and lines, so a text of any length is taken in
pieces and its sums are added up; of its words and lines only 64-bit hashes are held. Pieces
end at the end of a line, or where half a million characters have none, of a word; only a line
that long counts as two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from .words import LETTER, NUMBER, SPACE, kinds

PIECE = 1_000_000  # characters that are taken at once
NAMES = [
    "log_chars", "letters", "capitals", "digits", "symbols", "white", "symbol_runs",
    "word_length", "word_spread", "short_words", "long_words", "capital_words", "bare_symbols",
    "symbol_ends", "symbol_tails", "sentence_ends", "words_a_line", "adjacent_repeats",
    "different_words", "different_pairs", "commonest_word", "different_lines",
]


@functools.cache
def _capitals() -> np.ndarray:
    return np.array([chr(c).isupper() for c in range(0x20000)] + [False] * (0x110000 - 0x20000))


@functools.cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(text, piece) up to PIECE characters at a time; a longer text is cut behind a line or a word."""
    of, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                end = text.rfind("\n", at + PIECE // 2, end) + 1 or text.rfind(" ", at + PIECE // 2, end) + 1 or end
            if held and size + end - at > PIECE:
                yield np.array(of), held
                of, held, size = [], [], 0
            of.append(i)
            held.append(text[at:end])
            size += end - at
            at = end
    if held:
        yield np.array(of), held


def _runs(inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of runs that ``inside`` marks; a run ends at a piece's end."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] |= inside[first]
    return np.flatnonzero(start)


def _hashes(codes: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run, of its own characters and their order."""
    lengths = np.diff(np.append(starts, codes.size))
    place = np.arange(starts[0], codes.size) - np.repeat(starts, lengths)
    parts = (codes[starts[0] :].astype(np.uint64) + np.uint64(1)) * _powers()[place & 4095]
    parts[~inside[starts[0] :]] = 0
    return np.add.reduceat(parts, starts - starts[0])


def _different(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of different values, and how often its most frequent one stands there."""
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.append(True, (of[1:] != of[:-1]) | (values[1:] != values[:-1])) if of.size else np.zeros(0, bool)
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of[at], np.diff(np.append(at, of.size)))
    return np.bincount(of[at], minlength=n), most


def text_stats(texts: list[str]) -> np.ndarray:
    """A row of NAMES per text; all zeros for an empty one."""
    n = len(texts)
    sums: dict[str, np.ndarray] = {}

    def add(name: str, of: np.ndarray, values: np.ndarray) -> None:
        sums[name] = sums.get(name, np.zeros(n)) + np.bincount(of, values, n)

    words_of, words, lines_of, lines = [], [], [], []
    for of, parts in _pieces(texts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(lengths) - lengths
        kind = kinds()[codes]
        space, letter, number = kind == SPACE, kind == LETTER, kind == NUMBER
        symbol = ~(space | letter | number)
        capital = _capitals()[codes]
        same = np.append(False, codes[1:] == codes[:-1]) & symbol
        same[first] = False
        for name, marks in (("chars", None), ("letters", letter), ("capitals", capital), ("digits", number), ("symbols", symbol), ("white", space), ("symbol_runs", same)):
            add(name, of, lengths if marks is None else np.add.reduceat(marks, first, dtype=np.int64))
        broken = codes == 0x0A
        starts = _runs(~broken, first)
        if starts.size:
            own = of[np.searchsorted(first, starts, side="right") - 1]
            add("lines", own, np.ones(starts.size))
            lines_of.append(own)
            lines.append(_hashes(codes, ~broken, starts))
        starts = _runs(~space, first)
        if not starts.size:
            continue
        own = of[np.searchsorted(first, starts, side="right") - 1]
        solid = np.add.reduceat(~space, starts, dtype=np.int64)
        signs = np.add.reduceat(symbol, starts, dtype=np.int64)
        letters = np.add.reduceat(letter, starts, dtype=np.int64)
        large = np.add.reduceat(capital, starts, dtype=np.int64)
        last = starts + solid - 1
        ends = symbol[last]
        tails = ends & (solid > 1) & symbol[np.maximum(last - 1, 0)]
        sentence = np.isin(codes[last], [ord(c) for c in ".!?。！？"])
        for name, values in (
            ("words", np.ones(starts.size)), ("length", solid), ("squares", solid * solid), ("short", solid <= 3), ("long", solid > 12),
            ("capital_words", (letters > 1) & (large == letters)), ("bare", signs == solid), ("ends", ends), ("tails", tails), ("sentence", sentence),
        ):
            add(name, own, values)
        words_of.append(own)
        words.append(_hashes(codes, ~space, starts))

    def found(name: str) -> np.ndarray:
        return sums.get(name, np.zeros(n))

    def share(part: str | np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (found(part) if isinstance(part, str) else part) / np.maximum(whole, 1)

    chars, count, rows = found("chars"), found("words"), found("lines")
    of = np.concatenate([np.zeros(0, np.int64), *words_of]).astype(np.int64)
    values = np.concatenate([np.zeros(0, np.uint64), *words])
    together = of[1:] == of[:-1]
    adjacent = np.bincount(of[1:][together & (values[1:] == values[:-1])], minlength=n)
    pairs = (values[1:] * np.uint64(0x9E3779B97F4A7C15) + values[:-1])[together]
    different, most = _different(of, values, n)
    different_pairs, _ = _different(of[1:][together], pairs, n)
    in_lines = np.concatenate([np.zeros(0, np.int64), *lines_of]).astype(np.int64)
    different_lines, _ = _different(in_lines, np.concatenate([np.zeros(0, np.uint64), *lines]), n)
    mean = share("length", count)
    spread = np.sqrt(np.maximum(share("squares", count) - mean * mean, 0))
    columns = [
        np.log1p(chars), share("letters", chars), share("capitals", found("letters")), share("digits", chars), share("symbols", chars),
        share("white", chars), share("symbol_runs", chars), mean, spread, share("short", count), share("long", count),
        share("capital_words", count), share("bare", count), share("ends", count), share("tails", count), share("sentence", count),
        np.log1p(share(count, rows)), share(adjacent, count), share(np.log1p(different), np.log1p(count)),
        share(different_pairs, count - 1), share(most, count), share(different_lines, rows),
    ]
    return np.stack(columns, axis=1).astype(np.float32)
