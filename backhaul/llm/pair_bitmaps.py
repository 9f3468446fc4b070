"""Compressed sets of documents, a batch of rows at a time.

Documents have 64-bit numbers. A row is about one pair of token ids and one chunk of 2^16
document numbers, and has a list of sets of numbers within the chunk: the documents that
have the pair, then one set per binary digit of how often more than once they have it. A
set of fewer than 4096 numbers is their sorted list, 2 bytes each; a larger one is a bitmap
of 8 kB. No set is larger than that, however common a pair is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BITS = 16
SPARSE = 4096
BITMAP = (1 << CHUNK_BITS) // 8
PLANE_BITS = 5


def encode(row: np.ndarray, plane: np.ndarray, low: np.ndarray, planes: np.ndarray) -> pa.ListArray:
    """Sets as a list per row, of numbers ``low`` in sets ``plane``; row r has planes[r] of them."""
    keys = np.unique((row << (PLANE_BITS + CHUNK_BITS)) | (plane << CHUNK_BITS) | low)
    low = (keys & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
    bounds = np.concatenate([[0], np.cumsum(planes)])
    of = bounds[keys >> (PLANE_BITS + CHUNK_BITS)] + (keys >> CHUNK_BITS & ((1 << PLANE_BITS) - 1))
    counts = np.bincount(of, minlength=bounds[-1])
    sparse = counts < SPARSE
    begin = np.concatenate([[0], np.cumsum(np.where(sparse, counts, BITMAP // 2))])
    first = np.cumsum(counts) - counts
    out = np.zeros(begin[-1], np.uint16)
    listed = sparse[of]
    out[(begin[of] - first[of] + np.arange(of.size))[listed]] = low[listed]
    for c in np.flatnonzero(~sparse):
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[low[first[c] : first[c] + counts[c]]] = 1
        out[begin[c] : begin[c + 1]] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = pa.py_buffer((begin * 2).astype(np.int32))
    sets = pa.Array.from_buffers(pa.binary(), int(bounds[-1]), [None, offsets, pa.py_buffer(out)])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), sets)


class Sets:
    """The sets of a column as ``encode`` makes it."""

    def __init__(self, column: pa.ListArray):
        self.planes = np.diff(column.offsets.to_numpy())
        values = column.flatten()
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = values.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.offsets, self.lengths = offsets, np.diff(offsets)
        self.row = np.repeat(np.arange(self.planes.size), self.planes)
        self.plane = np.arange(self.row.size) - (np.cumsum(self.planes) - self.planes)[self.row]

    def sizes(self) -> np.ndarray:
        """Numbers in each set."""
        found = self.lengths // 2
        for c in np.flatnonzero(self.lengths == BITMAP):
            found[c] = int(np.bitwise_count(self.data[self.offsets[c] : self.offsets[c + 1]]).sum())
        return found

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: documents that have the pair, and how often they have it together."""
        sizes = self.sizes()
        weight = self.weights()
        links = np.zeros(self.planes.size, np.int64)
        np.add.at(links, self.row, sizes * weight)
        return sizes[np.cumsum(self.planes) - self.planes], links

    def weights(self) -> np.ndarray:
        """What a document's place in a set counts: 1 for having the pair, then the values of the digits."""
        return np.where(self.plane == 0, 1, np.int64(1) << np.maximum(self.plane - 1, 0))

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(set, number) of all numbers in all sets."""
        dense = self.lengths == BITMAP
        begin, end = int(self.offsets[0]), int(self.offsets[-1])
        counts = self.lengths // 2
        of = np.repeat(np.arange(counts.size), counts)
        low = np.frombuffer(self.data[begin:end].tobytes(), np.uint16).astype(np.int64)
        if not dense.any():
            return of, low
        keep = ~dense[of]
        parts, numbers = [of[keep]], [low[keep]]
        for c in np.flatnonzero(dense):
            bits = np.unpackbits(self.data[self.offsets[c] : self.offsets[c + 1]], bitorder="little")
            numbers.append(np.flatnonzero(bits))
            parts.append(np.full(numbers[-1].size, c))
        return np.concatenate(parts), np.concatenate(numbers)


def merge(column: pa.ListArray, group: np.ndarray) -> pa.ListArray:
    """One row per group (rising numbers from 0): every set is the union of its rows' sets."""
    sets = Sets(column)
    of, low = sets.members()
    planes = np.zeros(int(group[-1]) + 1, np.int64)
    np.maximum.at(planes, group, sets.planes)
    return encode(group[sets.row[of]], sets.plane[of], low, planes)
