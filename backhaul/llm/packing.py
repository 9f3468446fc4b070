"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (attention within
the piece); that of a sequence is the sum of its pieces. Documents are cut into whole
sequences and a rest. The rests of a block of documents are assigned in descending
order, each to the sequence of lowest cost that still has room; a rest that fits nowhere
is cut to fill what room there is, again at the lowest cost first.

The sequences of a block hold exactly its tokens: as many of full capacity as possible,
and for the remainder sequences whose lengths are powers of two (which need no padding),
so there is no padding at all. A block is up to ``block`` consecutive rows of a task.
Memory is bounded by a block's rests, of less than a sequence each, and nothing is
shuffled. A task that runs again reads the same rows and gives the same sequences, as
long as ``docs`` is a table (the pipeline's stages read written tables).

Defined cases: a null text is the empty text, which is the end token alone. Repeated
rows are packed each on its own. A null doc_id is kept. An empty table has no sequences.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import byte_bpe
from .common import small_batches, table

CAPACITY = 1024
BLOCK = 4096
END_ID = 0
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)


def sequence_lengths(tokens: int, capacity: int) -> np.ndarray:
    """Full sequences, then powers of two that add up to the rest."""
    full, rest = divmod(tokens, capacity)
    tail = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([capacity] * full + tail, np.int64)


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, sequence, offset in it) of one block's items."""
    room = sequence_lengths(int(lengths.sum()), capacity)
    size = room.copy()
    cost = np.zeros(room.size)
    pieces = []

    def put(item: int, start: int, n: int, to: int) -> None:
        pieces.append((item, start, n, to, int(size[to] - room[to])))
        room[to] -= n
        cost[to] += linear * n + quadratic * n * n

    left_over = []
    for item in np.argsort(-lengths, kind="stable"):
        n = int(lengths[item])
        fits = np.flatnonzero(room >= n)
        if fits.size:
            put(int(item), 0, n, int(fits[np.argmin(cost[fits])]))
        else:
            left_over.append(int(item))
    if left_over:
        gaps = iter(np.argsort(cost, kind="stable"))
        to = -1
        for item in left_over:
            start, n = 0, int(lengths[item])
            while start < n:
                while to < 0 or room[to] == 0:
                    to = int(next(gaps))
                take = min(n - start, int(room[to]))
                put(item, start, take, to)
                start += take
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    block: int = BLOCK,
    linear: float = 1.0,
    quadratic: float = 1.0 / CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), see SCHEMA; ``with_ids`` adds the token ids."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        base = TaskContext.get().partitionId() << 40
        made = 0
        rests: list[tuple] = []  # doc_id, start, ids, doc_tokens

        def row(doc, start, ids, total, sequence, offset):
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            return (doc, start, len(ids), crc, total, base + sequence, offset, *([ids] if with_ids else []))

        def frame(rows):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, pa.int64()) for c in zip(*(r[:7] for r in rows))]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

        def flush():
            nonlocal made
            lengths = np.array([len(r[2]) for r in rests], np.int64)
            rows = []
            for item, start, n, to, offset in balance(lengths, capacity, linear, quadratic):
                doc, at, ids, total = rests[item]
                rows.append(row(doc, at + start, ids[start : start + n], total, made + to, offset))
            made += sequence_lengths(int(lengths.sum()), capacity).size
            rests.clear()
            return frame(rows)

        for batch in frames:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names = batch.column(0).to_pylist()
            for i in range(0, len(texts), 512):
                ids, bounds = encoder.encode(texts[i : i + 512])
                rows = []
                for k, doc in enumerate(names[i : i + 512]):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID))
                    whole = len(own) // capacity * capacity
                    for at in range(0, whole, capacity):
                        rows.append(row(doc, at, own[at : at + capacity], len(own), made, 0))
                        made += 1
                    if whole < len(own):
                        rests.append((doc, whole, own[whole:].copy(), len(own)))
                if rows:
                    yield frame(rows)
                if len(rests) >= block:
                    yield flush()
        if rests:
            yield flush()

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return small_batches(docs.select("doc_id", "text")).mapInArrow(work, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
