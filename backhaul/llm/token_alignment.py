"""Which tokens of two vocabularies stand for the same bytes, over a corpus.

Both tokenizations cut a text's bytes. A token of one and a token of the other are linked
where their byte ranges overlap; byte offsets where tokens of both end cut the links into
groups. For every pair of ids the corpus gives the number of documents that link it and the
number of links, and those numbers give each document a score.

The index is inverted: a task encodes its documents and holds, per pair, the documents that
have it as a compressed bitmap, with one more bitmap per binary digit of how often more than
once they have it (``pair_bitmaps``). Bitmaps are of chunks of 65,536 document numbers. The
pieces of a (pair, chunk) from several tasks are OR-merged and popcounted; the counts, one row
per pair and chunk, are summed. The merged postings then take the pairs' counts back: each
chunk's postings run through one array of a number per document.

No row is larger than a chunk's bitmaps, so a pair that every document has is many rows, of
which each task holds one at a time; postings of a chunk are dealt over ``SHARES`` tasks by a
hash of the pair. Rows shuffled are bitmaps, not links.

Defined cases: a text that is null or empty, or for which the joined tokens' bytes differ from
a space and the text in either vocabulary, has no tokens, zeros and no groups. Strings of special
tokens are plain text. Documents are told apart by row, so repeated rows, null and repeated
ids are documents of their own, and each counts. An empty table gives an empty result. Other columns
are not read. Token ids and their product have to stay below 2^43, links of a pair within a document
below 2^31.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import ByteBpe, byte_letters
from .common import small_batches, table, with_row_key, written
from .pair_bitmaps import CHUNK_BITS, Sets, encode, merge
from .piece_bpe import piece_bpe
from .words import batches, has_unknown

SHARES = 8
HELD = 600_000  # postings that a task holds before it writes them out
ROWS = 1 << 15  # rows of an Arrow batch
TEXT = 1_000_000  # characters that are aligned at once
LOW = (1 << CHUNK_BITS) - 1

DOCUMENT = [
    ("number", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
]
POSTING = [("pair", pa.int64()), ("chunk", pa.int64()), ("sets", pa.list_(pa.binary()))]
EITHER = (
    "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pair long, chunk long, sets array<binary>"
)


class PlainByteBpe(ByteBpe):
    """Strings of special tokens are ordinary text."""

    @functools.cached_property
    def _library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        return library

    def _odd(self, text: str) -> bool:
        return has_unknown(text)

    @functools.cached_property
    def bytes(self) -> list[bytes]:
        """Bytes of every id."""
        names = Tokenizer.from_file(self.path).get_vocab()
        found = [b""] * (max(names.values()) + 1)
        letters = byte_letters()
        for name, i in names.items():
            plain = all(c in letters for c in name)
            found[i] = bytes(letters[c] for c in name) if plain and name not in self.special else name.encode()
        return found


@dataclass
class Side:
    """One vocabulary: tokens of texts, and how many bytes and which each id stands for."""

    coder: object
    before: str  # what is put before a text

    def __post_init__(self) -> None:
        self.table = pa.array(self.coder.bytes, pa.binary())
        self.lengths = np.fromiter(map(len, self.coder.bytes), np.int64, len(self.coder.bytes))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.coder.encode([self.before + t for t in texts] if self.before else texts)
        return ids.astype(np.int64), np.asarray(bounds, np.int64)

    def right(self, texts: list[bytes], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For which texts the tokens' bytes are the text's."""
        joined = self.table.take(pa.array(ids))
        data = joined.buffers()[2]
        whole = data.to_pybytes() if data is not None else b""
        if whole == b"".join(texts):  # and every text has its own
            ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[bounds[1:]]
            own = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            if np.array_equal(ends, own):
                return np.ones(len(texts), bool)
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])[bounds]
        return np.array([whole[x:y] == t for x, y, t in zip(at[:-1], at[1:], texts)], bool)


@functools.cache
def sides(path_a: str, path_b: str) -> tuple[Side, Side, pa.Array]:
    """Both vocabularies, and the text of each id followed by each of the signs , | ;. One per Python worker."""
    a, b = Side(PlainByteBpe(path_a), " "), Side(piece_bpe(path_b), "")
    most = max(len(a.lengths), len(b.lengths))
    return a, b, pa.array([f"{i}{sign}" for i in range(most) for sign in ",|;"], pa.string())


def _without(ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    keep = np.repeat(good, counts)
    return ids[keep], np.concatenate([[0], np.cumsum(np.where(good, counts, 0))])


@dataclass
class Aligned:
    """Counts of texts, the digests of their groups ('' without tokens), and all links as (text, id, id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(texts: list[str], path_a: str, path_b: str, digest=lambda data: hashlib.sha256(data).hexdigest()) -> Aligned:
    """Groups and links of texts, none of them empty. ``digest`` takes a text's groups as bytes."""
    first, second, signs = sides(path_a, path_b)
    data = [b" " + t.encode() for t in texts]
    (ids_a, bounds_a), (ids_b, bounds_b) = first.tokens(texts), second.tokens(texts)
    good = first.right(data, ids_a, bounds_a) & second.right(data, ids_b, bounds_b)
    if not good.all():
        ids_a, bounds_a = _without(ids_a, bounds_a, good)
        ids_b, bounds_b = _without(ids_b, bounds_b, good)
    ends_a, ends_b = np.cumsum(first.lengths[ids_a]), np.cumsum(second.lengths[ids_b])
    in_b = np.searchsorted(ends_b, ends_a)
    last_a = ends_b[np.minimum(in_b, max(len(ends_b) - 1, 0))] == ends_a if len(ends_a) else np.zeros(0, bool)
    both = ends_a[last_a]
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    last_b = np.zeros(len(ends_b), bool)
    last_b[in_b[last_a]] = True
    # Links: every stretch between two neighbouring ends of either side is one
    ends = np.concatenate([ends_a, ends_b[~last_b]])
    ends.sort(kind="stable")
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    text_ends = np.cumsum(np.where(good, lengths, 0))
    link_a, link_b = ids_a[np.searchsorted(ends_a, ends)], ids_b[np.searchsorted(ends_b, ends)]
    n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
    n_groups = np.diff(np.concatenate([[0], np.searchsorted(both, text_ends, side="right")]))
    of = np.repeat(np.arange(len(texts)), n_a + n_b - n_groups)
    # Text of the groups: a group's ids of the first side, then those of the second
    per_a, per_b = (np.bincount(g, minlength=len(both)) for g in (group_a, group_b))
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]] = ids_a * 3 + last_a
    codes[np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]] = ids_b * 3 + 2 * last_b
    written_out = signs.take(pa.array(codes))
    offsets = np.frombuffer(written_out.buffers()[1], np.int32)[: len(codes) + 1]
    whole = memoryview(written_out.buffers()[2]) if len(codes) else memoryview(b"")
    bounds = (bounds_a + bounds_b).tolist()
    groups = [digest(whole[offsets[x] : offsets[y] - 1]) if y > x else "" for x, y in zip(bounds, bounds[1:])]
    return Aligned(n_a, n_b, n_groups, groups, of, link_a, link_b)


class Postings:
    """Postings of a task, written out as bitmaps when there are enough of them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, numbers: np.ndarray, text: np.ndarray, pair: np.ndarray) -> None:
        """Links as (text, pair), where text t has the number numbers[t]."""
        if not len(text):
            return
        order = np.lexsort((pair, text)) if int(pair.max()) >= 1 << 43 else np.argsort((text << 43) | pair)
        text, pair = text[order], pair[order]
        new = np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))
        at = np.flatnonzero(new)
        self.parts.append((numbers[text[at]], pair[at], np.diff(np.append(at, len(text))).astype(np.int32)))
        self.held += at.size

    def out(self) -> Iterator[pa.RecordBatch]:
        """All that is held, as rows of POSTING by chunk and pair."""
        if not self.parts:
            return
        number, pair, times = map(np.concatenate, zip(*self.parts))
        self.parts, self.held = [], 0
        chunk = number >> CHUNK_BITS
        for own in np.unique(chunk):
            here = chunk == own
            pairs, row = np.unique(pair[here], return_inverse=True)
            low, more = number[here] & LOW, times[here].astype(np.int64) - 1
            digits = int(more.max()).bit_length()
            rows, places, lows = [row], [np.zeros(row.size, np.int64)], [low]
            planes = np.ones(pairs.size, np.int64)
            for k in range(digits):
                has = (more >> k & 1) == 1
                rows.append(row[has])
                places.append(np.full(rows[-1].size, k + 1, np.int64))
                lows.append(low[has])
                planes[rows[-1]] = k + 2
            sets = encode(np.concatenate(rows), np.concatenate(places), np.concatenate(lows), planes)
            yield from _either(postings=[pa.array(pairs), pa.array(np.full(pairs.size, own)), sets])


def _either(documents: list[pa.Array] | None = None, postings: list[pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
    n = len((documents or postings)[0])
    columns = documents or [pa.nulls(n, kind) for _, kind in DOCUMENT]
    columns = [*columns, *(postings or [pa.nulls(n, kind) for _, kind in POSTING])]
    batch = pa.RecordBatch.from_arrays(columns, [name for name, _ in DOCUMENT + POSTING])
    for at in range(0, n, ROWS):
        yield batch.slice(at, ROWS)


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document (pair is null) and rows of postings, from one pass over the texts.

    Columns doc_id and text are read; ``number`` tells rows apart.
    """
    keyed, key = with_row_key(docs)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings()
        width = len(sides(path_a, path_b)[1].lengths)
        for batch in frames:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            numbers = batch.column(1).to_numpy()
            for part in batches(texts, TEXT):
                found = [t for t in texts[part] if t]
                own = np.flatnonzero([bool(t) for t in texts[part]])
                size = part.stop - part.start
                counts = np.zeros((4, size), np.int64)
                groups = np.full(size, "", object)
                if found:
                    at = align(found, path_a, path_b)
                    counts[:, own] = at.n_a, at.n_b, at.n_groups, at.n_a + at.n_b - at.n_groups
                    groups[own] = at.groups
                    held.add(numbers[part][own], at.text, at.a * width + at.b)
                columns = [batch.column(1)[part], batch.column(2)[part], *map(pa.array, counts), pa.array(groups, pa.string())]
                yield from _either(documents=columns)
                if held.held > HELD:
                    yield from held.out()
        yield from held.out()

    rows = keyed.select("text", F.col(key).alias("number"), F.col("doc_id").cast("long").alias("doc_id"))
    return small_batches(rows).mapInArrow(work, EITHER)


def merged(found: DataFrame) -> DataFrame:
    """(pair, chunk, sets, documents, links): one row per pair and chunk."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def unite(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            pair, chunk, sets = (rows.column(i).chunk(0) for i in range(3))
            p, c = pair.to_numpy(), chunk.to_numpy()
            new = np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1]))
            if not new.all():
                sets = merge(sets, np.cumsum(new) - 1)
                pair, chunk = pa.array(p[new]), pa.array(c[new])
            documents, links = Sets(sets).totals()
            yield pa.RecordBatch.from_arrays(
                [pair, chunk, sets, pa.array(documents), pa.array(links)], ["pair", "chunk", "sets", "documents", "links"]
            )

        for batch in frames:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            p, c = (rows.column(i).to_numpy() for i in range(2))
            same = (p == p[-1]) & (c == c[-1])  # the last pair's rows may go on in the next batch
            begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if begin:
                yield from unite(rows.slice(0, begin))
            rest = rows.slice(begin)
        if rest is not None:
            yield from unite(rest)

    rows = found.where("pair IS NOT NULL").select("pair", "chunk", "sets")
    dealt = rows.repartition("chunk", _share()).sortWithinPartitions("chunk", "pair")
    return small_batches(dealt).mapInArrow(work, "pair long, chunk long, sets array<binary>, documents long, links long")


def _share():
    return F.pmod(F.xxhash64("pair"), F.lit(SHARES))


def pair_counts(postings_merged: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, documents, links, best): best tells that no other pair of this b has more links."""
    counts = postings_merged.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    counts = counts.select("pair", F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"), "documents", "links")
    counts = written(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def scores(postings_merged: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, n_best, count_sum) of every document with a link."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        total = np.zeros((2, LOW + 1), np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            own = np.flatnonzero(total[1])
            columns = [pa.array((at[0] << CHUNK_BITS) + own), pa.array(total[0][own]), pa.array(total[1][own])]
            yield pa.RecordBatch.from_arrays(columns, ["number", "n_best", "count_sum"])

        for batch in frames:
            if not batch.num_rows:
                continue
            chunk, share = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (share[1:] != share[:-1])) + 1
            for x, y in zip([0, *cuts], [*cuts, batch.num_rows]):
                if at != (chunk[x], share[x]):
                    if at is not None:
                        yield from out()
                    at = (int(chunk[x]), int(share[x]))
                    total[:] = 0
                sets = Sets(batch.column(2).slice(x, y - x))
                links, best = batch.column(3).to_numpy()[x:y], batch.column(4).to_numpy(zero_copy_only=False)[x:y]
                of, low = sets.members()
                weight = sets.weights()
                np.add.at(total[0], low, (weight * best[sets.row])[of])
                np.add.at(total[1], low, (weight * links[sets.row])[of])
        if at is not None:
            yield from out()

    rows = postings_merged.select("pair", "chunk", "sets").join(counts.select("pair", "links", "best"), "pair")
    rows = rows.select("chunk", _share().alias("share"), "sets", "links", "best")
    dealt = rows.repartition("chunk", "share").sortWithinPartitions("chunk", "share")
    parts = small_batches(dealt).mapInArrow(work, "number long, n_best long, count_sum long")
    return parts.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


@dataclass
class Alignment:
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (a digest);
    ``pairs``: pair, a, b, documents, links, best."""

    documents: DataFrame
    pairs: DataFrame


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> Alignment:
    """Align the texts of ``docs`` (doc_id, text) under a byte-level BPE and a sentencepiece vocabulary."""
    found = written(postings(docs, path_a, path_b), "postings")
    index = written(merged(found), "index")
    counts = written(pair_counts(index, len(sides(path_a, path_b)[1].lengths)), "counts")
    known = written(scores(index, counts), "scores")
    rows = found.where("pair IS NULL").join(known, "number", "left")
    documents = rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups"
    )
    return Alignment(documents, counts)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(table(spark, sf_dir, "documents"), *paths).documents.withColumnRenamed("groups", "groups_sha256")
