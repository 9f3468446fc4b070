"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the different character
n-grams (n = 1, 2, 3) that both contain, divided by the root of the product of their own
counts. Texts are lower-cased, runs of anything but letters are one space. n-grams are
those of the training sample, over any letters of any script: an n-gram is a hash of its code points
into ``SLOTS`` slots, of which those the sample has are used.

Landmarks, some training texts of every language, give Nystroem features: with K the
kernel among landmarks, a text's kernel values with the landmarks times K^(-1/2). On
them one ridge regression per language separates it from the rest (target 1 or -1). The
two matrices are multiplied once, so predicting a batch is: presence matrix, times
landmarks, divided by the norms, times coefficients.

The model is fitted on the driver from at most ``SAMPLE`` different texts, ``PER_LANGUAGE`` of one language,
chosen by a hash of the text (one at least of every language). Of a long one it takes a window of ``MAX_CHARS``
characters, shorter ones if all would pass ``TOTAL_CHARS``; that bounds it. There are at most ``LANDMARKS``
landmarks (one at least of every language), chosen by a hash as well. So the model has at most SLOTS times
LANDMARKS numbers, whatever the number of languages up to LANDMARKS. The choice needs the
number of texts of each language first; with it a bound on the hash leaves about as many of each as
are wanted, and only those are ranked.
Whole texts are predicted, in batches within a task; nothing is shuffled.

Defined cases: ``und`` with score 0 if a text is null or has no letter, or if there is
nothing to learn from. A null id is not held out. Ties go to the language that sorts
first. Repeated rows stay. An empty table gives an empty result. Other columns are not
read, and lang and doc_id serve to choose and label training texts only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .words import LETTER, kinds

PER_LANGUAGE = 250
SAMPLE = 4_000
MAX_CHARS = 20_000
TOTAL_CHARS = 20_000_000
LANDMARKS = 256
LANDMARKS_PER_LANGUAGE = 32
SLOTS = 1 << 16
BLOCK = 128  # texts whose presence matrix is held at once
RIDGE = 1e-2
FOLDS = 5
UNKNOWN = "und"


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Grams:
    """Presence of the n-grams of some texts, as a matrix of texts by n-grams."""

    def __init__(self, texts: list[str]):
        known = np.zeros(SLOTS, bool)
        for text in texts:
            slots, _, _ = self._slots([text])
            known[slots] = True
        self.size = int(known.sum())
        self.index = np.full(SLOTS, self.size, np.int32)
        self.index[known] = np.arange(self.size)

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of all n-grams but those that neighbouring spaces are in, the text of each, whether a text has letters."""
        low = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, low), np.int64, len(low))
        letter = kinds()[codes] == LETTER
        begins = np.cumsum(lengths) - lengths
        has_letter = np.add.reduceat(letter, begins, dtype=np.int64) > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters, the first
        keep[begins] = True
        symbols = np.where(letter, codes, 0)[keep].astype(np.uint64)
        of = np.repeat(np.arange(len(low), dtype=np.int32), np.add.reduceat(keep, begins, dtype=np.int64))
        # Two spaces meet where two texts do, or where a text has no letter behind its first one
        apart = (symbols[:-1] == 0) & (symbols[1:] == 0)
        one = symbols * _MIX[0]
        two = one[:-1] * _MIX[1] + symbols[1:] * _MIX[2] + np.uint64(1)
        three = two[:-1] * _MIX[1] + symbols[2:] * _MIX[2] + np.uint64(2)
        slots, owners = [], []
        for values, bad in ((one, None), (two, apart), (three, apart[:-1] | apart[1:])):
            good = slice(None) if bad is None else ~bad
            mixed = values[good] ^ (values[good] >> np.uint64(29))
            slots.append((mixed * _MIX[0] >> np.uint64(48)).astype(np.int64) & (SLOTS - 1))
            owners.append(of[: values.size][good])
        return np.concatenate(slots), np.concatenate(owners), has_letter

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, has letters)."""
        slots, of, has_letter = self._slots(texts)
        width = self.size + 1  # the last column takes what is not known
        found = np.zeros(len(texts) * width, np.uint8)
        found[of.astype(np.int64) * width + self.index[slots]] = 1
        return found.reshape(-1, width)[:, :-1].astype(np.float32), has_letter


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    landmarks: np.ndarray  # n-grams by landmarks, each of unit length
    weights: np.ndarray  # landmarks and a constant, by languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        seen, has_letter = self.grams.presence(texts)
        norm = np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
        kernel = seen @ self.landmarks / norm
        scores = kernel @ self.weights[:-1] + self.weights[-1]
        best = scores.argmax(axis=1)
        score = np.clip((scores[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
        return names, np.where(has_letter, score, 0.0)


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of a bounded, repeatable choice of different texts outside the held-out fold."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    fit = labelled.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    different = written(fit.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")), "different")
    counts = different.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return []
    wanted = max(1, min(PER_LANGUAGE, SAMPLE // languages))
    # Hashes are spread evenly: below this bound are twice as many texts and some more
    share = F.least(F.lit(1.0), (2.0 * wanted + 20) / F.col("n"))
    # A row per language; without the hint rows would be dealt by language before they are few
    few = different.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang")
    few = few.where((F.col("h") / 2.0**64 + 0.5) <= F.col("share"))
    by_hash = Window.partitionBy("lang").orderBy("h")
    chosen = few.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= wanted)
    chosen = chosen.select("lang", "h", "doc_id").collect()  # ``wanted`` for each language at most
    ids, hashes = sorted({r["doc_id"] for r in chosen}), sorted({r["h"] for r in chosen})
    rows = fit.where(F.col("doc_id").isin(ids) & F.col("h").isin(hashes))
    wide = F.lit(max(1, min(MAX_CHARS, TOTAL_CHARS // len(chosen))))
    begin = F.pmod("h", F.greatest(F.length("text") - wide, F.lit(0)) + 1).cast("int")
    rows = rows.select("doc_id", "lang", "h", F.substring("text", begin + 1, wide).alias("text"))
    rows = rows.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text")).collect()  # repeated rows once
    wanted_rows = {(r["doc_id"], r["lang"], r["h"]) for r in chosen}
    return sorted((r["lang"], r["text"]) for r in rows if (r["doc_id"], r["lang"], r["h"]) in wanted_rows)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def has_letter(text: str) -> bool:
    return bool((kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == LETTER).any())


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """The model of (language, text) rows; None if no text has a letter."""
    sample = sorted({(lang, text) for lang, text in sample if has_letter(text)}, key=lambda r: (r[0], _digest(r[1])))
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    grams = Grams([text for _, text in sample])
    each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(languages)))
    place: Counter[str] = Counter()
    marks = []
    for lang, text in sample:
        place[lang] += 1
        if place[lang] <= each:
            marks.append(text)

    def seen(texts: list[str]) -> np.ndarray:
        found, _ = grams.presence(texts)
        return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))

    landmarks = np.ascontiguousarray(np.concatenate([seen([t]) for t in marks]).T)
    among = (landmarks.T @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    solid = values > 1e-6 * values[-1]
    root = vectors[:, solid] / np.sqrt(values[solid])  # K^(-1/2), up to a rotation
    texts = [text for _, text in sample]
    blocks = [seen(texts[at : at + BLOCK]) @ landmarks for at in range(0, len(texts), BLOCK)]
    features = np.concatenate(blocks).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(sample), 1))])
    targets = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in sample])
    share = np.array([1 / place[lang] for lang, _ in sample])[:, None]  # every language weighs the same
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ (share * features) + penalty, features.T @ (share * targets))
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return Model(languages, grams, landmarks, weights.astype(np.float32))


def identify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    ``carry`` names columns of ``docs`` that come along, in a struct ``row``, before which
    ``has_letter`` tells of texts with a letter, whether or not there is a model.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(training_sample(docs.select("doc_id", "text", "lang"))))

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            names, scores = [], []
            begin = 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and end - begin < BLOCK and (end == begin or held + len(texts[end]) <= 1_000_000):
                    held += len(texts[end])
                    end += 1
                if model.value is None:
                    names += [UNKNOWN] * (end - begin)
                    scores += [0.0] * (end - begin)
                else:
                    own, score = model.value.predict(texts[begin:end])
                    names += own
                    scores += score.tolist()
                begin = end
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            if carry:
                rest.insert(-1, pa.array(map(has_letter, texts), pa.bool_()))
            columns = [*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names_out, "lang_pred", "score"])

    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    more = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out, *more)
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[1:]]
    if carry:
        fields.insert(-1, ("has_letter", "boolean"))
    names_out = [name for name, _ in fields]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields)
    return small_batches(rows).mapInArrow(work, f"{schema}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
