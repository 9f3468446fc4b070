"""License scans: phrases by position, and an exact set-similarity join with templates.

Only DataFrame functions. A text is read once. Its blocks are all runs of ``LINES`` consecutive
lines (or all lines, if it has fewer), so notices are found where they are wrapped; of a block's distinct words, those that any
template has are kept. The join finds every (block, template) with
``|block and template| / |template| >= THRESHOLD`` in which the template's own word is:

* tokens are ordered by the number of blocks they are in, rarest first;
* length: the block needs at least the required number of template words;
* prefix: a template of n words, k of them required, shares one of its first n - k + 1
  with every block that qualifies, so only those are indexed; the same holds for blocks;
* position: behind the places where a shared word stands in both, enough words are left;
* the pairs that remain are verified.

The index has one row per template word and is broadcast: its size is bounded by the
templates given. Blocks are joined where they are, and what is shuffled are counts per
token and labels per document, both combined before. Long texts have many blocks, and
no block is cut.

Defined cases: a null text is the empty text. Without a phrase, ``first_word`` and
``last_word`` are null, labels are empty strings and the score is 0. The score is 1 with
a phrase, else the best containment found. Repeated rows stay, as do null ids. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

THRESHOLD = 0.8
LINES = 3
# Phrases and their labels
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Words of license notices, their labels, and the word without which they are not meant
TEMPLATES = [
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "granted"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gpl", "gnu"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "commons"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "mozilla"),
    ("copyright all rights reserved", "reserved", "reserved"),
]
# Everything in ASCII but digits and letters parts words
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def required(words: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * words - 1e-9))


def _phrase_places(phrase: str) -> Column:
    """Places where the words of a phrase stand in column ``words``, which is NULL without any phrase."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        same = [F.get("words", i + k) == part for k, part in enumerate(parts)]
        return F.coalesce(reduce(and_, same), F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)


def _comma_joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def read_texts(docs: DataFrame, phrases: list[tuple[str, str]], vocabulary: list[str], least: int) -> DataFrame:
    """A narrow row per document: what phrases say, and its blocks' template words."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.transform(
        F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(ascii_lower(line), BETWEEN_WORDS, " "))
    )
    read = docs.select("doc_id", lines.alias("lines"))
    read = read.select(
        "doc_id",
        F.array_join(F.filter("lines", lambda line: line != ""), " ").alias("joined"),
        F.transform("lines", lambda line: F.filter(F.split(line, " "), lambda w: w.isin(vocabulary))).alias("kept"),
    )
    begins = F.sequence(F.lit(1), F.greatest(F.size("kept") - (LINES - 1), F.lit(1)))
    runs = F.transform(begins, lambda i: F.array_sort(F.array_distinct(F.flatten(F.slice("kept", i, F.lit(LINES))))))
    blocks = F.array_distinct(F.filter(runs, lambda words: F.size(words) >= least))
    read = read.select("doc_id", "joined", blocks.alias("blocks"))
    spaced = F.concat(F.lit(" "), "joined", F.lit(" "))
    has_phrase = reduce(or_, [F.contains(spaced, F.lit(f" {phrase} ")) for phrase, _ in phrases])
    spaces = F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(" "), F.lit("")))
    # The words are a column of their own: within the search for places they would be split for each place
    read = read.select(
        "doc_id",
        F.when(F.col("joined") == "", F.lit(0)).otherwise(spaces + 1).cast("long").alias("n_words"),
        F.when(has_phrase, F.split("joined", " ")).alias("words"),
        "blocks",
    )
    places = F.when(F.col("words").isNull(), F.array(*[F.array().cast("array<int>")] * len(phrases)))
    read = read.select(
        "doc_id", "n_words", places.otherwise(F.array(*[_phrase_places(p) for p, _ in phrases])).alias("places"), "blocks"
    )
    all_places = F.flatten("places")
    labels = [F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    return read.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        "blocks",
    )


def join_templates(blocks: DataFrame, templates: list[tuple[str, str, str | None]], threshold: float) -> DataFrame:
    """(row, label, containment) of all (block, template) pairs; ``blocks`` has row and words. A
    template is its text, its label and the word that a block has to have, if any."""
    spark = blocks.sparkSession
    sets = [(sorted(set(text.split(" "))), label, own) for text, label, own in templates]
    vocabulary = {w for words, _, _ in sets for w in words}
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # at most the vocabulary
    seen = {r["word"]: r["count"] for r in counts}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index = []
    for words, label, own in sets:
        ranks = sorted(order[w] for w in words)
        need = required(len(ranks), threshold)
        index += [(rank, p, ranks, need, label, order.get(own)) for p, rank in enumerate(ranks[: len(ranks) - need + 1])]
    index = spark.createDataFrame(index, "rank int, place int, template array<int>, need int, label string, own int")
    least = min(required(len(words), threshold) for words, _, _ in sets)

    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ranked = blocks.select("row", F.array_sort(F.transform("words", lambda w: F.get(F.array(rank_of[w]), F.lit(0)))).alias("block"))
    prefix = F.slice("block", F.lit(1), F.size("block") - least + 1)
    ranked = ranked.select("row", "block", F.posexplode(prefix).alias("at", "rank"))
    left = F.least(F.size("template") - F.col("place"), F.size("block") - F.col("at"))
    shared = F.size(F.array_intersect("block", "template"))
    return (
        ranked.join(F.broadcast(index), "rank")
        .where((F.size("block") >= F.col("need")) & (left >= F.col("need")))
        .where((shared >= F.col("need")) & (F.col("own").isNull() | F.array_contains("block", F.col("own"))))
        .select("row", "label", (shared / F.size("template")).alias("containment"))
    )


def scan_licenses(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str, str | None]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    vocabulary = sorted({w for text, *_ in templates for w in text.split(" ")})
    least = min(required(len(set(text.split(" "))), threshold) for text, *_ in templates)
    read = written(read_texts(docs, phrases, vocabulary, least), "licenses")
    blocks = read.select("row", F.explode("blocks").alias("words"))
    found = (
        join_templates(blocks, templates, threshold)
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    out = read.drop("blocks").join(found, "row", "left")
    labels = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        _comma_joined(F.col("base")).alias("base_labels"), _comma_joined(labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{text}', '{label}', '{own}')" for text, label, own in TEMPLATES)
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM d
), p AS (
  SELECT doc_id, len(words) AS n_words,
    list_filter(range(1, len(words) + 1), lambda i: words[i] = 'cc' AND words[i + 1] = 'by') AS cc,
    list_filter(range(1, len(words) + 1), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(words) + 1), lambda i: words[i] = 'all' AND words[i + 1] = 'rights' AND words[i + 2] = 'reserved') AS res
  FROM w
), templates AS (
  SELECT label, own, list_distinct(string_split(txt, ' ')) AS tokens FROM (VALUES {_VALUES}) v(txt, label, own)
), lines AS (
  SELECT doc_id, list_transform(string_split(t, chr(10)),
    lambda line: list_filter(string_split_regex(line, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS words FROM d
), blocks AS (
  SELECT doc_id, list_distinct(flatten(words[at:at + {LINES - 1}])) AS tokens
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {LINES - 1}, 1) + 1)) AS at FROM lines)
), found AS (
  SELECT doc_id, list_distinct(list(label)) AS more,
    max(len(list_intersect(b.tokens, m.tokens))::DOUBLE / len(m.tokens)) AS best
  FROM blocks b, templates m WHERE len(list_intersect(b.tokens, m.tokens)) >= ceil({THRESHOLD} * len(m.tokens) - 1e-9)
    AND list_contains(b.tokens, m.own)
  GROUP BY doc_id
), named AS (
  SELECT doc_id, n_words::BIGINT AS n_words, (len(cc) + len(gpl) + len(res))::BIGINT AS n_base,
    list_min(cc || gpl || res) - 1 AS first_word, list_max(cc || gpl || res) - 1 AS last_word,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
      CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base
  FROM p
)
SELECT named.doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM named LEFT JOIN found ON named.doc_id = found.doc_id
"""
