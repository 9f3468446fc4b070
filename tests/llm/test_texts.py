import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from backhaul.llm.language import LANDMARKS, RIDGE, SLOTS, UNKNOWN, Grams, fit, identify, training_sample
from backhaul.llm.license_scan import PHRASES, TEMPLATES, join_templates, scan_licenses

# --- licenses --------------------------------------------------------------------------


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def scanned(text, threshold=0.8):
    words = words_of(text or "")
    places, base = [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += own
        base |= {label} if own else set()
    more, best = set(), 0.0
    lines = (text or "").split("\n")
    for i in range(max(1, len(lines) - 2)):
        block = {w for line in lines[i : i + 3] for w in words_of(line)}
        for template, label, own in TEMPLATES:
            tokens = set(template.split())
            n = len(tokens & block)
            if own in block and n >= math.ceil(threshold * len(tokens) - 1e-9):
                more.add(label)
                best = max(best, n / len(tokens))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best,
    )


NOTICES = [
    "ALL RIGHTS RESERVED", "all rights\nreserved all--rights, reserved!", "all rights reservedé", "CC-BY cc by by cc by 4.0",
    "the GNU General Public License, version 3", "released under mit license", "under the released license of mit\nx",
    "This work is licensed under the General Public License 3", "cc", "cc\x7fby", "mit license the\nreleased under",
]


def test_scan_licenses(spark, odd_docs, no_docs):
    pick = random.Random(6)
    vocabulary = [w for t, *_ in TEMPLATES for w in t.split()] + ["Other", "Wörter", "x1", "\n", "\n", "-"]
    made = [" ".join(pick.choice(vocabulary) for _ in range(pick.randrange(40))) for _ in range(150)]
    made += [" ".join(w for w in t.split() if pick.random() < 0.85) for t, *_ in TEMPLATES * 6]
    texts = NOTICES + made
    docs = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string")
    docs = docs.unionByName(odd_docs.select("doc_id", "text")).withColumn("row", F.lit(1)).withColumn("blocks", F.lit("x"))
    expected = [(r["doc_id"], *scanned(r["text"])) for r in docs.collect()]
    found = [tuple(r) for r in scan_licenses(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(e[6] != "" for e in expected) > 40
    assert scan_licenses(no_docs).count() == 0


WRAPPED = {
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "mpl",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted": "bsd",
    "# Permission is hereby granted, free of charge,\n# to any person obtaining a copy\n# of this software and": "mit",
    "it was released under the apache license": "",
    "a wor\u212a licensed under the gnu general public license version 3": "gpl",
    "Redistribution and use in source\n\n\n\nand binary forms, with or without modification, are permitted": "",
}


def test_wrapped_notices(spark):
    docs = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in scan_licenses(docs).collect()}
    assert [found[i] for i in range(len(WRAPPED))] == list(WRAPPED.values())
    assert [scanned(t)[5] for t in WRAPPED] == [found[i] for i in range(6)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_join_finds_every_pair(spark, threshold):
    pick = random.Random(9)
    vocabulary = sorted({w for t, *_ in TEMPLATES for w in t.split()})
    sets = [sorted(set(pick.choices(vocabulary, k=pick.randrange(1, 25)))) for _ in range(200)]
    least = min(math.ceil(threshold * len(set(t.split())) - 1e-9) for t, *_ in TEMPLATES)
    sets = [s for s in sets if len(s) >= least] + [sorted(set(t.split())) for t, *_ in TEMPLATES]
    templates = [(t, str(i), None) for i, (t, *_) in enumerate(TEMPLATES)]
    blocks = spark.createDataFrame(list(enumerate(sets)), "row long, words array<string>")
    found = {(r["row"], r["label"]) for r in join_templates(blocks, templates, threshold).collect()}
    expected = {
        (i, label)
        for i, s in enumerate(sets)
        for t, label, _ in templates
        if len(set(s) & set(t.split())) >= max(1, math.ceil(threshold * len(set(t.split())) - 1e-9))
    }
    assert found == expected and expected


# --- languages -------------------------------------------------------------------------


def test_presence_is_that_of_plain_sets():
    texts = ["Abc, abc!", "ça va?  ÇA", "", "123", "日本語 x", "a--b"]
    grams = Grams(texts[:2])
    matrix, has_letter = grams.presence(texts)
    assert has_letter.tolist() == [True, True, False, False, True, True]

    def plain(text):
        low = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)} - {"  "}

    for i in (0, 1, 4, 5):
        for j in (0, 1):
            assert matrix[i] @ matrix[j] == len(plain(texts[i]) & plain(texts[j]))


def test_many_letters_and_scripts():
    """Two scripts of 1,500 letters each and eleven of 30."""
    pick = random.Random(5)
    alphabets = {f"a{k}": [chr(0x400 + 30 * k + i) for i in range(30)] for k in range(4)}
    alphabets |= {f"l{k}": [chr(0x61 + (k * 3 + i) % 26) for i in range(9)] for k in range(7)}
    alphabets |= {"han": [chr(0x4E00 + i) for i in range(1500)], "hangul": [chr(0xAC00 + i) for i in range(1500)]}

    def text(letters):
        return " ".join("".join(pick.choices(letters, k=pick.randrange(1, 7))) for _ in range(60))

    made = [(lang, text(letters)) for lang, letters in alphabets.items() for _ in range(60)]
    model = fit([m for i, m in enumerate(made) if i % 3])
    apart = [m for i, m in enumerate(made) if i % 3 == 0]
    names, scores = model.predict([t for _, t in apart])
    right = [a == b for a, (b, _) in zip(names, apart)]
    assert sum(right) / len(right) > 0.95
    assert all(r for r, (lang, _) in zip(right, apart) if lang.startswith("han"))
    assert model.landmarks.shape[0] <= SLOTS and model.landmarks.shape[1] <= LANDMARKS


def test_equals_plain_nystroem_ridge():
    """Kernel by sets, K^(-1/2) and ridge regression written out."""
    pick = random.Random(6)
    made = [(lang, " ".join(pick.choices(words, k=12))) for lang, words in (("x", ["abc", "bcd", "ca"]), ("y", ["xyz", "abz", "zz"])) for _ in range(8)]
    made = sorted(set(made), key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
    model = fit(made)
    grams = [{t[i : i + n] for t in [f" {text} "] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for _, text in made]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    values, vectors = np.linalg.eigh(kernel)  # all texts are landmarks
    solid = values > 1e-6 * values[-1]
    root = vectors[:, solid] / np.sqrt(values[solid])
    features = np.hstack([kernel @ root, np.ones((len(made), 1))])
    share = np.array([1 / sum(m[0] == lang for m in made) for lang, _ in made])[:, None]
    targets = np.array([[1.0 if lang == name else -1.0 for name in "xy"] for lang, _ in made])
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ (share * features) + penalty, features.T @ (share * targets))
    names, scores = model.predict([t for _, t in made])
    plain = features @ solved
    assert names == ["xy"[i] for i in plain.argmax(axis=1)]
    assert np.allclose(scores, np.clip((plain.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang_pred == found.lang).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_nothing_but_text_decides(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    blinded = docs.withColumn("lang", F.when(~out, F.col("lang"))).withColumn("source", F.lit("x"))
    assert sorted(map(str, identify(docs).collect())) == sorted(map(str, identify(blinded).collect()))
    sample = training_sample(docs)
    assert sample == training_sample(docs.repartition(7))


def test_odd_texts(spark, odd_docs, no_docs):
    found = identify(odd_docs, carry=odd_docs.columns)
    assert found.count() == odd_docs.count() and found.select("row.*").columns == odd_docs.columns
    for r in found.collect():
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] != UNKNOWN) == letters and 0 <= r["score"] <= 1
        assert r["doc_id"] is not None or not r["held_out"]
    assert identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in identify(unlabelled).collect()} == {(UNKNOWN, 0.0)}
    assert fit([]) is None and fit([("en", "12 3")]) is None


def test_long_texts_and_copies_are_learned_from(spark):
    words = {"aa": "hello world today", "bb": "bonjour monde demain"}
    rows = [(i, f"{words['aa']} {i}", "aa") for i in range(40)]
    rows += [(100 + i, f"{words['bb']} {i} " * 2_000, "bb") for i in range(20)]
    rows += [(200 + i, "aaa the same", "aa") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = training_sample(docs)
    assert {lang for lang, _ in sample} == {"aa", "bb"} and len(set(sample)) == len(sample)
    assert max(len(t) for _, t in sample) <= 20_000 and [t for _, t in sample].count("aaa the same") == 1
    assert all(r["lang_pred"] == r["lang"] for r in identify(docs).join(docs, "doc_id").collect())
