import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from backhaul.llm.common import connected_components
from backhaul.llm.embedding_dedup import compare_tiles, embedding_groups, forest, unit
from backhaul.llm.exact_dedup import exact_duplicates
from backhaul.llm.simhash import fingerprint, linked, simhash_groups


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- exact -----------------------------------------------------------------------


def expected_duplicates(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        own = groups[text or ""]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("content_hash", [None, F.length])  # lengths collide all the time
def test_exact_duplicates(odd_docs, content_hash):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = exact_duplicates(odd_docs, **({"content_hash": content_hash} if content_hash else {}))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_duplicates(rows)


def test_exact_duplicates_carry_columns(odd_docs, no_docs):
    kept = exact_duplicates(odd_docs, carry=odd_docs.columns).where("kept").select("row.*")
    assert kept.columns == odd_docs.columns
    assert {r["text"] or "" for r in kept.collect()} == {r["text"] or "" for r in odd_docs.collect()}
    assert exact_duplicates(no_docs).count() == 0


# --- fingerprints ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        assert fingerprint(r["text"] or "") == plain_fingerprint(r["text"])


@pytest.mark.parametrize("long_list", [2, 16])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_have_the_components_of_all_pairs(spark, long_list, max_bits):
    pick = random.Random(5)
    prints = [pick.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    for base in prints[:30]:  # near ones, and chains of them
        for _ in range(4):
            base ^= 1 << pick.randrange(64)
            prints.append(base)
    crowd = pick.getrandbits(64)
    prints += [crowd ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    prints = sorted({int(p) - (1 << 64) if p >> 63 else p for p in prints})
    pairs = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits]
    edges = linked(spark.createDataFrame([(p,) for p in prints], "fp long"), max_bits, long_list)
    found = dict(connected_components(edges).collect())
    expected = components(prints, pairs)
    assert {p: found.get(p, p) for p in prints} == expected


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1400)]
    edges = [*chain, *star, (5, 5), (-3, 9), (9, -3)]
    found = dict(connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert found == {k: v for k, v in components({n for e in edges for n in e}, edges).items() if k != 5}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_simhash_groups(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd_docs.collect()]
    prints = sorted({p for _, p in rows})
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    part = components(prints, pairs)
    least = {}
    for doc, p in rows:
        if doc is not None:
            least[part[p]] = min(doc, least.get(part[p], doc))
    expected = [(doc, f"{p:016x}", least.get(part[p])) for doc, p in rows]
    found = [tuple(r) for r in simhash_groups(odd_docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert simhash_groups(no_docs).count() == 0


def test_simhash_links_near_copies(spark):
    pick = random.Random(2)
    text = " ".join(str(pick.randrange(10**6)) for _ in range(4000))
    near = text.replace(" ", "  ", 3).upper() + " end"
    docs = spark.createDataFrame([(9, text), (4, near), (2, text[::-1])], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_groups(docs).collect()}
    assert found == {9: 4, 4: 4, 2: 2}


# --- embeddings ---------------------------------------------------------------------------


def vectors(n=600, size=24, seed=1):
    rng = np.random.default_rng(seed)
    plain = rng.normal(size=(n, size))
    near = plain[:60] + rng.normal(scale=0.09, size=(60, size))
    again = near + rng.normal(scale=0.09, size=(60, size))
    crowd = plain[99] + rng.normal(scale=0.05, size=(80, size))
    same = np.repeat(plain[:1], 40, axis=0)
    return np.concatenate([plain, near, again, crowd, same, 3.5 * plain[5:8]])


def test_compare_tiles_finds_every_pair():
    x = unit(vectors())
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    a, b = compare_tiles(x[:400], x[300:], axes, 0.95)
    whole = x[:400] @ x[300:].T
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(whole >= 0.95))))


def test_forest_keeps_components():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    kept = forest(x, y)
    assert len(kept) < 60
    assert components(range(60), kept) == components(range(60), zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("tile", [64, 4096])
def test_embedding_groups(spark, tile):
    x = vectors()
    ids = np.random.default_rng(8).permutation(len(x))
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23]
    rows += [(10_000 + i, v, 2) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").repartition(5)
    found = {r["vec_id"]: tuple(r)[1:] for r in embedding_groups(df, tile=tile).collect()}
    whole = np.concatenate([x, x[:1]])  # the vector without an id links like any other
    cosine = unit(whole) @ unit(whole).T >= 0.95
    part = components(range(len(whole)), [(int(a), int(b)) for a, b in zip(*np.nonzero(cosine)) if a < b])
    least = {}
    for k, i in enumerate(ids.tolist()):
        least[part[k]] = min(i, least.get(part[k], i))
    for k, i in enumerate(ids.tolist()):
        assert found[i] == (int(cosine[k].sum()) - 1, least[part[k]], least[part[k]] == i)
    for i in range(len(odd)):
        assert found[10_000 + i] == (0, 10_000 + i, True)
    assert found[None] == (int(cosine[-1].sum()) - 1, least[part[len(x)]], False)
    assert len(found) == len(rows)


def test_embeddings_without_ids_connect(spark):
    """1 and 2 are linked through a vector without an id; two such vectors alone; one id with two vectors."""
    angles = [(1, 0.0), (None, 0.3), (2, 0.6), (None, 2.0), (None, 2.1), (7, 3.5), (7, 5.0), (3, 5.1)]
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in angles]
    found = Counter(tuple(r) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == {
        (1, 1, 1, True): 1, (None, 2, 1, False): 1, (2, 1, 1, False): 1, (None, 1, None, True): 2,
        (7, 0, 3, False): 1, (7, 1, 3, False): 1, (3, 1, 3, True): 1,
    }


def test_embedding_groups_of_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_groups(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_groups(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    short = spark.createDataFrame([(1, [1.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in embedding_groups(short).collect()) == {(1, 2, 1, True): 1, (2, 2, 1, False): 2}
