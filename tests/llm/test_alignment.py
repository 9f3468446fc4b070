import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_texts import ODD_TEXTS
from tokenizers import Tokenizer

from backhaul.llm import token_alignment
from backhaul.llm.byte_bpe import byte_letters
from backhaul.llm.pair_bitmaps import Sets, encode, merge
from backhaul.llm.piece_bpe import PieceBpe
from backhaul.llm.token_alignment import align_tokens

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
MORE = [
    " leading", "trailing ", "  two  spaces  ", " ", "\n", "a▁b", "<0x41> <s></s><unk>", "x\x00y", "é" * 300, "日本語と中文",
    "ﬁ ² ͸ \U0010ffff", "tab\tand\r\nline", "word" * 400, "a b c d e f g", "The quick brown fox, the quick brown fox.",
]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, and {(a, b): [documents, links]}, token by token."""
    tok = Tokenizer.from_file(A)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    letters = byte_letters()
    piece = sentencepiece.SentencePieceProcessor(model_file=B)

    def ranges(ids, data):
        at, out = 0, []
        for i, d in zip(ids, data):
            out.append((i, at, at + len(d)))
            at += len(d)
        return out

    per_text = []
    for text in texts:
        wanted = b" " + (text or "").encode()
        ids_a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        data_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in ids_a]
        ids_b = piece.encode(text or "")
        names = [piece.id_to_piece(i) for i in ids_b]
        data_b = [bytes([int(n[3:5], 16)]) if piece.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        if not text or b"".join(data_a) != wanted or b"".join(data_b) != wanted:
            per_text.append(([], [], [], 0))
            continue
        ra, rb = ranges(ids_a, data_a), ranges(ids_b, data_b)
        links = [(x, y) for x, s, e in ra for y, s2, e2 in rb if s < e2 and s2 < e]
        cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in r if begin <= s and e <= cut) for r in (ra, rb)))
            begin = cut
        per_text.append((ra, rb, links, groups))
    total = Counter(link for _, _, links, _ in per_text for link in links)
    documents = Counter(link for _, _, links, _ in per_text for link in set(links))
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    rows = []
    for ra, rb, links, groups in per_text:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ra else ""
        best = sum(total[link] == most[link[1]] for link in links)
        rows.append((len(ra), len(rb), len(groups) if ra else 0, len(links), best, sum(total[link] for link in links), digest))
    return rows, {link: (documents[link], n) for link, n in total.items()}


def compared(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, number int, pair string").repartition(parts)
    found = align_tokens(df, A, B)
    got = sorted((tuple(r) for r in found.documents.collect()), key=repr)
    wanted, pairs = plain([t for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, wanted)), key=repr)
    assert {(r["a"], r["b"]): (r["documents"], r["links"]) for r in found.pairs.collect()} == pairs


def test_equals_plain_alignment(spark):
    texts = ODD_TEXTS[:-2] + ["word " * 300, ODD_TEXTS[-1]] + MORE
    rows = list(enumerate(texts + MORE)) + [(3, "One. Two, three!"), (None, "One. Two, three!"), (None, None)]
    compared(spark, rows)


def test_small_pieces_are_merged(spark, monkeypatch):
    """Postings written out after every few texts, chunks cut in many places."""
    monkeypatch.setattr(token_alignment, "TEXT", 60)
    monkeypatch.setattr(token_alignment, "HELD", 5)
    monkeypatch.setattr(token_alignment, "ROWS", 7)
    rng = random.Random(0)
    words = ["the", " and", "tion", "é", "  ", "über", "!!", "日本", "\n", "fox", "<s>", "1999"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(80)]
    compared(spark, rows, 2)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 1500]
    compared(spark, rows[:60])


def test_no_documents(spark, no_docs):
    found = align_tokens(no_docs, A, B)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def test_pieces_equal_the_library():
    coder = PieceBpe(B)
    assert coder.by_words
    rng = random.Random(1)
    signs = [" ", " ", "a", "b", "th", "e", "\n", "é", "▁", "日", "🤗", "0", "x" * 120, "\t"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    ids, bounds = coder.encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == coder.model.encode(texts)


@pytest.mark.parametrize("size", [1, 40, 4095, 4096, 60000])
def test_sets(size):
    rng = np.random.default_rng(size)
    members = {(r, p): np.sort(rng.choice(1 << 16, max(1, size // (p + 1)), replace=False)) for r in range(3) for p in range(r + 1)}
    keys = np.array([(r, p, m) for (r, p), own in members.items() for m in own])
    keys = keys[rng.permutation(len(keys))]
    column = encode(*keys.T, np.array([1, 2, 3]))
    sets = Sets(column)
    of, low = sets.members()
    found = {(int(sets.row[s]), int(sets.plane[s])): np.sort(low[of == s]) for s in np.unique(of)}
    assert found.keys() == members.keys() and all(np.array_equal(found[k], members[k]) for k in found)
    documents, links = sets.totals()
    assert documents.tolist() == [len(members[r, 0]) for r in range(3)]
    assert links.tolist() == [sum(len(members[r, p]) << max(p - 1, 0) for p in range(r + 1)) for r in range(3)]
    union = Sets(merge(pa.concat_arrays([column, column.slice(1)]).take(pa.array([0, 1, 3, 2, 4])), np.array([0, 1, 1, 2, 2])))
    assert union.totals()[1].tolist() == links.tolist()
