import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from backhaul.llm.bpe_automaton import encode_documents, word_bpe
from backhaul.llm.byte_bpe import byte_bpe
from backhaul.llm.packing import balance, pack, sequence_lengths
from backhaul.llm.token_rollup import TokenRollup, count_tokens, op5_token_counts

from llm_texts import ODD_TEXTS

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def random_texts(n: int) -> list[str]:
    pick = random.Random(7)
    plain = "ab'srelvtmdthino  \n\t1²é!.,日'AEΣİ"
    wide = [*map(chr, range(0x20, 0x250)), *map(chr, range(0x370, 0x600)), *map(chr, range(0x1F600, 0x1F640))]
    texts = ["".join(pick.choice(plain) for _ in range(pick.randrange(60))) for _ in range(n)]
    return texts + ["".join(pick.choice(wide) for _ in range(pick.randrange(40))) for _ in range(n)]


TEXTS = [t or "" for t in ODD_TEXTS] + ["aaaa aaaaa aaaaaaaaaaaa", "hahahaha", "Σας ΟΔΟΣ", "é Å", "Ᲊx"] + random_texts(800)


def test_byte_ids_are_the_librarys():
    library = Tokenizer.from_file(BYTES)
    ids, bounds = byte_bpe(BYTES).encode(TEXTS)
    for i, text in enumerate(TEXTS):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert byte_bpe(BYTES).encode([])[1].tolist() == [0]


def test_automaton_encodes_and_decodes_as_the_library():
    library = Tokenizer.from_file(WORDS)
    for text, (n, ids, decoded) in zip(TEXTS, word_bpe(WORDS).encode_and_decode(TEXTS), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, expected)) and n == len(expected), repr(text)
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_encode_documents(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    expected = []
    for doc, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        expected.append((doc, len(ids), *sha))
    found = [tuple(r) for r in encode_documents(odd_docs, WORDS).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert encode_documents(no_docs, WORDS).count() == 0


def test_sequences_add_up():
    assert sequence_lengths(0, 1024).tolist() == []
    assert sequence_lengths(2 * 1024 + 77, 1024).tolist() == [1024, 1024, 64, 8, 4, 1]


def test_balance_fills_every_sequence_and_evens_out_cost():
    lengths = np.random.default_rng(1).integers(1, 1024, 800)
    pieces = balance(lengths, 1024, 1.0, 1 / 1024)
    room = sequence_lengths(int(lengths.sum()), 1024)
    used, cost, of_item = np.zeros(len(room), int), np.zeros(len(room)), defaultdict(int)
    for item, start, n, to, offset in pieces:
        assert offset == used[to] and start == of_item[item] and n > 0
        used[to] += n
        cost[to] += n + n * n / 1024
        of_item[item] += n
    assert (used == room).all() and all(of_item[i] == n for i, n in enumerate(lengths))
    full = cost[room == 1024]
    in_order = [lengths[i : i + 2] for i in range(0, 800, 2)]  # first come, first served
    assert full.std() < np.std([(x + x * x / 1024).sum() for x in in_order])
    assert len(pieces) < 1.5 * len(lengths)


def test_pack(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    found = pack(odd_docs, BYTES, block=8).toPandas()
    sums = found.groupby("sequence_id").length.sum()
    assert ((sums == 1024) | (sums & (sums - 1) == 0)).all()
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
    texts = {(r["doc_id"]): r["text"] or "" for r in odd_docs.collect() if r["doc_id"] is not None and r["doc_id"] != 3}
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = found[found.doc_id == doc].sort_values("start")
        at = 0
        for piece in own.itertuples():
            part = np.array(ids[at : at + piece.length], "<u4")
            assert (piece.start, piece.doc_tokens, piece.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += piece.length
        assert at == len(ids)
    assert found[found.doc_id.isna()].length.sum() > 0
    assert found[found.doc_id == 3].length.sum() == 2 * found[found.doc_id == 3].doc_tokens.iloc[0]
    assert pack(no_docs, BYTES).count() == 0


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_rollup_equals_a_recount(spark, tmp_path):
    schema = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long"
    rollup = TokenRollup(spark, str(tmp_path))
    pick, state = random.Random(3), {}
    for batch in range(1, 5):
        rows = []
        for doc in pick.sample(range(40), 25):
            op = pick.choice(["insert", "revise", "delete"])
            put = (pick.choice(["a", None]), pick.choice(["en", "de", None]), pick.randrange(9)) if op != "delete" else (None,) * 3
            rows.append((doc, pick.choice(["v1", "v2"]), op, *put))
        rows += rows[:3]  # sent twice within the batch
        changes = spark.createDataFrame(rows, schema)
        assert rollup.apply(batch, changes)
        assert not rollup.apply(batch, changes)
        for doc, version, op, source, lang, n in rows:
            state.pop((doc, version), None)
            if op != "delete":
                state[doc, version] = (source, lang, n)
        expected = defaultdict(lambda: [0, 0])
        for (_, version), (source, lang, n) in state.items():
            expected[source, lang, version][0] += 1
            expected[source, lang, version][1] += n
        assert totals(rollup) == {k: tuple(v) for k, v in expected.items()}


def test_rollup_writes_an_unfinished_batch_anew(spark, tmp_path):
    schema = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long"
    rollup = TokenRollup(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "v", "insert", "s", "en", 5), (None, "v", "insert", "s", "en", 2)], schema)
    assert rollup.committed() == [] and totals(rollup) == {}
    rollup.apply(1, rows)
    (tmp_path / "sums" / "batch-000000001" / "_SUCCESS").rename(tmp_path / "marker")
    assert rollup.committed() == [] and totals(rollup) == {}
    assert rollup.apply(1, rows)
    assert totals(rollup) == {("s", "en", "v"): (2, 7)}
    rollup.apply(2, rows.limit(0))
    changed = rows.where("doc_id is null").withColumn("n_tokens", F.lit(9).cast("long"))
    rollup.apply(3, changed)
    assert totals(rollup) == {("s", "en", "v"): (2, 14)}


def test_token_counts(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    rows = count_tokens(odd_docs, BYTES, ["row", "fp"]).collect()
    texts = {r["fp"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["n_tokens"] == len(library.encode(texts[r["fp"]], add_special_tokens=False).ids)
    assert count_tokens(no_docs, BYTES, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken"])
def test_rank_files(name):
    import base64

    import tiktoken

    path = public_tokenizers.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe(path).count(TEXTS).tolist() == [len(plain.encode_ordinary(t)) for t in TEXTS]


def test_documents_that_share_an_id_or_have_none(spark, tmp_path):
    schema = "doc_id long, row long, tokenizer string, op string, source string, lang string, n_tokens long"
    rows = [(None, 1, "v", "insert", "s", "en", 10), (None, 2, "v", "insert", "s", "en", 7), (1, 3, "v", "insert", "s", "en", 5), (1, 4, "v", "insert", "s", "fr", 9)]
    rollup = TokenRollup(spark, str(tmp_path))
    rollup.apply(1, spark.createDataFrame(rows, schema))
    assert totals(rollup) == {("s", "en", "v"): (3, 22), ("s", "fr", "v"): (1, 9)}
    rollup.apply(2, spark.createDataFrame([(None, 2, "v", "delete", None, None, None), (1, 4, "v", "revise", "s", "fr", 2)], schema))
    assert totals(rollup) == {("s", "en", "v"): (2, 15), ("s", "fr", "v"): (1, 2)}


def test_compaction_and_other_changes_under_one_number(spark, tmp_path):
    schema = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long"
    rollup = TokenRollup(spark, str(tmp_path))
    rollup.compact()
    for n in range(1, 4):
        rollup.apply(n, spark.createDataFrame([(i, "v", "insert", "s", "en", n) for i in range(n, n + 5)], schema))
    before = totals(rollup)
    rollup.compact()
    assert totals(rollup) == before == {("s", "en", "v"): (7, 1 + 2 + 3 * 5)}
    again = spark.createDataFrame([(i, "v", "insert", "s", "en", 2) for i in range(2, 7)], schema)
    assert not rollup.apply(2, again.repartition(3))
    with pytest.raises(ValueError):
        rollup.apply(2, again.limit(4))
    rollup.apply(4, spark.createDataFrame([(3, "v", "delete", None, None, None), (1, "v", "revise", "s", "en", 9)], schema))
    assert totals(rollup) == {("s", "en", "v"): (6, 9 + 2 + 3 * 4)}
    rollup.compact()
    assert totals(rollup) == {("s", "en", "v"): (6, 9 + 2 + 3 * 4)}


def test_query_equals_a_recount(spark, folder):
    import base64

    import tiktoken

    library = Tokenizer.from_file(BYTES)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    multi = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    least = {}
    for r in rows:
        least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    expected = defaultdict(lambda: [0, 0])
    changed = 0
    for r in rows:
        text = r["text"] or ""
        if least[text] != r["doc_id"]:
            continue
        if r["lang"] == "en":
            changed += "\n" in text
            text = text.replace("\n", " ")
            name, n = "byte_bpe_50k", len(library.encode(text, add_special_tokens=False).ids)
        else:
            name, n = "byte_bpe_multi_50k", len(multi.encode_ordinary(text))
        expected[r["source"], r["lang"], name][0] += 1
        expected[r["source"], r["lang"], name][1] += n
    found = {tuple(r)[:3]: tuple(r)[3:] for r in op5_token_counts(spark, folder).collect()}
    assert found == {k: tuple(v) for k, v in expected.items()} and changed > 20
