import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from backhaul.llm.queries import oracle_sql, queries
from backhaul.session import scratch_root
from backhaul.sources import list_files
from checks.compare import compare, connect

NATIVE = ("op3_exact_dedup", "op6_license_scan", "op9_url_filter")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    rows, problem = compare(spark, connect(folder), queries()[name], oracle_sql()[name], folder)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, folder, name):
    plan = queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def expected_documents(rows):
    """What the first three stages keep, told plainly."""
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    last = {}
    for doc, text in rows:
        if doc is not None:
            last[text] = max(doc, last.get(text, doc))
    rows = [(d, t) for d, t in rows if d is None or d == last[t]]
    prints = {d: plain_fingerprint(t) for d, t in rows if d is not None}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    first = components(sorted(prints), pairs)
    return [(d, t) for d, t in rows if d is None or first[d] == d]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(10_000, None), (10_001, "12 3 !"), (10_002, ""), (10_003, "Zwölf Boxkämpfer"), (10_004, "zwölf boxkämpfer")]
    extra = spark.createDataFrame([(d, t, None, "src", 0) for d, t in extra], docs.schema)
    docs = docs.unionByName(extra)
    docs = docs.withColumn("row", docs["source"]).withColumn("fp", docs["doc_id"])
    expected = expected_documents([(r["doc_id"], r["text"]) for r in docs.collect()])
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.columns == columns
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(expected)
    assert 10_003 in {d for d, _ in expected} and 10_004 not in {d for d, _ in expected}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id").sum("length").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in expected}
    assert {r["doc_id"]: r["sum(length)"] for r in packed} == tokens


def test_stages_of_odd_and_of_no_documents(spark, odd_docs, tmp_path):
    for docs in (odd_docs, odd_docs.limit(0)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{docs.isEmpty()}-{n}-{id(docs)}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_copies_go_by_row(spark, tmp_path):
    first, second = "One text about the sea and the ships on it", "Another text, on mountains and on what grows there"
    rows = [(9, first), (7, first), (7, second), (7, second), (None, first), (None, "Only here"), (None, "Only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(7, second), (9, first), (None, "Only here")]
    for stage in (corpus_pipeline.without_copies, corpus_pipeline.without_near_copies):
        near = stage is corpus_pipeline.without_near_copies
        path = str(tmp_path / str(near))
        docs.write.parquet(path)
        for given in (docs, spark.read.parquet(path)):
            found = [tuple(r) for r in stage(spark, given, "").collect()]
            assert sorted(found, key=str) == sorted([(7, first) if near and r[0] == 9 else r for r in expected], key=str)


def test_no_labels_drop_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "1 2", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.with_language(spark, docs, "").collect()] == [1]


def test_missing_languages_are_named(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    lacking = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.with_language(spark, lacking, folder).collect()}
    assert all(found[i] == truth[i] for i in found if i % 3)
    named = [found[i] == truth[i] for i in found if i % 3 == 0]
    assert len(named) > 30 and sum(named) / len(named) > 0.95


def test_pieces_carry_their_ids(spark, odd_docs):
    for r in corpus_pipeline.packed(spark, odd_docs, "").collect():
        data = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert len(r["ids"]) == r["length"] and zlib.crc32(data) == r["ids_crc32"]


def test_run_leaves_its_last_stage_only(spark, folder):
    before = {n for n in list_files(spark, scratch_root(spark)) if n.startswith("pipeline-")}
    corpus_pipeline.run(spark, folder)
    after = {n for n in list_files(spark, scratch_root(spark)) if n.startswith("pipeline-")} - before
    assert len(after) == 1 and next(iter(after)).startswith("pipeline-packing-")
