"""Each query over the small tables against its plain version."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import queries


@pytest.fixture(scope="module")
def docs(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, columns):
    return {tuple(r) for r in df.select(*columns.split()).collect()}


def test_op2(spark, small, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert rows(queries.op2_decontaminate(spark, small), "doc_id n_words n_hit n_items items_sha256 contaminated") == brute.op2(docs, bench)


def test_op4(spark, small, docs):
    assert rows(queries.op4_huffman_tokens(spark, small), "doc_id start n_tokens ids_crc32") == brute.op4(docs, queries.tokenizer_path())


def test_op6(spark, small, docs):
    assert rows(queries.op6_license_join(spark, small), "doc_id n_words n_base first_word last_word base_labels") == brute.op6(docs)


def test_op9(spark, small, docs):
    assert rows(queries.op9_ngram_join(spark, small), "doc_id n_shingles component_id") == brute.op9(docs)


def test_op10(spark, small):
    vectors = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute.op10(vectors), {}
    for r in queries.op10_multi_index(spark, small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_pipeline(spark, small):
    """Every stage against its plain version on its own input."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    stage = {n: f for n, f in corpus_pipeline.STAGES}
    kept = stage["toxicity"](spark, table, small).persist()
    assert kept.columns == table.columns
    pairs = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    one = stage["near_duplicates"](spark, kept, small).persist()
    assert one.columns == table.columns and {r.doc_id for r in one.collect()} == {d for d, _, c in brute.op9(pairs) if d == c}
    pairs = [tuple(r) for r in one.select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = stage["benchmark_passages"](spark, one, small).persist()
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {w[0] for w in brute.op2(pairs, bench) if not w[5]}
    mixed = stage["source_mix"](spark, clean, small).persist()
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == table.columns and set(times.values()) <= {1, 2}
    size, target = brute.op5([tuple(r) for r in clean.select("doc_id", "source", "text").collect()])
    assert abs(sum(size[d] * n for d, n in times.items()) - sum(t for _, t in target.values())) < 0.1 * sum(t for _, t in target.values())
    last = stage["token_files"](spark, mixed, small)
    text = [tuple(r) for r in mixed.select("doc_id", "text").collect()]
    assert rows(last, "doc_id n_tokens") == {(d, n) for d, _, n, _ in brute.op4(text, queries.tokenizer_path())} and last.count() == len(text)
    assert last.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == last.agg(F.sum("n_tokens")).first()[0]
