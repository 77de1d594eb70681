"""Ingestion, vectors, fusion with a store, answers of models, the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from corpuslens import api, cli
from corpuslens.operators import dense, retrieve, synthesize
from corpuslens.plans import decision
from corpuslens.sources import markup, store

TEXT = "Abstract The first sentence says how the kidney reacts to the new compound in detail. Results A second one reports p < 0.001 for the main end point of the trial. Discussion The third explains what follows from both of them."


def xml(spark, *records):
    return spark.createDataFrame([(r,) for r in records], "xml string")


def test_text_with_marks_inside(spark):
    record = "<article><front><article-id pub-id-type='pmid'>4</article-id><article-title>On <b>x</b></article-title><abstract><p>IL-<italic>6</italic> and H<sub>2</sub>O</p><p>next</p></abstract></front><body><sec><title>Of <i>y</i></title><p>a <b>b</b><xref ref-type='bibr' rid='r'>3</xref> c</p></sec></body></article>"
    row = markup.jats_papers(xml(spark, record)).first()
    assert (row.doc_id, row.title, row.text) == ("pmid_4", "On ", "Abstract\nIL-6 and H2O\nnext\n\n\nOf\na b c") and row.metadata["has_full_text"] == "true"
    only = markup.jats_papers(xml(spark, "<article><abstract><title>T</title>bare</abstract></article>")).first()
    assert only.text == "Abstract\nTbare" and only.title == "No title" and only.doc_id.startswith("pmc_unknown_") and only.metadata["has_full_text"] == "false"


def test_broken_records_are_rows(spark):
    for kind, good in (("pubmed", "<PubmedArticle><PMID>7</PMID><ArticleTitle>A</ArticleTitle></PubmedArticle>"), ("pmc", "<article><abstract><p>x</p></abstract></article>")):
        rows = markup.parsed(xml(spark, good, "<article><p>open", None, "no mark-up"), kind)
        assert markup.papers(rows).count() == 1
        assert [(r.stage, bool(r.identifier), bool(r.reason)) for r in markup.errors(rows).collect()] == [(f"{kind}_parse", True, True)] * 3


def test_ingest(spark):
    pmids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("1",)], "pmid string")
    links = markup.pmc_links(spark.createDataFrame([("1", '{"linksets":[{"linksetdbs":[{"dbto":"pmc","links":["9"]}]}]}'), ("2", '{"linksets":[{}]}'), ("3", "broken"), ("4", '{"linksets":[{"linksetdbs":[{"dbto":"pmc","links":["8"]}]}]}')], "pmid string, json string"))
    full = markup.parsed(xml(spark, "<article><article-id pub-id-type='pmc'>PMC9</article-id><body><sec><p>whole</p></sec></body></article>", "<article>"), "pmc")
    abstracts = markup.parsed(xml(spark, *(f"<PubmedArticle><PMID>{i}</PMID><AbstractText>short {i}</AbstractText></PubmedArticle>" for i in (1, 2, 4))), "pubmed")
    papers, errors = store.ingest(pmids, links, markup.papers(full), markup.papers(abstracts), markup.errors(full).unionByName(markup.errors(abstracts)))
    assert {(r.doc_id, r.text) for r in papers.collect()} == {("pmc_PMC9", "whole"), ("pmid_2", "Abstract\nshort 2"), ("pmid_4", "Abstract\nshort 4")}
    assert sorted((r.stage, r.identifier) for r in errors.where("stage <> 'pmc_parse'").collect()) == [("fetch", "3"), ("link", "3")] and errors.where("stage = 'pmc_parse'").count() == 1


def test_vectors_are_added_once_and_of_one_length(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    assert store.upsert_vectors(rows, f"{tmp_path}/v", 2) == 2 and store.upsert_vectors(rows, f"{tmp_path}/v", 2) == 0
    with pytest.raises(ValueError):
        store.upsert_vectors(rows, f"{tmp_path}/v", 3)


def test_embeddings_are_cached(spark):
    texts = spark.createDataFrame([("x",), ("yy",), ("x",)], "text string")
    model = lambda some: [[float(len(t))] for t in some]
    first = dense.embed(texts, model).persist()
    assert sorted(r.vector for r in first.collect()) == [[1.0], [2.0]]
    kept = first.withColumn("vector", F.array(F.lit(9.0)))  # what the cache says counts, not the model
    more = dense.embed(texts.union(spark.createDataFrame([("zzz",)], texts.schema)), model, kept)
    assert sorted(r.vector for r in more.collect()) == [[3.0], [9.0], [9.0]]


def test_fusion_leaves_out_chunks_that_are_gone(spark):
    side = lambda *ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    kept = spark.createDataFrame([("c1",), ("c3",)], "chunk_id string")
    assert [(r.chunk_id, r["rank"]) for r in retrieve.fuse(side("c1"), side("gone", "c3"), store=kept).orderBy("rank").collect()] == [("c1", 1), ("c3", 3)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("d1", "One", TEXT, {"k": "v"}), ("d2", "Two", "Abstract Quite another matter is told here, which has to do with bridges and their arches alone. Results They stand.", {"k": "v"})], api.DOCUMENT)


def test_hybrid_engine(spark, documents):
    engine = api.Engine(spark, decision.Config(dense=dense.hash_topk))
    engine.add_documents(documents)
    out = engine.query("How does the kidney react to the compound?")
    assert out["evidence"][0]["doc_title"] == "One"
    ranks = decision.rankings(spark.createDataFrame([("q", "kidney compound")], "query_id string, text string"), engine.index, hybrid=True)
    assert list(ranks) == ["bm25", "reranked", "dense", "hybrid", "hybrid_reranked"] and all(r.count() for r in ranks.values())


def test_models_write_and_fail(spark, documents):
    engine = api.Engine(spark)
    engine.add_documents(documents)
    asked = spark.createDataFrame([("a", "kidney compound"), ("b", "bridges arches"), ("c", "zzzz")], "query_id string, text string")
    plain = {r.query_id: r for r in engine.query_batch(asked).collect()}

    def write(prompt):
        if "bridges" in prompt.split("Excerpts")[0]:
            raise RuntimeError("not today")
        return "written " + str("Excerpts" in prompt)

    got = {r.query_id: r for r in synthesize.written(engine.query_batch(asked), write).collect()}
    assert got["a"].answer == "written True" and got["b"] == plain["b"] and got["c"] == plain["c"] and got["a"].reasoning_chain == plain["a"].reasoning_chain


def test_command_line(spark, documents, tmp_path, monkeypatch, capsys):
    documents.where("doc_id = 'd1'").write.parquet(f"{tmp_path}/corpus")
    documents.unionByName(documents.withColumn("doc_id", F.lit("d3"))).write.parquet(f"{tmp_path}/new")
    base = ["--corpus", f"{tmp_path}/corpus"]
    assert cli.main([*base, "--ingest", f"{tmp_path}/new", "--ingest-max", "2", "--save-corpus", "--stats"]) == 0
    said = capsys.readouterr().out
    assert "1 added" in said and json.loads(said.split("added", 1)[1])["n_documents"] == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("kidney compound\nstats\nquit\nnever asked\n"))
    assert cli.main([*base, "--show-prompt"]) == 0
    said = capsys.readouterr().out
    assert "Question: kidney compound" in said and '"n_documents": 2' in said and "never asked" not in said


def test_background_ingestion(spark, documents):
    import time

    engine = api.Engine(spark)
    none = spark.createDataFrame([("fetch", "5", "no text")], "stage string, identifier string, reason string")
    jobs = [engine.ingest("kidney", lambda q, n: (documents.limit(n), none), 2), engine.ingest("bad", lambda q, n: 1 / 0)]
    for job in jobs:
        while engine.ingest_status(job)["status"] == "running":
            time.sleep(0.2)
    assert engine.ingest_status(jobs[0])["indexed"] == 2 and engine.ingest_status(jobs[0])["errors"][0]["identifier"] == "5"
    assert engine.ingest_status(jobs[1])["status"] == "failed" and "zero" in engine.ingest_status(jobs[1])["error"]
    with pytest.raises(KeyError):
        engine.ingest_status("none")
