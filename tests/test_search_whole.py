"""Search scores whole chunks where they are: only the best of each task leave it."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslens import queries
from corpuslens.functions import text as T
from corpuslens.operators import index, retrieve
from corpuslens.plans import decision

K1, B = 1.5, 0.75


def table(spark, rows):
    made = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_no int, tokens array<string>")
    return made.withColumn("chunk_ord", F.struct("doc_id", "chunk_no")).repartition(3)


def brute(questions, rows, k):
    n, avgdl, df = len(rows), sum(len(r[3]) for r in rows) / len(rows), defaultdict(int)
    for r in rows:
        for t in set(r[3]):
            df[t] += 1
    out = {}
    for q, terms in questions:
        found = []
        for chunk, doc, no, tokens in rows:
            hit = [t for t in set(terms) if t in tokens]
            score = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tokens.count(t) * (K1 + 1) / (tokens.count(t) + K1 * (1 - B + B * len(tokens) / avgdl)) for t in hit)
            if hit:
                found.append((-round(score, 6), (doc is not None, doc or "", no), chunk, sorted(hit)[:8]))
        out |= {(q, i + 1): (c, -s, h) for i, (s, _, c, h) in enumerate(sorted(found)[:k])}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    """Copies tie, documents may lack an id, questions come in blocks and scores in parts."""
    monkeypatch.setattr(retrieve, "BLOCK", 2)
    monkeypatch.setattr(retrieve, "CELLS", 40)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"c{i}", None if i == 7 else str(i % 40), i // 40, rng.choices(words, k=rng.randrange(6))) for i in range(150)]
    rows += [(f"d{i}", f"9{i}", 0, ["w1", "w2", "w3"]) for i in range(60)]
    questions = [(q, rng.sample(words, rng.randrange(1, 9))) for q in range(7)]
    asked = spark.createDataFrame(questions, "query_id long, expanded_tokens array<string>")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score, r.match_terms) for r in retrieve.search(asked, index.build(table(spark, rows), keep=False), 5).collect()}
    want = brute(questions, rows, 5)
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert all(abs(got[x][1] - want[x][1]) < 2e-6 and got[x][2] == want[x][2] for x in want)


def test_search_deals_no_pairs(spark):
    """One exchange, that of the best: neither postings nor pairs of question and chunk are dealt."""
    rows = [(f"c{i}", str(i), 0, ["a", "b"]) for i in range(20)]
    found = retrieve.search(spark.createDataFrame([("q", ["a", "b"])], "query_id string, expanded_tokens array<string>"), index.build(table(spark, rows), keep=False))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_guarded_stops(spark):
    said = ["See Fig. A. B", "i.e.g. X. Y", "e.g. X vs. Y et al. Z", "Max max. Min"]
    got = spark.createDataFrame([(s,) for s in said], "t string").select("t", T.sentences(F.col("t")).alias("s"))
    assert {r.t: r.s for r in got.collect()} == {"See Fig. A. B": ["See Fig. A.", "B"], "i.e.g. X. Y": ["i.e.g.", "X.", "Y"], "e.g. X vs. Y et al. Z": ["e.g. X vs. Y et al. Z"], "Max max. Min": ["Max max. Min"]}


def test_only_named_documents_are_read_into_words(spark, small):
    """Reranking chooses documents by the hits before it cuts texts into words; tables of tokens are dropped after the search."""
    from pathlib import Path

    hits = spark.createDataFrame([(1, 3)], "query_id long, chunk_id long")
    assert [r.doc_id for r in queries._docs(spark, small, hits).collect()] == [3]
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("table-*"))
    assert queries._staged_hits(spark, small, 5).count() > 0
    assert set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("table-*")) == before


def test_gaps_read_nothing_that_was_dropped(spark, small):
    """The gaps are computed after the table of chunks is gone: hits, evidence and the number of chunks are staged."""
    gaps = queries.knowledge_gaps(spark, small)
    assert not [f for f in gaps.inputFiles() if "/table-" in f]
    assert gaps.count() == spark.read.parquet(f"{small}/benchmark.parquet").count()


def test_table_of_chunks_holds_no_texts(spark, small, monkeypatch):
    """What is written to disk of chunks is what search reads."""
    written = []
    monkeypatch.setattr(decision, "tabled", lambda df: written.append(df.columns) or df)
    queries.knowledge_gaps(spark, small)
    assert written == [["chunk_id", "chunk_ord", "tokens"]]


def test_documents_cut_again_give_the_same_decisions(spark):
    """Documents of hits are found by their ids, also where ids repeat or are missing."""
    rng = random.Random(5)
    words = ["kidney", "compound", "alpha", "results", "tissue", "method", "however", "trial"]
    said = lambda: " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(rng.randrange(40)))
    docs = spark.createDataFrame([(None if i % 9 == 0 else str(i % 50), f"T{i}", said()) for i in range(60)], "doc_id string, title string, text string").repartition(3).persist()
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(6)], "query_id long, text string")
    table = decision.corpus(docs, table=True)
    got, want = decision.decide(asked, table, documents=docs), decision.decide(asked, decision.corpus(docs))
    rows = [sorted(r.json for r in decision.as_json(x).collect()) for x in (got, want)]
    assert rows[0] == rows[1] and '"evidence":[{' in rows[0][0]


def test_sections_by_their_first_words(spark):
    said = ["Abstract. A", "abstracts", "BACKGROUND x", "Materials  and methods", "material", "methodical", " Results", "x\nResults", "Discussions", "Concluded", "Conclusion", "Bibliography", "Appendix", "", None, "Body"]
    got = [r.s for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").orderBy("i").select(T.section(F.col("t")).alias("s")).collect()]
    assert got == ["Abstract", "Body", "Introduction", "Methods", "Body", "Methods", "Results", "Body", "Discussion", "Body", "Conclusion", "References", "Supplementary", "Body", "Body", "Body"]
