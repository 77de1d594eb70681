"""Registered queries over the driver's tables; oracles.py has the same in SQL.

Documents have no titles, so theirs are their ids; a document is one chunk where the SQL has to build the index itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dense, evidence, index, metrics, rerank, retrieve, synthesize
from .plans import decision
from .sources import markup, store
from .sources.store import staged

long = "long"
#: Passages that a search for them in all texts may hold.
BENCH_BYTES = 64 << 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in fewer scan partitions than there are cores are dealt to all cores, as one row group is one task."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name == "documents" and table.rdd.getNumPartitions() < cores else table


def _docs(spark, d, hits: DataFrame | None = None) -> DataFrame:
    """Documents as chunks of one; only those that hits name, which are chosen before their texts are looked at."""
    docs = _t(spark, d, "documents")
    docs = docs if hits is None else retrieve.named(docs.withColumn("chunk_id", F.col("doc_id")), hits)
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("doc_id").cast("string").alias("title"), F.lit("Body").alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("chunk_ord"), T.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))


def _questions(spark, d) -> DataFrame:
    return decision.analyzed(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _index(spark, d) -> index.Index:
    return index.build(_docs(spark, d).select("chunk_id", "chunk_ord", "tokens"))


def _hits(spark, d, k: int = 15) -> DataFrame:
    return retrieve.search(_questions(spark, d), _index(spark, d), k)


def _staged_hits(spark, d, k: int) -> DataFrame:
    """Hits that are computed here, from tokens that are a table until then."""
    of = index.build(store.tabled(_docs(spark, d).select("chunk_id", "chunk_ord", "tokens")), keep=False)
    hits = staged(retrieve.search(_questions(spark, d), of, k))
    store.drop(of.chunks)
    return hits


def _qrels(spark, d) -> DataFrame:
    """Documents that hold a benchmark passage: all passages, as many as fit in BENCH_BYTES, are looked for in one pass over the texts."""
    bench = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")).where("passage IS NOT NULL")
    if (bench.agg(F.sum(F.length("passage"))).first()[0] or 0) > BENCH_BYTES:
        raise ValueError("the benchmark is too large to go to all tasks")
    found = _t(spark, d, "documents").select("doc_id", "text").join(F.broadcast(bench), F.contains("text", F.col("passage")))
    return found.select(F.col("item_id").alias("query_id"), "doc_id", F.lit(2).alias("grade")).distinct()


def _reranked(spark, d, k: int = 5, hits: DataFrame | None = None) -> DataFrame:
    q = _questions(spark, d).select("query_id", "intent", "expanded_tokens", F.col("tokens").alias("query_tokens"))
    hits = staged(_hits(spark, d)) if hits is None else hits
    return rerank.rerank(hits.select("query_id", "chunk_id", "score", "rank").join(q, "query_id").join(_docs(spark, d, hits).drop("chunk_ord"), "chunk_id"), k)


def tokenize_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size("tokens").cast(long).alias("n_tokens"), F.size(F.array_distinct("tokens")).cast(long).alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def clean_text_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"))


def sentence_split(spark, d):
    s = T.sentences(T.clean_text(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", F.size(s).cast(long).alias("n_sentences"), F.md5(F.array_join(s, "\n")).alias("sentences_md5"))


def truncate_excerpt(spark, d):
    clean = _t(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c"))
    return clean.select("doc_id", F.md5(T.truncate(F.col("c"), 400)).alias("excerpt_md5"), F.length(T.truncate(F.col("c"), 400)).cast(long).alias("n_chars"))


HEADS = ["Abstract", "BACKGROUND", "Materials and methods", "Resulting", "Discussion", "conclusions", "Bibliography", "Appendix", "Body", "methodological"]


def section_detect(spark, d):
    """Documents with a heading in front that their id chooses."""
    head = F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    return _t(spark, d, "documents").select(T.section(F.concat(head, F.lit(" "), F.coalesce("text", F.lit("")))).alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def chunk_documents(spark, d):
    from .operators.chunking import chunk

    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), "text")
    return chunk(docs).select("chunk_id", "doc_id", "section", "page", "char_start", "char_end", F.length("text").cast(long).alias("n_chars"), F.size("tokens").cast(long).alias("n_tokens"))


def term_freq_top(spark, d):
    return _index(spark, d).postings.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(100)


def doc_freq(spark, d):
    return _index(spark, d).vocab.select("term", "df")


def vocab_stats(spark, d):
    return index.index_stats(_index(spark, d))


def corpus_stats_by_lang(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(T.tokenize(F.col("text")))).alias("n_tokens"))


def _user_turns(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def intent_classify(spark, d):
    return _user_turns(spark, d).select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def entity_extract(spark, d):
    e = T.entities(F.col("text"))
    return _user_turns(spark, d).select("conv_id", "turn", F.size(e).cast(long).alias("n_entities"), F.array_join(e, "|").alias("entities"))


def abbrev_expand(spark, d):
    t = T.expanded(T.tokenize(F.col("text")))
    return _user_turns(spark, d).select("conv_id", "turn", F.array_join(t, " ").alias("expanded"))


def bm25_topk(spark, d):
    return _hits(spark, d).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast(long).alias("rank"), "score", F.array_join("match_terms", " ").alias("match_terms"))


def bm25_prefix_fallback(spark, d):
    """Questions of one unknown term each: a benchmark item's terms with qq at their end."""
    terms = _questions(spark, d).select("query_id", F.transform("expanded_tokens", lambda t: F.concat(t, F.lit("qq"))).alias("expanded_tokens"))
    return retrieve.search(terms, _index(spark, d), 10).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast(long).alias("rank"), "score", F.array_join("match_terms", " ").alias("match_terms"))


def dense_topk(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return dense.cosine_topk(q, v, 10).select("query_id", F.col("rank").cast(long).alias("rank"), F.col("chunk_id").alias("vec_id"), F.round("score", 5).alias("score"))


def hash_embed(spark, d):
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return dense.hash_embed(b).select(F.col("id").alias("item_id"), F.col("bucket").cast(long).alias("bucket"), F.round("weight", 6).alias("weight"))


def _hash_hits(spark, d, k: int = 15) -> DataFrame:
    return dense.hash_topk(_questions(spark, d), _docs(spark, d), k)


def hash_dense_topk(spark, d):
    return _hash_hits(spark, d).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast(long).alias("rank"), "score")


def rrf_fusion(spark, d):
    return retrieve.fuse(_hits(spark, d), _hash_hits(spark, d)).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast(long).alias("rank"), "score")


def rerank_scores(spark, d):
    return _reranked(spark, d).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast(long).alias("rank"), F.col("first_rank").cast(long).alias("first_rank"), "score")


EVIDENCE_HEADS = ["These results demonstrate a change. ", "However, it did fail and was not seen. ", "Odds ratio OR = 2.5 (95% CI) in 12.5% of Alpha Beta. ", "In 1987 Gamma was described. ", ""]


def _marked(spark, d) -> DataFrame:
    """Documents with a sentence in front that their id chooses."""
    head = F.element_at(F.array(*(F.lit(h) for h in EVIDENCE_HEADS)), (F.col("doc_id") % len(EVIDENCE_HEADS) + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def support_type(spark, d):
    return _marked(spark, d).select("doc_id", T.support_type(F.col("text")).alias("support_type"))


def key_terms(spark, d):
    return _marked(spark, d).select("doc_id", F.array_join(T.key_terms(F.col("text"), F.array(F.lit("alpha"), F.lit("the"), F.lit("results"))), "|").alias("key_terms"))


def relevance_norm(spark, d):
    return _hits(spark, d).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), evidence.relevance(F.col("score")).alias("relevance"))


def _confidence_rows(spark, d) -> DataFrame:
    return _reranked(spark, d).select("query_id", T.support_type(F.col("text")).alias("kind"), evidence.relevance(F.col("score")).alias("relevance"))


def confidence_scores(spark, d):
    n, direct, indirect, against = F.count(F.lit(1)), F.count_if(F.col("kind") == "direct"), F.count_if(F.col("kind") == "indirect"), F.count_if(F.col("kind") == "contradictory")
    rows = _confidence_rows(spark, d).groupBy(F.col("query_id").alias("item_id")).agg(n.alias("n"), direct.alias("direct"), indirect.alias("indirect"), against.alias("against"), F.avg("relevance").alias("average"))
    overall = synthesize.overall_confidence(F.col("n"), F.col("direct"), F.lit(0))
    return rows.select("item_id", "n", "direct", F.round(synthesize.assessment_confidence(F.col("n"), F.col("direct"), F.col("indirect")), 4).alias("assessment"), F.round(synthesize.synthesis_confidence(F.col("average"), F.col("n"), F.col("direct"), F.col("against")), 4).alias("synthesis"), F.round(overall, 3).alias("overall"), synthesize.label(overall).alias("label"))


def common_terms(spark, d):
    rows = _reranked(spark, d).select("query_id", T.key_terms(F.col("text"), F.col("query_tokens")).alias("key_terms"))
    return synthesize.common_terms(rows).select(F.col("query_id").alias("item_id"), F.array_join("common", "|").alias("common"))


def _decisions(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), "text")
    corpus = decision.corpus(docs, table=True)
    made = decision.decide(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), corpus, documents=docs)
    store.drop(corpus.chunks)  # what made reads is staged
    return made


def decision_output(spark, d):
    """Every part of the decisions, lists joined."""
    of = lambda c, f: F.array_join(F.transform(c, lambda e: e[f]), "|")
    return _decisions(spark, d).select(
        F.col("query_id").alias("item_id"), "intent", "answer", "confidence", "confidence_label", of("evidence", "source_id").alias("sources"), of("evidence", "section").alias("sections"), of("evidence", "support_type").alias("support_types"),
        F.md5(of("evidence", "excerpt")).alias("excerpts_md5"), F.array_join(F.transform("evidence", lambda e: F.array_join(e["key_terms"], ",")), "|").alias("key_terms"), F.array_join("knowledge_gaps", "|").alias("gaps"), F.array_join("follow_up_questions", "|").alias("questions"),
        F.size("reasoning_chain").cast(long).alias("n_steps"), F.element_at("reasoning_chain", 2)["content"].alias("second_step"), F.round(F.element_at("reasoning_chain", 2)["confidence"], 6).alias("second_confidence"),
        F.col("sources_used").cast(long).alias("sources_used"), "total_chunks_searched",
    )


def knowledge_gaps(spark, d):
    return _decisions(spark, d).select(F.col("query_id").alias("item_id"), F.size("knowledge_gaps").cast(long).alias("n_gaps"), F.array_join("knowledge_gaps", "|").alias("gaps"))


def followups(spark, d):
    none = F.array(F.struct(F.array(F.lit("alpha"), F.lit("beta")).alias("key_terms")))
    return _user_turns(spark, d).select("conv_id", "turn", F.array_join(synthesize.follow_ups(T.intent(F.col("text")), T.entities(F.col("text")), none), "|").alias("questions"))


def _ranked(spark, d) -> DataFrame:
    return metrics.doc_ranking(_hits(spark, d).withColumnRenamed("chunk_id", "doc_id"))


def doc_maxpool(spark, d):
    """Languages by their best document."""
    of = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_id"))
    return metrics.doc_ranking(_hits(spark, d).join(of, "chunk_id")).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("lang"), "score", F.col("rank").cast(long).alias("rank"))


def mrr_at_k(spark, d):
    return metrics.reciprocal_rank(_ranked(spark, d), _qrels(spark, d), 5).select(F.col("query_id").alias("item_id"), F.round("rr", 6).alias("rr"))


def ndcg_at_k(spark, d):
    return metrics.ndcg(_ranked(spark, d), _qrels(spark, d)).select(F.col("query_id").alias("item_id"), F.col("k").cast(long).alias("k"), "ndcg")


def _modes(spark, d, depth: int = 60, keep: int = 5) -> dict[str, DataFrame]:
    """Document rankings of the five ways to answer, from candidates of one depth."""
    hits, hashed = _staged_hits(spark, d, depth), staged(_hash_hits(spark, d, depth))
    fused = staged(retrieve.fuse(hits, hashed, depth))
    hits_by = {"bm25": hits, "reranked": _reranked(spark, d, keep, hits), "dense": hashed, "hybrid": fused, "hybrid_reranked": _reranked(spark, d, keep, fused)}
    return {mode: metrics.doc_ranking(h.select("query_id", F.col("chunk_id").alias("doc_id"), "score")) for mode, h in hits_by.items()}


def eval_by_mode(spark, d):
    """Means of each metric, and how far each mode is from BM25."""
    return metrics.deltas(metrics.evaluate(_modes(spark, d), staged(_qrels(spark, d))), "bm25")


def eval_by_intent(spark, d):
    """Mean reciprocal rank of each mode by the questions' intent."""
    qrels, intents = staged(_qrels(spark, d)), _questions(spark, d).select("query_id", "intent")
    rows = [metrics.by_intent(metrics.reciprocal_rank(r, qrels, 5), intents, "rr").select(F.lit(mode).alias("mode"), "intent", "rr", "n") for mode, r in _modes(spark, d).items()]
    return reduce(DataFrame.unionAll, rows)


# Published rubric points of ten questions under two ways to write answers.
RUBRIC_ROWS = {
    "rules": {"Q01": (1, 0, 0, 0, 1, 1, 1, 1), "Q02": (1, 1, 0, 0, 0, 1, 1, 0), "Q03": (1, 0, 0, 0, 1, 1, 1, 0), "Q07": (1, 1, 0, 0, 0, 0, 0, 0), "Q08": (2, 2, 1, 1, 1, 1, 1, 1), "Q09": (2, 2, 1, 1, 1, 1, 1, 1), "Q11": (1, 2, 1, 0, 1, 1, 0, 0), "Q12": (1, 1, 0, 0, 1, 1, 0, 0), "Q13": (1, 1, 0, 0, 1, 1, 0, 0), "Q14": (1, 1, 1, 0, 1, 1, 0, 0)},
    "model": {"Q01": (1, 1, 0, 0, 1, 1, 0, 1), "Q02": (1, 1, 0, 0, 1, 1, 1, 1), "Q03": (1, 1, 1, 0, 1, 1, 0, 1), "Q07": (2, 2, 1, 0, 1, 1, 0, 1), "Q08": (2, 2, 1, 1, 1, 1, 1, 1), "Q09": (2, 2, 1, 1, 1, 1, 1, 1), "Q11": (1, 2, 1, 0, 1, 1, 0, 1), "Q12": (1, 2, 1, 0, 1, 1, 0, 0), "Q13": (1, 2, 1, 0, 1, 1, 0, 1), "Q14": (2, 2, 1, 1, 1, 1, 1, 1)},
}
_FLAT = [(s, q, *p) for s, rows in RUBRIC_ROWS.items() for q, p in rows.items()]


def _rubric(spark) -> DataFrame:
    return spark.createDataFrame(_FLAT, "system string, query_id string, " + ", ".join(f"{c} int" for c in metrics.RUBRIC))


def rubric_means(spark, d):
    return metrics.rubric_means(_rubric(spark))


def rubric_compare(spark, d):
    return metrics.rubric_compare(_rubric(spark), "rules").select("system", "query_id", F.col("total").cast(long).alias("total"), F.col("delta").cast(long).alias("delta"))


def upsert_new_docs(spark, d):
    """What the second half of the documents adds to the first, keyed by text."""
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    first, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    return store.new_rows(new, first, "k").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def _library(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents of which every third has a full text and every fifth doesn't say, and their chunks."""
    from .operators.chunking import chunk

    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), "text", F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("has_full_text"), (F.col("doc_id") % 3 == 0).cast("string"))).alias("metadata"))
    return docs, chunk(docs)


def corpus_stats(spark, d):
    return index.corpus_stats(*_library(spark, d))


def corpus_documents(spark, d):
    return index.corpus_documents(*_library(spark, d))


def html_extract(spark, d):
    h = markup.html_fields(_t(spark, d, "pages"))
    return h.select("page_id", "title", "heading", "n_links", F.md5("text").alias("text_md5"))


def json_links(spark, d):
    """Link responses made of events: the first link into PMC where the event's type has one."""
    e = _t(spark, d, "events")
    json = F.concat(F.lit('{"linksets":[{"linksetdbs":[{"dbto":"'), F.col("event_type"), F.lit('","links":["x"]},{"dbto":"pmc","links":["'), F.col("user_id").cast("string"), F.lit('","0"]}]}]}'))
    return markup.pmc_links(e.select(F.col("event_id").alias("pmid"), json.alias("json"))).select(F.col("pmid").alias("event_id"), "pmcid", "error")


def stream_ingest_counts(spark, d):
    """A stream of events run to its end, in hourly windows."""
    import uuid

    from .streaming.ingest import windowed

    source = spark.readStream.schema(_t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet" if not d.endswith("/events.parquet") else "*").parquet(d)
    name = "windows_" + uuid.uuid4().hex
    query = windowed(source).writeStream.format("memory").outputMode("complete").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", F.col("n").cast(long).alias("n"))


QUERIES = {f.__name__: f for f in (
    tokenize_counts, clean_text_hash, sentence_split, truncate_excerpt, section_detect, chunk_documents, term_freq_top, doc_freq, vocab_stats, corpus_stats_by_lang, intent_classify, entity_extract, abbrev_expand, bm25_topk, bm25_prefix_fallback,
    dense_topk, hash_embed, hash_dense_topk, rrf_fusion, rerank_scores, support_type, key_terms, relevance_norm, confidence_scores, common_terms, knowledge_gaps, followups, doc_maxpool, mrr_at_k, ndcg_at_k, eval_by_mode, eval_by_intent, rubric_means, rubric_compare,
    upsert_new_docs, corpus_stats, corpus_documents, html_extract, json_links, stream_ingest_counts, decision_output,
)}
