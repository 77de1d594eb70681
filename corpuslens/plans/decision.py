"""The whole plan from documents and questions to one decision row per question."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dense, evidence, index, rerank, retrieve, synthesize
from ..sources.store import small_batches, staged, tabled


@dataclass(frozen=True)
class Config:
    """Sizes in characters; depths in rows. dense: (queries, chunks, k) -> (query_id, chunk_id, score, rank), or None."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 80
    retrieval_top_k: int = 15
    rerank_top_k: int = 5
    dense: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None
    synthesizer: Callable[[DataFrame], DataFrame] | None = None


def chunked(documents: DataFrame, config: Config) -> DataFrame:
    return chunking.chunk(documents, config.chunk_size, config.chunk_overlap, config.min_chunk_size).withColumn("chunk_ord", F.struct("doc_id", "chunk_no"))


def corpus(documents: DataFrame, config: Config = Config(), table: bool = False) -> index.Index:
    """Index of documents (doc_id, title, text); doc_id gives the order in which they came.

    table: what search reads of chunks is written once, for store.drop(), instead of whole chunks being held in storage; decide() then takes the documents, too."""
    small_batches(documents.sparkSession)
    chunks = chunked(documents, config)
    return index.build(tabled(chunks if config.dense else chunks.select("chunk_id", "chunk_ord", "tokens")), keep=False) if table else index.build(chunks)


def recut(documents: DataFrame, corpus_: index.Index, hits: DataFrame, config: Config) -> index.Index:
    """corpus_ with whole chunks of the documents that hits come from: only these, a few for each question, are cut again."""
    few = staged(retrieve.named(corpus_.chunks.select("chunk_id", F.col("chunk_ord")["doc_id"].alias("doc_id")), hits).select("doc_id").distinct())
    return corpus_._replace(chunks=chunked(retrieve.named(documents.withColumn("doc_id", F.col("doc_id").cast("string")), few, "doc_id"), config))


def analyzed(questions: DataFrame) -> DataFrame:
    """questions (query_id, text) with the columns of their analysis."""
    return questions.select("query_id", F.col("text"), *(c.alias(k) for k, c in T.analyze(F.col("text")).items()))


def retrieved(queries: DataFrame, corpus_: index.Index, config: Config) -> DataFrame:
    hits = retrieve.search(queries.select("query_id", "expanded_tokens"), corpus_, config.retrieval_top_k)
    if config.dense is not None:
        hits = retrieve.fuse(hits, config.dense(queries.select("query_id", "text"), corpus_.chunks, config.retrieval_top_k), config.retrieval_top_k, store=corpus_.chunks)
    return hits.select("query_id", "chunk_id", "score", "rank", "match_terms")


def reranked(queries: DataFrame, hits: DataFrame, corpus_: index.Index, k: int) -> DataFrame:
    """The k best hits with the chunk's and the query's columns; wide texts join only after the first cut."""
    about = queries.select("query_id", "intent", "expanded_tokens", F.col("tokens").alias("query_tokens"))
    chunks = corpus_.chunks.select("chunk_id", "doc_id", "title", "section", "text", "tokens")
    return rerank.rerank(hits.join(about, "query_id").join(retrieve.named(chunks, hits), "chunk_id"), k)


def decide(questions: DataFrame, corpus_: index.Index, config: Config = Config(), documents: DataFrame | None = None) -> DataFrame:
    """One row per question (query_id, text): answer, confidence, evidence, reasoning, gaps, follow-ups.

    Hits and evidence, a few rows for each question, are computed once; several columns come from each.
    documents: those that corpus_ was made of, where its chunks are a table without texts."""
    queries = staged(analyzed(questions))
    hits = staged(retrieved(queries, corpus_, config))
    whole_chunks = corpus_ if documents is None else recut(documents, corpus_, hits, config)
    rows = staged(evidence.evidence(reranked(queries, hits, whole_chunks, config.rerank_top_k)))
    best = hits.groupBy("query_id").agg(F.max_by("score", -F.col("rank")).alias("top_score"))
    none = F.array().cast("array<string>")
    whole = queries.join(evidence.nested(rows), "query_id", "left").join(synthesize.common_terms(rows), "query_id", "left").join(best, "query_id", "left").crossJoin(staged(corpus_.stats).select(F.col("n").alias("total_chunks_searched")))
    empty = F.filter(F.array(F.struct(*(F.lit("").alias(c) for c in ("source_id", "doc_title", "section", "excerpt")), F.lit(0.0).alias("relevance_score"), F.lit("").alias("support_type"), none.alias("key_terms"))), lambda e: F.lit(False))
    whole = whole.withColumn("evidence", F.coalesce("evidence", empty)).withColumn("common", F.coalesce("common", none))
    found = F.col("evidence")
    whole = whole.withColumn("knowledge_gaps", evidence.gaps(F.col("entities"), F.col("needs_quantitative"), found, F.col("top_score"), F.col("total_chunks_searched")))
    confidence = synthesize.overall_confidence(F.size(found), evidence.count_of(found, "direct"), F.size("knowledge_gaps"))
    made = whole.select(
        "query_id", F.col("text").alias("query"), "intent", synthesize.answer(found, F.col("common")).alias("answer"), F.round(confidence, 3).alias("confidence"), synthesize.label(confidence).alias("confidence_label"), "evidence",
        synthesize.reasoning(F.col("intent"), F.col("entities"), F.size("expanded_tokens"), found, F.col("knowledge_gaps")).alias("reasoning_chain"), "knowledge_gaps",
        synthesize.follow_ups(F.col("intent"), F.col("entities"), found).alias("follow_up_questions"), F.size(F.array_distinct(F.transform(found, lambda e: e["doc_title"]))).alias("sources_used"), "total_chunks_searched",
    )
    return made if config.synthesizer is None else config.synthesizer(made)


def as_json(decisions: DataFrame) -> DataFrame:
    return decisions.select("query_id", F.to_json(F.struct(*decisions.columns)).alias("json"))


def rankings(questions: DataFrame, corpus_: index.Index, depth: int = 60, keep: int = 5, hybrid: bool = False) -> dict[str, DataFrame]:
    """Document rankings by mode, as evaluation wants them: retrieval to a depth, reranked to a few."""
    from ..operators.metrics import doc_ranking

    queries = analyzed(questions)
    of = corpus_.chunks.select("chunk_id", "doc_id")
    out, config = {}, Config(retrieval_top_k=depth)
    hits = retrieved(queries, corpus_, config)
    out["bm25"] = doc_ranking(hits.join(of, "chunk_id"))
    out["reranked"] = doc_ranking(reranked(queries, hits, corpus_, keep))
    if hybrid:
        out["dense"] = doc_ranking(dense.hash_topk(queries, corpus_.chunks, depth).join(of, "chunk_id"))
        fused = retrieved(queries, corpus_, Config(retrieval_top_k=depth, dense=dense.hash_topk))
        out["hybrid"] = doc_ranking(fused.join(of, "chunk_id"))
        out["hybrid_reranked"] = doc_ranking(reranked(queries, fused, corpus_, keep))
    return out


__all__ = ["Config", "analyzed", "as_json", "corpus", "decide", "rankings", "reranked", "retrieved"]
