"""Evidence rows from reranked hits, and the gaps that a question's evidence leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def relevance(score: Column, by: str = "query_id") -> Column:
    """Score as a share of the query's best, at most 1, three decimals."""
    best = F.first("score").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.round(F.least(F.lit(1.0), score / F.greatest(best, F.lit(0.01))), 3)


def evidence(reranked: DataFrame) -> DataFrame:
    """One row per reranked hit: source_id, doc_title, section, excerpt, relevance_score, support_type, key_terms."""
    return reranked.select(
        "query_id", "rank", F.col("chunk_id").alias("source_id"), F.col("title").alias("doc_title"), "section", T.truncate(F.col("text"), 400).alias("excerpt"),
        relevance(F.col("score")).alias("relevance_score"), T.support_type(F.col("text")).alias("support_type"), T.key_terms(F.col("text"), F.col("query_tokens")).alias("key_terms"),
    )


def nested(rows: DataFrame) -> DataFrame:
    """(query_id, evidence): the evidence of each query in the order of rank; a query has as many as the rerank depth."""
    fields = ["source_id", "doc_title", "section", "excerpt", "relevance_score", "support_type", "key_terms"]
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias("evidence"))


def count_of(evidence_: Column, kind: str) -> Column:
    return F.size(F.filter(evidence_, lambda e: e["support_type"] == kind))


def gaps(entities: Column, needs_quantitative: Column, evidence_: Column, top_score: Column, n_chunks: Column) -> Column:
    """At most five messages, in fixed order; top_score is the best before reranking (null: nothing was found)."""
    covered = F.lower(F.array_join(F.transform(evidence_, lambda e: e["excerpt"]), " "))
    uncovered = F.transform(F.filter(entities, lambda e: ~F.contains(covered, F.lower(e))), lambda e: F.concat(F.lit("The indexed documents hold no direct evidence on '"), e, F.lit("'")))
    none = F.array().cast("array<string>")
    one = lambda hit, message: F.when(hit, F.array(message)).otherwise(none)
    numbers = F.exists(evidence_, lambda e: F.lower(e["excerpt"]).rlike(C.HAS_NUMBERS))
    against = count_of(evidence_, "contradictory")
    low = top_score < 1.5 * F.log((F.greatest(n_chunks, F.lit(1)) + 0.5) / 1.5 + 1)
    old = F.size(F.filter(evidence_, lambda e: e["excerpt"].rlike(C.OLD_YEAR)))
    return F.slice(
        F.concat(
            uncovered,
            one(needs_quantitative & ~numbers, F.lit("No quantitative data (effect sizes, p-values, intervals) in the evidence found")),
            one(against > 0, F.concat(against.cast("string"), F.lit(" source(s) contradict: the answer may not be a consensus"))),
            one(F.coalesce(low, F.lit(False)), F.lit("The evidence scores low: the documents may not address this question")),
            one((F.size(evidence_) > 0) & (old >= F.floor(F.size(evidence_) / 2)), F.lit("The evidence may be old: check it against recent publications")),
        ),
        1,
        5,
    )
