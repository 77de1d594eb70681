"""Retrieval and answer quality as aggregates over rankings and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUBRIC = ["sem", "ent", "dir", "qty", "ctx", "src", "evd", "unc"]


def doc_ranking(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Documents by their best chunk, not below 0; ties by doc_id."""
    best = hits.groupBy(*by, "doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def reciprocal_rank(ranking: DataFrame, qrels: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """rr of each query of qrels: one over the rank of its first relevant document within k, else 0."""
    good = ranking.where(F.col("rank") <= k).join(qrels.where("grade > 0"), ["query_id", "doc_id"]).groupBy(*by).agg((1.0 / F.min("rank")).alias("rr"))
    every = qrels.select("query_id").distinct() if len(by) == 1 else qrels.select("query_id").distinct().join(ranking.select(*by).distinct(), "query_id")
    return every.join(good, list(by), "left").select(*by, F.coalesce("rr", F.lit(0.0)).alias("rr"))


def ndcg(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """ndcg of each query and k; 0 where the ideal is 0. The ideal counts graded documents that weren't retrieved."""
    k = F.explode(F.array(*(F.lit(x) for x in ks))).alias("k")
    ideal = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).where(F.col("rank") <= max(ks)).select("*", k).where("rank <= k").groupBy("query_id", "k").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("idcg"))
    got = ranking.where(F.col("rank") <= max(ks)).join(qrels, ["query_id", "doc_id"]).select("*", k).where("rank <= k").groupBy(*by, "k").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    every = ideal if len(by) == 1 else ideal.join(ranking.select(*by).distinct(), "query_id")
    return every.join(got, [*by, "k"], "left").select(*by, "k", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def evaluate(modes: dict[str, DataFrame], qrels: DataFrame, k: int = 5, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(mode, metric, value): means over the queries of qrels of rankings (query_id, doc_id, rank) by mode."""
    out = None
    for mode, ranking in modes.items():
        rr = reciprocal_rank(ranking, qrels, k).agg(F.avg("rr").alias("value")).select(F.lit(mode).alias("mode"), F.lit(f"mrr@{k}").alias("metric"), "value")
        gains = ndcg(ranking, qrels, ks).groupBy("k").agg(F.avg("ndcg").alias("value")).select(F.lit(mode).alias("mode"), F.concat(F.lit("ndcg@"), F.col("k").cast("string")).alias("metric"), "value")
        both = rr.unionAll(gains)
        out = both if out is None else out.unionAll(both)
    return out.withColumn("value", F.round("value", 6))


def by_intent(metric: DataFrame, intents: DataFrame, value: str) -> DataFrame:
    """Mean of a metric by the hand label of each query's intent."""
    return metric.join(intents, "query_id").groupBy("intent").agg(F.round(F.avg(value), 6).alias(value), F.count(F.lit(1)).alias("n"))


def deltas(report: DataFrame, base: str) -> DataFrame:
    """Each mode's values less those of the base mode."""
    first = report.where(F.col("mode") == base).select("metric", F.col("value").alias("base"))
    return report.join(first, "metric").select("mode", "metric", "value", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


def rubric_total(scores: DataFrame) -> DataFrame:
    return scores.withColumn("total", sum((F.col(c) for c in RUBRIC[1:]), F.col(RUBRIC[0])))


def rubric_means(scores: DataFrame) -> DataFrame:
    """(system, dimension, mean) of each rubric dimension and of the total."""
    names = [*RUBRIC, "total"]
    long = rubric_total(scores).unpivot(["system", "query_id"], names, "dimension", "points")
    return long.groupBy("system", "dimension").agg(F.round(F.avg("points"), 6).alias("mean"))


def judge(answers: DataFrame, claims: DataFrame, score: Column) -> DataFrame:
    """Answers with claims of the same query, judged by a column (a model's function, or scores that were read)."""
    return answers.join(claims, "query_id").withColumn("judged", score)


def rubric_compare(scores: DataFrame, base: str) -> DataFrame:
    """Total of each query by system, and the difference to the base system."""
    total = rubric_total(scores).select("system", "query_id", "total")
    first = total.where(F.col("system") == base).select("query_id", F.col("total").alias("base_total"))
    return total.join(first, "query_id").select("system", "query_id", "total", (F.col("total") - F.col("base_total")).alias("delta"))


def shifted(points: Column) -> Column:
    """Points from 1 to 3 as points from 0 to 2."""
    return F.greatest(F.lit(0), points - 1)


def combined(retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers' totals with retrieval metrics beside them, 0 where a query has none."""
    return answers.join(retrieval, "query_id", "left").fillna(0, [c for c in retrieval.columns if c != "query_id"])


def rag_dataset(decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """(question, answer, contexts, ground_truth) rows for answer evaluation."""
    truth = F.concat_ws(" ", F.col("reference_claim"), F.concat(F.lit("Direction: "), F.col("expected_direction")), F.concat(F.lit("Context: "), F.col("expected_context")))
    return decisions.join(claims, "query_id").select(F.col("query").alias("question"), "answer", F.transform("evidence", lambda e: F.concat(F.lit("["), e["section"], F.lit("] "), e["doc_title"], F.lit(": "), e["excerpt"])).alias("contexts"), truth.alias("ground_truth"))
