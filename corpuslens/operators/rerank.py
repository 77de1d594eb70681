"""Reranking by section, term density, first rank and recall of telling terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .retrieve import top


def section_weight(intent: Column, section: Column) -> Column:
    """Weight of a section for an intent."""
    out = F.lit(1.0)
    for name, weights in C.SECTION_WEIGHTS.items():
        same = ~intent.isin([n for n in C.SECTION_WEIGHTS if n != "general"]) if name == "general" else intent == name
        for part, w in weights.items():
            if w != 1.0:
                out = F.when(same & (section == part), w).otherwise(out)
    return out


def scores(hits: DataFrame) -> DataFrame:
    """Adds density, factor and adjusted to hits with score, rank, intent, section, expanded_tokens, tokens."""
    query, own = F.col("expanded_tokens"), F.array_distinct("tokens")
    telling = F.array_except(query, F.array(*(F.lit(t) for t in C.GENERIC_TERMS)))
    matched = F.size(F.array_intersect(telling, own))
    density = F.when(F.size(own) > 0, F.size(F.array_intersect(query, own)) / F.size(own)).otherwise(0.0)
    factor = F.when(F.size(telling) == 0, C.EMPTY_DISCRIMINATIVE).when(matched == 0, C.MISSED_FACTOR).otherwise(C.MATCH_BASE + C.MATCH_SHARE * matched / F.size(telling))
    bonus = 1.0 + 0.05 / F.greatest("rank", F.lit(1))
    wide = hits.withColumn("density", density).withColumn("factor", factor)
    return wide.withColumn("adjusted", F.round(F.col("score") * section_weight(F.col("intent"), F.col("section")) * (1 + F.col("density") * 0.4) * bonus * F.col("factor"), 6))


def rerank(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best by adjusted score; first_rank and first_score keep what retrieval gave."""
    wide = scores(hits).withColumnsRenamed({"rank": "first_rank", "score": "first_score", "adjusted": "score"})
    return top(wide, k, order=("first_rank",))
