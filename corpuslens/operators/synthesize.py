"""Rule-based answers: confidence, reasoning steps, answer text, follow-up questions, and the prompt for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .evidence import count_of


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def assessment_confidence(n: Column, direct: Column, indirect: Column) -> Column:
    return F.least(F.lit(1.0), (direct * 0.3 + indirect * 0.15) / F.greatest(n, F.lit(1)) + 0.4)


def synthesis_confidence(average: Column, n: Column, direct: Column, against: Column) -> Column:
    return clamp(average * 0.5 + direct / F.greatest(n, F.lit(1)) * 0.5 - against * 0.1, 0.0, 1.0)


def overall_confidence(n: Column, direct: Column, n_gaps: Column) -> Column:
    value = clamp(0.3 + F.least(F.lit(0.4), n * 0.08) + F.least(F.lit(0.2), direct * 0.07) - n_gaps * 0.05, 0.05, 0.95)
    return F.when(n > 0, value).otherwise(0.0)


def label(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "High").when(confidence >= 0.5, "Moderate").when(confidence >= 0.25, "Low").otherwise("Insufficient")


def common_terms(rows: DataFrame) -> DataFrame:
    """(query_id, common): of each query's six most frequent key terms those in two rows or more; ties by term."""
    counted = rows.select("query_id", F.explode(F.array_distinct("key_terms")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("term").alias("term")))), 1, 6)
    return counted.groupBy("query_id").agg(F.transform(F.filter(best, lambda x: x["n"] <= -2), lambda x: x["term"]).alias("common"))


def follow_ups(intent: Column, entities: Column, evidence: Column) -> Column:
    """Three questions by intent and one on the first evidence's key terms."""
    subject = F.coalesce(F.get(entities, F.lit(0)), F.lit("this target"))
    ask = lambda kind: F.array(*(F.replace(F.lit(q), F.lit("{entity}"), subject) for q in C.FOLLOW_UPS[kind]))
    out = None
    for kind in C.FOLLOW_UPS:
        if kind != "general":
            out = F.when(intent == kind, ask(kind)) if out is None else out.when(intent == kind, ask(kind))
    terms = F.slice(F.array_distinct(F.flatten(F.transform(F.slice(evidence, 1, 2), lambda e: F.slice(e["key_terms"], 1, 2)))), 1, 2)
    more = F.when(F.size(terms) > 0, F.array(F.concat(F.lit("What is the clinical significance of "), F.array_join(terms, " and "), F.lit("?")))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(out.otherwise(ask("general")), more), 1, 4)


def _listed(rows: Column, most: int) -> Column:
    return F.transform(F.slice(rows, 1, 3), lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["doc_title"], F.lit(" ("), e["section"], F.lit("): "), T.shortened(e["excerpt"], most)))


def answer(evidence: Column, common: Column) -> Column:
    """Direct evidence, else indirect, then contradictions, then what sources have in common."""
    of = lambda kind: F.filter(evidence, lambda e: e["support_type"] == kind)
    direct, indirect, against = of("direct"), of("indirect"), of("contradictory")
    none = F.array().cast("array<string>")
    head = (
        F.when(F.size(direct) > 0, F.concat(F.array(F.concat(F.size(direct).cast("string"), F.lit(" source(s) speak to this question directly:"))), _listed(direct, 300)))
        .when(F.size(indirect) > 0, F.concat(F.array(F.lit("No source speaks to this question directly; these bear on it:")), _listed(indirect, 280)))
        .otherwise(F.array(F.lit("Little of what was found bears on this question.")))
    )
    but = F.when(F.size(against) > 0, F.array(F.concat(F.size(against).cast("string"), F.lit(" source(s) contradict: "), F.array_join(F.transform(F.slice(against, 1, 2), lambda e: F.concat(e["doc_title"], F.lit(": "), T.truncate(e["excerpt"], 150), F.lit("..."))), "; ")))).otherwise(none)
    shared = F.when((F.size(evidence) >= 2) & (F.size(common) > 0), F.array(F.concat(F.lit("Several sources share: "), F.array_join(F.slice(common, 1, 4), ", ")))).otherwise(none)
    return F.when(F.size(evidence) == 0, F.lit("The indexed documents hold nothing on this question.")).otherwise(F.array_join(F.concat(head, but, shared), "\n\n"))


def reasoning(intent: Column, entities: Column, n_terms: Column, evidence: Column, gaps: Column) -> Column:
    """Numbered steps: interpretation; retrieval (nothing found) or assessment, synthesis and, if any, gaps."""
    n = F.size(evidence)
    direct, indirect, against = (count_of(evidence, k) for k in ("direct", "indirect", "contradictory"))
    average = F.aggregate(evidence, F.lit(0.0), lambda s, e: s + e["relevance_score"]) / F.greatest(n, F.lit(1))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    number = lambda c: c.cast("string")
    step = lambda i, name, content, confidence: F.struct(F.lit(i).alias("step_number"), F.lit(name).alias("label"), content.alias("content"), confidence.cast("double").alias("confidence"))
    titles = F.size(F.array_distinct(F.transform(evidence, lambda e: e["doc_title"])))
    first = F.get(evidence, F.lit(0))
    named = F.when(F.size(entities) > 0, F.array_join(entities, ", ")).otherwise("none")
    one = step(1, "Query interpretation", text("Intent: ", intent, ". Entities: ", named, ". Search terms: ", number(n_terms), "."), F.lit(1.0))
    empty = step(2, "Evidence retrieval", F.lit("No evidence was found."), F.lit(0.0))
    two = step(2, "Evidence assessment", text(number(n), " row(s): ", number(direct), " direct, ", number(indirect), " indirect, ", number(against), " contradictory, from ", number(titles), " document(s)."), assessment_confidence(n, direct, indirect))
    three = step(3, "Answer synthesis", text("Built from ", number(n), " excerpt(s), first ", F.coalesce(first["doc_title"], F.lit("")), " (", F.coalesce(first["section"], F.lit("")), ")."), synthesis_confidence(average, n, direct, against))
    four = step(4, "Knowledge gap analysis", text(number(F.size(gaps)), " gap(s): ", F.array_join(F.slice(gaps, 1, 2), "; "), "."), F.lit(0.7))
    return F.when(n == 0, F.array(one, empty)).when(F.size(gaps) > 0, F.array(one, two, three, four)).otherwise(F.array(one, two, three))


def prompt(question: Column, evidence: Column, gaps: Column) -> Column:
    """What a model that writes the answer is given: the question, numbered excerpts of at most 500 characters, the gaps."""
    excerpts = F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["doc_title"], F.lit(" | "), e["section"], F.lit(" | "), e["support_type"], F.lit("\n"), T.truncate(e["excerpt"], 500)))
    return F.concat(F.lit("Question: "), question, F.lit("\n\nExcerpts:\n"), F.array_join(excerpts, "\n\n"), F.lit("\n\nKnown gaps: "), F.when(F.size(gaps) > 0, F.array_join(gaps, "; ")).otherwise("none"))


def written(decisions: DataFrame, write: Callable[[str], str]) -> DataFrame:
    """decisions with answers that a model wrote from the prompt; where it fails or there is no evidence, the rule-based answer stays.

    Reasoning, confidence and gaps stay as they are in either case."""
    asked = decisions.withColumn("prompt", F.when(F.size("evidence") > 0, prompt(F.col("query"), F.col("evidence"), F.col("knowledge_gaps"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for rule, text in zip(batch["answer"], batch["prompt"]):
                try:
                    answers.append(write(text) if text is not None else rule)
                except Exception:  # whatever a model's client raises, there is an answer without it
                    answers.append(rule)
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": answers})

    key = decisions.schema["query_id"].dataType.simpleString()
    made = asked.select("query_id", "answer", "prompt").mapInPandas(run, f"query_id {key}, answer string")
    return decisions.drop("answer").join(made, "query_id").select(*decisions.columns)
