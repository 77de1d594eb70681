"""Text functions as column expressions: they run inside the JVM and need no Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

W, S = C.W, C.S


def tokenize(text: Column) -> Column:
    """Lower-cased words of two or more of a-z 0-9 _, hyphenated ones as one, without stopwords of four letters or more."""
    joined = F.regexp_replace(F.lower(text), f"({W})-({W})", "$1_$2")
    found = F.regexp_extract_all(joined, F.lit(rf"(?<!{W})[a-z0-9_]{{2,}}(?!{W})"), F.lit(0))
    kept = F.array_except(F.array(F.lit("")), F.array(F.lit("")))  # an empty array<string>
    spaced = F.transform(found, lambda t: F.translate(t, "_", "-"))
    return F.coalesce(F.filter(spaced, lambda t: (F.length(t) <= 3) | ~t.isin(C.DROPPED)), kept)


def clean_text(text: Column) -> Column:
    """White space collapsed, line-break hyphens joined, citation marks removed."""
    for pattern, replacement in C.CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def sentences(text: Column) -> Column:
    """Split before a capital after . ! or ?, but not after the guarded abbreviations."""
    # the stop comes first, as few places have one; e.g. after i. is the rest of i.e., whose stop is guarded already
    guards = "|".join(re.escape(g).replace("\\ ", " ") for g in C.SENTENCE_GUARDS).replace(r"e\.g", r"(?<!i\.)e\.g")
    safe = F.regexp_replace(text, rf"\.(?<=(?:{guards})\.)", "<DOT>")
    parts = F.transform(F.split(safe, rf"(?<=[.!?]){S}+(?=[A-Z])"), lambda s: F.regexp_replace(F.replace(s, F.lit("<DOT>"), F.lit(".")), rf"^{S}+|{S}+$", ""))
    return F.filter(parts, lambda s: s != "")


def truncate(text: Column, most: int) -> Column:
    """The longest run of first sentences within so many characters; the raw prefix where not even one fits."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        full = acc["full"] | (F.length(longer) > most)
        return F.struct(F.when(full, acc["text"]).otherwise(longer).alias("text"), full.alias("full"))

    fitting = F.aggregate(sentences(text), start, step)["text"]
    return F.when(F.length(text) <= most, text).when(fitting != "", fitting).otherwise(F.substring(text, 1, most))


def shortened(text: Column, most: int) -> Column:
    """truncate, with ... where something is missing."""
    cut = truncate(text, most)
    return F.when(F.length(cut) < F.length(text), F.concat(cut, F.lit("..."))).otherwise(cut)


def section(text: Column) -> Column:
    """Section that a sentence opens by its first words, else Body."""
    line = F.trim(F.substring_index(text, "\n", 1))
    # few sentences open any section, so all patterns are looked for at once before they are told apart
    out = F.when(~line.rlike(rf"(?i)^(?:{'|'.join(p for p, _ in C.SECTIONS)})"), "Body")
    for pattern, name in C.SECTIONS:
        out = out.when(line.rlike(rf"(?i)^(?:{pattern})"), name)
    return out.otherwise("Body")


def intent(question: Column) -> Column:
    """First intent of which the question contains a trigger, else general."""
    q, out = F.lower(question), None
    for name, triggers in C.INTENTS.items():
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(q, F.lit(t))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def entities(question: Column) -> Column:
    """Runs of capitalised words, without single question words."""
    return F.filter(F.regexp_extract_all(question, F.lit(C.ENTITY), F.lit(0)), lambda e: ~e.isin(C.NOT_ENTITIES))


def expanded(tokens: Column) -> Column:
    """Distinct tokens, with those of the words that abbreviations stand for; sorted."""
    pairs = [x for k, v in C.ABBREVIATIONS.items() for x in (F.lit(k), F.split(F.lit(" ".join(t for t in v.split() if len(t) > 1)), " "))]
    known = F.create_map(*pairs)
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(known[t], none))))))


def analyze(question: Column) -> dict[str, Column]:
    """The columns of a query's analysis."""
    tokens, kind = tokenize(question), intent(question)
    return {"tokens": tokens, "expanded_tokens": expanded(tokens), "intent": kind, "entities": entities(question), "is_comparison": kind == "comparison", "needs_quantitative": kind.isin(C.QUANTITATIVE)}


def support_type(text: Column) -> Column:
    """contradictory, direct or indirect."""
    low = F.lower(text)
    any_of = lambda patterns: F.greatest(*(low.rlike(p) for p in patterns))
    return F.when(any_of(C.CONTRADICTORY), "contradictory").when(any_of(C.DIRECT), "direct").otherwise("indirect")


def key_terms(text: Column, tokens: Column) -> Column:
    """At most six of: four entities, two statistics, three query terms of four letters or more; first places kept."""
    low = F.lower(text)
    names = F.regexp_extract_all(text, F.lit(C.KEY_ENTITY), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(C.STATISTICS), F.lit(0))
    terms = F.filter(tokens, lambda t: (F.length(t) > 3) & F.contains(low, t))
    return F.slice(F.array_distinct(F.concat(F.slice(names, 1, 4), F.slice(numbers, 1, 2), F.slice(terms, 1, 3))), 1, 6)
