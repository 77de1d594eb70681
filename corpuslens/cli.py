"""python -m corpuslens.cli --corpus DIR [--query TEXT | --stats | --demo] [--ingest DIR [--ingest-max N] [--save-corpus]] [--llm MODULE:FUNCTION] [--hybrid] [--show-prompt]

Without --query, --stats and --demo, questions are read from the input, a line each; demo, stats and quit are commands there."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Iterable
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import dense, synthesize
from .plans import decision

DEMO = ["How does the treatment work?", "What is the outcome versus the control?"]


def answer(engine: api.Engine, question: str, show_prompt: bool) -> None:
    if show_prompt:
        rows = engine.query_batch(engine.spark.createDataFrame([("q", question)], "query_id string, text string"))
        print(rows.select(synthesize.prompt(F.col("query"), F.col("evidence"), F.col("knowledge_gaps"))).first()[0])
    print(json.dumps(engine.query(question), indent=2, ensure_ascii=False))


def loop(engine: api.Engine, lines: Iterable[str], show_prompt: bool) -> None:
    for line in map(str.strip, lines):
        if line.lower() in ("quit", "exit", "q"):
            return
        if line.lower() == "stats":
            print(json.dumps(engine.corpus(), indent=2))
        elif line:
            for question in DEMO if line.lower() == "demo" else [line]:
                answer(engine, question, show_prompt)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--corpus", required=True, help="parquet of doc_id, title, text, metadata")
    p.add_argument("--query")
    p.add_argument("--demo", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--hybrid", action="store_true")
    p.add_argument("--llm", metavar="MODULE:FUNCTION", help="a function of the prompt that writes the answer")
    p.add_argument("--show-prompt", action="store_true")
    p.add_argument("--ingest", help="parquet of papers to add to the corpus")
    p.add_argument("--ingest-max", type=int, metavar="N", help="at most so many of them, by doc_id")
    p.add_argument("--save-corpus", action="store_true", help="append what --ingest added to --corpus")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    write = None
    if a.llm:
        module, name = a.llm.split(":")
        write = partial(synthesize.written, write=getattr(importlib.import_module(module), name))
    engine = api.Engine(spark, decision.Config(dense=dense.hash_topk if a.hybrid else None, synthesizer=write))
    engine.add_documents(spark.read.schema(api.DOCUMENT).parquet(a.corpus))
    if a.ingest:
        found = spark.read.schema(api.DOCUMENT).parquet(a.ingest)
        found = found if a.ingest_max is None else found.orderBy("doc_id").limit(a.ingest_max)
        if a.save_corpus:
            from .sources.store import append_new

            print(append_new(found.dropDuplicates(["doc_id"]), a.corpus), "added")
        engine.add_documents(found)
    if a.stats:
        print(json.dumps(engine.corpus(), indent=2))
    elif a.demo or a.query:
        for question in [a.query] if a.query else DEMO:
            answer(engine, question, a.show_prompt)
    else:
        loop(engine, sys.stdin, a.show_prompt)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
