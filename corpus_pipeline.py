"""A corpus from documents in five stages: toxicity, near duplicates, benchmark passages, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import _shared, apportion, decontaminate, huffman, ngram_join, toxic_grammar
from corpuslens.llm.queries import tokenizer_path

#: Near copies share eight tenths of their sets of five words; four words and 85 of 100 are op 9's own contract.
NEAR = {"width": 5, "num": 80}
#: Approximate and model-based stages can't be told in SQL; the tests hold them against plain versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject."""
    labels = _shared.ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_grammar.reject(docs, toxic_grammar.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row, that with the smallest doc_id (null last); of rows with one id and one text, one."""
    _shared.ready(spark)
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():  # ids name rows, and are much smaller keys than what follows
        lost = ngram_join.join(docs, ngram_join.Sets(**NEAR)).where("doc_id <> component_id").select("doc_id")
        return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    keyed = docs.select(F.struct("*").alias("doc"), row.alias("row"), F.col("text").alias("text"))
    found = _shared.saved(ngram_join.join(keyed, ngram_join.Sets(**NEAR), "row").withColumnRenamed("doc_id", "row"), "classes")
    left = keyed.join(found.where(~F.col("row").eqNullSafe(F.col("component_id"))).select("row"), "row", "left_anti")
    again = _shared.saved(found.groupBy("row").count().where("count > 1").select("row"), "repeated")
    if not again.isEmpty():
        left = left.join(again, "row", "left_anti").unionByName(left.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return left.select("doc.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    bench = _shared.ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, decontaminate.Index(spark, bench, docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number (0, 1 or 2); rows go by id and text, as ids may be missing or repeated."""
    _shared.ready(spark)
    keyed = docs.select(F.struct("*").alias("doc"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash")).alias("row"))
    taken = apportion.mix(keyed.select("row", "doc.doc_id", "doc.source", "doc.text"), carry="row").where("size > 0")
    times = taken.groupBy(F.col("carried").alias("row")).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).alias("times")).where("times > 0")
    return keyed.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32 of each row."""
    _shared.ready(spark)
    return huffman.write(docs, tokenizer_path()).read()


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("source_mix", source_mix), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder."""
    docs = _shared.ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _shared.saved(stage(spark, docs, sf_dir), name)
    return docs
