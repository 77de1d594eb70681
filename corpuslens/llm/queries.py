"""The operators of this package over whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, apportion, chat_tree, decontaminate, huffman, license_join, line_dedup, mih, ngram_join, toxic_grammar, warc_index
from .oracles import ORACLES

CONTROL_CONVERSATION = "</s>[INST] ok [/INST]"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _shared.ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = _shared.shared_dir(spark, "warc")
    index = warc_index.CaptureIndex(spark, path, warc_index.write_archives(pages, path))
    found = warc_index.fetch(index.lookup(warc_index.keys_of(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.annotate(docs, decontaminate.Index(spark, _table(spark, sf_dir, "benchmark"), docs))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_CONVERSATION), (-1, 1, "assistant", CONTROL_CONVERSATION)], "conv_id long, turn long, role string, text string")
    return chat_tree.read(chat_tree.write(turns.unionByName(more)))


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).read()


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_join.scan(docs, license_join.Templates(docs))


def op7_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_grammar.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxic_grammar.score(docs, model)
    return scored.select("doc_id", toxic_grammar.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    store = line_dedup.LineStore(spark)
    store.insert(docs)
    left = line_dedup.dedup(docs, store)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_capture_index, op2_decontaminate, op3_chat_tree, op4_huffman_tokens, op5_sainte_lague, op6_license_join, op7_toxic_grammar, op8_line_dedup, op9_ngram_join, op10_multi_index, pipeline)}

__all__ = ["ORACLES", "QUERIES"]
