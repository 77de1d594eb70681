"""Continuous ingestion: new documents reach the corpus and additive index parts exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import store

DOCUMENT = "doc_id string, title string, text string, metadata map<string,string>"


def documents(spark: SparkSession, path: str, schema: str = DOCUMENT, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start(stream: DataFrame, corpus_path: str, checkpoint: str, available_now: bool = True):
    """Writes documents, chunks and per-batch term counts under corpus_path; a batch that is repeated adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["doc_id"])
        known = store.table(batch.sparkSession, f"{corpus_path}/documents", new.withColumn("batch", F.lit(0).cast("long"))).where(F.col("batch") != number)
        new = new.join(known.select("doc_id"), "doc_id", "left_anti").select(*batch.columns).withColumn("batch", F.lit(number).cast("long")).persist()
        chunks = chunking.chunk(new).withColumn("batch", F.lit(number).cast("long"))
        terms = chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sizes = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("dl"))
        for name, df in (("chunks", chunks), ("terms", terms), ("sizes", sizes), ("documents", new)):
            df.drop("batch").write.mode("overwrite").parquet(f"{corpus_path}/{name}/batch={number}")
        new.unpersist()

    out = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def statistics(spark: SparkSession, corpus_path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and sizes so far: each batch's counts added up."""
    terms = spark.read.parquet(f"{corpus_path}/terms").groupBy("term").agg(F.sum("df").alias("df"))
    sizes = spark.read.parquet(f"{corpus_path}/sizes").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    return terms, sizes


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of their time; works on a stream (with a watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


