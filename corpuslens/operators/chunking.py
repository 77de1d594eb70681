"""Overlapping windows of sentences.

Sentences come from column expressions. The fold that groups them is sequential within a document, so it runs over Arrow
batches, one document's sentences at a time; documents are independent and need no exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = "chunk_id string, doc_id string, title string, text string, section string, page int, char_start int, char_end int, chunk_no int"


def windows(sentences: list[str], sections: list[str], size: int, overlap: int, least: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(first sentence, sentence after the last, section, length without spaces, position) of each window that is long enough."""
    first, used, section, position = 0, 0, "Body", 0
    lengths = [len(s) for s in sentences]

    def emit(last: int) -> Iterator[tuple]:
        if sum(lengths[first:last]) + last - first - 1 >= least:
            yield first, last, section, used, position

    for i, n in enumerate(lengths):
        if sections[i] != "Body":
            section = sections[i]
        if used + n > size and i > first:
            yield from emit(i)
            held, back = 0, i
            while back > first and held + lengths[back - 1] <= overlap:
                back -= 1
                held += lengths[back] + 1
            first, used = back, sum(lengths[back:i])
        used += n
        position += n + 1
    if len(lengths) > first:
        yield from emit(len(lengths))


def chunk(documents: DataFrame, size: int = 512, overlap: int = 64, least: int = 80) -> DataFrame:
    """Chunks of documents (doc_id, title, text), with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, title, parts, sections in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (a, b, section, used, position) in enumerate(windows(parts or [], sections or [], size, overlap, least)):
                    key = hashlib.md5(f"{doc}:{position}".encode()).hexdigest()[:12]
                    rows.append((key, doc, title, " ".join(parts[a:b]), section, max(1, position // 2500 + 1), position - used, position, n))
            types = [pa.string()] * 5 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, types)], names=[f.split()[0] for f in FIELDS.split(", ")])

    parts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("title").cast("string").alias("title"), T.sentences(T.clean_text(F.col("text"))).alias("parts"))
    made = parts.withColumn("sections", F.transform("parts", T.section)).mapInArrow(run, FIELDS)
    return made.withColumn("tokens", T.tokenize(F.col("text")))
