"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

Every benchmark item becomes windows of consecutive words (an item shorter than a window is one
window). A window is the set of its word shingles. One pass over the documents counts how often each
benchmark shingle occurs; shingles are then ordered by rarity. A window that must be contained to the
share ``containment`` needs one of its ``n - ceil(containment * n) + 1`` rarest shingles, so only those are
looked up in the second pass (at containment 1 that is the rarest alone, and none where it doesn't occur). A found shingle fixes
where the whole window would lie, or between which places (positional bound), which must be inside the text (length bound), and there the
window is compared exactly: word by word at containment 1, else by how many of its shingles stand in a stretch of text as long as the window.

Windows are made, ordered and kept in tasks, in blocks of ``block_items`` items in the shared folder; the driver only has the blocks' numbers. A task
holds a batch of texts and one block at a time, whatever the benchmark's size, and the documents are never shuffled.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no window; a null
item_id is listed as the empty string; repeated rows are judged one by one, repeated item_ids count once; a very long text
is a batch of its own; other columns, whatever their names, are kept by ``clean`` and ignored by ``annotate``.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _windows(ids: list, texts: pa.Array, size: int, k: int) -> dict[str, np.ndarray] | None:
    """The windows of some items: item number, words, shingle width, and the first and number of their shingles among those of all items."""
    found: list[list] = [[], [], [], [], []]
    grams, n = [], 0
    for lo, _, data, at in _words.pieces(texts):
        hashed, _, _, bounds = _words.words(data, at, _words.ALNUM)
        for i in np.flatnonzero(np.diff(bounds)):
            own = hashed[bounds[i] : bounds[i + 1]]
            m = min(size, len(own))
            width, many = min(k, m), len(own) - m + 1
            grams.append(_words.shingles(own, width))
            for column, value in zip(found, (lo + i, m, width, n + np.arange(many), m - width + 1)):
                column.append(np.broadcast_to(value, many))
            n += len(grams[-1])
    if not grams:
        return None
    item, words, width, start, count = (np.concatenate(x).astype(np.int64) for x in found)
    return {"item": item, "words": words, "width": width, "start": start, "count": count, "gram": np.concatenate(grams), "ids": np.array(["" if x is None else str(x) for x in ids])}


class Index:
    """Benchmark windows in blocks in the shared folder, with the shingles to look up first in each."""

    def __init__(self, spark, bench: DataFrame, docs: DataFrame, item_col: str = "item_id", bench_text: str = "text", text_col: str = "text", window: int = 13, shingle: int = 5, containment: float = 1.0, block_items: int = 50_000):
        self.containment = containment
        folder = _shared.shared_dir(spark, "benchmark")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, block_items):
                    some = batch.slice(lo, block_items)
                    if (block := _windows(some.column(0).to_pylist(), some.column(1), window, shingle)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([_store(folder, block)])], names=["file"])

        items = bench.select(F.col(item_col).cast("string").alias("i"), F.col(bench_text).cast("string").alias("t"))
        made = _shared.saved(items.repartition(max(1, -(-items.count() // block_items))).mapInArrow(_shared.lean(make), "file string"), "windows")
        #: one name for each block that the documents hold shingles of
        self.files = self._order_by_rarity(docs, text_col, [r["file"] for r in made.collect()], folder)

    def _order_by_rarity(self, docs: DataFrame, text_col: str, files: list[str], folder: str) -> list[str]:
        """Count the benchmark's shingles over all documents, then keep each window's rarest ones as its prefix."""
        containment = self.containment

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            for batch in batches:
                texts = [_words.words(data, at, _words.ALNUM)[0] for _, _, data, at in _words.pieces(batch.column(0))]
                for n, file in enumerate(files):
                    block = _block(cache, file, len(files))
                    if "own" not in block:
                        block["own"], block["widths"] = np.unique(block["gram"]), np.unique(block["width"])
                    own, total = block["own"], np.zeros(len(block["own"]), np.int64)
                    for hashed in texts:
                        for width in block["widths"]:
                            grams = _words.shingles(hashed, int(width))
                            where = np.searchsorted(own, grams)
                            where[where == len(own)] = 0
                            total += np.bincount(where[own[where] == grams], minlength=len(own))
                    some = total > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(np.count_nonzero(some), n, np.int32)), pa.array(own[some].view(np.int64)), pa.array(total[some])], names=["block", "gram", "n"])

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                block = batch.column(0).to_numpy()
                for n in np.unique(block):
                    if n != now and held:
                        yield pa.RecordBatch.from_arrays([pa.array([_prefixes(files[now], held)])], names=["file"])
                        held = []
                    now = int(n)
                    held.append(batch.filter(pa.array(block == n)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([_prefixes(files[now], held)])], names=["file"])

        def _prefixes(file: str, counts: list[pa.RecordBatch]) -> str:
            """The block with the keys of its windows: the rarest shingles, as many as a contained window has one of."""
            block = _load(file)
            key = np.concatenate([c.column(1).to_numpy() for c in counts]).view(np.uint64)
            n = np.concatenate([c.column(2).to_numpy() for c in counts])
            by = np.argsort(key)
            key, n = key[by], n[by]
            where = np.minimum(np.searchsorted(key, block["gram"]), len(key) - 1)
            freq = np.where(key[where] == block["gram"], n[where], 0)
            gram, window, offset = [], [], []
            for size in np.unique(block["count"]):
                own = np.flatnonzero(block["count"] == size)
                at = block["start"][own][:, None] + np.arange(size)
                value, count_ = block["gram"][at], freq[at]
                if containment < 1:  # a set has a shingle once
                    by_value = np.argsort(value, axis=1, kind="stable")
                    again = np.zeros(value.shape, bool)
                    ordered = np.take_along_axis(value, by_value, 1)
                    np.put_along_axis(again, by_value[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                    count_ = np.where(again, np.iinfo(np.int64).max, count_)
                    distinct = size - again.sum(1)
                else:
                    distinct = np.full(len(own), size)
                need = distinct - np.ceil(containment * distinct - 1e-9).astype(np.int64) + 1
                rare = np.lexsort((value, count_), axis=1)
                place = np.take_along_axis(at, rare, 1)
                some = (np.arange(size) < need[:, None]) & (freq[place] > 0)
                gram.append(block["gram"][place][some])
                window.append(np.broadcast_to(own[:, None], rare.shape)[some])
                offset.append(rare[some])
            gram, window, offset = (np.concatenate(x) for x in (gram, window, offset))
            by = np.argsort(gram, kind="stable")
            return _store(folder, block | {"key": gram[by], "key_window": window[by], "key_offset": offset[by]})

        counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_shared.lean(count), "block int, gram long, n long").groupBy("block", "gram").agg(F.sum("n").alias("n"))
        ordered = counted.repartition(max(1, len(files)), "block").sortWithinPartitions("block").mapInArrow(_shared.lean(order), "file string")
        return sorted(r["file"] for r in _shared.saved(ordered, "prefixes").collect())


def _store(folder: str, block: dict) -> str:
    out = io.BytesIO()
    np.savez(out, **block)
    _shared.put(file := f"{folder}/{uuid.uuid4().hex}.npz", out.getvalue())
    return file


def _load(file: str) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(_shared.get(file))))


def _block(cache: dict, file: str, files: int) -> dict[str, np.ndarray]:
    """A block; a task keeps the one it read last."""
    if file not in cache:
        cache.clear()
        cache[file] = _load(file)
    return cache[file]


def _find(block: dict, hashed: np.ndarray, bounds: np.ndarray, containment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of each window that occurs."""
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = [np.zeros((3, 0), np.int64)]
    for width in np.unique(block["width"]).tolist():
        own = _words.shingles(hashed, width)
        lo, hi = np.searchsorted(block["key"], own), np.searchsorted(block["key"], own, "right")
        if not len(hits := np.flatnonzero(hi > lo)):
            continue
        many = (hi - lo)[hits]
        entry = np.repeat(lo[hits] - np.cumsum(many) + many, many) + np.arange(many.sum())
        window, place = block["key_window"][entry], np.repeat(hits, many)
        if containment < 1:  # the shingle may be any of those of the stretch
            size = block["count"][window]
            first = np.repeat(place - size + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            window = np.repeat(window, size)
        else:
            first = place - block["key_offset"][entry]
        m = block["words"][window]
        fits = (block["width"][window] == width) & (first >= 0) & (first + m <= len(hashed))
        window, first, m = window[fits], first[fits], m[fits]
        fits = text_of[first] == text_of[first + m - 1]
        window, first = np.unique(np.stack([window[fits], first[fits]]), axis=1) if fits.any() else (window[:0], first[:0])
        if not len(window):
            continue
        for size in np.unique(block["count"][window]):
            w, s = (x[block["count"][window] == size] for x in (window, first))
            for a in range(0, len(w), 100_000):
                some, at = w[a : a + 100_000], s[a : a + 100_000]
                want, have = block["gram"][block["start"][some][:, None] + np.arange(size)], own[at[:, None] + np.arange(size)]
                if containment < 1:
                    sets = [set(x) for x in want.tolist()]
                    same = np.array([len(x & set(y)) >= math.ceil(containment * len(x) - 1e-9) for x, y in zip(sets, have.tolist())], bool)
                else:
                    same = (want == have).all(1)
                out.append(np.stack([at[same], block["words"][some[same]], block["item"][some[same]]]))
    return tuple(np.concatenate(out, axis=1))


_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _judge(index: Index, cache: dict, column: pa.Array, share: int) -> Iterator[tuple]:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text."""
    texts = []
    for _, _, data, at in _words.pieces(column):
        hashed, _, _, bounds = _words.words(data, at, _words.ALNUM)
        texts.append((hashed, bounds, np.zeros(len(hashed) + 1, np.int64), {}))
    for file in index.files:
        block = _block(cache, file, len(index.files))
        for hashed, bounds, delta, items in texts:
            first, m, item = _find(block, hashed, bounds, index.containment)
            np.add.at(delta, first, 1)
            np.add.at(delta, first + m, -1)
            for text, i in np.unique(np.stack([np.searchsorted(bounds, first, "right") - 1, item]), axis=1).T.tolist():
                items.setdefault(text, set()).add(str(block["ids"][i]))
    for _, bounds, delta, items in texts:
        hit = np.concatenate(([0], np.cumsum(np.cumsum(delta[:-1]) > 0)))
        n_words, n_hit = np.diff(bounds), np.diff(hit[bounds])
        for i in range(len(bounds) - 1):
            own = sorted(items.get(i, ()))
            digest = hashlib.sha256(",".join(own).encode()).hexdigest() if own else _NO_ITEMS
            yield int(n_words[i]), int(n_hit[i]), len(own), digest, bool(n_hit[i] > 0 and share * n_hit[i] >= n_words[i])


def annotate(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """One row per document with its hit words and items; contaminated: at least 1 in share words is hit."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            rows = list(zip(*_judge(index, cache, batch.column(1), share))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_shared.lean(run), f"doc_id {kind}, {RESULT}")


def clean(docs: DataFrame, index: Index, text_col: str = "text", share: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([not row[4] for row in _judge(index, cache, batch.column(at), share)], pa.bool_()))

    return docs.mapInArrow(_shared.lean(run), docs.schema)
