"""Reversible line dedup: exact reference counts per line key, sharded, with cuckoo filters in front.

A store is a folder of signed entries (key, document, +1 or -1) in shards by key. Inserting documents appends
+1 entries, deleting them appends -1 entries, so any state can be undone; ``references`` sums them into the exact
table: how many documents hold a key and which is the last. A cuckoo filter per shard, a file in the shared folder, holds the keys that
are held often enough to be dropped; after documents came or went only the keys that crossed that line are put into the filters or deleted from
them, and only a filter that becomes too full is made anew. The filters tell most lines apart without a join: where all of them together are within
``filter_limit`` each task looks its lines up in all, else lines are dealt by shard (each shard to many tasks, so a common
line is no large group) and a task holds one filter at a time. What passes is joined with the exact table, so the filters' false positives
change nothing.

Lines are trimmed, lower-cased, measured and hashed to 128 bits with numpy over the bytes of a run of texts at once.

Defined cases: null or empty text is one empty line; a null document id counts as one document below all
others; rows that repeat a document id count as one document and are rewritten each; ids have to be integers; a very long text
is worked on alone, a very long line is a key like any other; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words

KEY = "k1 long, k2 long"
NO_ID = -(2**63)
_SECOND = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)


class Lines(NamedTuple):
    """Lines of some texts, in order: text, first byte, byte after the last; key bounds, and the two halves of the keys of lines that are long enough (``keyed``)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keyed: np.ndarray
    k1: np.ndarray
    k2: np.ndarray


def lines(data: np.ndarray, at: np.ndarray, least: int) -> Lines:
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(at, breaks, "right") - 1
    start = np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((at[1:], breaks)), kind="stable")
    text = np.repeat(np.arange(len(at) - 1), 1 + np.bincount(text_of, minlength=len(at) - 1))
    b = _words.LOWER[data]
    solid = np.flatnonzero(_words.SOLID[b])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(j > i)
    first, last = solid[i[some]], solid[j[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[last] - points[first] >= least
    keyed, first, last = some[long], first[long], last[long]
    k1, k2 = (_words.hash_spans(table[b], first, last).view(np.int64) for table in (_words._BYTE, _SECOND))
    return Lines(text, start, end, keyed, k1, k2)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, two buckets for a key; numpy arrays, so a filter is its bytes."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        n = 1
        while n * self.SLOTS * 0.85 < max(capacity, 1):
            n *= 2
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.asarray(key, np.int64).view(np.uint64)
        print_ = ((key >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.table) - 1)
        first = key & mask
        return print_, first.astype(np.int64), self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return ((np.asarray(bucket).astype(np.uint64) ^ (np.asarray(print_).astype(np.uint64) * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*self._places(keys)):
            spot = b if np.all(self.table[a]) else a
            for kick in range(self.KICKS):
                free = np.flatnonzero(self.table[spot] == 0)
                if len(free):
                    self.table[spot, free[0]] = p
                    break
                slot = (kick + int(p)) % self.SLOTS
                p, self.table[spot, slot] = self.table[spot, slot], p
                spot = int(self._other(np.array([spot]), np.array([p]))[0])
            else:  # too full: a table twice as large can't be made from fingerprints alone
                raise OverflowError("cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*self._places(keys)):
            for spot in (a, b):
                if len(at := np.flatnonzero(self.table[spot] == p)):
                    self.table[spot, at[0]] = 0
                    break

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.int64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)


def _built(keys: np.ndarray) -> CuckooFilter:
    capacity = len(keys)
    while True:
        try:
            out = CuckooFilter(capacity)
            out.insert(keys)
            return out
        except OverflowError:
            capacity *= 2


def _entries(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(k1, k2, doc) of each document's distinct keys of at least so many code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for lo, _, data, at in _words.pieces(batch.column(1)):
                found = lines(data, at, least)
                of = found.text[found.keyed]
                order = np.lexsort((found.k2, found.k1, of))
                a, b, of = found.k1[order], found.k2[order], of[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(doc[lo + of[new]])], names=["k1", "k2", "doc"])

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_shared.lean(run), f"{KEY}, doc long")


class Filters(NamedTuple):
    """The keys that are held often (k1, k2, last_doc, n_rows) and the files of the filters over them, one for each shard of k2."""

    min_docs: int
    often: DataFrame
    files: list[str | None]
    sizes: list[int]


class LineStore:
    """The entries of all documents inserted so far, less those deleted."""

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 20, shard_keys: int = 200_000):
        self.spark, self.path, self.least, self.shard_keys = spark, path or _shared.shared_dir(spark, "lines"), least, shard_keys
        self._made: Filters | None = None

    def _append(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> None:
        _entries(docs, id_col, text_col, self.least).distinct().withColumn("n", F.lit(sign)).write.mode("append").parquet(f"{self.path}/entries")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Documents must be new to the store; one that is inserted again counts again until deleted as often."""
        self._append(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._append(docs, -1, id_col, text_col)

    def references(self) -> DataFrame:
        """Exact table: k1, k2, n_docs, last_doc of every key that a document still holds."""
        held = self.spark.read.schema(f"{KEY}, doc long, n int").parquet(f"{self.path}/entries").groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n")).where("n > 0")
        return held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))

    def filters(self, min_docs: int) -> Filters:
        """Filters of the store's present state: those of the state before with the keys that came or went, or new ones."""
        often = _shared.saved(self.references().where(F.col("n_docs") >= min_docs).select("k1", "k2", "last_doc", F.col("n_docs").alias("n_rows")), "references")
        before = self._made if self._made and self._made.min_docs == min_docs and -(-often.count() // self.shard_keys) <= 2 * len(self._made.files) else None
        if before:
            sign = lambda x, y, n: x.join(y.select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(n).alias("sign"))
            files, sizes, changes = list(before.files), list(before.sizes), sign(before.often, often, -1).unionByName(sign(often, before.often, 1))
        else:
            files, changes = [None] * max(1, -(-often.count() // self.shard_keys)), often.select("k1", "k2", F.lit(1).alias("sign"))
            sizes = [0] * len(files)
        made = self._write(changes, files).collect()  # a row for each shard
        full = [r["shard"] for r in made if r["file"] is None]
        if full:
            anew = often.where(F.pmod("k2", F.lit(len(files))).isin(full)).select("k1", "k2", F.lit(1).alias("sign"))
            made = [r for r in made if r["file"] is not None] + self._write(anew, [None] * len(files)).collect()
        for r in made:
            files[r["shard"]], sizes[r["shard"]] = r["file"], r["size"]
        self._made = Filters(min_docs, often, files, sizes)
        return self._made

    def _write(self, changes: DataFrame, files: list[str | None]) -> DataFrame:
        """(shard, file, size) of the filters that changes (k1, k2, sign) touch; no file where a filter became too full for them."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, keys, signs in _shards(batches):
                try:
                    if files[shard] is None:
                        made = _built(keys[signs > 0])
                    else:
                        made = CuckooFilter.load(_shared.get(files[shard]))
                        made.delete(keys[signs < 0])
                        made.insert(keys[signs > 0])
                except OverflowError:
                    file, data = None, b""
                else:
                    file, data = f"{path}/filters/{shard}-{uuid.uuid4().hex}.cuckoo", made.dump()
                    _shared.put(file, data)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([file], pa.string()), pa.array([len(data)], pa.int64())], names=["shard", "file", "size"])

        dealt = changes.select(F.pmod("k2", F.lit(len(files))).cast("int").alias("shard"), "k1", "sign").repartition(len(files), "shard").sortWithinPartitions("shard")
        return _shared.saved(dealt.mapInArrow(_shared.lean(run), "shard int, file string, size long"), "filters")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, signs) from rows (shard, k1, sign) sorted by shard; a shard has about shard_keys rows."""
    now, held = None, []
    for batch in batches:
        shard, key, sign = (c.to_numpy() for c in batch.columns)
        for s in np.unique(shard):
            if s != now and held:
                yield now, *(np.concatenate(x) for x in zip(*held))
                held = []
            now = int(s)
            held.append((key[shard == s], sign[shard == s]))
    if held:
        yield now, *(np.concatenate(x) for x in zip(*held))


def _sift(entries: DataFrame, made: Filters, filter_limit: int) -> DataFrame:
    """The entries whose keys the filters hold, with others that look like them."""
    files, shards = made.files, len(made.files)
    small = sum(made.sizes) <= filter_limit
    if not small:
        shard, part = F.pmod("k2", F.lit(shards)), F.pmod(F.xxhash64("doc"), F.lit(16))
        entries = entries.repartition(shard, part).sortWithinPartitions(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, CuckooFilter] = {}
        for batch in batches:
            key, shard = batch.column(0).to_numpy(), np.mod(batch.column(1).to_numpy(), shards)
            keep = np.zeros(len(key), bool)
            for s in np.unique(shard).tolist():
                if files[s] is None:
                    continue
                if s not in held:
                    if not small:
                        held.clear()
                    held[s] = CuckooFilter.load(_shared.get(files[s]))
                own = shard == s
                keep[own] = held[s].contains(key[own])
            yield batch.filter(pa.array(keep))

    return entries.mapInArrow(_shared.lean(run), f"{KEY}, doc long")


def _without(data: np.ndarray, at: np.ndarray, found: Lines, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of the texts without the lines that are gone; the others stay, joined by new lines."""
    opens = np.ones(len(found.text), bool)
    opens[1:] = found.text[1:] != found.text[:-1]
    left = np.flatnonzero(~gone)
    leads = left[np.flatnonzero(np.diff(found.text[left], prepend=-1))]  # first line of each text that stays
    delta = np.zeros(len(data) + 1, np.int64)
    # a line goes with the line break before it, and so does the break before a text's first line that stays
    np.add.at(delta, found.start[gone] - ~opens[gone], 1)
    np.add.at(delta, found.end[gone], -1)
    leads = leads[~opens[leads]]
    np.add.at(delta, found.start[leads] - 1, 1)
    np.add.at(delta, found.start[leads], -1)
    keep = np.cumsum(delta[:-1]) <= 0
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def dedup(docs: DataFrame, store: LineStore, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", filter_limit: int = 64 << 20) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_dropped of each row, against all that the store holds.

    A key in at least min_docs documents loses its lines except in the last document that holds it."""
    least = store.least
    made = store.filters(min_docs)
    total = made.often.agg(F.sum("n_rows")).first()[0] or 0
    entries = _sift(_entries(docs, id_col, text_col, least), made, filter_limit).distinct()
    known = _shared.lookup(entries, made.often, ["k1", "k2"], total).where("doc <> last_doc")
    lost = known.groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("lost"))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in _words.pieces(batch.column(1)):
                found = lines(data, at, least)
                lists = batch.column(2).slice(lo, hi - lo)
                row = pc.list_parent_indices(lists).to_numpy()
                pairs = lists.flatten()
                gone = np.zeros(len(found.text), bool)
                if len(row):
                    k1, k2 = (pairs.field(i).to_numpy() for i in (0, 1))
                    u, v = np.unique(k1), np.unique(k2)
                    i, j = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((u, found.k1), (v, found.k2)))
                    place = lambda r, a, b: (r * len(u) + a) * len(v) + b
                    same = (u[i] == found.k1) & (v[j] == found.k2)
                    same &= np.isin(place(found.text[found.keyed], i, j), place(row, np.searchsorted(u, k1), np.searchsorted(v, k2)))
                    gone[found.keyed[same]] = True
                n, n_gone = (np.bincount(found.text, w, hi - lo).astype(np.int64) for w in (None, gone))
                text, of = _without(data, at, found, gone)
                column = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(of.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column.cast(pa.string()), pa.array(n), pa.array(n_gone)], names=["doc_id", "text", "n_lines", "n_dropped"])

    return source.join(lost, "doc", "left").select("doc_id", "text", "lost").mapInArrow(_shared.lean(rewrite), f"doc_id {kind}, text string, n_lines long, n_dropped long")
