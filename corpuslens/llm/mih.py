"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning: on a bounded sample (``sample`` vectors, or as many as fill ``sample_bytes`` of at least 1,000, those with the smallest hashes of their ids) vectors are centred and
rotated to their principal axes, then several rotations are fitted in turn so that signs keep most (iterative
quantization), each giving as many bits as there are axes. For inner products, vectors are first divided by the largest
length and given one more component that makes all of length one; queries get 0 there. The search radius is the
one that would have found the share ``target`` of true neighbours within the sample.

Search: a code is cut in substrings of 16 bits; two codes within the radius are, in one of m substrings at least, within its
part of it (pigeonhole). Vectors are indexed in blocks. A block has an inverted list for each substring: its values in order, and
for each value the rows that have it. A query probes the lists: the values within its part of the radius are found by flipping bits, where those flips
are fewer than the block's values, else by going through the values; only the rows in their lists are candidates. Candidates are compared
by whole code, and those within the radius scored with the original vectors. The queries, in blocks of bounded size in the shared folder, go
through each block of rows. Queries that found fewer than k, such as outliers of a
clustered table, are searched again at twice the radius until they are full or all codes are within it. Equal vectors are one: of each, the smallest ids as many
as a result can name are kept, and equal queries are searched once.

On data without structure in few directions neighbours are far in Hamming distance, too, the radius is then large and
most rows become candidates; the comparison of whole codes is what keeps the scoring small.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do those of
another length than the most frequent one; ties go to the smaller id; fewer candidates than k are all returned; repeated rows
(same id) are one vector if equal; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

SUB = 16
#: Pairs of queries and rows that are looked at together; it bounds memory only.
PAIRS = 1 << 20


class Codes(NamedTuple):
    mean: np.ndarray
    rotations: np.ndarray
    largest: float
    radius: int


def _unit(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    if query:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
    x = x / largest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])


def encode(codes: Codes, x: np.ndarray, query: bool = False) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    z = (_unit(x, codes.largest, query) - codes.mean) @ codes.rotations
    bits = np.packbits(z > 0, axis=1)
    if bits.shape[1] % 2:
        bits = np.column_stack([bits, np.zeros(len(bits), np.uint8)])
    return np.ascontiguousarray(bits).view(np.uint16)


def _distances(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(codes)), np.uint16)
    for j in range(codes.shape[1]):
        out += np.bitwise_count(q[:, j, None] ^ codes[None, :, j])
    return out


def learn(x: np.ndarray, n_all: int, largest: float, k: int = 20, bits: int = 256, target: float = 0.985, seed: int = 5, rounds: int = 20) -> Codes:
    rng = np.random.default_rng(seed)
    u = _unit(x, largest, False)
    mean = u.mean(0)
    u = u - mean
    _, s, axes = np.linalg.svd(u, full_matrices=False)
    axes = axes[s > 1e-9 * max(s[0], 1e-300)] if len(s) and s[0] > 0 else axes[:1]
    d, parts = len(axes), []
    v = u @ axes.T
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            b, _, a = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v, full_matrices=False)
            r = (b @ a).T
        parts.append(axes.T @ r)
    codes = Codes(mean, np.column_stack(parts)[:, : max(bits, 1)], largest, 0)
    probe = x[rng.permutation(len(x))[:300]]
    near = max(1, -(-k * len(x) // max(n_all, 1)))
    score = probe @ x.T
    dist = _distances(encode(codes, probe, True), encode(codes, x))
    own = np.argsort(-score, axis=1, kind="stable")[:, 1 : near + 1]  # without itself
    found = np.take_along_axis(dist, own, 1).ravel()
    radius = int(np.quantile(found, target, method="higher")) if len(found) else codes.rotations.shape[1]
    return codes._replace(radius=radius)


def _flips(most: int) -> int:
    return sum(comb(SUB, i) for i in range(most + 1))


@cache
def _masks(most: int) -> np.ndarray:
    """All values of a substring with at most so many bits set."""
    every = np.arange(1 << SUB, dtype=np.uint32).astype(np.uint16)
    return every[np.bitwise_count(every) <= most]


class Block:
    """Inverted lists of the substrings of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = codes.view(np.uint64) if codes.shape[1] % 4 == 0 else codes
        self.lists = []
        for column in codes.T:
            rows = np.argsort(column, kind="stable").astype(np.int32)
            values, first = np.unique(column[rows], return_index=True)
            self.lists.append((values, np.append(first, len(rows)), rows))

    def probe(self, j: int, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows whose substring j is within most bits of the query's."""
        values, first, rows = self.lists[j]
        if _flips(most) * 4 < len(values):
            wanted = q[:, None] ^ _masks(most)[None, :]
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            query, nth = np.nonzero(values[at] == wanted)
            value = at[query, nth]
        else:
            query, value = np.nonzero(np.bitwise_count(q[:, None] ^ values[None, :]) <= most)
        size = first[value + 1] - first[value]
        place = np.repeat(first[value] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.repeat(query, size), rows[place]

    def candidates(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows that some probe finds, each once."""
        m = len(self.lists)
        part, more = divmod(radius, m)
        found = np.zeros((len(q), len(self.codes)), bool)
        for j in range(m):
            most = part if j <= more else part - 1  # sum of (most + 1) is above the radius
            if most >= 0:
                found[self.probe(j, q[:, j], min(most, SUB))] = True
        return np.nonzero(found)

    def within(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all codes within the radius of each query's."""
        ask = np.ascontiguousarray(q).view(np.uint64) if self.whole.dtype == np.uint64 else q
        out = []
        step = max(1, PAIRS // max(1, len(self.codes)))
        for lo in range(0, len(q), step):
            i, r = self.candidates(q[lo : lo + step], radius)
            dist = np.zeros(len(i), np.uint16)
            for word in range(self.whole.shape[1]):
                dist += np.bitwise_count(ask[lo + i, word] ^ self.whole[r, word])
            out.append((lo + i[dist <= radius], r[dist <= radius]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, sample: int = 20_000, sample_bytes: int = 128 << 20, query_block: int = 256, row_block: int = 1 << 15) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by every, among all others."""
    with _shared.scope(vectors.sparkSession):
        return _search(vectors, every, k, id_col, vector_col, bits, sample, sample_bytes, query_block, row_block)


def _search(vectors: DataFrame, every: int, k: int, id_col: str, vector_col: str, bits: int, sample: int, sample_bytes: int, query_block: int, row_block: int) -> DataFrame:
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    length = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("v") == length["d"])
    # the smallest k + 1 ids of each vector; the limit applies within each partition before the exchange
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = _shared.saved(usable.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "vectors")
    stats = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("largest")).first()
    rows = min(sample, max(1000, sample_bytes // (8 * length["d"])))
    learnt = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    x = np.stack([np.asarray(r) for r in learnt["v"].to_pylist()])
    codes = learn(x, stats["n"], stats["largest"], k, bits)

    asked = usable.where(F.col("vec_id") % every == 0)
    twins = _shared.saved(asked.groupBy("v").agg(F.min("vec_id").alias("first"), F.countDistinct("vec_id").alias("n_rows")), "queries")
    best = Window.partitionBy("first").orderBy(F.desc("score"), "vec_id")

    def within(queries: DataFrame, radius: int) -> DataFrame:
        """The k + 1 nearest within the radius of each of the queries (v, first)."""
        path = _shared.shared_dir(spark, "queries")

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, query_block):
                    part = batch.slice(lo, query_block)
                    q = np.stack([np.asarray(r) for r in part.column(0).to_pylist()])
                    ids = part.column(1).to_numpy()
                    out = io.BytesIO()
                    np.savez(out, q=q, ids=ids, codes=encode(codes, q, True))
                    _shared.put(file := f"{path}/{ids[0]}.npz", out.getvalue())
                    yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

        files = [r["file"] for r in queries.select("v", "first").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(store, "file string").collect()]  # one name for each block of queries

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def answer(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
                block = Block(encode(codes, v))
                for file in files:
                    asked_ = np.load(io.BytesIO(_shared.get(file)))
                    q, names = asked_["q"], asked_["ids"]
                    i, r = block.within(asked_["codes"], radius)
                    score = np.concatenate([(q[i[a : a + 50_000]] * v[r[a : a + 50_000]]).sum(1) for a in range(0, len(i), 50_000)] or [np.zeros(0)])
                    best = _top(i, ids[r], score, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[best]]), pa.array(ids[r[best]]), pa.array(score[best])], names=["first", "vec_id", "score"])

            held: list[tuple] = []
            for batch in batches:
                for lo in range(0, batch.num_rows, row_block):
                    part = batch.slice(lo, row_block)
                    held.append((part.column(0).to_numpy(), np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)))
                    if sum(len(h[0]) for h in held) >= row_block:
                        yield from answer(*(np.concatenate(x) for x in zip(*held)))
                        held = []
            if held:
                yield from answer(*(np.concatenate(x) for x in zip(*held)))

        found = index.mapInArrow(_shared.lean(scan), "first long, vec_id long, score double")
        return _shared.saved(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank"), "near")

    full = min(k + 1, stats["n"])
    radius, most = codes.radius, codes.rotations.shape[1]
    near, left = within(twins, radius), twins
    while radius < most:
        left = _shared.saved(left.join(near.groupBy("first").count().where(F.col("count") >= full), "first", "left_anti").select("v", "first"), "short")
        if left.isEmpty():
            break
        radius = min(most, max(2 * radius, radius + SUB))
        near = near.join(left.select("first"), "first", "left_anti").unionByName(within(left, radius))
    # the answers of equal queries are one row, which goes to all of them; a vector that many queries have is no large group
    ids = asked.distinct()
    total = twins.agg(F.sum("n_rows")).first()[0] or 0
    names = _shared.lookup(ids, twins, ["v"], total).select(F.col("vec_id").alias("query_id"), "first")
    answers = near.groupBy("first").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("found"))
    answers = _shared.saved(answers.join(twins.select("first", "n_rows"), "first"), "answers")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    told = _shared.lookup(_shared.saved(names, "names"), answers, ["first"], total).select("query_id", F.posexplode(others).alias("at", "x"))
    return _shared.saved(told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "neighbours", keep=True)
