"""Token ids in compact files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

Writing: every text becomes token ids and an end id (one pass, kept as a table in the shared folder, with each task's counts of the
ids); the counts are added up over the whole corpus; package-merge gives code lengths of at most ``limit`` bits (more where a vocabulary
needs them, 24 at most) and the canonical codes follow from the lengths alone, which are all that the model file holds. Each document
is coded on its own and starts at a whole byte; the coded documents are dealt by ranges of doc_id, sorted, and each range is written as
files of about ``file_tokens`` tokens, in blocks, while it streams by, so a task holds one file's bytes at most.

File: blocks one after the other. Block: magic, counts, then arrays - document ids and null marks, tokens and
bytes of each document, bit offsets (from the document's first byte) of every ``every``-th token - and the codes.
Any block can be read alone with the model file; from any checkpoint decoding can begin.

Reading: a block's checkpoints are lanes that are decoded in step, one table lookup a token for all of them (a second one
for codes of more than 16 bits).

Encoding: a byte-level tokenizer without normalizer always cuts a text before a space that a character other than white space follows, and after
a letter that an ASCII character other than a letter follows (of these, spaces stay with what comes after them), so a text is the sequence of the pieces between such places. The pieces of some megabytes are dictionary-encoded with Arrow, each different one is encoded
by the tokenizers library unless the worker remembers it, and its ids are gathered for all places where it stands. Texts that hold one of the tokenizer's added
tokens, and all texts under other tokenizers, are encoded whole.

Defined cases: null text is empty and has only the end id; null doc_id comes first; rows that repeat a doc_id
stand beside each other in the order of their tokens' number and codes; doc_id has to be an integer, as files hold it in 64 bits;
an empty table gives no file; a very long text is a piece of work of its own and one block; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, _words

MAGIC = np.uint32(0x48554631)
LIMIT, MOST, TABLE, EVERY = 16, 24, 16, 128
#: Bytes of text whose pieces share a dictionary, and pieces that a worker remembers (some 30 MB); they bound memory only.
RUN, CACHED = 4 << 20, 500_000
_encoders: dict[str, _Encoder] = {}
#: First bytes of white space that isn't ASCII, and all such characters.
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_BLANKS = [c.encode() for c in "\u0085\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the spaces that a character of the same text follows which isn't white space."""
    spot = np.flatnonzero(data[:-1] == 32) if len(data) else np.zeros(0, np.int64)
    spot = spot[~_BLANK[data[spot + 1]]]
    end = np.zeros(len(data) + 1, bool)
    end[at] = True
    spot = spot[~end[spot + 1]]
    if len(odd := np.flatnonzero(_WIDE[data[spot + 1]])):
        blank = np.zeros(len(odd), bool)
        for c in _BLANKS:
            same = spot[odd] + len(c) < len(data)
            for j, x in enumerate(c):
                same &= data[np.minimum(spot[odd] + 1 + j, len(data) - 1)] == x
            blank |= same
        spot = np.delete(spot, odd[blank])
    return spot


_LETTER, _SIGN = (np.array([x < 128 and x != 32 and chr(x).isalpha() == letter for x in range(256)]) for letter in (True, False))


def _word_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of ASCII characters, other than letters and spaces, that follow an ASCII letter of the same text."""
    spot = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
    return spot[at[np.searchsorted(at, spot)] != spot]


class _Encoder:
    """A tokenizer; pieces says whether texts may be cut before words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.made = made = Tokenizer.from_file(path)
        before = made.pre_tokenizer
        self.pieces = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and not any((made.normalizer, made.truncation, made.padding, getattr(made.model, "dropout", None)))
        self.added = [x.content for x in made.get_added_tokens_decoder().values()]
        vocabulary = made.get_vocab()
        self.kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        # in the byte-level alphabet a leading space is this letter; only the first token of a piece has it
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        del vocabulary
        _shared.trim()
        self._forget()

    def _forget(self) -> None:
        """known: pieces; ids and of: their ids; key and place: their hashes in order and where they stand; met: which were met again."""
        self.known, self.ids, self.of = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.key, self.place, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, one after the other, and len + 1 offsets into them."""
        data, at = _words.utf8(pieces)
        data, at = data[at[0] : at[-1]], at - at[0]
        spaces = np.concatenate(([0], np.cumsum(data == 32)))
        first = np.zeros(len(data) + 1, bool)
        first[_cuts(data, at)] = True
        plain = first[at[:-1]] & (spaces[at[1:]] - spaces[at[:-1]] == 1)
        for token in self.added:
            plain &= ~pc.match_substring(pieces, token).to_numpy(zero_copy_only=False)
        n = np.zeros(len(pieces), np.int64)
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        found = [np.zeros(0, np.uint32)]
        for lo in range(0, len(own), 2000):  # words one after the other are cut again before each
            some = own[lo : lo + 2000]
            ids = self.alone(["".join(pieces.take(pa.array(some)).to_pylist())])[0]
            start = np.flatnonzero(self.leads[ids])
            if len(start) != len(some):
                raise ValueError("not a byte-level tokenizer")
            n[some] = np.diff(start, append=len(ids))
            found.append(ids)
        odd = self.alone(pieces.take(pa.array(rest)).to_pylist()) if len(rest) else []
        n[rest] = [len(x) for x in odd]
        stop = np.cumsum(n)
        out = np.empty(int(n.sum()), np.uint32)
        out[np.repeat(plain, n)] = np.concatenate(found)
        for i, ids in zip(rest, odd):
            out[stop[i] - n[i] : stop[i]] = ids
        return out, np.concatenate(([0], stop))

    def dictionary(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it the ids of each of some different pieces start and how many they are."""
        data, at = _words.utf8(pieces)
        key = _words.hash_spans(_words._BYTE[data[at[0] : at[-1]]], at[:-1] - at[0], at[1:] - at[0])
        where = np.full(len(pieces), -1)
        if len(self.key):
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            some = np.flatnonzero(self.key[spot] == key)
            place = self.place[spot[some]]
            same = pc.equal(pieces.take(pa.array(some)), self.known.take(pa.array(place))).to_numpy(zero_copy_only=False)
            where[some[same]] = place[same]
            self.met[place[same]] = True
        new = np.flatnonzero(where < 0)
        fresh = pieces.take(pa.array(new))
        ids, of = self.encoded(fresh)
        where[new] = len(self.known) + np.arange(len(new))
        pool, of = np.concatenate((self.ids, ids)), np.concatenate((self.of, self.of[-1] + of[1:]))
        start, n = of[where], np.diff(of)[where]
        known, met, keys, places = pa.concat_arrays([self.known, fresh]), np.append(self.met, np.zeros(len(new), bool)), np.append(self.key, key[new]), np.append(self.place, where[new].astype(np.int32))
        if len(known) > CACHED:  # those that came back stay, with the latest
            kept = met.copy()
            kept[len(self.known) :] = True
            if np.count_nonzero(kept) > CACHED:
                kept[: len(self.known)] = False
            number = np.cumsum(kept) - 1
            size = np.diff(of)
            self.ids, self.of = pool[np.repeat(kept, size)], np.concatenate(([0], np.cumsum(size[kept])))
            known, met = known.filter(pa.array(kept)), np.zeros(np.count_nonzero(kept), bool)
            stay = kept[places]
            keys, places = keys[stay], number[places[stay]].astype(np.int32)
        else:
            self.ids, self.of = pool, of
        order = np.argsort(keys, kind="stable")
        self.known, self.met, self.key, self.place = known, met, keys[order], places[order]
        return pool, start, n


def encode_texts(texts: pa.Array, path: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, one after the other, and how many each text has."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    held = _encoders[path]
    data, at = _words.utf8(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    cuts = np.concatenate((_cuts(data, at), _word_ends(data, at))) if held.pieces and len(data) else np.zeros(0, np.int64)
    for token in held.added if len(cuts) else ():
        whole = np.flatnonzero(pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False))
        if len(whole):
            cuts = cuts[~np.isin(np.searchsorted(at, cuts, "right") - 1, whole)]
    some = np.flatnonzero(np.diff(at))
    start = np.sort(np.concatenate((cuts, at[some])))
    start = start[np.diff(start, prepend=-1) > 0]  # a text that begins with a cut
    pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = pieces.dictionary_encode()
    pool, first, n = held.dictionary(coded.dictionary)
    # the end id is one more piece after each text's own
    pool, first, n = np.append(pool, np.uint32(end_id)), np.append(first, len(pool)), np.append(n, 1)
    bounds = np.searchsorted(start, at)
    index = np.insert(coded.indices.to_numpy(), bounds[1:], len(n) - 1)
    size = n[index]
    total = np.concatenate(([0], np.cumsum(size)))
    n_tokens = np.diff(total[bounds + np.arange(len(bounds))])
    out = np.empty(int(total[-1]), held.kind if end_id <= np.iinfo(held.kind).max else np.uint32)
    for lo in range(0, len(index), 1 << 17):
        part, many = index[lo : lo + (1 << 17)], size[lo : lo + (1 << 17)]
        a, b = total[lo], total[min(lo + (1 << 17), len(index))]
        out[a:b] = pool[np.repeat(first[part] - (total[lo : lo + len(part)] - a), many) + np.arange(b - a)]
    return out, n_tokens


def widest(counts: np.ndarray, limit: int = LIMIT) -> int:
    """limit, or as many bits as the symbols need and two more."""
    return max(limit, min(MOST, int(np.count_nonzero(counts) - 1).bit_length() + 2)) if np.count_nonzero(counts) > 1 << (limit - 1) else limit


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each symbol (0: it doesn't occur) by package-merge; at most limit bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << min(limit, MOST):
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64)
    n = len(leaf)
    #: per level: how many of its first items are leaves, as a running count
    levels = []
    packed = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packed])
        order = np.argsort(both, kind="stable")
        levels.append(np.concatenate(([0], np.cumsum(order < n))))
        both = both[order]
        packed = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for level in reversed(levels):
        leaves = level[take]
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = length
    return out


class Codes(NamedTuple):
    """Length and code of each symbol; what the first ``bits`` bits of a window stand for (width 0: a longer code); of the
    symbols in the order of their codes, where each one's windows of ``limit`` bits begin."""

    length: np.ndarray
    code: np.ndarray
    symbols: np.ndarray
    widths: np.ndarray
    bits: int
    limit: int
    order: np.ndarray
    first: np.ndarray


def canonical(length: np.ndarray, limit: int = LIMIT) -> Codes:
    """Codes in the order (length, symbol), with their tables."""
    used = np.flatnonzero(length)
    used = used[np.lexsort((used, length[used]))]
    width = length[used].astype(np.int64)
    span = 1 << (limit - width)
    first = np.cumsum(span) - span
    code = np.zeros(len(length), np.uint64)
    code[used] = (first >> (limit - width)).astype(np.uint64)
    bits = min(limit, TABLE)
    symbols, widths = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    short = width <= bits
    many = span[short] >> (limit - bits)
    symbols[: many.sum()] = np.repeat(used[short], many)
    widths[: many.sum()] = np.repeat(width[short], many)
    return Codes(length.astype(np.int64), code, symbols, widths, bits, limit, used, first)


def pack(ids: np.ndarray, n_tokens: np.ndarray, codes: Codes, every: int = EVERY) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Bits of documents one after the other, each from a whole byte on; bytes of each; bit offsets of its checkpoints."""
    width = codes.length[ids]
    end = np.cumsum(width)
    stop = np.cumsum(n_tokens)
    first = stop - n_tokens
    ends = np.concatenate(([0], end))
    bits = ends[stop] - ends[first]
    size = (bits + 7) // 8
    base = (np.cumsum(size) - size) * 8 - ends[first]
    at = end - width + np.repeat(base, n_tokens)
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    value = codes.code[ids] << (np.uint64(64) - shift - width.astype(np.uint64))
    n = int(size.sum()) // 4 + 3
    total = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = total.astype(np.uint64).astype(">u4").tobytes()[: int(size.sum())]
    marks = [ends[a:b:every] - ends[a] for a, b in zip(first, stop)]
    return data, size, marks


def unpack(data: np.ndarray, lane_bit: np.ndarray, lane_tokens: np.ndarray, codes: Codes) -> np.ndarray:
    """Ids of all lanes in order; every lane begins at a bit of data and holds so many tokens."""
    out = np.empty(int(lane_tokens.sum()), np.uint32)
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    start = np.cumsum(lane_tokens) - lane_tokens
    order = np.argsort(-lane_tokens, kind="stable")
    bit, start, left = lane_bit[order].astype(np.int64), start[order], lane_tokens[order]
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")  # lanes with more than step tokens
    down, all_short = np.uint32(32 - codes.bits), not len(codes.order) or codes.length.max() <= codes.bits
    for step, n in enumerate(live):
        own = bit[:n]
        seen = window[own >> 3] << (own & 7).astype(np.uint32)
        key = seen >> down
        symbol, width = codes.symbols[key], codes.widths[key]
        if not all_short and len(long := np.flatnonzero(width == 0)):
            symbol[long] = codes.order[np.searchsorted(codes.first, seen[long] >> np.uint32(32 - codes.limit), "right") - 1]
            width[long] = codes.length[symbol[long]]
        out[start[:n] + step] = symbol
        own += width
    return out


def _block(rows: list[tuple]) -> bytes:
    """rows: (doc_id, n_tokens, code, marks)"""
    marks = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
    head = np.array([MAGIC, len(rows), len(marks), sum(len(r[2]) for r in rows)], "<u4")
    parts = [
        head.tobytes(),
        np.array([0 if r[0] is None else r[0] for r in rows], "<i8").tobytes(),
        np.array([r[0] is None for r in rows], "u1").tobytes(),
        np.array([r[1] for r in rows], "<u4").tobytes(),
        np.array([len(r[2]) for r in rows], "<u4").tobytes(),
        marks.astype("<u4").tobytes(),
        *(r[2] for r in rows),
    ]
    return b"".join(parts)


def read_block(data: bytes, codes: Codes, every: int = EVERY) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each, and all ids in order."""
    magic, n, n_marks, n_bytes = np.frombuffer(data, "<u4", 4)
    if magic != MAGIC or len(data) != 16 + 17 * n + 4 * n_marks + n_bytes:
        raise ValueError("not a block")
    at = 16
    ids = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, "u1", n, at := at + 8 * n)
    tokens = np.frombuffer(data, "<u4", n, at := at + n).astype(np.int64)
    size = np.frombuffer(data, "<u4", n, at := at + 4 * n).astype(np.int64)
    marks = np.frombuffer(data, "<u4", n_marks, at := at + 4 * n).astype(np.int64)
    code = np.frombuffer(data, np.uint8, n_bytes, at + 4 * n_marks)
    lanes = -(-tokens // every)
    doc = np.repeat(np.arange(n), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lane_tokens = np.minimum(every, tokens[doc] - nth * every)
    ids_out = unpack(code, marks + 8 * (np.cumsum(size) - size)[doc], lane_tokens, codes)
    return [None if z else int(i) for i, z in zip(ids, null)], tokens, ids_out


class TokenFiles:
    """What write() leaves in the shared folder: model.bin, data files, and a table of their blocks."""

    def __init__(self, path: str, blocks: DataFrame, every: int, limit: int):
        self.path, self.blocks, self.every, self.limit = path, blocks, every, limit

    def codes(self) -> Codes:
        return canonical(np.frombuffer(zlib.decompress(_shared.get(f"{self.path}/model.bin")), np.uint8), self.limit)

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
        me, every = TokenFiles(self.path, None, self.every, self.limit), self.every

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = me.codes()
            for batch in batches:
                for file, offset, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                    docs, tokens, ids = read_block(_shared.get(file, offset, length), codes, every)
                    stop = np.cumsum(tokens)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop, tokens)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + stop - tokens), pa.array(tokens), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        # a row for each range that was written, summed up from the first on; ranges are as many as the tasks that wrote
        ranges = self.blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        base = ranges.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        parts = max(1, self.blocks.sparkSession.sparkContext.defaultParallelism * 2)
        todo = self.blocks.join(base, F.col("shard") == F.col("s")).select("file", "offset", "length", (F.col("base") + F.col("before")).alias("start"))
        return todo.repartition(parts).mapInArrow(_shared.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _binary(data: bytes, size: np.ndarray) -> pa.Array:
    """The parts of data, one after the other, as a column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _held(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 23, block_bytes: int = 1 << 20, limit: int = LIMIT, every: int = EVERY) -> TokenFiles:
    """Write all texts of docs as token files in ascending order of id_col."""
    spark: SparkSession = docs.sparkSession
    path = _shared.shared_dir(spark, "tokens")
    schema = "doc_id long, n_tokens long, width int, ids binary, counts binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for lo, hi, _, _ in _words.pieces(batch.column(1), RUN):
                ids, n = encode_texts(batch.column(1).slice(lo, hi - lo), tokenizer_path, end_id)
                for a in range(0, len(ids), 1 << 18):
                    own = np.bincount(ids[a : a + (1 << 18)], minlength=len(total))
                    own[: len(total)] += total
                    total = own
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(np.full(len(n), ids.itemsize, np.int32)), _binary(ids.tobytes(), n * ids.itemsize), pa.nulls(len(n), pa.binary())], names=names)
                _shared.trim()
        # the task's counts are a row of their own, which alone has this column
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary())], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw_path = f"{path}/raw"
    source.mapInArrow(_shared.lean(tokens), schema).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(schema).parquet(raw_path).drop("counts").where("n_tokens >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                used, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    told = spark.read.schema("counts binary").parquet(raw_path).where("counts IS NOT NULL")
    counted = told.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    counts = np.zeros(int(max(counted["id"].to_pylist(), default=0)) + 1, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    limit = widest(counts, limit)
    length = code_lengths(counts, limit)
    _shared.put(f"{path}/model.bin", zlib.compress(length.tobytes()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(length, limit)
        for batch in batches:
            n_tokens = batch.column(1).to_numpy()
            group = np.cumsum(n_tokens) // 500_000
            for lo, hi in zip(edges := np.flatnonzero(np.diff(group, prepend=-1)), [*edges[1:], len(group)]):
                part = batch.slice(lo, hi - lo)
                data, size, marks = pack(_held(part.column(3)).view(f"<u{part.column(2)[0].as_py()}").astype(np.int64), n_tokens[lo:hi], codes, every)
                check = [zlib.crc32(data[b - n : b]) for b, n in zip(np.cumsum(size).tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(check, pa.int64()), _binary(data, size), _binary(np.concatenate(marks).astype("<u4").tobytes(), np.array([4 * len(m) for m in marks]))], names=["doc_id", "n_tokens", "check", "code", "marks"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()  # ranges are numbered in order
        out, found, rows, size, before, number = io.BytesIO(), [], [], 0, 0, 0
        held = 0

        def flush() -> None:
            nonlocal rows, size, before, held
            if rows:
                block, n = _block(rows), sum(r[1] for r in rows)
                found.append((out.tell(), len(block), before, n))
                out.write(block)
                before, held = before + n, held + n
                rows, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, found, number, held
            flush()
            if found:
                file = f"{path}/data-{shard:06d}-{number:06d}.huf"
                _shared.put(file, out.getvalue())
                offset, nbytes, start, n = (pa.array(x, pa.int64()) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(found), pa.int32()), pa.array([file] * len(found)), offset, nbytes, start, n], names=["shard", "file", "offset", "length", "before", "n_tokens"])
                out, found, number, held = io.BytesIO(), [], number + 1, 0

        for batch in batches:
            for doc, n, bits, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                rows.append((doc, n, bits, marks))
                size += len(bits)
                if size >= block_bytes:
                    flush()
                    if held >= file_tokens:
                        yield from close()
        yield from close()

    files = max(1, -(-int(counts.sum()) // file_tokens))
    order = ["doc_id", "n_tokens", "check"]  # documents without id or with the same one are dealt, too
    dealt = raw.mapInArrow(_shared.lean(code), "doc_id long, n_tokens long, check long, code binary, marks binary").repartitionByRange(files, *order).sortWithinPartitions(*order, "code")
    blocks = _shared.saved(dealt.mapInArrow(_shared.lean(store), "shard int, file string, offset long, length long, before long, n_tokens long"), "blocks")
    _shared.drop(spark, raw_path)
    return TokenFiles(path, blocks, every, limit)
