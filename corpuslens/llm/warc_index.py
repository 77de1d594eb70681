"""WARC archives with a two-level capture index.

``write`` stores one record per page (a gzip member each) in archive files; pages whose payload another page
with a smaller id has already are revisit records without payload; a payload that many pages share is looked up by broadcast. Captures are then sorted by their reversed-host
key into index shards: blocks of lines, compressed, and for each shard a sparse directory with the first
key of each block. ``lookup`` deals the wanted keys to the shards by binary search over the shards' first keys, finds
the block by binary search in the shard's directory, reads that range of the index file, then searches the block.
``fetch`` reads ranges of the archives. The only list that the driver holds has one key per index shard.

Defined cases: null html is an empty payload; a null url has the empty key; a null page_id is a response of its
own; rows that repeat a page_id are records of their own, each found by each look-up of the key that they share; page ids have to be integers; a very long page is a record
like any other; other columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URL = re.compile(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?(.*)", re.S)


def reversed_host_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL, without scheme, user and fragment; hosts in lower case."""
    scheme, host, port, rest = _URL.match(url or "").groups()
    rest = rest.split("#", 1)[0] or "/"
    front = ",".join(reversed((host or "").lower().strip(".").split("."))) + (f":{port}" if port and (scheme or "").lower() + port not in ("http80", "https443") else "")
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", f"{front}){rest}")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Keys sort by URL, then by page; unlike dates in archives' indexes, page ids tell captures apart."""
    return f"{reversed_host_key(url)} {'' if page_id is None else page_id}"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; first: the page that holds the payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)))
    if first is not None:
        head += [("WARC-Refers-To", _uri(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = http + (payload if first is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    if field["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("damaged payload")
    return page(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), size, digest, field["WARC-Type"], page(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None


def write_archives(pages: DataFrame, path: str, min_revisit: int = 100, file_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Archive files in path/archive; a row of CAPTURE for each record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # of payloads that several pages share; partial sums come before the exchange, so a common page is no large group
    shared = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    shared = _shared.saved(shared, "digests")
    rows = _shared.lookup(rows, shared, ["digest"], pages.count()).select("page_id", "url", "payload", "digest", F.expr("CASE WHEN page_id > first AND octet_length(payload) >= " + str(int(min_revisit)) + " THEN first END").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = io.BytesIO(), []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out, found
            if found:
                file = f"{path}/archive/{uuid.uuid4().hex}.warc.gz"  # a task that runs twice leaves a file that no row names
                _shared.put(file, out.getvalue())
                key, page, offset, length = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(page, pa.int64()), pa.array([file] * len(key)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
                out, found = io.BytesIO(), []

        for batch in batches:
            for page, url, payload, digest, first in zip(*batch.columns):
                page, url = page.as_py(), url.as_py()
                data = gzip.compress(record(page, url, payload.as_py(), digest.as_py(), first.as_py()), level, mtime=0)
                found.append((capture_key(url, page), page, out.tell(), len(data)))
                out.write(data)
                if out.tell() >= file_bytes:
                    yield from flush()
        yield from flush()

    captures = _shared.saved(rows.mapInArrow(_shared.lean(run), CAPTURE), "captures")
    _shared.drop_saved(shared)
    return captures


class CaptureIndex:
    """Index shards in path/index; ``shards`` has the first key of each, in order."""

    def __init__(self, spark: SparkSession, path: str, captures: DataFrame, block_lines: int = 500, shard_lines: int = 1_000_000):
        self.spark, self.path = spark, path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, directory, lines, first = io.BytesIO(), [], [], None
            name = uuid.uuid4().hex

            def flush() -> None:
                if lines:
                    data = zlib.compress("\n".join("\t".join(x) for x in lines).encode("utf-8", "surrogatepass"))
                    directory.append((lines[0][0], str(out.tell()), str(len(data))))
                    out.write(data)
                    lines.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    first = row[0] if first is None else first
                    lines.append(["" if x is None else str(x) for x in row])
                    if len(lines) >= block_lines:
                        flush()
            flush()
            if directory:
                _shared.put(f"{path}/index/{name}.idx", out.getvalue())
                _shared.put(f"{path}/index/{name}.dir", zlib.compress("\n".join("\t".join(x) for x in directory).encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "name"])

        # the bytes' order, as strings in Python sort by code point
        parts = max(1, -(-captures.count() // shard_lines), min(spark.sparkContext.defaultParallelism, captures.count() // (20 * block_lines)))
        dealt = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
        made = _shared.saved(dealt.mapInArrow(run, "first string, name string"), "shards")
        self.shards = sorted((r["first"], r["name"]) for r in made.collect())  # one row an index shard

    def lookup(self, keys: DataFrame) -> DataFrame:
        """CAPTURE rows of all captures with a key of the column key."""
        shards, path = self.shards, self.path
        if not shards:
            return self.spark.createDataFrame([], CAPTURE)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = [s[0] for s in shards]
            for batch in batches:
                own = batch.column(0).to_pylist()
                lo = [max(0, bisect.bisect_left(firsts, k) - 1) for k in own]
                hi = [max(0, bisect.bisect_right(firsts, k) - 1) for k in own]  # more than one shard only where a key fills shards
                pairs = [(k, s) for k, a, b in zip(own, lo, hi) for s in range(a, b + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], names=["key", "shard"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple = (None,)
            for batch in batches:
                found: list[list[str]] = []
                for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if held[0] != shard:
                        base = f"{path}/index/{shards[shard][1]}"
                        rows = [x.split("\t") for x in zlib.decompress(_shared.get(f"{base}.dir")).decode("utf-8", "surrogatepass").split("\n")]
                        held = shard, base, [r[0] for r in rows], rows, {}
                    _, base, firsts, rows, blocks = held
                    for n in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                        if n not in blocks:
                            if len(blocks) > 8:
                                blocks.clear()
                            lines = [x.split("\t") for x in zlib.decompress(_shared.get(f"{base}.idx", int(rows[n][1]), int(rows[n][2]))).decode("utf-8", "surrogatepass").split("\n")]
                            blocks[n] = [x[0] for x in lines], lines
                        own, lines = blocks[n]
                        found += lines[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([int(x[1]) if x[1] else None for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string()), pa.array([int(x[3]) for x in found], pa.int64()), pa.array([int(x[4]) for x in found], pa.int64())], names=["key", "page_id", "file", "offset", "length"])

        wanted = keys.select("key").distinct().mapInArrow(route, "key string, shard int")
        return wanted.repartitionById(len(shards), F.col("shard")).sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def fetch(captures: DataFrame, read_bytes: int = 8 << 20) -> DataFrame:
    """RECORD rows of captures, read from the archives in ranges that take neighbours together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ("", 0, b"")
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, (file, offset, length) in enumerate(zip(files, offsets, lengths)):
                if held[0] != file or offset < held[1] or offset + length > held[1] + len(held[2]):
                    stop = offset + length
                    for f, o, n in zip(files[i + 1 :], offsets[i + 1 :], lengths[i + 1 :]):
                        if f != file or o > stop + 65536 or o + n - offset > read_bytes:
                            break
                        stop = max(stop, o + n)
                    held = file, offset, _shared.get(file, offset, stop - offset)
                at = offset - held[1]
                found.append(parse(gzip.decompress(held[2][at : at + length])))
            rows = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = captures.sparkSession.sparkContext.defaultParallelism * 4
    return captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_shared.lean(run), RECORD)


def keys_of(pages: DataFrame) -> DataFrame:
    """The capture keys of pages, to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(run, "key string")
