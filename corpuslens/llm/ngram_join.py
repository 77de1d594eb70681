"""N-gram Jaccard join by prefix trees, exact, for sets of word shingles.

1. One pass gives each document the size and a fingerprint of its set, and three keys of minima of hashes. Documents
   with equal sets are one from then on, so copies cost nothing further.
2. Sets that agree in a key of minima, likely near copies, are brought together in trees of bounded size; every pair in a
   tree is decided exactly. What links is one component; this only saves work in step 4.
3. Shingles are counted over all documents (sorted and delta-coded by ranges of their hash, so the exchange takes
   some two bytes each). Those in ``common`` documents or more come last in the global order, by count; the others
   come first, by hash. Sets that link share at least ``share`` shingles of their prefixes in that order.
4. Prefixes are inverted; shingles whose documents are all in one component are done. Of other pairs across components
   within the length bound, those that share fewer prefix shingles than linking needs are out, and the rest is
   decided in trees, too. A shingle with more than ``crowd`` documents left names no pairs: its documents become a
   block, together with those of other such shingles that have the same least document. A large block is cut by size, as sets of which one
   is much smaller can't link, and by hash into parts; parts of neighbouring sizes go through trees two by two, so a set is sent once
   for each part instead of each partner; parts that are all of one component don't meet. Components of all links come from
   alternating stars over tables in the shared folder.

A tree holds sets as paths of shingles in the global order from its frequent end on (among the shingles that are too rare to have been
counted, those that more sets of the tree have come first), in depth-first order. A probe goes through it with the overlap
of its path so far, computed once for all sets that share the path, and leaves a subtree as soon as more shingles are
missing than any set below could make up.

Keys that many rows share (copies of one text, a key of minima, a crowded shingle) are summed up before any exchange and looked up by
broadcast, as there can't be many of them; no task gets such a group whole.

Defined cases: null or empty texts have an empty set, link with nothing and are their own component; a text of
fewer words than a shingle has one shingle; rows that repeat a doc_id are judged each by its own text, and are in one component if
their texts link; a null doc_id is above all others; a very long text is worked on alone and its set has to fit in a task; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words

CHUNK = 192
PART = 512
#: Shingles in a part, tokens between two looks at the bounds, bytes of the table of probes: they bound memory only.
MOST = 500_000
STEP = 256
TABLE = 32_000_000
SEEDS = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 2**63, 9)]


class Sets:
    """What the steps have in common: shingle width and threshold num / den of the Jaccard similarity."""

    def __init__(self, width: int = 4, num: int = 85, den: int = 100, share: int = 3, common: int = 24, crowd: int = 32):
        self.width, self.num, self.den, self.share, self.common, self.crowd = width, num, den, share, common, crowd

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least intersection of linked sets of these sizes: den * i >= num * (a + b - i)."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n + (-self.num * n // self.den) + self.share)

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, sorted sets, offsets) of runs of texts."""
        for lo, hi, data, at in _words.pieces(column):
            hashed, _, _, bounds = _words.words(data, at, _words.SOLID)
            yield lo, hi, *_words.shingle_sets(hashed, bounds, self.width)


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits that equal sets share, whatever their order."""
    return _words.mix(_sum_by(_words.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds) + np.diff(bounds).astype(np.uint64))


def profile(docs: DataFrame, sets: Sets, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, fp, k0, k1, k2 of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, bounds in sets.of(batch.column(1)):
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                keys = np.zeros((3, len(n)), np.uint64)
                for j, seed in enumerate(SEEDS):
                    if len(some):
                        keys[j // 3, some] = _words.mix(keys[j // 3, some] * np.uint64(31) + np.minimum.reduceat(_words.mix(values ^ seed), bounds[some]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(x.view(np.int64)) for x in (fingerprints(values, bounds), *keys))], names=["doc_id", "n", "fp", "k0", "k1", "k2"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_shared.lean(run), f"doc_id {kind}, n long, fp long, k0 long, k1 long, k2 long")


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


class _Seen:
    """Fingerprints a task has had already; forgetting some only repeats work."""

    def __init__(self) -> None:
        self.held: set[int] = set()

    def fresh(self, fps: np.ndarray) -> np.ndarray:
        if len(self.held) > 500_000:
            self.held.clear()
        out = np.zeros(len(fps), bool)
        for i, x in enumerate(fps.tolist()):
            if x not in self.held:
                self.held.add(x)
                out[i] = True
        return out


def _choose(values: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts, and the place in texts of each value."""
    n = np.diff(bounds)[texts]
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + bounds[texts][of]
    return values[at], of


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of one part after the other, from rows (part, blob) sorted by part; a part is as large as its range of hashes."""
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(blob.as_py())
    if held:
        yield now, held


def common_shingles(docs: DataFrame, sets: Sets, text_col: str, total: int, limit: int = 2_000_000) -> np.ndarray:
    """First 40 bits of the shingles in at least ``common`` different sets of one task or more, rarest first.

    Every set counts, once per task that meets it. If the list were over limit, the bound is raised until it fits:
    the order stays one order for all, whatever the bound."""
    parts = max(64, total // 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                values = np.sort(np.concatenate(held) >> np.uint64(24))
                # ranges of equal width in the hash's space
                cut = np.searchsorted(values, (np.arange(parts + 1, dtype=np.float64) * (2.0**40 / parts)).astype(np.uint64))
                blobs = []
                for a, b in zip(cut[:-1], cut[1:]):
                    delta = np.diff(values[a:b], prepend=np.uint64(0))
                    blobs.append(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T[:5]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(blobs, pa.binary())], names=["part", "blob"])
                held, size = [], 0

        for batch in batches:
            for _, _, values, bounds in sets.of(batch.column(0)):
                own, _ = _choose(values, bounds, np.flatnonzero(seen.fresh(fingerprints(values, bounds))))
                held.append(own)
                size += len(own)
                if size >= 3_000_000:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            values = []
            for blob in blobs:
                planes = np.frombuffer(blob, np.uint8).reshape(5, -1)
                delta = np.zeros((planes.shape[1], 8), np.uint8)
                delta[:, :5] = planes.T
                values.append(np.cumsum(delta.view(np.uint64).ravel(), dtype=np.uint64))
            value, n = np.unique(np.concatenate(values), return_counts=True)
            some = n >= sets.common
            yield pa.RecordBatch.from_arrays([pa.array(value[some].view(np.int64)), pa.array(n[some])], names=["shingle", "n"])

    counted = _shared.saved(_rows(docs, text_col).mapInArrow(_shared.lean(run), "part long, blob binary").repartition("part").sortWithinPartitions("part").mapInArrow(_shared.lean(merge), "shingle long, n long"), "common")
    bound, kept = sets.common, counted
    while kept.count() > limit:
        bound *= 2
        kept = counted.where(F.col("n") >= bound)
    got = kept.toArrow()  # at most limit rows of 16 bytes
    value, n = got["shingle"].to_numpy().view(np.uint64), got["n"].to_numpy()
    return value[np.lexsort((value, n))]


class Order:
    """The global order of shingles: those that were counted by their frequency, above all others."""

    def __init__(self, common: np.ndarray):
        by_value = np.argsort(common)
        self.value, self.place = common[by_value], by_value.astype(np.int32)

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        """0 for a rare shingle, from 1 on for the counted ones, the most frequent last."""
        rank = np.zeros(len(shingles), np.int64)
        if len(self.value):
            short = shingles >> np.uint64(24)
            where = np.minimum(np.searchsorted(self.value, short), len(self.value) - 1)
            rank = np.where(self.value[where] == short, self.place[where] + 1, 0)
        return rank


def _tree(sets_: list[np.ndarray], targets: list[int], order_: Order | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """Ranks of every set, the targets in depth-first order, how much of each path the one before shares, how many ranks have to be looked at.

    Ranks start at the frequent end of the global order; shingles that only one set of the tree has come behind all others."""
    value, inverse, n = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, -n, -order_.rank(value) if order_ else np.zeros(len(value)), n == 1))] = np.arange(len(value))
    ranks = rank[inverse]
    stop = np.cumsum([len(s) for s in sets_])
    paths = [np.sort(ranks[b - len(s) : b]) for s, b in zip(sets_, stop)]
    order = np.array(sorted(targets, key=lambda i: paths[i].astype(">i4").tobytes()))
    shared = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        x, y = paths[order[k - 1]], paths[order[k]]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        shared[k] = differ[0] if len(differ) else m
    return paths, order, shared, int(np.count_nonzero(n > 1))


def _stops(shared: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Of each path, the depths below what it shares where later paths leave it, and its end."""
    out: list[list[int]] = [[]] * len(sizes)
    least: list[int] = []  # depths at which later paths leave the current one, shallow first
    for j in range(len(sizes) - 1, -1, -1):
        if j + 1 < len(sizes):
            while least and least[-1] >= shared[j + 1]:
                least.pop()
            least.append(int(shared[j + 1]))
        own = [d for d in least if shared[j] < d < sizes[j]]
        out[j] = [*own, int(sizes[j])] if sizes[j] > shared[j] else []
    return out


def tree_join(sets_: list[np.ndarray], rule: Sets, probes: list[int] | None = None, sides: list[int] | None = None, order_: Order | None = None) -> list[tuple[int, int]]:
    """Links between the sets (of the probes with all others; of different sides, of which there are two) that join what no link before has joined.

    All probes go through the tree at once: a node holds those still in its subtree and the overlap of each with its path.
    """
    if sides is not None:
        probes = [i for i, x in enumerate(sides) if x == sides[0]]
    asked = set(probes) if probes is not None else set()
    paths, order, shared, inner = _tree(sets_, [i for i in range(len(sets_)) if i not in asked], order_)
    ask = order if probes is None else np.array(probes)
    size = np.array([len(p) for p in paths])
    if not len(order) or not len(ask):
        return []
    stops = _stops(shared, size[order])
    # misses that the largest set which can link with a probe may have
    largest = np.minimum(size[order].max(), rule.den * size[ask] // rule.num)
    spare = largest - rule.overlap(largest, size[ask])
    label, links = np.arange(len(sets_)), []
    columns = max(1, min(len(ask), TABLE // max(1, inner)))
    for lo in range(0, len(ask), columns):
        some = ask[lo : lo + columns]
        has = np.zeros((inner, len(some)), np.uint8)
        for c, i in enumerate(some):
            has[paths[i][: np.searchsorted(paths[i], inner)], c] = 1
        nodes = [(0, np.arange(len(some)), np.zeros(len(some), np.int64))]
        for j, i in enumerate(order):
            while nodes[-1][0] > shared[j]:
                nodes.pop()
            depth, live, overlap = nodes[-1]
            if probes is None:  # each pair once
                later = live + lo > j
                live, overlap = live[later], overlap[later]
            path = paths[i]
            for stop in stops[j]:
                while depth < stop and len(live):
                    step = path[depth : min(stop, depth + STEP)]
                    depth += len(step)
                    step = step[: np.searchsorted(step, inner)]
                    if len(step):
                        overlap = overlap + (has[step] if len(live) == len(some) else has[np.ix_(step, live)]).sum(0, dtype=np.int64)
                    stay = depth - overlap <= spare[lo + live]
                    if not stay.all():
                        live, overlap = live[stay], overlap[stay]
                nodes.append((depth, live, overlap))
                if not len(live):
                    break
            if len(live):
                for q in some[live[overlap >= rule.overlap(size[i], size[some[live]])]]:
                    if label[q] != label[i]:
                        links.append((int(q), int(i)))
                        label[label == label[q]] = label[i]
    return links


def _stars(fps: list[int], links: list[tuple[int, int]]) -> pa.RecordBatch:
    """(a, b) from the least of each linked class to its others."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        x, y = sorted((find(fps[i]), find(fps[j])))
        root[y] = x
    others = [x for x in root if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([find(x) for x in others], pa.int64()), pa.array(others, pa.int64())], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal values of the first column, from a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b == a:
                continue
            if held and held[0].column(0)[0].as_py() != int(key[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream sorted by its first column in pieces that no value of it is parted by; for small groups."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = rows.column(0).to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1])
        if len(cut):
            yield rows.slice(0, int(cut[-1]) + 1)
            rows = rows.slice(int(cut[-1]) + 1)
        held = rows
    if held is not None and len(held):
        yield held


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def set_table(docs: DataFrame, wanted: DataFrame, rule: Sets, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, s) of the wanted fingerprints, each made from the document with the smallest id that has it, its ``least`` in classes.

    The ids are a written table, so the join sends them to every task only where their files are known to be small."""
    ids = _shared.saved(classes.join(wanted.select("fp").distinct(), "fp", "left_semi").select(F.col("least").alias("_wanted")).distinct(), "wanted")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for _, _, values, bounds in rule.of(batch.column(0)):
                fp = fingerprints(values, bounds)
                keep = np.diff(bounds) > 0
                keep[keep] = seen.fresh(fp[keep])
                own = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.binary())], names=["fp", "s"])

    return source.mapInArrow(_shared.lean(run), "fp long, s binary").groupBy("fp").agg(F.first("s").alias("s"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of all ends of edges (a, b): the least end that each can reach. Alternating stars until nothing changes."""
    now = _shared.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours to the least; small star: smaller neighbours and self to the least
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        new = _shared.saved(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        _shared.drop_saved(now)
        now = new
        if state == count:
            break
        count = state
    return now.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root"))


def _near_copies(reps: DataFrame, n_reps: int, docs: DataFrame, rule: Sets, order_: Order, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links among sets that share a key of minima: each set goes to one group, groups to trees of bounded size."""
    keys = reps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(3)))).alias("x")).select("fp", "x.i", "x.k")
    heads = keys.groupBy("i", "k").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    home = _shared.lookup(keys, heads, ["i", "k"], 3 * n_reps).where("head IS NOT NULL").groupBy("fp").agg(F.min("head").alias("head"))
    home = _shared.saved(home, "home")
    sizes = home.groupBy("head").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("chunks", F.ceil(F.col("n_rows") / (CHUNK - 1)))
    placed = _shared.lookup(home, sizes, ["head"], n_reps).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    # every tree of a large group also gets the group's head, which holds them together
    extra = sizes.where("chunks > 1").select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("head").alias("fp"))
    placed = placed.select("head", "chunk", "fp").union(extra.select("head", "chunk", "fp")).distinct()
    found = set_table(docs, placed, rule, classes, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            if len(rows) > 1:
                yield _stars(rows["fp"].to_pylist(), tree_join(_sets_of(rows["s"]), rule, order_=order_))

    return placed.join(found, "fp").select(F.xxhash64("head", "chunk").alias("g"), "fp", "s").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_shared.lean(run), "a long, b long")


def _prefixes(docs: DataFrame, rule: Sets, order_: Order, text_col: str, total: int) -> DataFrame:
    """(shingle, fp, n) of prefix shingles that more than one set has, exchanged as arrays."""
    parts = max(64, total // 4_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, _Seen()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                token, fp, n = (np.concatenate(x) for x in zip(*held))
                part = (token % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                token, fp, n = token[order], fp[order], n[order].astype(np.uint32)
                blobs = [token[a:b].tobytes() + fp[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(blobs, pa.binary())], names=["part", "blob"])
                held, size = [], 0

        for batch in batches:
            for _, _, values, bounds in rule.of(batch.column(0)):
                fps = fingerprints(values, bounds)
                own = np.flatnonzero(seen.fresh(fps) & (np.diff(bounds) > 0))
                if not len(own):
                    continue
                token, of = _choose(values, bounds, own)
                n = np.diff(bounds)[own]
                rank = order_.rank(token)
                order = np.lexsort((token, rank, of))
                nth = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
                keep = order[nth < rule.prefix(n)[of]]
                held.append((token[keep], fps[own][of[keep]], n[of[keep]]))
                size += len(keep)
                if size >= 1_000_000:
                    yield from flush()
        yield from flush()

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            token, fp, n = [], [], []
            for blob in blobs:
                m = len(blob) // 20
                token.append(np.frombuffer(blob, np.uint64, m))
                fp.append(np.frombuffer(blob, np.int64, m, 8 * m))
                n.append(np.frombuffer(blob, np.uint32, m, 16 * m))
            token, fp, n = (np.concatenate(x) for x in (token, fp, n))
            order = np.lexsort((fp, token))
            token, fp, n = token[order], fp[order], n[order]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
            token, fp, n = token[first], fp[first], n[first]
            many = np.zeros(len(token), bool)
            many[1:] = token[1:] == token[:-1]
            many[:-1] |= token[1:] == token[:-1]
            for lo in range(0, max(1, len(own := np.flatnonzero(many))), 100_000):
                x = own[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(token[x].view(np.int64)), pa.array(fp[x]), pa.array(n[x].astype(np.int64))], names=["shingle", "fp", "n"])

    return _rows(docs, text_col).mapInArrow(_shared.lean(run), "part long, blob binary").repartition("part").sortWithinPartitions("part").mapInArrow(_shared.lean(invert), "shingle long, fp long, n long")


def _rest(inverted: DataFrame, known: DataFrame, rule: Sets) -> tuple[DataFrame, DataFrame]:
    """(a, b) of pairs across components that may still link; (block, fp) of the documents of crowded shingles."""
    marked = _shared.saved(inverted.join(known, "fp", "left").select("shingle", "fp", "n", F.coalesce("root", "fp").alias("root")), "marked")
    open_ = marked.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("fp").alias("block"), F.count(F.lit(1)).alias("n_rows")).where("x <> y").select("shingle", "block", "n_rows")
    open_ = _shared.saved(open_, "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            shingle, fp, n, root = (rows[c].to_numpy() for c in ("shingle", "fp", "n", "root"))
            for d in range(1, rule.crowd):  # a shingle's documents are sorted by n: partners of each are the following ones up to the length bound
                i = np.flatnonzero(shingle[d:] == shingle[:-d])
                if not len(i):
                    break
                j = i + d
                some = (n[j] <= n[i] * rule.den // rule.num) & (root[i] != root[j])
                i, j = i[some], j[some]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j])), pa.array(np.minimum(rule.share, rule.overlap(n[i], n[j])))], names=["a", "b", "need"])

    few = marked.join(open_.where(F.col("n_rows") <= rule.crowd).select("shingle"), "shingle", "left_semi").select("shingle", "fp", "n", "root")
    pairs = few.repartition("shingle").sortWithinPartitions("shingle", "n", "fp").mapInArrow(_shared.lean(run), "a long, b long, need long").groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("c")).where("c >= need")
    many = open_.where(F.col("n_rows") > rule.crowd)
    crowded = _shared.lookup(marked, many, ["shingle"], marked.count()).where("block IS NOT NULL").select("block", "fp").distinct()
    return _shared.saved(pairs.select("a", "b"), "pairs"), _shared.saved(crowded, "blocks")


def _decide_blocks(block: DataFrame, docs: DataFrame, known: DataFrame, rule: Sets, order_: Order, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The links across components within blocks (block, fp): parts of bounded size, two by two.

    A block of more than one part is cut into bands of sizes; sets of bands that aren't neighbours can't link. A component that fills parts
    of a band has its own, and these don't meet each other; the others share parts."""
    found = _shared.saved(set_table(docs, block, rule, classes, id_col, text_col), "sets")
    fill = F.greatest(F.count(F.lit(1)) / PART, F.sum("n") / MOST)
    sized = block.join(found.select("fp", (F.length("s") / 8).cast("long").alias("n")), "fp").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sized = _shared.saved(sized, "sized")
    wide = sized.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"), (fill > 1).alias("wide"))
    n_sized = sized.count()
    # where these floors differ by 2 the larger set has more than den / num times the other's size; the little more is for rounding
    band = F.when(F.col("wide"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0001 * rule.den / rule.num)))).otherwise(0).cast("long")
    banded = _shared.saved(_shared.lookup(sized, wide, ["block"], n_sized).withColumn("band", band).drop("wide"), "bands")
    whole = banded.groupBy("block", "band", "root").agg(F.count(F.lit(1)).alias("n_rows"), fill.alias("fill")).where("fill >= 0.5").withColumn("parts", F.ceil("fill")).drop("fill")
    dealt = _shared.lookup(banded, whole, ["block", "band", "root"], n_sized)
    mixed = dealt.where("parts IS NULL").groupBy("block", "band").agg(F.count(F.lit(1)).alias("n_rows"), F.ceil(fill).alias("others"))
    own = dealt.where("parts IS NOT NULL").select("fp", "block", "band", F.col("root").alias("of"), F.pmod(F.xxhash64("fp"), "parts").alias("nth"))
    rest = _shared.lookup(dealt.where("parts IS NULL").select("fp", "block", "band"), mixed, ["block", "band"], n_sized).select("fp", "block", "band", F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("fp"), "others").alias("nth"))
    placed = _shared.saved(own.unionByName(rest).withColumn("part", F.xxhash64("band", "of", "nth")), "parts")
    parts = _shared.saved(placed.groupBy("block", "part").agg(F.first("of").alias("of"), F.first("band").alias("band")), "dealt")
    left, right = parts.alias("x"), parts.select("block", "part", "of", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")).alias("y")
    meet = left.join(right, F.expr("x.block = y.block AND x.band = y.band AND (x.of IS NULL OR y.of IS NULL OR x.of <> y.of)")).select(F.col("x.block").alias("block"), F.col("x.part").alias("part"), F.col("y.part").alias("other"))
    # each meeting has its two sides' sets; the list of a set's meetings goes with its part
    meetings = meet.select("block", "part", F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("g"), (F.col("part") == F.col("other")).alias("own"))
    sent = placed.select("fp", "block", "part").join(meetings, ["block", "part"]).select("fp", "part", "g", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            if len(rows) > 1:
                yield _stars(rows["fp"].to_pylist(), tree_join(_sets_of(rows["s"]), rule, None, None if rows["own"][0].as_py() else rows["part"].to_pylist(), order_))

    return sent.join(found, "fp").select("g", "fp", "own", "part", "s").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_shared.lean(run), "a long, b long")


def _decide(pairs: DataFrame, docs: DataFrame, rule: Sets, order_: Order, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link, each probe going through trees of its partners."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))
    found = _shared.saved(set_table(docs, ends, rule, classes, id_col, text_col), "sets")
    rows = pairs.withColumn("g", F.xxhash64("a", F.pmod("b", F.lit(64)))).select("g", "a", F.col("b").alias("fp"))
    heads = rows.select("g", "a", F.col("a").alias("fp")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            fps, sets_, a = rows["fp"].to_pylist(), _sets_of(rows["s"]), rows["a"][0].as_py()
            probe = fps.index(a)
            partners = [i for i, fp in enumerate(fps) if fp != a]
            for lo in range(0, len(partners), CHUNK):
                some = [probe, *partners[lo : lo + CHUNK]]
                yield _stars([fps[i] for i in some], tree_join([sets_[i] for i in some], rule, [0], order_=order_))

    return rows.union(heads).join(found, "fp").select("g", "a", "fp", "s").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_shared.lean(run), "a long, b long")


def join(docs: DataFrame, rule: Sets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    rule = rule or Sets()
    profiles = _shared.saved(profile(docs, rule, id_col, text_col), "profiles", keep=True)
    with _shared.scope(docs.sparkSession):
        # one row for each different set; copies are summed up before the exchange
        classes = _shared.saved(profiles.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"), *(F.first(c).alias(c) for c in ("n", "k0", "k1", "k2"))), "classes")
        size = classes.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
        roots = _links(docs, rule, classes, size["sets"], size["total"], id_col, text_col)
        rooted = classes.join(roots, "fp", "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
        named = _shared.lookup(rooted.withColumnRenamed("n_rows", "n_docs"), smallest, ["root"], size["sets"]).select("fp", "component_id", F.col("n_docs").alias("n_rows"))
        named = _shared.saved(named, "named", keep=True)
    some = _shared.lookup(profiles.where("n > 0").select("doc_id", "n", "fp"), named, ["fp"], size["rows"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = profiles.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def _links(docs: DataFrame, rule: Sets, classes: DataFrame, n_sets: int, total: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, root) of all sets that link with another one."""
    order_ = Order(common_shingles(docs, rule, text_col, total))
    near = _shared.saved(_near_copies(classes, n_sets, docs, rule, order_, classes, id_col, text_col), "near")
    known = _shared.saved(components(near), "known")
    pairs, blocks = _rest(_shared.saved(_prefixes(docs, rule, order_, text_col, total), "inverted"), known, rule)
    more = _shared.saved(_decide(pairs, docs, rule, order_, classes, id_col, text_col), "more")
    crowded = _shared.saved(_decide_blocks(blocks, docs, known, rule, order_, classes, id_col, text_col), "crowded")
    return _shared.saved(components(near.union(more).union(crowded)), "roots")
