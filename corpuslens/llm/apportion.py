"""Mixing sources to target weights with Sainte-Lague apportionment, in DataFrame operations only.

The mix is a number of blocks of equal length in words: ``block_words``, or as few (one at least) as give the smallest
target 64 blocks, so that a source of a few words reaches its target, too. Sources get whole blocks by the highest quotients
``target / (2 * seats + 1)``; each source's blocks go to its shards (documents dealt by a hash, as many shards as its own rows ask for, so that a hot
source is many) by the same rule with the shards' sizes; what a shard is too small for goes to the source's others. Inside a shard the documents stand in a
seeded order; a quota takes the shard whole as often as it can and the rest as a run of blocks from a
seeded place on, so only the documents at a run's ends are cut.

Highest quotients need no loop: with m parties and N seats the divisor lies between V / (N + m/2) and
V / (N - m/2), which leaves about 3 m quotients to rank; what lies above them is counted.

Defined cases: null text has size 0; a null source is a source of its own, last in order, and another one than the empty string; equal quotients
go by the order of sources, then of shards; rows of size 0 take 0; an empty table gives an empty result; repeated rows are rows of their own, and of equal ones
each takes the same or those earlier in the seeded order more; a very long text is one number here; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    single = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.coalesce(single, F.lit("")) == "", F.lit(0)).otherwise(F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit(""))) + 1).cast("long")


def _seeded(*columns: Column) -> Column:
    """A number from 0 up to 2**60 that follows from the columns' values; null ones are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in columns)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target words of each source: share of all words by weight, none above most times its own, the excess dealt on by weight.

    sizes: source, size. weights repeat over the sources by code point, null last. Sources leave the dealing in the order of
    cap / weight; the first k are capped for the least k that leaves the next one below its cap."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy(F.lit(0))
    up_to = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    base = sizes.withColumn("weight", weigh).withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("size").over(every) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    level = base.withColumn("level", left / heavy)
    first_free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)
    return level.withColumn("free", first_free["level"]).select("source", F.col("size").alias("source_size"), F.when(F.col("free").isNull() | (F.col("ratio") <= F.col("free")), F.col("cap")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str) -> DataFrame:
    """Adds quota: the seats of each row by highest quotients within its group. Ties go by the column ``tie``."""
    every = Window.partitionBy(*group)
    half = F.count(F.lit(1)).over(every) / 2.0
    total = F.sum(votes).over(every)
    wide = parties.withColumn("_total", total).withColumn("_half", half)
    sure = F.when((F.col("_total") > 0) & (F.col(seats) > F.col("_half")), F.greatest(F.lit(0.0), F.floor(F.col(votes) * (F.col(seats) - F.col("_half")) / F.col("_total") - 0.5))).otherwise(0.0).cast("long")
    upper = F.when(F.col("_total") > 0, F.ceil(F.col(votes) * (F.col(seats) + F.col("_half")) / F.col("_total") + 0.5)).otherwise(F.lit(0)).cast("long")
    wide = wide.withColumn("_sure", sure).withColumn("_upper", F.greatest(upper, F.col("_sure"))).withColumn("_open", F.col(seats) - F.sum("_sure").over(every))
    rows = wide.withColumn("_seat", F.explode(F.sequence(F.col("_sure"), F.col("_upper"))))
    by_quotient = every.orderBy(F.desc(F.col(votes) / (2 * F.col("_seat") + 1)), "tie", "_seat")
    won = rows.withColumn("_won", ((F.row_number().over(by_quotient) <= F.col("_open")) & (F.col(votes) > 0)).cast("long"))
    keep = [c for c in parties.columns]
    return won.groupBy(*keep).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, block_words: int = 32, shard_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row: the words that the mix takes from it, at most ``most`` times its size.

    carry: a column of docs to keep as ``carried``."""
    key = _seeded(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = _shared.saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(carry).alias("carried")] if carry else [])), "sizes")
    shards = rows.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    rows = rows.join(F.broadcast(shards), F.col("source").eqNullSafe(F.col("_source"))).withColumn("at", key).withColumn("shard", F.pmod("at", F.col("shards"))).drop("_source", "shards")
    cells = _shared.saved(rows.groupBy("source", "shard").agg(F.sum("size").alias("cell")), "cells")
    sources = targets(cells.groupBy("source").agg(F.sum("cell").alias("size")), weights, share, most)
    every = Window.partitionBy(F.lit(0))
    step = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 64))).cast("long")
    seats = sources.withColumn("tie", F.struct(F.col("source").isNull(), "source")).withColumn("step", F.coalesce(step, F.lit(1).cast("long"))).withColumn("seats", F.round(F.sum("target").over(every) / F.col("step")).cast("long"))
    given = sainte_lague(seats, ["seats"], "target", "seats").select("source", "source_size", "target", "step", F.col("quota").alias("blocks"))
    joined = cells.alias("c").join(given.alias("g"), F.expr("c.source <=> g.source")).select("c.source", "shard", "cell", "source_size", "target", "step", "blocks").withColumn("tie", F.col("shard"))
    quota = sainte_lague(joined, ["source", "blocks"], "cell", "blocks").drop("tie", "blocks")
    # what a small shard can't take of its blocks goes to its source's shards with room, the widest first
    quota = quota.withColumn("words", F.least(F.col("quota") * F.col("step"), F.col("cell") * most)).withColumn("room", F.col("cell") * most - F.col("words"))
    earlier = Window.partitionBy("source").orderBy(F.desc("room"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    over = F.sum(F.col("quota") * F.col("step") - F.col("words")).over(Window.partitionBy("source")) - F.coalesce(F.sum("room").over(earlier), F.lit(0))
    quota = quota.withColumn("words", F.col("words") + F.greatest(F.lit(0), F.least(over, F.col("room"))))
    words = F.col("words")
    quota = quota.withColumn("whole", F.when(F.col("cell") > 0, F.floor(words / F.col("cell"))).otherwise(0).cast("long")).withColumn("rest", words - F.col("whole") * F.col("cell"))
    starts = F.pmod(_seeded(F.lit(seed), F.col("source"), F.col("shard")), F.greatest(F.lit(1), F.floor(F.col("cell") / F.col("step")))) * F.col("step")
    quota = quota.withColumn("from", F.when(F.col("cell") > 0, starts).otherwise(0).cast("long"))
    inside = Window.partitionBy("source", "shard").orderBy("at", "doc_id", "size")
    placed = rows.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    kept = ["carried"] if carry else []
    both = placed.alias("r").join(quota.alias("q"), F.expr("r.source <=> q.source AND r.shard = q.shard")).select(*kept, "doc_id", "size", "source_size", "target", "cell", "whole", "rest", "from", "start", "end")
    stop = F.col("from") + F.col("rest")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("start", a))
    taken = F.col("whole") * F.col("size") + overlap(F.col("from"), F.least(stop, F.col("cell"))) + overlap(F.lit(0), F.greatest(F.lit(0), stop - F.col("cell")))
    return both.select(*kept, "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))
