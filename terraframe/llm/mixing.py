"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in an order shuffled by a hash of their key, passed
through up to `passes` times. A document's virtual finish time is the words of its source up to
its end, over the source's weight: where all queues are served at the same time, source s has
been served `weight * t` words by time t, until its last pass ends. Sorting by finish time over
all sources is the mix; it is truncated at the time by which the budget is used up. That time
solves sum(min(weight * t, passes * size)) = budget, so no document is taken more than `passes`
times and what a short source can't give goes to the others by weight.

Defined results: a null text has no words; documents of no words are never taken; a null source
is a source of its own, last in order; documents whose key, source and size agree may change
places, which changes no sum; an empty table gives an empty mix. Columns of the input are kept,
but for those whose names begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, running_sum, spread

WEIGHTS = (5, 2, 1)
PASSES = 3
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: __source, __source_size, __weight, __target, and the end of the mix, __until.

    Weights repeat over the sources by code point, null last. The table has a row per source, at most
    MAX_SOURCES, which is checked; windows over it without a key are bounded by that.
    """
    everything = Window.partitionBy()
    sources = cut(docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__source_size")))
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("__weight", weight.cast("long")).withColumn("__cap", F.col("__source_size") * passes)
    # Sources fill up in order of cap over weight. Before the k-th is full, words served by time t
    # are those of the full ones and t times the weights of the rest; the least of these lines is
    # what is served, so the time at which the budget is reached is the latest over the lines.
    filled = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("__source_size").over(everything) - F.coalesce(F.sum("__cap").over(filled), F.lit(0))
    rest = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(filled), F.lit(0))
    sources = sources.withColumn("__line", left.cast("double") / rest.cast("double")).withColumn("__until", F.max("__line").over(everything))
    target = F.least(F.col("__until") * F.col("__weight"), F.col("__cap").cast("double"))
    return sources.select("__source", "__source_size", "__weight", target.alias("__target"), "__until")


def schedule(docs: DataFrame, key: str, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, whole: bool = False) -> DataFrame:
    """Every document with __copies, an array of (copy, finish, words) that the mix takes of it.

    At the end of the mix each source has one document in service. It is cut to the words served
    by then, or, with `whole`, taken if half of it was.
    """
    hashed = F.md5(F.concat_ws("/", F.lit("mix"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hi, lo = spread(F.col("__hash"))
    rows = docs.withColumn("__hash", hashed).withColumn("__hi", hi).withColumn("__lo", lo)
    rows = running_sum(rows, [source], "__hi", "__lo", [F.col("__hash"), F.col(key), F.col(size)], size, "__before", targets(docs, source, size, weights, passes))

    def copy(k: Column) -> Column:
        start = k * F.col("__source_size") + F.col("__before")
        finish = (start + F.col(size)).cast("double") / F.col("__weight")
        served = F.round(F.col("__target")).cast("long") - start
        taken = F.when(served * 2 >= F.col(size), F.col(size)).otherwise(F.lit(0)) if whole else F.least(served, F.col(size))
        return F.struct((k + 1).cast("int").alias("copy"), finish.alias("finish"), taken.cast("long").alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), copy), lambda c: c["words"] > 0)
    return rows.withColumn("__copies", copies).drop("__hash", "__hi", "__lo", "__before")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, whole: bool = True) -> DataFrame:
    """The mix itself: a row per copy taken, range-sorted by __finish, with __copy and __words."""
    rows = schedule(docs, key, source, size, weights, passes, whole)
    rows = rows.drop("__source_size", "__weight", "__target", "__until").withColumn("__taken", F.explode("__copies")).drop("__copies")
    rows = rows.withColumns({"__finish": F.col("__taken.finish"), "__copy": F.col("__taken.copy"), "__words": F.col("__taken.words")}).drop("__taken")
    return rows.repartitionByRange(F.col("__finish"), F.col(key)).sortWithinPartitions("__finish", key)
