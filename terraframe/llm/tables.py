"""Small helpers on DataFrames: tables of a folder, lineage cuts, distributed prefix sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import cut  # noqa: F401  for the operators beside this module

#: Buckets at each of the two levels by which rows of one key are dealt out.
FAN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse_own_names(df: DataFrame) -> None:
    """Columns that begin with two underscores are the operators' own; an input that has one is refused."""
    if clash := [c for c in df.columns if c.startswith("__")]:
        raise ValueError(f"columns {clash}: names that begin with two underscores are the operator's own")


#: Bytes of an Arrow batch that Spark sends to a Python worker; a longer row is a batch of its own.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of some BATCH bytes, so what an executor and its workers hold doesn't depend on the length of rows.

    The session's own bound stays where it is smaller; rows of a batch are bounded by Spark's setting as well.
    """
    conf = df.sparkSession.conf
    sizes = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if sizes.byteStringAsBytes(conf.get(BATCH_BYTES)) > BATCH:
        conf.set(BATCH_BYTES, str(BATCH))
    return df.mapInArrow(run, schema)


def spread(key: Column) -> tuple[Column, Column]:
    """Two levels of buckets, in the order of a 128-bit hex key: its first bits, then its next."""
    number = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    return (number / F.lit(FAN)).cast("int"), F.pmod(number, F.lit(FAN))


def running_sum(df: DataFrame, by: list[str], hi: str, lo: str, order: list[Column], value: str, out: str, per_key: DataFrame | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows before each, within `by`, ordered by hi, lo and `order`.

    A key may hold any share of all rows: they are summed by bucket, the buckets' sums are added up
    in two levels, and no task ever holds more than a bucket's rows. `order` must be a total order
    up to rows that may change places. Keys may be null. `per_key`, if given, has a row per key, under
    other names for the columns `by`, which come first; its further columns are added. It meets the
    buckets' sums, not the rows, so no key is hot there either.
    """

    def before(what: str, keys: list[str], at: list) -> Column:
        frame = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(frame), F.lit(0))

    # never null and compared plainly, so that the rows are shuffled once for their window and the join
    told = {c: f"{c}__told" for c in by}
    df = df.withColumns({told[c]: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by})
    keys = [*told.values(), hi, lo]
    other = {c: f"{c}__of_bucket" for c in keys}
    bucket = [other[c] for c in keys]
    small = df.groupBy(*[F.col(c).alias(other[c]) for c in keys]).agg(F.sum(value).alias("__sum"))
    small = small.withColumn("__low", before("__sum", bucket[:-1], bucket[-1:]))
    top = small.groupBy(*[F.col(c).alias(f"{c}__top") for c in bucket[:-1]]).agg(F.sum("__sum").alias("__all"))
    top = top.withColumn("__high", before("__all", [f"{c}__top" for c in bucket[:-2]], [f"{bucket[-2]}__top"]))
    same = lambda pairs: [F.col(x) == F.col(y) for x, y in pairs]
    added = per_key.columns[len(by) :] if per_key is not None else []
    if per_key is not None:
        named = per_key.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in per_key.columns[: len(by)]})
        top = top.join(named, same(zip([f"{other[told[c]]}__top" for c in by], per_key.columns, strict=False)))
    bases = small.join(top, same((c, f"{c}__top") for c in bucket[:-1])).select(*bucket, (F.col("__low") + F.col("__high")).alias("__base"), *added)
    rows = df.withColumn("__here", before(value, keys, order))
    joined = rows.join(bases, same((c, other[c]) for c in keys))
    return joined.withColumn(out, (F.col("__base") + F.col("__here")).cast("long")).drop("__base", "__here", *bucket, *told.values())


#: Places of a membership bitmap; its size is fixed, whatever it is made from.
PLACES = 1 << 24


def bitmap(keys: DataFrame, place: Column) -> bytes:
    """One bit per place (0 to PLACES - 1) that a key has: PLACES / 8 bytes, so it can be sent to all executors.

    It answers "surely not" or "maybe". With ever more keys it fills up and lets more pass, which
    costs time but no result: what passes must be joined exactly.
    """
    at = place.cast("long") + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = bytearray(PLACES // 8)
    for r in rows:
        first = (r["b"] - 1) * 4096
        out[first : first + len(r["m"])] = r["m"]
    return bytes(out)


def maybe(bits: bytes, places: np.ndarray) -> np.ndarray:
    """Which of the places a bitmap has."""
    return (np.frombuffer(bits, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
