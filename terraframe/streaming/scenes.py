"""Scenes as they arrive: a stream of pixel files, summarised batch by batch. An extension, not parity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import indices


def pixel_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Pixels (raster_id, y, x, bands) of Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def index_totals(pixels: DataFrame, name: str, bands: Mapping[str, str]) -> DataFrame:
    """By scene: valid pixels, mean and extent of an index; sums only, so state is a row per scene."""
    value = indices.index(name, {n: F.col(c) for n, c in bands.items()})
    return pixels.select("raster_id", value.alias("v")).groupBy("raster_id").agg(F.count("v").alias("valid_pixels"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def write_totals(totals: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the totals in a table in memory; `checkpoint` makes a restart go on where it was."""
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
