"""The same computations on streams: requests per cell, metric counters, position fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tesserae.operators import state
from tesserae.sources.shared import scratch
from tesserae.streaming import ordered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A folder's table as a stream, whether it is one file or many."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream over all that is there now writes, read from the shared folder it is written to; a complete result replaces the one before."""
    spark = df.sparkSession
    at = scratch(spark, "stream")
    w = df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "complete":
        w = w.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}"))
    else:
        w = w.outputMode(mode).format("parquet").option("path", f"{at}/rows")
    w.start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema, StructField("batch", LongType())]) if mode == "complete" else df.schema).parquet(f"{at}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last).drop("batch")
    return rows


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts per event time window and kind; rows later than `late` behind the newest are left out, windows close behind that."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))


def fused(updates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(source_id, seq, t, arrived, accuracy, lat, lon) to the accepted updates, with the state kept per source between batches.

    Rows are taken by t, then seq, behind a watermark of `delay`: with none, what one batch brings is in order, and rows of a later batch that are
    older are left out.
    """
    fields = ("accuracy", "lat", "lon")

    def step(s: dict | None, r: tuple) -> tuple[dict, list[tuple]]:
        t, seq, arrived, *rest = r
        s, o = state.fusion(s, {"t": t, "arrived": arrived, **dict(zip(fields, rest))})
        return s, [(seq, bool(o["accepted"]), round(o["lat"], 6), o["accuracy"])]

    return ordered.in_order(updates, "source_id", "t", ["seq"], ["arrived", *fields], delay, step, None, "source_id long, seq long, accepted boolean, lat double, accuracy double")
