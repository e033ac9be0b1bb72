"""Sample blocks: (run_id, channel, block_no, start_sample, fs, samples), one row a
channel and block, as Parquet partitioned by run and cut by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorline.sources.recordings import BLOCK_SECONDS, ingest_wav  # noqa: F401


def write_blocks(blocks: DataFrame, path: str, channels_per_file: int = 64) -> None:
    """Parquet by run; files hold neighbouring channels in order, so that scans
    of a channel range skip files and row groups by their statistics. The sample
    after a block is written too, so that time is cut without reading samples."""
    cell = F.floor(F.col("channel") / channels_per_file)
    held = blocks.withColumn("stop_sample", F.col("start_sample") + F.size("samples"))
    held.repartition("run_id", cell).sortWithinPartitions("run_id", "channel", "block_no").write.mode("append").partitionBy("run_id").parquet(path)


def scan_blocks(spark: SparkSession, path: str, run_id: int | None = None, first: int | None = None, stop: int | None = None, channels: tuple[int, int] | None = None) -> DataFrame:
    """Blocks that overlap samples [first, stop) of channels [lo, hi). Conditions
    reach the scan: partitions by run, row groups by channel, start and stop."""
    out = spark.read.parquet(path)
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if channels is not None:
        out = out.filter((F.col("channel") >= channels[0]) & (F.col("channel") < channels[1]))
    if stop is not None:
        out = out.filter(F.col("start_sample") < stop)
    if first is not None:
        out = out.filter(F.col("stop_sample") > first)
    return out.drop("stop_sample")


def block_inventory(blocks: DataFrame) -> DataFrame:
    """Files, blocks and spans per run and channel without reading samples."""
    return blocks.groupBy("run_id", "channel").agg(F.count("*").alias("n_blocks"), F.min("start_sample").alias("first_sample"), F.max("start_sample").alias("last_block_sample"))


def overlapping(inventory: DataFrame, start: Column, stop: Column, at: str = "ts", block_s: int = BLOCK_SECONDS) -> DataFrame:
    """Blocks with start - block_s < at <= stop: those that hold part of the span."""
    t = F.col(at)
    return inventory.filter((t > start - F.expr(f"make_dt_interval(0,0,0,{block_s})")) & (t <= stop))


def find_blocks(inventory: DataFrame, start: Column, duration_s: float, channels: list[int] | None = None) -> DataFrame:
    """``overlapping`` for a start and a duration, for some channels."""
    found = overlapping(inventory, start, start + F.expr(f"make_dt_interval(0,0,0,{duration_s})"))
    return found if channels is None else found.filter(F.col("channel").isin(channels))
