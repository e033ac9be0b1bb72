"""Reports over direction fits and receptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def angle_bins(spark: SparkSession) -> DataFrame:
    """bin_no, lo, hi of the 19 bins (-0.5, 0.5], (0.5, 5], (5, 10], ... (85, 90]."""
    k = F.col("id")
    lo = F.when(k == 0, -0.5).when(k == 1, 0.5).otherwise(5.0 * (k - 1))
    return spark.range(19).select(k.cast("int").alias("bin_no"), lo.alias("lo"), F.when(k == 0, 0.5).otherwise(5.0 * k).alias("hi"))


def angle_histogram(fits: DataFrame, bins: DataFrame) -> DataFrame:
    """subarray_id, bin_no, n: valid packets per right-closed bin; empty bins have 0.

    Every fit is counted once, before the shuffle, under its bin or under none
    (not valid, no bin); a row per subarray then meets the bins.
    """
    at = F.when(F.col("valid"), F.col("angle_off_axis_deg")).alias("at")
    edges = bins.agg(F.array_sort(F.collect_list(F.struct("bin_no", "lo", "hi"))).alias("edges"))  # one row of 19 bins
    hit = F.filter("edges", lambda b: (F.col("at") > b["lo"]) & (F.col("at") <= b["hi"]))
    placed = fits.select("subarray_id", at).join(F.broadcast(edges)).select("subarray_id", "edges", F.get(hit, F.lit(0))["bin_no"].alias("bin_no"))
    counts = placed.groupBy("subarray_id", "bin_no").agg(F.count("*").alias("n"), F.first("edges").alias("edges"))
    held = counts.groupBy("subarray_id").agg(F.first("edges").alias("edges"), F.map_from_entries(F.collect_list(F.when(F.col("bin_no").isNotNull(), F.struct("bin_no", "n")))).alias("m"))
    rows = held.select("subarray_id", "m", F.explode("edges").alias("b"))
    return rows.select("subarray_id", "b.bin_no", F.coalesce(F.element_at("m", F.col("b.bin_no")), F.lit(0)).alias("n"))


#: Packets in a block of a series: the unit of work of its segments and gaps.
BLOCK = 1 << 16


def angle_series(fits: DataFrame, max_packet: int | None = None, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """subarray_id, packet, angle, segment for packets 0..max_packet (the largest
    with an angle if not given); angle and segment are null where there is none. A
    jump of more than one packet starts a new segment; subarrays without any
    angle are left out.

    A subarray is worked on in blocks of ``block`` packets, each angle with the gap
    before it; a table with a row per block carries the segments on. The angles are
    read twice: with ``path``, a new folder, they are written there and the fits are
    worked out once.
    """
    known = fits.filter(F.col("valid") & F.col("angle_off_axis_deg").isNotNull() & (F.col("packet") >= 0)).select("subarray_id", F.col("packet").cast("long").alias("packet"), F.col("angle_off_axis_deg").alias("angle"))
    if max_packet is not None:
        known = known.filter(F.col("packet") <= max_packet)
    w = W.partitionBy("subarray_id", "block").orderBy("packet")
    within = known.withColumn("block", F.expr(f"packet div {block}")).withColumn("prev", F.lag("packet").over(w))
    placed = within.withColumn("cuts", F.sum(F.coalesce((F.col("packet") - F.col("prev") > 1).cast("long"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    if path is not None:
        placed.write.parquet(path)
        placed = fits.sparkSession.read.schema(placed.schema).parquet(path)

    blocks = placed.groupBy("subarray_id", "block").agg(F.min("packet").alias("first"), F.max("packet").alias("last"), F.max("cuts").alias("cuts"))  # a row per block
    w_b = W.partitionBy("subarray_id").orderBy("block")
    cut = F.coalesce((F.col("first") - F.lag("last").over(w_b) > 1).cast("long"), F.lit(0))
    before = blocks.withColumn("cut", cut).select("subarray_id", "block", (F.sum(F.col("cut") + F.col("cuts")).over(w_b.rowsBetween(W.unboundedPreceding, 0)) - F.col("cuts")).alias("before"))
    start = F.when(F.col("prev").isNull(), F.col("block") * block).otherwise(F.least(F.col("prev") + 1, F.col("packet")))
    filled = placed.join(before, ["subarray_id", "block"]).select("subarray_id", F.explode(F.sequence(start, "packet")).alias("k"), "packet", "angle", (F.col("before") + F.col("cuts")).alias("segment"))
    own = lambda c: F.when(F.col("k") == F.col("packet"), F.col(c)).alias(c)
    held = filled.select("subarray_id", F.col("k").alias("packet"), own("angle"), own("segment"))

    tops = blocks.groupBy("subarray_id").agg(F.max("last").alias("top"))  # a row per subarray
    end = tops.agg((F.max("top") if max_packet is None else F.lit(max_packet).cast("long")).alias("end"))
    grid = tops.select("subarray_id").join(F.broadcast(end)).select("subarray_id", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"end div {block}"))).alias("block"))
    # few bytes but much work, which size-based merging of partitions does not see
    dealt = grid.repartition(int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "subarray_id", "block")
    rest = dealt.join(blocks.select("subarray_id", "block", "last"), ["subarray_id", "block"], "left").select("subarray_id", F.coalesce(F.col("last") + 1, F.col("block") * block).alias("a"), F.least("end", (F.col("block") + 1) * block - 1).alias("b"))
    tails = rest.filter("a <= b").select("subarray_id", F.explode(F.sequence("a", "b")).alias("packet"), *[F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("angle", "segment")])
    return held.unionByName(tails)


def channel_usage(fits: DataFrame) -> DataFrame:
    """Per subarray: summed channels available, after stage 1 and 2 (0 where not
    valid), and the mean after stage 2 over valid packets."""
    n = lambda c: F.sum(F.when(F.col("valid"), F.col(c)).otherwise(0)).alias(c)
    return fits.groupBy("subarray_id").agg(F.sum("channels_available").alias("channels_available"), n("n_inliers_stage1"), n("n_inliers_stage2"), F.avg(F.when(F.col("valid"), F.col("n_inliers_stage2"))).alias("mean_stage2"))


def reception_map(receptions: DataFrame, min_snr: float = 3.0, angles: tuple[float, float] = (0.0, 90.0), version: int = 4) -> DataFrame:
    """channel, packet, detected, successful (checksum and version), snr (null if
    low) and whether the grazing angle lies in bounds."""
    ok = F.coalesce(F.col("valid") & (F.col("version") == version), F.lit(False))
    return receptions.select("channel", "packet", F.col("snr").isNotNull().alias("detected"), ok.alias("successful"), F.when(F.col("snr") >= min_snr, F.col("snr")).alias("snr"), F.col("grazing_deg").between(*angles).alias("in_bounds"))
