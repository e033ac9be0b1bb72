"""Streams against the same work in one batch."""

import random

from pyspark.sql import functions as F

from sensorline.sources import blocks as block_files
from sensorline.streaming import streams


def test_distinct_packets_of_a_stream_are_exact(spark, tmp_path):
    """100 000 packets a window and channel, each seen twice, over several bitmaps; the last window stays open."""
    n = 100_000
    rows = spark.range(2 * n + 2).select(
        F.when(F.col("id") < 2 * n, F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") % 2 * 10)).otherwise(F.timestamp_seconds(F.lit(1_000_009_000))).alias("ts"),
        (F.col("id") % 2).alias("channel"),
        F.when(F.col("id") % 50 == 1, None).otherwise(F.floor(F.col("id") / 4) * 3 - 7).alias("packet"),
    )
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = streams.block_coverage(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "10 seconds", "5000 seconds")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.start, r.channel): (r.packets, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = rows.filter(F.col("ts") < F.timestamp_seconds(F.lit(1_000_009_000))).groupBy(F.window("ts", "10 seconds").alias("w"), "channel").agg(F.count_distinct("packet").alias("packets"), F.count("*").alias("n"))
    assert got == {(r.w.start, r.channel): (r.packets, r.n) for r in want.collect()} and len(got) == 2


def test_time_is_cut_without_reading_samples(spark, tmp_path):
    df = spark.range(40).select(F.lit(0).alias("run_id"), F.lit(1).alias("channel"), F.col("id").alias("block_no"), (F.col("id") * 10).alias("start_sample"), F.array_repeat(F.lit(1.0), 10).alias("samples"))
    block_files.write_blocks(df, f"{tmp_path}/blocks")
    cut = block_files.scan_blocks(spark, f"{tmp_path}/blocks", first=95, stop=200)
    assert sorted(r.block_no for r in cut.collect()) == list(range(9, 20)) and sorted(cut.columns) == sorted(df.columns)
    plan = cut.select("block_no")._jdf.queryExecution().executedPlan().toString()
    assert "array" not in plan.split("ReadSchema")[1] and "GreaterThan(stop_sa" in plan  # Spark shortens the list of filters


def test_samples_out_of_order_give_the_sum_in_order(spark, tmp_path):
    """Batches whose samples lag and lead by up to a minute, values to despike, nulls, two samples at one time;
    what is over a minute behind the watermark is dropped, what is not closed stays."""
    rng, n = random.Random(7), 600
    base = 1_700_000_000
    rows = [(c, k, base + k - (k % 10 == 9), None if k % 97 == 5 else (9.0 if k % 50 == 3 else rng.uniform(-1, 1))) for c in (1, 2) for k in range(n)]
    turns = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 55))
    third = len(turns) // 3
    late = [(1, 10_000, base - 500, 1.0)]
    schema = "channel long, sample_idx long, t long, value double"
    for part in (turns[:third], turns[third : 2 * third], turns[2 * third :], late):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("channel long, sample_idx long, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        streams.running_integral(source, 2.0, 0.5, "60 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    got = {(r.channel, r.sample_idx): r.integral for r in spark.read.schema("channel long, sample_idx long, integral double").parquet(f"{tmp_path}/out").collect()}
    closed = max(r[2] for r in rows) - 60
    want = {}
    for c in (1, 2):
        total = 0.0
        for _, k, t, v in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            total += v if v is not None and abs(v) <= 2.0 else 0.0
            if t <= closed:
                want[c, k] = total * 0.5
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_expected_arrivals_may_change_their_period(spark, tmp_path):
    """The period goes from 20 to 13 seconds mid-stream; peaks near and far, two near one arrival, a peak far too late."""
    rng, base = random.Random(3), 1_700_000_000
    starts, t = [], 0
    while t < 600:
        starts.append(t)
        t += 20 if t < 300 else 13
    expected = [(k, c, base + s + c) for k, s in enumerate(starts) for c in (1, 2)]
    peaks = [(c, base + s + c + rng.choice([-5, -2, -1, 0, 1, 2, 7])) for s in starts for c in (1, 2) for _ in range(rng.choice([0, 1, 2]))]
    cut = lambda rows, at, k: [[r for r in rows if (r[at] - base) // 220 == part] for part in range(k)]
    too_late = [(1, expected[0][2])]  # in the last delivery, ten minutes behind
    end = base + 5000
    for name, parts, schema in (
        ("peaks", cut(peaks, 1, 3) + [too_late + [(0, end)]], "channel long, t long"),
        ("expected", cut(expected, 2, 3) + [[(-1, 0, end)]], "packet long, channel long, t long"),
    ):
        for part in parts:
            spark.createDataFrame(part, schema).select("*", F.timestamp_seconds("t").alias("ts")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    got = streams.assign_to_expected(read("peaks", "channel long, ts timestamp"), read("expected", "packet long, channel long, ts timestamp").withColumnRenamed("ts", "target_ts"), 2.0, "30 seconds")
    got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(got.schema).parquet(f"{tmp_path}/out").select("packet", "channel", F.unix_seconds("peak_ts").alias("p")).collect()
    want = {}
    for k, c, s in expected:
        near = [p for c2, p in peaks if c2 == c and abs(p - s) <= 2]
        if near:
            want[k, c] = min(near)
    assert len(rows) == len(want) and {(r.packet, r.channel): r.p for r in rows} == want
