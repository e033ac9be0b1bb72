"""Steps that only larger or odd tables bring to light."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.llm import itq
from sensorline.operators import calibrate, doa, joins, locate, packets, polyline
from sensorline.plans import bindings as B
from sensorline.plans import registry
from sensorline.streaming import streams


def test_state_of_scattered_packets_is_small(spark, tmp_path):
    """5,000 packets far apart in one window: a bitmap each would hold 20 MB."""
    n = 5_000
    rows = spark.range(n + 1).select(
        F.timestamp_seconds(F.lit(1_000_000_000) + F.when(F.col("id") < n, 0).otherwise(9_000)).alias("ts"), F.lit(1).alias("channel"), (F.col("id") * 100_003 - 7).alias("packet")
    )
    rows.write.parquet(f"{tmp_path}/in")
    stream = streams.block_coverage(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "10 seconds", "5000 seconds")
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.packets, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(n, n)]
    assert max(s["memoryUsedBytes"] for p in run.recentProgress for s in p["stateOperators"]) < 10e6


def test_decoding_of_many_receptions_is_quick_and_least_in_errors():
    """4,096 words with three errors each, against the encoder's input."""
    rng, n = np.random.default_rng(1), 4_096
    bits = np.hstack([rng.integers(0, 2, (n, 64)), np.zeros((n, packets.MEMORY), int)])
    state, coded = np.zeros(n, int), []
    for k in range(bits.shape[1]):
        register = bits[:, k] << packets.MEMORY | state
        coded += [np.bitwise_count(register & p) & 1 for p in packets.POLYNOMIALS]
        state = register >> 1
    coded = np.stack(coded, 1).astype(np.int8)
    for at in (5, 60, 120):
        coded[:, at] ^= 1
    start = time.process_time()
    assert (packets.viterbi(coded, 64) == bits[:, :64]).all()
    assert time.process_time() - start < 10


def test_code_bits_may_be_short_long_or_missing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1]), (4, [0] * 200), (5, [0] * 144 + [1] * 9)], "packet int, bits array<int>")
    assert {r.packet: r.bits for r in packets.convolutional_decode(df, ("packet",)).collect()} == {k: [0] * 64 for k in range(1, 6)}


def test_lines_without_direction_and_sources_on_vertices_have_no_cosine(spark):
    """Cable 1 stays in one place, cable 2 does after a step; a division by a length of 0 was an error."""
    line = spark.createDataFrame([(1, k, 3.0, 4.0, 0.0) for k in range(3)] + [(2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0)], "cable_id int, seq int, x double, y double, z double")
    sources = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0), (2, 8, 0.0, 0.0, 0.0)], "cable_id int, source_id int, x double, y double, z double")
    got = {(r.cable_id, r.seq): (r.range_m, r.cos_grazing) for r in polyline.range_and_grazing(sources, line).collect()}
    assert got == {(1, 0): (5.0, None), (1, 1): (5.0, None), (1, 2): (5.0, None), (2, 0): (0.0, None), (2, 1): (1.0, 1.0)}


def test_bearings_are_within_a_turn(spark, sf, monkeypatch):
    """Steps may leave a bearing some turns on, as 15 of 250 segments of sf0.1 did."""
    fit = calibrate.calibrate_segments
    monkeypatch.setattr(calibrate, "calibrate_segments", lambda *a: fit(*a).withColumn("theta_deg", F.col("theta_deg") - 720))
    got = [r.theta_deg for r in registry.queries()["f14_calibrate_segments"](spark, sf).collect() if r.success]
    assert got and all(-60 <= t < 60 for t in got)


def test_unwrapped_jumps_of_half_a_step_agree_with_sql(spark, tmp_path):
    """32.79 - 77.79 is -45 less a rounding: the SQL's floor of a quotient gave 45, outside of [-45, 45)."""
    rows = [(k, f"2024-01-01 00:00:0{k}", k, v) for k, v in enumerate([77.79, 32.79, 88.68, 43.68, 43.68, 133.68])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()["b6_unwrap"]).fetchall()
    got = registry.queries()["b6_unwrap"](spark, str(tmp_path)).select("channel", "sample_idx", "unwrapped")
    assert sorted(want) == sorted(map(tuple, got.collect())) and sorted(want)[1][2] == 32.79


def test_long_cells_of_a_sweep_take_time_in_proportion(spark):
    """60,000 queries in one cell: a frame to the end of the partition would be read anew for each row."""
    n = 60_000
    q = spark.range(n).select("id", (F.col("id") / n * 100).alias("x"))
    knots = spark.createDataFrame([(float(k), float(k * k)) for k in (0, 10, 50, 99)], "x double, v double")
    start = time.monotonic()
    got = joins.bracketing_bucketed(q, knots, "x", ["v"], 1000.0).select("id", "at_lo", "v_lo", "at_hi", "v_hi").toPandas().sort_values("id")
    assert time.monotonic() - start < 30
    x, at = got["id"].to_numpy() / n * 100, np.array([0.0, 10.0, 50.0, 99.0])
    lo, hi = np.searchsorted(at, x, "right") - 1, np.searchsorted(at, x, "left")
    assert (got["at_lo"].to_numpy() == at[lo]).all() and (got["v_lo"].to_numpy() == at[lo] ** 2).all()
    inside = hi < 4
    assert (got["at_hi"].to_numpy()[inside] == at[hi[inside]]).all() and got["at_hi"][~inside].isna().all()


def test_full_buckets_of_far_vectors_lose_no_link(spark):
    """Neighbours just within the threshold, about a mean of three times the spread: fine signs part some of them."""
    rng = np.random.default_rng(5)
    n, dim = 2000, 32
    x = rng.standard_normal((n, dim))
    x += 3 * np.sqrt(dim) * np.eye(dim)[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = rng.uniform(0.9801, 0.983, 300)
    side = rng.standard_normal((300, dim))
    side -= (side * unit[:300]).sum(1, keepdims=True) * unit[:300]
    x[1000:1300] = want[:, None] * unit[:300] + np.sqrt(1 - want[:, None] ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(k, [float(z) for z in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()} == dict(enumerate((linked.sum(1) - 1).tolist()))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_lines_work_no_line_out_for_a_filter(spark, sf):
    plan = _plan(B.placed(spark, sf))
    assert "Filter (size(zip_with" not in plan and "hashpartitioning(packet" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # merging, slicing and lines share the shuffle by packet


@pytest.mark.parametrize("name", ["f3_ols_fit", "f3_theil_sen_fit", "f3_ransac_fit"])
def test_fits_stay_in_the_rows_of_their_lines(spark, sf, name):
    plan = _plan(registry.queries()[name](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("size(zip_with") == 0


def test_fits_of_many_sizes_equal_those_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(g, 0, c, 3.0 * c + (g % 3), float(rng.normal())) for g in range(40) for c in range(g % 9)]
    points = spark.createDataFrame(rows, "packet long, subarray_id long, channel int, s double, t double")
    for fit in (doa.ransac_fit, doa.theil_sen_fit, lambda p: doa.multiline_fit(p, k=2, least=2), lambda p: doa.multiline_fit(p, k=2, least=2, shared=True)):
        whole = {r.packet: r for r in fit(points).collect()}
        for g in (1, 2, 3, 5, 8, 17, 26):
            alone = fit(points.filter(f"packet = {g}")).collect()
            assert [whole[g]] == alone if alone else g not in whole


def test_rings_are_not_shuffled_and_take_the_side_that_meets_the_plane(spark):
    rows = [(k, 0, 20.0 + 7 * k, 0.6, 0.0 if k % 2 else 0.8, 0.8 if k % 2 else 0.0, 1.0, 2.0, -10.0 + 5 * k) for k in range(20)]
    fits = spark.createDataFrame(rows, "packet long, subarray_id int, angle_deg double, ax double, ay double, az double, re double, rn double, ru double")
    for far in (50.0, 500.0):
        got = locate.cone_plane_points(fits, max_range=far)
        assert "Window" not in _plan(got) and "Exchange" not in _plan(got)
        scanned = locate.cone_plane_points(fits, max_range=far, window=(-1e9, 1e9, -1e9, 1e9))  # asks every direction
        assert sorted(got.collect()) == sorted(scanned.collect()) and got.count() > 0


def test_polygons_of_fits_equal_those_of_their_points(spark, sf):
    from sensorline.plans.arrival_queries import _located

    fits = _located(spark, sf).filter("packet < 400").cache()
    for far in (60.0, 500.0):
        plain = {(r.packet, r.subarray_id): r for r in locate.band_polygon(locate.cone_plane_points(fits, max_range=far)).collect()}
        got = {(r.packet, r.subarray_id): r for r in locate.fit_polygons(fits, max_range=far).collect()}
        assert got.keys() == plain.keys() and got
        for key, r in got.items():
            assert r.n_vertices == plain[key].n_vertices and r.area == pytest.approx(plain[key].area, rel=1e-7, abs=1e-5)
    assert "Window" not in _plan(registry.queries()["f10_band_polygon"](spark, sf))


def _join_rows(df) -> int:
    """Rows that the joins of a collected frame gave out."""

    def nodes(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        return [node, *[n for x in inner for n in nodes(x)]]

    joins_ = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName().endswith("JoinExec")]
    assert joins_
    return sum(n.metrics().apply("numOutputRows").value() for n in joins_)


def test_fixes_of_one_time_meet_runs_as_arrays(spark):
    """5,000 fixes at one time and 40 runs: their 200,000 pairs are not rows of the join."""
    at = lambda us: F.timestamp_micros(F.lit(1_700_000_000_000_000) + us)
    fixes = spark.range(5_000).select(F.col("id").alias("event_id"), at(F.lit(0)).alias("ts"))
    runs = spark.range(40).select(F.col("id").alias("run_id"), at(F.lit(-1_000_000)).alias("start_ts"), at(F.lit(7)).alias("stop_ts"))
    got = polyline.run_window(fixes, runs)
    assert got.columns == ["event_id", "ts", "run_id"]
    rows = got.collect()
    assert len(rows) == 200_000 == len({(r.event_id, r.run_id) for r in rows})
    assert _join_rows(got) == 80


def test_run_windows_hold_their_ends_to_the_microsecond(spark):
    at = lambda s, us=0: F.timestamp_micros(F.lit(s * 1_000_000 + us))
    ends = [(1, 100, 0), (2, 100, -1), (3, 1060, 0), (4, 1060, 1), (5, 500, 0), (6, -20, 0)]
    fixes = None
    for key, s, us in ends:
        one = spark.range(1).select(F.lit(key).alias("event_id"), at(s, us).alias("ts"))
        fixes = one if fixes is None else fixes.unionByName(one)
    fixes = fixes.unionByName(spark.sql("select 7 as event_id, cast(null as timestamp) as ts"))
    runs = spark.range(1).select(F.lit("a").alias("run_id"), at(280).alias("start_ts"), at(880).alias("stop_ts"))
    runs = runs.unionByName(spark.range(1).select(F.lit("b").alias("run_id"), at(150).alias("start_ts"), at(-190).alias("stop_ts")))
    runs = runs.unionByName(spark.range(1).select(F.lit("c").alias("run_id"), at(900).alias("start_ts"), at(100).alias("stop_ts")))
    got = {(r.event_id, r.run_id) for r in polyline.run_window(fixes, runs).collect()}
    assert got == {(1, "a"), (3, "a"), (5, "a"), (6, "b")}


def test_integrals_of_many_channels_share_calls_and_state(spark, tmp_path):
    """2,000 channels, one without a number and ids beyond 2**53, in two unordered deliveries: a state row per channel would be 2,000 of them."""
    big = 1 << 60
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.range(6_000).select(
            F.when(F.col("id") % 2_000 > 0, F.lit(big) + F.col("id") % 2_000).alias("channel"), (F.lit(9) - F.floor(F.col("id") / 2_000)).alias("sample_idx"),
            F.when(F.col("id") % 7 > 0, F.col("id") % 11 + 0.25).alias("value"), F.timestamp_seconds(F.lit(1_000) - F.floor(F.col("id") / 2_000)).alias("ts"),
        )
        rows.limit(0).write.parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        for turn in (rows.filter("sample_idx = 8"), rows.filter("sample_idx <> 8"), rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(9_000)))):
            turn.write.mode("append").parquet(f"{tmp_path}/in")
            run = streams.running_integral(source, 9.0, 2.0, "60 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
            assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) < 1_500
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want, total = {}, {}
    for k in range(5_999, -1, -1):  # times run against the numbers of the samples' ids
        value = 0.0 if k % 7 == 0 or k % 11 + 0.25 > 9 else k % 11 + 0.25
        channel = big + k % 2_000 if k % 2_000 else None
        total[channel] = total.get(channel, 0.0) + value
        want[channel, 9 - k // 2_000] = total[channel] * 2.0
    assert {(r.channel, r.sample_idx): r.integral for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_trimmed_lines_of_a_batch_equal_those_by_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(g, 0, c, 3.0 * c, float(c * 4e-4 + rng.normal() * 4e-3) if (g, c) != (5, 1) else None) for g in range(60) for c in range(1 + g % 8)]
    rows += [(100, 0, c, 2.0, 0.001 * c) for c in range(5)]  # one place: no slope
    lines = doa.gather_line(spark.createDataFrame(rows, "packet long, subarray_id long, channel int, s double, t double"))
    got = {r.packet: r.asDict() for r in doa.trimmed_lines(lines).collect()}
    want = {r.packet: r.asDict() for r in doa.trimmed_lines(lines, line=lambda k: doa.ols_line(k)).collect()}
    assert got.keys() == want.keys() and len({r["reason"] for r in want.values()}) >= 4
    for key, r in want.items():
        assert got[key] == {c: pytest.approx(v, rel=1e-9, abs=1e-15) if isinstance(v, float) else v for c, v in r.items()}
    assert "ArrowEvalPython" in _plan(doa.trimmed_lines(lines)) and _plan(doa.trimmed_lines(lines)).count("aggregate(") == 0


def test_common_polygons_of_many_groups_equal_those_one_by_one():
    from sensorline.operators import outlines

    rng = np.random.default_rng(2)
    group, e, n = [], [], []
    for g in range(60):
        for _ in range(1 + g % 3):
            turn, r = np.sort(rng.random(9)) * 2 * np.pi, rng.uniform(20, 200, 9)
            group, e, n = [*group, g], [*e, 1e3 * g + r * np.cos(turn)], [*n, r * np.sin(turn)]
    group = np.array(group)
    of, got = outlines.common_polygons(group, e, n)
    for g in range(60):
        mine = np.flatnonzero(group == g)
        assert got[of == g] == pytest.approx(outlines.common_polygon([e[k] for k in mine], [n[k] for k in mine]), rel=1e-9, abs=1e-6)
    assert len(set(of.tolist())) > 50


@pytest.mark.parametrize("name", ["f10_resolved_outlines", "f12_common_outline"])
def test_outlines_of_fits_are_not_points(spark, sf, name):
    from sensorline.operators import outlines
    from sensorline.plans.arrival_queries import _located

    assert "collect_list(p#" not in _plan(registry.queries()[name](spark, sf))  # no row per vertex
    fits = _located(spark, sf).filter("packet < 300").cache()
    plain = {(r.packet, r.subarray_id): r for r in outlines.outlines(locate.cone_plane_points(fits, samples=36, max_range=500.0)).collect()}
    got = {(r.packet, r.subarray_id): r for r in outlines.fit_outlines(fits, samples=36, max_range=500.0).collect()}
    assert got.keys() == plain.keys() and got
    for key, r in got.items():
        assert r.e == pytest.approx(plain[key].e, rel=1e-7, abs=1e-5) and r.n == pytest.approx(plain[key].n, rel=1e-7, abs=1e-5)


def test_tracks_of_one_tile_are_not_shuffled_as_cells(spark, sf):
    from sensorline.plans.arrival_queries import WINDOW, _located

    fits = _located(spark, sf).filter("packet < 600").cache()
    got = locate.locate(fits, WINDOW, 10.0, 2)
    plan = _plan(got)
    whole = locate.track_centroids(locate.regions(locate.fine_cells(fits, WINDOW, 10.0, 2)), 5.0)
    assert sorted(got.collect()) == sorted(whole.select(*got.columns).collect()) and got.count() > 0
    assert plan.count("MapInPandas") == 1 and "Window" not in plan


def test_series_of_angles_in_blocks(spark, tmp_path):
    """Gaps within, at the borders of and over whole blocks of 8; a packet given twice; a subarray that ends early."""
    from sensorline.operators import reports

    given = {1: [0, 1, 7, 8, 9, 33, 34, 40, 41, 41], 2: [3], 3: [15, 16, 17, 31, 32]}
    rows = [(s, p, True, float(p)) for s, ps in given.items() for p in ps] + [(4, 2, False, 1.0), (1, -1, True, 1.0)]
    fits = spark.createDataFrame(rows, "subarray_id int, packet long, valid boolean, angle_off_axis_deg double")
    for most, path in ((None, None), (None, f"{tmp_path}/a"), (45, f"{tmp_path}/b"), (16, None)):
        want = []
        for s, ps in given.items():
            last, segment, seen = 41 if most is None else most, 0, None
            for p in range(last + 1):
                if p in ps:
                    segment += seen is not None and p - seen > 1
                    seen = p
                want += [(s, p, float(p), segment) if p in ps else (s, p, None, None)] * max(1, ps.count(p))
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, reports.angle_series(fits, most, path, block=8).collect()), key=key) == sorted(want, key=key)


def test_series_of_angles_is_dealt_by_blocks_and_fits_once(spark, sf):
    plan = _plan(registry.queries()["g2_angle_series"](spark, sf))
    assert "hashpartitioning(subarray_id" in plan and "lineitem" not in plan


def test_cells_of_peaks_are_handed_over_one_by_one(spark):
    """An Arrow batch holds 10,000 rows however long, so a batch of cells would be a partition's whole series."""
    from sensorline.operators import detection

    series = spark.range(100).select((F.col("id") % 2).alias("channel"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    assert "FlatMapGroupsInPandas" in _plan(detection.local_maxima(series, 1.0))
