"""Closed-form and brute-force cases of the operators."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.functions import scalars
from sensorline.operators import arrivals, calibrate, conditioning, detection, doa, joins, locate, packets, polyline, reports, sensitivity, signal
from sensorline.sources import arrivals as arrival_files
from sensorline.sources import blocks as block_files
from sensorline.sources import tables
from sensorline.streaming import streams


def _blocks(spark, series, size):
    rows = [(0, c, k, k * size, [float(v) for v in x[k * size : (k + 1) * size]]) for c, x in series.items() for k in range(math.ceil(len(x) / size))]
    return spark.createDataFrame(rows, "run_id int, channel long, block_no long, start_sample long, samples array<double>")


def _long(df):
    out = {}
    for r in conditioning.explode_blocks(df).collect():
        out.setdefault(r.channel, {})[r.sample_idx] = r.value
    return out


def test_plane_wave_with_outliers_recovers_the_angle(spark):
    theta = math.radians(70)
    rows = [(1, 0, c, 5.0 * c, 5.0 * c * math.cos(theta) / 1475 + (0.05 if c % 5 == 0 else 0)) for c in range(40)]
    pts = spark.createDataFrame(rows, "packet long, subarray_id int, channel int, s double, t double")
    slope = doa.theil_sen_fit(pts).first().slope
    assert math.degrees(math.acos(slope * 1475)) == pytest.approx(70, abs=1e-6)
    fit = doa.with_angles(doa.trimmed_fit(pts, 40.0, 5.0, fit=doa.theil_sen_fit)).first()
    assert fit.valid and fit.n_inliers_stage2 == 32 and fit.angle_deg == pytest.approx(70, abs=1e-6)
    assert doa.ransac_fit(pts).first().slope == doa.ransac_fit(pts.repartition(3)).first().slope


def test_three_lines(spark):
    rows = [(1, 0, c, float(c), 2e-4 * c + 0.1 * (c % 3)) for c in range(60)]
    pts = spark.createDataFrame(rows, "packet long, subarray_id int, channel int, s double, t double")
    for shared in (False, True):
        assert doa.multiline_fit(pts, shared=shared).first().slope == pytest.approx(2e-4, abs=2e-5)


def test_leaving_one_out_equals_fitting_without_each_point():
    rng = np.random.default_rng(5)
    for n in (7, 12, 30):
        s, t, label = rng.normal(size=n), rng.normal(size=n), np.arange(n) % 2

        def plain(keep):
            x = np.stack([s, label == 0, label == 1], 1)[keep]
            m, left = np.linalg.lstsq(x, t[keep], rcond=None)[:2]
            return left[0], m

        fits = [plain(np.arange(n) >= 0)] + [plain(np.arange(n) != j) for j in range(n) if (label == label[j]).sum() > 3]
        want = min(fits, key=lambda f: f[0])[1]
        slope, cut = doa._best_shared(s, t, label, 2, 3, True)
        assert [slope, *cut] == pytest.approx(want.tolist())


def test_parallel_lines_with_an_outlier_and_a_steep_slope(spark):
    late = [(1, 0, c, float(c), 2e-4 * c + 0.1 * (c % 3) + (0.04 if c == 31 else 0)) for c in range(60)]
    steep = [(2, 0, c, float(c), 0.01 * c + 0.001 * (c % 3)) for c in range(30)]
    few = [(3, 0, c, float(c), 3e-4 * c) for c in range(5)] + [(4, 0, 1, 0.0, 0.0)]
    pts = spark.createDataFrame(late + steep + few, "packet long, subarray_id int, channel int, s double, t double")
    got = {r.packet: r for r in doa.multiline_fit(pts, shared=True).collect()}
    assert got[1].slope == pytest.approx(2e-4, abs=5e-6) and got[1].n_lines == 3
    assert got[2].slope == pytest.approx(0.99 / 1475)
    assert got[3].slope == pytest.approx(3e-4) and got[3].n_lines == 1
    assert got[4].slope is None


def test_envelope_does_not_see_block_borders(spark):
    t = np.arange(3000)
    pulse = np.exp(-(((t - 1500) / 400.0) ** 2)) * np.sin(0.9 * t)

    one, many = (_long(signal.envelope(_blocks(spark, {0: pulse}, size), 128))[0] for size in (3000, 70))
    assert len(one) == len(many) == 3000
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9
    want = np.exp(-(((t - 1500) / 400.0) ** 2))
    assert max(abs(one[k] - want[k]) for k in one) < 0.01


def test_bucketed_sweep_equals_the_plain_one(spark):
    rng = np.random.default_rng(2)
    knots = spark.createDataFrame([(int(u), float(x), float(x) * 2) for u, x in zip(rng.integers(0, 3, 60), rng.integers(0, 900, 60))], "u int, x double, v double").dropDuplicates(["u", "x"])
    queries = spark.createDataFrame([(int(u), float(x), k) for k, (u, x) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-50, 950, 300)))], "u int, x double, k int")
    plain = joins.bracketing(queries, knots, "x", ["v"], ("u",))
    for width in (7.0, 100.0, 5000.0):
        swept = joins.bracketing_bucketed(queries, knots, "x", ["v"], width, ("u",))
        assert sorted(map(str, swept.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_vertical_axis_meets_the_plane_in_a_circle(spark):
    fit = spark.createDataFrame([(1, 0, 60.0, 0.0, 0.0, 1.0, 0.0, 0.0, 20.0)], "packet long, subarray_id int, angle_deg double, ax double, ay double, az double, re double, rn double, ru double")
    ring = locate.cone_plane_points(fit, 30.0).filter("ring = 'nominal'").select(F.sqrt(F.col("e") ** 2 + F.col("n") ** 2).alias("r")).collect()
    assert len(ring) == 300 and all(r.r == pytest.approx(10 * math.tan(math.radians(60))) for r in ring)
    area = locate.band_polygon(locate.cone_plane_points(fit, 30.0)).first().area
    assert area > 0


def test_track_from_two_fits(spark):
    """Two lines across each other see a source where it is."""
    source = np.array([40.0, 25.0, 30.0])
    rows = []
    for k, (axis, ref) in enumerate([((1.0, 0.0, 0.0), (10.0, 0.0, 0.0)), ((0.0, 1.0, 0.0), (0.0, 5.0, 0.0))]):
        d = np.array(ref) - source
        rows.append((1, k, float(np.degrees(np.arccos(d @ np.array(axis) / np.linalg.norm(d)))), *axis, *ref))
    fits = spark.createDataFrame(rows, "packet long, subarray_id int, angle_deg double, ax double, ay double, az double, re double, rn double, ru double")
    best = locate.locate(fits, (-100.0, 100.0, -100.0, 100.0), 5.0, 5).collect()
    assert min(math.hypot(r.e - 40, r.n - 25) for r in best) < 5


def test_pulse_train(spark):
    x = np.zeros(800)
    for at, a in ((150, 1.0), (350, 0.8), (550, 0.3)):
        x[at : at + 60] += a
    blocks = _blocks(spark, {7: x}, 200)
    corr = _long(signal.matched_filter(blocks, [1.0] * 60))[7]
    assert corr == pytest.approx(dict(enumerate(np.correlate(x, np.ones(60), "valid"))))
    series = conditioning.explode_blocks(signal.matched_filter(blocks, [1.0] * 60))
    peaks = {r.peak: r.prominence for r in detection.find_peaks(series, 10.0, 5.0, 50).collect()}
    assert sorted(peaks) == [150, 350, 550] and peaks[350] == pytest.approx(48)
    runs = spark.createDataFrame([(0, 160, 200, 3)], "run_id int, offset long, period long, n_packets long")
    found = detection.detect_packets(series, runs, 20.0, 10.0, 5.0, 50).collect()
    assert sorted((r.packet, r.sample_idx) for r in found) == [(0, 150), (1, 350), (2, 550)]


def test_early_echo_is_taken(spark):
    peaks = spark.createDataFrame([(1, 95), (1, 104), (1, 300)], "channel long, peak long")
    targets = spark.createDataFrame([(0, 100), (1, 200)], "packet long, target long")
    assert [tuple(r) for r in detection.assign_peaks(peaks, targets, 10.0).collect()] == [(0, 1, 95)]


def test_bandpass_is_3_db_at_the_edges_and_block_size_does_not_matter(spark):
    sos = signal.butterworth_bandpass(10.0, 20.0, 100.0, 3)
    z = np.exp(-2j * np.pi * np.array([10.0, 20.0, 14.2]) / 100)
    h = np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sos], 0)
    assert abs(h[:2]) == pytest.approx(1 / math.sqrt(2), abs=1e-6) and abs(h[2]) == pytest.approx(1, abs=1e-3)
    x = np.random.default_rng(1).standard_normal(2000)
    a, b = (_long(signal.bandpass(_blocks(spark, {1: x}, n), 10.0, 20.0, 100.0, 3))[1] for n in (500, 1000))
    assert a == pytest.approx(b, abs=1e-6)


def test_integral_does_not_depend_on_blocks(spark):
    x = np.arange(100.0)
    long = conditioning.explode_blocks(_blocks(spark, {1: x, 2: -x}, 30))
    for block in (7, 1000):
        got = {(r.channel, r.sample_idx): r.integral for r in conditioning.integrate(long, 0.5, block).collect()}
        assert got[1, 99] == pytest.approx(x.sum() / 2) and got[2, 50] == pytest.approx(-x[:51].sum() / 2)


def test_wrap_and_unwrap_round_trip(spark):
    x = np.cumsum(np.random.default_rng(2).uniform(-40, 40, 60)) * 1.0
    x -= x[0]
    df = spark.createDataFrame([(0, c, float(v)) for c, v in enumerate(x)], "sample_idx long, channel long, raw double").withColumn("value", scalars.wrap(F.col("raw"), 90.0))
    assert all(r.unwrapped == pytest.approx(r.raw) for r in conditioning.unwrap(df, 90.0).collect())


def test_altitude_gap_and_lead_in(spark):
    line = spark.createDataFrame([(1, k, 0.0, 0.0, z) for k, z in enumerate([10.0, 0.0, 0.0, 40.0, 0.0])], "cable_id int, seq int, lat double, lon double, alt double")
    assert [r.alt for r in polyline.fill_alt_by_index(line).orderBy("seq").collect()] == pytest.approx([10, 20, 30, 40, 40])
    ch = spark.createDataFrame([(c, float(c)) for c in range(10)], "channel int, lat double")
    assert [tuple(r) for r in polyline.lead_in_remap(ch, 2).orderBy("channel").collect()] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0), (5, 2.0), (6, 3.0), (7, 4.0)]


def test_bins_and_gaps(spark):
    fits = spark.createDataFrame([(k, 0, True, a) for k, a in enumerate([0.0, 0.5, 0.51, 5.0, 90.0, -1.0])], "packet long, subarray_id int, valid boolean, angle_off_axis_deg double")
    hist = {r.bin_no: r.n for r in reports.angle_histogram(fits, reports.angle_bins(spark)).collect()}
    assert hist[0] == 2 and hist[1] == 2 and hist[18] == 1 and sum(hist.values()) == 5
    some = spark.createDataFrame([(p, 0, True, 1.0) for p in (1, 2, 3, 7, 8)], fits.schema)
    rows = [r.segment for r in reports.angle_series(some, 9).orderBy("packet").collect()]
    assert rows == [None, 0, 0, 0, None, None, None, 1, 1, None]


def test_codec_round_trip_and_checksum(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (5, 64))
    for row in bits:
        rest = 0
        for b in row[:56]:
            top = (rest >> 7) ^ b
            rest = (rest << 1) & 255
            rest ^= 7 * top
        row[56:] = [(rest >> k) & 1 for k in range(7, -1, -1)]
    coded = []
    for k, row in enumerate(bits):
        state, out = 0, []
        for b in [*row, *[0] * 8]:
            reg = (int(b) << 8) | state
            out += [bin(reg & p).count("1") & 1 for p in packets.POLYNOMIALS]
            state = reg >> 1
        out[3 * k] ^= 1  # an error that decoding repairs
        coded.append((k, k, out))
    df = spark.createDataFrame(coded, "channel int, packet int, bits array<int>")
    got = {r.packet: r.bits for r in packets.convolutional_decode(df).collect()}
    assert all(got[k] == row.tolist() for k, row in enumerate(bits))
    fields = packets.unpack_fields(packets.convolutional_decode(df)).collect()
    assert all(r.valid for r in fields)
    assert {r.packet: r.version for r in fields} == {k: int("".join(map(str, row[:4])), 2) for k, row in enumerate(bits)}


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(0, 100, 60))], "i int, x double")
    iv = spark.createDataFrame([(j, float(a), float(a + w)) for j, (a, w) in enumerate(zip(rng.uniform(0, 100, 30), rng.uniform(0, 20, 30)))], "j int, lo double, hi double")
    got = {(r.i, r.j) for r in joins.point_interval_join(p, iv, "x", "lo", "hi", 7.0).collect()}
    assert got == {(a.i, b.j) for a in p.collect() for b in iv.collect() if b.lo <= a.x < b.hi}
    near = {(r.i, r.j) for r in joins.within_join(p, iv, "x", "lo", 3.0).collect()}
    assert near == {(a.i, b.j) for a in p.collect() for b in iv.collect() if abs(a.x - b.lo) <= 3}
    knots = iv.select(F.col("lo").alias("x"), F.col("hi").alias("v"))
    one = {r.i: tuple(r) for r in joins.bracketing(p, knots, "x", ["v"]).select("i", "at_lo", "v_lo", "at_hi", "v_hi").collect()}
    two = {r.i: tuple(r) for r in joins.bracketing_bucketed(p, knots, "x", ["v"], 9.0).select("i", "at_lo", "v_lo", "at_hi", "v_hi").collect()}
    assert one == two


def test_kernel_mean_and_statistics(spark):
    q = spark.createDataFrame([(0, 5.0), (1, 50.0)], "qid int, x double")
    p = spark.createDataFrame([(4.0, 1.0), (6.0, None), (7.0, 100.0)], "xp double, fp double")
    got = {r.qid: r["mean"] for r in sensitivity.kernel_mean(q, p, 2.0).collect()}
    assert got == {0: 0.5, 1: None}
    with pytest.raises(ValueError):
        sensitivity.binned_sensitivity(q, q, q, ["mode"])
    loud = {r.qid: r["mean"] for r in sensitivity.kernel_mean(q, p.filter("fp = 1"), 2.0, db_in=True, db_out=True).collect()}
    assert loud[0] == pytest.approx(1.0)


def test_files_round_trip(spark, tmp_path):
    arr = spark.createDataFrame([(1, 7, 100), (1, 8, 120), (2, 7, 300)], "packet int, channel int, sample_idx long")
    arrival_files.write_arrivals(arr, f"{tmp_path}/a", "packet")
    got = arrival_files.nest_rows(spark.read.text(f"{tmp_path}/a"), "packet", "channel")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, arr.collect()))
    assert {r.packet: len(r.arrivals) for r in arrivals.flip_arrivals(arr).collect()} == {1: 2, 2: 1}
    b = _blocks(spark, {1: np.arange(60.0), 2: np.arange(60.0)}, 20)
    block_files.write_blocks(b, f"{tmp_path}/b")
    assert block_files.scan_blocks(spark, f"{tmp_path}/b", 0, 25, 45, (2, 3)).count() == 2
    (tmp_path / "w").mkdir()
    for k, name in enumerate(("x_20200101_000000.wav", "x_20200101_000010.wav")):
        with wave.open(str(tmp_path / "w" / name), "wb") as w:
            w.setparams((1, 2, 10, 0, "NONE", ""))
            w.writeframes(np.full(100, 1000 * (k + 1), "<i2").tobytes())
    wav = block_files.ingest_wav(spark, f"{tmp_path}/w", "x").orderBy("block_no").collect()
    assert [(r.block_no, r.start_sample, len(r.samples)) for r in wav] == [(0, 0, 100), (1, 100, 100)]
    (tmp_path / "line.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"fid":"1"},"geometry":{"type":"MultiLineString","coordinates":[[[10.0,63.0,-5.0],[10.1,63.1]]]}}]}')
    line = tables.read_polyline(spark, f"{tmp_path}/line.json").orderBy("seq").collect()
    assert [(r.lat, r.lon, r.alt) for r in line] == [(63.0, 10.0, -5.0), (63.1, 10.1, None)]


def test_upsert_modes(spark):
    old = spark.createDataFrame([("d", 1, 10, None), ("d", 2, 20, 2)], "date string, run_id int, a int, b int")
    new = spark.createDataFrame([("d", 2, 21, None), ("d", 3, 30, 3)], old.schema)
    pick = lambda mode: {r.run_id: (r.a, r.b) for r in tables.upsert_runs(old, new, mode).collect()}
    assert pick("ignore")[2] == (20, 2) and pick("replace")[2] == (21, None)
    assert pick("replace-existing")[2] == (21, 2) and pick("ignore-existing")[2] == (20, 2)
    with pytest.raises(ValueError):
        tables.upsert_runs(old, new)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, k, float((k * 7 + c) % 50)) for c in range(3) for k in range(40)]
    whole = spark.createDataFrame(rows, "channel long, sample_idx long, value double")
    for part in range(2):
        whole.filter((F.col("sample_idx") >= part * 20) & (F.col("sample_idx") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = streams.running_integral(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in"), 45.0, 0.5)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.channel, r.sample_idx): r.integral for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = conditioning.integrate(whole.withColumn("value", scalars.despike(F.col("value"), 45.0)), 0.5)
    assert got == pytest.approx({(r.channel, r.sample_idx): r.integral for r in batch.collect()})


def test_long_series_are_spread_over_tasks(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
        xs = spark.range(0, 20000, 10).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
        knots = spark.createDataFrame([(100.0, 1.0), (18100.0, 181.0)], "x double, y double")
        met = sensitivity.lookup_interp(xs, knots)
        assert all(r.y == pytest.approx(min(max(r.x, 100.0), 18100.0) / 100) for r in met.collect()) and met.count() == 2000 and parts(met) > 1
        segs = spark.createDataFrame([(True, 0, 200, 1.0), (True, 18000, 18200, 91.0)], "success boolean, receiver_min int, receiver_max int, theta_deg double").selectExpr("*", "cast(null as double) as theta_deg_norm", "cast(null as double) as theta_deg_continuous")
        angles = polyline.interp_segment_angles(segs, spark.range(20000).select(F.col("id").alias("channel")))
        assert all(r.theta == pytest.approx(1 + 90 * (min(max(r.channel, 100), 18100) - 100) / 18000) for r in angles.collect()) and parts(angles) > 1
        points = spark.range(1, 10001).selectExpr("id * 7 as packet", "id as lat", "id as lon")
        made = tables.export_features(points, "tx", 3)
        assert sorted(r.packet for r in made.collect()) == list(range(7, 70001, 21)) and parts(made) > 1
    finally:
        spark.conf.unset(setting)


def test_calibration_recovers_segments_and_names_failures(spark, tmp_path):
    rng = np.random.default_rng(5)
    truth = {0: (40.0, -25.0, 35.0, 0.02), 20: (-80.0, 60.0, -140.0, -0.1)}
    sources = [(p, float(rng.uniform(-600, 600)), float(rng.uniform(-600, 600)), 0.0, 10.0 * p) for p in range(40)]
    arrivals = []
    for start, (x0, y0, deg, dt) in truth.items():
        for k in range(20):  # the end channel is the next segment's first and stays silent
            hx, hy = x0 + k * 1.02 * math.cos(math.radians(deg)), y0 + k * 1.02 * math.sin(math.radians(deg))
            arrivals += [(start + k + (start > 0), p, t + math.dist((x, y, z), (hx, hy, -15.0)) / 1475 + dt) for p, x, y, z, t in sources]
    arrivals = [r for r in arrivals if r[0] != 20] + [(85, 99, 1.0), (125, 1, None), (None, 1, 1.0), (145, 3, 30.5)]
    got = {
        r.segment: r
        for r in calibrate.calibrate_segments(
            spark.createDataFrame(arrivals, "channel int, packet long, t double"),
            spark.createDataFrame([*sources, (None, 0.0, 0.0, 0.0, 0.0)], "packet long, x double, y double, z double, t_tx double"),
            spark.createDataFrame([(c, -45.0) for c in range(0, 161, 20) if c != 60] + [(60, None)], "channel int, z double"),
            str(tmp_path / "calibrate"), 0, 160,
        ).collect()
    }
    for start, (x0, y0, deg, dt) in truth.items():
        r = got[start]
        assert r.success and r.z_h == -15.0 and r.n_measurements == 800
        assert (r.x0, r.y0, r.theta_deg_norm, r.dt) == pytest.approx((x0, y0, deg, dt), abs=1e-5)
    assert [got[s].reason for s in (40, 60, 80, 100, 120, 140)] == ["missing_depth", "missing_depth", "no_measurements", "no_receivers", "no_measurements", "too_few_measurements"]
    none = calibrate.calibrate_segments(*(spark.createDataFrame([], s) for s in ("channel int, packet long, t double", "packet long, x double, y double, z double, t_tx double", "channel int, z double")), str(tmp_path / "none"), 0, 40)
    assert [r.reason for r in none.collect()] == ["missing_depth"] * 2
