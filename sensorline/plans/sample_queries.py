"""Queries over samples, blocks, polylines, packets and streams, each with its SQL twin."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from sensorline.functions import geo, scalars
from sensorline.operators import calibrate
from sensorline.operators import conditioning as C
from sensorline.operators import detection, joins, packets, polyline, sensitivity, signal
from sensorline.plans import bindings as B
from sensorline.sources import blocks as block_files
from sensorline.sources import recordings, tables
from sensorline.streaming import streams

QUERIES: dict = {}


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _scratch(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# calibration


#: A bent array of segments of 4 steps, turned by rule, that hears every order as a source:
#: the true bearings are known in SQL and must come back from the rounded arrivals.
_BEND = "(segment * 37) % 120 - 60"


@_query(
    "f14_calibrate_segments",
    f"""with s as (select 4 * unnest(generate_series(0, (select max(s_suppkey) - 2 from supplier) // 4)) as ch_min), n as (
      select 4 * g as ch_min, count(*) as n from (
        select distinct l_suppkey - 1 as channel, l_orderkey as packet from lineitem) a, (values (0), (1)) as v(b), lateral (select (channel - b) // 4 as g) where channel >= b and (b = 0 or channel % 4 = 0) group by g)
    select ch_min as segment, -15.0::double as z_h, ok as success, case when not ok then 'missing_depth' end as reason, case when ok then n else 0 end as n_measurements,
      case when ok then ({_BEND.replace("segment", "(ch_min // 4)")})::double end as theta_deg, case when ok then 0.02::double end as dt
    from (select *, ch_min + 4 <= (select max(s_suppkey) - 1 from supplier) as ok from s left join n using (ch_min)) where ok
    union all select ch_min, null, false, 'missing_depth', 0, null, null from s where ch_min + 4 > (select max(s_suppkey) - 1 from supplier)""",
)
def _(spark, sf):
    supplier, orders = B.table(spark, sf, "supplier"), B.table(spark, sf, "orders")
    depths = supplier.select((F.col("s_suppkey") - 1).alias("channel"), F.lit(-45.0).alias("z"))
    turn = lambda c: F.radians(F.pmod(F.floor(F.greatest(c - 1, F.lit(0)) / 4) * 37, F.lit(120)) - 60)
    leg = lambda f: F.when(F.col("channel") > 0, 1.02 * f(turn(F.col("channel")))).otherwise(0.0)
    places = depths.select("channel")
    for name, f in (("hx", F.cos), ("hy", F.sin)):
        places = joins.running_sum(places, leg(f), name, F.floor(F.col("channel") / 4096), [F.col("channel")])
    at = lambda c, m: (F.col(c) * m % 2001 - 1000).cast("double")
    sources = orders.select(F.col("o_orderkey").alias("packet"), at("o_orderkey", 7919).alias("x"), at("o_custkey", 104729).alias("y"), F.lit(0.0).alias("z"), (F.col("o_orderkey") % 3600).cast("double").alias("t_tx"))
    heard = B.table(spark, sf, "lineitem").select((F.col("l_suppkey") - 1).alias("channel"), F.col("l_orderkey").alias("packet")).distinct()
    r = F.sqrt((F.col("x") - F.col("hx")) ** 2 + (F.col("y") - F.col("hy")) ** 2 + 225.0)
    arrivals = heard.join(sources, "packet").join(places, "channel").select("channel", "packet", (F.round((F.col("t_tx") + r / 1475.0 + 0.02) * 25000) / 25000).alias("t"))
    last = supplier.agg(F.coalesce(F.max("s_suppkey"), F.lit(1)).alias("m")).first().m
    got = calibrate.calibrate_segments(arrivals, sources, depths, _scratch(spark, "calibrate"), 0, last - 1, 4)
    return got.select("segment", "z_h", "success", "reason", "n_measurements", (_r("theta_deg_norm", 1) + 0.0).alias("theta_deg"), (_r("dt", 3) + 0.0).alias("dt"))


# blocks and samples


@_query("a8_scan_blocks", f"with {B.BLK} select channel, block_no, block_no * 64 as start_sample from blk where channel >= 2 and channel < 6 and block_no * 64 < 900 and block_no * 64 + 64 > 130")
def _(spark, sf):
    path = _scratch(spark, "blocks")
    block_files.write_blocks(B.blocks(spark, sf), path)
    return block_files.scan_blocks(spark, path, 0, 130, 900, (2, 6)).select("channel", "block_no", "start_sample")


@_query("a8_select_block_range", f"with {B.BLK} select channel, greatest(block_no * 64, 130) as start_sample, least(block_no * 64 + 64, 900) - greatest(block_no * 64, 130) as n from blk where channel >= 2 and channel < 6 and block_no * 64 < 900 and block_no * 64 + 64 > 130")
def _(spark, sf):
    return C.select_block_range(B.blocks(spark, sf), [2, 3, 4, 5], 130, 770).select("channel", "start_sample", F.size("samples").cast("long").alias("n"))


@_query("a11_write_blocks", f"with {B.BLK} select 0 as run_id, channel, block_no, round(list_sum(list_transform(samples, lambda x: cast(x as double))), 4) + 0.0 as total from blk")
def _(spark, sf):
    path = _scratch(spark, "blocks")
    block_files.write_blocks(B.blocks(spark, sf), path)
    return block_files.scan_blocks(spark, path).select("run_id", "channel", "block_no", (_r(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


@_query(
    "a12_ingest_wav",
    """with b as (select label as channel, row_number() over (partition by label order by vec_id) - 1 as block_no, embedding as samples from embeddings where label is not null),
    g as (select channel, block_no from range((select max(channel) + 1 from b)) as c(channel), range((select max(block_no) + 1 from b)) as k(block_no))
    select cast(channel as int) as channel, block_no, block_no * 64 as start_sample, 64::double as fs, cast(coalesce(list_sum(list_transform(samples, lambda x: greatest(-32768, least(32767, floor(cast(x as double) * 32768 + 0.5))))), 0) as bigint) as total from g left join b using (channel, block_no)""",
)
def _(spark, sf):
    """Recordings of 64 s, written from blocks and read back by ranges of 16 KB."""
    path, held = _scratch(spark, "recordings"), B.blocks(spark, sf).filter("channel is not null")
    channels = held.agg(F.coalesce(F.max("channel"), F.lit(0)) + 1).first()[0]
    recordings.write_wav(held, path, "tow", "20200101_000000", 64, int(channels), 1, 64)
    got = recordings.ingest_wav(spark, path, "tow", block_seconds=1, range_bytes=16 << 10)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 32768)
    return got.select("channel", "block_no", "start_sample", "fs", total.cast("long").alias("total"))


@_query("a16_write_decoded", "select l_suppkey as channel, l_orderkey as packet, l_linenumber as line, case when l_returnflag <> 'R' then round(l_quantity / 5, 4) end as snr, l_linestatus as mode from lineitem")
def _(spark, sf):
    """Receptions written as decoded packets and read back."""
    path = _scratch(spark, "decoded")
    mode = F.col("l_linestatus").alias("mode")
    rows = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("packet"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 5).alias("snr"), mode)
    tables.write_decoded(rows, path)
    return tables.read_decoded(spark, path, "line int, snr double, mode string").withColumn("snr", _r("snr", 4))


@_query("a5_read_source_track", "select strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value / 10, 6) as lat, round(value / 20, 6) as lon from events where event_id % 7 <> 0 and event_id % 11 <> 0")
def _(spark, sf):
    path, k = _scratch(spark, "track"), F.col("event_id")
    stamp = F.when(k % 11 == 0, "at noon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    lat = F.when(k % 7 == 0, "north").otherwise((F.col("value") / 10).cast("string"))
    B.table(spark, sf, "events").select(stamp.alias("datetime"), lat.alias("lat"), (F.col("value") / 20).alias("lon")).write.csv(path, header=True)
    return tables.read_source_track(spark, path).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), _r("lat").alias("lat"), _r("lon").alias("lon"))


@_query(
    "a6_read_runs",
    """select cast(o_orderkey as int) as run_id, case when o_orderkey % 5 <> 0 then round(o_totalprice, 2) end as fs, strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') as start_ts,
    case when o_orderkey % 3 = 0 then cast(o_custkey as double) else case when o_orderkey % 100 >= 60 then 5.5 else 2.5 end end as alt from orders""",
)
def _(spark, sf):
    path, k = _scratch(spark, "runs"), F.col("o_orderkey")
    alt = F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise('{"0": 2.5, "60": 5.5}')
    B.table(spark, sf, "orders").select(k.alias("run_id"), F.when(k % 5 == 0, "none").otherwise(F.col("o_totalprice").cast("string")).alias("fs"), F.date_format("o_orderdate", "yyyyMMdd HHmmss").alias("start_ts"), alt.alias("tx_alt")).write.csv(path, header=True, escape='"')
    runs = tables.read_runs(spark, path)
    return runs.select("run_id", _r("fs", 2).alias("fs"), F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), polyline.altitude_at(F.col("tx_alt"), F.col("run_id") % 100).alias("alt"))


@_query("a3_read_polyline", f"with {B.LIN} select cast(seq - min(seq) over (partition by cable_id) as int) as seq, round(lat, 6) as lat, round(lon, 6) as lon, round(alt, 4) + 0.0 as alt from lin")
def _(spark, sf):
    path = _scratch(spark, "lines")
    tables.write_polyline(polyline.chainage(B.full_lines(spark, sf)), path)
    return tables.read_polyline(spark, path, whole=False).select("seq", _r("lat").alias("lat"), _r("lon").alias("lon"), (_r("alt", 4) + 0.0).alias("alt"))


@_query("a13_read_bands", "select s_name as band, round(s_acctbal, 2) + 0.0 as f_lo, round(s_acctbal + s_suppkey, 2) + 0.0 as f_hi from supplier")
def _(spark, sf):
    """A file of bands for every nation."""
    path, s = _scratch(spark, "bands"), B.table(spark, sf, "supplier")
    entry = F.struct("s_name", F.array("s_acctbal", F.col("s_acctbal") + F.col("s_suppkey")))
    s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.partitionBy("s_nationkey").text(path)
    return tables.read_bands(spark, path).select("band", (_r("f_lo", 2) + 0.0).alias("f_lo"), (_r("f_hi", 2) + 0.0).alias("f_hi"))


@_query("a13_read_transducer", "select round(o_custkey * 1000.0, 3) as x, round(o_totalprice, 2) as y from orders where o_orderkey % 5 <> 0")
def _(spark, sf):
    path, o = _scratch(spark, "transducer"), B.table(spark, sf, "orders")
    o.select(F.col("o_custkey").alias("f"), F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.col("o_totalprice").cast("string")).alias("tx")).write.csv(path, header=True)
    return tables.read_transducer(spark, path).select(_r("x", 3).alias("x"), _r("y", 2).alias("y"))


@_query("a14_read_doa_results", "select distinct cast(s_nationkey as int) as start_channel, cast(s_nationkey % 7 + 3 as int) as array_length, cast(s_suppkey as int) as packet, cast(s_nationkey * 2 as double) as angle_deg from supplier")
def _(spark, sf):
    """A file of packets for every nation."""
    path, s = _scratch(spark, "results"), B.table(spark, sf, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("string"), F.struct((F.col("s_nationkey") * 2).cast("double").alias("angle_deg")))
    name = F.format_string("start_ch_%d_arrlen_%d", F.col("s_nationkey"), F.col("s_nationkey") % 7 + 3).alias("name")
    s.groupBy(name).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.partitionBy("name").text(path)
    found = tables.read_doa_results(spark, path)
    return found.select("start_channel", "array_length", "packet", scalars.json_path(F.col("json"), "angle_deg").cast("double").alias("angle_deg"))


@_query("a9_find_blocks", "select user_id, count(*) as n from events where ts > (select min(ts) from events) + interval 90 second and ts <= (select min(ts) from events) + interval 86500 second group by user_id")
def _(spark, sf):
    e = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = e.agg((F.min("ts") + F.expr("interval 100 seconds")).alias("t0"))
    found = block_files.find_blocks(e.join(F.broadcast(start)), F.col("t0"), 86400.0)
    return found.groupBy("user_id").agg(F.count("*").alias("n"))


@_query("a10_block_inventory", f"with {B.BLK} select 0 as run_id, channel, count(*) as n_blocks, min(block_no * 64) as first_sample, max(block_no * 64) as last_block_sample from blk group by channel")
def _(spark, sf):
    return block_files.block_inventory(B.blocks(spark, sf))


@_query("b1_select_range", f"with {B.SMP} select channel, sample_idx, value from smp where channel >= 4 and channel < 90 and (channel - 4) % 3 = 0 and sample_idx >= 5 and sample_idx < 25")
def _(spark, sf):
    return C.select_range(B.samples(spark, sf), (4, 90, 3), 5, 20).select("channel", "sample_idx", "value")


@_query("b2_time_axis", f"with {B.SMP} select channel, sample_idx, strftime(ts + to_microseconds(cast(floor(sample_idx * 40000 / 1000) as bigint)), '%Y-%m-%d %H:%M:%S.%f') as at from smp")
def _(spark, sf):
    at = C.time_axis(F.col("ts"), F.col("sample_idx"), 1 / 25000)
    return B.samples(spark, sf).select("channel", "sample_idx", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@_query("b2_relative_time", f"with {B.SMP} select channel, sample_idx, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by channel)) / 1e6, 3) as rel_s from smp")
def _(spark, sf):
    return C.relative_time(B.samples(spark, sf)).select("channel", "sample_idx", _r("rel_s", 3).alias("rel_s"))


@_query("b3_to_units", f"with {B.BLK} select channel, sample_idx, round(value * (0.5 / 8.0), 6) + 0.0 as value from lng")
def _(spark, sf):
    b = B.blocks(spark, sf).withColumn("samples", C.to_units(F.col("samples"), 0.5, [4.0, 8.0], 1))
    return C.explode_blocks(b).withColumn("value", _r("value") + 0.0)


@_query("b4_despike", "select event_id, case when abs(value) > 400 then 0.0 else value end as v from events")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", scalars.despike(F.col("value"), 400.0).alias("v"))


@_query("b5_wrap", "select event_id, round((value + 45.0) - 90.0 * floor((value + 45.0) / 90.0) - 45.0, 6) + 0.0 as v from events")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", (_r(scalars.wrap(F.col("value"), 90.0)) + 0.0).alias("v"))


@_query(
    "b6_unwrap",
    f"""with {B.SMP}, d as (select channel, sample_idx, value, value - lag(value) over w as j from smp window w as (partition by sample_idx order by channel)),
    s as (select *, coalesce(case when (j + 45.0) % 90.0 < 0 then ((j + 45.0) % 90.0 + 90.0) % 90.0 else (j + 45.0) % 90.0 end - 45.0, value) as d from d) select channel, sample_idx, round(sum(d) over (partition by sample_idx order by channel), 5) + 0.0 as unwrapped from s""",
)
def _(spark, sf):
    return C.unwrap(B.samples(spark, sf), 90.0).select("channel", "sample_idx", (_r("unwrapped", 5) + 0.0).alias("unwrapped"))


@_query("b7_integrate", f"with {B.SMP} select channel, sample_idx, round(sum(value) over (partition by channel order by sample_idx) * 0.04, 6) as integral from smp")
def _(spark, sf):
    return C.integrate(B.samples(spark, sf).select("channel", "sample_idx", "value"), 0.04, 16).select("channel", "sample_idx", _r("integral").alias("integral"))


@_query("b7_integrate_blocks", f"with {B.BLK} select channel, sample_idx, round(sum(value) over (partition by channel order by sample_idx) * 0.04, 5) + 0.0 as value from lng")
def _(spark, sf):
    return C.explode_blocks(C.integrate_blocks(B.blocks(spark, sf), 0.04)).withColumn("value", _r("value", 5) + 0.0)


_BAND = (10.0, 30.0, 100.0)


def _cascade(order: int = 6) -> str:
    """The filter in SQL from its band alone: poles of the analog band-pass by complex
    roots, one section a pair, and the recursion sample by sample."""
    lo, hi, fs = _BAND
    states = [f"{s}{k}" for k in range(1, order + 1) for s in ("p", "q")]
    steps, v = [], "x"
    for k in range(1, order + 1):
        gain = "g * " if k == 1 else ""
        steps.append(f"{gain}{v} + p{k} as y{k}, -a[{k}] * y{k} + q{k} as np{k}, -{gain}{v} - b[{k}] * y{k} as nq{k}")
        v = f"y{k}"
    return f"""with recursive {B.BLK}, w as (select 2 * {fs} * tan(pi() * {lo} / {fs}) as w1, 2 * {fs} * tan(pi() * {hi} / {fs}) as w2),
    lp as (select k, cos(pi() * (2 * k + {order} - 1) / {2 * order}) * (w2 - w1) / 2 as re, sin(pi() * (2 * k + {order} - 1) / {2 * order}) * (w2 - w1) / 2 as im, w1 * w2 as mid from w, range(1, {order + 1}) as r(k)),
    z as (select *, re * re - im * im - mid as zr, 2 * re * im as zi from lp), rt as (select *, sqrt((sqrt(zr * zr + zi * zi) + zr) / 2) as rr, (case when zi < 0 then -1 else 1 end) * sqrt((sqrt(zr * zr + zi * zi) - zr) / 2) as ri from z),
    an as (select re + t * rr as ar, im + t * ri as ai from rt, (values (1), (-1)) as v(t)),
    po as (select ((2 * {fs} + ar) * (2 * {fs} - ar) - ai * ai) / (power(2 * {fs} - ar, 2) + ai * ai) as pr, (4 * {fs} * ai) / (power(2 * {fs} - ar, 2) + ai * ai) as pim, power(2 * {fs} - ar, 2) + ai * ai as far from an),
    co as (select list(-2 * pr order by pr * pr + pim * pim) as a, list(pr * pr + pim * pim order by pr * pr + pim * pim) as b, (select exp({order} * ln((w2 - w1) * 2 * {fs})) from w) * exp(-sum(ln(far))) as g from po where pim > 0),
    src as (select channel, list(value order by sample_idx) as xs from lng group by channel),
    rec as (select channel, 0::bigint as i, 0.0::double as y, {", ".join(f"0.0::double as {x}" for x in states)} from src
      union all select channel, i + 1, y{order}, {", ".join("n" + x for x in states)} from (select *, {", ".join(steps)} from (select rec.*, xs[i + 1] as x, a, b, g from rec join src using (channel), co where i < len(xs))))
    select channel, i - 1 as sample_idx, round(y, 5) + 0.0 as value from rec where i > 0"""


@_query("b8_bandpass", _cascade())
def _(spark, sf):
    return C.explode_blocks(signal.bandpass(B.blocks(spark, sf), *_BAND)).withColumn("value", _r("value", 5) + 0.0)


@_query(
    "b11_noise_psd",
    f"""with {B.BLK}, fr as (select channel, block_no, k, j, cast(samples[k * 8 + j + 1] as double) * (0.5 - 0.5 * cos(2 * pi() * j / 15)) as x from blk, range(1, 6) as f(k), range(16) as g(j)),
    w as (select sum(power(0.5 - 0.5 * cos(2 * pi() * j / 15), 2)) as e from range(16) as g(j)),
    sp as (select channel, block_no, k, b, power(sum(x * cos(2 * pi() * b * j / 16)), 2) + power(sum(x * sin(2 * pi() * b * j / 16)), 2) as p from fr, range(9) as h(b) group by all)
    select channel, b * 100.0 / 16 as freq, round(10 * log10(avg(p) / (100.0 * any_value(e))) + 180, 5) as psd_db from sp, w group by channel, b""",
)
def _(spark, sf):
    windows = B.blocks(spark, sf).select("channel", F.col("block_no").alias("packet"), "samples")
    return signal.noise_psd(windows, 100.0, 16, 8).withColumn("psd_db", _r("psd_db", 5))


_POINTS = "pnt as (select channel, event_id as packet, sample_idx as pos from smp where event_type = 'purchase')"


def _points(spark, sf):
    return B.samples(spark, sf).filter("event_type = 'purchase'").select("channel", F.col("event_id").alias("packet"), F.col("sample_idx").alias("at"))


@_query("b12_window_around", f"with {B.SMP}, {_POINTS} select s.channel, packet, sample_idx, sample_idx - pos as rel, value from smp s join pnt p on s.channel = p.channel and sample_idx >= pos - 4 and sample_idx < pos + 4")
def _(spark, sf):
    return C.window_around(B.samples(spark, sf), _points(spark, sf), 4, 4)


TEMPLATE = [0.5, -1.0, 2.0, 0.25]


@_query(
    "c1_matched_filter",
    f"with {B.BLK}, c as (select channel, sample_idx, 0.5 * value - lead(value, 1) over w + 2.0 * lead(value, 2) over w + 0.25 * lead(value, 3) over w as value from lng window w as (partition by channel order by sample_idx)) select channel, sample_idx, round(value, 5) + 0.0 as value from c where value is not null",
)
def _(spark, sf):
    return C.explode_blocks(signal.matched_filter(B.blocks(spark, sf), TEMPLATE)).withColumn("value", _r("value", 5) + 0.0)


@_query("c1_matched_filter_native", QUERIES["c1_matched_filter"][1])
def _(spark, sf):
    return C.explode_blocks(signal.matched_filter_native(B.blocks(spark, sf), TEMPLATE)).withColumn("value", _r("value", 5) + 0.0)


#: Envelope of the correlation in SQL: m holds its values and their largest.
_ENVELOPE = f"""{B.BLK}, c as (select channel, sample_idx, 0.5 * value - lead(value, 1) over w + 2.0 * lead(value, 2) over w + 0.25 * lead(value, 3) over w as value from lng window w as (partition by channel order by sample_idx)),
    x as (select channel, min(sample_idx) as first, list(cast(value as double) order by sample_idx) as v from c where value is not null group by channel),
    k as (select n, list(case when k % n = 0 then 0.0 when n % 2 = 0 then case when k % 2 <> 0 then 2 / tan(pi() * k / n) / n else 0.0 end else (1 / tan(pi() * k / n) - case when k % 2 = 0 then 1 else -1 end / sin(pi() * k / n)) / n end order by k desc) as h
      from (select distinct len(v) as n from x), lateral (select unnest(range(1 - n, n)) as k) group by n),
    n as (select *, unnest(range(1, len(v) + 1)) as i from x),
    e as (select channel, first + i - 1 as sample_idx, sqrt(power(v[i], 2) + power(list_inner_product(v, h[len(v) - i + 1:2 * len(v) - i]), 2)) as value from n join k on k.n = len(v)),
    m as (select *, max(value) over (partition by channel) as m from e)"""


@_query("c2_envelope", f"with {_ENVELOPE} select channel, sample_idx, round(value / case when m > 0 then m else 1 end, 5) as value from m")
def _(spark, sf):
    return C.explode_blocks(signal.envelope(signal.matched_filter(B.blocks(spark, sf), TEMPLATE))).withColumn("value", _r("value", 5))


@_query(
    "c3_local_maxima",
    f"""with {B.SMP}, r as (select *, row_number() over w as i, case when lag(value) over w = value then 0 else 1 end as ch from smp window w as (partition by channel order by sample_idx)),
    g as (select *, sum(ch) over (partition by channel order by sample_idx) as g from r), f as (select channel, g, min(i) as a, max(i) as b, min(value) as v from g group by all),
    t as (select channel, a, b, v, lag(v) over w as p, lead(v) over w as n from f window w as (partition by channel order by g))
    select r.channel, r.sample_idx as peak, r.value as level from t join r on r.channel = t.channel and r.i = (a + b) // 2 where v > p and v > n and v >= 250""",
)
def _(spark, sf):
    return detection.local_maxima(B.samples(spark, sf), 250.0)


def _peaks_sql(height: float, prominence: float, distance: int) -> str:
    """Peaks of a table ser (channel, sample_idx, value): maxima by windows, the greedy
    choice one peak after the other, grounds by comparison with every sample."""
    return f"""r as (select *, row_number() over w as i, case when lag(value) over w = value then 0 else 1 end as ch from ser window w as (partition by channel order by sample_idx)),
    g as (select *, sum(ch) over (partition by channel order by sample_idx) as g from r), f as (select channel, g, min(i) as a, max(i) as b, min(value) as v from g group by all),
    t as (select channel, a, b, v, lag(v) over w as p, lead(v) over w as n from f window w as (partition by channel order by g)),
    mx as (select r.channel, r.sample_idx as peak, r.value as level, row_number() over (partition by r.channel order by r.value desc, r.sample_idx) as rk from t join r on r.channel = t.channel and r.i = (a + b) // 2 where v > p and v > n and v >= {height}),
    rec as (select channel, 0::bigint as rk, []::bigint[] as kept from (select distinct channel from mx)
      union all select rec.channel, mx.rk, case when len(list_filter(kept, lambda k: abs(k - peak) < {distance})) = 0 then list_append(kept, peak) else kept end from rec join mx on mx.channel = rec.channel and mx.rk = rec.rk + 1),
    kp as (select channel, unnest(arg_max(kept, rk)) as peak from rec group by channel), kl as (select kp.channel, peak, level from kp join mx using (channel, peak)),
    ed as (select kl.channel, peak, level, max(case when sample_idx < peak and value > level then sample_idx end) as lo, min(case when sample_idx > peak and value > level then sample_idx end) as hi from kl join ser on ser.channel = kl.channel group by all),
    pk as (select ed.channel, peak, level, level - greatest(min(case when sample_idx <= peak then value end), min(case when sample_idx >= peak then value end)) as prominence
      from ed join ser on ser.channel = ed.channel and sample_idx > coalesce(lo, -1) and sample_idx < coalesce(hi, 9223372036854775807) group by ed.channel, peak, level),
    found as (select * from pk where prominence >= {prominence})"""


@_query("c3_find_peaks", f"with recursive {B.SMP}, ser as (select channel, sample_idx, value from smp), {_peaks_sql(250.0, 100.0, 5)} select channel, peak, level, round(prominence, 6) as prominence from found")
def _(spark, sf):
    return detection.find_peaks(B.samples(spark, sf), 250.0, 100.0, 5).withColumn("prominence", _r("prominence"))


_RUN = "(select min(sample_idx) as first, max(sample_idx) // 64 as n_packets from ser)"


@_query(
    "c6_detect_packets",
    f"""with recursive {_ENVELOPE}, ser as (select channel, sample_idx, value / case when m > 0 then m else 1 end as value from m), {_peaks_sql(0.2, 0.1, 8)},
    tg as (select unnest(range(0, n_packets)) as packet, first from {_RUN})
    select packet, channel, min(peak) as sample_idx from found join tg on abs(peak - (first + packet * 64)) <= 20 group by packet, channel""",
)
def _(spark, sf):
    env = C.explode_blocks(signal.envelope(signal.matched_filter(B.blocks(spark, sf), TEMPLATE)))
    runs = env.agg(F.lit(0).alias("run_id"), F.min("sample_idx").alias("offset"), F.lit(64).alias("period"), F.floor(F.max("sample_idx") / 64).alias("n_packets"))
    return detection.detect_packets(env, runs, 20.0, 0.2, 0.1, 8)


# polylines and geodesy

_FILL = """kn as (select *, {x} as x, case when {known} then {x} end as kx, case when {known} then alt end as kz from {src}),
  br as (select *, last_value(kx ignore nulls) over b as x0, last_value(kz ignore nulls) over b as z0, first_value(kx ignore nulls) over a as x1, first_value(kz ignore nulls) over a as z1 from kn
    window b as (partition by cable_id order by seq rows between unbounded preceding and current row), a as (partition by cable_id order by seq rows between current row and unbounded following))
  select cable_id, seq, round(case when x0 is null then z1 when x1 is null then z0 when x0 = x1 then z0 else z0 + (z1 - z0) * (x - x0) / (x1 - x0) end, 6) as alt from br"""


@_query("e1_fill_alt_by_index", f"with {B.POL}, " + _FILL.format(x="cast(seq + 1 as double)", known="alt is not null and abs(alt) >= 1e-9", src="pol"))
def _(spark, sf):
    return polyline.fill_alt_by_index(B.polylines(spark, sf)).select("cable_id", "seq", _r("alt").alias("alt"))


_FLAT = B.POL + ", lg as (select *, lag(lat) over w as plat, lag(lon) over w as plon from pol window w as (partition by cable_id order by seq)), ds as (select *, sum(coalesce(sqrt(power((lon - plon) * 111320 * cos(radians((lat + plat) / 2)), 2) + power((lat - plat) * 111320, 2)), 0)) over (partition by cable_id order by seq) as d from lg)"


@_query("e2_fill_alt_by_distance", f"with {_FLAT}, " + _FILL.format(x="d", known="seq < 1 or coalesce(alt, 0) <> 0", src="ds"))
def _(spark, sf):
    return polyline.fill_alt_by_distance(B.polylines(spark, sf)).select("cable_id", "seq", _r("alt").alias("alt"))


@_query("e3_chainage", f"with {B.CUM} select cable_id, seq, round(cum, 4) as cum from cum")
def _(spark, sf):
    return polyline.chainage(B.full_lines(spark, sf)).select("cable_id", "seq", _r("cum", 4).alias("cum"))


_XYZ = "(alt + 6378000) * sin(radians(lon)) * cos(radians(lat)) as x, (alt + 6378000) * sin(radians(lat)) as y, (alt + 6378000) * cos(radians(lon)) * cos(radians(lat)) as z"


@_query("e4_gps_distance", f"with {B.LIN}, c as (select cable_id, seq, {_XYZ} from lin), d as (select cable_id, seq, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) as d from c window w as (partition by cable_id order by seq)) select cable_id, seq, round(sum(coalesce(d, 0)) over (partition by cable_id order by seq), 3) as cum from d")
def _(spark, sf):
    return polyline.cumulative_gps_distance(B.full_lines(spark, sf)).select("cable_id", "seq", _r("cum", 3).alias("cum"))


def _near_points(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("cable_id"), F.col("o_orderkey").alias("point_id"), (63.0 + (F.col("o_orderkey") % 613) / 1e5).alias("lat"), (10.0 + (F.col("o_orderkey") % 419) / 1e5).alias("lon"))


@_query(
    "e5_nearest_vertex",
    f"""with {B.LIN}, p as (select o_custkey as cable_id, o_orderkey as point_id, 63.0 + (o_orderkey % 613) / 1e5 as a, 10.0 + (o_orderkey % 419) / 1e5 as o from orders),
    m as (select cable_id, point_id, seq, row_number() over (partition by cable_id, point_id order by sqrt(power((lon - o) * 111320 * cos(radians((a + lat) / 2)), 2) + power((lat - a) * 111320, 2)), seq) as r from p join lin using (cable_id))
    select cable_id, point_id, seq from m where r = 1""",
)
def _(spark, sf):
    return polyline.nearest_vertex(_near_points(spark, sf), polyline.chainage(B.full_lines(spark, sf))).drop("cum")


@_query(
    "e6_sample_polyline",
    f"""with {B.CUM}, sg as (select *, lead(cum) over w as c1, lead(lat) over w as la1, lead(lon) over w as lo1, lead(alt) over w as al1 from cum window w as (partition by cable_id order by seq)),
    s2 as (select * from sg where c1 > cum), sl as (select *, case when lead(seq) over (partition by cable_id order by seq) is null then c1 + 1e-6 else c1 end as ce from s2),
    ln as (select cable_id, max(cum) as len from cum group by cable_id), tg as (select cable_id, channel, greatest(0.0, least(5.0 + channel * 50.0, len)) as s from ln, range(20) as g(channel))
    select tg.cable_id, cast(channel as int) as channel, round(s, 4) as s, round(lat + (la1 - lat) * (s - cum) / (c1 - cum), 8) as lat, round(lon + (lo1 - lon) * (s - cum) / (c1 - cum), 8) as lon, round(alt + (al1 - alt) * (s - cum) / (c1 - cum), 4) as alt
    from tg join sl on tg.cable_id = sl.cable_id and s >= cum and s < ce""",
)
def _(spark, sf):
    line = polyline.chainage(B.full_lines(spark, sf))
    targets = polyline.channel_targets(line.select("cable_id").distinct(), 50.0, 20, 5.0)
    return polyline.sample_polyline(line, targets).select("cable_id", "channel", _r("s", 4).alias("s"), _r("lat", 8).alias("lat"), _r("lon", 8).alias("lon"), _r("alt", 4).alias("alt"))


@_query(
    "e7_interpolate_coordinates",
    f"""with {B.CUM}, c as (select cable_id, cum as d, {_XYZ} from cum), q as (select cable_id, cast(k as int) as point_id, k * 40.0 as d from (select distinct cable_id from cum), range(10) as g(k)),
    lo as (select q.cable_id, point_id, q.d, c.d as d0, x as x0, y as y0, z as z0 from q asof left join c on q.cable_id = c.cable_id and q.d >= c.d),
    hi as (select q.cable_id, point_id, c.d as d1, x as x1, y as y1, z as z1 from q asof left join c on q.cable_id = c.cable_id and q.d <= c.d),
    w as (select *, case when d0 is null then 1.0 when d1 is null or d0 = d1 then 0.0 else (d - d0) / (d1 - d0) end as w from lo join hi using (cable_id, point_id)),
    p as (select cable_id, point_id, d, case when w = 0 then x0 when w = 1 then x1 else x0 + (x1 - x0) * w end as x, case when w = 0 then y0 when w = 1 then y1 else y0 + (y1 - y0) * w end as y, case when w = 0 then z0 when w = 1 then z1 else z0 + (z1 - z0) * w end as z from w)
    select cable_id, point_id, d, round(degrees(asin(y / sqrt(x * x + y * y + z * z))), 7) as lat, round(degrees(atan2(x, z)), 7) as lon, round(sqrt(x * x + y * y + z * z) - 6378000, 3) + 0.0 as alt from p""",
)
def _(spark, sf):
    line = polyline.chainage(B.full_lines(spark, sf)).withColumnRenamed("cum", "d")
    q = polyline.channel_targets(line.select("cable_id").distinct(), 40.0, 10).withColumnsRenamed({"s": "d", "channel": "point_id"})
    return polyline.interpolate_coordinates(q, line).select("cable_id", "point_id", "d", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), (_r("alt", 3) + 0.0).alias("alt"))


@_query("e8_lead_in_remap", "with c as (select distinct cast(l_suppkey as bigint) as channel from lineitem), h as (select channel as k, channel * 1.5 as lat from c), n as (select max(channel) - min(channel) + 1 as n from c) select channel, lat from (select channel, greatest(channel - 3, 0) as k from c, n where channel < n - 2) join h using (k)")
def _(spark, sf):
    c = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel")).distinct().withColumn("lat", F.col("channel") * 1.5)
    return polyline.lead_in_remap(c, 2)


@_query("e9_tidal_offset", f"with {B.POL} select cable_id, seq, round(case when alt <> 0 then alt - 0.975 else alt end, 4) as alt from pol")
def _(spark, sf):
    return B.polylines(spark, sf).select("cable_id", "seq", _r(polyline.tidal_offset(F.col("alt")), 4).alias("alt"))


@_query("e10_decimate_polyline", f"with {B.POL} select cable_id, seq from pol where seq % 5 = 0 or seq = (select max(seq) from pol q where q.cable_id = pol.cable_id)")
def _(spark, sf):
    return polyline.decimate_polyline(B.polylines(spark, sf)).select("cable_id", "seq")


@_query("e11_spacing_check", f"with {B.LIN}, n as (select *, lead(lat) over w as nlat, lead(lon) over w as nlon, lead(alt) over w as nalt from lin window w as (partition by cable_id order by seq)) select cable_id, seq, round(" + B.DIST.format(p="n") + ", 4) as spacing from n where nlat is not null")
def _(spark, sf):
    return polyline.spacing_check(B.full_lines(spark, sf), "seq").withColumn("spacing", _r("spacing", 4))


@_query("e12_to_cartesian", f"with {B.LIN} select cable_id, seq, round(x, 2) as x, round(y, 2) as y, round(z, 2) as z from (select cable_id, seq, {_XYZ} from lin)")
def _(spark, sf):
    x, y, z = geo.to_cartesian(F.col("lat"), F.col("lon"), F.col("alt"))
    return B.full_lines(spark, sf).select("cable_id", "seq", _r(x, 2).alias("x"), _r(y, 2).alias("y"), _r(z, 2).alias("z"))


@_query("e12_to_gps", f"with {B.LIN} select cable_id, seq, round(lat, 7) as lat, round(lon, 7) as lon, round(alt, 3) as alt from lin")
def _(spark, sf):
    gps = geo.to_gps(*geo.to_cartesian(F.col("lat"), F.col("lon"), F.col("alt")))
    return B.full_lines(spark, sf).select("cable_id", "seq", *[_r(c, d).alias(n) for c, d, n in zip(gps, (7, 7, 3), ("lat", "lon", "alt"))])


_ECEF = "(6378137.0 / sqrt(1 - e2 * power(sin(radians({a})), 2)) + {h}) * cos(radians({a})) * cos(radians({o})) as x{s}, (6378137.0 / sqrt(1 - e2 * power(sin(radians({a})), 2)) + {h}) * cos(radians({a})) * sin(radians({o})) as y{s}, (6378137.0 / sqrt(1 - e2 * power(sin(radians({a})), 2)) * (1 - e2) + {h}) * sin(radians({a})) as z{s}"


@_query(
    "e13_geodetic_to_enu",
    f"""with {B.LIN}, k as (select *, (1 / 298.257223563) * (2 - 1 / 298.257223563) as e2 from lin),
    p as (select cable_id, seq, {_ECEF.format(a="lat", o="lon", h="alt", s="")}, {_ECEF.format(a="63.005", o="10.004", h="0.0", s="0")} from k), d as (select cable_id, seq, x - x0 as dx, y - y0 as dy, z - z0 as dz, radians(63.005) as la, radians(10.004) as lo from p)
    select cable_id, seq, round(-sin(lo) * dx + cos(lo) * dy, 4) + 0.0 as e, round(cos(la) * dz - sin(la) * (cos(lo) * dx + sin(lo) * dy), 4) + 0.0 as n, round(cos(la) * (cos(lo) * dx + sin(lo) * dy) + sin(la) * dz, 4) + 0.0 as u from d""",
)
def _(spark, sf):
    o = geo.Origin(F.lit(63.005), F.lit(10.004), F.lit(0.0))
    enu = geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), o)
    return B.full_lines(spark, sf).select("cable_id", "seq", *[_r(c, 4).alias(n) for c, n in zip(enu, "enu")])


@_query("e13_enu_to_geodetic", f"with {B.LIN} select cable_id, seq, round(lat, 7) as lat, round(lon, 7) as lon, round(alt, 3) as alt from lin")
def _(spark, sf):
    o = geo.Origin(F.lit(63.005), F.lit(10.004), F.lit(0.0))
    back = geo.enu_to_geodetic(*geo.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), o), o)
    return B.full_lines(spark, sf).select("cable_id", "seq", *[_r(c, d).alias(n) for c, d, n in zip(back, (7, 7, 3), ("lat", "lon", "alt"))])


@_query("e14_distance_equirect", f"with {B.LIN}, q as (select *, 63.005 as qlat, 10.004 as qlon, 0.0 as qalt from lin) select cable_id, seq, round(" + B.DIST.format(p="q") + ", 4) as d from q")
def _(spark, sf):
    d = geo.distance_equirect(F.lit(63.005), F.lit(10.004), F.col("lat"), F.col("lon"), F.lit(0.0), F.col("alt"))
    return B.full_lines(spark, sf).select("cable_id", "seq", _r(d, 4).alias("d"))


@_query(
    "e15_range_and_grazing",
    f"""with {B.LIN}, l as (select cable_id, seq, lat * 1000 as x, lon * 1000 as y, alt as z from lin),
    d as (select *, coalesce(x - lag(x) over w, lead(x) over w - x) as dx, coalesce(y - lag(y) over w, lead(y) over w - y) as dy, coalesce(z - lag(z) over w, lead(z) over w - z) as dz from l window w as (partition by cable_id order by seq)),
    m as (select *, sum(dx) over w / 5 as mx, sum(dy) over w / 5 as my, sum(dz) over w / 5 as mz from d window w as (partition by cable_id order by seq rows between 4 preceding and current row)),
    s as (select o_custkey as cable_id, o_orderkey as source_id, o_orderkey % 90 + 62950.0 as sx, o_orderkey % 70 + 9990.0 as sy, 30.0 as sz from orders),
    j as (select *, sqrt(power(x - sx, 2) + power(y - sy, 2) + power(z - sz, 2)) as r, sqrt(mx * mx + my * my + mz * mz) as l from s join m using (cable_id) where mx is not null)
    select cable_id, source_id, count(*) as n, round(min(r), 4) as range_m, round(max(case when l > 1e-9 then ((x - sx) * mx + (y - sy) * my + (z - sz) * mz) / l / r end), 6) + 0.0 as cos_grazing from j group by all""",
)
def _(spark, sf):
    line = B.full_lines(spark, sf).select("cable_id", "seq", (F.col("lat") * 1000).alias("x"), (F.col("lon") * 1000).alias("y"), F.col("alt").alias("z"))
    many = line.groupBy("cable_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    k = F.col("o_orderkey")
    src = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("cable_id"), k.alias("source_id"), (k % 90 + 62950.0).alias("x"), (k % 70 + 9990.0).alias("y"), F.lit(30.0).alias("z"))
    return polyline.range_and_grazing(src, line.join(many, "cable_id", "left_semi")).groupBy("cable_id", "source_id").agg(F.count("*").alias("n"), _r(F.min("range_m"), 4).alias("range_m"), (_r(F.max(F.when(~F.isnan("cos_grazing"), F.col("cos_grazing")))) + 0.0).alias("cos_grazing"))


@_query("e16_bearing_segment", f"with {B.LIN}, s as (select *, seq * 7.0 as b from lin) select cable_id, seq, round(lat - 50 * cos(radians(b)) / 111320, 8) as lat0, round(lon - 50 * sin(radians(b)) / (111320 * cos(radians(lat))), 8) as lon0, round(lat + 50 * cos(radians(b)) / 111320, 8) as lat1, round(lon + 50 * sin(radians(b)) / (111320 * cos(radians(lat))), 8) as lon1 from s")
def _(spark, sf):
    ends = geo.bearing_segment(F.col("lat"), F.col("lon"), F.col("seq") * 7.0, 100.0)
    return B.full_lines(spark, sf).select("cable_id", "seq", *[_r(c, 8).alias(n) for c, n in zip(ends, ("lat0", "lon0", "lat1", "lon1"))])


@_query("e17_tx_times", "select o_orderkey as run_id, k as packet, strftime(o_orderdate + to_microseconds(cast(round(k * 562500 / 25000.0 * 1e6) as bigint)), '%Y-%m-%d %H:%M:%S.%f') as ts, o_custkey + k * 562500 as sample_idx from (select *, unnest(range(0, 4)) as k from orders)")
def _(spark, sf):
    runs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("seq_start_ts"), F.col("o_custkey").alias("offset"), F.lit(562500).alias("period"), F.lit(25000.0).alias("fs"), F.lit(4).alias("n_packets"))
    return polyline.tx_times(runs).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_RUNS = "runs as (select user_id as run_id, min(ts) as a, min(ts) + interval 5400 second as b from events group by user_id)"


@_query("e18_run_window", f"with {_RUNS} select run_id, event_id from events join runs on ts >= a - interval 180 second and ts <= b + interval 180 second")
def _(spark, sf):
    e = B.table(spark, sf, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("start_ts"), (F.min("ts") + F.expr("interval 5400 seconds")).alias("stop_ts"))
    return polyline.run_window(e.select("event_id", "ts"), runs).select("run_id", "event_id")


_FIX = "ev as (select user_id, event_id, event_type, epoch_us(ts) / 1e6 as t, value from events), fx as (select user_id, t, max(63 + value / 1e4) as lat, max(10 + value / 2e4) as lon from ev where event_type = 'purchase' group by all), qs as (select user_id, event_id, t from ev where event_type = 'view')"
_BOTH = _FIX + """, lo as (select q.user_id, q.event_id, q.t, f.t as t0, f.lat as la0, f.lon as lo0 from qs q asof left join fx f on q.user_id = f.user_id and q.t >= f.t),
  hi as (select q.event_id, f.t as t1, f.lat as la1, f.lon as lo1 from qs q asof left join fx f on q.user_id = f.user_id and q.t <= f.t), bt as (select * from lo join hi using (event_id))"""


def _fixes(spark, sf):
    e = B.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    fixes = e.filter("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max(63 + F.col("value") / 1e4).alias("lat"), F.max(10 + F.col("value") / 2e4).alias("lon"))
    return e.filter("event_type = 'view'").select("user_id", "event_id", "t"), fixes


@_query("e19_interp_positions", f"with {_BOTH} select user_id, event_id, round(case when t1 = t0 then la0 else la0 + (la1 - la0) * (t - t0) / (t1 - t0) end, 6) as lat, round(case when t1 = t0 then lo0 else lo0 + (lo1 - lo0) * (t - t0) / (t1 - t0) end, 6) as lon from bt where t0 is not null and t1 is not null")
def _(spark, sf):
    q, f = _fixes(spark, sf)
    return polyline.interp_positions(q, f, ("user_id",)).select("user_id", "event_id", _r("lat").alias("lat"), _r("lon").alias("lon"))


_TXYZ = "(30.0 + 6378000) * sin(radians({o})) * cos(radians({a})) as x{s}, (30.0 + 6378000) * sin(radians({a})) as y{s}, (30.0 + 6378000) * cos(radians({o})) * cos(radians({a})) as z{s}"


@_query(
    "e20_tx_locations",
    f"""with {_BOTH}, c as (select user_id, event_id, t, t0, t1, {_TXYZ.format(o="lo0", a="la0", s="0")}, {_TXYZ.format(o="lo1", a="la1", s="1")} from bt where t0 is not null or t1 is not null),
    w as (select *, case when t0 is null then 1.0 when t1 is null or t1 = t0 then 0.0 else (t - t0) / (t1 - t0) end as w from c),
    p as (select user_id, event_id, case when w = 0 then x0 when w = 1 then x1 else x0 + (x1 - x0) * w end as x, case when w = 0 then y0 when w = 1 then y1 else y0 + (y1 - y0) * w end as y, case when w = 0 then z0 when w = 1 then z1 else z0 + (z1 - z0) * w end as z from w)
    select user_id, event_id, round(degrees(asin(y / sqrt(x * x + y * y + z * z))), 5) as lat, round(degrees(atan2(x, z)), 5) as lon, round(sqrt(x * x + y * y + z * z) - 6378000, 3) as alt from p""",
)
def _(spark, sf):
    q, f = _fixes(spark, sf)
    out = polyline.tx_locations(q, f, 30.0, ("user_id",)).filter("lat is not null")
    return out.select("user_id", "event_id", _r("lat", 5).alias("lat"), _r("lon", 5).alias("lon"), _r("alt", 3).alias("alt"))


_SEG = "sg as (select l_suppkey * 10 as receiver_min, l_suppkey * 10 + 7 as receiver_max, min(l_quantity) as q, max(l_discount) * 1000 as d from lineitem group by l_suppkey)"


def _segments(spark, sf):
    g = B.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("q"), (F.max("l_discount") * 1000).alias("d"))
    s = F.col("l_suppkey")
    return g.select((s * 10).alias("receiver_min"), (s * 10 + 7).alias("receiver_max"), (s % 4 != 3).alias("success"), F.when(s % 2 == 0, F.col("d") * 3).alias("theta_deg_continuous"), F.when(s % 3 == 0, F.col("d") * 2).alias("theta_deg_norm"), (F.col("q") * 20.0).alias("theta_deg"))


@_query(
    "e21_interp_segment_angles",
    f"""with {_SEG}, a as (select (receiver_min + receiver_max) / 2.0 as x, coalesce(case when (receiver_min // 10) % 2 = 0 then d * 3 end, case when (receiver_min // 10) % 3 = 0 then d * 2 end, q * 20.0) as r from sg where (receiver_min // 10) % 4 <> 3),
    k as (select x, r + 180.0 - 360.0 * floor((r + 180.0) / 360.0) - 180.0 as th from a), c as (select distinct l_suppkey * 10 + l_linenumber as channel from lineitem),
    l as (select channel, k.x as x0, k.th as t0 from c asof left join k on c.channel >= k.x), h as (select channel, k.x as x1, k.th as t1 from c asof left join k on c.channel <= k.x)
    select channel, round(case when x0 is null then t1 when x1 is null or x0 = x1 then t0 else t0 + (t1 - t0) * (channel - x0) / (x1 - x0) end, 6) + 0.0 as theta from l join h using (channel)""",
)
def _(spark, sf):
    c = B.table(spark, sf, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("channel")).distinct()
    return polyline.interp_segment_angles(_segments(spark, sf), c).select("channel", (_r("theta") + 0.0).alias("theta"))


@_query(
    "e22_redraw_polyline",
    f"""with {B.LIN}, p as (select cable_id, seq as channel, (lon - 10) * 1e5 as e, (lat - 63) * 1e5 as n from lin), q as (select *, e - lag(e) over w as le, n - lag(n) over w as ln from p window w as (partition by cable_id order by channel)),
    t as (select *, channel between 2 and 8 and le is not null as tn from q), m as (select *, case when tn then sqrt(le * le + ln * ln) * cos(radians(channel * 11.0)) else 0 end as me, case when tn then sqrt(le * le + ln * ln) * sin(radians(channel * 11.0)) else 0 end as mn from t),
    s as (select *, sum(me) over w as se, sum(mn) over w as sn from m window w as (partition by cable_id order by channel)),
    b as (select *, last_value(case when not tn then e - se end ignore nulls) over w as be, last_value(case when not tn then n - sn end ignore nulls) over w as bn from s window w as (partition by cable_id order by channel))
    select cable_id, channel, round(case when tn then be + se else e end, 3) + 0.0 as e, round(case when tn then bn + sn else n end, 3) + 0.0 as n from b""",
)
def _(spark, sf):
    p = B.full_lines(spark, sf).select("cable_id", F.col("seq").alias("channel"), ((F.col("lon") - 10) * 1e5).alias("e"), ((F.col("lat") - 63) * 1e5).alias("n"))
    angles = p.select("channel").distinct().withColumn("theta", F.col("channel") * 11.0)
    return polyline.redraw_polyline(p, angles, 2, 8).select("cable_id", "channel", (_r("e", 3) + 0.0).alias("e"), (_r("n", 3) + 0.0).alias("n"))


@_query(
    "e23_continuous_angles",
    "with a as (select l_orderkey as k, l_linenumber as c, min(l_quantity) * 11.0 as th from lineitem group by all), j as (select *, th - lag(th) over w + 90.0 as j from a window w as (partition by k order by c)), d as (select *, coalesce(j - 180.0 * floor(j / 180.0) - 90.0, th) as d from j) select k, c, round(sum(d) over (partition by k order by c), 6) as theta_cont from d",
)
def _(spark, sf):
    a = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c")).agg((F.min("l_quantity") * 11.0).alias("theta"))
    return polyline.continuous_angles(a, "k", "c").select("k", "c", _r("theta_cont").alias("theta_cont"))


@_query("a4_polyline_features", f"with {B.CUM} select cable_id, 'LineString' as kind, count(*) as n, round(max(cum), 4) as length, round(sum(lon * (seq + 1)), 5) as lons, round(sum(lat * (seq + 1)), 5) as lats, round(sum(alt * (seq + 1)), 4) + 0.0 as alts from cum group by cable_id")
def _(spark, sf):
    made = tables.polyline_features(polyline.chainage(B.full_lines(spark, sf)))
    back = made.select("cable_id", F.from_json("json", "type string, properties struct<length:double>, geometry struct<type:string,coordinates:array<array<double>>>").alias("x"))
    total = lambda k: F.aggregate(F.transform("x.geometry.coordinates", lambda p, i: p[k] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return back.select("cable_id", F.col("x.geometry.type").alias("kind"), F.size("x.geometry.coordinates").cast("long").alias("n"), _r("x.properties.length", 4).alias("length"), _r(total(0), 5).alias("lons"), _r(total(1), 5).alias("lats"), (_r(total(2), 4) + 0.0).alias("alts"))


@_query("a15_export_features", "select o_orderkey as packet, '{\"type\":\"Feature\",\"properties\":{\"kind\":\"tx\",\"label\":\"' || o_orderkey || '\"},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || o_custkey || ',' || o_custkey + 1 || ']}}' as json from (select *, row_number() over (order by o_orderkey) - 1 as i from orders) where i % 3 = 0")
def _(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("packet"), F.col("o_custkey").alias("lon"), (F.col("o_custkey") + 1).alias("lat"))
    return tables.export_features(o, "tx", 3)


# decoding


def _hop(df):
    """Slots 0..12 of 32 chips, by rule."""
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("chip")).distinct().withColumn("slot", (F.col("chip") * 7 + 3) % 13)


_HOP = "hop as (select k as chip, (k * 7 + 3) % 13 as slot from range(32) as g(k)), pat as (select a.chip, a.slot, b.slot as noise from hop a join hop b on a.chip = (b.chip + 6) % 32 where a.chip <> 0)"
_BINS = "bin as (select l_suppkey as channel, l_partkey as packet, l_orderkey % 32 as chip, l_linenumber * 3 % 26 as bin, sum(l_quantity) as re, sum(l_discount) as im from lineitem group by all)"


def _bins(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("channel"), F.col("l_partkey").alias("packet"), (F.col("l_orderkey") % 32).cast("int").alias("chip"), (F.col("l_linenumber") * 3 % 26).cast("int").alias("bin")).agg(F.sum("l_quantity").alias("re"), F.sum("l_discount").alias("im"))


def _some(spark, sf):
    return B.table(spark, sf, "region").limit(1)


@_query("h2_extract_receptions", f"with {B.SMP}, {_POINTS}, g as (select channel, packet, pos, k from pnt, range(6) as r(k)) select g.channel, packet, cast(k as int) as k, coalesce(value, 0.0) as value from g left join smp on smp.channel = g.channel and sample_idx = pos + k")
def _(spark, sf):
    arr = _points(spark, sf).withColumnRenamed("at", "sample_idx")
    cut = packets.extract_receptions(B.samples(spark, sf), arr, 6)
    return cut.select("channel", "packet", F.posexplode("samples").alias("k", "value"))


@_query(
    "h3_chip_dft",
    f"""with {B.BLK}, c as (select channel, block_no as packet, (sample_idx % 64) // 16 as chip, (sample_idx % 64) % 16 as i, value from lng)
    select channel, packet, cast(chip as int) as chip, cast(b as int) as bin, round(sum(value * cos(2 * pi() * (2.0 + b) * i / 16)), 5) + 0.0 as re, round(sum(value * sin(2 * pi() * (2.0 + b) * i / 16)), 5) + 0.0 as im from c, range(4) as g(b) group by all""",
)
def _(spark, sf):
    rec = B.blocks(spark, sf).select("channel", F.col("block_no").alias("packet"), "samples")
    return packets.chip_dft(rec, 16.0, 2.0, 1.0, 4, 4).select("channel", "packet", "chip", "bin", (_r("re", 5) + 0.0).alias("re"), (_r("im", 5) + 0.0).alias("im"))


_SNR = f"{_HOP}, {_BINS}, pw as (select channel, packet, sum(case when bin // 2 = slot then re * re + im * im end) as s, sum(case when bin // 2 = noise then re * re + im * im end) as z from bin join pat using (chip) group by all), snr as (select channel, packet, case when s > 0 and z > 0 then 10 * log10(s / z) end as snr_db, sqrt(z) as noise_rms from pw)"


@_query("h4_reception_snr", f"with {_SNR} select channel, packet, round(snr_db, 6) as snr_db, round(noise_rms, 6) as noise_rms from snr")
def _(spark, sf):
    out = packets.reception_snr(_bins(spark, sf), _hop(_some(spark, sf)))
    return out.select("channel", "packet", _r("snr_db").alias("snr_db"), _r("noise_rms").alias("noise_rms"))


@_query("h5_stack_receptions", f"with {_SNR} select packet, chip, bin, round(sum(sqrt(re * re + im * im) / noise_rms), 6) as level from bin join snr using (channel, packet) where snr_db >= 3 and noise_rms > 0 group by all")
def _(spark, sf):
    b = _bins(spark, sf)
    return packets.stack_receptions(b, packets.reception_snr(b, _hop(_some(spark, sf)))).withColumn("level", _r("level"))


@_query("h6_hop_bits", f"with {_HOP}, {_BINS} select channel, packet, chip, cast(arg_max(bin % 2, row(re * re + im * im, -bin)) as int) as bit from bin join hop using (chip) where bin // 2 = slot group by all")
def _(spark, sf):
    return packets.hop_bits(_bins(spark, sf), _hop(_some(spark, sf)))


_BITS = "bt as (select l_orderkey as packet, cast(l_linenumber - 1 as int) as chip, min(cast(l_quantity as int)) % 2 as bit from lineitem group by all)"


def _packet_bits(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("packet"), (F.col("l_linenumber") - 1).cast("int").alias("chip")).agg((F.min(F.col("l_quantity").cast("int")) % 2).alias("bit"))


@_query("h7_deinterleave", f"with {_BITS} select packet, string_agg(bit, '' order by ((chip - 2) * 3) % 5) as bits from bt where chip >= 2 group by packet")
def _(spark, sf):
    return packets.deinterleave(_packet_bits(spark, sf), ("packet",), 5, 3, 2).select("packet", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


@_query("h8_convolutional_decode", None)
def _(spark, sf):
    bits = _packet_bits(spark, sf).groupBy("packet").agg(F.transform(F.array_sort(F.collect_list(F.struct("chip", "bit"))), lambda x: x["bit"]).alias("bits"))
    coded = bits.select("packet", F.flatten(F.array_repeat("bits", 144)).alias("bits")).withColumn("bits", F.slice("bits", 1, 144))
    return packets.convolutional_decode(coded, ("packet",))


def _sixty_four(spark, sf):
    """64 bits a packet from the order's key and customer."""
    o = B.table(spark, sf, "orders")
    bit = lambda c, n: F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda k: F.pmod(F.floor(c / F.pow(F.lit(2.0), k)), F.lit(2)).cast("int"))
    return o.select(F.col("o_orderkey").alias("packet"), F.concat(bit(F.col("o_orderkey"), 32), bit(F.col("o_custkey"), 32)).alias("bits"))


_CRC = "select *, (o_orderkey << 32) | o_custkey as v from orders"


@_query(
    "h9_crc8",
    """with recursive b as (select o_orderkey as packet, o_orderkey as hi, o_custkey >> 8 as lo from orders),
    r(packet, hi, lo, k, c) as (select packet, hi, lo, 0, 0 from b union all select packet, hi, lo, k + 1, case when xor((c >> 7) & 1, bit) = 1 then xor((c * 2) & 255, 7) else (c * 2) & 255 end
      from (select *, case when k < 32 then (hi >> (31 - k)) & 1 else (lo >> (55 - k)) & 1 end as bit from r) where k < 56)
    select packet, cast(c as int) as crc from r where k = 56""",
)
def _(spark, sf):
    return _sixty_four(spark, sf).select("packet", packets.crc8(F.slice("bits", 1, 56)).alias("crc"))


@_query(
    "h10_unpack_fields",
    "select o_orderkey as packet, cast((o_orderkey >> 28) & 15 as int) as version, cast((o_orderkey >> 16) & 255 as int) as classUserID, cast((o_orderkey >> 10) & 63 as int) as appType, ((o_orderkey & 1023) << 24) | (o_custkey >> 8) as appData, cast(o_custkey & 255 as int) as crc8 from orders",
)
def _(spark, sf):
    return packets.unpack_fields(_sixty_four(spark, sf), ("packet",)).select("packet", "version", "classUserID", "appType", "appData", "crc8")


@_query("h11_bpsk", f"select l_orderkey as k, l_linenumber as line, l_partkey as p, cast(abs(m - pi()) > pi() / 2 as int) as bit from (select *, atan2(l_tax - 0.04, l_discount - 0.05) + pi() - 0.3 - 2 * pi() * floor((atan2(l_tax - 0.04, l_discount - 0.05) + pi() - 0.3) / (2 * pi())) as m from lineitem)")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), scalars.bpsk_slice(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, 0.3).alias("bit"))


# sensitivity


@_query(
    "i1_lookup_interp",
    "with t as (select l_quantity * 10 as x, min(l_tax) as y from lineitem group by all), q as (select o_orderkey as k, cast(o_custkey * 1.7 as double) as x from orders), l as (select k, q.x, t.x as x0, t.y as y0 from q asof left join t on q.x >= t.x), h as (select k, t.x as x1, t.y as y1 from q asof left join t on q.x <= t.x) select k, round(case when x0 is null then y1 when x1 is null or x0 = x1 then y0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0) end, 8) as y from l join h using (k)",
)
def _(spark, sf):
    t = B.table(spark, sf, "lineitem").groupBy((F.col("l_quantity") * 10).alias("x")).agg(F.min("l_tax").alias("y"))
    q = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 1.7).alias("x"))
    return sensitivity.lookup_interp(q, t).select("k", _r("y", 8).alias("y"))


@_query("i2_transmission_loss", "select l_orderkey as k, l_linenumber as line, l_partkey as p, round(20.0 * log10(l_extendedprice), 6) as loss_db from lineitem")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), _r(scalars.transmission_loss(F.col("l_extendedprice"))).alias("loss_db"))


@_query(
    "i3_cross_spectrum",
    f"""with {B.BLK}, y as (select channel, block_no as packet, j, (0.5 * cast(samples[j + 1] as double) - cast(samples[j + 2] as double) + 2.0 * cast(samples[j + 3] as double) + 0.25 * cast(samples[j + 4] as double)) * sqrt(2) / 2 * (0.5 - 0.5 * cos(2 * pi() * j / 60)) as y from blk, range(61) as g(j))
    select channel, packet, round(k * 100.0 / 61, 6) as freq, round(sum(y * cos(2 * pi() * j * k / 61)) / 4 / 100, 8) + 0.0 as re, round(-sum(y * sin(2 * pi() * j * k / 61)) / 4 / 100, 8) + 0.0 as im from y, range(31) as h(k) group by channel, packet, k""",
)
def _(spark, sf):
    rec = B.blocks(spark, sf).select("channel", F.col("block_no").alias("packet"), "samples")
    return sensitivity.cross_spectrum(rec, TEMPLATE, 100.0).select("channel", "packet", _r("freq").alias("freq"), (_r("re", 8) + 0.0).alias("re"), (_r("im", 8) + 0.0).alias("im"))


@_query(
    "i4_sensitivity_db",
    f"""with s as (select l_suppkey as channel, l_orderkey as packet, l_linenumber * 100.0 as freq, sum(l_quantity) as re, sum(l_tax) as im from lineitem group by all),
    f as (select distinct freq, freq / 10 as psd, freq / 50 as tx from s), l as (select distinct channel, packet, channel + packet % 7 as loss from s)
    select channel, packet, freq, round(10 * log10(re * re + im * im) - (psd + tx - loss), 6) as sens_db from s join f using (freq) join l using (channel, packet)""",
)
def _(spark, sf):
    s = B.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("packet"), (F.col("l_linenumber") * 100.0).alias("freq")).agg(F.sum("l_quantity").alias("re"), F.sum("l_tax").alias("im"))
    f = s.select("freq").distinct()
    loss = s.select("channel", "packet", (F.col("channel") + F.col("packet") % 7).alias("loss_db")).distinct()
    return sensitivity.sensitivity_db(s, f.withColumn("db", F.col("freq") / 10), f.withColumn("db", F.col("freq") / 50), loss).withColumn("sens_db", _r("sens_db"))


@_query(
    "i5_binned_sensitivity",
    """with v as (select l_suppkey as channel, l_orderkey as packet, l_extendedprice as freq, l_quantity as sens, l_tax * 100 as snr, (l_orderkey * 13 + l_suppkey) % 90 as angle from lineitem),
    b as (select cast(k as int) as bin_no, k * 2000.0 as lo, k * 2000.0 + 2000.0 as hi from range(10) as g(k)), p as (select bin_no, channel, packet, avg(sens) as sens, min(angle) as angle from v join b on freq >= lo and freq < hi where snr >= 3 group by all), a as (select k * 5.0 as angle from range(18) as g(k))
    select bin_no, a.angle, count(*) as n, round(20 * log10(sum((0.5 + 0.5 * cos(pi() * (p.angle - a.angle) / 2)) * power(10, sens / 20)) / sum(0.5 + 0.5 * cos(pi() * (p.angle - a.angle) / 2))), 5) as mean, round(stddev_samp(sens), 6) as std, round(quantile_cont(sens, 0.5), 6) as median, round(quantile_cont(sens, 0.25), 6) as q1 from p join a on abs(p.angle - a.angle) < 2 group by all having count(*) > 1""",
)
def _(spark, sf):
    v = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("packet"), F.col("l_extendedprice").alias("freq"), F.col("l_quantity").alias("sens_db"), (F.col("l_tax") * 100).alias("snr"), ((F.col("l_orderkey") * 13 + F.col("l_suppkey")) % 90).alias("angle_deg"))
    some = _some(spark, sf)
    bins = some.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin_no")).select("bin_no", (F.col("bin_no") * 2000.0).alias("lo"), (F.col("bin_no") * 2000.0 + 2000.0).alias("hi"))
    angles = some.select(F.explode(F.sequence(F.lit(0), F.lit(17))).alias("a")).select((F.col("a") * 5.0).alias("angle"))
    out = sensitivity.binned_sensitivity(v, bins, angles, ["mean", "std", "median", "q1"]).filter("n > 1")
    return out.select("bin_no", "angle", "n", _r("mean", 5).alias("mean"), *[_r(c).alias(c) for c in ("std", "median", "q1")])


_KERNEL = "p as (select o_custkey * 1.0 as xp, case when o_orderkey % 9 <> 0 then o_totalprice / 997 end as fp from orders), q as (select event_id as qid, value / 3 as x from events)"


def _kernel(spark, sf):
    p = B.table(spark, sf, "orders").select((F.col("o_custkey") * 1.0).alias("xp"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 997).alias("fp"))
    return B.table(spark, sf, "events").select(F.col("event_id").alias("qid"), (F.col("value") / 3).alias("x")), p


@_query("i6_kernel_mean", f"with {_KERNEL}, m as (select qid, avg(coalesce(fp, 0)) as m from q join p on abs(x - xp) < 2 group by qid) select qid, round(x, 6) as x, round(m, 6) as mean from q left join m using (qid)")
def _(spark, sf):
    return sensitivity.kernel_mean(*_kernel(spark, sf), 2.0).select("qid", _r("x").alias("x"), _r("mean").alias("mean"))


@_query("i7_hann_kernel_mean", f"with {_KERNEL}, m as (select qid, sum((0.5 + 0.5 * cos(pi() * (xp - x) / 2)) * coalesce(fp, 0)) / sum(0.5 + 0.5 * cos(pi() * (xp - x) / 2)) as m from q join p on abs(x - xp) < 2 group by qid) select qid, round(x, 6) as x, round(m, 5) as mean from q left join m using (qid)")
def _(spark, sf):
    return sensitivity.kernel_mean(*_kernel(spark, sf), 2.0, scalars.hann_kernel).select("qid", _r("x").alias("x"), _r("mean", 5).alias("mean"))


@_query("i8_modelled_strain", "with s as (select event_id, abs((0.7 + 0.4 * 0.2) * power(cos(radians(value / 2.5)), 2) - 0.02 * power(sin(radians(value / 2.5)), 2)) as s from events) select event_id, case when s > 0 then round(120.0 + 60 - 20 * log10(2.25e9) + 20 * log10(s), 4) end as strain_db from s")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", _r(scalars.modelled_strain_db(F.col("value") / 2.5, F.lit(120.0)), 4).alias("strain_db"))


@_query(
    "i9_modelled_gain",
    "with w as (select event_id, 700.0 * cos(radians(value / 2.5)) / 1500.0 as k from events), g as (select event_id, abs(k * 1.02) as e, k * 1.02 / 2 as x from w) select event_id, round(case when e > 0.45 then 0.0 when e < 0.4 then 1.0 else 0.5 + 0.5 * cos(pi() * (e - 0.4) / 0.05) end * case when abs(x) < 1e-12 then 1.0 else power(sin(pi() * x) / (pi() * x), 2) end, 7) as gain from g",
)
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", _r(scalars.modelled_gain(F.col("value") / 2.5, F.lit(700.0)), 7).alias("gain"))


# scalars


@_query("j1_time_list", "select o_orderkey as k, strftime(timestamp '2020-01-01' + to_seconds(o_custkey * 10), '%H%M%S') as hhmmss from orders")
def _(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_custkey") * 10) % 86400).alias("second"))
    return o.join(F.broadcast(scalars.time_list(spark, "000000", "240000", 10)), "second").select("k", "hhmmss")


@_query("j2_seconds_of_day", "select event_id, round((epoch_us(ts) % 86400000000) / 1e6, 6) as s from events")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", _r(scalars.seconds_of_day(F.col("ts").cast("timestamp"))).alias("s"))


@_query("j3_parse_ts", "select event_id, strftime(case when event_id % 4 = 3 then null when event_id % 4 = 1 then timestamp '1970-01-01' + (date_trunc('second', ts) - date_trunc('day', ts)) when event_id % 4 = 0 then date_trunc('second', ts) else ts end, '%Y-%m-%d %H:%M:%S.%f') as t from events")
def _(spark, sf):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(ts, "yyyyMMdd HHmmss")).when(k == 1, F.date_format(ts, "HHmmss")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.lit("at noon"))
    return B.table(spark, sf, "events").select("event_id", F.date_format(scalars.parse_ts(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))


@_query("j4_strip_trailing", "select o_orderkey as k, rtrim(cast(o_custkey * 100 as varchar), '0') as s from orders")
def _(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), scalars.strip_trailing((F.col("o_custkey") * 100).cast("string"), "0").alias("s"))


@_query("j6_json_path", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", scalars.json_path(F.col("props"), "k").alias("k"))


# streams


def _run_stream(spark, stream, mode: str = "append", path: str | None = None):
    """Result table of a stream that takes all its input and ends; files lie in the
    shared folder. With the ``path`` of an earlier run it goes on from there."""
    path = path or _scratch(spark, "stream")
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _event_stream(spark, sf):
    schema = B.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


_CLOSED = "(select max(ts) - interval 10 minute from events)"


@contextmanager
def _state_in_rocksdb(spark):
    """The state store that arbitrary state needs, and that keeps large state off the heap, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@_query("k1_stream_coverage", f"with w as (select time_bucket(interval 1 hour, ts) as s, user_id as channel, event_id from events) select strftime(s, '%Y-%m-%d %H:%M:%S') as start, channel, count(distinct event_id) as packets, count(*) as n from w where s + interval 1 hour <= {_CLOSED} group by s, channel")
def _(spark, sf):
    a = _event_stream(spark, sf).select("ts", F.col("user_id").alias("channel"), F.col("event_id").alias("packet"))
    with _state_in_rocksdb(spark):
        out = _run_stream(spark, streams.block_coverage(a, "1 hour", "10 minutes"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "channel", "packets", "n")


@_query("k2_stream_integral", "select user_id as channel, event_id as sample_idx, round(sum(case when abs(value) > 400 then 0 else value end) over (partition by user_id order by event_id) * 0.04, 6) as integral from events")
def _(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("channel"), F.col("event_id").alias("sample_idx"), "value")
    with _state_in_rocksdb(spark):
        return _run_stream(spark, streams.running_integral(s, 400.0, 0.04)).withColumn("integral", _r("integral"))


@_query(
    "k2_stream_integral_unordered",
    """with c as (select *, epoch_us(ts) <= (select epoch_us(max(ts)) // 1000 * 1000 - 86400000000 from events) as closed from events)
    select user_id as channel, event_id as sample_idx, round(sum(case when abs(value) > 400 then 0 else value end) over (partition by user_id order by ts, event_id) * 0.04, 6) as integral from c where closed""",
)
def _(spark, sf):
    """Events come in four deliveries, held back by up to a day by a rule of their number; the stream goes on with each."""
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("sample_idx"), "value", F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.min(F.unix_seconds("ts")).alias("t0"), F.max(F.unix_seconds("ts")).alias("t1"))  # one row
    held = F.unix_seconds("ts") - F.col("t0") + F.pmod(F.col("sample_idx") * 7919, F.lit(86000))
    dealt = e.join(F.broadcast(ends)).withColumn("turn", F.least(F.lit(3), F.floor(4 * held / (F.col("t1") - F.col("t0") + 1)))).drop("t0", "t1")
    path, run = _scratch(spark, "unordered"), _scratch(spark, "stream")
    dealt.limit(0).drop("turn").write.parquet(path)  # a stream's folder must be there
    stream = streams.running_integral(spark.readStream.schema(e.schema).parquet(path), 400.0, 0.04, "1 day")
    with _state_in_rocksdb(spark):
        for turn in range(4):
            dealt.filter(F.col("turn") == turn).drop("turn").write.mode("append").parquet(path)
            out = _run_stream(spark, stream, path=run)
    return out.withColumn("integral", _r("integral"))


@_query(
    "k3_stream_assignment",
    """with e as (select epoch_us(ts) / 1e6 as t, user_id as channel from events), p as (select *, cast(round((t - 10.0) / 900.0) as bigint) as packet from e),
    g as (select *, 10.0 + packet * 900.0 as target from p where abs(t - 10.0 - packet * 900.0) <= 120)
    select packet, channel, round(min(t), 6) as peak_s from g where (floor(target / 900) + 1) * 900 <= (select max(target) - 120 from g) group by packet, channel""",
)
def _(spark, sf):
    p = _event_stream(spark, sf).select("ts", F.col("user_id").alias("channel"))
    return _run_stream(spark, streams.assign_stream(p, 10.0, 900.0, 120.0)).withColumn("peak_s", _r("peak_s"))


@_query(
    "k3_stream_join",
    """with a as (select event_id as packet, user_id as channel, epoch_us(ts) as target from events where event_id % 2 = 0), p as (select user_id as channel, epoch_us(ts) as us from events where event_id % 2 = 1)
    select packet, channel, round(min(us - target) / 1e6, 6) as lag_s from a join p using (channel) where abs(us - target) <= 3600000000 group by packet, channel""",
)
def _(spark, sf):
    """Even events are expected arrivals, odd ones peaks; a last row of a channel of its own closes both streams."""
    e = B.table(spark, sf, "events").select("event_id", F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    path, run = _scratch(spark, "expected"), _scratch(spark, "stream")
    for folder, rest in (("peaks", 1), ("expected", 0)):
        own = e.filter(F.abs(F.col("event_id") % 2) == rest)
        own.unionByName(last.select(F.lit(-1).alias("event_id"), F.lit(-1).alias("channel"), "ts").select(*[F.col(f.name).cast(f.dataType) for f in e.schema])).write.parquet(f"{path}/{folder}")
    read = lambda folder: spark.readStream.schema(e.schema).parquet(f"{path}/{folder}")
    met = streams.assign_to_expected(read("peaks"), read("expected").select(F.col("event_id").alias("packet"), "channel", F.col("ts").alias("target_ts")), 3600.0, "10 minutes")
    return _run_stream(spark, met, path=run).select("packet", "channel", _r((F.unix_micros("peak_ts") - F.unix_micros("target_ts")) / 1e6).alias("lag_s"))
