"""Queries over arrival tables, fits and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorline.functions import scalars
from sensorline.operators import arrivals as A
from sensorline.operators import detection, doa, locate, outlines, reports
from sensorline.plans import bindings as B
from sensorline.plans.sample_queries import _scratch
from sensorline.sources import arrivals as files
from sensorline.sources import tables

QUERIES: dict = {}


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# sources and sinks


@_query("a1_nested_arrivals_round_trip", f"with {B.ARR} select packet, channel, sample_idx from arr")
def _(spark, sf):
    nested = files.to_nested(B.arrivals(spark, sf), "packet")
    text = nested.select(F.concat(F.lit('{"'), F.col("key").cast("string"), F.lit('":'), "json", F.lit("}")).alias("value"))
    return files.nest_rows(text, "packet", "channel").select(F.col("packet").cast("long").alias("packet"), "channel", "sample_idx")


@_query("a2_nested_arrivals", f"""with {B.ARR} select packet as key, '{{' || string_agg('"' || channel || '":' || sample_idx, ',' order by channel) || '}}' as json from arr group by packet""")
def _(spark, sf):
    return files.to_nested(B.arrivals(spark, sf), "packet")


_RUNS = "cast(o_custkey % 50 as int) as date, o_orderkey as run_id, case when o_orderkey % 4 <> 0 then {v} end as fs, {w} as period"


@_query(
    "a7_upsert_runs",
    f"""with o as (select {_RUNS.format(v="o_totalprice", w="o_custkey")} from orders where o_orderkey % 3 <> 0),
    n as (select {_RUNS.format(v="o_totalprice + 1", w="case when o_orderkey % 5 <> 0 then -o_custkey end")} from orders where o_orderkey % 3 <> 1)
    select coalesce(o.date, n.date) as date, coalesce(o.run_id, n.run_id) as run_id, round(coalesce(n.fs, o.fs), 4) as fs, coalesce(n.period, o.period) as period
    from o full join n on o.date = n.date and o.run_id = n.run_id""",
)
def _(spark, sf):
    o = B.table(spark, sf, "orders")
    keys = [(F.col("o_custkey") % 50).cast("int").alias("date"), F.col("o_orderkey").alias("run_id")]
    some = F.col("o_orderkey") % 4 != 0
    old = o.filter("o_orderkey % 3 <> 0").select(*keys, F.when(some, F.col("o_totalprice")).alias("fs"), F.col("o_custkey").alias("period"))
    new = o.filter("o_orderkey % 3 <> 1").select(*keys, F.when(some, F.col("o_totalprice") + 1).alias("fs"), F.when(F.col("o_orderkey") % 5 != 0, -F.col("o_custkey")).alias("period"))
    return tables.upsert_runs(old, new, "replace-existing").withColumn("fs", _r("fs", 4))


@_query("a14_result_file_names", "select o_orderkey as k, cast(o_custkey % 300 as int) as start_channel, cast(30 + o_orderkey % 10 as int) as array_length from orders")
def _(spark, sf):
    path = F.format_string("/r/x_start_ch_%d_arrlen_%d.json", F.col("o_custkey") % 300, 30 + F.col("o_orderkey") % 10)
    start, length = tables.name_parts(path)
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), start.alias("start_channel"), length.alias("array_length"))


@_query("a16_reception_keys", "select 'C' || l_linenumber || 'P' || l_orderkey as key, count(*) as n from lineitem group by all")
def _(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.select(tables.reception_key(F.col("l_linenumber"), F.col("l_orderkey")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# arrivals


@_query("d1_merge_arrivals", f"with {B.ARR} select * from arr")
def _(spark, sf):
    return B.arrivals(spark, sf)


@_query("d2_flip_arrivals", f"with {B.ARR} select packet, array_to_string(list(channel || '=' || sample_idx order by channel), ' ') as arrivals from arr group by packet")
def _(spark, sf):
    flat = F.array_join(F.transform("arrivals", lambda x: F.concat_ws("=", x["channel"].cast("string"), x["sample_idx"].cast("string"))), " ")
    return A.flip_arrivals(B.arrivals(spark, sf)).select("packet", flat.alias("arrivals"))


@_query(
    "d3_presence_matrix",
    f"""with {B.ARR}, ps as (select distinct packet from arr), ch as (select unnest(range(lo, hi + 1)) as channel from (select min(channel) as lo, max(channel) as hi from arr))
    select packet, cast(channel as int) as channel, cast(arr.packet is not null as int) as present from (select packet as packet, channel from ps, ch) left join arr using (packet, channel)""".replace("cast(arr.packet is not null as int)", "cast(sample_idx is not null as int)"),
)
def _(spark, sf):
    a = B.arrivals(spark, sf)
    return A.presence_matrix(a, a)


@_query("d4_coverage_pct", f"with {B.ARR} select packet, round(100.0 * count(distinct channel) / (select max(channel) - min(channel) + 1 from arr), 6) as coverage_pct from arr group by packet")
def _(spark, sf):
    return A.coverage_pct(B.arrivals(spark, sf)).withColumn("coverage_pct", _r("coverage_pct"))


def _sent(spark, sf):
    return B.table(spark, sf, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("packet"), F.floor(F.col("o_totalprice")).alias("tx_sample"))


_SENT = "snt as (select o_orderkey as packet, cast(floor(o_totalprice) as bigint) as tx_sample from orders where o_orderkey % 10 <> 0)"


@_query("d5_avg_travel_time", f"with {B.ARR}, {_SENT}, tt as (select channel, sample_idx - tx_sample as travel from arr join snt using (packet) where packet between 1 and 1000000000000) select channel, round(avg(travel), 4) as avg_travel, count(travel) as n from (select distinct channel from arr) left join tt using (channel) group by channel")
def _(spark, sf):
    return A.avg_travel_time(B.arrivals(spark, sf), _sent(spark, sf), 1, 10**12).withColumn("avg_travel", _r("avg_travel", 4))


@_query("d5_travel_times", f"with {B.ARR}, {_SENT} select packet, channel, sample_idx - tx_sample as travel from arr join snt using (packet)")
def _(spark, sf):
    return A.travel_times(B.arrivals(spark, sf), _sent(spark, sf))


@_query(
    "d6_path_difference",
    f"""with {B.ARR}, m as (select a.packet, 1475.0 * (b.sample_idx - a.sample_idx) / 25000.0 as m from arr a join arr b on a.packet = b.packet and a.channel = 1 and b.channel = 3),
    g as (select o_orderkey as packet, o_totalprice / 100 as d_a, o_custkey as d_b from orders)
    select packet, round(m, 4) as measured_m, round(abs(d_a - d_b), 4) as geometric_m, round(abs(m) - abs(d_a - d_b), 4) as error_m from m join g using (packet)""",
)
def _(spark, sf):
    geometry = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("packet"), (F.col("o_totalprice") / 100).alias("d_a"), F.col("o_custkey").alias("d_b"))
    out = A.path_difference_error(A.path_difference(B.arrivals(spark, sf), 1, 3, 1475.0, 25000.0), geometry)
    return out.select("packet", *[_r(c, 4).alias(c) for c in ("measured_m", "geometric_m", "error_m")])


@_query(
    "d7_depth_correct",
    f"""with {B.ARR}, s as (select o_orderkey as packet, o_totalprice / 1000 as se, o_custkey * 1.0 as sn, 30.0 as su from orders),
    h as (select distinct channel, 10.0 * channel as e, 3.0 * channel as n, -2.0 * channel as u from arr),
    j as (select packet, channel, sample_idx / 2e8 as t, u - su as dz, sqrt(power(e - se, 2) + power(n - sn, 2) + power(u - su, 2)) as r from arr join h using (channel) join s using (packet))
    select packet, channel, round(t, 9) as t, round(case when r < 1e-6 then t else t - dz * (dz / r) / 1475.0 end, 9) as t_flat from j""",
)
def _(spark, sf):
    a = B.arrivals(spark, sf)
    c = F.col("channel")
    channels = a.select("channel").distinct().select("channel", (10.0 * c).alias("e"), (3.0 * c).alias("n"), (-2.0 * c).alias("u"))
    source = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("packet"), (F.col("o_totalprice") / 1000).alias("se"), (F.col("o_custkey") * 1.0).alias("sn"), F.lit(30.0).alias("su"))
    return A.depth_correct(a.withColumn("t", F.col("sample_idx") / B.TIME), channels, source, 1475.0).select("packet", "channel", _r("t", 9).alias("t"), _r("t_flat", 9).alias("t_flat"))


_STATUS = f"""with {B.ARR}, {B.SUB}, ps as (select o_orderkey as packet from orders union select l_orderkey + 3 from lineitem),
  n as (select packet, subarray_id, count(*) as n from arr join sub on channel >= start_ch and channel < start_ch + n_ch group by all), sn as (select distinct packet, true as seen from arr)
  select packet, subarray_id, coalesce(n, 0) as n, seen is not null and coalesce(n, 0) >= 3 as valid, case when seen is null then 'packet_missing' when coalesce(n, 0) < 3 then 'too_few_channels' end as reason
  from (select packet, subarray_id from ps, sub) left join n using (packet, subarray_id) left join sn using (packet)"""


@_query("d8_subarray_status", _STATUS)
def _(spark, sf):
    packets = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("packet")).union(B.table(spark, sf, "lineitem").select(F.col("l_orderkey") + 3))
    return A.subarray_status(B.arrivals(spark, sf), B.subarrays(spark, sf), packets)


@_query("d8_subarray_slice", f"with {B.ARR}, {B.SUB} select subarray_id, packet, channel, sample_idx from arr join sub on channel >= start_ch and channel < start_ch + n_ch")
def _(spark, sf):
    return A.subarray_slice(B.arrivals(spark, sf), B.subarrays(spark, sf)).select("subarray_id", "packet", "channel", "sample_idx")


@_query("d9_to_seconds", f"with {B.ARR} select packet, channel, round(sample_idx / 25000.0, 6) as t from arr")
def _(spark, sf):
    return B.arrivals(spark, sf).select("packet", "channel", _r(A.to_seconds(F.col("sample_idx"), 25000.0)).alias("t"))


# detection


def _peaks(spark, sf):
    return B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel"), (F.col("l_partkey") * 1000 + F.col("l_orderkey") % 1000).alias("peak")).distinct()


_PEAKS = "pk as (select distinct l_suppkey as channel, l_partkey * 1000 + l_orderkey % 1000 as peak from lineitem)"
_TARGETS = "tg as (select distinct o_custkey as packet, o_custkey * 1300 + 70 as target from orders)"


def _targets(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("packet"), (F.col("o_custkey") * 1300 + 70).alias("target")).distinct()


@_query("c4_expected_arrivals", "select o_orderkey as run_id, k as packet, o_custkey * 10 + k * (500 + o_orderkey % 7) as target from (select *, unnest(range(0, 3 + o_orderkey % 5)) as k from orders)")
def _(spark, sf):
    k = F.col("o_orderkey")
    runs = B.table(spark, sf, "orders").select(k.alias("run_id"), (F.col("o_custkey") * 10).alias("offset"), (500 + k % 7).alias("period"), (3 + k % 5).alias("n_packets"))
    return detection.expected_arrivals(runs)


@_query(
    "c4_estimate_run",
    f"""with {_PEAKS}, g as (select peak - lag(peak) over (partition by channel order by peak) as gap from pk), e as (select min(peak) as f, max(peak) - min(peak) as s from pk group by channel),
    m as (select quantile_cont(gap, 0.5) as period from g), q as (select quantile_cont(f, 0.5) as "offset", quantile_cont(s, 0.5) as s from e)
    select "offset", period, cast(round(s / period) + 1 as bigint) as n_packets from q, m""",
)
def _(spark, sf):
    return detection.estimate_run(_peaks(spark, sf))


@_query("c5_default_tolerance", f"with {_PEAKS} select round(3 * stddev_pop(f), 4) as tol from (select min(peak) as f from pk group by channel)")
def _(spark, sf):
    return detection.default_tolerance(_peaks(spark, sf)).select(_r("tol", 4).alias("tol"))


@_query("c5_assign_peaks", f"with {_PEAKS}, {_TARGETS} select packet, channel, min(peak) as sample_idx from pk join tg on abs(peak - target) <= 750 group by all")
def _(spark, sf):
    return detection.assign_peaks(_peaks(spark, sf), _targets(spark, sf), 750.0)


# direction finding


@_query("f1_principal_axis_2d", f"with {B.AXIS} select packet, subarray_id, round(ax, 6) as ax, round(ay, 6) as ay from axes where cxx_ok".replace(" where cxx_ok", " semi join (select packet, subarray_id from pts group by all having count(*) > 1) using (packet, subarray_id)"))
def _(spark, sf):
    pts = B.fit_points(spark, sf).withColumnsRenamed({"e": "x", "n": "y"})
    many = pts.groupBy("packet", "subarray_id").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return doa.principal_axis_2d(pts).join(many, ["packet", "subarray_id"], "left_semi").select("packet", "subarray_id", _r("ax").alias("ax"), _r("ay").alias("ay"))


@_query("f1_principal_axis_3d", None)
def _(spark, sf):
    return doa.principal_axis(B.fit_points(spark, sf)).select("packet", "subarray_id", *[_r(c).alias(c) for c in ("ax", "ay", "az")])


@_query("f2_along_array", f"with {B.AXIS} select packet, subarray_id, channel, round(s, 6) + 0.0 as s from st")
def _(spark, sf):
    return B.placed(spark, sf).select("packet", "subarray_id", "channel", (_r("s") + 0.0).alias("s"))


@_query("f3_ols_fit", f"with {B.AXIS} select packet, subarray_id, round(regr_slope(t, s), 9) as slope, round(regr_intercept(t, s), 9) as intercept, count(*) as n from st group by all having count(*) > 2")
def _(spark, sf):
    return doa.ols_lines(B.lines(spark, sf)).filter("n > 2").select("packet", "subarray_id", _r("slope", 9).alias("slope"), _r("intercept", 9).alias("intercept"), "n")


@_query(
    "f3_theil_sen_fit",
    f"""with {B.AXIS}, pr as (select a.packet, a.subarray_id, median((b.t - a.t) / (b.s - a.s)) as sl from st a join st b on a.packet = b.packet and a.subarray_id = b.subarray_id and b.s > a.s group by all)
    select packet, subarray_id, round(sl, 9) as slope, round(median(t - sl * s), 9) as intercept, count(*) as n from st join pr using (packet, subarray_id) group by packet, subarray_id, sl""",
)
def _(spark, sf):
    return doa.theil_sen_lines(B.lines(spark, sf)).select("packet", "subarray_id", _r("slope", 9).alias("slope"), _r("intercept", 9).alias("intercept"), "n")


@_query("f3_ransac_fit", None)
def _(spark, sf):
    return doa.ransac_lines(B.lines(spark, sf))


@_query(
    "f4_trimmed_fit",
    f"""with {B.FITS} select packet, subarray_id, channels_available, n_inliers_stage1, n_inliers_stage2, valid, reason, round(slope, 8) as slope, round(residual_rms, 8) as residual_rms, round(residual_max_abs, 8) as residual_max_abs from fits""",
)
def _(spark, sf):
    out = doa.trimmed_lines(B.lines(spark, sf))
    return out.select("packet", "subarray_id", "channels_available", "n_inliers_stage1", "n_inliers_stage2", "valid", "reason", *[_r(c, 8).alias(c) for c in ("slope", "residual_rms", "residual_max_abs")])


@_query("f5_cone_angles", f"with {B.FITS} select packet, subarray_id, round(angle_deg, 4) as angle_deg, round(angle_off_axis_deg, 4) as angle_off_axis_deg, side from ang where valid")
def _(spark, sf):
    return B.doa_fits(spark, sf).filter("valid").select("packet", "subarray_id", _r("angle_deg", 4).alias("angle_deg"), _r("angle_off_axis_deg", 4).alias("angle_off_axis_deg"), "side")


@_query(
    "f8_shared_slope",
    f"""with {B.AXIS}, c as (select *, channel % 2 as cl from st), d as (select packet, subarray_id, s - avg(s) over w as s, t - avg(t) over w as t from c window w as (partition by packet, subarray_id, cl))
    select packet, subarray_id, round(regr_slope(t, s), 9) as slope, count(*) as n from d group by all having count(*) > 3""",
)
def _(spark, sf):
    out = doa.shared_slope(B.placed(spark, sf).withColumn("cluster", F.col("channel") % 2))
    return out.filter("n > 3").select("packet", "subarray_id", _r("slope", 9).alias("slope"), "n")


#: The given subarrays have at most five channels: two lines of two points or more.
_PATHS = {"k": 2, "least": 2}


@_query("f7_multiline_fit", None)
def _(spark, sf):
    return doa.multiline_lines(B.lines(spark, sf), **_PATHS)


@_query("f8_shared_slope_loop", None)
def _(spark, sf):
    return doa.multiline_lines(B.lines(spark, sf), shared=True, **_PATHS)


def _located(spark, sf):
    """Valid fits with axis and reference."""
    return B.doa_fits(spark, sf).filter("valid").select("packet", "subarray_id", "angle_deg", "ax", "ay", F.lit(0.0).alias("az"), "re", "rn", "ru")


WINDOW = (0.0, 120.0, -100.0, 100.0)
_LOC = B.FITS + """, ref as (select packet, subarray_id, avg(e) as re, avg(n) as rn, avg(u) as ru from pts group by all),
  loc as (select packet, subarray_id, angle_deg, ax, ay, 0.0 as az, re, rn, ru from ang join axes using (packet, subarray_id) join ref using (packet, subarray_id) where valid)"""
_RINGS = _LOC + """, ring as (select *, radians(greatest(0.5, least(179.5, greatest(0.5, least(179.5, angle_deg)) + off))) as th, cos(k * 2 * pi() / 300) as cp, sin(k * 2 * pi() / 300) as sp, cast(k as int) as kk, ay as px, -ax as py, 0.0 as pz
    from loc, (values ('inner', -5.0), ('nominal', 0.0), ('outer', 5.0)) as v(ring, off), range(300) as g(k)),
  dir as (select *, -(cos(th) * ax + sin(th) * cp * px / sqrt(ax * ax + ay * ay)) as dx, -(cos(th) * ay + sin(th) * cp * py / sqrt(ax * ax + ay * ay)) as dy,
    -(sin(th) * sp * (ax * py - ay * px) / sqrt(ax * ax + ay * ay)) as dz from ring),
  both_ as (select *, case when abs(dz) > 1e-8 then (30.0 - ru) / (case when fl then -dz else dz end) end as r from dir, (values (false), (true)) as f(fl)),
  met as (select packet, subarray_id, ring, kk as k, fl as flipped, re + r * (case when fl then -dx else dx end) as e, rn + r * (case when fl then -dy else dy end) as n from both_ where r > 0 and r <= 500),
  kept as (select *, count_if(not flipped) over (partition by packet, subarray_id, ring) > 0 as straight from met)"""


@_query("f9_cone_plane_points", f"with {_RINGS} select packet, subarray_id, ring, k, flipped, round(e, 3) + 0.0 as e, round(n, 3) + 0.0 as n from kept where flipped <> straight")
def _(spark, sf):
    pts = locate.cone_plane_points(_located(spark, sf), max_range=500.0)
    return pts.select("packet", "subarray_id", "ring", "k", "flipped", _r("e", 3).alias("e"), _r("n", 3).alias("n"))


@_query(
    "f10_band_polygon",
    f"""with {_RINGS}, o as (select *, case when ring = 'outer' then k else 1000000 - k end as o from kept where flipped <> straight and ring <> 'nominal'),
    s as (select *, coalesce(lead(e) over w, first_value(e) over w) as e2, coalesce(lead(n) over w, first_value(n) over w) as n2 from o window w as (partition by packet, subarray_id order by o)),
    g as (select packet, subarray_id, count(*) as n_vertices, count(distinct ring) as rings, sum(e * n2 - e2 * n) / 2 as a from s group by all)
    select packet, subarray_id, n_vertices, round(abs(a), 2) as area from g where rings = 2 and n_vertices >= 3 and abs(a) > 1e-9""",
)
def _(spark, sf):
    return locate.fit_polygons(_located(spark, sf), max_range=500.0).select("packet", "subarray_id", "n_vertices", _r("area", 2).alias("area"))


@_query(
    "f11_qualified_packets",
    f"with {B.FITS} select packet from ang where valid and n_inliers_stage2 > 3 and channels_available > 0 group by packet having count(distinct subarray_id) = (select count(*) from sub)",
)
def _(spark, sf):
    fits = B.doa_fits(spark, sf).withColumn("has_points", F.col("n_inliers_stage2") > 3).withColumn("nominal_points", F.col("channels_available"))
    return locate.qualified_packets(fits, B.subarrays(spark, sf))


def _cells_sql(size: float) -> str:
    """Every cell of the window against every fit: hit tells the cells in all bands of a packet."""
    nx, ny = round((WINDOW[1] - WINDOW[0]) / size), round((WINDOW[3] - WINDOW[2]) / size)
    return _LOC + f""", cell as (select ix, iy, (ix + 0.5) * {size} as ce, {WINDOW[2]} + (iy + 0.5) * {size} as cn from range({nx}) as x(ix), range({ny}) as y(iy)),
  ang_ as (select packet, subarray_id, ix, iy, angle_deg, degrees(acos(greatest(-1.0, least(1.0, ((re - ce) * ax + (rn - cn) * ay) / sqrt(power(re - ce, 2) + power(rn - cn, 2) + power(ru - 30.0, 2)))))) as to_cell from loc, cell),
  trn_ as (select *, case when bool_or(abs(to_cell - angle_deg) <= 5.0) over (partition by packet, subarray_id) then angle_deg else 180 - angle_deg end as used from ang_),
  hit as (select packet, ix, iy, bool_and(abs(to_cell - used) <= 5.0) as ok from trn_ group by all)"""


@_query("f12_intersect_bands", f"with {_cells_sql(10.0)} select packet, count(*) as cells, min(ix) as ix_lo, max(iy) as iy_hi from hit where ok group by packet")
def _(spark, sf):
    cells = locate.intersect_bands(_located(spark, sf), WINDOW, 10.0)
    return cells.groupBy("packet").agg(F.count("*").alias("cells"), F.min("ix").cast("long").alias("ix_lo"), F.max("iy").cast("long").alias("iy_hi"))


#: Regions in SQL: every cell reaches its neighbours' neighbours, and the least cell that it reaches names its region.
_REGIONS = f"""with recursive {_cells_sql(5.0)}, c as (select packet, ix, iy, ix * 1000 + iy as k, (ix + 0.5) * 5.0 as e, -100.0 + (iy + 0.5) * 5.0 as n from hit where ok),
  nb as (select a.packet, a.k as f, b.k as t from c a join c b on a.packet = b.packet and abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
  rc as (select packet, k as f, k as t from c union select rc.packet, rc.f, nb.t from rc join nb on nb.packet = rc.packet and nb.f = rc.t),
  lb as (select packet, f as k, min(t) as region from rc group by all),
  rg as (select packet, region, avg(e) as e, avg(n) as n, count(*) * 25.0 as area from c join lb using (packet, k) group by all)"""


@_query(
    "f13_track_centroids",
    _REGIONS + " select packet, cast(rank as int) as rank, round(e, 4) + 0.0 as e, round(n, 4) + 0.0 as n, 30.0::double as u, area from (select *, row_number() over (partition by packet order by area desc, e, n) as rank from rg) where rank <= 2",
)
def _(spark, sf):
    got = locate.locate(_located(spark, sf), WINDOW, 10.0, 2)
    return got.select("packet", "rank", (_r("e", 4) + 0.0).alias("e"), (_r("n", 4) + 0.0).alias("n"), "u", "area")


#: Vertices of a ring in the queries of exact outlines.
_VERTICES = 36


def _scanline_sql(group: str) -> str:
    """Exact area and centroid of what all outlines of a group share: strips between the
    heights of vertices and crossings, bits of the outlines flipped from edge to edge."""
    rings = _RINGS.replace("300", str(_VERTICES))
    return rings + f""", o as (select *, case when ring = 'outer' then k else 1000000 - k end as o from kept where flipped <> straight and ring <> 'nominal'),
  s as (select packet, subarray_id, e as x1, n as y1, coalesce(lead(e) over w, first_value(e) over w) as x2, coalesce(lead(n) over w, first_value(n) over w) as y2,
    count(*) over v >= 3 and bool_or(ring = 'inner') over v and bool_or(ring = 'outer') over v as whole from o window w as (partition by packet, subarray_id order by o), v as (partition by packet, subarray_id)),
  ed as (select {group}, dense_rank() over (partition by {group} order by subarray_id) - 1 as bit, case when y1 < y2 then x1 else x2 end as x1, least(y1, y2) as y1, case when y1 < y2 then x2 else x1 end as x2, greatest(y1, y2) as y2 from s where whole),
  lv as (select *, (x2 - x1) / (y2 - y1) as m, row_number() over (partition by {group} order by bit, y1, y2, x1, x2) as i from ed where y1 < y2),
  cr as (select {group}, a.y1 as ay1, a.y2 as ay2, b.y1 as by1, b.y2 as by2, ((b.x1 - b.m * b.y1) - (a.x1 - a.m * a.y1)) / (a.m - b.m) as y from lv a join lv b using ({group})
    where a.i < b.i and a.y1 < b.y2 and b.y1 < a.y2 and least(a.x1, a.x2) <= greatest(b.x1, b.x2) and least(b.x1, b.x2) <= greatest(a.x1, a.x2) and a.m <> b.m),
  ys as (select {group}, y1 as y from lv union select {group}, y2 from lv union select {group}, y from cr where y > greatest(ay1, by1) and y < least(ay2, by2)),
  strip as (select {group}, y as lo, lead(y) over (partition by {group} order by y) as hi from ys),
  pc as (select {group}, lo, hi, bit, i, x1 + m * (lo - y1) as xl, x1 + m * (hi - y1) as xh from strip join lv using ({group}) where hi is not null and y1 <= lo and y2 >= hi),
  sw as (select *, bit_xor(1::bigint << bit) over (partition by {group}, lo order by xl + xh, i rows unbounded preceding) as mask, lead(xl) over q as rl, lead(xh) over q as rh from pc window q as (partition by {group}, lo order by xl + xh, i)),
  fl as (select {group}, (1::bigint << (max(bit) + 1)) - 1 as every, avg(x1) as ox, avg(y1) as oy from lv group by all),
  tr as (select {group}, ox, oy, (hi - lo) as h, lo - oy as lo, xl - ox as xl, xh - ox as xh, rl - ox as rl, rh - ox as rh from sw join fl using ({group}) where mask = every),
  mo as (select {group}, ox, oy, sum(h * (rl - xl + rh - xh) / 2) as area, sum(h * (rl * rl + rl * rh + rh * rh - xl * xl - xl * xh - xh * xh) / 6) as se, sum(lo * h * (rl - xl + rh - xh) / 2 + h * h * (rl - xl + 2 * (rh - xh)) / 6) as sn from tr group by all)
  select {group}, round(area, 3) as area, round(ox + se / area, 3) + 0.0 as e, round(oy + sn / area, 3) + 0.0 as n from mo where area > 0.001"""


def _common_outlines(spark, sf, keys: tuple[str, ...]):
    fits = _located(spark, sf).repartition("packet")  # outlines and regions of a packet stand together from here
    bands = outlines.fit_outlines(fits, samples=_VERTICES, max_range=500.0)
    whole = outlines.whole_areas(outlines.common_regions(bands, keys), keys).filter("area > 0.001")
    return whole.select(*keys, _r("area", 3).alias("area"), (_r("e", 3) + 0.0).alias("e"), (_r("n", 3) + 0.0).alias("n"))


@_query("f10_resolved_outlines", f"with {_scanline_sql('packet, subarray_id')}")
def _(spark, sf):
    return _common_outlines(spark, sf, ("packet", "subarray_id"))


@_query("f12_common_outline", f"with {_scanline_sql('packet')}")
def _(spark, sf):
    return _common_outlines(spark, sf, ("packet",))


# reports

_BINS = "bins as (select cast(k as int) as bin_no, case when k = 0 then -0.5 when k = 1 then 0.5 else 5.0 * (k - 1) end as lo, case when k = 0 then 0.5 else 5.0 * k end as hi from range(19) as g(k))"
_HIST = f"with {B.FITS}, {_BINS}, h as (select subarray_id, bin_no, count(*) as n from ang join bins on angle_off_axis_deg > lo and angle_off_axis_deg <= hi where valid group by all) select subarray_id, bin_no, coalesce(n, 0) as n from (select distinct subarray_id, bin_no from ang, bins) left join h using (subarray_id, bin_no)"


@_query("g1_angle_histogram", _HIST)
def angle_histogram(spark, sf):
    return reports.angle_histogram(B.doa_fits(spark, sf), reports.angle_bins(spark))


@_query(
    "g2_angle_series",
    f"""with {B.FITS}, kn as (select subarray_id, packet, angle_off_axis_deg as angle from ang where valid),
    cu as (select *, case when packet - lag(packet) over (partition by subarray_id order by packet) > 1 then 1 else 0 end as b from kn), sg as (select *, sum(b) over (partition by subarray_id order by packet) as segment from cu)
    select subarray_id, packet, round(angle, 4) as angle, cast(segment as bigint) as segment from (select distinct subarray_id, g.packet from kn, range((select max(packet) + 1 from kn)) as g(packet)) left join sg using (subarray_id, packet)""",
)
def _(spark, sf):
    return reports.angle_series(B.doa_fits(spark, sf), path=_scratch(spark, "angles")).select("subarray_id", "packet", _r("angle", 4).alias("angle"), "segment")


@_query(
    "g3_channel_usage",
    f"with {B.FITS} select subarray_id, cast(sum(channels_available) as bigint) as channels_available, cast(sum(case when valid then n_inliers_stage1 else 0 end) as bigint) as n_inliers_stage1, cast(sum(case when valid then n_inliers_stage2 else 0 end) as bigint) as n_inliers_stage2, round(avg(case when valid then n_inliers_stage2 end), 6) as mean_stage2 from ang group by subarray_id",
)
def _(spark, sf):
    return reports.channel_usage(B.doa_fits(spark, sf)).withColumn("mean_stage2", _r("mean_stage2"))


@_query(
    "g4_reception_map",
    """select l_suppkey as channel, l_orderkey as packet, l_linenumber as line, l_returnflag <> 'R' as detected, l_discount > 0.05 and cast(l_tax * 100 as int) % 5 = 4 as successful,
    case when l_returnflag <> 'R' and l_quantity / 5 >= 3 then round(l_quantity / 5, 4) end as snr, l_partkey % 180 between 0 and 90 as in_bounds from lineitem""",
)
def _(spark, sf):
    r = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("packet"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 5).alias("snr"), (F.col("l_discount") > 0.05).alias("valid"), (F.round(F.col("l_tax") * 100).cast("int") % 5).alias("version"), (F.col("l_partkey") % 180).alias("grazing_deg"))
    keyed = r.withColumn("packet", F.struct("packet", "line"))
    return reports.reception_map(keyed).select("channel", "packet.packet", "packet.line", "detected", "successful", _r("snr", 4).alias("snr"), "in_bounds")


@_query("j5_numeric_key_order", "select key, cast(row_number() over (order by cast(key as bigint)) as int) as place from (select distinct cast(l_suppkey as varchar) as key from lineitem)")
def _(spark, sf):
    from pyspark.sql import Window as W

    keys = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("key")).distinct()
    return keys.withColumn("place", F.row_number().over(W.orderBy(F.col("key").cast("long"))))


@_query("b9_channel_ranges", "with c as (select distinct l_suppkey as channel from lineitem where l_suppkey % 5 <> 0), g as (select channel, channel - row_number() over (order by channel) as g from c) select min(channel) as min_ch, max(channel) as max_ch, count(*) as size from g group by g")
def _(spark, sf):
    from sensorline.operators.conditioning import channel_ranges

    return channel_ranges(B.table(spark, sf, "lineitem").filter("l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("channel")))


@_query("b9_expand_ranges", "select distinct l_suppkey as channel from lineitem where l_suppkey % 5 <> 0")
def _(spark, sf):
    from sensorline.operators.conditioning import channel_ranges, expand_ranges

    return expand_ranges(channel_ranges(B.table(spark, sf, "lineitem").filter("l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("channel"))))


@_query("b10_available_channels", "with a as (select channel, row_number() over (order by channel) - 1 as place from (select distinct l_suppkey as channel from lineitem)) select channel, cast(place as int) as place from a where channel in (select o_custkey from orders)")
def _(spark, sf):
    from sensorline.operators.conditioning import available_channels

    return available_channels(B.table(spark, sf, "orders").select(F.col("o_custkey").alias("channel")), B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("channel")))


@_query("h1_packet_samples", "select o_orderkey as k, cast(round(o_totalprice * 176 / (100 + o_custkey % 50)) as bigint) as n from orders")
def _(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), scalars.packet_samples((100 + F.col("o_custkey") % 50), F.col("o_totalprice")).alias("n"))
