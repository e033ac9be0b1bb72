"""The given tables seen as the library's canonical tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.operators.arrivals import merge_arrivals


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet"), F.col("l_linenumber").cast("int").alias("channel"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("sample_idx"))


RAW = "raw as (select l_orderkey as packet, cast(l_linenumber as int) as channel, cast(round(l_extendedprice * 100) as bigint) as sample_idx from lineitem)"
ARR = RAW + ", arr as (select packet, channel, min(sample_idx) as sample_idx from raw group by all)"


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return merge_arrivals(raw_arrivals(spark, sf))


def subarrays(spark: SparkSession, sf: str) -> DataFrame:
    """Two subarrays over the channels that the arrivals have."""
    top = raw_arrivals(spark, sf).agg(F.max("channel").alias("m"))
    return top.select(F.explode(F.array(F.struct(F.lit(0).alias("subarray_id"), F.lit(1).alias("start_ch"), (F.col("m") - 2).alias("n_ch")), F.struct(F.lit(1).alias("subarray_id"), F.lit(3).alias("start_ch"), (F.col("m") - 2).alias("n_ch")))).alias("x")).select("x.*")


SUB = "sub as (select subarray_id, start_ch, m - 2 as n_ch from (select max(channel) as m from arr), (values (0, 1), (1, 3)) as v(subarray_id, start_ch))"

#: Times of 0 to 0.05 s, so that trimming at 10 m and 5 m has work to do.
TIME = 2e8


def fit_points(spark: SparkSession, sf: str) -> DataFrame:
    """packet, subarray_id, channel, t and positions e, n, u of a bent line. Arrivals are
    dealt by packet, so merging, slicing and lines of a packet share one shuffle."""
    from sensorline.operators.arrivals import subarray_slice

    c = F.col("channel").cast("double")
    dealt = merge_arrivals(raw_arrivals(spark, sf).repartition("packet"))
    cut = subarray_slice(dealt, subarrays(spark, sf))
    return cut.select("packet", "subarray_id", "channel", (F.col("sample_idx") / TIME).alias("t"), (10 * c + F.col("packet") % 7).alias("e"), (3 * c + 0.5 * c * c).alias("n"), (0.1 * c).alias("u"))


PTS = ARR + ", " + SUB + f""", pts as (
  select packet, subarray_id, channel, sample_idx / {TIME} as t, 10.0 * channel + packet % 7 as e, 3.0 * channel + 0.5 * channel * channel as n, 0.1 * channel as u
  from arr join sub on channel >= start_ch and channel < start_ch + n_ch)"""

#: Places along the principal axis in the plane, from the first channel.
AXIS = PTS + """, cov as (
  select packet, subarray_id, var_pop(e) as cxx, var_pop(n) as cyy, covar_pop(e, n) as cxy,
         arg_max(e, channel) - arg_min(e, channel) as de, arg_max(n, channel) - arg_min(n, channel) as dn
  from pts group by all), trn as (select *, 0.5 * atan2(2 * cxy, cxx - cyy) as a from cov),
axes as (select packet, subarray_id, case when de * cos(a) + dn * sin(a) < 0 then -cos(a) else cos(a) end as ax, case when de * cos(a) + dn * sin(a) < 0 then -sin(a) else sin(a) end as ay from trn),
pl as (select pts.*, e * ax + n * ay as p from pts join axes using (packet, subarray_id)),
st as (select packet, subarray_id, channel, t, p - arg_min(p, channel) over (partition by packet, subarray_id) as s from pl)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per packet and subarray with its axis in the plane and its line of (channel, s, t)."""
    from sensorline.operators.doa import packet_lines

    return packet_lines(fit_points(spark, sf), ("e", "n"))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Fit points with their place ``s`` along the principal axis in the plane."""
    from sensorline.operators.doa import line_points

    return line_points(lines(spark, sf))


FITS = AXIS + """,
f1 as (select packet, subarray_id, regr_slope(t, s) as sl, regr_intercept(t, s) as ic from st group by all),
k1 as (select st.* from st join f1 using (packet, subarray_id) where abs(t - sl * s - ic) < 10.0 / 1475.0),
f2 as (select packet, subarray_id, regr_slope(t, s) as sl, regr_intercept(t, s) as ic from k1 group by all),
k2 as (select k1.* from k1 join f2 using (packet, subarray_id) where abs(t - sl * s - ic) < 5.0 / 1475.0),
f3 as (select packet, subarray_id, regr_slope(t, s) as sl, regr_intercept(t, s) as ic from k2 group by all),
r3 as (select packet, subarray_id, sqrt(avg((t - sl * s - ic) * (t - sl * s - ic))) as rms, max(abs(t - sl * s - ic)) as top from k2 join f3 using (packet, subarray_id) group by all),
c0 as (select packet, subarray_id, count(*) as a from st group by all), c1 as (select packet, subarray_id, count(*) as b from k1 group by all), c2 as (select packet, subarray_id, count(*) as c from k2 group by all),
fw as (select packet, subarray_id, a, coalesce(b, 0) as b, coalesce(c, 0) as c, sl, rms, top from c0 left join c1 using (packet, subarray_id) left join c2 using (packet, subarray_id) left join f3 using (packet, subarray_id) left join r3 using (packet, subarray_id)),
fr as (select *, case when a < 3 then 'too_few_channels' when b < 3 then 'too_few_inliers_stage1' when c < 3 then 'too_few_inliers_stage2' when sl is null or isnan(sl) then 'no_slope' end as reason from fw),
fits as (select packet, subarray_id, a as channels_available, b as n_inliers_stage1, c as n_inliers_stage2, reason is null as valid, reason,
         case when reason is null then sl end as slope, case when reason is null then rms end as residual_rms, case when reason is null then top end as residual_max_abs,
         case when reason is null then degrees(acos(greatest(-1.0, least(1.0, sl * 1475.0)))) end as angle_deg from fr),
ang as (select *, least(angle_deg, 180 - angle_deg) as angle_off_axis_deg, case when angle_deg <= 90 then 'first to last' when angle_deg > 90 then 'last to first' end as side from fits)"""


def doa_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Fits of ``lines`` with their angles, axes and mean places."""
    from sensorline.operators.doa import trimmed_lines, with_angles

    return with_angles(trimmed_lines(lines(spark, sf)))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """channel, sample_idx, ts, value of the events of a user in order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("sample_idx"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type", "event_id")


SMP = "smp as (select user_id as channel, row_number() over (partition by user_id order by ts, event_id) - 1 as sample_idx, ts, value, event_type, event_id from events)"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """channel, block_no, start_sample, samples of the vectors of a label in order."""
    w = W.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf, "embeddings").select(F.col("label").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("block_no"), F.col("embedding").cast("array<double>").alias("samples"))
    return v.select(F.lit(0).alias("run_id"), "channel", "block_no", (F.col("block_no") * 64).alias("start_sample"), "samples")


BLK = "blk as (select label as channel, row_number() over (partition by label order by vec_id) - 1 as block_no, embedding as samples from embeddings), lng as (select channel, block_no, block_no * 64 + k - 1 as sample_idx, cast(samples[k] as double) as value from (select *, unnest(range(1, 65)) as k from blk))"


def polylines(spark: SparkSession, sf: str) -> DataFrame:
    """cable_id, seq, lat, lon, alt of the orders of a customer in order."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    alt = F.when(k % 5 == 0, 0.0).when(k % 7 == 0, None).otherwise(-(k % 100).cast("double") - 1)
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("cable_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (63.0 + (k % 1000) / 1e5).alias("lat"), (10.0 + (k % 777) / 1e5).alias("lon"), alt.alias("alt"))


POL = """pol as (select o_custkey as cable_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as seq, 63.0 + (o_orderkey % 1000) / 1e5 as lat, 10.0 + (o_orderkey % 777) / 1e5 as lon,
  case when o_orderkey % 5 = 0 then 0.0 when o_orderkey % 7 = 0 then null else -cast(o_orderkey % 100 as double) - 1 end as alt from orders)"""
#: Lines whose altitudes are all known, and their chainage.
LIN = POL + ", lin as (select cable_id, seq, lat, lon, coalesce(alt, 0.0) as alt from pol)"
DIST = "sqrt(power((lon - {p}lon) * 111320 * cos(radians((lat + {p}lat) / 2)), 2) + power((lat - {p}lat) * 111320, 2) + power(alt - {p}alt, 2))"
CUM = LIN + ", lag_ as (select *, lag(lat) over w as plat, lag(lon) over w as plon, lag(alt) over w as palt from lin window w as (partition by cable_id order by seq)), cum as (select cable_id, seq, lat, lon, alt, sum(coalesce(" + DIST.format(p="p") + ", 0)) over (partition by cable_id order by seq) as cum from lag_)"


def full_lines(spark: SparkSession, sf: str) -> DataFrame:
    return polylines(spark, sf).withColumn("alt", F.coalesce("alt", F.lit(0.0)))
