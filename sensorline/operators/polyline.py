"""Cable polylines, channel positions and source tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.functions.geo import METRES_PER_DEGREE, distance_equirect, to_cartesian, to_gps
from sensorline.functions.scalars import wrap
from sensorline.operators.joins import bracketing, bracketing_bucketed, lerp, point_interval_join

#: A polyline is (cable_id, seq, lat, lon, alt).
_BEFORE = (W.unboundedPreceding, 0)
_AFTER = (0, W.unboundedFollowing)


def _cable() -> W:
    return W.partitionBy("cable_id").orderBy("seq")


def _missing(alt: Column) -> Column:
    return alt.isNull() | (F.abs(alt) < 1e-9)


def _fill(df: DataFrame, x: Column, known: Column) -> Column:
    w = _cable()
    knot = F.when(known, F.struct(x.alias("x"), F.col("alt").alias("z")))
    lo, hi = F.last(knot, True).over(w.rowsBetween(*_BEFORE)), F.first(knot, True).over(w.rowsBetween(*_AFTER))
    between = lerp(x, lo["x"], hi["x"], lo["z"], hi["z"])
    return F.when(lo.isNull(), hi["z"]).when(hi.isNull(), lo["z"]).otherwise(between)


def fill_alt_by_index(line: DataFrame) -> DataFrame:
    """Altitudes that are null or 0 become linear in the vertex number; ends take the nearest."""
    placed = line.withColumn("__i", F.row_number().over(_cable()).cast("double"))
    return placed.withColumn("__z", _fill(placed, F.col("__i"), ~_missing(F.col("alt")))).withColumn("alt", F.col("__z")).drop("__i", "__z")


def _steps(line: DataFrame, cubic: bool) -> DataFrame:
    w = _cable()
    p = [F.lag(c).over(w) for c in ("lat", "lon", "alt")]
    d = distance_equirect(p[0], p[1], F.col("lat"), F.col("lon"), *((p[2], F.col("alt")) if cubic else ()))
    return line.withColumn("__d", F.coalesce(d, F.lit(0.0)))


def fill_alt_by_distance(line: DataFrame, missing: float = 0.0, starting_at: int = 1) -> DataFrame:
    """Altitudes equal to ``missing`` become linear in the plane distance along the
    line; the first ``starting_at`` vertices count as known."""
    far = _steps(line, False).withColumn("__x", F.sum("__d").over(_cable().rowsBetween(*_BEFORE))).withColumn("__i", F.row_number().over(_cable()))
    known = (F.col("__i") <= starting_at) | (F.coalesce(F.col("alt"), F.lit(missing)) != missing)
    return far.withColumn("__z", _fill(far, F.col("__x"), known)).withColumn("alt", F.col("__z")).drop("__d", "__x", "__i", "__z")


def chainage(line: DataFrame) -> DataFrame:
    """Add ``cum``: length along the line in three dimensions."""
    return _steps(line, True).withColumn("cum", F.sum("__d").over(_cable().rowsBetween(*_BEFORE))).drop("__d")


def cumulative_gps_distance(line: DataFrame) -> DataFrame:
    """Add ``cum``: sum of chords on the sphere."""
    w = _cable()
    x, y, z = to_cartesian(F.col("lat"), F.col("lon"), F.col("alt"))
    held = line.withColumns({"__x": x, "__y": y, "__z": z})
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("__y", "__z")), F.pow(F.col("__x") - F.lag("__x").over(w), 2)))
    return held.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("cum", F.sum("__d").over(w.rowsBetween(*_BEFORE))).drop("__x", "__y", "__z", "__d")


def _packed(line: DataFrame) -> DataFrame:
    """Vertices of a cable in about sqrt(N) leaves of sqrt(N): strips of neighbours in
    latitude, cut by longitude. cable_id, leaf, the leaf's box and its vertices."""
    placed = line.filter("lat is not null and lon is not null").select("cable_id", "seq", "lat", "lon", "cum")
    per = W.partitionBy("cable_id")
    counted = placed.withColumns({"__n": F.count("*").over(per), "__i": F.row_number().over(per.orderBy("lat", "lon", "seq")) - 1})
    strip = F.floor(F.col("__i") / F.ceil(F.pow("__n", F.lit(0.75))))
    cut = counted.withColumn("__s", strip).withColumn("__j", F.row_number().over(W.partitionBy("cable_id", "__s").orderBy("lon", "lat", "seq")) - 1)
    leaf = F.struct("__s", F.floor(F.col("__j") / F.ceil(F.sqrt("__n"))).alias("k"))
    box = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
    return cut.groupBy("cable_id", leaf.alias("leaf")).agg(*box, F.collect_list(F.struct("lat", "lon", "seq", "cum")).alias("vertices"))


def _least_to_box(lat: Column, lon: Column, box: Column) -> Column:
    """A lower bound, less than rounding, of the distances from a place to the vertices in a box."""
    outside = lambda x, lo, hi: F.greatest(F.lit(0.0), lo - x, x - hi)
    shrink = F.least(*[F.cos(F.radians((lat + box[c]) / 2)) for c in ("lat_lo", "lat_hi")])  # cosine is concave here
    dy, dx = outside(lat, box["lat_lo"], box["lat_hi"]), outside(lon, box["lon_lo"], box["lon_hi"]) * shrink
    return F.sqrt(dx * dx + dy * dy) * METRES_PER_DEGREE * (1 - 1e-9) - 1e-6


def nearest_vertex(points: DataFrame, line: DataFrame) -> DataFrame:
    """point_id, seq, cum of the closest vertex of a chained line; the first wins ties.

    The vertices of a cable are packed into about sqrt(N) leaves with boxes. A
    point looks at the boxes, which are one row a cable, and then only at leaves
    that are no farther than the nearest of the leaves' middle vertices: about
    sqrt(N) boxes and a few times sqrt(N) vertices in place of N. Points and
    vertices without a place are left out, as are points of unknown cables;
    repeated points give one row.
    """
    leaves = _packed(line)
    one = F.struct("leaf", "lat_lo", "lat_hi", "lon_lo", "lon_hi", F.get("vertices", F.floor(F.size("vertices") / 2).cast("int")).alias("mid"))
    boxes = leaves.groupBy("cable_id").agg(F.collect_list(one).alias("boxes"))
    lat, lon = F.col("lat"), F.col("lon")
    seen = points.filter("lat is not null and lon is not null").select("cable_id", "point_id", "lat", "lon").join(boxes, "cable_id")
    reach = F.array_min(F.transform("boxes", lambda b: distance_equirect(lat, lon, b["mid"]["lat"], b["mid"]["lon"])))
    near = seen.withColumn("__r", reach).select("cable_id", "point_id", "lat", "lon", F.explode(F.transform(F.filter("boxes", lambda b: _least_to_box(lat, lon, b) <= F.col("__r")), lambda b: b["leaf"])).alias("leaf"))
    met = near.join(leaves.select("cable_id", "leaf", "vertices"), ["cable_id", "leaf"])
    best = F.array_min(F.transform("vertices", lambda v: F.struct(distance_equirect(lat, lon, v["lat"], v["lon"]).alias("d"), v["seq"].alias("seq"), v["cum"].alias("cum"))))
    return met.groupBy("cable_id", "point_id").agg(F.min(best).alias("v")).select("cable_id", "point_id", "v.seq", "v.cum")


def segments(line: DataFrame) -> DataFrame:
    """Pieces between neighbouring vertices of a chained line; pieces of no length go."""
    w = _cable()
    ends = [F.lead(c).over(w).alias(f"{c}_to") for c in ("cum", "lat", "lon", "alt")]
    return line.select("cable_id", "seq", "cum", "lat", "lon", "alt", *ends).filter("cum_to > cum")


def sample_polyline(line: DataFrame, targets: DataFrame) -> DataFrame:
    """cable_id, channel, s, lat, lon, alt at chainage ``s`` of targets
    (cable_id, channel, s), clamped to the line. Joined by bracketing pieces."""
    seg = segments(line)
    ends = line.groupBy("cable_id").agg(F.max("cum").alias("len"))
    at = targets.join(ends, "cable_id").withColumn("__s", F.greatest(F.lit(0.0), F.least(F.col("s"), F.col("len"))))
    last = seg.withColumn("__end", F.when(F.lead("seq").over(_cable()).isNull(), F.col("cum_to") + 1e-6).otherwise(F.col("cum_to")))
    hit = point_interval_join(at, last, "__s", "cum", "__end", 1000.0, ("cable_id",))
    line_of = lambda c: lerp(F.col("__s"), F.col("cum"), F.col("cum_to"), F.col(c), F.col(f"{c}_to")).alias(c)
    return hit.select("cable_id", "channel", F.col("__s").alias("s"), line_of("lat"), line_of("lon"), line_of("alt"))


def channel_targets(cables: DataFrame, spacing: float, count: int, origin: Column | float = 0.0, offset: float = 0.0) -> DataFrame:
    """Chainages origin + offset + channel * spacing of channels 0..count-1."""
    start = origin if isinstance(origin, Column) else F.lit(float(origin))
    return cables.select("cable_id", start.alias("__o"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("channel")).select("cable_id", "channel", (F.col("__o") + offset + F.col("channel") * spacing).alias("s"))


def interpolate_coordinates(queries: DataFrame, known: DataFrame) -> DataFrame:
    """lat, lon, alt at distances ``d``, linear in Cartesian axes between known
    (cable_id, d, lat, lon, alt); clamped at the ends."""
    x, y, z = to_cartesian(F.col("lat"), F.col("lon"), F.col("alt"))
    knots = known.select("cable_id", "d", x.alias("x"), y.alias("y"), z.alias("z"))
    met = bracketing(queries.select("cable_id", "d", "point_id"), knots, "d", ["x", "y", "z"], ("cable_id",))
    axis = lambda c: F.coalesce(lerp(F.col("d"), F.col("at_lo"), F.col("at_hi"), F.col(f"{c}_lo"), F.col(f"{c}_hi")), F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    lat, lon, alt = to_gps(axis("x"), axis("y"), axis("z"))
    return met.select("cable_id", "point_id", "d", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


def lead_in_remap(channels: DataFrame, n_skip: int = 24) -> DataFrame:
    """Channels 0..n_skip stand at the first point, later ones move up by
    n_skip + 1; channels from count - n_skip on are not given."""
    size = channels.agg((F.max("channel") - F.min("channel") + 1).alias("__n"))  # one row
    to = channels.select("channel").join(F.broadcast(size)).filter(F.col("channel") < F.col("__n") - n_skip)
    held = to.select(F.col("channel").alias("__c"), F.greatest(F.col("channel") - n_skip - 1, F.lit(0)).alias("channel"))
    return held.join(channels, "channel").drop("channel").withColumnRenamed("__c", "channel")


def tidal_offset(alt: Column, dz: float = -0.975) -> Column:
    """Shift altitudes that are known (not null, not 0)."""
    return F.when(alt != 0, alt + dz).otherwise(alt)


def decimate_polyline(line: DataFrame, step: int = 5) -> DataFrame:
    """Every ``step``-th vertex from the first on; the last stays."""
    w = _cable()
    placed = line.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(W.partitionBy("cable_id")))
    return placed.filter(((F.col("__i") - 1) % step == 0) | (F.col("__i") == F.col("__n"))).drop("__i", "__n")


def spacing_check(channels: DataFrame, order: str = "channel") -> DataFrame:
    """Distance of each channel to the next, in three dimensions; the last is left out."""
    w = W.partitionBy("cable_id").orderBy(order)
    n = [F.lead(c).over(w) for c in ("lat", "lon", "alt")]
    d = distance_equirect(F.col("lat"), F.col("lon"), n[0], n[1], F.col("alt"), n[2])
    return channels.select("cable_id", order, d.alias("spacing")).filter("spacing is not null")


def range_and_grazing(sources: DataFrame, line: DataFrame, smooth: int = 5) -> DataFrame:
    """Distance and cosine of the grazing angle between sources (source_id, x, y, z)
    and vertices (cable_id, seq, x, y, z).

    The local direction is the difference to the vertex before (the first
    repeats the second), a moving mean of ``smooth`` rows that starts from
    zeros, normalised; one under 1e-9 is no direction, and its cosine null, as that
    of a source on a vertex. All pairs are wanted; the line is a few hundred vertices.
    """
    w = _cable()
    axes = ("x", "y", "z")
    diff = line.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c)) for c in axes})
    mean = diff.withColumns({f"d{c}": F.sum(f"d{c}").over(w.rowsBetween(-(smooth - 1), 0)) / smooth for c in axes})
    size = F.sqrt(sum((F.pow(F.col(f"d{c}"), 2) for c in axes[1:]), F.pow(F.col("dx"), 2)))
    v = mean.select("cable_id", "seq", *[F.col(c).alias(f"v{c}") for c in axes], *[F.when(size > 1e-9, F.try_divide(F.col(f"d{c}"), size)).alias(f"u{c}") for c in axes])
    both = sources.select("cable_id", "source_id", *axes).join(v, "cable_id")
    rel = {c: F.col(f"v{c}") - F.col(c) for c in axes}
    r = F.sqrt(sum((rel[c] * rel[c] for c in axes[1:]), rel["x"] * rel["x"]))
    dot = sum((rel[c] * F.col(f"u{c}") for c in axes[1:]), rel["x"] * F.col("ux"))
    return both.select("cable_id", "source_id", "seq", r.alias("range_m"), F.try_divide(dot, r).alias("cos_grazing"))


def tx_times(runs: DataFrame) -> DataFrame:
    """run_id, packet, ts, sample_idx of runs (run_id, seq_start_ts, offset, period, fs, n_packets)."""
    at = runs.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_packets") - 1)))
    micros = F.unix_micros(F.col("seq_start_ts").cast("timestamp")) + F.round(F.col("packet") * F.col("period") / F.col("fs") * 1e6).cast("long")
    return at.select("run_id", "packet", F.timestamp_micros(micros).alias("ts"), (F.col("offset") + F.col("packet") * F.col("period")).alias("sample_idx"))


#: Fixes that are one row on their way to the runs.
FIX_BLOCK = 4096


def run_window(fixes: DataFrame, runs: DataFrame, margin_s: int = 180, width_s: int = 60) -> DataFrame:
    """Fixes inside [start - margin, stop + margin] of a run, with run_id.

    The result is fixes times the runs that overlap, so a pair must cost no more than
    its row: the fixes of ``width_s`` seconds stand as arrays of at most ``FIX_BLOCK``,
    and a run meets whole arrays in the cells of its window; only those of its two
    ends hold fixes outside. Times are compared as whole microseconds.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda t: F.expr(f"{t} div {width_s * 1_000_000}")
    margin = margin_s * 1_000_000
    # few bytes but much work, which size-based merging of partitions does not see
    parts = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = fixes.withColumn("__us", us("ts")).filter("__us is not null").withColumn("__cell", cell("__us")).repartition(parts, "__cell")
    placed = timed.withColumn("__block", F.floor((F.row_number().over(W.partitionBy("__cell").orderBy("__us")) - 1) / FIX_BLOCK))
    blocks = placed.groupBy("__cell", "__block").agg(F.collect_list(F.struct("__us", *fixes.columns)).alias("__rows"))
    spans = runs.select("run_id", (us("start_ts") - margin).alias("__lo"), (us("stop_ts") + margin).alias("__hi")).filter("__lo <= __hi")
    met = spans.withColumn("__cell", F.explode(F.sequence(cell("__lo"), cell("__hi")))).repartition(parts, "__cell").join(blocks, "__cell")
    each = met.select("run_id", "__lo", "__hi", F.explode("__rows").alias("__x")).filter("__x.__us between __lo and __hi")
    return each.select(*[F.col("__x")[c].alias(c) for c in fixes.columns], "run_id")


def interp_positions(queries: DataFrame, fixes: DataFrame, on: tuple[str, ...] = (), width: float = 3600.0) -> DataFrame:
    """Linear lat, lon at query times ``t`` (seconds); queries outside the fixes go.
    Swept in cells of ``width`` seconds, so a long track is many tasks."""
    met = bracketing_bucketed(queries, fixes, "t", ["lat", "lon"], width, on).filter("at_lo is not null and at_hi is not null")
    made = [lerp(F.col("t"), F.col("at_lo"), F.col("at_hi"), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) for c in ("lat", "lon")]
    return met.select(*[c for c in queries.columns], *made)


def altitude_at(tx_alt: Column, second: Column) -> Column:
    """Altitude of a run (map of seconds to metres) at a second: that of the last key
    not after it, of the first one before all."""
    keys = F.sort_array(F.map_keys(tx_alt))
    last = F.array_max(F.filter(keys, lambda k: k <= second))
    return F.element_at(tx_alt, F.coalesce(last, F.get(keys, F.lit(0))))


def tx_locations(queries: DataFrame, fixes: DataFrame, alt: float | Column, on: tuple[str, ...] = (), width: float = 3600.0) -> DataFrame:
    """lat, lon, alt of the source at times ``t``, linear in Cartesian axes, clamped at
    the ends. ``alt`` is a number or a column over the queries, such as ``altitude_at``.
    Swept in cells of ``width`` seconds."""
    moving = isinstance(alt, Column)
    x, y, z = to_cartesian(F.col("lat"), F.col("lon"), F.lit(0.0 if moving else float(alt)))
    knots = fixes.select(*on, "t", x.alias("x"), y.alias("y"), z.alias("z"))
    met = bracketing_bucketed(queries, knots, "t", ["x", "y", "z"], width, on)
    axis = lambda c: F.coalesce(lerp(F.col("t"), F.col("at_lo"), F.col("at_hi"), F.col(f"{c}_lo"), F.col(f"{c}_hi")), F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    lat, lon, up = to_gps(axis("x"), axis("y"), axis("z"))
    return met.select(*queries.columns, lat.alias("lat"), lon.alias("lon"), (alt if moving else up).alias("alt"))


def interp_segment_angles(segs: DataFrame, channels: DataFrame) -> DataFrame:
    """Angle per channel, linear between centres of successful segments, ends clamped.

    The first angle that is not null of theta_deg_continuous, theta_deg_norm
    and theta_deg counts, wrapped to [-180, 180). Swept in cells of 1000 channels.
    """
    angle = wrap(F.coalesce("theta_deg_continuous", "theta_deg_norm", "theta_deg"), 360.0)
    knots = segs.filter("success").select(((F.col("receiver_min") + F.col("receiver_max")) / 2.0).alias("x"), angle.alias("theta")).filter("theta is not null")
    met = bracketing_bucketed(channels.select(F.col("channel").cast("double").alias("x"), "channel"), knots, "x", ["theta"], 1000.0)
    made = F.coalesce(lerp(F.col("x"), F.col("at_lo"), F.col("at_hi"), F.col("theta_lo"), F.col("theta_hi")), F.col("theta_lo"), F.col("theta_hi"))
    return met.select("channel", made.alias("theta"))


def redraw_polyline(points: DataFrame, angles: DataFrame, first: int, last: int) -> DataFrame:
    """Channels (cable_id, channel, e, n) with headings ``theta`` in degrees inside
    first..last: step lengths stay, positions follow from the running sum of
    the steps from the channel before; channels outside stay."""
    w = W.partitionBy("cable_id").orderBy("channel")
    held = points.join(angles, "channel", "left")
    le, ln = F.col("e") - F.lag("e").over(w), F.col("n") - F.lag("n").over(w)
    turned = F.col("channel").between(first, last) & F.col("theta").isNotNull() & le.isNotNull()
    step = held.withColumns({"__t": turned, "__l": F.sqrt(le * le + ln * ln)})
    moved = {c: F.when(F.col("__t"), F.col("__l") * f(F.radians("theta"))) for c, f in (("e", F.cos), ("n", F.sin))}
    summed = step.withColumns({f"__s{c}": F.sum(F.coalesce(m, F.lit(0.0))).over(w.rowsBetween(*_BEFORE)) for c, m in moved.items()})
    start = {c: F.last(F.when(~F.col("__t"), F.struct(F.col(c).alias("p"), F.col(f"__s{c}").alias("s"))), True).over(w.rowsBetween(*_BEFORE)) for c in ("e", "n")}
    return summed.select("cable_id", "channel", *[F.when(F.col("__t"), start[c]["p"] + F.col(f"__s{c}") - start[c]["s"]).otherwise(F.col(c)).alias(c) for c in ("e", "n")])


def continuous_angles(df: DataFrame, on: str, order: str, angle: str = "theta", out: str = "theta_cont") -> DataFrame:
    """Angles shifted by multiples of 180 degrees so that no step exceeds 90."""
    w = W.partitionBy(on).orderBy(order)
    jump = F.col(angle) - F.lag(angle).over(w)
    step = F.pmod(jump + 90, F.lit(180.0)) - 90
    return df.withColumn("__d", F.coalesce(step, F.col(angle))).withColumn(out, F.sum("__d").over(w.rowsBetween(*_BEFORE))).drop("__d")
