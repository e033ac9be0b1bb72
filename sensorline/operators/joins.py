"""Join and scan shapes that the optimiser does not find by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def point_interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, on: tuple[str, ...] = (), closed: str = "left", how: str = "inner") -> DataFrame:
    """Rows of ``points`` and ``intervals`` with the point inside the interval.

    Cells of ``width`` make it an equi-join: an interval visits every cell that
    it touches, a point lies in one. ``closed`` is left, right, both or none.
    Choose ``width`` near the usual interval length. ``how`` is inner or left.
    """
    cell = "__cell"
    p = points.withColumn(cell, F.floor(F.col(at) / width))
    i = intervals.withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    above = F.col(at) >= F.col(low) if closed in ("left", "both") else F.col(at) > F.col(low)
    below = F.col(at) <= F.col(high) if closed in ("right", "both") else F.col(at) < F.col(high)
    keys = [cell, *on]
    right = i.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in i.columns])
    match = above & below
    for k in keys:
        match = match & (p[k] == F.col(f"__r_{k}"))
    return p.join(right, match, how).drop(cell, *[f"__r_{k}" for k in keys])


def within_join(left: DataFrame, right: DataFrame, a: str, b: str, tol: float, on: tuple[str, ...] = (), closed: bool = True, how: str = "inner") -> DataFrame:
    """Rows with \\|a - b\\| <= tol (< tol if not ``closed``): right rows visit the
    cells next to their own, so the cell and ``on`` are equi-keys."""
    cell = "__cell"
    width = tol if tol > 0 else 1.0
    l = left.withColumn(cell, F.floor(F.col(a) / width).cast("long"))
    near = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(b) / width).cast("long") + d))
    keys = [cell, *on]
    r = right.withColumn(cell, near)
    r = r.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in r.columns])
    gap = F.abs(F.col(a) - F.col(b))
    match = gap <= tol if closed else gap < tol
    for k in keys:
        match = match & (l[k] == F.col(f"__r_{k}"))
    return l.join(r, match, how).drop(cell, *[f"__r_{k}" for k in keys])


def bracketing(queries: DataFrame, knots: DataFrame, at: str, values: list[str], on: tuple[str, ...] = (), bucket: Column | None = None) -> DataFrame:
    """As-of join both ways: for each query the last knot at or before it and the
    first at or after it, as ``at_lo``, ``v_lo``, ``at_hi``, ``v_hi``.

    Both streams are united and swept in order of ``at`` and back; ties put knots
    first, so a query on a knot meets it on both sides. ``on`` partitions the
    sweep. Outside the knots' span a side is null.
    """
    q_cols = [c for c in queries.columns if c not in (at, *on)]
    k = knots.select(*on, at, F.struct(F.col(at).alias("at"), *values).alias("__k"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in q_cols], F.lit(0).alias("__q"))
    q = queries.select(*on, at, F.lit(None).cast(k.schema["__k"].dataType).alias("__k"), *q_cols, F.lit(1).alias("__q"))
    order = [F.col(at), F.col("__q")]
    w = W.partitionBy(*on) if on else W.partitionBy(F.lit(0))
    seen = lambda by: F.last("__k", ignorenulls=True).over(w.orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    swept = k.unionByName(q).withColumn("__lo", seen(order))
    # swept backwards: a frame that ends with the partition is read anew for each row
    swept = swept.withColumn("__next", seen([c.desc() for c in order]))
    swept = swept.withColumn("__hi", F.when(F.col("__lo.at") == F.col(at), F.col("__lo")).otherwise(F.col("__next")))
    out = swept.filter("__q = 1")
    sides = [F.col(f"__{s}.{c}").alias(f"{c}_{s}") for s in ("lo", "hi") for c in ("at", *values)]
    return out.select(*on, at, *q_cols, *sides)


def bracketing_bucketed(queries: DataFrame, knots: DataFrame, at: str, values: list[str], width: float, on: tuple[str, ...] = ()) -> DataFrame:
    """``bracketing`` for long series: one without a key, or hot ones among those of ``on``.

    Cells of ``width`` (and ``on``) partition the sweep; every cell with queries
    also gets the last knot before it and the first after it, found by a window
    over one row per cell. ``at`` must be numeric.
    """
    cell = F.floor(F.col(at) / width).alias("cell")
    keys = (*on, "cell")
    k = knots.select(*on, F.col(at), *values, cell)
    q = queries.withColumn("cell", F.floor(F.col(at) / width))
    ends = k.groupBy(*keys).agg(F.max_by(F.struct(at, *values), at).alias("last"), F.min_by(F.struct(at, *values), at).alias("first"))
    cells = q.select(*keys).distinct().join(ends, list(keys), "full")
    w = W.partitionBy(*on) if on else W.partitionBy(F.lit(0))  # a row per cell, not per knot
    side = lambda end, by: F.last(end, True).over(w.orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    edges = cells.select(*keys, side("last", F.col("cell")).alias("before"), side("first", F.col("cell").desc()).alias("after"))
    carried = edges.select(*keys, F.explode(F.array("before", "after")).alias("e")).filter("e is not null").select(*keys, "e.*")
    return bracketing(q, k.unionByName(carried), at, values, keys).drop("cell")


def lerp(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear value at x; y0 where both knots coincide."""
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def running_sum(df: DataFrame, value: Column, out: str, block: Column, order: list[Column], on: tuple[str, ...] = ()) -> DataFrame:
    """Running sum in two levels: within blocks, plus the total of earlier blocks.

    A plain window would put a whole series into one task. Here the windows are
    over the rows of a block and over one row per block. ``block`` must grow
    with ``order``.
    """
    held = df.withColumn("__b", block).withColumn("__v", value)
    totals = held.groupBy(*on, "__b").agg(F.sum("__v").alias("__t"))
    w = (W.partitionBy(*on) if on else W.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*on, "__b", F.coalesce(F.sum("__t").over(w), F.lit(0.0)).alias("__o"))
    inner = held.withColumn("__s", F.sum("__v").over(W.partitionBy(*on, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(before, [*on, "__b"]).withColumn(out, F.col("__s") + F.col("__o")).drop("__b", "__v", "__s", "__o")
