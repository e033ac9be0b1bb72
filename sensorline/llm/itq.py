"""Near-duplicate vectors by iterative quantisation and multi-index hashing.

A sample of unit vectors is turned onto its principal axes; from there
alternating steps learn rotations whose signs lose least, which spreads the
sample over the codes. Every vector gets the sign bits of several such
rotations, cut into substrings; each substring indexes a Hamming table of its
own. Vectors that meet in a table are reranked by the cosine of the original
vectors. Two vectors of cosine 0.98 agree on a 16-bit substring with
probability about 0.35, so sixteen tables miss such a pair with probability
0.001; closer pairs far less.

The axes go through the origin, as the cosine does: about the mean, the bits of
one tight cluster would be noise. Where the vectors of a label have a mean of
some length, such bits are not balanced and buckets fill. Full buckets are compared
whole, block by block, so that no pair that meets is left out; a label whose tables
hold more pairs than the label itself is one bucket, which costs less and finds all.

On demand (``exact=False``) a full bucket whose vectors lie wide apart is split by
signs about the label's mean, learned in the same way, by as many as the logarithm
of its size asks for. That takes far fewer pairs and misses some that link.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.llm.common import stage_table
from sensorline.llm.graph import connected_components

COSINE = 0.98
#: Vectors the rotations are learned from, at most (a documented bound, chosen by a hash of the vector).
SAMPLE_ROWS = 8_000
SAMPLE_ROUNDS = 30
BITS, TABLES = 16, 16
#: Vectors of a bucket that counts as full, what splitting leaves in one about, and the bits there are for it.
FULL, SPLIT_TO, FINE_BITS = 256, 24, 24
#: A full bucket is compared whole if its pairs are on average within this many times the distance that links.
NEAR = 3.0
#: Turned coordinates that measure how far apart the vectors of a bucket lie.
SPREAD_AXES = 16
#: Vectors of a block; a fuller bucket is compared block by block, in as many tasks.
BLOCK = 1024
#: Rows of one comparing task, about.
TASK_ROWS = 4_000


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (array of float or double) and usable: labelled, of a length,
    without null or non-finite components and not zero."""
    given = rows.schema[vector_col].dataType
    v = F.col(f"`{vector_col}`")
    v = v if isinstance(getattr(given, "elementType", None), T.FloatType) else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0)
    usable = F.coalesce(fine & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull(), F.lit(False))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"), usable.alias("usable"))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 20) -> np.ndarray:
    """Matrix (dimension x bits) whose signs are the code bits."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    turned = sample @ axes
    rng = np.random.default_rng(seed)
    out = []
    while sum(m.shape[1] for m in out) < bits:
        rotation, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
        for _ in range(SAMPLE_ROUNDS):
            code = np.where(turned @ rotation >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(code.T @ turned)
            rotation = (u @ w).T
        out.append(axes @ rotation)
    return np.hstack(out)[:, :bits]


def substrings(unit: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the vectors, one of ``bits`` signs per table."""
    bit = (unit @ planes >= 0).reshape(len(unit), TABLES, bits)
    return bit @ (1 << np.arange(bits)[::-1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a column of arrays, and the start and length of each row (0 for null)."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths, lengths


def label_means(distinct: DataFrame) -> DataFrame:
    """label, size and mean of the unit vectors of each label of more than FULL vectors
    of that size. Batches are summed before the shuffle."""
    kind = distinct.schema["label"].dataType

    def run(batches):
        for batch in batches:
            flat, first, lengths = _rows(batch.column(1))
            names, which = np.unique(np.array([repr(x) for x in batch.column(0).to_pylist()]), return_inverse=True)
            group = which * (int(lengths.max(initial=0)) + 1) + lengths
            out = []
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                n = int(lengths[mine[0]])
                out.append((batch.column(0)[int(mine[0])].as_py(), n, len(mine), _unit(flat[first[mine][:, None] + np.arange(n)]).sum(0)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(0).type), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.float64()))], names=["label", "size", "n", "s"])

    schema = T.StructType([T.StructField("label", kind), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    parts = distinct.select("label", "v").mapInArrow(run, schema).select("label", "size", "n", F.posexplode("s").alias("axis", "x"))
    sums = parts.groupBy("label", "size", "axis").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).filter(F.col("n") > FULL)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("axis", (F.col("x") / F.col("n")).alias("m")))), lambda p: p["m"])
    return sums.groupBy("label", "size").agg(ordered.alias("mean"))


def index(distinct: DataFrame) -> DataFrame:
    """Rows (node, copies, label, v) of distinct vectors with ``keys`` (signs about
    the origin, one key per table), ``fine`` (signs about the label's mean, 0 in
    small labels) and ``turned``, some coordinates of the unit vector."""
    spark = distinct.sparkSession
    means = stage_table(label_means(distinct), "label-means").withColumnRenamed("label", "l")
    held = distinct.join(means, (F.col("label") == F.col("l")) & (F.size("v") == F.col("size")), "left").select("node", "copies", "label", "v", "mean")
    sizes = [r.n for r in distinct.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # a row per length in use
    models = {}
    for n in sizes:
        same = held.filter(F.size("v") == n)
        share = min(1.0, SAMPLE_ROWS / max(1, same.count()))
        rows = same.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v", "mean").limit(2 * SAMPLE_ROWS).collect()
        unit = _unit(np.array([r.v for r in rows]))
        off = np.array([u - np.array(r["mean"]) for u, r in zip(unit, rows) if r["mean"] is not None])
        models[n] = learn_rotations(unit, BITS * TABLES), learn_rotations(off, FINE_BITS * TABLES) if len(off) else None
    sent = spark.sparkContext.broadcast(models)  # dimension x (BITS + FINE_BITS) x TABLES numbers per length

    def run(batches):
        for batch in batches:
            (flat, first, lengths), (m_flat, m_first, m_lengths) = _rows(batch.column(3)), _rows(batch.column(4))
            keys, fine = np.zeros((len(lengths), TABLES), np.int32), np.zeros((len(lengths), TABLES), np.int32)
            turned = np.zeros((len(lengths), SPREAD_AXES), np.float32)
            for n in np.unique(lengths):
                mine = np.flatnonzero(lengths == n)
                planes, about = sent.value[int(n)]
                unit = _unit(flat[first[mine][:, None] + np.arange(n)])
                keys[mine] = substrings(unit, planes, BITS)
                axes = min(SPREAD_AXES, planes.shape[0])
                turned[mine, :axes] = unit @ planes[:, :axes]
                some = np.flatnonzero(m_lengths[mine] == n)
                if about is not None and len(some):
                    fine[mine[some]] = substrings(unit[some] - m_flat[m_first[mine[some]][:, None] + np.arange(n)], about, FINE_BITS)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, fine, turned)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["node", "copies", "label", "v", "keys", "fine", "turned"])

    made = [T.StructField("keys", T.ArrayType(T.IntegerType())), T.StructField("fine", T.ArrayType(T.IntegerType())), T.StructField("turned", T.ArrayType(T.FloatType()))]
    return held.mapInArrow(run, T.StructType([*held.schema.fields[:4], *made]))


def split_keys(indexed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """node, copies, label, v and ``keys array<long>``, the final key of every table:
    those of full buckets whose vectors lie wide apart go on with fine bits."""
    cells = indexed.select("node", "label", "turned", F.size("v").alias("size"), F.posexplode(F.arrays_zip("keys", "fine")).alias("place", "k")).select("node", "label", "turned", "size", "place", "k.keys", "k.fine")
    at = ["label", "size", "place", "keys"]
    full = stage_table(cells.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") > FULL), "full-buckets")
    plain = indexed.select("node", "copies", "label", "v", F.col("keys").cast("array<long>").alias("keys"))
    if not full.take(1):
        return plain
    # the sum of the variances of some axes of a rotation that spreads them evenly stands for all
    axes = F.least(F.col("size"), F.lit(SPREAD_AXES))
    spread = cells.join(full, at).groupBy(*at).agg(F.first("n").alias("n"), sum((F.var_pop(F.get("turned", F.lit(k))) for k in range(SPREAD_AXES)), F.lit(0.0)).alias("var"))
    wide = spread.filter(F.col("var") * F.col("size") / axes >= NEAR * (1 - cosine))
    bits = F.least(F.lit(FINE_BITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / SPLIT_TO)))).cast("int")
    wide = stage_table(wide.select(*at, bits.alias("bits")), "wide-buckets")
    if not wide.take(1):
        return plain
    final = F.when(F.col("bits").isNull(), F.col("keys").cast("long")).otherwise(F.xxhash64("keys", F.floor(F.col("fine") / F.pow(F.lit(2), FINE_BITS - F.col("bits")))))
    keyed = cells.drop("turned").join(wide, at, "left").select("node", F.struct("place", final.alias("k")).alias("x")).groupBy("node").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["k"]).alias("keys"))
    return indexed.select("node", "copies", "label", "v").join(keyed, "node")


def whole_keys(indexed: DataFrame) -> DataFrame:
    """node, copies, label, v and ``keys array<long>``, the keys of every table; one
    key for vectors of a label and length whose tables hold more pairs than they make."""
    cells = indexed.select("label", F.size("v").alias("size"), F.posexplode("keys").alias("place", "key"))
    counts = cells.groupBy("label", "size", "place", "key").agg(F.count("*").alias("n"))
    held = counts.groupBy("label", "size").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum(F.when(F.col("place") == 0, F.col("n"))).alias("n"))
    one = stage_table(held.filter(F.col("pairs") > F.col("n") * (F.col("n") - 1)).select(F.col("label").alias("l"), "size"), "whole-labels")
    met = indexed.join(one, (F.col("label") == F.col("l")) & (F.size("v") == F.col("size")), "left")
    keys = F.when(F.col("size").isNotNull(), F.array(-F.col("size").cast("long"))).otherwise(F.col("keys").cast("array<long>"))
    return met.select("node", "copies", "label", "v", keys.alias("keys"))


def compare_buckets(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one task's buckets: (node, partner, links). ``links`` counts the
    vectors linked to ``node`` by pairs that this bucket is the first table to
    hold, copies included; ``partner`` is a smaller node it is connected to here,
    or null."""
    found = []
    rows = rows.sort_values(["unit", "block"], kind="stable").reset_index(drop=True)
    keys = rows["keys"].to_numpy()
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    block, tables = rows["block"].to_numpy(), rows["place"].to_numpy()
    vectors = rows["v"].to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], rows["unit"].to_numpy()[1:] != rows["unit"].to_numpy()[:-1], [True]]))
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a < 2:
            continue
        unit = _unit(np.array(vectors[a:b].tolist()))
        first = int(np.searchsorted(block[a:b], 1))  # rows of the pair's first block
        left, right = (np.arange(b - a), np.arange(b - a)) if first == b - a else (np.arange(first), np.arange(first, b - a))
        linked = unit[left] @ unit[right].T >= cosine
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        keep = x < y
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        table = tables[a]
        k = np.array(keys[a:b].tolist(), np.int64)
        fresh = ~(k[x, :table] == k[y, :table]).any(1)
        links = np.bincount(x[fresh], copies[a:b][y[fresh]], b - a) + np.bincount(y[fresh], copies[a:b][x[fresh]], b - a)
        ids = node[a:b]
        partner = ids.copy()
        np.minimum.at(partner, x, ids[y])
        np.minimum.at(partner, y, ids[x])
        # vectors of one component that share no smallest neighbour still need an edge each
        low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        while True:
            at = np.argsort(ids)
            top = partner[at[np.searchsorted(ids[at], partner)]]
            at_low, at_high = at[np.searchsorted(ids[at], low)], at[np.searchsorted(ids[at], high)]
            least = np.minimum(top[at_low], top[at_high])
            new = top.copy()
            np.minimum.at(new, at_low, least)
            np.minimum.at(new, at_high, least)
            if (new == partner).all():
                break
            partner = new
        some = (links > 0) | (partner != ids)
        found.append(pd.DataFrame({"node": ids[some], "partner": np.where(partner[some] != ids[some], partner[some], -1), "links": links[some].astype(np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({"node": [], "partner": [], "links": []}).astype("int64")


def links(indexed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, partner, links) rows of all buckets; see ``compare_buckets``.

    A bucket of more than BLOCK vectors is split into blocks by a hash of the
    node, and each pair of blocks is a unit of its own. Every pair of a bucket
    lies in one unit, so a full bucket becomes many small tasks and no pair is
    lost; only links that no earlier table holds are counted.
    """
    cells = indexed.select("node", "copies", "label", "v", "keys", F.posexplode("keys").alias("place", "key"))
    full = indexed.select("label", F.posexplode("keys").alias("place", "key")).groupBy("label", "place", "key").agg(F.count("*").alias("n")).filter("n > 1")
    full = stage_table(full, "shared-buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    held = cells.join(full, ["label", "place", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks").cast("long")).cast("int"))
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    within = F.struct("label", "place", "key", low.alias("low"), high.alias("high"))
    units = paired.select("node", "copies", "v", "keys", "place", F.when(low == high, 0).when(F.col("own") == low, 0).otherwise(1).alias("block"), F.xxhash64(within).alias("unit"))
    n = full.agg((F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK))).alias("n")).first().n or 0
    tasks = max(1, math.ceil(n / TASK_ROWS))
    return units.withColumn("task", F.pmod("unit", F.lit(tasks))).groupBy("task").applyInPandas(lambda rows: compare_buckets(rows, cosine), "node long, partner long, links long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, exact: bool = True) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Vectors link only within a label. Equal vectors are reduced to one before
    the index, with the number of their copies; each copy links with the
    others. Vectors that cannot link (null, empty, zero, null or non-finite
    components, null label) and rows without a vec_id have no links, their own
    vec_id as component_id, and stay. Vectors of different lengths never link.
    Without ``exact`` full buckets of far vectors are split, see ``split_keys``.
    """
    given = clean_vectors(rows)
    digest = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    good = given.filter("usable")
    keyed = good.select("vec_id", *digest)
    distinct = good.select("vec_id", "label", "v", *digest).groupBy("h1", "h2").agg(F.min_by(F.struct("label", "v"), "vec_id").alias("x"), F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    made = stage_table(index(stage_table(distinct.select("node", "copies", "x.label", "x.v"), "vectors")), "vector-index")
    indexed = stage_table(whole_keys(made) if exact else split_keys(made, cosine), "vector-keys")
    found = stage_table(links(indexed, cosine), "vector-links")
    classes = connected_components(found.filter("partner >= 0").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = distinct.select("h1", "h2", "node", "copies").join(counts, "node", "left").join(classes, "node", "left")
    named = groups.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = keyed.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = given.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
