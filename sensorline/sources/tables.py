"""Small tables: polylines, source tracks, runs, look-ups, result files, decoded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorline.functions.scalars import parse_ts

_GEO = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_polyline(spark: SparkSession, path: str, axis_order: tuple[str, str, str] = ("lon", "lat", "alt"), whole: bool = True) -> DataFrame:
    """cable_id, part, seq, lat, lon, alt of GeoJSON lines, one or many per feature.

    Entries follow ``axis_order``; a missing third entry gives a null altitude.
    cable_id is a feature's place in its collection, which is a file, or a line
    of a file if not ``whole``.
    """
    root = spark.read.text(path, wholetext=whole).select(F.from_json("value", _GEO).alias("f"))
    feature = root.select(F.posexplode("f.features").alias("cable_id", "x"))
    lines = F.from_json("x.geometry.coordinates", "array<array<array<double>>>")
    single = F.array(F.from_json("x.geometry.coordinates", "array<array<double>>"))
    parts = feature.select("cable_id", F.posexplode(F.when(F.col("x.geometry.type") == "LineString", single).otherwise(lines)).alias("part", "line"))
    points = parts.select("cable_id", "part", F.posexplode("line").alias("seq", "p"))
    return points.select("cable_id", "part", "seq", *[F.get("p", F.lit(axis_order.index(a))).alias(a) for a in ("lat", "lon", "alt")])


def polyline_features(line: DataFrame) -> DataFrame:
    """cable_id, json: a GeoJSON feature of each line, with its length in ``properties``."""
    point = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "alt"))), lambda p: F.array_compact(F.array(p["lon"], p["lat"], p["alt"])))
    g = line.groupBy("cable_id").agg(point.alias("c"), F.max("cum").alias("length"))
    return g.select("cable_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("length").alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))).alias("json"))


def write_polyline(line: DataFrame, path: str) -> None:
    """FeatureCollection of the lines: one text file per cable, joined nowhere."""
    polyline_features(line).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "json", F.lit("]}"))).write.mode("overwrite").text(path)


def read_source_track(spark: SparkSession, path: str) -> DataFrame:
    """ts, lat, lon of a CSV with a header; rows that do not parse are dropped."""
    raw = spark.read.csv(path, header=True, schema="datetime string, lat double, lon double", mode="DROPMALFORMED")
    return raw.select(parse_ts(F.col("datetime")).alias("ts"), "lat", "lon").dropna()


#: Types of the columns of a run table; others stay text.
RUN_TYPES = {"run_id": "int", "offset_samples": "long", "fs": "double", "period_samples": "long", "n_packets": "int", "channel_spacing": "double", "n_channels": "int"}
RUN_TIMES = ("start_ts", "stop_ts", "seq_start_ts")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a CSV with a header, typed; what does not parse is null. tx_alt may be a
    number or a JSON map of seconds to metres."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')

    def typed(c: str) -> Column:
        if c == "tx_alt":
            return altitude_map(F.col(c))
        return parse_ts(F.col(c)) if c in RUN_TIMES else F.col(c).try_cast(RUN_TYPES[c]) if c in RUN_TYPES else F.col(c)

    return raw.select(*[typed(c).alias(c) for c in raw.columns])


def altitude_map(text: Column) -> Column:
    """map<int,double>; a plain number holds from second 0 on."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.create_map(F.lit(0), number)).otherwise(F.transform_keys(F.from_json(text, "map<string,double>"), lambda k, _: k.try_cast("int")))


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """date, run, json of a day registry {date: {run: {...}}}."""
    root = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("date", "runs"))
    return root.select("date", F.explode("runs").alias("run", "json"))


#: How clashing rows and columns of two registries are decided.
MODES = ("raise", "ignore", "replace", "ignore-existing", "replace-existing")


def upsert_runs(old: DataFrame, new: DataFrame, on_exist: str = "raise", keys: tuple[str, ...] = ("date", "run_id")) -> DataFrame:
    """Merge run registries with the same columns.

    Rows of one side only stay. Rows of both: ``raise`` is an error, ``ignore``
    keeps the old row, ``replace`` takes the new one, ``ignore-existing`` fills
    the old row's nulls, ``replace-existing`` overwrites with the new row's values.
    """
    if on_exist not in MODES:
        raise ValueError(f"on_exist must be one of {', '.join(MODES)}")
    if on_exist == "raise" and new.join(old, list(keys), "left_semi").take(1):
        raise ValueError("some runs exist already")
    a, b = old.alias("a"), new.alias("b")
    match = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both = F.col(f"a.{keys[0]}").isNotNull() & F.col(f"b.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if on_exist in ("ignore", "replace"):
            return F.when(both, y if on_exist == "replace" else x).otherwise(F.coalesce(x, y))
        return F.coalesce(y, x) if on_exist == "replace-existing" else F.coalesce(x, y)

    return a.join(b, match, "full").select(*[pick(c).alias(c) for c in old.columns])


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """band, f_lo, f_hi of {"band": [lo, hi]}."""
    root = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("band", "f"))
    return root.select("band", F.get("f", F.lit(0)).alias("f_lo"), F.get("f", F.lit(1)).alias("f_hi"))


def read_hop(spark: SparkSession, path: str) -> DataFrame:
    """chip, slot of a file with a number per line (a few hundred lines, read whole)."""
    lines = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("chip", "v")).select("chip", F.col("v").cast("double").cast("int").alias("slot"))


def read_transducer(spark: SparkSession, path: str) -> DataFrame:
    """x (Hz) and y (dB) of a datasheet in kHz and dB."""
    return spark.read.csv(path, header=True, schema="f double, tx double", mode="DROPMALFORMED").dropna().select((F.col("f") * 1000).alias("x"), F.col("tx").alias("y"))


def name_parts(path: Column) -> tuple[Column, Column]:
    """start_channel and array_length that a result file's name carries."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"start_ch_(\d+)_arrlen_(\d+)", k), F.lit("")).cast("int")
    return part(1), part(2)


def read_doa_results(spark: SparkSession, path: str) -> DataFrame:
    """packet, start_channel, array_length, json of result files {packet: {...}}."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    start, length = name_parts(F.col("p"))
    return raw.select(start.alias("start_channel"), length.alias("array_length"), F.explode(F.from_json("value", "map<string,string>")).alias("packet", "json")).withColumn("packet", F.col("packet").cast("int"))


def reception_key(channel: Column, packet: Column) -> Column:
    """C<channel>P<packet>."""
    return F.concat(F.lit("C"), channel.cast("string"), F.lit("P"), packet.cast("string"))


def write_decoded(decoded: DataFrame, path: str) -> None:
    """CSV of decoded packets, keyed by reception."""
    decoded.select(reception_key(F.col("channel"), F.col("packet")).alias("key"), *[c for c in decoded.columns if c not in ("channel", "packet")]).write.mode("overwrite").csv(path, header=True)


def read_decoded(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """channel, packet and ``columns`` (as in "snr double, bits string") of files of
    ``write_decoded``; rows whose key is no reception have null channel and packet."""
    raw = spark.read.csv(path, header=True, schema=f"key string, {columns}")
    number = lambda k: F.regexp_extract("key", "^C([0-9]+)P([0-9]+)$", k).try_cast("long")
    return raw.select(number(1).alias("channel"), number(2).alias("packet"), *raw.columns[1:])


def export_features(points: DataFrame, kind: str, every: int = 1, order: str = "packet", label: Column | None = None, width: float = 1000.0) -> DataFrame:
    """json: a point feature of every ``every``-th row of (lat, lon, ...) in order,
    with ``kind`` and a label. Lines go by ``polyline_features``.

    Rows are numbered in blocks of ``width`` of a numeric ``order``, from the
    number of rows in earlier blocks; any other order is one block."""
    from pyspark.sql import Window as W
    from pyspark.sql import types as T

    numeric = isinstance(points.schema[order].dataType, T.NumericType)
    block = F.coalesce(F.floor(F.col(order) / width).cast("double"), F.lit(float("-inf"))) if numeric else F.lit(0.0)
    held = points.withColumn("__b", block)
    counts = held.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    numbered = held.withColumn("__i", F.row_number().over(W.partitionBy("__b").orderBy(order)) - 1).join(before, "__b", "left")
    placed = numbered.filter((F.col("__i") + F.coalesce("__o", F.lit(0))) % every == 0)
    tag = F.col(order).cast("string") if label is None else label
    return placed.select(order, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("kind"), tag.alias("label")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))).alias("json"))
