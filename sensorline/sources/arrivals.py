"""Arrival files: nested JSON of channel -> packet -> sample, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NESTED = "map<string,map<string,bigint>>"


def nest_rows(texts: DataFrame, outer: str = "channel", inner: str = "packet") -> DataFrame:
    """packet, channel, sample_idx of rows with a JSON text ``value``."""
    whole = texts.select(F.explode(F.from_json("value", NESTED)).alias("o", "m")).select("o", F.explode("m").alias("i", "sample_idx"))
    return whole.select(F.col("o").cast("int").alias(outer), F.col("i").cast("int").alias(inner), "sample_idx").select("packet", "channel", "sample_idx")


def read_arrivals(spark: SparkSession, paths: str | list[str], outer: str = "channel") -> DataFrame:
    """Arrivals of nested JSON files; ``outer`` says which key comes first."""
    inner = "packet" if outer == "channel" else "channel"
    return nest_rows(spark.read.text(paths, wholetext=True), outer, inner)


def to_nested(arrivals: DataFrame, by: str = "packet") -> DataFrame:
    """One row per outer key: key and the JSON object of its arrivals, keys in order."""
    inner = "channel" if by == "packet" else "packet"
    entries = F.array_sort(F.collect_list(F.struct(F.col(inner).alias("k"), F.col("sample_idx").alias("v"))))
    text = lambda m: F.to_json(F.map_from_entries(F.transform(m, lambda x: F.struct(x["k"].cast("string"), x["v"]))))
    return arrivals.groupBy(F.col(by).alias("key")).agg(entries.alias("m")).select("key", text(F.col("m")).alias("json"))


def write_arrivals(arrivals: DataFrame, path: str, by: str = "packet") -> None:
    """JSON lines {"key": ..., "arrivals": {...}} or, for tables, ``write.parquet``."""
    to_nested(arrivals, by).select(F.concat(F.lit('{"'), F.col("key").cast("string"), F.lit('":'), "json", F.lit("}"))).write.mode("overwrite").text(path)
