"""Helpers shared by the corpus operators: scratch tables, word splitting, digests."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset on
    a local master (tests) a temporary folder of this machine is taken.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_corpus_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext._corpus_scratch = own
    return own


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a reread, not the
    steps before it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stage_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stage_table`` that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; no words for an empty or blank text."""
    return F.array_remove(F.split(text, GAP_PATTERN, -1), "")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more code points are hashed one by one.
STEP_CHARS = 64


def span_hashes(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each span code[start:start+size] of code points (uint32).

    All spans take their next code point at once and are scrambled after each,
    so no sum over places can cancel out. Long spans take BLAKE2b.
    """
    order = np.argsort(-size, kind="stable")
    first, length = start[order], size[order]
    out = mix64(length.astype(np.uint64) + _STEP)
    for k in range(min(STEP_CHARS, int(length[0]) if len(length) else 0)):
        n = int(np.searchsorted(-length, -k))  # spans of more than k code points
        out[:n] = mix64(out[:n] * np.uint64(5) + code[first[:n] + k] + _STEP)
    for k in range(int(np.searchsorted(-length, -STEP_CHARS))):
        digest = hashlib.blake2b(code[first[k] : first[k] + length[k]].tobytes(), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    back = np.empty_like(out)
    back[order] = out
    return back
