"""Token counts through a cache keyed by content and tokenizer digests.

Every text is reduced to the digest of its normal form; the digests are joined
to the counts stored for this version of the tokenizer. Only distinct digests
without a count are encoded, and their counts are appended to the cache, a
Parquet table in a shared folder.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorline.llm import bpe
from sensorline.llm.common import fresh_name, shared_dir, stage_table, text_or_empty

_CACHE = "content string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normal_form(text: Column) -> Column:
    """What is counted: null counts as the empty text. White space, case and
    special strings change the count, so nothing else is folded."""
    return F.coalesce(text, F.lit(""))


def _counter(path: str, vocabulary):
    """Function of a list of texts that gives their numbers of tokens."""
    if vocabulary is not None:
        codec = bpe.Codec(vocabulary)
        return lambda texts: codec.encode_many(texts)[1]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in model.encode(texts, num_threads=1)])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: np.array([len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)])


def encode_counts(misses: DataFrame, path: str) -> DataFrame:
    """content, n_tokens of rows content, text. Byte-level BPE files are counted
    by the codec of this package, which gives the library's ids; the others by
    their library, whose file must then lie at ``path`` on every machine."""
    try:
        sent = misses.sparkSession.sparkContext.broadcast(bpe.load_vocabulary(path)) if path.endswith(".json") else None
    except ValueError:
        sent = None

    def run(batches):
        count = _counter(path, sent and sent.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())], np.int64)
            for a, b in bpe._cuts(sizes):
                made = count(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.asarray(made, np.int64))], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, _CACHE)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """Stored counts, one per digest (jobs that ran at the same time may both
    have appended one); None if nothing is stored yet."""
    try:
        return spark.read.schema(_CACHE).parquet(cache_path).dropDuplicates(["content"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(df: DataFrame, tokenizer_path: str, cache_dir: str, text_col: str = "text", count_col: str = "n_tokens", normalise=normal_form) -> DataFrame:
    """Add ``count_col long``: the tokens of the whole text, without added ones.

    Null texts count as empty (0 tokens for byte-level BPE). Repeated texts are
    encoded once; repeated rows stay. Texts that the cache knows are not
    encoded. An existing ``count_col`` is replaced.
    """
    spark = df.sparkSession
    cache_path = f"{cache_dir.rstrip('/')}/{tokenizer_digest(tokenizer_path)}"
    text = normalise(F.col(f"`{text_col}`"))
    digest = F.sha2(text, 256)
    known = read_cache(spark, cache_path)
    misses = df.select(digest.alias("content"), text.alias("text"))
    if known is not None:
        misses = misses.join(known, "content", "left_anti")
    misses = misses.dropDuplicates(["content"])
    encode_counts(misses, tokenizer_path).write.mode("append").parquet(cache_path)
    rest = [c for c in df.columns if c.lower() != count_col.lower()]
    key = fresh_name(df, "content")
    # written, so that the join can split the rows of a text with very many copies
    counts = stage_table(read_cache(spark, cache_path), "token-counts").select(F.col("content").alias(key), F.col("n_tokens").alias(count_col))
    held = df.withColumn(key, digest) if count_col.lower() not in map(str.lower, df.columns) else df.select(*[F.col(f"`{c}`") for c in rest], digest.alias(key))
    return held.join(counts, key).select(*[F.col(f"`{c}`") for c in rest], F.col(count_col))


def document_counts(documents: DataFrame, tokenizer_path: str, limit: int = 512, cache_dir: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Without ``cache_dir`` a new, empty
    cache in the shared folder is filled."""
    cache_dir = cache_dir or f"{shared_dir(documents.sparkSession)}/token-cache-{uuid.uuid4().hex}"
    sized = documents.select("doc_id", "text", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, tokenizer_path, cache_dir)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
