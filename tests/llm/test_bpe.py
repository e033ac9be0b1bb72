import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sensorline.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "'s", "'re", "'", "ll", " ", "  ", "\n", "\t", "é", "日", "1", "²", "!", "-", "<|endoftext|>", "<|", "_", "\x1c", "\xa0", "🙂", "T", "ation", " the", "́", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_the_library_on_random_texts(library):
    codec, rng = bpe.Codec(bpe.load_vocabulary(PATH)), random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["é" * 500, "a'll 123 " + "ab" * 3000, "x" * 20001, " " * 5000, "日本" * 900]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tree_yields_the_leftmost_of_the_lowest():
    tree = bpe.PairTree([5 * 8 + 0, 3 * 8 + 1, 3 * 8 + 2])
    assert tree.nodes[1] == 25
    tree.put(1, bpe._INF)
    assert tree.nodes[1] == 26


def test_digests_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, " \n")], "doc_id long, text string")
    got = bpe.digests(docs.select("doc_id", "text").union(odd), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").union(odd).collect()}
    assert len(got) == docs.count() + 4
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("x", 1, "old")], "text string, IDS int, __input string")
    out = bpe.encode(df, PATH)
    assert out.columns == ["text", "__input", "ids"] and out.first().ids == [87]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_counts_come_from_the_cache(spark, sf, library, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    cache = f"file://{tmp_path}/cache"
    first = {r.doc_id: r.n_tokens for r in tokencount.document_counts(docs, PATH, cache_dir=cache).collect()}
    assert first == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    stored = spark.read.parquet(f"{cache}/{tokencount.tokenizer_digest(PATH)}")
    before = stored.count()
    assert before == docs.select("text").distinct().count()
    more = docs.union(spark.createDataFrame([(9000, "new text"), (9001, "new text"), (9002, None)], docs.schema))
    again = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.document_counts(more, PATH, cache_dir=cache).collect()}
    assert {k: v[1] for k, v in again.items() if k < 9000} == first
    assert again[9000] == again[9001] == (8, 2, False) and again[9002] == (0, 0, False)
    assert spark.read.parquet(f"{cache}/{tokencount.tokenizer_digest(PATH)}").count() == before + 2


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(spark, name, tmp_path):
    df = spark.createDataFrame([("Some words, and more.", 0), (None, 0)], T.StructType([T.StructField("text", T.StringType()), T.StructField("N_Tokens", T.IntegerType())]))
    got = tokencount.count_tokens(df, public_tokenizers.path(name), f"file://{tmp_path}").collect()
    assert sorted(r.n_tokens for r in got)[0] == 0 and max(r.n_tokens for r in got) > 4
