"""Jump consistent hashing against its definition with whole 64-bit numbers."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from sensorline.llm import shards


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def test_shards_follow_the_definition(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (1, 2, 24, 150):
        for r in shards.with_shards(ids, n).collect():
            assert (r.shard, r.grown_shard) == (jump(key_of(r.doc_id), n), jump(key_of(r.doc_id), n + 1))


def test_only_the_new_shard_takes_rows(spark):
    rows = shards.with_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), 24).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 24 for r in moved) and abs(len(moved) / len(rows) - 1 / 25) < 0.006
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 1.2 * len(rows) / 24


def test_sizes_checksums_and_slots(spark):
    texts = [None, "", "a", "é\U0001f642", "long " * 100_000]
    rows = [(k % 40, texts[k % 5], k) for k in range(200)] + [(5, "same", 0)] * 900 + [(None, "no id", 1), (None, None, 2), (-7, "minus", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SHARD int").repartition(7)
    got = shards.assign(df).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", jump(key_of(d), 24), jump(key_of(d), 25)) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32)))
    for held in slots.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held))) and [x for _, x in held] == sorted(x for _, x in held)
    assert shards.assign(df.limit(0)).collect() == []


def test_a_group_in_many_ranges_is_numbered_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.lit(1).alias("v"))
    got = shards.number_rows(df, ["g"], ["v"], "at").collect()
    assert sorted((r.g, r.at) for r in got) == [(g, k) for g in (0, 1) for k in range(2500)]


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    shards.write_shards(df, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.shard for r in back} == {k: jump(key_of(k), 4) for k in range(500)}


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(shards.ORACLE)
    names = [d[0] for d in cur.description]
    got = shards.assign(spark.read.parquet(f"{sf}/documents.parquet")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
