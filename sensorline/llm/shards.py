"""Stable shards by jump consistent hashing. DataFrame functions only.

A stable key seeds a sequence of draws that says at which shard counts the key
moves, always into the shard that was just added; no ring table is kept. With
one more shard the expected share 1 / (n + 1) of the keys moves and the others
stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.llm.common import fresh_name, let, stage_table, text_or_empty

#: Shards of the registered query.
SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Rows in a file of ``write_shards``, about.
FILE_ROWS = 100_000
#: Fixed value: multiplier of the 64-bit linear congruential generator of jump hashing, in 16-bit limbs from the lowest.
_LIMBS = tuple((2862933555777941757 >> (16 * k)) & 0xFFFF for k in range(4))
_LOW = 0xFFFFFFFF


def stable_key(*cols: Column) -> Column:
    """Struct hi, lo: the first 64 bits of an MD5 of the columns' strings, which are joined by commas (null: empty)."""
    digest = F.md5(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def _next(hi: Column, lo: Column) -> Column:
    """Struct hi, lo of key * multiplier + 1 modulo 2^64; no product passes 2^49."""
    c0, c1, c2, c3 = _LIMBS
    up = lambda x: F.shiftleft(x.bitwiseAND(0xFFFF), 16)
    low = lo * c0 + up(lo * c1) + 1
    high = F.shiftright(low, 32) + F.shiftright(lo * c1, 16) + lo * c2 + up(lo * c3) + hi * c0 + up(hi * c1)
    return F.struct(high.bitwiseAND(_LOW).alias("hi"), low.bitwiseAND(_LOW).alias("lo"))


def jump(key: Column, shards: int) -> Column:
    """Struct shard, grown: the shard of a key (hi, lo) among ``shards`` and among one more.

    The places where a key moves grow, and are gone through up to the larger
    count: about its logarithm many, and never more than there are shards.
    """
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"), key["hi"].alias("hi"), key["lo"].alias("lo"))

    def move(acc: Column, _: Column) -> Column:
        def moved(k: Column) -> Column:
            far = F.floor((acc["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(k["hi"], 1) + 1)))
            held = F.when(acc["j"] < shards, acc["j"]).otherwise(acc["shard"])
            return F.struct(held.alias("shard"), acc["j"].alias("grown"), far.alias("j"), k["hi"].alias("hi"), k["lo"].alias("lo"))

        return F.when(acc["j"] <= shards, let(_next(acc["hi"], acc["lo"]), moved)).otherwise(acc)

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, move), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out long``: the place of a row, from 0 and without gaps, among the rows of
    its ``by`` group in ``order`` (nulls first).

    Groups of any size: rows are dealt out by ranges of group and order, places
    are counted within a range, and the rows of earlier ranges are added. Equal
    rows lie in any order and may be cut apart. ``df`` should read a table.
    """
    tie, part, before = (fresh_name(df, x) for x in ("tie", "part", "before"))
    named = df.withColumn(tie, F.monotonically_increasing_id())
    held = stage_table(named.repartitionByRange(*by, *order, tie).withColumn(part, F.spark_partition_id()), "numbered")
    ranges = held.groupBy(*by, part).agg(F.count("*").alias(before))
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per group and range
    ranges = ranges.select(*[F.col(c).alias(f"{part}_{k}") for k, c in enumerate([*by, part])], F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    within = F.row_number().over(W.partitionBy(*by, part).orderBy(*order, tie))
    placed = held.withColumn(out, within.cast("long") - 1)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{part}_{k}")) for k, c in enumerate([*by, part])))
    return placed.join(ranges, same).withColumn(out, F.col(out) + F.col(before)).select(*df.columns, out)


def with_shards(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """Add ``shard int`` and ``grown_shard int``; both follow from the key and the count alone.

    Columns only, no shuffle. Rows of one key stay together, null is a key like
    any other. Columns of these names are replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "grown_shard")]
    at = fresh_name(docs, "jump")
    made = docs.select(*rest, jump(stable_key(F.col(f"`{key_col}`")), shards).alias(at))
    return made.select(*rest, F.col(f"{at}.shard").alias("shard"), F.col(f"{at}.grown").alias("grown_shard"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the UTF-8 bytes of the text and ROW_BYTES, slot the place within the
    shard in order of doc_id (nulls first), size and checksum; repeated rows
    have slots of their own. A null text counts as empty. Texts are read once
    and never shuffled; only the numbers of a row are.
    """
    raw = F.encode(text_or_empty("text"), "UTF-8")
    own = docs.select("doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    told = stage_table(with_shards(own, shards), "shards")
    placed = number_rows(told, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key_col: str = "doc_id", files: int = 1) -> None:
    """Write ``docs`` as Parquet, a folder ``shard=k`` a shard in about ``files`` files each.

    Rows are dealt to the files of a shard by their whole content, so that a hot
    key fills all files of its shard unless its rows are equal.
    """
    made = with_shards(docs, shards, key_col).drop("grown_shard")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not c.lower() == "shard"]), F.lit(files))
    made.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)


#: Checksum and draws in SQL: bytes are folded one by one, draws by recursion over the keys.
ORACLE = r"""
with recursive d as (
  select row_number() over () as r, doc_id, encode(coalesce(text, '')) as raw, md5(coalesce(cast(doc_id as varchar), '')) as m from documents),
c as (
  select r, doc_id, octet_length(raw) + 8 as size,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::bigint)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) as text_crc32
  from d),
j as (
  select r, ('0x' || substr(m, 1, 8))::hugeint * 4294967296 + ('0x' || substr(m, 9, 8))::hugeint as k, 0::bigint as shard, 0::bigint as grown, 0::bigint as j from d
  union all
  select r, k2, case when j < 24 then j else shard end, j, floor((j + 1) * (2147483648::double / ((k2 // 8589934592)::double + 1)))::bigint
  from (select *, (k * 2862933555777941757 + 1) % 18446744073709551616 as k2 from j where j <= 24))
select c.doc_id, c.size::bigint as size, c.text_crc32::bigint as text_crc32, 'key' as law, s.shard::int as shard,
       row_number() over (partition by s.shard order by c.doc_id nulls first, c.size, c.text_crc32) - 1 as slot, s.grown::int as grown_shard
from c join (select r, max(shard) as shard, max(grown) as grown from j group by r) s on s.r = c.r
"""
