"""URL filters by temporal list joins. DataFrame functions only.

A list is a table of dated entries: key, action, listed_at. The entries of a
key become validity intervals that do not overlap, kept as timelines of a few
dozen entries a row. A capture has as keys its address without query, its host
and all domains of two labels or more above it. The most specific key with an
entry that holds when it was fetched decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.llm.common import fresh_name


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def address_of(url: Column) -> Column:
    """Host and path of an address, without query and closing slashes; null without a host."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def host_keys(host: Column) -> Column:
    """(step, key) of a host: itself at step 1, and each domain above it that has two labels or more."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(i.alias("step"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key")))


#: Entries in a row of a timeline.
TIMELINE = 64


def dated_entries(entries: DataFrame) -> DataFrame:
    """key, valid_from, action of dated entries. An entry holds until the key's next
    date. Of entries of one key and date the greatest action in string order
    holds, so a repeat changes nothing; entries without key or date are left out."""
    return entries.filter("key is not null and listed_at is not null").groupBy("key", F.col("listed_at").alias("valid_from")).agg(F.max("action").alias("action"))


def timelines(dated: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (null: still valid) and ``held``: up to TIMELINE entries
    of a key in order of their dates. The intervals of a key do not overlap and leave no gap."""
    place = F.row_number().over(W.partitionBy("key").orderBy("valid_from"))
    placed = dated.withColumn("part", F.floor((place - 1) / TIMELINE))
    rows = placed.groupBy("key", "part").agg(F.min("valid_from").alias("valid_from"), F.array_sort(F.collect_list(F.struct("valid_from", "action"))).alias("held"))
    return rows.select("key", "valid_from", F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from")).alias("valid_to"), "held")


def host_chains(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """host, ``chain``: step, key and first date of the listed keys of each distinct host, nearest first.

    A key that was ever listed stays listed, so its first date says from when it
    can decide: a host has a row per label here, however many entries its
    domains have.
    """
    keys = hosts.filter("host is not null").select("host", F.inline(host_keys(F.col("host"))))
    met = keys.join(listed, "key")
    return met.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("step", "key", "since"))).alias("chain"))


def apply_list(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Add ``matched_level``, ``matched_key`` and ``action`` of the entry that decides.

    The level is address, host, parent (the host without its first label) or
    domain (any further one). All three are null where no entry holds: unlisted
    keys, captures before the first entry, null or malformed addresses, null
    times. The first dates of the address and of the host's chain say which key
    decides; one as-of join with that key's timeline gives the entry. Every join
    gives a capture at most one row, so repeated rows stay as they are, and no
    table holds hosts times entries. A host or key with a third of all captures
    is split by the joins' skew handling; a small list is broadcast by size.
    Columns of these names are replaced.
    """
    rest = [c for c in captures.columns if c.lower() not in ("matched_level", "matched_key", "action")]
    url = F.col(f"`{url_col}`")
    at, address, host, own, chain, near, line = (fresh_name(captures, x) for x in ("at", "address", "host", "own", "chain", "near", "line"))
    out = captures.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{time_col}`").alias(at), address_of(url).alias(address), host_of(url).alias(host))
    dated = dated_entries(entries)
    listed = dated.groupBy("key").agg(F.min("valid_from").alias("since"))
    by_host = host_chains(captures.select(host_of(url).alias("host")).distinct(), listed)
    out = out.join(listed.select(F.col("key").alias(f"{own}_key"), F.col("since").alias(own)), F.col(address) == F.col(f"{own}_key"), "left")
    out = out.join(by_host.select(F.col("host").alias(f"{chain}_host"), F.col("chain").alias(chain)), F.col(host) == F.col(f"{chain}_host"), "left")
    above = F.get(F.filter(chain, lambda k: k["since"] <= F.col(at)), F.lit(0))
    decides = F.when(F.col(own) <= F.col(at), F.struct(F.lit(0).alias("step"), F.col(address).alias("key"))).otherwise(F.when(above.isNotNull(), F.struct(above["step"].alias("step"), above["key"].alias("key"))))
    out = out.select(*[F.col(f"`{c}`") for c in rest], at, decides.alias(near)).withColumn(f"{near}_key", F.col(f"{near}.key"))
    held = timelines(dated).select(*[F.col(c).alias(f"{line}_{c}") for c in ("key", "valid_from", "valid_to", "held")])
    since, until = F.col(f"{line}_valid_from"), F.col(f"{line}_valid_to")
    out = out.join(held, (F.col(f"{near}_key") == F.col(f"{line}_key")) & (since <= F.col(at)) & (until.isNull() | (F.col(at) < until)), "left")
    entry = F.element_at(F.filter(f"{line}_held", lambda e: e["valid_from"] <= F.col(at)), -1)
    step = F.col(f"{near}.step")
    level = F.when(step == 0, "address").when(step == 1, "host").when(step == 2, "parent").when(step > 2, "domain")
    return out.select(*[F.col(f"`{c}`") for c in rest], level.alias("matched_level"), F.col(f"{near}_key").alias("matched_key"), F.when(step.isNotNull(), entry["action"]).alias("action"))


#: The given tables hold neither fetch times nor lists, so both follow from the
#: pages by rule: a page is fetched ``page_id mod 525600`` minutes into 2024, and
#: an address whose page_id is divisible by 16 brings entries for its keys.
_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(f"{_EPOCH} + make_dt_interval(0, 0, cast(page_id % 525600 as int), 0)").alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """Dated entries that follow from the pages: blocks and later releases of
    addresses, hosts, parents and domains of two labels, spread over the year by the id."""
    some = pages.filter("page_id % 16 = 0").select("page_id", "url", host_of(F.col("url")).alias("host"))
    parts, k = F.split("host", r"\."), F.col("page_id")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    domain = F.when(F.size(parts) > 3, last(F.lit(2)))
    parent = F.when(F.size(parts) > 2, last(F.greatest(F.size(parts) - 1, F.lit(1))))
    key = F.when(k % 256 == 0, domain).when(k % 64 == 0, F.col("host")).when(k % 32 == 0, parent).otherwise(address_of(F.col("url")))
    action = F.when(F.floor(k / 16) % 3 == 0, F.lit("allow")).otherwise(F.lit("block"))
    return some.select(key.alias("key"), action.alias("action"), F.expr(f"{_EPOCH} + make_dt_interval(cast((page_id * 37) % 360 as int), 0, 0, 0)").alias("listed_at"))


def filter_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, matched_level, matched_key, action, kept of every page."""
    judged = apply_list(page_captures(pages), page_list(pages))
    return judged.withColumn("kept", F.coalesce(F.col("action") != "block", F.lit(True)))


ORACLE = r"""
with k as (
  select page_id, url, timestamp '2024-01-01 00:00:00' + to_minutes(cast(page_id % 525600 as bigint)) as fetched_at,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host,
         regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path
  from pages),
p as (
  select *, host || path as address, string_split(host, '.') as parts from k),
c as (
  select page_id, url, fetched_at, address, host,
         case when len(parts) > 2 then array_to_string(parts[2:], '.') end as parent,
         case when len(parts) > 3 then array_to_string(parts[-2:], '.') end as domain
  from p),
e as (
  select case when page_id % 256 = 0 then domain when page_id % 64 = 0 then host when page_id % 32 = 0 then parent else address end as key,
         case when (page_id // 16) % 3 = 0 then 'allow' else 'block' end as action,
         timestamp '2024-01-01 00:00:00' + to_days(cast((page_id * 37) % 360 as integer)) as valid_from
  from c where page_id % 16 = 0),
v as (
  select key, valid_from, action, lead(valid_from) over (partition by key order by valid_from) as valid_to
  from (select key, valid_from, max(action) as action from e where key is not null and valid_from is not null group by all)),
s as (select page_id, fetched_at, i, array_to_string(parts[i:], '.') as name from (select *, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) as i from p) where host is not null),
h as (
  select page_id, min(i) as i, arg_min(key, i) as key, arg_min(action, i) as action
  from s join v on key = name and valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to) group by page_id)
select c.page_id, c.url, c.fetched_at,
       case when a.key is not null then 'address' when i = 1 then 'host' when i = 2 then 'parent' when i > 2 then 'domain' end as matched_level,
       coalesce(a.key, h.key) as matched_key,
       coalesce(a.action, h.action) as action,
       coalesce(coalesce(a.action, h.action) <> 'block', true) as kept
from c
left join v a on a.key = c.address and a.valid_from <= c.fetched_at and (a.valid_to is null or c.fetched_at < a.valid_to)
left join h on h.page_id = c.page_id
"""
