"""Near-duplicates of texts by BagMinHash: signatures, bands and exact overlap.

A text is the multiset of its shingles of five words (a shorter text is one
shingle). Every shingle owns Poisson processes over its weight, cut at powers
of two: [0,1), [1,2), [2,4), ... A process of width w yields points at rate
m * w; each point falls on one of m places and on a level of its interval, and
counts if the level is below the shingle's weight in the text. The place keeps
the point of least value. Two texts agree on a place with the probability of
their weighted Jaccard similarity, because points depend on shingle, interval
and number only. Points beyond the largest place value cannot matter, so a
process stops there: a text costs about m * log(m) points, not m per shingle.

Places are banded; texts that share a band are verified by the overlap of
their whole multisets. Classes are connected components of verified links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import GAP_CHARS, mix64 as _mix, span_hashes, stage_table
from sensorline.llm.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: Places of a band and bands. A pair of similarity 0.8 misses all bands with probability 8e-5, of 0.85 with 2e-7.
ROWS, BANDS = 7, 40
CHUNK_CHARS = 500_000
#: Points made at once.
POINTS = 500_000
#: Texts of a block of a full band, rows of a comparing task (about) and numbers of a matrix at once.
BLOCK = 256
TASK_ROWS = 500
COMPARE_CELLS = 4_000_000


_STEP = np.uint64(0x9E3779B97F4A7C15)
_GAPS = np.array([ord(c) for c in GAP_CHARS], np.uint32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and the number of words of each text."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    gap = np.isin(code, _GAPS)
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    return span_hashes(code, start, end - start), np.bincount(owner, minlength=len(texts))


def shingle_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: owner, hash and how often, by owner and hash."""
    words, n = word_hashes(texts)
    first = np.cumsum(n) - n
    length = np.minimum(n, SHINGLE)
    made = np.where(n > 0, n - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), made)
    at = np.repeat(first - np.cumsum(made) + made, made) + np.arange(made.sum())
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    key = length[owner].astype(np.uint64) * _STEP
    for k in range(SHINGLE):
        key = np.where(k < length[owner], _mix(key * np.uint64(5) + padded[at + k] + _STEP), key)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(new)
    return owner[place], key[place], np.diff(place, append=len(key))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_signatures(owner: np.ndarray, key: np.ndarray, count: np.ndarray, texts: int, places: int) -> np.ndarray:
    """Signature of each text, ``texts x places`` hashes; texts without shingles keep 0."""
    weight = np.bincount(owner, count, texts)
    best = np.full(texts * places, np.inf)
    out = np.zeros(texts * places, np.uint64)
    # one row per process: intervals [0,1), [1,2), [2,4), ... that begin below the weight
    who, keys, below, low, width = [owner], [key], [count], [np.zeros(len(key), np.int64)], [np.ones(len(key), np.int64)]
    edge = 1
    while (more := count > edge).any():
        who.append(owner[more])
        keys.append(key[more])
        below.append(count[more])
        low.append(np.full(more.sum(), edge))
        width.append(np.full(more.sum(), edge))
        edge *= 2
    who, keys, below, low, width = map(np.concatenate, (who, keys, below, low, width))
    seed = _mix(keys + low.astype(np.uint64) * _STEP)
    limit = (math.log(places) + 2) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        mine = np.flatnonzero(open_[who])
        value, k, ahead = np.zeros(len(mine)), 0, 1
        slots, values, marks = [], [], []
        while len(mine):
            go = np.zeros(len(mine), bool)
            step = max(1, POINTS // ahead)
            for at in (slice(i, i + step) for i in range(0, len(mine), step)):
                m = mine[at]
                count_to = np.array([(k + j) * int(_STEP) % (1 << 64) for j in range(1, ahead + 1)], np.uint64)
                mark = _mix(seed[m, None] + count_to)
                wait = -np.log(_unit(_mix(mark ^ _STEP))) / (places * width[m, None])
                wait[:, 0] += value[at]
                when = np.cumsum(wait, axis=1)
                value[at], go[at] = when[:, -1], when[:, -1] <= limit[who[m]]
                row, col = np.nonzero(when <= limit[who[m], None])
                m, mark, when = m[row], mark[row, col], when[row, col]
                good = low[m] + (_unit(_mix(mark + _STEP)) * width[m] - 1e-12).astype(np.int64) < below[m]
                slots.append(who[m[good]] * places + (mark[good] % np.uint64(places)).astype(np.int64))
                values.append(when[good])
                marks.append(mark[good])
            mine, value = mine[go], value[go]
            k, ahead = k + ahead, min(256, 2 * ahead if k else 1)
        slots, values, marks = map(np.concatenate, (slots, values, marks))
        np.minimum.at(best, slots, values)
        least = values == best[slots]
        out[slots[least]] = marks[least]
        open_ &= np.isinf(best.reshape(texts, places)).any(1)
        best.reshape(texts, places)[open_] = np.inf
        limit[open_] *= 2
    return out.reshape(texts, places)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One hash per text and band; bands never share a key."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for k in range(rows):
        key = _mix(key * np.uint64(3) + parts[:, :, k])
    return key.view(np.int64)


def _runs(sizes: list[int]):
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= CHUNK_CHARS:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def band_table(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, content (digest of the text) and bands (empty for texts without a word)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs([len(t) for t in texts]):
                part = texts[a:b]
                owner, key, count = shingle_counts(part)
                keys = band_keys(bag_signatures(owner, key, count, len(part), rows * bands), rows, bands)
                some = np.bincount(owner, minlength=len(part)) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in part]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel())),
                    ],
                    names=["doc_id", "content", "bands"],
                )

    return given.mapInArrow(run, "doc_id long, content string, bands array<long>")


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair; 0 without shingles."""
    n = len(left)
    (a, ka, ca), (b, kb, cb) = shingle_counts(left), shingle_counts(right)
    owner, key, count = np.concatenate([a, b]), np.concatenate([ka, kb]), np.concatenate([ca, cb])
    order = np.lexsort((key, owner))
    owner, key, count = owner[order], key[order], count[order]
    twin = np.flatnonzero((owner[1:] == owner[:-1]) & (key[1:] == key[:-1]))
    shared = np.bincount(owner[twin], np.minimum(count[twin], count[twin + 1]), n)
    return shared / np.maximum(np.bincount(owner, count, n) - shared, 1)


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of doc_id whose whole texts overlap by ``similarity`` or more."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            left, right = ([t or "" for t in batch.column(k).to_pylist()] for k in (2, 3))
            for x, y in _runs([len(p) + len(q) for p, q in zip(left, right)]):
                good = overlaps(left[x:y], right[x:y]) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays([c.slice(x, y - x).filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def compare_bands(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Pairs (a, b) of classes that some pair of texts of one unit links, as far
    as they connect classes that other pairs of the task leave apart.

    All pairs of a unit are compared at once: a shingle that comes c times is a
    column for each of 1..c, and the product of the 0/1 matrix with itself
    counts the shared ones.
    """
    found = set()
    rows = rows.sort_values(["unit", "block"], kind="stable").reset_index(drop=True)
    unit, block, group, text = (rows[c].to_numpy() for c in ("unit", "block", "class", "text"))
    edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    for a, b in zip(edge[:-1], edge[1:]):
        n, mine = b - a, group[a:b]
        first = int(np.searchsorted(block[a:b], 1))
        if n < 2 or (mine == mine[0]).all():
            continue
        owner, key, count = shingle_counts([t or "" for t in text[a:b]])
        weight = np.bincount(owner, count, n)
        level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, key = np.repeat(owner, count), _mix(np.repeat(key, count) + level.astype(np.uint64) * _STEP)
        _, column, times = np.unique(key, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        owner = owner[shared]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(1, COMPARE_CELLS // n)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            at = slice(*np.searchsorted(column, [start, start + width]))
            part = np.zeros((n, min(width, int(column[-1]) + 1 - start)), np.float32)
            part[owner[at], column[at] - start] = 1
            both += part @ part.T
        alike = both >= (similarity - 1e-9) * np.maximum(weight[:, None] + weight - both, 1)
        alike &= mine[:, None] < mine
        if first < n:
            side = np.arange(n) >= first
            alike &= side[:, None] != side
        found.update((int(mine[x]), int(mine[y])) for x, y in zip(*np.nonzero(alike)))
    return pd.DataFrame(_forest(found), columns=["a", "b"]).astype("int64")


def _forest(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Some of the pairs that connect the same classes without a cycle."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top.setdefault(y, y)
        return x

    out = []
    for a, b in sorted(pairs):
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def class_links(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that texts of a common band link, of rows band, text_id, class.

    A band of more than BLOCK texts becomes a unit for each pair of its blocks,
    so all its pairs are compared, in many small tasks, and none is ever a row;
    a task gives fewer rows than it has classes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.col("text").cast("string").alias("text"))
    sizes = stage_table(members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "band-sizes")
    own = F.pmod(F.xxhash64(F.lit(4), "text_id"), F.col("blocks").cast("long")).cast("int")
    held = members.join(sizes, "band").withColumn("own", own).join(texts, "text_id")
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = paired.select("class", "text", F.when((low == high) | (F.col("own") == low), 0).otherwise(1).alias("block"), F.xxhash64("band", low, high).alias("unit"))
    n = members.join(sizes, "band").agg(F.sum("blocks").alias("n")).first().n or 0
    tasks = max(1, math.ceil(n / TASK_ROWS))
    linked = units.withColumn("task", F.pmod("unit", F.lit(tasks))).groupBy("task").applyInPandas(lambda rows: compare_bands(rows, similarity), "a long, b long")
    return linked.distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept (doc_id = class_id)
    of every row.

    Rows of one doc_id are one document. Equal texts are one class, however
    many; texts without a word (null, empty, blank) are compared with nothing
    but equal ids; rows without a doc_id have class_id null and stay.

    Copies are reduced to one text before anything is paired. In a band, every
    text meets the smallest id first, and of those hubs each text is verified
    with the one it shares most bands with. Then all pairs of the bands that
    still hold several classes are compared, block by block. A class of
    thousands around its smallest id so costs one verification a text, and no
    link between classes is lost.
    """
    table = stage_table(band_table(docs, rows, bands), "bands")
    with_words = table.filter("size(bands) > 0 and doc_id is not null")
    texts = stage_table(with_words.groupBy("content").agg(F.min("doc_id").alias("text_id")), "texts")
    single = with_words.join(texts, (with_words.content == texts.content) & (with_words.doc_id == texts.text_id)).select("text_id", F.explode("bands").alias("band"))
    hubs = stage_table(single.groupBy("band").agg(F.min("text_id").alias("hub"), F.max("text_id").alias("last")).filter("hub < last").drop("last"), "hubs")
    members = stage_table(single.join(hubs, "band"), "band-members")
    stars = members.filter("text_id > hub").groupBy("text_id", "hub").agg(F.count("*").alias("n"))
    best = stars.groupBy(F.col("text_id").alias("b")).agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a"))
    first = stage_table(verified(best, docs, similarity), "links")
    classes = connected_components(first)
    placed = members.join(classes, members.text_id == classes.node, "left").select("band", "text_id", F.coalesce("component", "text_id").alias("class"))
    split = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("band")
    apart = stage_table(placed.join(split, "band"), "bands-apart")
    second = stage_table(class_links(apart, docs, similarity), "links")
    if second.take(1):
        classes = connected_components(first.unionByName(second))
    named = texts.join(classes, texts.text_id == classes.node, "left").select("content", F.coalesce("component", "text_id").alias("class_id"))
    known = table.filter("size(bands) > 0 and doc_id is not null").select("doc_id", "content").join(named, "content").select("doc_id", "class_id")
    other = table.filter("not (size(bands) > 0 and doc_id is not null)").select("doc_id", F.col("doc_id").alias("class_id"))
    return known.unionByName(other).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: one document of each class."""
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return stay.unionByName(docs.filter("doc_id is null"))
