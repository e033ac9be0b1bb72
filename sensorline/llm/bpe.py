"""Byte-level BPE encoding and decoding.

Method: a segment tree over the ranks of adjacent pairs. Its root yields the
leftmost pair of lowest rank; a merge changes three leaves (the merged pair's
and its two neighbours'), each in logarithmic time, until no leaf holds a rank.
Ranks never depend on anything outside a pre-token, so a pre-token is encoded
once and kept in a bounded table; new short ones are merged in step, a tree per
row of an array.

The vocabulary file is read on the driver and sent to the tasks as one
broadcast of fixed size (about 50,000 merges).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.llm.common import fresh_name, span_hashes

#: Pre-tokens kept per Python worker; the table is emptied when it is full.
CACHE_WORDS = 400_000
#: Pre-tokens of more characters are not kept, and of more bytes not merged in step.
KEYED_CHARS = 128
STEP_BYTES = 256
#: Characters of text encoded before a batch is handed on.
CHUNK_CHARS = 1_000_000
_INF = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in character of each byte: bytes that print stand for
    themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    out.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return out


def load_vocabulary(path: str) -> dict:
    """Merge ranks, byte ids, token bytes and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pre = spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without a normalizer is needed")
    if model.get("ignore_merges") or pre.get("add_prefix_space"):
        raise ValueError("ignore_merges and add_prefix_space are not supported")
    ids = model["vocab"]
    to_byte = {c: b for b, c in byte_alphabet().items()}
    raw = {i: bytes(to_byte[c] for c in t) for t, i in ids.items() if all(c in to_byte for c in t)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    raw.update({i: t.encode() for t, i in special.items()})
    return {
        "merges": merges,
        "byte_ids": [ids[c] for _, c in sorted(byte_alphabet().items())],
        "raw": raw,
        "special": special,
        "classes": character_classes(),
    }


#: Fixed value: how the vocabulary's makers cut a text into pre-tokens (tests hold the cuts against it).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairTree:
    """Segment tree over pair ranks; every node holds the least of
    ``rank * width + position`` below it, so equal ranks yield the leftmost."""

    def __init__(self, leaves: list[int]):
        self.width = width = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = nodes = [_INF] * width + leaves + [_INF] * (width - len(leaves))
        for k in range(width - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b

    def put(self, at: int, value: int) -> None:
        nodes, k = self.nodes, self.width + at
        nodes[k] = value
        k >>= 1
        while k:
            a, b = nodes[2 * k], nodes[2 * k + 1]
            least = a if a < b else b
            if nodes[k] == least:
                return
            nodes[k] = least
            k >>= 1


def merge_ids(ids: list[int], merges: dict) -> list[int]:
    """All merges of one pre-token, lowest rank first and leftmost among equals."""
    n = len(ids)
    if n < 2:
        return ids
    find = merges.get
    ids = list(ids)

    def leaf(i: int, j: int) -> int:
        hit = find((ids[i], ids[j]))
        return hit[0] * n + i if hit else _INF

    tree = PairTree([leaf(i, i + 1) for i in range(n - 1)])
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    while (least := tree.nodes[1]) != _INF:
        i = least % n
        j = after[i]
        ids[i] = find((ids[i], ids[j]))[1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            tree.put(j, _INF)
        if k >= 0:
            before[k] = i
            tree.put(i, leaf(i, k))
        else:
            tree.put(i, _INF)
        if (h := before[i]) >= 0:
            tree.put(h, leaf(h, i))
    return [x for x in ids if x >= 0]


class MergeTable:
    """Ranks of pairs as sorted arrays, for looking up many pairs at once."""

    def __init__(self, merges: dict):
        keys = np.fromiter(((a << 20) | b for a, b in merges), np.int64, len(merges))
        hits = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], hits[order, 0]
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        self.merged[hits[:, 0]] = hits[:, 1]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _INF for pairs that do not merge or have a side below 0."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _INF)


def merge_many(ids: np.ndarray, table: MergeTable) -> np.ndarray:
    """Merge many short pre-tokens in step, one segment tree per row.

    ``ids`` holds a pre-token per row, filled up with -1 to a power of two plus
    one. Merged-away places become -1. Each step takes the root of every row
    that still has a merge and updates its three leaves.
    """
    rows, n = ids.shape
    width = n - 1
    place = np.arange(width)

    def value(rank, at):
        return np.where(rank == _INF, _INF, (rank << 20) | at)

    tree = np.full((rows, 2 * width + 1), _INF)
    tree[:, width : 2 * width] = value(table.rank(ids[:, :-1], ids[:, 1:]), place)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    count = (ids >= 0).sum(1)
    after = np.where(np.arange(1, n + 1) < count[:, None], np.arange(1, n + 1), -1)
    before = np.tile(np.arange(-1, n - 1), (rows, 1))
    live = np.arange(rows)
    while True:
        root = tree[live, 1]
        some = root != _INF
        live, root = live[some], root[some]
        if not live.size:
            return ids
        i = root & 0xFFFFF
        j = after[live, i]
        k = after[live, j]
        h = before[live, i]
        merged = table.merged[root >> 20]
        ids[live, i] = merged
        ids[live, j] = -1
        after[live, i] = k
        more, less = k >= 0, h >= 0
        before[live[more], k[more]] = i[more]
        tree[live, width + j] = _INF
        tree[live, width + i] = value(table.rank(merged, np.where(more, ids[live, k], -1)), i)
        tree[live[less], width + h[less]] = value(table.rank(ids[live[less], h[less]], merged[less]), h[less])
        if width > 1:
            at = width + np.stack([np.minimum(j, width - 1), i, np.maximum(h, 0)])
            row = np.broadcast_to(live, at.shape)
            while at[0, 0] > 1:
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])


#: Classes of code points; two values past Unicode end a text or stand for a special token.
_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_STOP = 0x110000


def character_classes() -> np.ndarray:
    """Class of every code point, and _END for the stops after them."""
    out = np.zeros(_STOP + 4096, np.uint8)
    every = [chr(c) for c in range(_STOP) if not 0xD800 <= c < 0xE000]
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, "".join(every))]] = kind
    out[_STOP:] = _END
    return out


_SUFFIXES = [tuple(map(ord, s)) for s in ("s", "t", "re", "ve", "m", "ll", "d")]


def pre_token_starts(code: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First places of the pre-tokens of ``code`` (each stop is one of its own).

    Same cuts as PRE_TOKENS gives, but by whole-array steps: runs of one class;
    the last blank of a run of white space joins the run after it if it is a
    space and stands alone otherwise; an apostrophe that starts a pre-token
    takes the letters of a contraction with it.
    """
    kind = classes[code]
    n = len(code)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    blank = kind == _SPACE
    last = np.zeros(n, bool)  # last place of a run of white space with a pre-token after it
    last[:-1] = blank[:-1] & ~blank[1:] & (kind[1:] != _END)
    start |= last
    joins = np.flatnonzero(last & (code == 32))
    start[joins + 1] = False
    quote = np.flatnonzero((code == 39) & start)
    for ends in _SUFFIXES:
        hit = quote[quote + len(ends) < n]
        for k, c in enumerate(ends):
            hit = hit[code[hit + 1 + k] == c]
        start[hit + 1] = False
        after = hit + 1 + len(ends)
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[k] .. starts[k]+counts[k]-1 for all k, one after another."""
    total = np.cumsum(counts)
    return np.repeat(starts - total + counts, counts) + np.arange(total[-1] if len(total) else 0)


def _differ(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether one[a:a+size] and other[b:b+size] differ, for spans of at least one place."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_or.reduceat(one[_spread(a, size)] != other[_spread(b, size)], np.cumsum(size) - size)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: dict):
        self.merges, self.byte_ids = vocabulary["merges"], vocabulary["byte_ids"]
        self.special, self.classes = vocabulary["special"], vocabulary["classes"]
        self.table = MergeTable(self.merges)
        self.byte_table = np.array(self.byte_ids, np.int64)
        names = sorted(self.special, key=len, reverse=True)
        self.names = names
        self.parts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        raw = vocabulary["raw"]
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted keys of the pre-tokens met so far
        self.entry = np.zeros(0, np.int64)  # and their places below
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shown_at, self.shown_size, self.shown = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)  # their code points

    def _strangers(self, code, start, size, kinds, shown, which, alone) -> np.ndarray:
        """Pre-tokens whose code points are not those of their key: of the first one
        here, or of the one the table holds."""
        odd = np.zeros(len(start), bool)
        first = shown[which]
        odd[size != size[first]] = True
        other = np.flatnonzero(~odd & ~alone & (first != np.arange(len(start))))
        odd[other] = _differ(code, start[other], code, start[first[other]], size[other])
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, kinds), len(self.known) - 1)
            held = np.flatnonzero((self.known[at] == kinds) & ~alone[shown])
            place, mine = self.entry[at[held]], shown[held]
            wrong = self.shown_size[place] != size[mine]
            same = np.flatnonzero(~wrong)
            wrong[same] = _differ(code, start[mine[same]], self.shown, self.shown_at[place[same]], size[mine[same]])
            if wrong.any():
                odd |= np.isin(which, held[wrong])
        return odd

    def words(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[first:first+size], one after another, and their
        numbers of ids: short ones merged in step, the others one by one."""
        width = np.where(size > 1, 1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(np.int64), 0)
        flat, counts, order = [], [], []
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            step = max(1, 400_000 // (int(w) + 1))
            for part in (mine[k : k + step] for k in range(0, len(mine), step)):
                if w > STEP_BYTES:
                    made = [merge_ids(self.byte_table[data[first[k] : first[k] + size[k]]].tolist(), self.merges) for k in part]
                    counts.append(np.array([len(x) for x in made]))
                    flat.append(np.array([i for x in made for i in x], np.int64))
                else:
                    ids = np.full((len(part), w + 1), -1)
                    ids[np.repeat(np.arange(len(part)), size[part]), _spread(np.zeros(len(part), np.int64), size[part])] = self.byte_table[data[_spread(first[part], size[part])]]
                    if w:
                        ids = merge_many(ids, self.table)
                    keep = ids >= 0
                    counts.append(keep.sum(1))
                    flat.append(ids[keep])
                order.append(part)
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, counts, order = map(np.concatenate, (flat, counts, order))
        at = np.argsort(order)
        return flat[_spread((np.cumsum(counts) - counts)[at], counts[at])], counts[at]

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, a stop after each, and the texts' bytes;
        special tokens are stops too and have no bytes."""
        parts, plain, end = [], [], np.array([_STOP], np.uint32)
        for text in texts:
            pieces = self.parts(text) if self.names and any(s in text for s in self.names) else (text,)
            for p in pieces:
                if p in self.special:
                    parts.append(np.array([_STOP + 1 + self.names.index(p)], np.uint32))
                elif p:
                    parts.append(np.frombuffer(p.encode("utf-32-le"), np.uint32))
                    plain.append(p)
            parts.append(end)
        return np.concatenate(parts), np.frombuffer("".join(plain).encode(), np.uint8)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, data = self._codes(texts)
        start = pre_token_starts(code, self.classes)
        size = np.diff(start, append=len(code))
        stop = code[start] >= _STOP
        ends = np.flatnonzero(code[start] == _STOP)
        keys = span_hashes(code, start, np.minimum(size, KEYED_CHARS))
        keys[stop] = code[start[stop]]
        alone = (size > KEYED_CHARS) & ~stop
        if len(self.known) > CACHE_WORDS:
            self._forget()
        while True:  # hashes are not trusted: a pre-token that only shares one stands alone
            key = keys.copy()
            key[alone] = np.arange(alone.sum(), dtype=np.uint64) + np.uint64(_STOP + 4096)
            kinds, shown, which = np.unique(key, return_index=True, return_inverse=True)
            odd = self._strangers(code, start, size, kinds, shown, which, alone) & ~alone
            if not odd.any():
                break
            alone |= odd
        at = np.minimum(np.searchsorted(self.known, kinds), max(len(self.known) - 1, 0))
        new = np.flatnonzero((self.known[at] != kinds) | alone[shown] if len(self.known) else np.ones(len(kinds), bool))
        place = self.entry[at] if len(self.known) else np.zeros(len(kinds), np.int64)
        if new.size:
            is_stop = stop[shown[new]]
            plain = shown[new[~is_stop]]
            width = np.where(code >= _STOP, 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
            at_byte = np.concatenate([[0], np.cumsum(width)])
            made, counts = self.words(data, at_byte[start[plain]], at_byte[start[plain] + size[plain]] - at_byte[start[plain]])
            stops = [[] if c == _STOP else [self.special[self.names[c - _STOP - 1]]] for c in code[start[shown[new[is_stop]]]]]
            order = np.concatenate([new[~is_stop], new[is_stop]])
            made = np.concatenate([made, np.array([i for x in stops for i in x], np.int64)])
            counts = np.concatenate([counts, np.array([len(x) for x in stops], np.int64)])
            place[order] = len(self.count) + np.arange(len(order))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, made])
            long = np.where(alone[shown[order]], 0, size[shown[order]])
            self.shown_at = np.concatenate([self.shown_at, len(self.shown) + np.cumsum(long) - long])
            self.shown_size = np.concatenate([self.shown_size, long])
            self.shown = np.concatenate([self.shown, code[_spread(start[shown[order]], long)]])
            keep = order[~alone[shown[order]]]
            held, entries = np.concatenate([self.known, kinds[keep]]), np.concatenate([self.entry, place[keep]])
            by = np.argsort(held)
            self.known, self.entry = held[by], entries[by]
        token = place[which]
        counts = self.count[token]
        ids = self.flat[_spread(self.first[token], counts)]
        per_text = np.add.reduceat(counts, np.concatenate([[0], ends[:-1] + 1]))
        if alone.any():
            self._forget()
        return ids, per_text

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids; what is not UTF-8 becomes U+FFFD."""
        size = self.raw_size[ids]
        data = self.raw_bytes[_spread(self.raw_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        if len(data) < 1 << 31:
            made = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            try:
                return made.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


def _send(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_vocabulary(path))


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of a little over CHUNK_CHARS at most plus one row."""
    part = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    return [(int(a), int(b)) for a, b in zip(edge[:-1], edge[1:]) if b > a]


def _mapped(df: DataFrame, col: str, name: str, kind: T.DataType, sizes, make) -> DataFrame:
    """``df`` with one more column that tasks build from ``col``.

    ``make()`` returns the function of an Arrow array; an existing column of
    that name is replaced. Batches are cut by the size of their values, so
    very long values do not pile up.
    """
    rest = [c for c in df.columns if c.lower() != name.lower()]
    held = fresh_name(df, "input")
    given = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{col}`").alias(held))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, kind)])
    n = len(rest)

    def run(batches):
        one = make()
        for batch in batches:
            values = batch.column(n)
            for a, b in _cuts(sizes(values)):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], one(values.slice(a, b - a))], names=[*rest, name])

    return given.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col array<int>`` with the token ids of the whole text.

    Null and empty texts give an empty array. Strings of special tokens inside
    a text give the special token's id. Repeated rows stay; ``ids_col``
    replaces a column of that name. No shuffle.
    """
    sent = _send(df.sparkSession, vocabulary_path)
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def make():
        codec = Codec(sent.value)

        def one(texts):
            ids, counts = codec.encode_many([t or "" for t in texts.to_pylist()])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), type=kind)

        return one

    return _mapped(df, text_col, ids_col, T.ArrayType(T.IntegerType(), False), lambda v: pc.fill_null(pc.binary_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64), make)


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col string``: the text of the ids, special tokens included.

    Null gives the empty text; bytes that are not UTF-8 give U+FFFD; an id
    that the vocabulary lacks is an error.
    """
    sent = _send(df.sparkSession, vocabulary_path)

    def make():
        codec = Codec(sent.value)

        def one(lists):
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            return codec.decode_many(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)

        return one

    return _mapped(df, ids_col, text_col, T.StringType(), lambda v: 4 * pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64), make)


def digests(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    coded = encode(df.select("doc_id", "text"), vocabulary_path)
    back = decode(coded.select("doc_id", "ids"), vocabulary_path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
