"""Fill-in-the-middle transformation by secondary sort.

Every text is cut into pieces of at most UNITS code points that carry the
row they belong to and their place in the output. One shuffle by row, sorted by
row and place, streams the pieces into incremental digests; what is read from
this stream is cut again at the marks, sorted by its place in the source within
the same partition, and streamed into the digests of the restored texts. A
piece, not a text, is the unit in memory after the cut. (``repartition`` and
``sortWithinPartitions`` are the DataFrame form of
repartitionAndSortWithinPartitions.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import let, text_or_empty

#: Marks before the prefix, the suffix and the middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Order of the parts in the output of each form.
ORDERS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Places of the parts in the source.
_SOURCE = {"prefix": 0, "middle": 1, "suffix": 2}
#: Texts out of 100 that stay plain, and out of those transformed that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: Code points in a piece, at most.
UNITS = 4096
#: Pieces in an Arrow batch, at most.
BATCH = 512

#: A row of the stream: ``row`` and ``place`` sort it; the first piece of a row (place -1) tells its form and lengths instead of text.
PIECE = "row long, place long, body string, doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
_PIECE = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("body", pa.string()), ("doc_id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string())])
_FACTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars")


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """row, text, doc_id, n, form, a and b of every row: the text's cuts are after a and b code points.

    Four numbers h1..h4 drawn from the digest of ``seed:doc_id`` (null: empty)
    decide. Columns only. ``row`` numbers the rows of ``docs``, which must give
    the same rows in the same order if a task runs again, as files do.
    """
    text = text_or_empty("text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    held = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.col("doc_id").cast("string").alias("doc_id"), F.array(*h).alias("h"))
    size = F.char_length("text").cast("long")
    held = held.withColumn("n", size)
    cuts = F.array_sort(F.array(F.get("h", F.lit(0)) % (F.col("n") + 1), F.get("h", F.lit(1)) % (F.col("n") + 1)))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (F.get("h", F.lit(2)) % 100 >= 100 - PLAIN), "plain").when(F.get("h", F.lit(3)) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return held.select("row", "text", "doc_id", "n", form.alias("form"), let(cuts, lambda c: F.struct(F.get(c, F.lit(0)).alias("a"), F.get(c, F.lit(1)).alias("b"))).alias("c")).select("row", "text", "doc_id", "n", "form", "c.a", "c.b")


class _Out:
    """Rows of the stream, gathered into Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, row: int, place: int, body: str | None = None, *facts) -> None:
        self.rows.append((row, place, body, *facts, *[None] * (6 - len(facts))))

    def full(self, least: int = BATCH) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            cols = list(zip(*self.rows))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE)], schema=_PIECE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the outputs, each with its place."""
    out = _Out()
    for batch in batches:
        for k in range(batch.num_rows):
            row, text, doc_id, n, form, a, b = (batch.column(c)[k].as_py() for c in range(7))
            plain = form == "plain"
            out.add(row, -1, None, doc_id, n, form, None if plain else a, None if plain else b - a)
            spans = {"prefix": (0, a), "middle": (a, b), "suffix": (b, n)}
            place = 0
            for mark, (begin, end) in [(MARKS[p], spans[p]) for p in ORDERS[form]] or [("", (0, n))]:
                body = mark + text[begin : min(begin + UNITS, end)]
                while True:
                    out.add(row, place, body)
                    place, begin = place + 1, begin + UNITS
                    yield from out.full()
                    if begin >= end:
                        break
                    body = text[begin : min(begin + UNITS, end)]
    yield from out.full(1)


def pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Pieces of the outputs of all rows, a row's pieces together and in order."""
    cut = plan(docs, seed).mapInArrow(_cut, PIECE)
    return cut.repartition("row").sortWithinPartitions("row", "place")


class _Parts:
    """Reads an output piece by piece and tells which part each stretch of text
    belongs to; marks may be cut apart by the pieces."""

    def __init__(self, form: str) -> None:
        self.order, self.part, self.rest = list(ORDERS[form]), None, ""

    def read(self, body: str) -> Iterator[tuple[str, str]]:
        if not self.order and self.part is None:  # plain
            yield "prefix", body
            return
        held = self.rest + body
        while self.order:
            at = held.find(MARKS[self.order[0]])
            if at < 0:
                break
            if at:
                yield self.part, held[:at]
            self.part = self.order.pop(0)
            held = held[at + len(MARKS[self.part]) :]
        keep = len(MARKS["prefix"]) - 1 if self.order else 0
        self.rest = held[len(held) - keep :] if keep else ""
        if len(held) > keep:
            yield self.part, held[: len(held) - keep]

    def end(self) -> Iterator[tuple[str, str]]:
        if self.rest:
            yield self.part, self.rest


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each output, its facts at the end of the row, and its stretches with their places in the source."""
    out, now, facts, state, parts, place = _Out(), None, None, None, None, 0

    def close() -> None:
        nonlocal place
        for part, body in parts.end():
            out.add(now, (_SOURCE[part] << 40) + place, body)
        out.add(now, 3 << 40, None, *facts, state.hexdigest())

    for batch in batches:
        rows = batch.to_pydict()
        for k, (row, at, body) in enumerate(zip(rows["row"], rows["place"], rows["body"])):
            if at < 0:
                if now is not None:
                    close()
                now, facts, state, place = row, [rows[f][k] for f in _FACTS], hashlib.sha256(), 0
                parts = _Parts(facts[2])
                continue
            state.update(body.encode())
            for part, stretch in parts.read(body):
                out.add(row, (_SOURCE[part] << 40) + place, stretch)
                place += 1
            yield from out.full()
    if now is not None:
        close()
    yield from out.full(1)


_RESULT = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text: its facts and both digests."""
    state = hashlib.sha256()
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [*_FACTS, "output_sha256", "restored_sha256"]
    for batch in batches:
        rows, made = batch.to_pydict(), []
        for k, body in enumerate(rows["body"]):
            if body is not None:
                state.update(body.encode())
            else:
                made.append((*[rows[f][k] for f in _FACTS], rows["output_sha256"][k], state.hexdigest()))
                state = hashlib.sha256()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row.

    A null text is empty and stays plain; so do texts that hold a mark. Repeated
    rows give repeated results, rows of one doc_id with other texts are
    transformed each by itself, other columns of ``docs`` are not looked at.
    One shuffle; the second sort stays within the partitions of the first.
    """
    streamed = pieces(docs, seed).mapInArrow(_digest, PIECE)
    made = streamed.sortWithinPartitions("row", "place").mapInArrow(_restored, _RESULT)
    kind = docs.schema["doc_id"].dataType
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text with its whole output."""
    facts, parts = None, []
    schema = pa.schema([("doc_id", pa.string()), ("form", pa.string()), ("output", pa.string())])

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (facts[0], facts[2], "".join(parts))], schema=schema)

    for batch in batches:
        rows = batch.to_pydict()
        for k, body in enumerate(rows["body"]):
            if body is None:
                if facts is not None:
                    yield whole()
                facts, parts = [rows[f][k] for f in _FACTS], []
            else:
                parts.append(body)
    if facts is not None:
        yield whole()


def outputs(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, form and output (the transformed text) of every row."""
    made = pieces(docs, seed).mapInArrow(_joined, "doc_id string, form string, output string")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form came from, as a column."""

    def between(first: str, then: str | None) -> Column:
        begin = F.locate(MARKS[first], output) + len(MARKS[first])
        return F.substring(output, begin, F.locate(MARKS[then], output) - begin if then else F.char_length(output))

    parts = {f: {p: between(p, then) for p, then in zip(order, [*order[1:], None])} for f, order in ORDERS.items() if order}
    whole = lambda f: F.concat(*[parts[f][p] for p in sorted(_SOURCE, key=_SOURCE.get)])
    return F.when(form == "psm", whole("psm")).when(form == "spm", whole("spm")).otherwise(output)


ORACLE = r"""
with h as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
g as (
  select *, ('0x' || substr(d, 1, 8))::bigint % (n + 1) as x, ('0x' || substr(d, 9, 8))::bigint % (n + 1) as y,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(d, 17, 8))::bigint % 100 >= 90 then 'plain'
              when ('0x' || substr(d, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, least(x, y)) as prefix, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) as middle, substr(t, greatest(x, y) + 1) as suffix from g)
select doc_id, n::bigint as n, form, case when form <> 'plain' then least(x, y) end::bigint as prefix_chars,
       case when form <> 'plain' then greatest(x, y) - least(x, y) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
