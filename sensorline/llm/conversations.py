"""Repair of conversation structure by a persistent dynamic program over edits.

A conversation is to read as an optional system turn and then user and
assistant in turns. The cheapest edits that make it so are found row by row:
each state of the pattern holds the last edit of its best audit, a node linked
to the node before it, so audits share their prefixes. Nodes keep binary-lifting
ancestors with rolling hashes; where two audits cost the same, a search for
their longest common prefix finds the first edit in which they differ. Equal
hashes are believed only if both prefixes end in the same node, which is exact:
a state holds one audit.

Rows are sorted once by conversation and turn over range partitions. A
conversation that lies within a partition and is short is solved there. Any
other is cut into chunks: the program runs over each chunk from every state, and
the small tables of costs and ranks are composed over the chunks of a
partition and then over partitions, forth for the costs and back for the path,
so that no task holds a long conversation. Only the digest of the repaired text
is a stream over its chunks, as a digest must be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.llm.common import GAP_CHARS, GAP_PATTERN, stage_table

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and characters in a chunk, about; a longer conversation is cut.
CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
#: Rolling hash: modulus and base.
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A3C5E7
#: States: nothing yet, after the system turn, after user, after assistant; what each still takes.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
_WANTED = ("u", "u", "a", "u")
_ROLES = {"u": "user", "a": "assistant"}
#: Insertions that close a conversation in each state.
_CLOSING = ("", "II", "I", "")
_LEGAL = frozenset(("su", "ua", "au"))


class Node:
    """The last edit of an audit, linked to the audit before it."""

    __slots__ = ("edit", "depth", "hash", "up")

    def __init__(self, edit: str, parent: Node | None):
        self.edit = edit
        self.depth = parent.depth + 1 if parent else 0
        self.hash = (parent.hash * _BASE + ord(edit)) % _MOD if parent else 0
        self.up: list[Node] = []
        node = parent
        while node is not None:
            self.up.append(node)
            k = len(self.up) - 1
            node = node.up[k] if k < len(node.up) else None


def _lift(node: Node, depth: int) -> Node:
    """Ancestor of a node at ``depth``."""
    while node.depth > depth:
        node = node.up[min(len(node.up), (node.depth - depth).bit_length()) - 1]
    return node


def audit_of(node: Node) -> str:
    edits = []
    while node.up:
        edits.append(node.edit)
        node = node.up[0]
    return "".join(reversed(edits))


def before(x: Node, y: Node) -> bool:
    """Whether the audit of ``x`` comes first in ASCII order (a prefix before its extensions)."""
    if x is y:
        return False
    depth = min(x.depth, y.depth)
    a, b = _lift(x, depth), _lift(y, depth)
    if a is b:
        return x.depth < y.depth
    if a.hash != b.hash:
        # jump over everything in which the two still differ; their parents then end the longest common prefix
        for k in range(len(a.up) - 1, -1, -1):
            if k < len(a.up) and a.up[k].hash != b.up[k].hash:
                a, b = a.up[k], b.up[k]
        if a.up[0] is b.up[0]:
            return a.edit < b.edit
    # equal hashes of different nodes: the hash collided, so the audits themselves decide
    return audit_of(x) < audit_of(y)


class Best:
    """Cost and node of the best audit that ends in each state (None: none does)."""

    __slots__ = ("held",)

    def __init__(self) -> None:
        self.held: list[tuple[int, Node] | None] = [None] * 4

    def offer(self, state: int, cost: int, parent: Node, edit: str) -> bool:
        now = self.held[state]
        if now is not None:
            if now[0] < cost:
                return False
            if now[0] == cost:
                old = now[1]
                if old.up[0] is parent if old.up else False:
                    if old.edit <= edit:
                        return False
                elif not before(Node(edit, parent), old):
                    return False
        self.held[state] = (cost, Node(edit, parent))
        return True


def _inserted(best: Best) -> Best:
    """Allows insertions before the next row."""
    made = Best()
    made.held = list(best.held)
    changed = True
    while changed:
        changed = False
        for state, now in enumerate(made.held):
            if now is not None:
                changed |= made.offer(_NEXT[state][_WANTED[state]], now[0] + INSERT, now[1], "I")
    return made


def advance(best: Best, symbol: str) -> Best:
    """Best audits after a row. ``symbol`` is the class of its role (s, u, a or x),
    in capitals if it is truncated, or D if it must be deleted."""
    made, role = Best(), symbol.lower()
    extra = TRUNCATED if symbol.isupper() else 0
    for state, now in enumerate(_inserted(best).held):
        if now is None:
            continue
        cost, node = now
        made.offer(state, cost + DELETE, node, "D")
        if symbol == "D":
            continue
        if role in _NEXT[state]:
            made.offer(_NEXT[state][role], cost + extra, node, "K")
        made.offer(_NEXT[state][_WANTED[state]], cost + RENAME + extra, node, "R")
    return made


def run_from(symbols: str, start: int) -> Best:
    best = Best()
    best.held[start] = (0, Node("", None))
    for symbol in symbols:
        best = advance(best, symbol)
    return best


@lru_cache(maxsize=1 << 16)
def solve(symbols: str) -> tuple[int, str]:
    """Least cost and the first of the cheapest audits of a whole conversation."""
    found = None
    for state, now in enumerate(run_from(symbols, _EMPTY).held):
        if now is not None:
            cost, audit = now[0] + INSERT * len(_CLOSING[state]), audit_of(now[1]) + _CLOSING[state]
            if found is None or (cost, audit) < found:
                found = (cost, audit)
    return found


def repaired(roles: list[str], texts: list[str], audit: str, state: int = _EMPTY) -> list[str]:
    """Lines role:text after the edits of an audit that begins in ``state``."""
    lines, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        wanted = _WANTED[state]
        if edit == "I":
            lines.append(f"{_ROLES[wanted]}:")
        else:
            role = roles[k] if edit == "K" else _ROLES[wanted]
            lines.append(f"{role}:{texts[k]}")
            wanted, k = role[:1] if edit == "K" else wanted, k + 1
        state = _NEXT[state][wanted]
    return lines


# --- composition over chunks -------------------------------------------------------------------------------------

#: Rank of each state's audit from each start and its cost there; -1 where no audit leads.
_FAR = -1


def transfer(symbols: str) -> list[int]:
    """32 numbers: costs[start * 4 + end], then ranks in the order of the audits of one start."""
    costs, ranks = [_FAR] * 16, [_FAR] * 16
    for start in range(4):
        held = [(audit_of(now[1]), end, now[0]) for end, now in enumerate(run_from(symbols, start).held) if now is not None]
        for rank, (_, end, cost) in enumerate(sorted(held)):
            costs[4 * start + end], ranks[4 * start + end] = cost, rank
    return costs + ranks


def _step(entry: list[int], moves: list[int]) -> tuple[list[int], list[int]]:
    """Entry of the next chunk (4 costs, then 4 ranks) and the state that each state of it comes from.

    Audits of different states are no prefixes of each other, so the order of
    two audits is that of the states they come from, or else that within the chunk.
    """
    cost, source, order = [_FAR] * 4, [_FAR] * 4, [None] * 4
    for end in range(4):
        for start in range(4):
            if entry[start] >= 0 and moves[4 * start + end] >= 0:
                key = (entry[start] + moves[4 * start + end], entry[4 + start])
                if source[end] < 0 or key < (cost[end], entry[4 + source[end]]):
                    cost[end], source[end], order[end] = key[0], start, (entry[4 + start], moves[16 + 4 * start + end])
    places = sorted((o, k) for k, o in enumerate(order) if o is not None)
    rank = [_FAR] * 4
    for place, (_, k) in enumerate(places):
        rank[k] = place
    return cost + rank, source


def _unit(start: int) -> list[int]:
    return [0 if k == start else _FAR for k in range(4)] * 2


def compose(many: list[list[int]]) -> list[int]:
    """Transfer table of several chunks in a row."""
    costs, ranks = [], []
    for start in range(4):
        now = _unit(start)
        for moves in many:
            now, _ = _step(now, moves)
        costs += now[:4]
        ranks += now[4:]
    return costs + ranks


def path(many: list[list[int]], entry: list[int], end: int | None = None) -> tuple[list[list[int]], list[int], list[int]]:
    """Entry of every chunk, the state it ends in on the best path to ``end``, and the
    last entry. Without ``end`` the whole conversation ends here: the cheapest state
    after its closing insertions is taken."""
    entries, sources = [], []
    for moves in many:
        entries.append(entry)
        entry, source = _step(entry, moves)
        sources.append(source)
    if end is None:
        end = final_state(entry)
    ends = [0] * len(many)
    for k in range(len(many) - 1, -1, -1):
        ends[k], end = end, sources[k][end]
    return entries, ends, entry


def final_state(entry: list[int]) -> int:
    return min((k for k in range(4) if entry[k] >= 0), key=lambda k: (entry[k] + INSERT * len(_CLOSING[k]), entry[4 + k]))


# --- rows --------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of rows damaged by crc32(``conv_id:turn``) % 20:
    0 drops a row (``gone``), 1 empties its text, 2 takes out full stops, ! and ?,
    3 gives it twice, 4 makes its role user. Nulls of role and text, and within
    the key those of conv_id and turn, count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    f = F.col("fault")
    text = F.when(f == 1, "").when(f == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return held.select("conv_id", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (f == 0).alias("gone"), F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _own_fault(text: Column) -> Column:
    """b: no character but white space, t: the last other one ends no sentence, else empty."""
    bare = F.rtrim(text, F.lit(GAP_CHARS))
    return F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")


#: Counts of a chunk or a whole: see _tally.
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_ELEMENT = "chunk long, part long, size long, first string, last string, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, moves array<int>"


class _Piece:
    """Rows of one conversation in order, as far as they were read."""

    def __init__(self, conv) -> None:
        self.conv, self.turns, self.roles, self.texts, self.own, self.chars = conv, [], [], [], [], 0

    def add(self, turn, role, text, own) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.own.append(own)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.own) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS


def _tally(roles: list[str], faults: list[str], turns: list) -> dict:
    """Counts of rows in order; faults are b, d, t or empty."""
    classes = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    return {
        "size": len(roles),
        "first": classes[0] if classes else None,
        "last": classes[-1] if classes else None,
        "turns": len(set(known)),
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(classes, classes[1:])),
    }


def _joined(a: dict, b: dict) -> dict:
    """Counts of two stretches of one conversation that follow each other in order of turns."""
    if not a["size"] or not b["size"]:
        return a if a["size"] else b
    out = {k: a[k] + b[k] for k in ("size", "turns", *_COUNTS)}
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    return out


def _gaps(tally: dict) -> int:
    return 0 if tally["low"] is None else tally["high"] - tally["low"] + 1 - tally["turns"]


def _symbols(roles: list[str], faults: list[str]) -> str:
    made = []
    for role, fault in zip(roles, faults):
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        made.append("D" if fault in ("b", "d") else kind.upper() if fault == "t" else kind)
    return "".join(made)


def _faults(roles: list[str], texts: list[str], own: list[str], seen: set | None = None) -> list[str]:
    """First fault of each row. ``seen`` are places whose role and text stand in an earlier chunk."""
    met, made = set(), []
    for k, (role, text, fault) in enumerate(zip(roles, texts, own)):
        if fault == "b":
            made.append("b")
            continue
        key = (role, text)
        made.append("d" if key in met or seen and k in seen else fault)
        met.add(key)
    return made


_DONE = [("gaps", "long"), *[(c, "long") for c in _COUNTS], ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_CHUNK = [("chunk", "long"), ("turns", "array<long>"), ("roles", "array<string>"), ("texts", "array<string>"), ("own", "array<string>")]


def _packed(conv_type: T.DataType):
    """mapInArrow function over sorted rows: a result for every conversation that
    lies wholly inside the partition and in one chunk, else its chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType([T.StructField("conv_id", conv_type), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in (*_DONE, *_CHUNK)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made: list[tuple] = []
        chunk = 0
        piece: _Piece | None = None
        whole, weight = False, 0  # whole: the piece began inside this partition and was never cut

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made, weight
            cols = list(zip(*made))
            made, weight = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        def cut() -> None:
            nonlocal chunk, weight
            made.append((piece.conv, *[None] * len(_DONE), (part << 32) + chunk, piece.turns, piece.roles, piece.texts, piece.own))
            chunk, weight = chunk + 1, weight + piece.chars

        def finish() -> None:
            nonlocal weight
            faults = _faults(piece.roles, piece.texts, piece.own)
            tally = _tally(piece.roles, faults, piece.turns)
            cost, audit = solve(_symbols(piece.roles, faults))
            text = "\n".join(repaired(piece.roles, piece.texts, audit))
            made.append((piece.conv, _gaps(tally), *[tally[c] for c in _COUNTS], cost, audit, hashlib.sha256(text.encode()).hexdigest(), *[None] * len(_CHUNK)))
            weight += 1000

        for batch in batches:
            rows = batch.to_pydict()
            for conv, turn, role, text, gone, own in zip(*rows.values()):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        if whole:
                            finish()
                        else:
                            cut()
                        whole = True
                    piece = _Piece(conv)
                elif piece.full():
                    cut()
                    piece, whole = _Piece(conv), False
                if not gone:
                    piece.add(turn, role, text, own)
                if weight > 1 << 22:
                    yield from emit()
        if piece is not None:
            cut()
        if made:
            yield from emit()

    return run, T.StructType([T.StructField("conv_id", conv_type), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in (*_DONE, *_CHUNK)]])


def _row_key(role: Column, text: Column) -> Column:
    """Digest of role and text; the role's length keeps the two apart."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def _repeats(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, ``seen``: places of the rows whose role and text stand in an earlier chunk of their conversation.

    A chunk offers each of its different rows once, so a row that a hot
    conversation repeats is as many rows as there are chunks.
    """
    flat = chunks.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts", "own")).alias("k", "r")).filter("r.own <> 'b'")
    once = flat.groupBy("conv_id", "chunk", _row_key(F.col("r.roles"), F.col("r.texts")).alias("key")).agg(F.min("k").alias("k"))
    first = once.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("f_key")).agg(F.min("chunk").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("f_key"))).filter("chunk > first")
    return later.groupBy("chunk").agg(F.collect_list("k").alias("seen"))


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = []
        for conv, chunk, turns, roles, texts, own, seen in zip(*(rows[c] for c in ("conv_id", "chunk", "turns", "roles", "texts", "own", "seen"))):
            faults = _faults(list(roles), list(texts), list(own), set(seen) if seen is not None else None)
            known = [None if t is None or t != t else int(t) for t in turns]
            made.append({"conv_id": conv, "chunk": chunk, "part": chunk >> 32} | _tally(list(roles), faults, known) | {"moves": transfer(_symbols(list(roles), faults)), "faults": faults})
        yield pd.DataFrame(made, columns=["conv_id", *_names(_ELEMENT), "faults"])


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _element(row) -> dict:
    out = row._asdict()
    for k in ("low", "high", "first", "last"):
        out[k] = None if pd.isna(out[k]) else out[k] if k in ("first", "last") else int(out[k])
    return out | {"moves": [int(x) for x in out["moves"]]}


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """One element for the chunks of one conversation in one partition."""
    held = [_element(r) for r in rows.sort_values("chunk").itertuples(index=False)]
    total = held[0]
    for e in held[1:]:
        total = _joined(total, e)
    made = {"conv_id": rows["conv_id"].iloc[0]} | {k: total[k] for k in _names(_ELEMENT) if k in total} | {"chunk": held[0]["chunk"], "part": held[0]["part"], "moves": compose([e["moves"] for e in held])}
    return pd.DataFrame([made], columns=["conv_id", *_names(_ELEMENT)])


def _over_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and end of each part of one conversation; the first part also carries the counts and the cost."""
    held = [_element(r) for r in rows.sort_values("part").itertuples(index=False)]
    total = held[0]
    for e in held[1:]:
        total = _joined(total, e)
    entries, ends, last = path([e["moves"] for e in held], _unit(_EMPTY))
    cost = last[ends[-1]] + INSERT * len(_CLOSING[ends[-1]])
    first = {"gaps": _gaps(total), **{c: total[c] for c in _COUNTS}, "cost": cost}
    made = [{"part": e["part"], "entry": entry, "end": end} | {k: v if j == 0 else None for k, v in first.items()} for j, (e, entry, end) in enumerate(zip(held, entries, ends))]
    return pd.DataFrame(made).assign(conv_id=rows["conv_id"].iloc[0])


def _over_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    """Start and end of each chunk of one conversation in one partition."""
    rows = rows.sort_values("chunk")
    entry, end = [int(x) for x in rows["entry"].iloc[0]], int(rows["end"].iloc[0])
    moves = [[int(x) for x in m] for m in rows["moves"]]
    entries, ends, _ = path(moves, entry, end)
    # the path's own states: each chunk starts where the one before it ends
    starts = [_step(e, m)[1][x] for e, m, x in zip(entries, moves, ends)]
    return pd.DataFrame({"chunk": rows["chunk"], "start": starts, "stop": ends})


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and repaired lines of each chunk."""
    for rows in batches:
        made = []
        for conv, chunk, roles, texts, faults, start, stop in zip(*(rows[c] for c in ("conv_id", "chunk", "roles", "texts", "faults", "start", "stop"))):
            audit = audit_of(run_from(_symbols(list(roles), list(faults)), start).held[stop][1])
            lines = repaired(list(roles), list(texts), audit, start)
            made.append((conv, chunk, audit, "\n".join(lines), len(lines), stop))
        yield pd.DataFrame(made, columns=["conv_id", "chunk", "audit", "body", "n_lines", "stop"])


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from its chunks in order: digest and audit."""
    now, key = None, object()

    def close() -> pd.DataFrame:
        conv, state, audit, some, stop = now
        closing = _CLOSING[stop]
        for line in repaired([], [], closing, stop):
            state.update((("\n" if some else "") + line).encode())
            some = True
        return pd.DataFrame({"conv_id": [conv], "audit": ["".join(audit) + closing], "repaired_sha256": [state.hexdigest()]})

    for rows in batches:
        for conv, audit, body, n, stop in zip(*(rows[c] for c in ("conv_id", "audit", "body", "n_lines", "stop"))):
            same = now is not None and (conv == key or pd.isna(conv) and pd.isna(key))
            if not same:
                if now is not None:
                    yield close()
                now, key = [conv, hashlib.sha256(), [], False, _EMPTY], conv
            if n:
                now[1].update((("\n" if now[3] else "") + body).encode())
                now[3] = True
            now[2].append(audit)
            now[4] = stop
    if now is not None:
        yield close()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation of ``rows`` (conv_id, turn, role, text, and
    ``gone`` for rows that only name their conversation).

    Rows stand in order of turn (nulls first), then of role and of a digest of
    the text, so repeated rows stand together. Null roles and texts count as one
    space, null conv_id is a conversation like any other. A conversation whose
    rows are all gone gives zeros, the empty audit and the digest of nothing.
    Other columns are not looked at. conv_id may be of any type that pandas
    keeps; turn is a whole number. Texts are shuffled once, those of
    conversations that lie across partitions or are long three times.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), gone.alias("gone"))
    held = held.withColumn("own", _own_fault(F.col("text"))).withColumn("near", F.left("role", F.lit(32))).withColumn("mix", F.xxhash64("role", "text")).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "near", "mix", "tie"]
    run, schema = _packed(rows.schema["conv_id"].dataType)
    dealt = held.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "own")
    packed = stage_table(dealt.mapInArrow(run, schema), "conversations")
    done = packed.filter("chunk is null").select("conv_id", *[n for n, _ in _DONE])
    chunks = packed.filter("chunk is not null").select("conv_id", *[n for n, _ in _CHUNK])

    kind = rows.schema["conv_id"].dataType.simpleString()
    seen = _repeats(chunks).withColumnRenamed("chunk", "s_chunk")
    told = chunks.join(seen, F.col("chunk") == F.col("s_chunk"), "left").drop("s_chunk")
    elements = stage_table(told.mapInPandas(_elements, f"conv_id {kind}, {_ELEMENT}, faults array<string>"), "conversation-chunks")
    narrow = elements.drop("faults")
    folded = narrow.groupBy("conv_id", "part").applyInPandas(_fold, f"conv_id {kind}, {_ELEMENT}")
    parts = stage_table(folded.groupBy("conv_id").applyInPandas(_over_parts, f"conv_id {kind}, part long, entry array<int>, end int, " + ", ".join(f"{c} long" for c in ("gaps", *_COUNTS, "cost"))), "conversation-parts")
    entered = parts.select(F.col("conv_id").alias("p_conv"), F.col("part").alias("p_part"), "entry", "end")
    within = narrow.select("conv_id", "part", "chunk", "moves").join(entered, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part")))
    steps = within.groupBy("conv_id", "part").applyInPandas(_over_chunks, "chunk long, start int, stop int")
    edits = chunks.join(elements.select(F.col("chunk").alias("e_chunk"), "faults"), F.col("chunk") == F.col("e_chunk")).join(steps.withColumnRenamed("chunk", "t_chunk"), F.col("chunk") == F.col("t_chunk"))
    bodies = edits.select("conv_id", "chunk", "roles", "texts", "faults", "start", "stop").mapInPandas(_edited, f"conv_id {kind}, chunk long, audit string, body string, n_lines int, stop int")
    texts = bodies.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInPandas(_streamed, f"conv_id {kind}, audit string, repaired_sha256 string")
    counts = parts.filter("cost is not null").select(F.col("conv_id").alias("c_conv"), "gaps", *_COUNTS, "cost")
    long = texts.join(counts, F.col("conv_id").eqNullSafe(F.col("c_conv"))).select("conv_id", *[n for n, _ in _DONE])
    return done.unionByName(long)
