"""Conversation repair against a program that carries whole audits as strings."""

import hashlib
import random
import re
import zlib

import pytest

from sensorline.llm import conversations as conv

STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAMES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def cheapest(rows):
    """Cost, audit and repaired text of rows (role, text, fault)."""
    best = {0: (0, "", ())}

    def offer(d, k, v):
        d[k] = min(d.get(k, v), v)

    def inserted(b):
        for _ in range(3):
            for s, (c, a, lines) in list(b.items()):
                for ch in "ua":
                    if ch in STEPS[s]:
                        offer(b, STEPS[s][ch], (c + 2, a + "I", (*lines, NAMES[ch] + ":")))
        return b

    for role, text, fault in rows:
        made = {}
        for s, (c, a, lines) in inserted(dict(best)).items():
            offer(made, s, (c + 3, a + "D", lines))
            if fault in ("b", "d"):
                continue
            more = int(fault == "t")
            if role[:1] in STEPS[s]:
                offer(made, STEPS[s][role[:1]], (c + more, a + "K", (*lines, f"{role}:{text}")))
            for ch in "ua":
                if ch in STEPS[s]:
                    offer(made, STEPS[s][ch], (c + 2 + more, a + "R", (*lines, f"{NAMES[ch]}:{text}")))
        best = made
    cost, audit, lines = min(v for k, v in inserted(dict(best)).items() if k in (0, 3))
    return cost, audit, "\n".join(lines)


def brute(table):
    """All results from rows (conv_id, turn, role, text) in plain Python."""
    held = {r[0]: [] for r in table}
    for c, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held[c] += [(turn, "user" if fault == 4 else role, text)] * (fault != 0) * (1 + (fault == 3))
    out = {}
    for c, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t for t, *_ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = cheapest(judged)
        faults = [f for *_, f in judged]
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in conv.repair(conv.damage(df)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def samples(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("suaxSUAXD") for _ in range(rng.randint(0, longest))) for _ in range(n)]


def as_rows(symbols):
    return [(NAMES[s.lower()] if s != "D" else "user", "t", "b" if s == "D" else "t" if s.isupper() else "") for s in symbols]


def test_every_sequence_of_edits_is_considered():
    """Against all sequences of edits, for up to four rows."""

    def every(rows, state, k, room):
        if k == len(rows) and state in (0, 3):
            yield 0, ""
        moves = [(2, "I", ch, 0) for ch in "ua"] if room else []
        if k < len(rows):
            role, _, fault = rows[k]
            moves += [(3, "D", "", 1)]
            if fault != "b":
                moves += [(int(fault == "t"), "K", role[:1], 1)] + [(2 + int(fault == "t"), "R", ch, 1) for ch in "ua"]
        for cost, edit, ch, used in moves:
            to = state if edit == "D" else STEPS[state].get(ch)
            if to is not None:
                for c, a in every(rows, to, k + used, 3 if used else room - 1):
                    yield cost + c, edit + a

    for symbols in samples(60, 4, 1):
        assert conv.solve(symbols) == min(every(as_rows(symbols), 0, 0, 3))


def test_audits_equal_whole_strings_and_compose():
    for symbols in samples(800, 12, 2):
        cost, audit, text = cheapest(as_rows(symbols))
        assert conv.solve(symbols) == (cost, audit)
        rows = as_rows(symbols)
        assert "\n".join(conv.repaired([r[0] for r in rows], [r[1] for r in rows], audit)) == text
        cut = len(symbols) // 2
        pieces = [symbols[: cut // 2], symbols[cut // 2 : cut], "", symbols[cut:]]
        tables = [conv.transfer(p) for p in pieces]
        _, ends, last = conv.path(tables, conv._unit(0))
        assert last[ends[-1]] + 2 * len(conv._CLOSING[ends[-1]]) == cost
        state, made = 0, ""
        for piece, end in zip(pieces, ends):
            made += conv.audit_of(conv.run_from(piece, state).held[end][1])
            state = end
        assert made + conv._CLOSING[state] == audit
        whole = conv.compose(tables)
        assert whole == conv.compose([conv.compose(tables[:2]), conv.compose(tables[2:])]) == conv.transfer(symbols)


def test_hash_collisions_change_nothing(monkeypatch):
    want = {s: conv.solve.__wrapped__(s) for s in samples(200, 14, 3)}
    monkeypatch.setattr(conv, "_MOD", 1)
    assert {s: conv.solve.__wrapped__(s) for s in want} == want


def test_prefix_search():
    def chain(text, root):
        for ch in text:
            root = conv.Node(ch, root)
        return root

    rng, root = random.Random(4), conv.Node("", None)
    shared = chain("KDRIKDRI" * 40, root)
    for _ in range(200):
        a, b = ("".join(rng.choice("DIKR") for _ in range(rng.randint(1, 9))) for _ in range(2))
        x, y = chain(a, shared), chain(b, shared)
        assert conv.audit_of(x) == "KDRIKDRI" * 40 + a
        assert conv.before(x, y) == (a < b) and conv.before(y, x) == (b < a)
    assert not conv.before(shared, shared) and conv.before(shared, chain("K", shared))


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == brute(rows)


@pytest.mark.parametrize("size", [3000])
def test_long_and_odd_conversations(spark, size):
    rng = random.Random(5)
    words = ["Hi.", "So", "", "Yes!", None, "é\U0001f642?", " \t\n", "x" * 200_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*words[: 7 + (t == 3)], f"word {rng.randint(0, 400)}."])) for c, n in ((1, size), (2, 5), (None, 700), (4, 1)) for t in range(n)]
    rows += [(6, None, "user", "Hi."), (6, None, "user", "Hi."), (6, 4, None, None), (6, 4, None, None), (7, None, None, None), (8, -3, "user", "Hi."), (8, 9, "assistant", "So.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, AUDIT string, chunk int")
    got = found(df)
    assert len(got) == 7 and got == brute(rows)
    assert found(df.filter("conv_id = 4")) == brute([r for r in rows if r[0] == 4])
    assert found(df.limit(0)) == {}


def test_conversations_whose_rows_are_all_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
