"""Conversation repair against a search over all edits and against a table of whole texts."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

import tallywork.llm.conversations as conv

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = "grp seq rank digest codes letters code n start end last gaps blank duplicate truncated illegal cost audit copy h low high".split()
ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, None, "user", "x"), (2, 5, "user", "x"), (3, 3, "assistant", "A."), (3, 3, "assistant", "A."), (3, 9, "system", "S!"), (None, 1, "user", "Q?"), (None, 2, "tool", " \t"),
    (4, 1, "system", "S."), (5, 1, "", ""), (5, 2, "a", "b."), (6, 1, "user", "long " * 50_000 + "."), (6, 2, "assistant", "end"), (7, -(2**63), "user", "x."), (7, 2**63 - 1, "user", "y."),
]


def options(kind, flag, state):
    """(letter, next state, cost) of one row; state by the initials so far."""
    out = [("D", state, 4)]
    if flag < 2:
        to = 3 if state == 2 else 2
        out.append(("R", to, 3 + 3 * flag))
        if kind == "s" and state == 0:
            out.append(("K", 1, 3 * flag))
        if kind == "u" and state in (0, 1, 3):
            out.append(("K", 2, 3 * flag))
        if kind == "a" and state == 2:
            out.append(("K", 3, 3 * flag))
    return out


def search(rows):
    """Least (cost, text): whole texts are kept per row and state, inserts go anywhere."""
    def spread(best):
        for _ in range(3):
            for s in list(best):
                to = 3 if s == 2 else 2
                move = (best[s][0] + 3, best[s][1] + "I")
                if to not in best or move < best[to]:
                    best[to] = move
        return best

    # every text is kept that is cheapest up to here in its state: a longer text may win later
    best = {(0, ""): 0}
    for kind, flag in rows:
        grown = {}
        for (s, text), cost in best.items():
            for k in range(4):
                state = s
                for _ in range(k):
                    state = 3 if state == 2 else 2
                for letter, to, more in options(kind, flag, state):
                    key, c = (to, text + "I" * k + letter), cost + 3 * k + more
                    grown[key] = min(c, grown.get(key, 1 << 30))
        low = {s: min(c for (t, _), c in grown.items() if t == s) for s in {s for s, _ in grown}}
        best = {key: c for key, c in grown.items() if c == low[key[0]]}
    ends = []
    for (s, text), cost in best.items():
        for k in range(3):
            state = s
            for _ in range(k):
                state = 3 if state == 2 else 2
            if state in (0, 3):
                ends.append((cost + 3 * k, text + "I" * k))
    return min(ends)


def brute(rows, also=()):
    by = {g: [] for g in also}
    for g, turn, role, text in rows:
        by.setdefault(g, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for g, of in by.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, faults = set(), []
        for _, role, text in of:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append(2 if not core else 3 if (role, text) in seen else 0 if core[-1] in ".!?" else 1)
            seen.add((role, text))
        initials = [r[1][:1] for r in of]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        turns = {r[0] for r in of if r[0] is not None}
        cost, audit = search(list(zip(initials, faults, strict=True)))
        odd, place, lines, left = (len(audit) - audit.count("D")) % 2, 0, [], iter(of)
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                lines.append((row[1] if letter == "K" else ("assistant" if (place - odd) % 2 else "user")) + ":" + (row[2] if row else ""))
                place += 1
        gaps = min(max(turns) - min(turns) + 1 - len(turns), 2**63 - 1) if turns else 0
        out.append((g, gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def damaged(rows):
    out = []
    for g, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if g is None else g}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(g, turn, "user" if h == 4 else role, text)] * ((h != 0) + (h == 3))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edits_against_search():
    pick = random.Random(5)
    for n in range(400):
        rows = [(pick.choice("suax"), pick.choice([0, 0, 1, 2, 3])) for _ in range(pick.randrange(0, 9))]
        codes = bytes("suax".index(k) * 4 + f for k, f in rows)
        cost, audit = search(rows)
        steps = [conv.STEPS[x] for x in codes] + [conv.END]
        assert conv.forward(steps, 0)[0][0] == cost and conv.edits(codes, 0, 0, True) == audit, rows
        cut = [codes[i : i + 3] for i in range(0, len(codes), 3)]  # by tables of segments
        path = conv.crossings([*[conv.table(c) for c in cut], conv.END], 0, 0)
        assert "".join(conv.edits(c, path[i], path[i + 1], False) for i, c in enumerate(cut)) + conv.END[path[-2]][0][1] == audit, rows


def test_long_conversation():
    codes = bytes(random.Random(2).randrange(16) for _ in range(20_000))
    steps = [conv.STEPS[x] for x in codes] + [conv.END]
    cost, path, audit = conv.forward(steps, 0)[0][0], conv.crossings(steps, 0, 0), conv.edits(codes, 0, 0, True)
    assert sum(e[p][q][0] for e, p, q in zip(steps, path, path[1:], strict=False)) == cost and len(audit) - audit.count("I") == 20_000


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(conv, "SEGMENT", size)
    rows = ODD + [(8, i, pick, f"t{i % 5}.") for i, pick in enumerate(random.Random(1).choices(["user", "assistant", "system"], k=40))] + [(9, 4, "user", "Same.")] * 30
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    also = spark.createDataFrame([(1,), (77,), (77,)], "conv_id long")
    assert got(conv.repair_conversations(df, also)) == brute(rows, also=[77])


def test_query(spark):
    from tallywork.llm.queries import op12_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_repair(spark, SF)) == brute(damaged(rows), also={r[0] for r in rows})


def test_empty_table(spark):
    kept, dropped = conv.damage(spark.createDataFrame([], SCHEMA))
    assert conv.repair_conversations(kept, dropped).collect() == []
