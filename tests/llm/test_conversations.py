"""Conversation repair against a search over all edits, and its edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from textloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"


def cheapest(signature):
    """All edits, without states: roles are spelt out and matched as a whole."""
    best = (4 * len(signature) + 9, "~")

    def search(i, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(signature):
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best, (cost, audit))
        else:
            c = signature[i]
            search(i + 1, cost + 3, audit + "D", roles, 0)
            if c != "x":
                search(i + 1, cost + c.isupper(), audit + "K", roles + c.lower(), 0)
                for r in "ua":
                    search(i + 1, cost + 2 + c.isupper(), audit + "R", roles + r, 0)
        if inserted < 3:
            for r in "ua":
                search(i, cost + 2, audit + "I", roles + r, inserted + 1)

    search(0, 0, "", "", 0)
    return best


def test_solver():
    solver, rng = C.Solver(), random.Random(1)
    some = ["".join(t) for n in range(4) for t in itertools.product("suaoSUAOx", repeat=n)] + ["".join(rng.choices("suaoUAx", k=rng.randrange(4, 7))) for _ in range(250)]
    for signature in some:
        assert solver.solve(signature) == cheapest(signature), signature
    assert len(solver.known) < 1000  # letters and cost differences, not signatures
    assert len(solver.solve("sua" * 50_000)[1]) >= 150_000


def plain(rows):
    """conv_id to the result, by the rules one after another; rows are (conv_id, turn, role, text) after damage, with their order."""
    out = {}
    for conv, own in rows.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, signature = [0, 0, 0], set(), ""
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(own))
        cost, audit = cheapest(signature)
        lines, at, rest = [], 0, list(own)
        wild = [e for e in audit if e != "D"]
        kept, k = [], 0
        for e in audit:
            if e == "I":
                kept.append((None, ""))
            else:
                _, role, text = rest[k]
                k += 1
                if e != "D":
                    kept.append((role if e == "K" else None, text))
        assert len(kept) == len(wild)
        offset = 1 if kept and kept[0][0] and kept[0][0][0] == "s" else 0
        lines = [f"{role or ('user', 'assistant')[(at - offset) % 2]}:{text}" for at, (role, text) in enumerate(kept)]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    found = []
    for conv in [None, *range(60)]:
        for turn in sorted(rng.sample(range(9), rng.randrange(1, 6))):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No?", "Well, maybe", "  ", None, "A ", "Fine!\n\t", "é.", "One. Two", "word " * 300 + "end."])
            found.append((conv, rng.choice([turn, turn, turn, None]) if conv else turn, role, text))
    return [*found, (3, 2, "user", "Again."), (3, 2, "user", "Again."), (3, 2, "assistant", "Again.")]


def test_against_plain_rules(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(4)
    after = {}
    for conv, turn, role, text in rows:
        own = after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in C.repaired(C.damaged(df.select("conv_id", "turn", "role", "text"))).collect()}
    assert got == plain(after)
    whole = {}
    for conv, turn, role, text in rows:
        whole.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {r[0]: tuple(r)[1:] for r in C.repaired(C.as_rows(df)).collect()}
    assert got == plain(whole)


def test_all_rows_dropped_and_empty_tables(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hello.") for c in gone], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in C.repaired(C.damaged(df)).collect()) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone]
    assert C.repaired(C.damaged(df.limit(0))).count() == 0
