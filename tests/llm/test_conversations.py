"""Conversation repair against trying every list of edits."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelforge.llm import conversations as cv

COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def every(rows, ends=True):
    """(cost, edits) of all lists of edits whose role initials are allowed, up to two insertions per gap."""
    out = []

    def go(i, roles, cost, edits, inserted):
        ok = roles[1:] if roles[:1] == "s" else roles
        if not all(c == "ua"[k % 2] for k, c in enumerate(ok)):
            return
        if i == len(rows) and (not roles or (ok and len(ok) % 2 == 0)):
            out.append((cost, edits))
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, edits + "I", inserted + 1)
        if i == len(rows):
            return
        role, must_go, stay = cv._choices(rows[i])
        go(i + 1, roles, cost + 2, edits + "D", 0)
        if not must_go:
            go(i + 1, roles + role, cost + stay, edits + "K", 0)
            for r in "ua":
                if r != role:
                    go(i + 1, roles + r, cost + stay + 1, edits + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


def forward(rows):
    """Cheapest edits of a long conversation, layer by layer."""
    step = {(k, r): n for k, f in cv.FOLLOWS.items() for r, n in f.items()}
    layer = {cv.NOTHING: (0, "")}

    def with_insertions(layer):
        for _ in range(2):
            for kind, (cost, edits) in list(layer.items()):
                for r in "ua":
                    if (kind, r) in step:
                        new = (cost + 5, edits + "I")
                        layer[step[kind, r]] = min(layer.get(step[kind, r], new), new)
        return layer

    for row in rows:
        role, must_go, stay = cv._choices(row)
        after = {}
        for kind, (cost, edits) in with_insertions(layer).items():
            options = [(kind, cost + 2, "D")]
            if not must_go:
                for r in "sua":
                    if (kind, r) in step and (r == role or r != "s"):
                        options.append((step[kind, r], cost + stay + (r != role), "K" if r == role else "R"))
            for to, c, e in options:
                after[to] = min(after.get(to, (c, edits + e)), (c, edits + e))
        layer = after
    layer = with_insertions(layer)
    return min(layer[k] for k in cv.ENDS if k in layer)


def random_rows(rng, n):
    return "".join(rng.choice("suuaaaxSUAX0123") for _ in range(n))


def test_search_tries_no_worse_than_every_list():
    rng = random.Random(5)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 5))
        assert cv.repair(rows) == every(rows), rows


def test_long_conversations_are_chained():
    rng = random.Random(6)
    for n in (60, 255, 256, 257, 700):
        rows = random_rows(rng, n)
        assert cv.repair(rows) == forward(rows)
    for rows in ("u" * 600, "a" * 600, "2" * 600, "1" * 300 + "s" * 300, "ua" * 300, "x" * 513):
        assert cv.repair(rows) == forward(rows), rows[:5]


def test_bounds_are_never_above_the_cost():
    rng = random.Random(7)
    for _ in range(200):
        rows = random_rows(rng, rng.randint(0, 6))
        bounds = cv.suffix_bounds(rows, cv.ENDS)
        for i in range(len(rows) + 1):
            for kind in range(4):
                found = cv.search(rows[i:], kind)
                assert found is None or bounds[i][kind == cv.USER] <= found[0]


SPACE = " \t\n\x0b\f\r"


def by_hand(data):
    groups = defaultdict(list)
    for conv_id, turn, role, text in data:
        rows = groups[conv_id]
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        role = "user" if fate == 4 else role
        rows += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv_id, rows in groups.items():
        sign = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, sign(r)))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        codes, seen, counts = "", set(), [0, 0, 0]
        for _, role, text in rows:
            end = text.rstrip(SPACE)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += kind if fault is None else kind.upper() if fault < 2 else str("suax".index(kind))
            if fault is not None:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = forward(codes)
        i, lines, last = 0, [], ""
        for e in audit:
            if e != "I":
                _, role, text = rows[i]
                i += 1
            if e == "D":
                continue
            turned = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}" if e == "K" else f"{turned}:{text if e == 'R' else ''}")
            last = lines[-1][0]
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def awkward(seed):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine.", "cut", " \n", "", "Why?  \t", "Yes!", None, "w " * 20_000 + "end.", "é\U0001f600."]
    data = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 9)):
            data.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    data += [(100, i, "user" if i % 3 else "assistant", f"Turn {i % 200}{'.' if i % 5 else ''}") for i in range(700)]
    data += [data[4], data[4]]
    return data


@pytest.mark.parametrize("seed", [0, 1])
def test_whole_operator(spark, seed):
    data = awkward(seed)
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    df = df.withColumns({c: cv.F.lit("x") for c in ("sign", "gone", "copy", "mark", "blank", "audit", "cost")})
    got = {r[0]: tuple(r)[1:] for r in cv.repaired_after_damage(df).collect()}
    assert got == by_hand(data)


def test_empty_table_and_lost_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert cv.repaired_after_damage(spark.createDataFrame([], schema)).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cv.repaired_after_damage(spark.createDataFrame([(lost, 0, "user", "Hi.")], schema)).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
