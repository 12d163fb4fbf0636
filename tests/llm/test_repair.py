import hashlib
import random
import zlib

import pytest

from tidewater.llm import repair as R
from tidewater.llm.repair import damage, repair_report, solve

SCHEMA = "conv_id long, turn long, role string, text string, conv string, row string, place string"


def cheapest(signs):
    """Least (cost, letters) over all edits, row by row over the four states."""
    best = {R.START: (0, "")}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        for _ in range(3):
            for s, (cost, letters) in list(table.items()):
                put(table, R._NEXT[s], (cost + 5, letters + "I"))
        return table

    for sign in signs:
        after = {}
        for s, (cost, letters) in inserts(best).items():
            put(after, s, (cost + 2, letters + "D"))
            if sign != "-":
                more, kind = 5 * sign.isupper(), sign.lower()
                if s in R._AFTER.get(kind, ()):
                    put(after, R._REACHED[kind], (cost + more, letters + "K"))
                put(after, R._NEXT[s], (cost + 1 + more, letters + "R"))
        best = after
    best = inserts(best)
    return min(best[s] for s in (R.START, R.ASSISTANT) if s in best)


def row_of(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, signs, faults = set(), "", []
    for _, role, text in rows:
        words = text.rstrip(R.WHITE)
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        signs += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    cost, audit = cheapest(signs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    starts = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
    out, state, at = [], R.START, 0
    for letter in audit:
        if letter == "I":
            state = R._NEXT[state]
            out.append(R.ROLE[state] + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            state = R._REACHED[role[0]]
            out.append(f"{role}:{text}")
        elif letter == "R":
            state = R._NEXT[state]
            out.append(f"{R.ROLE[state]}:{text}")
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute(rows):
    of = {}
    for conv, turn, role, text, *_ in rows:
        kept = of.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return sorted((row_of(c, rows) for c, rows in of.items()), key=str)


def test_auction_finds_the_least_of_the_cheapest_edits():
    draw = random.Random(3)
    for n in range(600):
        signs = "".join(draw.choice("suax-SUAX" if n % 2 else "uuaa-UAs") for _ in range(draw.randint(0, 50)))
        assert solve(signs)[R.START][:2] == cheapest(signs), signs


@pytest.mark.parametrize(
    ("signs", "audit", "cost"),
    [
        ("ua", "KK", 0), ("sua", "KKK", 0), ("", "", 0), ("s", "D", 2), ("u", "D", 2), ("uu", "KR", 1), ("a", "D", 2), ("uaa", "KDK", 2),
        ("u-a", "KDK", 2), ("xa", "RK", 1), ("auaua", "DKKKK", 2), ("ssua", "DKKK", 2), ("uA", "DD", 4), ("uauaUaua", "KKKDDKKK", 4),
    ],
)
def test_hand_cases(signs, audit, cost):
    assert solve(signs)[R.START][:2] == (cost, audit)


def planted(n=40):
    draw, rows = random.Random(5), []
    texts = ["Good.", "yes!", "what?", "cut", "", " \t\n", "same.", "same.", None, "tail. \n", "x" * 200 + ".", "ü?"]
    for conv in [*range(n), None]:
        for turn in range(draw.randint(0, 9)):
            place = None if draw.random() < 0.1 else turn + draw.randint(0, 2)
            rows.append((conv, place, draw.choice(["user", "assistant", "assistant", "system", "tool", "", None]), draw.choice(texts), "c", "r", "p"))
    hot = [(n, t, ("user", "assistant")[t % 2], f"line {t % 31}." if t % 7 else "no end", "c", "r", "p") for t in range(300)]
    return [*rows, *rows[:5], *hot, (n + 1, 0, "user", "y" * 200_000 + ".", "c", "r", "p")]


@pytest.mark.parametrize("block_rows", [2, 7, 8192])
def test_report_equals_brute_force_for_any_block(spark, block_rows):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in repair_report(df, damage(df), block_rows).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_report(df, damage(df)).count() == 0
