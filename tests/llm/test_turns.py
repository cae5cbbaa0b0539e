"""Repair of conversations against all edits of short ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from corrobora.llm import turns
from corrobora.llm.queries import OP13_SQL
from corrobora.llm.turns import BLANK, CUT, DUPLICATE, _Walk, back, between, damage, over, repair_report, repaired_rows

END = (0, 10, 5, 0)


def cheapest(kinds):
    """The cheapest edits by trying all, in growing order of cost, of the forms that a repair may have."""
    best = {}

    def go(i, roles, audit, cost):
        if cost > 2 * len(kinds):  # deleting all is never dearer
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles):
            key = (cost, audit)
            best[key] = roles
        if re.fullmatch("s?(ua)*u?", roles):
            for role in "ua":
                go(i, roles + role, audit + "I", cost + 5)
            if i < len(kinds):
                kind = kinds[i]
                go(i + 1, roles, audit + "D", cost + 2)
                if not kind & (BLANK | DUPLICATE):
                    stays = 5 if kind & CUT else 0
                    go(i + 1, roles + "?sua"[kind & 3], audit + "K", cost + stays)
                    for role in "ua":
                        go(i + 1, roles + role, audit + "R", cost + stays + 1)

    go(0, "", "", 0)
    return min(best)


def walked(kinds, size):
    """The same by blocks of ``size`` rows and their checkpoints."""
    blocks = [bytes(kinds[i : i + size]) for i in range(0, len(kinds), size)]
    ends, after = [], END
    for b in reversed(blocks):
        ends.append(after)
        whole = after
        for kind in reversed(b):
            whole = back(whole, kind)
        after = over(between(b), after)
        assert after == whole
    walk, audit = _Walk(), ""
    for b, e in zip(blocks, reversed(ends), strict=True):
        walk.block(e, b)
        for _ in b:
            audit += "".join(edit for edit, _ in walk.row())
    audit += "".join(edit for edit, _ in walk.end())
    assert walk.cost == after[0]
    return walk.cost, audit


def test_cheapest_edits():
    rng = random.Random(3)
    for _ in range(250):
        kinds = [rng.randrange(4) | rng.choice([0, 0, 0, BLANK, DUPLICATE, CUT]) for _ in range(rng.randrange(6))]
        want = cheapest(kinds)
        assert {walked(kinds, size) for size in (1, 2, 3, 9)} == {want}


def plain(rows):
    """The report from the rule, with the edits of one walk over each whole conversation."""
    lost, convs = set(), {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(name.encode()) % 20
        lost.add(conv)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (2 if fault == 3 else 1))
    out = {}
    for conv in lost:
        said = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [t for t, _, _ in said if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in said:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {0: BLANK, 1: DUPLICATE, 2: CUT, None: 0}[fault])
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit = walked(kinds, 7) if kinds else (0, "")
        state, at, lines = 0, 0, []
        for edit in audit:
            new = "assistant" if state == 2 else "user"
            role, text = said[at][1:] if at < len(said) else ("", "")
            at += edit != "I"
            if edit != "D":
                role = new if edit in "IR" else role
                lines.append(f"{role}:{'' if edit == 'I' else text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def said():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "Why", "", " \t", "Go on? ", "x" * 3000 + ".", None, "Ä ", "a\nb."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in [None, None, 3, 3, 3, 9]] * 2
    rows += [(7, None, "user", "late."), (7, None, "user", "late."), (-1, 5, "user", "One.")]
    hot = [(500, t, "user" if t % 2 else "assistant", f"Line {t}{rng.choice('.!?,')}") for t in range(3000)]
    return rows + hot + [(501, t, "user", "same.") for t in range(400)]


SAID = "conv_id long, turn long, role string, text string, kind string, block string, at string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in said()], SAID).repartition(6)


def test_report(frame):
    want = plain(said())
    got = repair_report(damage(frame)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id][:-1]


def test_rows(frame):
    want = plain(said())
    lines = {}
    for r in repaired_rows(damage(frame)).orderBy("conv_id", "position").collect():
        assert r.edit in "KRI" and (r.edit != "I" or (r.turn is None and r.text == ""))
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_sql_says_the_same(frame):
    conversations = pd.DataFrame(said(), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    conversations = conversations[~conversations.conv_id.isin([500, 501])]
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = plain(said())
    for conv, *told in con.sql(OP13_SQL).fetchall():
        assert tuple(told) == want[conv][:-1]


def test_hot_conversation_is_spread(spark, frame):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = turns._placed(turns._ordered(damage(frame))).where("at = -1 AND conv_id = 500").select("part", "block", "kinds").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in placed}) > 1
    assert max(len(r.kinds) for r in placed) <= 32 * len(placed)


def test_empty(frame):
    assert repair_report(damage(frame.limit(0))).count() == 0 == repaired_rows(damage(frame.limit(0))).count()
