from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from parcelmart.llm import conversations as c
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}


def slow_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def slow_audit(rows, faults):
    """Every sequence of edits of least cost, tried one by one; at most two inserts in a row can pay."""
    best = [10**9, "", []]

    def go(i, state, cost, audit, text, inserted):
        if cost > best[0]:
            return
        if i == len(rows) and state in "0a" and (cost, audit) < (best[0], best[1]):
            best[:] = [cost, audit, text]
        following = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[following]
        if inserted < 2:
            go(i, following, cost + 5, audit + "I", [*text, name + ":"], inserted + 1)
        if i == len(rows):
            return
        role, body = rows[i]
        go(i + 1, state, cost + 2, audit + "D", text, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        more = 5 * (faults[i] == "truncated")
        go(i + 1, following, cost + 1 + more, audit + "R", [*text, f"{name}:{body}"], 0)
        first = role[:1]
        if first == following or first == "s" and state == "0":
            go(i + 1, first, cost + more, audit + "K", [*text, f"{role}:{body}"], 0)

    go(0, "0", 0, "", [], 0)
    return best


def slow_report(rows):
    """rows: (turn, role, text) of one conversation in order."""
    texts = [(role, text) for _, role, text in rows]
    faults = slow_faults(texts)
    cost, audit, repaired = slow_audit(texts, faults)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(texts, texts[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        known = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{known[0]}:{known[1]}".encode()) % 20
        role, text = known[2], known[3]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def slow_reports(original, rows):
    found = {r[0]: [] for r in original}
    for conv, turn, role, text in rows:
        found[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for some in found.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return {conv: slow_report(some) for conv, some in found.items()}


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def some_rows(seed, conversations=120, most=6):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]
    texts = ["Yes.", "No!", "Why?", "cut", " ", "", None, "Fine. ", "End.\n", "　"]
    return [(conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles), rng.choice(texts))
            for conv in [*range(conversations), None] for turn in range(rng.randint(1, most))]


@pytest.mark.parametrize("bits", [14, 1])
def test_reports_equal_brute_force(spark, monkeypatch, bits):
    """With blocks of two rows and groups of two blocks as well, so that the crossing states pass several levels."""
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    monkeypatch.setattr(c, "FAN_BITS", 10 if bits > 1 else 5)
    rows = some_rows(bits)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pos string")
    assert as_dict(c.repair_report(frame, frame)) == slow_reports(rows, rows)
    assert as_dict(c.repair_report(frame, c.damage(frame))) == slow_reports(rows, slow_damage(rows))


def test_given_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(c.repair_report(table, c.damage(table))) == slow_reports(rows, slow_damage(rows))


@functools.cache
def plain_best(codes):
    """(cost, letters) by a plain table over rows and states."""
    best = {0: (0, "")}
    for code in codes:
        step, ways = c.row_step(code)
        ahead = {}
        for state, (cost, letters) in best.items():
            for end in c.STATES:
                if step[state][end][0] < c.FAR:
                    way = (cost + step[state][end][0], letters + ways[state, end])
                    ahead[end] = min(ahead.get(end, way), way)
        best = ahead
    return min((cost + c.ENDINGS[s][0], letters + c.ENDINGS[s][1]) for s, (cost, letters) in best.items())


def test_long_conversations_by_halves_and_by_blocks():
    rng = random.Random(4)
    for size in (1, 2, 3, 17, 200, 1000):
        codes = "".join(rng.choice(c.CODES[:8] + "uauaua45") for _ in range(size))
        whole = c.summary([c.row_step(x)[0] for x in codes])
        end = c.last_state(whole)
        cost, letters = plain_best(codes)
        assert whole[0][end][0] + c.ENDINGS[end][0] == cost
        assert c.audit_between(codes, 0, end) + c.ENDINGS[end][1] == letters
        parts = [codes[i:i + 7] for i in range(0, size, 7)]
        steps = [c.summary([c.row_step(x)[0] for x in part]) for part in parts]
        states = c.crossings(steps, 0, end)
        assert "".join(c.audit_between(p, states[i], states[i + 1]) for i, p in enumerate(parts)) + c.ENDINGS[end][1] == letters


def test_edits_are_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Sure."), (1, 2, "user", ""), (1, 3, "assistant", "half")]
    edits = [tuple(r)[1:] for r in c.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert edits == [(0, "K", "user", "Hi.", 0, "u"), (1, "R", "assistant", "Sure.", 1, "u"), (2, "D", "user", "", 2, "1"),
                     (3, "D", "assistant", "half", 3, "A")]


def test_empty_table_and_conversation_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert c.repair_report(none, c.damage(none)).collect() == []
    one = spark.createDataFrame([(7, 1, "user", "Hi.")], SCHEMA)
    assert as_dict(c.repair_report(one, none)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_with_most_rows(spark):
    """A third of all rows in one conversation, with repeats: cut into blocks, same result."""
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 900)}.") for t in range(3000)]
    rows += [(i, t, ("user", "assistant")[t % 2], f"{i} {t}.") for i in range(1, 1500) for t in range(4)]
    rng.shuffle(rows)
    found = as_dict(c.repair_report(*[spark.createDataFrame(rows, SCHEMA).repartition(5)] * 2))
    seen, codes, kept = set(), "", sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])
    for _, _, role, text in kept:
        codes += {"assistant": "6", "user": "5"}[role] if (role, text) in seen else role[0]
        seen.add((role, text))
    cost, letters = plain_best(codes)
    assert found[0][5:7] == (cost, letters)
    assert all(found[i][5:7] == (0, "KKKK") for i in range(1, 1500))
