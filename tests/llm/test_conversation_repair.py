import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fareline.llm import conversation_repair, queries

SPACES = "\x20\t\n\x0b\x0c\r"
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        yield from [(conv, turn, role, text)] * (2 if fault == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, lines) by suffixes, with whole audits compared as strings."""
    best = {0: (0, "", []), 1: (4, "II", ["user:", "assistant:"]), 2: (2, "I", ["assistant:"]), 3: (0, "", [])}
    for (_, _, role, text), fault in zip(reversed(rows), reversed(found), strict=True):
        here, late = {}, fault == "truncated"
        for q in range(4):
            options = [(3 + best[q][0], "D" + best[q][1], best[q][2])]
            if fault in ("", "truncated"):
                after = STEP[q].get(role[:1])
                if after:
                    c, a, x = best[after]
                    options.append((c + late, "K" + a, [f"{role}:{text}", *x]))
                for new in ("user", "assistant"):
                    after = STEP[q].get(new[0])
                    if after:
                        c, a, x = best[after]
                        options.append((c + 2 + late, "R" + a, [f"{new}:{text}", *x]))
            here[q] = min(options, key=lambda o: o[:2])
        whole = {}
        for q in range(4):
            options, state, cost, lines = [here[q]], q, 0, []
            for j in range(1, 4):
                name = "assistant" if state == 2 else "user"
                state, cost, lines = STEP[state][name[0]], cost + 2, [*lines, name + ":"]
                c, a, x = here[state]
                options.append((c + cost, "I" * j + a, lines + x))
            whole[q] = min(options, key=lambda o: o[:2])
        best = whole
    return best[0]


def every_program(rows, found, limit):
    """Costs and audits of all edits up to a cost, checked against the pattern as text."""

    def go(k, cost, audit, roles):
        if cost > limit:
            return
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            yield cost, audit
        for new in "ua":
            yield from go(k, cost + 2, audit + "I", roles + new)
        if k == len(rows):
            return
        yield from go(k + 1, cost + 3, audit + "D", roles)
        if found[k] in ("", "truncated"):
            late = found[k] == "truncated"
            yield from go(k + 1, cost + late, audit + "K", roles + rows[k][2][:1])
            for new in "ua":
                yield from go(k + 1, cost + 2 + late, audit + "R", roles + new)

    return min(go(0, 0, "", ""))


def brute(rows):
    """The contract's row for each id, by plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == conv]
        digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        found = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        starts = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False))
        cost, audit, lines = cheapest(own, found)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha))
    return sorted(out, key=str)


def conversation(draw, conv, size):
    for turn in range(size):
        role = draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ["user", "assistant"][turn % 2]
        role = draw.choice(["system", "tool", "", None, "User"]) if draw.random() < 0.08 else role
        text = draw.choice(["Yes.", "No!", "what", "a b", "ok? ", "", "é.", " \n", None, "So it is.\t", "x" * 50])
        yield conv, draw.choice([turn, turn, turn + 1, None if draw.random() < 0.1 else turn]), role, text


@pytest.mark.parametrize("seed", range(4))
def test_least_edits_as_every_program(seed):
    """Stretches of up to four rows against all programs of edits, written out."""
    draw = random.Random(seed)
    for _ in range(25):
        rows = [
            (0, k, draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["a.", "b", "", "c!"]))
            for k in range(draw.randrange(1, 5))
        ]
        found = faults(rows)
        cost, audit, _ = cheapest(rows, found)
        assert (cost, audit) == every_program(rows, found, cost)
        kinds = [
            "sua".find(r[2][0]) % 4 + (4 if f == "truncated" else 8 if f else 0)
            for r, f in zip(rows, found, strict=True)
        ]
        kinds = np.array(kinds)
        edit, _, after = conversation_repair.solved(
            kinds, np.array([0]), np.array([len(kinds)]), np.array([0]), conversation_repair.END[None, :]
        )
        letters = "".join(conversation_repair.EDITS[e] for e in edit)
        more = int(conversation_repair.END[after[-1]]) // 2
        assert letters + "I" * more == audit


@pytest.mark.parametrize("block", [512, 3])
def test_query_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    draw = random.Random(block)
    rows = [r for k in range(150) for r in conversation(draw, k, draw.choice([1, 2, 5, 8, 30]))]
    rows += list(conversation(draw, None, 20)) + list(conversation(draw, 900, 400))
    rows += [(901, 0, "user", "Same.")] * 60 + [(902, None, "user", "Hi."), (902, None, "assistant", "Ho.")]
    table = spark.createDataFrame(
        [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int"
    )
    # One part for each partition of the shuffle, so that conversations cross their borders.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        found = queries.repairs(table.repartition(3))
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset(coalesce)


def test_given_conversations_as_brute_force(spark, small_folder):
    rows = spark.read.parquet(f"{small_folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = queries.QUERIES["op13_conversation_repair"](spark, small_folder)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute([tuple(r) for r in rows.collect()])


def test_repaired_rows_alternate(spark):
    draw = random.Random(1)
    rows = [r for k in range(40) for r in conversation(draw, k, 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = conversation_repair.placed(table)
    decisions = conversation_repair.edits(placed)
    found = conversation_repair.repaired(placed, decisions).orderBy("seq", "nth").collect()
    shas = {r.conv: r.repaired_sha256 for r in conversation_repair.audits(placed, decisions).collect()}
    for conv in range(40):
        own = [r for r in found if r.conv == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        lines = "\n".join(f"{r.role}:{r.text}" for r in own)
        assert hashlib.sha256(lines.encode()).hexdigest() == shas[conv]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert queries.repairs(table).collect() == []
