import hashlib
import itertools
import random
import zlib

import pytest

from ledgerlens.llm import repair


def all_repairs(codes):
    """Cost and edits of every sequence of edits that gives a well-formed conversation."""
    found = []

    def go(i, state, cost, edits, inserted):
        if i == len(codes) and state in (0, 3):
            found.append((cost, edits))
        if inserted < 3:
            go(i, repair.AFTER[state], cost + 2, edits + "I", inserted + 1)
        if i == len(codes):
            return
        code = codes[i]
        go(i + 1, state, cost + 3, edits + "D", 0)
        if code.isdigit():
            return
        extra = code.isupper()
        kind = code.lower()
        if kind == "s" and state == 0:
            go(i + 1, 1, cost + extra, edits + "K", 0)
        if kind == "u" and state != 2:
            go(i + 1, 2, cost + extra, edits + "K", 0)
        if kind == "a" and state == 2:
            go(i + 1, 3, cost + extra, edits + "K", 0)
        go(i + 1, repair.AFTER[state], cost + 2 + extra, edits + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def test_edits_are_the_cheapest_and_then_the_ascii_least():
    for n in (1, 2, 3):
        for codes in itertools.product("suaxUA1", repeat=n):
            codes = "".join(codes)
            edits, state = repair.walk(codes, repair.END, 0, True)
            assert (repair.cost_of(codes, edits), edits) == all_repairs(codes), codes
            assert state in (0, 3)


def test_blocks_give_what_one_walk_gives():
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choices(repair.CODES, k=rng.randint(1, 60)))
        cut = sorted({0, len(codes), *(rng.randint(0, len(codes)) for _ in range(4))})
        blocks = [codes[a:b] for a, b in zip(cut, cut[1:])]
        rows = [
            {"conv": "c", "block": i, "blocks": len(blocks), "first": a + 1, "codes": b}
            for i, (a, b) in enumerate(zip(cut, blocks))
        ]
        ends = list(repair._ends(reversed(list(repair._spelled(iter(rows))))))
        chosen = list(repair._chosen(repair._walks(iter(ends[::-1]))))
        whole, _ = repair.walk(codes, repair.END, 0, True)
        assert "".join(c["edits"] for c in chosen) == whole
        assert sum(c["cost"] for c in chosen) == repair.cost_of(codes, whole)
        shape = codes.translate(repair.INITIALS)
        assert sum(c["illegal"] for c in chosen) == sum(a + b not in repair.LEGAL for a, b in zip(shape, shape[1:]))


def brute(rows):
    """The report of one conversation from its (conv_id, turn, role, text) rows."""
    after = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if kind == 3 else 1)

    def place(r):
        digest = hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        return (r[0] is not None, r[0] or 0, r[1], digest)

    after.sort(key=place)
    seen, codes, count = set(), "", {"b": 0, "d": 0, "t": 0}
    for turn, role, text in after:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += str("suax".index(kind) + 1) if fault in ("b", "d") else kind.upper() if fault == "t" else kind
    edits, _ = repair.walk(codes, repair.END, 0, True) if codes else ("", 0)
    lines, state, i = [], 0, 0
    for e in edits:
        if e in "IR":
            state = repair.AFTER[state]
            lines.append(f"{repair.ROLE_OF[state]}:{'' if e == 'I' else after[i][2]}")
        elif e == "K":
            state = {"s": 1, "u": 2, "a": 3}[after[i][1][0]]
            lines.append(f"{after[i][1]}:{after[i][2]}")
        i += e != "I"
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    shape = codes.translate(repair.INITIALS)
    illegal = sum(a + b not in repair.LEGAL for a, b in zip(shape, shape[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, count["b"], count["d"], count["t"], illegal, repair.cost_of(codes, edits), edits, sha)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "no", " \t", "", None, "What?", "é!\n", "a.b ", " "]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)))
    rows += [(900, t, ("user", "assistant")[t % 2], f"{t}." if t % 7 else "cut") for t in range(700)]
    rows += [(901, 1, "user", "Same.")] * 200
    return rows


@pytest.mark.parametrize("block_rows", [5, 1024])
def test_report_equals_brute_force(spark, talks, block_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, pos string, n int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(df, block_rows=block_rows).collect()}
    by = {}
    for r in talks:
        by.setdefault(r[0], []).append(r)
    assert got == {k: brute(v) for k, v in by.items()}


def test_long_conversations_keep_few_vectors(monkeypatch):
    # the walk asks for every vector twice, going backward and a block at a time
    calls = []
    inner = repair.back
    monkeypatch.setattr(repair, "back", lambda code, after: calls.append(1) or inner(code, after))
    repair.walk("ua" * 2000, repair.END, 0, True)
    assert len(calls) == 8000


def test_very_long_texts_and_no_rows(spark):
    long = "word " * 400_000 + "end."
    df = spark.createDataFrame([(7, 5, "user", long), (7, 6, "assistant", "ok.")], "conv_id long, turn long, role string, text string")
    row = repair.repair_report(df).first()
    assert tuple(row)[1:] == brute([(7, 5, "user", long), (7, 6, "assistant", "ok.")])
    assert repair.repair_report(df.limit(0)).isEmpty()
