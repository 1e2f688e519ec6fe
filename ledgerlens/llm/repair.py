"""Conversation structure repair: cheapest edits to well-formed turns by a checkpointed DP.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.
Reading its role initials is an automaton of four states: 0 nothing yet, 1 after the system turn,
2 after a user, 3 after an assistant; 0 and 3 may end. Cost vectors hold, for each state, the least
cost of repairing the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import small_batches, stripped
from ledgerlens.operators.ranks import number_rows
from ledgerlens.sources.storage import scratch_path

BLOCK_ROWS = 1024  # turns of a conversation that one step works on, or the root of their number
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 60
AFTER = (2, 2, 3, 2)  # state after the next user or assistant turn
ROLE_OF = {2: "user", 3: "assistant"}
# state after a kept turn by initial, for each state; None where it may not stand
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")


def damage(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` of rows damaged by crc32 of conversation and turn, modulo 20:
    0 is dropped, 1 loses its text, 2 its ``.!?``, 3 comes twice, 4 turns into a user's. Null ids, roles and
    texts stand as one space; ``conv`` is the id as text."""
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit(" "))
    turn = F.coalesce(F.col(turn_col).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = turns.select(
        conv.alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    )
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _consume(code: str, q: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of every way to use up a row in state q, in ASCII order.

    A code is the initial of a row (s, u, a, or x for any other), in capitals if the row is
    truncated, or a digit (1 to 4 for these initials) if it has to go.
    """
    yield "D", DELETE, q
    if code.isdigit():
        return
    extra = TRUNCATED if code.isupper() else 0
    to = KEPT[code.lower()][q]
    if to is not None:
        yield "K", KEEP + extra, to
    yield "R", REROLE + extra, AFTER[q]


CODES = "suaxSUAX1234"
INITIALS = str.maketrans("SUAX1234", "suaxsuax")
WAYS = {c: tuple(tuple(_consume(c, q)) for q in range(4)) for c in CODES}


def back(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector before a row from the one behind it."""
    v = [min(cost + after[to] for _, cost, to in ways) for ways in WAYS[code]]
    # turns inserted before the row: at most two are of use
    u = min(v[2], INSERT + v[3])
    a = min(v[3], INSERT + u)
    u = min(u, INSERT + a)
    return (min(v[0], INSERT + u), min(v[1], INSERT + u), u, a)


def _matrix(code: str) -> np.ndarray:
    rows = [back(code, tuple(0 if i == j else NEVER // 4 for i in range(4))) for j in range(4)]
    return np.array(rows, dtype=np.int64).T


MATRICES = {c: _matrix(c) for c in CODES}


def block_matrix(codes: str) -> np.ndarray:
    """What ``back`` does over all rows of a block, as a matrix of sums and minima."""
    out = MATRICES[codes[-1]]
    for code in reversed(codes[:-1]):
        out = np.minimum((MATRICES[code][:, :, None] + out[None]).min(axis=1), NEVER // 4)
    return out


def walk(codes: str, end: tuple[int, ...], state: int, final: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits over ``codes`` from ``state``, and the state behind them.

    ``end`` is the cost vector behind the last row. Going backward, vectors are kept only before
    every r-th row, r about the root of the number of rows; going forward, those of the r rows
    ahead are worked out again from the next kept one, and each edit is the ASCII-least of those
    that lie on a cheapest way (are tight). So memory is about two roots. Turns inserted behind the
    last row are only given if the block is the ``final`` one of its conversation.
    """
    n = len(codes)
    step = isqrt(n) + 1
    kept = {}
    v = end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0:
            kept[i + 1] = v
        v = back(codes[i], v)
    out = []
    for low in range(0, n, step):
        high = min(low + step, n)
        ahead = [kept.get(high, end) if high < n else end]
        for i in range(high - 1, low - 1, -1):
            ahead.append(back(codes[i], ahead[-1]))
        ahead.reverse()
        for i in range(low, high):
            here, after = ahead[i - low], ahead[i - low + 1]
            while True:
                ways = WAYS[codes[i]][state]
                left = here[state]
                if DELETE + after[state] == left:
                    out.append("D")
                    break
                if INSERT + here[AFTER[state]] == left:
                    out.append("I")
                    state = AFTER[state]
                    continue
                edit, state = next((e, to) for e, cost, to in ways[1:] if cost + after[to] == left)
                out.append(edit)
                break
    while final and END[state]:
        out.append("I")
        state = AFTER[state]
    return "".join(out), state


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in small_batches(batches):
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _map_rows(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` from the rows of a partition to rows, in order and one at a time."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(n, kinds[k]) for n, k in (part.strip().split(" ") for part in schema.split(","))])
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), fields), schema)


def _spelled(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        yield r | {"matrix": block_matrix(r["codes"]).ravel().tolist() if r["blocks"] > 1 else None}


def _ends(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation come last one first; each gets the cost vector behind it."""
    conv, v = None, END
    for r in rows:
        if r["conv"] != conv:
            conv, v = r["conv"], END
        yield {k: r[k] for k in ("conv", "block", "blocks", "first", "codes")} | {"end": list(v)}
        if r["block"]:
            m = np.array(r["matrix"], dtype=np.int64).reshape(4, 4)
            v = tuple(int(x) for x in (m + np.array(v)[None, :]).min(axis=1))


def _walks(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits of a block from each state it may be entered in."""
    for r in rows:
        end, final = tuple(r["end"]), r["block"] + 1 == r["blocks"]
        found = [walk(r["codes"], end, q, final) if r["block"] or not q else ("", 0) for q in range(4)]
        yield {k: r[k] for k in ("conv", "block", "first", "codes")} | {
            "edits": [f[0] for f in found], "exits": [f[1] for f in found],
        }


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation come in order; each is entered in the state the last one left."""
    conv, state, last = None, 0, ""
    for r in rows:
        if r["conv"] != conv:
            conv, state, last = r["conv"], 0, ""
        shape = last + r["codes"].translate(INITIALS)
        illegal = sum(shape[i : i + 2] not in LEGAL for i in range(len(shape) - 1))
        last = shape[-1:]
        edits = r["edits"][state]
        yield {"conv": conv, "block": r["block"], "first": r["first"], "codes": r["codes"], "state": state,
               "edits": edits, "cost": cost_of(r["codes"], edits), "illegal": illegal}
        state = r["exits"][state]


def cost_of(codes: str, edits: str) -> int:
    total, i = 0, 0
    for e in edits:
        if e == "I":
            total += INSERT
            continue
        total += {"D": DELETE, "K": KEEP, "R": REROLE}[e]
        if e != "D" and codes[i].isupper():
            total += TRUNCATED
        i += 1
    return total


def _lines(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits that leave a turn, one row each: ``pos`` of the row they stand at or before, ``sub`` among
    those of one position, and the role given to it."""
    for r in rows:
        state, i, sub = r["state"], 0, 0
        for e in r["edits"]:
            if e in "IR":
                state = AFTER[state]
            elif e == "K":
                state = KEPT[r["codes"][i].lower()][state]
            if e != "D":
                yield {"conv": r["conv"], "pos": r["first"] + i, "sub": sub, "edit": e,
                       "role": ROLE_OF[state] if e in "IR" else None}
            sub += 1
            if e != "I":
                i, sub = i + 1, 0


class Repair:
    """Faults, edits and repaired turns of all conversations of ``turns`` (``conv``, ``turn``, ``role``,
    ``text``, as ``damage`` gives them; roles and texts without nulls).

    Rows stand by turn (nulls first), ties by role, then by a digest of role and text; repeated rows
    count as duplicates. Only slim rows are put in order (by ``number_rows``, over the whole cluster);
    a text moves once to drop its repetitions and once to its place.

    A conversation is cut into blocks of ``BLOCK_ROWS`` rows, or of the root of its rows if that is
    more. Blocks are turned into cost matrices in parallel; one pass backward over the blocks of a
    conversation stores the cost vector behind each (the checkpoints); blocks are walked in parallel
    again, from every state they may be entered in, and one pass forward picks the right walk. So no
    task holds more than a block, or one small row for each block, however long a conversation is.

    An empty table gives empty results.
    """

    def __init__(self, turns: DataFrame, block_rows: int = BLOCK_ROWS):
        spark = turns.sparkSession
        text = stripped(F.col("text"))
        blank = text == ""
        open_end = ~F.substring(text, -1, 1).isin(".", "!", "?")
        initial = F.substring("role", 1, 1)
        initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
        # 128 bits stand for role and text
        digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
        marked = turns.select("conv", "turn", "role", digest.alias("h"), initial.alias("initial"),
                              F.when(blank, "b").when(open_end, "t").otherwise("").alias("fault"), "text")
        slim = number_rows(marked.drop("text"), ["conv"], ["turn", "role", "h"], rank="pos", size="n")
        firsts = slim.where("fault <> 'b'").groupBy("conv", "h").agg(F.min("pos").alias("pos"))
        firsts = firsts.select("conv", "pos", F.lit(True).alias("is_first"))
        slim = slim.join(firsts, ["conv", "pos"], "left")
        again = (F.col("fault") != "b") & F.col("is_first").isNull()
        fault = F.when(again, "d").otherwise(F.col("fault"))
        path = scratch_path(spark, "repair-rows")
        slim.withColumn("fault", fault).drop("is_first").write.parquet(path)
        self.rows = spark.read.parquet(path)
        self.texts = marked.select("conv", "h", "text").dropDuplicates(["conv", "h"])

        code = F.when(F.col("fault").isin("b", "d"), F.translate("initial", "suax", "1234"))
        code = code.when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
        per = F.greatest(F.lit(block_rows), F.ceil(F.sqrt("n"))).cast("long")
        cut = self.rows.withColumn("block", F.floor((F.col("pos") - 1) / per).cast("long"))
        cut = cut.withColumn("blocks", F.ceil(F.col("n") / per).cast("long"))
        listed = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"))))
        blocks = cut.groupBy("conv", "block").agg(F.max("blocks").alias("blocks"), F.min("pos").alias("first"), listed.alias("l"))
        blocks = blocks.select("conv", "block", "blocks", "first", F.array_join("l.code", "").alias("codes"))
        whole = "conv string, block bigint, blocks bigint, first bigint, codes string"
        spelled = _map_rows(blocks, _spelled, f"{whole}, matrix array<bigint>")
        ends = _map_rows(spelled.repartition("conv").sortWithinPartitions("conv", F.desc("block")), _ends, f"{whole}, end array<bigint>")
        walks = _map_rows(ends.repartition("conv", "block"), _walks,
                          "conv string, block bigint, first bigint, codes string, edits array<string>, exits array<bigint>")
        chosen = _map_rows(walks.repartition("conv").sortWithinPartitions("conv", "block"), _chosen,
                           "conv string, block bigint, first bigint, codes string, state bigint, edits string, cost bigint, illegal bigint")
        path = scratch_path(spark, "repair-blocks")
        chosen.write.parquet(path)
        self.blocks = spark.read.parquet(path)

    def report(self) -> DataFrame:
        """One row per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
        ``illegal``, ``cost``, ``audit``."""
        def count(mark: str) -> Column:
            return F.count_if(F.col("fault") == mark)

        turn = F.col("turn")
        gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0))
        rows = self.rows.groupBy("conv").agg(gaps.cast("long").alias("gaps"), count("b").alias("blank"),
                                             count("d").alias("duplicate"), count("t").alias("truncated"))
        pieces = F.array_sort(F.collect_list(F.struct("block", "edits")))
        blocks = self.blocks.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), pieces.alias("p"))
        return rows.join(blocks.withColumn("audit", F.array_join("p.edits", "")).drop("p"), "conv")

    def repaired(self) -> DataFrame:
        """The repaired turns: ``conv``, ``pos`` and ``sub`` (their order), ``edit``, ``role``, ``text``."""
        lines = _map_rows(self.blocks.select("conv", "first", "codes", "state", "edits"), _lines,
                          "conv string, pos bigint, sub bigint, edit string, role string")
        own = lines.where("edit <> 'I'").join(self.rows.select("conv", "pos", "h", F.col("role").alias("old")), ["conv", "pos"])
        own = own.join(self.texts, ["conv", "h"]).select("conv", "pos", "sub", "edit", F.coalesce("role", "old").alias("role"), "text")
        return own.unionByName(lines.where("edit = 'I'").withColumn("text", F.lit("")))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256``: ``role:text`` of its turns, joined by line feeds. Turns pass by
    in order; a task holds one of them and the state of the hash."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        conv, seen = None, None
        for r in rows:
            if r["conv"] != conv:
                if seen is not None:
                    yield {"conv": conv, "repaired_sha256": seen.hexdigest()}
                conv, seen = r["conv"], hashlib.sha256()
            else:
                seen.update(b"\n")
            seen.update(f"{r['role']}:{r['text']}".encode())
        if seen is not None:
            yield {"conv": conv, "repaired_sha256": seen.hexdigest()}

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "pos", "sub").select("conv", "role", "text")
    return _map_rows(ordered, run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, conv_col: str = "conv_id", block_rows: int = BLOCK_ROWS, **columns: str) -> DataFrame:
    """``damage`` and ``Repair`` over all rows: one row for every conversation of ``turns``, also for
    those with no row left (zeros, empty audit, digest of nothing). A null id is a conversation, the
    same as the id of one space. Other columns of the input are not read."""
    work = Repair(damage(turns, conv_col, **columns), block_rows)
    found = work.report().join(digests(work.repaired()), "conv", "left")
    every = turns.select(F.col(conv_col).alias("conv_id")).distinct()
    every = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(found, "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
