"""Structure repair of conversations by Four-Russians block tables.

Turns should read as an optional system turn and then pairs of a user's and an assistant's
turn. A turn is kept (cost 0), given another role (2) or deleted (3), and empty turns are
inserted (2); a truncated turn that stays costs 1 more; blank and repeated turns must go.
What is left to pay from a place on depends on the turns behind it and on the last role
written so far, one of four states, so a place has a vector of four costs. Less its
smallest entry it is one of a few normalised vectors. For every such vector and every block
of ``BLOCK`` symbols (a turn's role and fault) a table, filled once by rule, holds the
vector in front of the block and what was taken off. A conversation is read from its end,
one lookup a block; then blocks are expanded backward from their right vector and traced
forward, the ASCII-least edit that keeps the cost first, so ties are settled exactly.

The plan is found on rows of a few numbers. Texts are read once more, in order, behind the
plan of their conversation, and leave as they come: no conversation's texts are held
together. A conversation is one sequence, and its hash one chain, so it is one task's work;
that task holds some 40 bytes for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import memo, stored

DELETE, INSERT, RELABEL, TRUNCATED = 3, 2, 2, 1
#: Symbols of a block.
BLOCK = 3

#: States: nothing written yet, then the role of the last turn written.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or relabelled turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: A turn that is kept: its role in 0 to 3 (system, user, assistant, any other), and where it may follow.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: Symbols: must go; role whole; role truncated; nothing, which fills the last block.
MUST_GO, WHOLE, CUT_OFF, FILL, SYMBOLS = 0, 1, 5, 9, 10
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}

SPACE = r"\x20\x09-\x0D"
FAULTS = ("blank", "duplicate", "truncated")
COLUMNS = ("gaps", *FAULTS, "illegal", "cost")


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits that use a turn up, in ASCII order: (initial, cost, state behind)."""
    yield "D", DELETE, state
    if symbol != MUST_GO:
        role, extra = (symbol - CUT_OFF, TRUNCATED) if symbol >= CUT_OFF else (symbol - WHOLE, 0)
        if (state, role) in KEPT:
            yield "K", extra, KEPT[state, role]
        yield "R", RELABEL + extra, NEXT[state]


def _with_inserts(costs: list[float]) -> list[int]:
    """Costs where turns may be inserted first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


def _before(symbol: int, costs: tuple[int, ...]) -> list[int]:
    """Costs in front of a turn from those behind it."""
    if symbol == FILL:
        return list(costs)
    return _with_inserts([min(c + costs[to] for _, c, to in _edits(symbol, q)) for q in range(4)])


class Blocks:
    """Tables of single symbols and of blocks, between numbers of normalised cost vectors."""

    def __init__(self, size: int = BLOCK) -> None:
        self.size = size
        inf = float("inf")
        vectors = [tuple(_with_inserts([0, inf, inf, 0]))]  # behind the last turn: number 0
        number = {vectors[0]: 0}
        to, off = [], []
        for vector in vectors:  # grows until no symbol leads to a new vector
            found = [_before(symbol, vector) for symbol in range(SYMBOLS)]
            least = [min(f) for f in found]
            own = [tuple(c - m for c in f) for f, m in zip(found, least)]
            for f in own:
                if f not in number:
                    number[f] = len(vectors)
                    vectors.append(f)
            to.append([number[f] for f in own])
            off.append(least)
        self.vectors = vectors
        self.to, self.off = np.array(to), np.array(off)
        self.powers = SYMBOLS ** np.arange(size - 1, -1, -1)
        codes = np.arange(SYMBOLS**size)
        at = np.repeat(np.arange(len(vectors))[:, None], len(codes), 1)
        taken = np.zeros_like(at)
        for power in self.powers[::-1]:  # the last symbol of a block first
            symbol = codes // power % SYMBOLS
            taken += self.off[at, symbol]
            at = self.to[at, symbol]
        self.block_to, self.block_off = at.tolist(), taken.tolist()
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def trace(self, code: int, right: int, state: int) -> tuple[str, int]:
        """The cheapest edits of a block, ASCII-least, and the state behind them."""
        if (code, right, state) in self.traces:
            return self.traces[code, right, state]
        symbols = [code // int(p) % SYMBOLS for p in self.powers]
        behind = [right]
        for symbol in reversed(symbols[1:]):
            behind.append(int(self.to[behind[-1], symbol]))
        edits, q = "", state
        for symbol, vector in zip(symbols, reversed(behind)):
            if symbol == FILL:
                continue
            after = self.vectors[vector]
            here = _before(symbol, after)
            while True:
                ways = [(e, c + after[to], to) for e, c, to in _edits(symbol, q)]
                ways.append(("I", INSERT + here[NEXT[q]], NEXT[q]))
                edit, _, q = min(w for w in ways if w[1] == here[q])
                edits += edit
                if edit != "I":
                    break
        self.traces[code, right, state] = edits, q
        return edits, q

    def plan(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost, and the ASCII-least of the cheapest edits."""
        filled = np.full(-(-len(symbols) // self.size) * self.size, FILL, np.int64)
        filled[: len(symbols)] = symbols
        codes = (filled.reshape(-1, self.size) @ self.powers).tolist()
        vector, cost, rights = 0, 0, []
        for code in reversed(codes):
            rights.append(vector)
            cost += self.block_off[vector][code]
            vector = self.block_to[vector][code]
        cost += self.vectors[vector][START]
        edits, state = [], START
        for code, right in zip(codes, reversed(rights)):
            own, state = self.trace(code, right, state)
            edits.append(own)
        while state not in (START, ASSISTANT):
            edits.append("I")
            state = NEXT[state]
        return cost, "".join(edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by ``crc32(conv_id:turn) % 20``, and ``present``, false for a dropped one.

    0 drops a turn, 1 empties its text, 2 removes its marks of sentence ends, 3 repeats it,
    4 makes it the user's. Nulls read as one space; a null turn stays null as a place.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("said", "[.!?]", ""))
    copies = F.when(F.col("fate") == 0, F.array(F.lit(False))).when(F.col("fate") == 3, F.array(F.lit(True), F.lit(True)))
    return conversations.select(
        "conv_id", "turn", spaced["role"].alias("own"), spaced["text"].alias("said"), fate.alias("fate")
    ).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("own")).alias("role"),
        text.otherwise(F.col("said")).alias("text"),
        F.explode(copies.otherwise(F.array(F.lit(True)))).alias("present"),
    )


def _borders(ids: pa.Array, last: object, any_before: bool) -> np.ndarray:
    """Places where another id than the one in front begins."""
    out = np.zeros(len(ids), bool)
    if len(ids):
        out[0] = not any_before or ids[0].as_py() != last
        one, two = ids.slice(0, len(ids) - 1), ids.slice(1)
        differ = pc.fill_null(pc.not_equal(one, two), True)
        both = pc.and_(pc.is_null(one), pc.is_null(two))
        out[1:] = pc.and_not(differ, both).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def _one_plan(blocks: Blocks, rows: list[tuple[np.ndarray, ...]]) -> tuple:
    """Gaps, faults, illegal neighbours, cost and edits of one conversation's turns."""
    role, blank, cut_off, one, two, turn, known, present = (np.concatenate(x) for x in zip(*rows))
    role, blank, cut_off, one, two, turn, known = (x[present] for x in (role, blank, cut_off, one, two, turn, known))
    turn = turn[known]
    gaps = int(turn.max()) - int(turn.min()) + 1 - len(np.unique(turn)) if len(turn) else 0
    order = np.lexsort((np.arange(len(one)), two, one))
    repeated = np.zeros(len(one), bool)
    repeated[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    repeated &= ~blank
    cut_off = cut_off & ~blank & ~repeated
    symbols = np.where(blank | repeated, MUST_GO, np.where(cut_off, CUT_OFF, WHOLE) + role)
    legal = np.isin(role[:-1] * 4 + role[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
    cost, edits = blocks.plan(symbols)
    return gaps, *(int(x.sum()) for x in (blank, repeated, cut_off)), int((~legal).sum()), cost, edits


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: Blocks = memo("conversation blocks", Blocks)
    rows: list[tuple] = []
    last, done = None, []

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([d[0] for d in done], kind)]
        columns += [pa.array([d[1][k] for d in done], pa.int64()) for k in range(len(COLUMNS))]
        columns.append(pa.array([d[1][-1] for d in done], pa.string()))
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv", *COLUMNS, "audit"])

    kind = None
    for batch in batches:
        ids = batch.column(0)
        kind = ids.type
        turns = batch.column(6)
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:6]]
        columns += [pc.fill_null(turns, 0).to_numpy(zero_copy_only=False)]
        columns += [pc.is_valid(turns).to_numpy(zero_copy_only=False), batch.column(7).to_numpy(zero_copy_only=False)]
        cuts = _borders(ids, last, bool(rows)).tolist()
        starts = [0, *cuts] if not cuts or cuts[0] else cuts
        for first, to in zip(starts, [*starts[1:], len(ids)]):
            if first in cuts and rows:
                done.append((last, _one_plan(blocks, rows)))
                rows = []
            last = ids[first].as_py()
            rows.append(tuple(c[first:to].copy() for c in columns))
        if len(done) >= 5000:
            yield flush(kind)
    if rows:
        done.append((last, _one_plan(blocks, rows)))
    if done:
        yield flush(kind)


def _order(rows: DataFrame, *first: str) -> DataFrame:
    """Every conversation in one partition, its turns in order, missing turns first."""
    turn = F.col("turn").asc_nulls_first()
    return rows.repartition("conv").sortWithinPartitions("conv", *first, turn, "role", "one", "two")


def _numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text))
    return rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(role, text).alias("one"),
        F.xxhash64(text, F.lit(1), role).alias("two"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
    )


def _plan_rows(rows: DataFrame) -> DataFrame:
    initial = F.substring("role", 1, 1)
    role = reduce(lambda x, y: x.when(initial == y[1], y[0]), enumerate("sua"), F.when(F.lit(False), 0)).otherwise(3)
    narrow = rows.select(
        "conv",
        role.alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut_off"),
        "one",
        "two",
        "turn",
        "present",
        "role",
    )
    kind = rows.schema["conv"].dataType.simpleString()
    columns = ", ".join(f"{c} bigint" for c in COLUMNS)
    return stored(_order(narrow).mapInArrow(_plans, f"conv {kind}, {columns}, audit string"))


def _state_of(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Plans and repaired turns in order: ("plan", row) and ("turn", (edit, role, text))."""
    edits, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state, at = NEXT[state], at + 1
            yield "turn", ("I", ROLE_NAMES[state], "")

    for batch in batches:
        names = batch.schema.names
        place = {c: names.index(c) for c in ("plan", "role", "text")}
        plans, roles, texts = (batch.column(place[c]) for c in ("plan", "role", "text"))
        is_plan = pc.is_valid(plans).to_numpy(zero_copy_only=False).tolist()
        for i, new in enumerate(is_plan):
            if new:
                row = plans[i].as_py()
                edits, at, state = row["audit"], 0, START
                yield "plan", row
                yield from inserted()
                continue
            edit, at = edits[at], at + 1
            if edit == "K":
                role = roles[i].as_py()
                state = _state_of(role)
                yield "turn", (edit, role, texts[i].as_py())
            elif edit == "R":
                state = NEXT[state]
                yield "turn", (edit, ROLE_NAMES[state], texts[i].as_py())
            yield from inserted()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield batch

    done, plan, digest, between = [], None, None, b""

    def flush() -> pa.RecordBatch:
        kind = schema.field("plan").type
        rows = pa.array([d[0] for d in done], kind)
        out = pa.RecordBatch.from_arrays([*rows.flatten(), pa.array([d[1] for d in done])], [*(f.name for f in kind), "repaired_sha256"])
        done.clear()
        return out

    for what, row in _edited(watched()):
        if what == "turn":
            digest.update(between + f"{row[1]}:{row[2]}".encode())
            between = b"\n"
            continue
        if plan is not None:
            done.append((plan, digest.hexdigest()))
        plan, digest, between = row, hashlib.sha256(), b""
        if len(done) >= 5000:
            yield flush()
    if plan is not None:
        done.append((plan, digest.hexdigest()))
        yield flush()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv", "place", "edit", "role", "text")
    kind, conv, place, out, held = None, None, 0, [], 0

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("plan").type.field("conv").type
            yield batch

    def flush() -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for what, row in _edited(watched()):
        if what == "plan":
            conv, place = row["conv"], 0
            continue
        out.append((conv, place, *row))
        place, held = place + 1, held + len(row[2])
        if len(out) >= 5000 or held > 4_000_000:
            yield flush()
            held = 0
    if out:
        yield flush()


def _behind_plans(rows: DataFrame) -> tuple[DataFrame, str]:
    """The turns of every conversation in order behind the row of its plan; the plan's columns as DDL."""
    plans = _plan_rows(rows)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plans.schema)
    turns = rows.filter("present").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "one", "two", "text", F.lit(None).cast(plans.schema).alias("plan")
    )
    heads = plans.select(
        "conv",
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        *(F.lit(0).cast("long").alias(c) for c in ("one", "two")),
        F.lit("").alias("text"),
        F.struct(*plans.columns).alias("plan"),
    )
    return _order(turns.unionByName(heads), "kind"), columns


def repair_plans(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row for each conversation: what is wrong with it, and its cheapest repair.

    Turns are taken in the order of ``turn``, missing ones first, then of role and of a hash
    of role and text. Columns: ``conv``; ``gaps``, the turn numbers missing between the least
    and the greatest; turns by their first fault: ``blank`` (no character but ASCII white
    space), ``duplicate`` (role and text seen earlier), ``truncated`` (last such character
    is no ``.``, ``!`` or ``?``); ``illegal`` neighbours, whose role initials are not su, ua
    or au; ``cost``; ``audit``, the initials of the edits in order (Delete, Insert, Keep,
    Rerole); ``repaired_sha256`` of the repaired turns, ``role:text``, one a line.

    Rows for which ``present`` does not hold only say that there is such a conversation; one
    without turns has zeros, no edits and the hash of nothing. Null roles and texts read as
    one space; null conversation ids are one conversation; repeated rows are duplicates; no
    rows give no rows. Other columns are neither read nor returned.
    """
    rows, columns = _behind_plans(_numbered(turns, conv, turn, role, text, present))
    return rows.select("plan", "role", "text").mapInArrow(_hashes, f"{columns}, repaired_sha256 string").withColumnRenamed("conv", conv)


def repaired_turns(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The repaired turns: ``conv``, ``place`` from 0, ``edit`` (I, K or R), ``role``, ``text``.

    See ``repair_plans``; a conversation of which nothing is left has no rows.
    """
    rows, columns = _behind_plans(_numbered(turns, conv, turn, role, text, present))
    kind = columns.split(", ")[0]
    schema = f"{kind}, place bigint, edit string, role string, text string"
    return rows.select("plan", "role", "text").mapInArrow(_turns, schema).withColumnRenamed("conv", conv)
