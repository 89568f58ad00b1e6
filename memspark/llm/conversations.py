"""Structure repair of conversations: the cheapest edits after which role initials read (s?(ua)+)?.

A row is a symbol (its role's initial and its fault).  Equal consecutive symbols are one run; a symbol
is a min-plus matrix over the four states of the pattern, its binary powers are cached, and a run
advances the vector of costs by those of its length.  Going back over the runs gives the cost from
each place to the end, and going forward again unrolls the choices, halving runs.

Rows are dealt by range of (conversation, turn), so that a conversation of any length lies in many
tasks.  A task finishes the conversations that it holds whole.  Of the first and the last one of each
task, blocks of rows go to the shared folder; from their matrices (16 numbers a block) follow the
costs after each block, from those and the symbols its edits, and the blocks are edited where they lie.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, tidy, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
END = (0, 2 * INSERT, INSERT, 0)  # costs of ending from each state
NEVER = 1 << 40
RUN = re.compile(r"(.)\1*")
LETTERS = "suao"  # classes of initials; as a symbol in upper case where truncated, x where it must go
WHITE = " \t\n\x0b\f\r"

MESSAGES = "messages array<struct<role string, text string>>"
COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
STATS = ", ".join(f"{c} long" for c in [*COUNTS, "min_turn", "max_turn"])


# -- the DP --------------------------------------------------------------------------------------


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


@functools.cache
def power(symbol: str, k: int) -> np.ndarray:
    """The min-plus matrix of 2**k rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    inserts, row = np.full((4, 4), NEVER), np.full((4, 4), NEVER)
    for q in range(4):
        inserts[q, NEXT[NEXT[q]]], inserts[q, NEXT[q]], row[q, q] = 2 * INSERT, INSERT, DELETE
        inserts[q, q] = 0
        if symbol != "x":
            extra = TRUNCATED * symbol.isupper()
            row[q, NEXT[q]] = min(row[q, NEXT[q]], REROLE + extra)
            if (to := KEPT.get((symbol.lower(), q))) is not None:
                row[q, to] = min(row[q, to], KEEP + extra)
    return times(inserts, row)


def matrix(symbols: str) -> np.ndarray:
    """The min-plus matrix of a block of rows."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for run in RUN.finditer(symbols):
        out = functools.reduce(times, [power(run[1], k) for k in bits(len(run[0]))], out)
    return out


def bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


@functools.lru_cache(1 << 16)
def _advanced(symbol: str, count: int, after: tuple) -> tuple:
    vector = np.array(after)
    for k in bits(count):
        vector = (power(symbol, k) + vector).min(1)
    return tuple(vector.tolist())


def advanced(symbol: str, count: int, after: tuple) -> tuple:
    """The costs before `count` rows of a symbol, from those after them."""
    least = min(after)
    return tuple(x + least for x in _advanced(symbol, count, tuple(x - least for x in after)))


@functools.lru_cache(1 << 16)
def _unrolled(symbol: str, count: int, state: int, after: tuple) -> tuple[str, int]:
    if count > 1:
        half = 1 << ((count - 1).bit_length() - 1)
        first, state = unrolled(symbol, half, state, advanced(symbol, count - half, after))
        second, state = unrolled(symbol, count - half, state, after)
        return first + second, state
    before, said = advanced(symbol, 1, after), ""
    extra = TRUNCATED * symbol.isupper()
    while True:  # the ASCII-least of the edits that reach the least cost
        if DELETE + after[state] == before[state]:
            return said + "D", state
        if INSERT + before[NEXT[state]] == before[state]:
            said, state = said + "I", NEXT[state]
            continue
        to = KEPT.get((symbol.lower(), state))
        if to is not None and KEEP + extra + after[to] == before[state]:
            return said + "K", to
        return said + "R", NEXT[state]


def unrolled(symbol: str, count: int, state: int, after: tuple) -> tuple[str, int]:
    """(edits of `count` rows of a symbol from a state, the state after them)."""
    least = min(after)
    return _unrolled(symbol, count, state, tuple(x - least for x in after))


def edits(symbols: str, state: int = EMPTY, after: tuple = END, last: bool = True) -> tuple[str, int, int]:
    """(edits, their cost, the state after them) of a block of rows; last: its conversation ends there."""
    runs = [(m[1], len(m[0])) for m in RUN.finditer(symbols)]
    costs = [after]
    for symbol, count in reversed(runs):
        costs.append(advanced(symbol, count, costs[-1]))
    said, begin = [], costs[-1][state]
    for (symbol, count), then in zip(runs, costs[-2::-1]):
        text, state = unrolled(symbol, count, state, then)
        said.append(text)
    end = after[state]
    while last and END[state]:
        said.append("I")
        state, end = NEXT[state], 0
    return "".join(said), begin - end, state


@functools.lru_cache(1 << 16)
def short_edits(symbols: str) -> tuple[str, int]:
    return edits(symbols)[:2]


# -- rows ----------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text; nulls count as one space) with planted faults,
    by the remainder of crc32(conv_id:turn) by 20: 0 drops a row (present is false), 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 sets role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.encode(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")), "utf-8")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), (k != 0).alias("present"), copies).drop("copy")


def ordered(rows: DataFrame, present: Column) -> DataFrame:
    """Rows in ranges of (conv_id, turn, role, text), with kind (0 blank, 1 duplicate of a row of an
    earlier turn, 2 truncated, 3 no fault, -1 not present), the class of the initial, and a hash of
    role and text."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), F.coalesce(present, F.lit(False)).alias("_there"))
    rows = rows.withColumns({c: F.when(F.col("_there"), F.col(c)) for c in ("turn", "role", "text")})
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "kind": F.when(~F.col("_there"), -1).when(bare == "", 0).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(2),
        "letter": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
        "said": F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "utf-8")),
    })
    # texts of several turns of a conversation; copies within a turn stand side by side and are seen there
    again = rows.where(F.col("kind") > 0).groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"))
    again = again.agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"), F.max(F.col("turn").isNull()).alias("_null"))
    again = again.where((F.col("_first") < F.col("_last")) | F.col("_null") & F.col("_first").isNotNull())
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    later = (F.col("kind") > 0) & F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first")))
    rows = rows.select("conv_id", "turn", "role", "text", F.when(later, 1).otherwise(F.col("kind")).cast("int").alias("kind"), F.col("letter").cast("int").alias("letter"), "said")
    return rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")


def edited(roles: pa.Array, texts: pa.Array, letters: np.ndarray, audits: list[str], shifts: list[int] | None) -> pa.ListArray:
    """The repaired messages of blocks whose rows stand one after another.  shifts: 1 for a block that
    goes on after a user's row; None: the blocks are whole conversations."""
    n = np.fromiter(map(len, audits), np.int64, len(audits))
    codes = np.frombuffer("".join(audits).encode(), np.uint8)
    block = np.repeat(np.arange(len(audits)), n)
    insert, keep = codes == ord("I"), codes != ord("D")
    row = np.cumsum(~insert) - 1
    codes, row, insert, block = codes[keep], row[keep], insert[keep], block[keep]
    many = np.bincount(block, minlength=len(audits))
    ends = np.cumsum(many)
    place = np.arange(len(block)) - (ends - many)[block]
    shift = np.zeros(len(audits), np.int64) if shifts is None else np.maximum(np.array(shifts, np.int64), 0)
    opens = np.ones(len(audits), bool) if shifts is None else np.array(shifts) < 0
    head = np.flatnonzero((place == 0) & (codes == ord("K")))
    head = head[(letters[row[head]] == 0) & opens[block[head]]]  # a system row at a conversation's start
    shift[block[head]] = 1
    set_role = codes != ord("K")
    new = np.where((place - shift[block]) % 2 == 0, "user", "assistant")
    source = pa.array(np.where(insert, 0, row), pa.int64(), mask=insert)
    role = pc.if_else(pa.array(set_role), pa.array(new, pa.string()), roles.take(source)) if len(row) else roles.slice(0, 0)
    text = texts.take(source).fill_null("") if len(row) else texts.slice(0, 0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([role, text], ["role", "text"]))


def first_pass(kind_of_id: str, block_rows: int, block_bytes: int):
    """A function for mapInArrow over ordered(): finished conversations, and blocks of open ones."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        carry = None  # the rows so far of the last conversation
        unsure, open_id = True, None  # whether the first rows to come may belong to an open conversation; its id
        anything = True  # the first conversation of the task, whatever its id
        before = None  # the last row of an emitted block of it

        def stats(rows, first, groups):
            """(present rows, symbols, numbers by group) of rows with group numbers."""
            turn, kind, letter, said = (rows.column(k) for k in (1, 4, 5, 6))
            kind, letter = kind.to_numpy().copy(), letter.to_numpy()
            has = turn.is_valid().to_numpy(zero_copy_only=False)
            turn = turn.fill_null(0).to_numpy()
            n = len(kind)
            same = np.zeros(n, bool)
            if n > 1:
                equal = pc.equal(said.slice(1), said.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                same[1:] = equal & (first[1:] == first[:-1]) & (turn[1:] == turn[:-1]) & (has[1:] == has[:-1])
            if before is not None and n:
                same[0] = before == (has[0], turn[0], said[0].as_py())
            kind[same & (kind > 0)] = 1
            count = lambda where: np.bincount(first[where], minlength=groups)
            inner = np.append(False, first[1:] == first[:-1])[:n]
            legal = np.zeros(n, bool)
            legal[1:] = np.isin(letter[:-1] * 4 + letter[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
            new_turn = has & ~(inner & np.append(False, has[:-1])[:n] & np.append(False, turn[1:] == turn[:-1])[:n])
            low, high = np.full(groups, np.iinfo(np.int64).max), np.full(groups, np.iinfo(np.int64).min)
            np.minimum.at(low, first[has], turn[has])
            np.maximum.at(high, first[has], turn[has])
            none = count(has) == 0
            codes = np.frombuffer(b"suaoSUAOx", np.uint8)
            symbols = codes[np.where(kind < 2, 8, letter + 4 * (kind == 2))].tobytes().decode()
            numbers = {"n_rows": count(kind >= 0), "blank": count(kind == 0), "duplicate": count(kind == 1), "truncated": count(kind == 2), "illegal": count(inner & ~legal), "turns": count(new_turn)}
            columns = [*(pa.array(numbers[c]) for c in COUNTS), pa.array(low, mask=none), pa.array(high, mask=none)]
            last = (has[-1], turn[-1], said[-1].as_py()) if n else before
            return letter, symbols, numbers["n_rows"], columns, last

        def split_groups(rows):
            """Whether each row is the first of its conversation here."""
            ids = rows.column(0)
            n = len(ids)
            new = np.ones(n, bool)
            if n > 1:
                a, b = ids.slice(1), ids.slice(0, n - 1)
                equal = pc.equal(a, b).fill_null(False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
                new[1:] = ~equal
            return new

        def out(ids, closed, numbers, symbols, matrices, ends, costs, audits, messages):
            n = len(ids)
            fields = [ids, pa.array(np.full(n, part, np.int64)), pa.array(numbers, pa.int64()), pa.array(np.full(n, closed))]
            fields += [pa.array(symbols, pa.string()), pa.array(matrices, pa.binary()), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())]
            return lambda columns: pa.RecordBatch.from_arrays([*fields, *columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string()), messages], names)

        names = ["conv_id", "part", "number", "whole", "symbols", "matrix", "first_letter", "last_letter", *COUNTS, "min_turn", "max_turn", "cost", "audit", "messages"]

        def closed_rows(rows):
            nonlocal number
            new = split_groups(rows)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            there = rows.column(4).to_numpy() >= 0
            here = rows.filter(pa.array(there))
            first = group[there]
            letter, symbols, many, columns, _ = stats(here, first, len(starts))
            ends = np.cumsum(many).tolist()
            found = [short_edits(s) if len(s) <= 32 else edits(s)[:2] for s in (symbols[e - m : e] for e, m in zip(ends, many.tolist()))]
            audits = [f[0] for f in found]
            messages = edited(here.column(2), here.column(3), letter, audits, None)
            n = len(starts)
            numbers = list(range(number, number + n))
            number += n
            return out(rows.column(0).take(pa.array(starts)), True, numbers, [None] * n, [None] * n, [(None, None)] * n, [f[1] for f in found], audits, messages)(columns)

        def open_rows(rows):
            nonlocal number, before
            here = rows.filter(pa.array(rows.column(4).to_numpy() >= 0))
            letter, symbols, many, columns, before = stats(here, np.zeros(len(here), np.int64), 1)
            messages = pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), pa.StructArray.from_arrays([here.column(2), here.column(3)], ["role", "text"]))
            ends = (int(letter[0]), int(letter[-1])) if len(here) else (None, None)
            number += 1
            return out(rows.column(0).slice(0, 1), False, [number - 1], [symbols], [matrix(symbols).astype("<i8").tobytes()], [ends], [None], [None], messages)(columns)

        for batch in batches:
            rows = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(split_groups(rows)).tolist()
            if unsure and not anything and rows.column(0)[0].as_py() != open_id:
                unsure, before = False, None
            if len(starts) > 1:
                if unsure:
                    yield open_rows(rows.slice(0, starts[1]))
                    unsure, before = False, None
                    starts = starts[1:]
                if len(starts) > 1:
                    yield closed_rows(rows.slice(starts[0], starts[-1] - starts[0]))
                anything = False
            carry = rows.slice(starts[-1])
            if len(carry) >= block_rows or carry.nbytes >= block_bytes:
                yield open_rows(carry)
                unsure, anything, open_id, carry = True, False, carry.column(0)[0].as_py(), None
        if carry is not None:
            yield open_rows(carry)

    schema = f"conv_id {kind_of_id}, part long, number long, whole boolean, symbols string, matrix binary, first_letter int, last_letter int, {STATS}, cost long, audit string, {MESSAGES}"
    return tidy(run), schema


def by_conversation(batches):
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    yield from itertools.groupby(rows(), key=lambda r: r[0])


def batches_of(rows, names: list[str], kinds: list):
    """Record batches of tuples."""
    while part := list(itertools.islice(rows, 2000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)


def backward(batches):
    """Blocks of a conversation, the last first -> the costs after each."""

    def rows():
        for _, blocks in by_conversation(batches):
            after, last = np.array(END), True
            for _, part, number, m in blocks:
                yield part, number, after.astype("<i8").tobytes(), last
                after, last = (np.frombuffer(m, "<i8").reshape(4, 4) + after).min(1), False

    yield from batches_of(rows(), ["part", "number", "after", "last"], [pa.int64(), pa.int64(), pa.binary(), pa.bool_()])


def forward(batches):
    """Blocks of a conversation in order -> their edits and what the border before each adds to counts."""

    def rows():
        for _, blocks in by_conversation(batches):
            state, block, letter, turn = EMPTY, 0, None, None
            for _, part, number, symbols, after, last, first_letter, last_letter, low, high in blocks:
                shift = -1 if state == EMPTY else int(state == USER)
                audit, cost, state = edits(symbols, state, tuple(np.frombuffer(after, "<i8").tolist()), last)
                illegal = int(letter is not None and first_letter is not None and (letter, first_letter) not in ((0, 1), (1, 2), (2, 1)))
                yield part, number, block, audit, cost, shift, illegal, -int(turn is not None and low == turn)
                block += 1
                letter = letter if last_letter is None else last_letter
                turn = turn if high is None else high

    yield from batches_of(rows(), ["part", "number", "block", "audit", "cost", "shift", "more_illegal", "more_turns"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])


def apply_edits(batches):
    """Blocks (first columns as they come, then messages, audit, letters of the symbols, shift)."""
    for batch in batches:
        k = batch.num_columns - 3
        for at in range(len(batch)):
            one = batch.slice(at, 1)
            messages = one.column(k).combine_chunks() if isinstance(one.column(k), pa.ChunkedArray) else one.column(k)
            held = messages.flatten()
            roles, texts = held.field("role"), held.field("text")
            letters = np.array([0 if r[:1] == "s" else 3 for r in roles.to_pylist()], np.int64)
            made = edited(roles, texts, letters, [one.column(k + 1)[0].as_py()], [one.column(k + 2)[0].as_py()])
            yield pa.RecordBatch.from_arrays([*one.columns[:k], one.column(k + 1), made], [*one.schema.names[:k], "audit", "messages"])


def repair(rows: DataFrame, present: Column | None = None, block_rows: int = 4096, block_bytes: int = 4_000_000) -> DataFrame:
    """Conversations (conv_id of any type, turn, role, text; other columns are ignored) repaired by the
    cheapest edits: Keep (cost 0), Rerole to user or assistant (1), Delete (2; the only edit of a blank
    or a duplicate row), Insert of an empty user or assistant row (5); a truncated row that stays adds 5.

    Rows stand by turn (nulls first), those of equal turn by role, then text.  Null role or text counts
    as one space; a null conv_id is one conversation.  A row's fault is the first of blank (no text but
    ASCII white space), duplicate (role and text seen before in the conversation), truncated (the last
    character before white space isn't one of .!?).  Rows for which `present` isn't true count for
    nothing, but their conversations are in the result.

    One row a conversation, or for those at the borders of tasks and those of over block_rows rows or
    block_bytes bytes that an Arrow batch doesn't hold whole, a row a block (whole is false; blocks are
    numbered from 0): n_rows, blank, duplicate,
    truncated, illegal (neighbours other than su, ua, au), turns (distinct), min_turn, max_turn, cost
    and audit (the edits' initials, of equal cost the ASCII-least), messages (the repaired rows).  A
    conversation's numbers are sums over its blocks."""
    small_batches(rows.sparkSession)
    there = present if present is not None else F.lit(True)
    run, schema = first_pass(rows.schema["conv_id"].dataType.simpleString(), block_rows, block_bytes)
    table = written(ordered(rows, there).mapInArrow(run, schema), "conversation-blocks")
    counts = [*COUNTS, "min_turn", "max_turn"]
    columns = ["conv_id", "block", "whole", *counts, "cost", "audit", "messages"]
    closed = table.where("whole").withColumn("block", F.lit(0).cast("long")).select(*columns)
    open_ = table.where(~F.col("whole"))
    steps = open_.select("conv_id", "part", "number", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    after = steps.mapInArrow(backward, "part long, number long, after binary, last boolean")
    steps = open_.select("conv_id", "part", "number", "symbols", "first_letter", "last_letter", "min_turn", "max_turn").join(after, ["part", "number"])
    steps = steps.select("conv_id", "part", "number", "symbols", "after", "last", "first_letter", "last_letter", "min_turn", "max_turn").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    plan = steps.mapInArrow(forward, "part long, number long, block long, audit string, cost long, shift int, more_illegal long, more_turns long")
    done = open_.drop("audit", "cost").join(plan, ["part", "number"]).withColumns({"illegal": F.col("illegal") + F.col("more_illegal"), "turns": F.col("turns") + F.col("more_turns")})
    schema = done.select(*columns).schema
    done = done.select(*columns[:-2], "messages", "audit", "shift").mapInArrow(tidy(apply_edits), schema)
    return closed.unionByName(done)


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation of repair(): its counts, gaps (maxTurn-minTurn+1-distinctTurns; 0 without
    turns), cost, audit, and the SHA-256 of its repaired role:text lines.  A hash of a conversation of
    several blocks goes over them in order."""
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    whole = repaired.where("whole").select("conv_id", gaps, *sums, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    names = ["conv_id", "turns", "min_turn", "max_turn", *sums, "audit", "repaired_sha256"]
    kind = repaired.schema["conv_id"].dataType
    of_id, kind = to_arrow_type(kind), kind.simpleString()

    def run(batches):
        def rows():
            for conv_id, blocks in by_conversation(batches):
                said, total, sha, turns, low, high, more_lines = [], [0] * len(sums), hashlib.sha256(), 0, None, None, False
                for _, _, t, a, b, *more, audit, messages in blocks:
                    turns += t
                    low = a if low is None else low
                    high = b if b is not None else high
                    total = [x + y for x, y in zip(total, more)]
                    said.append(audit)
                    for m in messages:
                        sha.update(("\n" * more_lines + m["role"] + ":" + m["text"]).encode())
                        more_lines = True
                yield conv_id, turns, low, high, *total, "".join(said), sha.hexdigest()

        yield from batches_of(rows(), names, [of_id, *[pa.int64()] * 8, pa.string(), pa.string()])

    parts = repaired.where(~F.col("whole")).select("conv_id", "block", "turns", "min_turn", "max_turn", *sums, "audit", "messages")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    folded = parts.mapInArrow(run, f"conv_id {kind}, turns long, min_turn long, max_turn long, " + ", ".join(f"{c} long" for c in sums) + ", audit string, repaired_sha256 string")
    return whole.unionByName(folded.select("conv_id", gaps, *sums, "audit", "repaired_sha256"))
