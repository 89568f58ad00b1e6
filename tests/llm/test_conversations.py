"""Conversation repair against exhaustive search, and against its SQL."""

import hashlib
import heapq
import zlib

import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import conversations, queries
from memspark.llm.sql import ORACLE_SQL

WHITE = " \t\n\x0b\f\r"


def search(rows):
    """(cost, audit, repaired rows) of [(initial, fault, role, text)] by Dijkstra over (row, state) with
    ties by the audit."""
    queue, done = [(0, "", 0, 0, ())], set()
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"u": 2, "a": 3}
    while queue:
        cost, audit, k, q, out = heapq.heappop(queue)
        if (k, q) in done:
            continue
        done.add((k, q))
        if k == len(rows) and q in (0, 3):
            return cost, audit, list(out)
        full = {"u": "user", "a": "assistant"}[step[q]]
        heapq.heappush(queue, (cost + 5, audit + "I", k, to[step[q]], (*out, (full, ""))))
        if k < len(rows):
            initial, fault, role, text = rows[k]
            heapq.heappush(queue, (cost + 2, audit + "D", k + 1, q, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(queue, (cost + 1 + extra, audit + "R", k + 1, to[step[q]], (*out, (full, text))))
                if initial == step[q] or initial == "s" and q == 0:
                    heapq.heappush(queue, (cost + extra, audit + "K", k + 1, 1 if initial == "s" else to[initial], (*out, (role, text))))


def loop(rows):
    """The contract, conversation by conversation."""
    every = {}
    for conv, turn, role, text in rows:
        held = every.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, held in every.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, made = set(), []
        for _, role, text in held:
            bare = text.rstrip(WHITE)
            made.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated", role, text))
            seen.add((role, text))
        cost, audit, repaired = search(made)
        turns = {t for t, _, _ in held if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = [sum(f == x for _, f, _, _ in made) for x in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0], b[0]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(made, made[1:]))
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(df, **more):
    out = conversations.digests(conversations.repair(conversations.damaged(df), F.col("present"), **more))
    return sorted(map(tuple, out.select(*COLUMNS).collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from(["", "truncated", "blank"])), max_size=9), st.integers(1, 4))
def test_edits(rows, times):
    rows = [(*r, {"s": "system", "u": "user", "a": "assistant"}.get(r[0], "tool"), "x") for r in rows for _ in range(times)]
    symbols = "".join("x" if f == "blank" else i.upper() if f else i for i, f, _, _ in rows)
    cost, audit, _ = search(rows)
    assert conversations.edits(symbols)[:2] == (audit, cost)
    # the same in two blocks
    half = len(symbols) // 2
    after = tuple((conversations.matrix(symbols[half:]) + conversations.END).min(1).tolist())
    first, c1, state = conversations.edits(symbols[:half], conversations.EMPTY, after, False)
    second, c2, _ = conversations.edits(symbols[half:], state)
    assert (first + second, c1 + c2) == (audit, cost)
    assert (conversations.matrix(symbols) + conversations.END).min(1)[0] == cost


def odd_rows():
    said = ["Hello.", "Yes?", "no end", "", " \n", None, "Fine!  ", "Two words.", "ü.", "x"]
    rows = [(c, t, ["user", "assistant", "system", None, "tool", ""][(c * 7 + t * 3) % 6 if c % 3 else t % 2], said[(c * 5 + t * t) % 10]) for c in range(40) for t in range(c % 12)]
    rows += [(None, t, "user", "a.") for t in (1, 2, 9)] + [(50, None, "user", "a."), (50, None, "user", "a."), (50, 3, "user", "a."), (51, None, None, None)]
    rows += [(52, 4, "assistant", "b."), (52, 4, "assistant", "a."), (52, 4, "user", "z."), (52, 4, "user", "z.")]
    rows += [(53, t, ["user", "assistant"][t % 2], f"text {t // 3}.") for t in range(900)] + [(54, t, "user", "same.") for t in range(300)]
    return rows + [(55, t, "assistant", "long " * 4000 + f"{t}!") for t in range(30)]


@pytest.mark.parametrize("more", [{}, {"block_rows": 7}, {"block_bytes": 3000}])
def test_equals_search(spark, more):
    df = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("clash"), "present": F.lit(3), "block": F.lit(1), "said": F.lit(0)}).repartition(6)
    assert run(df, **more) == loop(odd_rows())


def test_conversations_over_many_tasks(spark):
    """One conversation has most rows; its blocks lie in several tasks, and so do its equal rows."""
    rows = [(1, t, ["user", "assistant", "assistant", "user"][t % 4], f"text {t % 50}.") for t in range(6000)] + [(c, 1, "user", "a.") for c in range(2, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "300"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    repaired = conversations.repair(df, block_rows=500).persist()
    assert repaired.where("conv_id = 1").count() > 8 and repaired.where("whole").count() > 40
    blocks = sorted((r.block, r.audit, r.cost, r.duplicate) for r in repaired.where("conv_id = 1").collect())
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    seen, made = set(), []
    for _, _, role, text in rows[:6000]:
        made.append((role[0], "duplicate" if (role, text) in seen else "", role, text))
        seen.add((role, text))
    cost, audit, _ = search(made)
    assert ("".join(b[1] for b in blocks), sum(b[2] for b in blocks)) == (audit, cost)
    assert sum(b[3] for b in blocks) == sum(f == "duplicate" for _, f, _, _ in made)
    messages = [m.role[0] for r in repaired.where("conv_id = 1").orderBy("block").collect() for m in r.messages]
    assert messages == ["u", "a"] * (len(messages) // 2)
    assert run(df.withColumn("turn", F.col("turn") % 997), block_rows=500) == loop([(c, t % 997, r, x) for c, t, r, x in rows])
    repaired.unpersist()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_empty(spark):
    assert run(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []
    named = spark.createDataFrame([("c", 1, "user", "a."), ("c", 2, "assistant", "b.")], "conv_id string, turn int, role string, text string")
    assert run(named) == loop([("c", 1, "user", "a."), ("c", 2, "assistant", "b.")])


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, where):
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_conversations(spark, where)
    assert sorted(map(tuple, out.select(*COLUMNS).collect()), key=repr) == loop(rows)
    assert difference(out, connect(where), ORACLE_SQL["op11_conversations"]) == ""
