"""Chat formatting with minimum-cost role repair.

Legal conversations are those of a small automaton: at most one system turn first, then
user and assistant in turn, ending with the assistant. Each turn is kept, relabelled, merged
into the turn before it, or preceded by empty turns; the cheapest combination is found by
dynamic programming over the automaton's states, and the fragments rendered for the turns
give the conversation when put together in order.

A step of the program is a matrix in the (min, +) algebra, so a conversation may be cut
anywhere. Turns are range-partitioned by conversation and turn, which splits a conversation
of any size over tasks. Only the first and last conversation of a partition can go on
elsewhere: for these the tasks report 4 x 4 matrices, from which the driver derives what
each part has to know about the others, a few numbers per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

ROLES = ("system", "user", "assistant", "other")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, MERGE, MERGE_OTHER, INSERT = 2, 1, 3, 4
INF = 1 << 40
#: Turns and bytes of text of a partition where the session's shuffle partitions would hold
#: more: a task keeps the turns of a conversation until it has seen the last of its own.
TURNS, BYTES = 500_000, 64 << 20
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_OUT = "conv_id long, turn long, role string, new_role string, action string, inserted string, cost long, rendered string"


def _options(role: int) -> list[list[tuple[int, int, str, tuple[str, ...]]]]:
    """By state: (cost, next state, action, inserted roles), preferred ones first."""
    out = []
    for s in range(4):
        found = []
        for x in (SYSTEM, USER, ASSISTANT):
            if x == SYSTEM and s != START:
                continue
            fill = ("assistant",) if x == USER and s == USER else ("user",) if x == ASSISTANT and s != USER else ()
            same = role == x - 1
            found.append(((0 if same else RELABEL) + INSERT * len(fill), x, "keep" if same else "relabel", fill))
        if s != START:
            found.append((MERGE if role == s - 1 else MERGE_OTHER, s, "merge", ()))
        out.append(sorted(found, key=lambda o: o[0]))
    return out


OPTIONS = [_options(r) for r in range(4)]
FINISH = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
ENDING = ((), ("user", "assistant"), ("assistant",), ())
STEP = np.full((4, 4, 4), INF, np.int64)
for _r in range(4):
    for _s in range(4):
        for _c, _n, _, _ in OPTIONS[_r][_s]:
            STEP[_r, _s, _n] = min(STEP[_r, _s, _n], _c)


def role_codes(roles: list[str | None]) -> np.ndarray:
    known = {"system": 0, "user": 1, "assistant": 2}
    return np.array([known.get((r or "").strip().lower(), 3) for r in roles], np.int64)


def product(codes: np.ndarray) -> np.ndarray:
    """The (min, +) product of the steps of a run of turns, by halving."""
    m = STEP[codes]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[0 : len(m) - len(odd) : 2], m[1 : len(m) - len(odd) : 2]
        m = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), INF), odd])
    return m[0]


def walk(codes: np.ndarray, ahead: np.ndarray, state: int) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """The chosen option of each turn from ``state``; ahead: the least cost after the run."""
    n = len(codes)
    to_go = np.empty((n + 1, 4), np.int64)
    to_go[n] = ahead
    for i in range(n - 1, -1, -1):
        to_go[i] = (STEP[codes[i]] + to_go[i + 1]).min(axis=1)
    out = []
    for i, r in enumerate(codes.tolist()):
        nxt = to_go[i + 1]
        best = min(OPTIONS[r][state], key=lambda o: o[0] + nxt[o[1]])
        out.append(best)
        state = best[1]
    return out


def repair(roles: list[str | None]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """The repair of a whole conversation, for use without Spark."""
    return walk(role_codes(roles), FINISH, START)


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int | None, list]]:
    """Conversations of a sorted partition, one at a time: the id and a list per column."""
    now, held = None, None
    for b in batches:
        for conv, *values in zip(*(b.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True):
            if held is None or conv != now:
                if held is not None:
                    yield now, held
                now, held = conv, [[] for _ in columns]
            for own, value in zip(held, values, strict=True):
                own.append(value)
    if held is not None:
        yield now, held


def _fragments(conv, turns, roles, texts, chosen, state: int, last: bool) -> Iterator[tuple]:
    for i, (cost, nxt, action, fill) in enumerate(chosen):
        text = (texts[i] or "").replace("<|im_", "< |im_")
        if action == "merge":
            out = "\n" + text
        else:
            out = (CLOSE if state != START else "") + "".join(f"{OPEN}{r}\n{CLOSE}" for r in fill) + f"{OPEN}{ROLES[nxt - 1]}\n{text}"
        if last and i == len(chosen) - 1:
            out += CLOSE + "".join(f"{OPEN}{r}\n{CLOSE}" for r in ENDING[nxt])
            fill, cost = (*fill, *ENDING[nxt]), cost + int(FINISH[nxt])
        yield conv, turns[i], roles[i], ROLES[nxt - 1], action, ",".join(fill), cost, out
        state = nxt


def format_chats(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(conv_id, turn, role, new_role, action, inserted, cost, rendered)`` per turn of
    ``turns(conv_id, turn, role, text, ...)``.

    Costs: 2 to relabel, 1 to merge into a turn of the same role and 3 into another, 4 per
    empty turn; of equally cheap repairs the first in a fixed order of options is taken.
    ``rendered`` of a conversation's turns, in order, is the repaired conversation; a merged
    turn is the continuation of the one before. The costs of what is appended at the end go
    to the last turn. Turns are ordered by turn, role and the MD5 of the text, whose length
    does not matter to the sort or to the sample that cuts its ranges; nulls come first; a
    role other than system, user or assistant (or null) has to be relabelled or merged; a
    null text is empty; rows with a null conv_id are one conversation. Texts cannot forge
    turn marks. Further columns are ignored; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "md5", "tie"]
    count, size = cols.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TURNS), -(-size // BYTES))
    # equal rows may lie on both sides of a cut, hence the tie
    cols = cols.withColumn("md5", F.md5(F.col("text").cast("binary"))).withColumn("tie", F.monotonically_increasing_id())
    cols = cols.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("md5", "tie").checkpoint()
    roles_only = cols.select("conv_id", "role")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, final = TaskContext.get().partitionId(), None, None
        for conv, (roles,) in _runs(batches, "role"):
            final = (conv, roles)
            first = first or final
        rows = [] if first is None else [first] if first is final else [first, final]
        out = [(part, k, len(rows), conv, product(role_codes(roles)).tobytes()) for k, (conv, roles) in enumerate(rows)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["part", "k", "runs", "conv_id", "m"])

    ends = sorted(roles_only.mapInArrow(report, "part long, k long, runs long, conv_id long, m binary").collect(), key=lambda r: (r.part, r.k))
    groups: list[list] = []
    for r in ends:
        if groups and groups[-1][-1].part < r.part and groups[-1][-1].conv_id == r.conv_id:
            groups[-1].append(r)
        else:
            groups.append([r])
    ahead: dict[tuple[int, int | None], np.ndarray] = {}
    more: set[tuple[int, int | None]] = set()  # runs that go on in a later partition
    begins: dict[tuple[int, int | None], int] = {}
    for group in groups:
        b = FINISH
        for r in reversed(group):
            ahead[r.part, r.conv_id] = b
            if r is not group[-1]:
                more.add((r.part, r.conv_id))
            b = (np.frombuffer(r.m, np.int64).reshape(4, 4) + b).min(axis=1)
    if more:

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, rows = TaskContext.get().partitionId(), []
            for conv, (roles,) in _runs(batches, "role"):
                if (part, conv) in more:
                    codes = role_codes(roles)
                    rows.append((part, conv, [walk(codes, ahead[part, conv], s)[-1][1] for s in range(4)]))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["part", "conv_id", "exits"])

        exits = {(r.part, r.conv_id): r.exits for r in roles_only.mapInArrow(lead, "part long, conv_id long, exits array<long>").collect()}
        for group in groups:
            state = START
            for r in group:
                begins[r.part, r.conv_id] = state
                state = exits[r.part, r.conv_id][state] if (r.part, r.conv_id) in more else state

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        names = [f.split()[0] for f in _OUT.split(", ")]
        kinds = [pa.string() if "string" in f else pa.int64() for f in _OUT.split(", ")]
        batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)
        for conv, (turn, roles, texts) in _runs(batches, "turn", "role", "text"):
            at = (part, conv)
            state = begins.get(at, START)
            chosen = walk(role_codes(roles), ahead.get(at, FINISH), state)
            for row in _fragments(conv, turn, roles, texts, chosen, state, at not in more):
                rows.append(row)
                if len(rows) >= 2000:
                    yield batch()
                    rows = []
        yield batch()

    return cols.mapInArrow(render, _OUT)
