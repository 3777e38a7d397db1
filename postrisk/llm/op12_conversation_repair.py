"""Operator 12: repair of damaged conversations by Wagner-Fischer alignment.

The rows of a conversation are aligned to the role string ``(s?(ua)+)?``. All strings of the grammar
with the same last role share their ends, so one table of (rows left, roles left) costs, filled from
the end, holds the alignment to every feasible length. A quick repair (relabel, or insert before a
row) gives an incumbent cost; cells that need more insertions or deletions than it can pay for lie
outside the Ukkonen band and are never filled. The audits of all cheapest lengths, with and without
a leading system row, are traced back and compared; the ASCII-least stays.

Conversations of up to ``block`` rows are dealt out by id and repaired one after the other from a
sorted stream. Longer ones are cut into blocks of that many rows at range bounds: a block is aligned from
every role state to every other, the blocks' costs are chained (one small row a block), and each
block then writes its part of the audit and the repaired text for the states that the chain chose.
Insertions come before a row, so of two audits of a block none begins the other, and the block's
least audit is the whole's. The hash of a long conversation is taken over its parts as they stream by.

Defined results: null cells count as one space (a null id stays null in the result and is one
conversation; null turns come first); rows of equal turn are taken by role, then text; a
conversation without rows after damage gets zeros, an empty audit and the empty text's hash; an
empty role has no initial and so can't be kept; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postrisk.llm.common import write_cut

BLOCK = 4096
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)  # what was emitted last
ROLE = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
NEXT = "uuau"  # the next role by state
STATE = {"u": USER, "a": ASSISTANT}
#: Cost and audit of ending after the last row, by state: what is missing is inserted.
TAIL = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
NONE, BLANK, DUPLICATE, CUT = range(4)


class Row(NamedTuple):
    role: str
    text: str
    fault: int

    @property
    def gone(self) -> bool:
        """Has to be deleted."""
        return self.fault in (BLANK, DUPLICATE)


_BLANKS = " \t\n\x0b\x0c\r"


def fault(role: str, text: str, seen: bool) -> int:
    """First fault of a row: blank, duplicate (seen earlier), truncated."""
    end = text.rstrip(_BLANKS)
    return BLANK if not end else DUPLICATE if seen else CUT if end[-1] not in ".!?" else NONE


class Aligner:
    """Alignment of a run of rows, from any state to any state, without insertions after the last row."""

    def __init__(self, rows: list[Row]):
        self.rows, self.n = rows, len(rows)
        self.here = [r.role[:1] for r in rows]
        extra = 3 * sum(r.fault == CUT for r in rows)
        self.base = extra + DELETE * sum(r.gone for r in rows)
        self.left = np.zeros(self.n + 1, np.int64)  # rows that may stay, from here on
        self.cheap = np.zeros(self.n + 1, np.int64)  # of those, truncated ones: deleting one costs 1 more than keeping
        for i in range(self.n - 1, -1, -1):
            self.left[i] = self.left[i + 1] + (not rows[i].gone)
            self.cheap[i] = self.cheap[i + 1] + (rows[i].fault == CUT)
        self.tables: dict[str, tuple[list[int], list[np.ndarray]]] = {}
        self.bound = max(min(self._quick(s, True), self._quick(s, False)) for s in range(4)) + 9

    def _quick(self, state: int, insert: bool) -> int:
        """What a quick repair costs beyond the rows' own faults. 9 more turn its last role into the other
        (a row inserted before the last one, that one relabelled, and the end)."""
        cost = 0
        for r, c in zip(self.rows, self.here):
            if r.gone:
                continue
            if state == START and c == "s":
                state = SYSTEM
                continue
            want = NEXT[state]
            if c != want:
                cost += INSERT if insert and c == OTHER[want] else REROLE
                want = c if insert and c == OTHER[want] else want
            state = STATE[want]
        return cost

    def table(self, last: str) -> tuple[list[int], list[np.ndarray]]:
        """Costs of aligning rows i.. to the last k roles of a string that ends with ``last``: first k and costs, by i."""
        if last in self.tables:
            return self.tables[last]
        n, u = self.n, self.bound
        lows, costs = [0] * (n + 1), [np.zeros(0, np.int64)] * (n + 1)
        costs[n] = np.zeros(1, np.int64)
        for i in range(n - 1, -1, -1):
            r, left, cheap = self.rows[i], int(self.left[i]), int(self.cheap[i])
            dropped = min(left, u if u < cheap else cheap + (u - cheap) // 4)
            lo, hi = max(0, left - dropped), left + u // INSERT
            k = np.arange(lo, hi + 1)
            after = self._at(lows, costs, i + 1, lo - 1, hi)  # from lo - 1 on
            best = DELETE + after[1:]
            if not r.gone:
                odd = self.here[i] == last
                even = self.here[i] == OTHER[last]
                keep = np.where(k % 2 == 1, 0 if odd else REROLE, 0 if even else REROLE) + (TRUNCATED if r.fault == CUT else 0)
                best = np.minimum(best, np.where(k > 0, keep + after[:-1], INF))
            costs[i] = np.minimum.accumulate(best - INSERT * k) + INSERT * k
            lows[i] = lo
        self.tables[last] = lows, costs
        return lows, costs

    @staticmethod
    def _at(lows, costs, i, lo, hi) -> np.ndarray:
        out = np.full(hi - lo + 1, INF, np.int64)
        a, b = max(lo, lows[i]), min(hi, lows[i] + len(costs[i]) - 1)
        if a <= b:
            out[a - lo:b - lo + 1] = costs[i][a - lows[i]:b - lows[i] + 1]
        return out

    def _cost(self, last: str, i: int, k: int) -> int:
        lows, costs = self.table(last)
        j = k - lows[i]
        return int(costs[i][j]) if 0 <= j < len(costs[i]) else INF

    def trace(self, last: str, i: int, k: int) -> str:
        """The ASCII-least audit among the cheapest from a cell."""
        out = []
        while i < self.n:
            want, r = self._cost(last, i, k), self.rows[i]
            if DELETE + self._cost(last, i + 1, k) == want:
                out.append("D")
                i += 1
            elif k and INSERT + self._cost(last, i, k - 1) == want:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.here[i] == (last if k % 2 else OTHER[last]) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def _starts(self, i: int, entry: int, last: str) -> list[tuple[int, int]]:
        """(cost, length) of the strings that can follow ``entry``, cover rows i.. and end with ``last``; at least one role."""
        lows, costs = self.table(last)
        first = 1 if NEXT[entry] == last else 2
        k = np.arange(max(lows[i], first), lows[i] + len(costs[i]))
        k = k[k % 2 == first % 2]
        return [(int(c), int(x)) for x, c in zip(k, costs[i][k - lows[i]])]

    def solve(self, entry: int, leave: int) -> tuple[int, str | None]:
        """Least cost from one state to another, and its least audit."""
        found: list[tuple[int, tuple]] = []
        if entry == leave:
            found.append((DELETE * self.n, ("D" * self.n,)))
        if leave in (USER, ASSISTANT):
            last = "ua"[leave - USER]
            found += [(c, ("", last, 0, k)) for c, k in self._starts(0, entry, last)]
        if entry == START and leave != START:
            best = min((c for c, _ in found), default=INF)
            for p, r in enumerate(self.rows):  # the system row that stays; all before it go
                here = DELETE * p + (TRUNCATED if r.fault == CUT else 0)
                if DELETE * p > best:
                    break
                if r.gone or self.here[p] != "s":
                    continue
                if leave == SYSTEM:
                    found.append((here + DELETE * (self.n - p - 1), ("D" * p + "K" + "D" * (self.n - p - 1),)))
                else:
                    found += [(here + c, ("D" * p + "K", last, p + 1, k)) for c, k in self._starts(p + 1, SYSTEM, last)]
                best = min(best, min((c for c, _ in found), default=INF))
        cost = min((c for c, _ in found), default=INF)
        if cost >= INF:
            return INF, None
        audits = [how[0] if len(how) == 1 else how[0] + self.trace(*how[1:]) for c, how in found if c == cost]
        return cost, min(audits)


def whole(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if not rows:
        return 0, ""
    a = Aligner(rows)
    ends = [a.solve(START, s) for s in range(4)]
    return min((c + TAIL[s][0], t + TAIL[s][1]) for s, (c, t) in enumerate(ends) if t is not None)


def rebuilt(rows: list[Row], audit: str, state: int = START) -> tuple[list[str], int]:
    """The lines that an audit makes of the rows, and the state after them."""
    out, i = [], 0
    for op in audit:
        if op == "I":
            out.append(ROLE[NEXT[state]] + ":")
            state = STATE[NEXT[state]]
            continue
        r = rows[i]
        i += 1
        if op == "D":
            continue
        if op == "K" and state == START and r.role[:1] == "s":
            state = SYSTEM
        else:
            if op == "R":
                r = r._replace(role=ROLE[NEXT[state]])
            state = STATE[NEXT[state]]
        out.append(f"{r.role}:{r.text}")
    return out, state


def legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, with ``live``; a dropped row stays as a mark of its conversation."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    live = F.col("kind") != 0
    return c.select(
        "conv_id", F.when(live, F.col("turn")).alias("turn"), live.alias("live"),
        F.when(~live, F.lit("")).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(~live | (F.col("kind") == 1), F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id {}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations from rows sorted by conversation, turn, role and text."""
    held: list[tuple] = []
    done: list[tuple] = []
    key = None

    def finish():
        live = [r for r in held if r[2]]
        turns = {r[1] for r in live if r[1] is not None}
        seen: set[tuple[str, str]] = set()
        rows = []
        for _, _, _, role, text in live:
            rows.append(Row(role, text, fault(role, text, (role, text) in seen)))
            seen.add((role, text))
        cost, audit = whole(rows)
        lines, state = rebuilt(rows, audit)
        faults = [r.fault for r in rows]
        done.append((key, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                     sum(not legal(a.role, b.role) for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(5))):
            if held and r[0] != key:
                finish()
                held.clear()
            key = r[0]
            held.append(r)
        if done:
            yield _results(done, b.schema.field(0).type)
            done.clear()
        kind = b.schema.field(0).type
    if held:
        finish()
        yield _results(done, kind)


def _results(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], *[pa.array(c, pa.string()) for c in cols[7:]]],
                                      ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


# ---- conversations of more rows than a block ---------------------------------

def _placed(block: int):
    """Adds the range a row lies in and its block there; blocks end with the conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, nth = TaskContext.get().partitionId(), (), 0
        for b in batches:
            places = []
            for c in b.column(0).to_pylist():
                if (c,) != key:
                    key, nth = (c,), 0
                places.append(nth)
                nth += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part * (1 << 40) + p // block for p in places], pa.int64()),
                                              pa.array([p % block for p in places], pa.int64())], [*b.schema.names, "block", "place"])
    return run


def _block_rows(t: pa.Table) -> list[Row]:
    order = np.argsort(t.column("place").to_numpy(), kind="stable")
    return [Row(t.column("role")[i].as_py(), t.column("text")[i].as_py(), t.column("fault")[i].as_py()) for i in map(int, order)]


def _long(rows: DataFrame, block: int) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "text"]
    fixed = write_cut(rows.where("live").select(*names).withColumn("uid", F.monotonically_increasing_id()), "op12-long")
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text", "uid"]  # equal rows are alike, so uid only deals them out
    put = write_cut(fixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _placed(block), fixed.schema.simpleString()[7:-1].replace(":", " ") + ", block long, place long"), "op12-placed")
    text = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    at = F.struct("block", "place")
    keyed = put.withColumn("same", text)
    first = keyed.groupBy("conv_id", "same").agg(F.min(at).alias("first")).withColumnsRenamed({"conv_id": "c2", "same": "s2"})
    end = F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+$", "")
    flagged = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("same") == F.col("s2"))).select(
        *names, "block", "place",
        F.when(end == "", BLANK).when(at > F.col("first"), DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE).alias("fault"))
    flagged = write_cut(flagged, "op12-flagged")

    def costs(t: pa.Table) -> pa.Table:
        rows = _block_rows(t)
        a = Aligner(rows)
        got = [[a.solve(e, x) for x in range(4)] for e in range(4)]
        rank = [[sorted(y[1] for y in g if y[1] is not None).index(x[1]) if x[1] is not None else 9 for x in g] for g in got]
        return pa.table({"conv_id": t.column("conv_id")[:1], "block": t.column("block")[:1], "first": [rows[0].role], "last": [rows[-1].role],
                         "illegal": [sum(not legal(x.role, y.role) for x, y in zip(rows, rows[1:]))],
                         "costs": [[c for g in got for c, _ in g]], "ranks": [[r for g in rank for r in g]]})
    by_block = write_cut(flagged.groupBy("conv_id", "block").applyInArrow(
        costs, f"conv_id {kind}, block long, first string, last string, illegal long, costs array<long>, ranks array<long>"), "op12-blocks")

    def chain(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("block").to_numpy())
        t = t.take(order)
        cost = [np.array(c).reshape(4, 4) for c in t.column("costs").to_pylist()]
        rank = [np.array(c).reshape(4, 4) for c in t.column("ranks").to_pylist()]
        ahead = [np.array([c for c, _ in TAIL])]
        for c in reversed(cost):
            ahead.append((c + ahead[-1][None]).min(1))
        ahead.reverse()
        state, way = START, [START]
        for i, (c, r) in enumerate(zip(cost, rank)):
            total = c[state] + ahead[i + 1]
            state = min(np.flatnonzero(total == total.min()), key=lambda x: r[state][x])
            way.append(int(state))
        first, last = t.column("first").to_pylist(), t.column("last").to_pylist()
        illegal = sum(t.column("illegal").to_pylist()) + sum(not legal(a, b) for a, b in zip(last, first[1:]))
        n = t.num_rows
        return pa.table({"conv_id": t.column("conv_id"), "block": t.column("block"), "enter": way[:-1], "leave": way[1:],
                         "end": [i == n - 1 for i in range(n)], "cost": [int(ahead[0][START])] * n, "illegal": [illegal] * n})
    # one row a block
    ways = by_block.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, block long, enter long, leave long, end boolean, cost long, illegal long")
    ways = write_cut(ways, "op12-ways").withColumnsRenamed({"conv_id": "c2", "block": "b2"})

    def write(t: pa.Table) -> pa.Table:
        rows = _block_rows(t)
        enter, leave, end = (t.column(c)[0].as_py() for c in ("enter", "leave", "end"))
        audit = Aligner(rows).solve(enter, leave)[1] + (TAIL[leave][1] if end else "")
        return pa.table({"conv_id": t.column("conv_id")[:1], "block": t.column("block")[:1], "audit": [audit], "lines": pa.array([rebuilt(rows, audit, enter)[0]], pa.list_(pa.string()))})
    done = (flagged.join(ways, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("b2"))).drop("c2", "b2")
            .groupBy("conv_id", "block").applyInArrow(write, f"conv_id {kind}, block long, audit string, lines array<string>"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, sha, some, out = (), [], hashlib.sha256(), False, []
        for b in batches:
            for c, a, lines in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if (c,) != key:
                    if key:
                        out.append((key[0], "".join(audit), sha.hexdigest()))
                    key, audit, sha, some = (c,), [], hashlib.sha256(), False
                audit.append(a)
                for line in lines:
                    sha.update((("\n" if some else "") + line).encode())
                    some = True
            kind_ = b.schema.field(0).type
        if key:
            out.append((key[0], "".join(audit), sha.hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind_), pa.array(cols[1]), pa.array(cols[2])], ["conv_id", "audit", "repaired_sha256"])
    repaired = done.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(joined, f"conv_id {kind}, audit string, repaired_sha256 string")
    turns = fixed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = flagged.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == k).alias(c) for c, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))])
    facts = ways.where("end").select(F.col("c2").alias("conv_id"), "cost", "illegal")
    out = rows.groupBy("conv_id").agg(F.count("*").alias("_n"))
    for t in (turns, counts, facts, repaired):
        t = t.withColumnRenamed("conv_id", "c2")
        out = out.join(t, F.col("conv_id").eqNullSafe(F.col("c2")), "left").drop("c2")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    long = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("c2"))
    long = write_cut(long, "op12-ids")
    same = F.col("conv_id").eqNullSafe(F.col("c2"))
    some = not long.isEmpty()
    short = rows.join(long, same, "left_anti") if some else rows
    order = ["conv_id", "turn", "role", "text"]
    out = (short.select("conv_id", "turn", "live", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
           .mapInArrow(_short, _RESULT.format(kind)))
    return out.unionByName(_long(write_cut(rows.join(long, same, "left_semi"), "op12-rows"), block)) if some else out
