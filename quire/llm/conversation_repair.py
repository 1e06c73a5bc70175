"""Repair of the turn structure of conversations by least edits (operator 11).

A repaired conversation's role initials match ``(s?(ua)+)?``: nothing, or an
optional system turn and then pairs of user and assistant. Each turn is kept
(cost 0), gets the role user or assistant (2) or is deleted (3, required for
blank and duplicate turns); an empty turn of the next role is inserted anywhere
(2); a truncated turn that stays adds 1. The audit is the cheapest edits'
initials in order (K, R, D, I); of equally cheap ones the ASCII-least is taken.

Method: Spark deals conversations out by hash and sorts their turns; a task
takes batches of them, and a recursive query in DuckDB advances all of a
batch's conversations by one turn with each recursion, keeping for each state
of the grammar the least cost and its audit. After ``SEGMENT`` turns the audits
go on as ranks, so that a recursion's work doesn't grow with what lies behind
it, and a batch may end within a conversation: its states wait for the next
one. (Two audits of one conversation after the same number of turns both end
with the edit of the last turn, so that neither begins with the other and their
order stays whatever follows.)

The queries see faults and initials only; texts meet their edits in a second
pass, which holds one batch of turns and an audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.tables import remembering

#: Turns in a batch, and turns of a conversation that one recursive query advances.
BATCH, SEGMENT = 65_536, 256
#: Memory of a task's DuckDB.
MEMORY = "400MB"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, system, user, assistant; the last rows' extra inserts: (edits, cost).
ENDS = {0: ("", 0), 1: ("II", 2 * INSERT), 2: ("I", INSERT), 3: ("", 0)}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def moves() -> list[tuple[int, int, int, int, str]]:
    """``code, before, after, cost, edits`` of all ways to get over one turn; a code is 4 * fault + class of the initial (s, u, a, others)."""
    follows = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
    inserts = {0: (0, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (3, 2)}
    found = []
    for fault in range(4):
        for initial in range(4):
            for before in range(4):
                for n, state in enumerate(inserts[before]):
                    ways = [(state, DELETE, "D")]
                    if fault not in (BLANK, DUPLICATE):
                        more = UNFINISHED if fault == TRUNCATED else 0
                        ways.append((3 if state == 2 else 2, REROLE + more, "R"))
                        if initial in follows[state]:
                            ways.append((follows[state][initial], KEEP + more, "K"))
                    found += [(4 * fault + initial, before, after, cost + INSERT * n, "I" * n + edit) for after, cost, edit in ways]
    return found


_ADVANCE = """
CREATE OR REPLACE TEMP TABLE states AS
WITH RECURSIVE part AS (SELECT c, i - $low AS i, code FROM turns WHERE i >= $low AND i < $high),
walk AS (
  SELECT c, 0::BIGINT AS i, state, cost, prior, '' AS audit FROM before WHERE c IN (SELECT c FROM part)
  UNION ALL
  SELECT c, i, state, best.cost, best.prior, best.audit FROM (
    SELECT w.c, w.i + 1 AS i, m.after AS state, min({'cost': w.cost + m.cost, 'prior': w.prior, 'audit': w.audit || m.edits}) AS best
    FROM walk w JOIN part p ON p.c = w.c AND p.i = w.i JOIN moves m ON m.code = p.code AND m.before = w.state
    GROUP BY w.c, w.i, m.after)),
over AS (SELECT c, max(i) + 1 AS i FROM part GROUP BY c)
SELECT w.c, w.state, w.cost, row_number() OVER (PARTITION BY w.c ORDER BY w.prior, w.audit) AS prior, b.audit || w.audit AS audit
FROM walk w JOIN over USING (c, i) JOIN before b ON b.c = w.c AND b.prior = w.prior
UNION ALL SELECT c, state, cost, prior, audit FROM before WHERE c NOT IN (SELECT c FROM part)
"""
_BEST = """
SELECT c, min(cost + extra) AS cost, arg_min(audit || edits, {'cost': cost + extra, 'prior': prior}) AS audit
FROM before JOIN ends USING (state) GROUP BY c ORDER BY c
"""


class Walker:
    """Conversations of one task, taken batch by batch in their order."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.execute("CREATE TABLE moves(code INTEGER, before INTEGER, after INTEGER, cost BIGINT, edits VARCHAR)")
        self.db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
        self.db.execute("CREATE TABLE ends(state INTEGER, edits VARCHAR, extra BIGINT)")
        self.db.executemany("INSERT INTO ends VALUES (?, ?, ?)", [(s, *x) for s, x in ENDS.items()])
        self.open = None

    def step(self, c, code, n: int, states) -> list[tuple[int, int, str]]:
        """Advance ``n`` conversations over their turns (number, code); ``states``: of the first one if it began earlier."""
        import numpy as np

        first = np.flatnonzero(np.diff(c, prepend=-1)) if len(c) else np.empty(0, "i8")
        i = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c)))) if len(c) else np.empty(0, "i8")
        given = pa.table({"c": pa.array(c, pa.int64()), "i": pa.array(i, pa.int64()), "code": pa.array(code, pa.int32())})
        fresh = [(k, 0, 0, 0, "") for k in range(1 if states else 0, n)] + [(0, *x) for x in states or []]
        begin = pa.table({k: pa.array([x[at] for x in fresh], kind) for at, (k, kind) in enumerate((("c", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("prior", pa.int64()), ("audit", pa.string())))})
        self.db.register("given", given)
        self.db.register("begin", begin)
        self.db.execute("CREATE OR REPLACE TEMP TABLE turns AS SELECT * FROM given")
        self.db.execute("CREATE OR REPLACE TEMP TABLE before AS SELECT * FROM begin")
        for low in range(0, int(i.max()) + 1 if len(i) else 0, SEGMENT):
            self.db.execute(_ADVANCE.replace("$low", str(low)).replace("$high", str(low + SEGMENT)))
            self.db.execute("CREATE OR REPLACE TEMP TABLE before AS SELECT * FROM states")
        return self.db.execute(_BEST).fetchall()

    def take(self, rows: pa.Table, ends: bool) -> pa.RecordBatch:
        """The conversations that end in ``rows``, which go on where the last call's ended; the last one ends if nothing follows."""
        import numpy as np

        conv = rows.column("conv_id").combine_chunks()
        values = conv.to_pylist()
        new = np.array([i == 0 or values[i] != values[i - 1] for i in range(len(values))])
        c, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        n = len(starts)
        own = self.open if self.open and self.open["id"] == values[0] else None
        finished = [self.open] if self.open and own is None else []
        there = rows.column("present").to_numpy()
        c, fault, initial = c[there], rows.column("fault").to_numpy()[there], rows.column("initial").to_numpy()[there]
        turn = rows.column("turn").combine_chunks().filter(pa.array(there))
        known, turn = ~turn.is_null().to_numpy(False), turn.fill_null(0).to_numpy(False)
        # what stood before each turn in its conversation
        after, before_known, before_turn, before_initial = np.zeros(len(c), bool), np.zeros(len(c), bool), np.zeros(len(c), "i8"), np.zeros(len(c), "i4")
        if len(c):
            after[1:], before_known[1:], before_turn[1:], before_initial[1:] = c[1:] == c[:-1], known[:-1], turn[:-1], initial[:-1]
            if own and own["last"] and c[0] == 0:
                after[0], (before_known[0], before_turn[0], before_initial[0]) = True, own["last"]
        legal = ((before_initial == 0) & (initial == 1)) | ((before_initial == 1) & (initial == 2)) | ((before_initial == 2) & (initial == 1))
        distinct = known & ~(after & before_known & (before_turn == turn))
        count = lambda which: np.bincount(c[which], minlength=n)
        sums = {"blank": count(fault == BLANK), "duplicate": count(fault == DUPLICATE), "truncated": count(fault == TRUNCATED), "illegal": count(after & ~legal), "distinct": count(distinct)}
        least, most = np.full(n, np.iinfo("i8").max), np.full(n, np.iinfo("i8").min)
        np.minimum.at(least, c[known], turn[known])
        np.maximum.at(most, c[known], turn[known])
        best = self.step(c, 4 * fault + initial, n, own and own["states"])
        for k in range(n):
            one = {"id": values[starts[k]], "least": int(least[k]), "most": int(most[k]), "cost": best[k][1], "audit": best[k][2]} | {x: int(v[k]) for x, v in sums.items()}
            if k == 0 and own:
                one |= {x: one[x] + own[x] for x in sums} | {"least": min(one["least"], own["least"]), "most": max(one["most"], own["most"])}
            if k == n - 1:
                one["states"] = self.db.execute(f"SELECT state, cost, prior, audit FROM before WHERE c = {k}").fetchall()
                last = np.flatnonzero(c == k)[-1:]
                one["last"] = (bool(known[last[0]]), int(turn[last[0]]), int(initial[last[0]])) if len(last) else own and own["last"] if k == 0 else None
                self.open = one
            if k < n - 1 or ends:
                finished.append(one)
        for one in finished:
            one["gaps"] = one["most"] - one["least"] + 1 - one["distinct"] if one["distinct"] else 0
        arrays = [pa.array([x["id"] for x in finished], conv.type), *(pa.array([x[k] for x in finished], pa.int64()) for k in _NAMES), pa.array([x["audit"] for x in finished], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_NAMES, "audit"])


def _plain(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(0).alias("copy"), F.lit(True).alias("present"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, present``: conversations with planted faults.

    The fault of a turn follows from crc32 of ``conv_id:turn``, modulo 20: 0
    drops it (it stays as a row that isn't present), 1 empties its text, 2
    removes full stops, exclamation and question marks, 3 repeats it, 4 makes
    it the user's. A null, here and in role and text, is one space.
    """
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    fault = F.pmod(F.crc32(key), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = _plain(rows).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return plain.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"), "present")


def _order(*first: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*first, "turn", "role", "digest", "copy")]


def _audits(turns: DataFrame) -> DataFrame:
    """One row per conversation, with the counts of faults, the cost and the audit."""
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    initial = F.substring("role", 1, 1)
    light = turns.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", "present", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    )
    # one shuffle by conversation serves both orders
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    light = light.repartition("conv_id").withColumn("nth", earlier).sortWithinPartitions(*_order("conv_id"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    light = light.select("conv_id", "turn", "present", fault.alias("fault"), "initial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("conversations")
        walker, waiting, n = None, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                if n >= BATCH:
                    walker = walker or Walker()
                    yield walker.take(pa.Table.from_batches(waiting), False)
                    waiting, n = [], 0
                waiting.append(batch.slice(start, BATCH))
                n += waiting[-1].num_rows
        if n:
            yield (walker or Walker()).take(pa.Table.from_batches(waiting), True)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return light.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{x} long' for x in _NAMES)}, audit string")


def edits(rows) -> Iterator[tuple]:
    """Events of a stream of rows ``(audit, turn, role, text)``: ``("begin", row)`` and ``("turn", row, role, text, edit)``.

    A row with an audit begins a conversation, whose turns follow in order.
    """
    state, audit, at, head = 0, "", 0, None

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = (3 if state == 2 else 2), at + 1
            yield "turn", head, "assistant" if state == 3 else "user", "", "I"

    for row in rows:
        if row[0] is not None:
            if head is not None:
                yield from inserted()
            state, audit, at, head = 0, row[0], 0, row
            yield "begin", row
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[row[2][0]]
            yield "turn", row, row[2], row[3], edit
        elif edit == "R":
            state = 3 if state == 2 else 2
            yield "turn", row, "assistant" if state == 3 else "user", row[3], edit
    if head is not None:
        yield from inserted()


def _met(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's row of ``audits`` and then its turns, in order within a partition."""
    rows = turns.where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", "text")
    both = audits.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_order())


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, turn, role, text, edit`` (K, R or I), places from 0.

    Turns are taken in the order of ``turn`` (nulls first), then role, the
    text's MD5 and copies of a row. Null roles and texts are one space, so that a
    null text is blank; rows with a null conv_id are one conversation. A
    conversation of which nothing is left has no rows, as has an empty table;
    repeated rows are duplicate turns. Other columns are ignored, whatever
    their names. A conversation's audit, one byte a turn and state, stands in
    one task.
    """
    turns = _plain(conversations)
    met = _met(turns, _audits(turns).select("conv_id", "audit"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("conversations")
        out, place = [], 0
        ids = None

        def batch_of():
            columns = list(zip(*out)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((ids, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "turn", "role", "text", "edit"])

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        for event in edits(_rows(typed(), ("audit", "turn", "role", "text", "conv_id"))):
            if event[0] == "begin":
                place = 0
                continue
            _, row, role, text, edit = event
            out.append((row[4], place, row[1], role, text, edit))
            place += 1
            if len(out) >= 1024:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return met.mapInArrow(run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def digests(conversations: DataFrame) -> DataFrame:
    """Repair of the damaged conversations: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    One row per conv_id of the table, null included. ``gaps`` counts the turn
    numbers missing between the least and the greatest; ``illegal`` the
    neighbours whose initials aren't su, ua or au; ``repaired_sha256`` is that
    of the repaired ``role:text`` lines. Conversations without a turn left
    after the damage have zeros, an empty audit and the empty text's digest.
    Odd input is treated as ``repaired`` says.
    """
    turns = damaged(conversations)
    met = _met(turns, _audits(turns))
    names = ("audit", "turn", "role", "text", "conv_id", *_NAMES)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("conversations")
        out, head, digest, some, ids = [], None, None, False, None

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        def batch_of():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(columns[k + 1], pa.int64()) for k in range(len(_NAMES))), *(pa.array(x, pa.string()) for x in columns[-2:])], names=["conv_id", *_NAMES, "audit", "repaired_sha256"])

        for event in edits(_rows(typed(), names)):
            if event[0] == "begin":
                if head is not None:
                    out.append((*head[4:], head[0], digest.hexdigest()))
                head, digest, some = event[1], hashlib.sha256(), False
                if len(out) >= 1024:
                    yield batch_of()
                    out = []
            else:
                digest.update((("\n" if some else "") + f"{event[2]}:{event[3]}").encode())
                some = True
        if head is not None:
            out.append((*head[4:], head[0], digest.hexdigest()))
            yield batch_of()

    return met.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{x} long' for x in _NAMES)}, audit string, repaired_sha256 string")
