"""Conversation structure repair: Wagner-Fischer alignment to the grammar ``(s?(ua)+)?``.

A conversation's turns, in order, get faults, of which a turn has the first that holds:
*blank* (no character but white space), *duplicate* (role and text seen earlier
in the conversation), *truncated* (the last character that isn't white space
isn't one of ``.!?``).  Edits make the roles' initials alternate: K keeps a turn,
R gives it the role user or assistant (3), D deletes it (4; blank and duplicate turns
must go), I inserts an empty turn of user or assistant (3); a truncated turn
that stays costs 3 more.  The audit is the string of edits of the cheapest repair,
among equally cheap ones the least in ASCII order.

``align`` computes it: the turns are aligned to the alternating string of each
feasible length, those nearest to the number of turns first.  The cheapest cost
so far bounds the lengths that are still feasible and the band of cells that an
alignment of that cost can pass (Ukkonen).  Each length's audit is traced back,
and the audits are compared.

A conversation may hold any part of all rows.  Rows are dealt by ranges of
(conversation, turn, role, text digest), so a large one is spread over many
tasks.  Conversations that lie within one range are repaired on the spot, ``CHUNK``
turns at a time: from each state that the grammar can be in (nothing yet,
after s, after u, after a) the chunk is aligned to each state after it.  For equal
rows and states no cheapest audit is a prefix of another, so the least audit
of a whole is made of least audits of its chunks.  Conversations that
reach over a border of ranges, or hold more than ``HOLD`` rows, are written out
row by row; their earlier occurrences are found by a grouped minimum, their
chunks aligned by many tasks, and the chunks' tables folded in order.  Only the
digest of the repaired conversation reads its rows in one task, one row
at a time, since SHA-256 is sequential; the task holds the audit and a batch.

Order is by turn (nulls first), then role, then the MD5 of the text.  A null role or
text is one space.  A null conversation id is a conversation.  Equal turns with
equal role and text are duplicates.  A role counts by its first character; an empty
role is never legal.  Very long texts pass as they are, a batch of rows at a time.
A conversation all of whose rows are ``dropped`` has zeros, an empty audit and the
digest of nothing.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import written

#: Turns that are aligned at once; rows of a conversation that a task holds; entries of a task's memo.
CHUNK, HOLD, MEMO = 32, 2048, 20_000
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NEVER = 1 << 60
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---------------------------------------------------------------- alignment
def _tapes(entry: str, length: int) -> Iterator[str]:
    """The strings of ``length`` initials that the grammar allows after the state ``entry``."""
    pair = "au" if entry == "u" else "ua"
    yield (pair * (length // 2 + 1))[:length]
    if entry == "" and length:
        yield "s" + ("ua" * (length // 2 + 1))[:length - 1]


def _gap(d: int) -> int:
    return INSERT * d if d >= 0 else -DELETE * d


def _aligned(code: str, tape: str, limit: int) -> tuple[int, str] | None:
    """(cost, least audit) of the turns against one target, or None above ``limit``.

    ``code`` has a letter per turn: its initial (``o``: any other), upper case if
    truncated, ``x`` if it must go.  ``best[i][j]`` is the cost of turns ``i``.. against
    ``tape[j:]``, for cells of the band only.
    """
    n, m = len(code), len(tape)
    shift = m - n
    low = high = 0 if shift > 0 else shift
    high = max(shift, 0)
    if _gap(shift) > limit:
        return None
    while low > -n and _gap(low - 1) + _gap(shift - low + 1) <= limit:
        low -= 1
    while high < m and _gap(high + 1) + _gap(shift - high - 1) <= limit:
        high += 1
    best = [[NEVER] * (m + 2) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row = best[i]
        after = best[i + 1] if i < n else None
        turn = code[i] if i < n else ""
        more = CUT_OFF if turn.isupper() else 0
        same = turn.lower()
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            cost = NEVER
            if j < m and tape[j] != "s":
                cost = row[j + 1] + INSERT
            if after is not None:
                cost = min(cost, after[j] + DELETE)
                if j < m and same != "x":
                    if same == tape[j]:
                        cost = min(cost, after[j + 1] + KEEP + more)
                    elif tape[j] != "s":
                        cost = min(cost, after[j + 1] + REROLE + more)
            row[j] = cost
    if best[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        cost = best[i][j]
        more = CUT_OFF if i < n and code[i].isupper() else 0
        if i < n and cost == best[i + 1][j] + DELETE:
            audit.append("D")
            i += 1
        elif j < m and tape[j] != "s" and cost == best[i][j + 1] + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if cost == best[i + 1][j + 1] + KEEP + more and code[i].lower() == tape[j] else "R")
            i, j = i + 1, j + 1
    return best[0][0], "".join(audit)


def align(code: str, entry: str = "", exits: str | None = None) -> dict[str, tuple[int, str]]:
    """(cost, audit) by the state after the turns, from the state ``entry``; states are ``""``, s, u, a.

    With ``exits="end"`` only the cheapest whole repair, under ``"end"``: the grammar allows
    to end with nothing and after a.
    """
    n, found = len(code), {}
    if entry == "":
        found["end" if exits else ""] = (DELETE * n, "D" * n)
    worst = DELETE * n + INSERT * 3
    limits = {s: (found[s][0] if s in found else worst) for s in ("end",)} if exits else {s: worst for s in "sua"}
    # from the number of turns outwards, as long as an exit's incumbent allows the difference
    for length in sorted(range(0 if entry else 1, n + worst // INSERT + 2), key=lambda m: (abs(m - n), m)):
        if _gap(length - n) > max(limits.values()):
            if length > n:
                break
            continue
        for tape in _tapes(entry, length):
            state = tape[-1] if tape else entry
            if exits and state != "a":
                continue
            key = "end" if exits else state
            hit = _aligned(code, tape, limits[key])
            if hit and (key not in found or hit < found[key]):
                found[key] = hit
                limits[key] = hit[0]
    return found


class Aligner:
    """``align`` with a bounded memo: few sequences of roles and faults make up most conversations."""

    def __init__(self):
        self.memo: dict = {}

    def __call__(self, code: str, entry: str = "", exits: str | None = None) -> dict[str, tuple[int, str]]:
        key = (code, entry, exits)
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = align(*key)
        return self.memo[key]

    def table(self, code: str) -> list[tuple[str, str, int, str]]:
        """(entry, exit, cost, audit) of a chunk."""
        return [(e, x, *hit) for e in ("", "s", "u", "a") for x, hit in self(code, e).items()]


class Fold:
    """Cheapest repair of chunks in order; what all states' audits begin with is put aside."""

    def __init__(self):
        self.states, self.done = {"": (0, "")}, []

    def add(self, table: Iterable[tuple[str, str, int, str]]) -> None:
        new: dict[str, tuple[int, str]] = {}
        for entry, out, cost, audit in table:
            if entry in self.states:
                at = self.states[entry]
                hit = (at[0] + cost, at[1] + audit)
                if out not in new or hit < new[out]:
                    new[out] = hit
        common = os.path.commonprefix([a for _, a in new.values()])
        if len(common) > 4096:
            self.done.append(common)
            new = {s: (c, a[len(common):]) for s, (c, a) in new.items()}
        self.states = new

    def result(self) -> tuple[int, str]:
        cost, audit = min(self.states[s] for s in ("", "a") if s in self.states)
        return cost, "".join(self.done) + audit


# ------------------------------------------------------------ faults and lines
def _code(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(letter for ``align``, fault) of a turn."""
    body = text.rstrip(SPACES)
    if not body:
        return "x", "blank"
    if seen:
        return "x", "duplicate"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (letter, "") if body[-1] in ".!?" else (letter.upper(), "truncated")


def lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of every repaired turn."""
    last = ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text, edit


def digest(repaired: Iterable[tuple[str, str, str]]) -> str:
    """SHA-256 of ``role:text`` lines joined by newlines."""
    h, first = hashlib.sha256(), True
    for role, text, _ in repaired:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


def _summary(rows: list[tuple], seen: set | None) -> dict:
    """Counts and letters of a chunk of live rows (turn, role, text, earlier), in order."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    letters = []
    for turn, role, text, earlier in rows:
        if seen is not None:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            earlier = mark in seen
            seen.add(mark)
        letter, fault = _code(role, text, earlier)
        letters.append(letter)
        if fault:
            out[fault] += 1
    initials = [r[1][:1] for r in rows]
    out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    return out | {"code": "".join(letters), "first": initials[0], "last": initials[-1], "turns": len(set(turns)),
                  "low": turns[0] if turns else None, "high": turns[-1] if turns else None}


class Report:
    """Counts of a conversation from its chunks' summaries, in order."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.last = self.low = self.high = None
        self.turns = 0

    def add(self, s: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[k] += s[k]
        if self.last is not None and self.last + s["first"] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = s["last"]
        if s["low"] is not None:
            self.turns += s["turns"] - (self.high == s["low"])
            self.low = s["low"] if self.low is None else self.low
            self.high = s["high"]
            self.counts["gaps"] = self.high - self.low + 1 - self.turns


def _whole(rows: list[tuple], aligner: Aligner) -> dict:
    """The report of a conversation whose live rows (turn, role, text) are all here."""
    report, seen, fold = Report(), set(), Fold()
    rows = [(*r, False) for r in rows]
    cost, audit = 0, ""
    for lo in range(0, len(rows), CHUNK):
        s = _summary(rows[lo:lo + CHUNK], seen)
        report.add(s)
        if len(rows) <= CHUNK:
            cost, audit = aligner(s["code"], "", "end")["end"]
        else:
            fold.add(aligner.table(s["code"]))
    if len(rows) > CHUNK:
        cost, audit = fold.result()
    return report.counts | {"cost": cost, "audit": audit,
                            "repaired_sha256": digest(lines(audit, iter([r[1:3] for r in rows])))}


# ------------------------------------------------------------------- Spark side
def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 512, max_chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= at_once or chars >= max_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _fields(spec: str) -> list[T.StructField]:
    return T.StructType.fromDDL(spec).fields


FOUND = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _in_ranges(turns: DataFrame) -> DataFrame:
    """Reports of conversations within one range; rows (``audit`` null) of the others."""
    order = ["conv_id", "turn", "role", "mark"]
    dealt = (turns.withColumn("mark", F.md5(F.encode("text", "UTF-8"))).withColumn("nth", F.monotonically_increasing_id())
             .repartitionByRange(*order, "nth").sortWithinPartitions(*order)
             .select("conv_id", "turn", "role", "text", "dropped"))
    schema = T.StructType([turns.schema["conv_id"], *_fields("part int, seq bigint, turn bigint, role string, text string, dropped boolean"),
                           *_fields(FOUND)])
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        blank = (None,) * (len(COUNTS) + 2)

        def out() -> Iterator[tuple]:
            aligner, seq = Aligner(), 0
            now, held, chars = None, [], 0
            loose, begun = True, False                 # loose: rows of this conversation pass as they are
            for conv, *row in _rows(batches, ["conv_id", "turn", "role", "text", "dropped"]):
                if begun and conv != now:
                    if not loose:
                        r = _whole([x[:3] for x in held if not x[3]], aligner)
                        yield (now, part, None, None, None, None, None, *(r[c] for c in COUNTS), r["audit"], r["repaired_sha256"])
                    held, chars, loose = [], 0, False
                now, begun = conv, True
                held.append(row)
                chars += len(row[2])
                loose = loose or len(held) > HOLD or chars > 1 << 22
                if loose:
                    for x in held:
                        seq += 1
                        yield (now, part, seq, *x, *blank)
                    held = []
            for x in held:                             # the last conversation may go on in the next range
                seq += 1
                yield (now, part, seq, *x, *blank)

        yield from _batches(out(), kinds)

    return written(dealt.mapInArrow(run, schema), "turns")


def _chunk_tables(rows: DataFrame) -> DataFrame:
    """Summary and alignment table of every chunk of live rows."""
    firsts = rows.withColumn("mark", F.md5(F.encode("text", "UTF-8")))
    least = firsts.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m")).agg(
        F.min(F.struct("part", "seq")).alias("least"))
    known = firsts.join(least, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")))
    known = known.select("conv_id", "part", "seq", "turn", "role", "text", (F.struct("part", "seq") > F.col("least")).alias("earlier"),
                         F.floor(F.col("seq") / CHUNK).alias("chunk"))
    schema = T.StructType([rows.schema["conv_id"], *_fields(
        "part int, chunk bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
        "turns bigint, low bigint, high bigint, "
        "table array<struct<entry: string, leave: string, cost: bigint, audit: string>>")])
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            aligner, key, held = Aligner(), None, []

            def summed() -> tuple:
                s = _summary(held, None)
                table = [dict(zip(("entry", "leave", "cost", "audit"), t)) for t in aligner.table(s["code"])]
                return (*key, *(s[c] for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high")), table)

            for conv, part, chunk, *row in _rows(batches, ["conv_id", "part", "chunk", "turn", "role", "text", "earlier"]):
                if held and (conv, part, chunk) != key:
                    yield summed()
                    held = []
                key = (conv, part, chunk)
                held.append(row)
            if held:
                yield summed()

        yield from _batches(out(), kinds)

    dealt = known.repartition("conv_id", "part", "chunk").sortWithinPartitions("conv_id", "part", "chunk", "seq")
    return dealt.select("conv_id", "part", "chunk", "turn", "role", "text", "earlier").mapInArrow(run, schema)


def _folded(tables: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit) from the chunks' tables, read in order."""
    schema = T.StructType([tables.schema["conv_id"], *_fields(FOUND.rsplit(",", 1)[0])])
    kinds, names = _arrow(schema), tables.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, report, fold = None, None, None
            for row in _rows(batches, names):
                s = dict(zip(names, row))
                if report is not None and s["conv_id"] != now:
                    cost, audit = fold.result()
                    yield (now, *(report.counts | {"cost": cost}).values(), audit)
                    report = None
                if report is None:
                    now, report, fold = s["conv_id"], Report(), Fold()
                report.add(s)
                fold.add((t["entry"], t["leave"], t["cost"], t["audit"]) for t in s["table"])
            if report is not None:
                cost, audit = fold.result()
                yield (now, *(report.counts | {"cost": cost}).values(), audit)

        yield from _batches(out(), kinds)

    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(run, schema)


def _replayed(rows: DataFrame, audits: DataFrame, order: list[str], as_rows: bool) -> DataFrame:
    """Audits applied to the rows (conv_id, role, text, columns of ``order``) of their conversations.

    A conversation's audit comes first in its stream of rows.  Gives
    (conv_id, repaired_sha256), or every repaired turn.
    """
    kind = rows.schema["conv_id"]
    tail = "place bigint, role string, text string, edit string" if as_rows else "repaired_sha256 string"
    schema = T.StructType([kind, *_fields(tail)])
    kinds = _arrow(schema)
    names = ["role", "text", *(c for c in order if c not in ("role", "text"))]
    stream = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), *names).unionByName(
        audits.select("conv_id", "audit", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _rows(batches, ["conv_id", "audit", "role", "text"])
        ahead: list = [next(source, None)]

        def own() -> Iterator[tuple[str, str]]:
            """Rows up to the next audit."""
            while (row := next(source, None)) is not None and row[1] is None:
                yield row[2:]
            ahead.append(row)

        def out() -> Iterator[tuple]:
            while (head := ahead.pop()) is not None:
                turns = own()
                repaired = lines(head[1], turns)
                if as_rows:
                    for place, line in enumerate(repaired):
                        yield (head[0], place, *line)
                else:
                    yield (head[0], digest(repaired))
                for _ in turns:                        # all have an edit; this only finds the next audit
                    pass

        yield from _batches(out(), kinds)

    sorted_rows = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order)
    return sorted_rows.mapInArrow(run, schema)


def _live(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
                        (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("dropped"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           dropped: Column | None = None) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256) of every conversation; ``dropped`` rows only name theirs."""
    seams = _in_ranges(_live(turns, conv, turn, role, text, dropped))
    whole = seams.filter("audit IS NOT NULL")
    rows = seams.filter("audit IS NULL")
    live = rows.filter("NOT dropped").select("conv_id", "part", "seq", "turn", "role", "text")
    folded = written(_folded(_chunk_tables(live)), "audits")
    hashed = _replayed(live, folded, ["part", "seq"], False).withColumnRenamed("conv_id", "c")
    split = folded.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")))
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    nothing = rows.select("conv_id").distinct().join(
        folded.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select(
        "conv_id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("audit"),
        F.lit(digest([])).alias("repaired_sha256"))
    return whole.select(*names).unionByName(split.select(*names)).unionByName(nothing)


def repaired_turns(turns: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", dropped: Column | None = None) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations, by the audits that ``repair`` found."""
    live = _live(turns, conv, turn, role, text, dropped).filter("NOT dropped")
    return _replayed(live.withColumn("mark", F.md5(F.encode("text", "UTF-8"))), audits.select("conv_id", "audit"),
                     ["turn", "role", "mark"], True)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with ``dropped``: a quarter of them damaged by the CRC-32 of ``conv_id:turn``, a null as one space.

    Of its remainders by 20, 0 drops the row, 1 empties the text, 2 removes ``.!?`` from it, 3
    repeats the row and 4 gives it the role user.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).when(kind == 0, "").otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"),
                                F.explode(copies).alias("copy")).drop("copy")
