"""Operator 13: repair of conversation structure by weighted CYK parsing over intervals of turns.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  The repair grammar is in Chomsky normal form: a
nonterminal [p, q] stands for the turns that lead from state p to state q of that pattern, [p, q] -> [p, r] [r, q] are its
binary rules, and a turn that is kept, given another role or deleted is a terminal.  Insertion closure: every cell of one turn
is closed under inserted turns before and behind it.  A cell holds, per nonterminal, the least (cost, audit).

Spans of up to ``BLOCK`` turns are parsed bottom-up by length over all their splits.  Since the nonterminals are closed under
splitting, a longer span needs one split only, so blocks are combined in pairs, then fours, and so on.  Edits of equal cost on
one span never give an audit that begins another one, so the least audit of a span is made of the least audits of its parts.

Conversations of up to ``LONG_ROWS`` turns and ``LONG_BYTES`` of text are parsed where their rows meet.  Longer ones are cut
into chunks by position: chunks are parsed in parallel, their cells combined ``FAN`` at a time, and the edits joined to rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import SPACE, load, map_arrow
from leadwake.operators.ranking import running_counts
from leadwake.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK, LONG_ROWS, LONG_BYTES, CHUNK, FAN = 16, 1024, 1 << 24, 256, 64
#: The pattern's moves: from a state by an initial to a state.  0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
AT = {pq: k for k, pq in enumerate(PAIRS)}
RULES = [(k, [(AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT]) for (p, q), k in AT.items()]
#: What follows which role initial without fault.
PROPER = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, CUT = range(4)
_SIGN = re.compile(rf"[^{SPACE}]")
_END = re.compile(rf"[.!?][{SPACE}]*\Z")
COUNTS = "blank long, duplicate long, truncated long, illegal long"
LINE = "struct<turn:long,edit:string,role:string,text:string>"


def combined(a: list, b: list) -> list:
    """The cell of a span from the cells of its two parts."""
    out = []
    for _, ways in RULES:
        best = None
        for x, y in ways:
            x, y = a[x], b[y]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = (cost, x[1] + y[1])
                elif cost == best[0]:
                    best = min(best, (cost, x[1] + y[1]))
        out.append(best)
    return out


def _closure() -> list:
    """No turn at all: nothing, or the cheapest inserted turns between two states."""
    cell = [(0, "") if p == q else None for p, q in PAIRS]
    one = [min(((INSERT, "I") for role in "ua" if MOVES.get((p, role)) == q), default=None) for p, q in PAIRS]
    for _ in range(3):
        step = combined(cell, one)
        cell = [min((x for x in pair if x is not None), default=None) for pair in zip(cell, step)]
    return cell


EMPTY = _closure()


@lru_cache(4096)
def turn_cell(initial: str, fault: int) -> list:
    """The cell of one turn."""
    extra = TRUNCATED if fault == CUT else 0
    cell = []
    for p, q in PAIRS:
        ways = [(DELETE, "D")] if p == q else []
        if fault not in (BLANK, DUPLICATE):
            if MOVES.get((p, initial)) == q:
                ways.append((KEEP + extra, "K"))
            if any(MOVES.get((p, role)) == q for role in "ua"):
                ways.append((REROLE + extra, "R"))
        cell.append(min(ways, default=None))
    return combined(combined(EMPTY, cell), EMPTY)


def cyk(turns: list[list]) -> list:
    """The cell of a short span: all spans by length, over all splits."""
    spans = {(k, k + 1): cell for k, cell in enumerate(turns)}
    for length in range(2, len(turns) + 1):
        for i in range(len(turns) - length + 1):
            j = i + length
            tries = [combined(spans[i, k], spans[k, j]) for k in range(i + 1, j)]
            spans[i, j] = [min((x for x in ways if x is not None), default=None) for ways in zip(*tries)]
    return spans[0, len(turns)]


def parsed(turns: list[list]) -> list:
    """The cell of a span of any length."""
    level = [cyk(turns[k:k + BLOCK]) for k in range(0, len(turns), BLOCK)]
    while len(level) > 1:
        level = [combined(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def accepted(cell: list) -> tuple[int, str]:
    """The least edits that give a proper conversation, or none at all."""
    return min(x for x in (cell[AT[0, 0]], cell[AT[0, 3]]) if x is not None)


def faults(rows: list[tuple[str, str]], seen: set | None = None) -> list[int]:
    """The first fault of each (role, text) row in order."""
    seen = set() if seen is None else seen
    out = []
    for row in rows:
        known = row in seen
        seen.add(row)
        out.append(BLANK if not _SIGN.search(row[1]) else DUPLICATE if known else NONE if _END.search(row[1]) else CUT)
    return out


def edits(audit: str) -> list[tuple[int, int, str, str | None]]:
    """(row from 1, place behind it, edit, new role or none) of each letter.  Turns inserted before all rows come at row 0."""
    state = 1 if len(audit.replace("D", "")) % 2 else 3  # an odd number of turns begins with a system turn, which is kept
    row = place = 0
    out = []
    first = state == 1
    for x in audit:
        row, place = (row, place + 1) if x == "I" else (row + 1, 0)
        role = None
        if x != "D":
            if first:
                first = False
            else:
                role = "assistant" if state == 2 else "user"
                state = 3 if state == 2 else 2
        out.append((row, place, x, role if x in "RI" else None))
    return out


def _lines(rows: list[tuple], audit: str) -> list[dict]:
    """The repaired turns of (turn, role, text) rows."""
    out = []
    for k, _, x, role in edits(audit):
        if x == "I":
            out.append({"turn": None, "edit": x, "role": role, "text": ""})
        elif x != "D":
            turn, old, text = rows[k - 1]
            out.append({"turn": turn, "edit": x, "role": role or old, "text": text})
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in PROPER for a, b in zip(initials, initials[1:]))


def _whole(turns: DataFrame) -> DataFrame:
    """Conversations that fit in a task: key, counts, cost, audit, lines."""

    def result(key, rows):
        said = [(r, t) for _, r, t in rows]
        found, initials = faults(said), [r[:1] for r, _ in said]
        cost, audit = accepted(parsed([turn_cell(i, f) for i, f in zip(initials, found)]))
        days = {t for t, _, _ in rows if t is not None}
        gaps = max(days) - min(days) + 1 - len(days) if days else 0
        return {"key": key, "gaps": gaps, "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(CUT),
                "illegal": _illegal(initials), "cost": cost, "audit": audit, "lines": _lines(rows, audit)}

    def run(batches):
        key, rows, done, size = None, [], [], 0
        for b in batches:
            for k, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        done.append(result(key, rows))
                        if size > LONG_BYTES or len(done) >= 512:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done, size = [], 0
                    key, rows = k, []
                if role is not None:  # a row without role only names its conversation
                    rows.append((turn, role, text))
                    size += len(text)
        if key is not None:
            done.append(result(key, rows))
        yield pa.RecordBatch.from_pylist(done, schema)

    line = pa.struct([("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("lines", pa.list_(line))])
    order = F.col("turn").asc_nulls_first()
    met = turns.select("key", "turn", "role", "text").repartition("key").sortWithinPartitions("key", order, "role", "text")
    return map_arrow(met, run, f"key string, gaps long, {COUNTS}, cost long, audit string, lines array<{LINE}>")


_CELL = f"key string, chunk long, first string, last string, {COUNTS}, cells array<struct<cost:long,audit:string>>"


def _cell_rows(grouped: DataFrame, read, join) -> DataFrame:
    """One cell per run of rows with equal (key, part); rows come ordered inside a run.  Cells are joined as rows arrive."""

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                mark = row["key"], row["part"]
                if mark != now:
                    out += [state] if now is not None else []
                    now, state = mark, None
                fresh = read(row)
                state = fresh if state is None else join(state, fresh)
            yield pa.RecordBatch.from_pylist([_given(x) for x in out], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([_given(state)], schema)

    cell = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("cells", cell)])
    return map_arrow(grouped, run, _CELL)


def _given(x: dict) -> dict:
    return {**x, "cells": [None if c is None else {"cost": c[0], "audit": c[1]} for c in x["cells"]]}


def _read_cell(row: dict) -> dict:
    cells = [None if c is None else (c["cost"], c["audit"]) for c in row["cells"]]
    return {k: row[k] for k in ("key", "first", "last", "blank", "duplicate", "truncated", "illegal")} | {"chunk": row["part"], "cells": cells}


def _read_turn(row: dict) -> dict:
    fault = row["fault"]
    return {"key": row["key"], "chunk": row["part"], "first": row["initial"], "last": row["initial"], "blank": int(fault == BLANK), "duplicate": int(fault == DUPLICATE),
            "truncated": int(fault == CUT), "illegal": 0, "cells": turn_cell(row["initial"], fault)}


def _joined(a: dict, b: dict) -> dict:
    sums = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += a["last"] + b["first"] not in PROPER
    return {"key": a["key"], "chunk": a["chunk"], "first": a["first"], "last": b["last"], **sums, "cells": combined(a["cells"], b["cells"])}


def _in_chunks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations too long for a task: (key, counts, cost, audit) and their rows (key, pos, turn, role, text)."""
    placed = running_counts(turns.filter("role is not null").select("key", "turn", "role", "text"), ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"pos": F.lit(True)})
    placed = materialize(placed.withColumn("digest", F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256)))
    first = placed.groupBy("key", "digest").agg(F.min("pos").alias("since"))
    sign, end = F.col("text").rlike(f"[^{SPACE}]"), F.rtrim(F.translate("text", "\t\n\x0b\f\r", " " * 5)).rlike(r"[.!?]\z")
    fault = F.when(~sign, BLANK).when(F.col("pos") > F.col("since"), DUPLICATE).when(end, NONE).otherwise(CUT)
    skinny = placed.join(first, ["key", "digest"]).select("key", "pos", F.floor((F.col("pos") - 1) / CHUNK).cast("long").alias("part"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    cells = materialize(_cell_rows(skinny.repartition("key", "part").sortWithinPartitions("key", "part", "pos"), _read_turn, _joined))
    while cells.agg(F.max("chunk")).first()[0]:
        wider = cells.withColumn("part", F.floor(F.col("chunk") / FAN).cast("long"))
        cells = materialize(_cell_rows(wider.repartition("key", "part").sortWithinPartitions("key", "part", "chunk"), _read_cell, _joined))
    best = F.array_min(F.filter(F.array(F.col("cells")[AT[0, 0]], F.col("cells")[AT[0, 3]]), lambda x: x.isNotNull()))
    turns_seen = placed.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = cells.withColumn("best", best).join(turns_seen, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    return materialize(found), placed.select("key", "pos", "turn", "role", "text")


def _chunk_lines(found: DataFrame, placed: DataFrame) -> DataFrame:
    """The repaired turns of long conversations: (key, pos, place, turn, edit, role, text)."""

    def run(batches):
        for b in batches:
            for key, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                all_edits = [e for e in edits(audit) if e[2] != "D"]
                for k in range(0, len(all_edits), 65536):
                    pos, place, edit, role = zip(*all_edits[k:k + 65536])
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(pos)), "pos": pa.array(pos, pa.int64()), "place": pa.array(place, pa.int64()), "edit": pa.array(edit), "new": pa.array(role, pa.string())})

    asked = map_arrow(found.select("key", "audit"), run, "key string, pos long, place long, edit string, new string")
    return asked.join(placed, ["key", "pos"], "left").select(
        "key", "pos", "place", F.when(F.col("edit") != "I", F.col("turn")).alias("turn"), "edit", F.coalesce("new", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _chunk_digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256): a digest needs its lines in order, so a conversation's lines stream through one task, none is held."""

    def run(batches):
        now, state = None, None
        for b in batches:
            for key, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"key": [now], "repaired_sha256": [state.hexdigest()]})
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if now is not None:
            yield pa.RecordBatch.from_pydict({"key": [now], "repaired_sha256": [state.hexdigest()]})

    met = lines.repartition("key").sortWithinPartitions("key", "pos", "place").select("key", "role", "text")
    return map_arrow(met, run, "key string, repaired_sha256 string")


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a text key per conversation (null ids are one), split into conversations that fit in a task and longer ones."""
    blank = F.lit(" ")
    absent = F.col("absent") if "absent" in rows.columns else F.lit(False)
    turns = rows.select(F.coalesce(F.col("conv_id").cast("string"), blank).alias("key"), F.when(~absent, F.col("turn").cast("long")).alias("turn"),
                        F.when(~absent, F.coalesce("role", blank)).alias("role"), F.when(~absent, F.coalesce("text", blank)).alias("text"))
    long = materialize(turns.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
                       .filter((F.col("n") > LONG_ROWS) | (F.col("size") > LONG_BYTES)).select("key"))
    if long.isEmpty():
        return turns, None
    return turns.join(long, "key", "left_anti"), materialize(turns.join(long, "key", "left_semi"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    ``rows``: conv_id, turn, role, text; other columns are not read, but where ``absent`` is given and true a row only names
    its conversation.  Null roles and texts read as one blank, null turns come first, null ids are one conversation.  Rows of
    one turn stand by role, then text.  A conversation without rows has zeros and an empty audit.  Texts may be of any length.
    """
    turns, long = _prepared(rows)
    short = _whole(turns)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    out = short.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    if long is not None:
        found, placed = _in_chunks(long)
        named = long.select("key").distinct().join(found, "key", "left").join(_chunk_digests(_chunk_lines(found, placed)), "key", "left")
        zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        out = out.union(named.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}).select(out.columns))
    return out.select(F.when(F.col("key") != " ", F.col("key")).cast(rows.schema["conv_id"].dataType).alias("conv_id"), *out.columns[1:])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), turn (null where inserted), edit (K, R or I), role, text."""
    turns, long = _prepared(rows)
    out = _whole(turns).select("key", F.posexplode("lines").alias("k", "x")).select("key", (F.col("k") + 1).cast("long").alias("place"), "x.*")
    if long is not None:
        lines = materialize(_chunk_lines(*_in_chunks(long)))
        out = out.union(running_counts(lines.withColumnRenamed("place", "at"), ["key"], [F.col("pos"), F.col("at")], {"place": F.lit(True)}).select(out.columns))
    return out.select(F.when(F.col("key") != " ", F.col("key")).cast(rows.schema["conv_id"].dataType).alias("conv_id"), *out.columns[1:])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults by the hash of conversation and turn; a dropped row stays as one that is absent."""
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce("text", blank)
    return (rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
                        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                        (h == 0).alias("absent"), F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy"))


def op13(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(load(spark, sf_dir, "conversations")))
