"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation's rows are edited until its role initials read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turns. Rows are kept (K),
deleted (D) or given another role (R), turns are inserted (I); the cheapest edits
are taken, and of those with equal cost the ones whose initials are the least.

The grammar has four states: nothing yet, after a system turn, after a user turn,
after an assistant turn. A forward vector holds the cost of reaching each state
and how the least initials that reach it compare; a backward vector holds the cost
to the end. They meet in the middle, the least of the cheapest crossings is
chosen, and both halves are solved alike, so nothing but the edits is kept. Two
strings of initials that have consumed the same rows never begin one another,
since both end with the edit of the last row; so their order decides.

Rows are dealt by ranges of (conversation, turn) and cut into fragments of at
most ``FRAGMENT_ROWS`` rows or ``FRAGMENT_BYTES`` of text. Nearly all conversations
are one fragment and are repaired in that pass. One that a range or a limit has
cut, such as one that holds a third of all rows, becomes a four-by-four matrix per
fragment; the forward and backward vectors run over the matrices, which settles
the states at the cuts, and then every fragment is repaired for itself.

Defined cases: a null role or text is one space; null turns come first; rows with
one turn go by the md5 of ``role:text``; a null ``conv_id`` is a conversation of
its own; rows that repeat are duplicates; an empty table has no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.llm.ngram_join import complete_groups
from peerscope.session import materialize

FRAGMENT_ROWS, FRAGMENT_BYTES = 4096, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States of the grammar.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed turn, and the role that it gets.
_TURN = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row of each initial; no entry where it may not be kept.
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
_INITIALS = ("s", "u", "a", "")
#: Faults as they count for the edits; a row's code is its initial and its fault.
SOUND, REMOVED, CUT = range(3)
END = 12
_FAR = 1 << 40
_LEGAL = {"su", "ua", "au"}


def _steps(code: int) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row, the states after it with their least cost and initials."""
    out = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, inserted = before, ""
        for _ in range(3):
            cost = INSERT * len(inserted)
            if code == END:
                options = [(START, cost, inserted)] if state in (START, ASSISTANT) else []
            else:
                initial, fault = _INITIALS[code // 3], code % 3
                options = [(state, cost + DELETE, inserted + "D")]
                if fault != REMOVED:
                    extra = cost + TRUNCATED * (fault == CUT)
                    options.append((_TURN[state], extra + REROLE, inserted + "R"))
                    if state in _KEPT[initial]:
                        options.append((_KEPT[initial][state], extra + KEEP, inserted + "K"))
            for after, price, edits in options:
                best[after] = min(best.get(after, (_FAR, "")), (price, edits))
            state, inserted = _TURN[state], inserted + "I"
        out.append(best)
    return out


#: Every edit of one row that can be part of the cheapest; the last code is the end of the conversation.
STEPS = [_steps(code) for code in range(END + 1)]


@lru_cache(maxsize=1 << 16)
def _forward(costs: tuple, ranks: tuple, code: int) -> tuple[tuple, tuple, int]:
    """Costs (least 0) and order of the least initials of all states one row on, and what was taken off."""
    best: dict[int, tuple] = {}
    for before in range(4):
        if costs[before] < _FAR:
            for after, (price, edits) in STEPS[code][before].items():
                found = (costs[before] + price, ranks[before], edits)
                best[after] = min(best.get(after, found), found)
    least = min(cost for cost, _, _ in best.values())
    order = {after: k for k, after in enumerate(sorted(best, key=lambda s: best[s][1:]))}
    return tuple(best[s][0] - least if s in best else _FAR for s in range(4)), tuple(order.get(s, 4) for s in range(4)), least


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, code: int) -> tuple[tuple, int]:
    found = [min((price + costs[after] for after, (price, _) in STEPS[code][s].items()), default=_FAR) for s in range(4)]
    least = min(found)
    return tuple(min(c - least, _FAR) for c in found), least


def run_forward(codes: bytes, first: int, after: int, start: int) -> tuple[tuple, tuple, int]:
    """Costs and order of the states behind ``codes[first:after]``, and the cost to add to all."""
    costs = tuple(0 if s == start else _FAR for s in range(4))
    ranks, total = (0, 0, 0, 0), 0
    for k in range(first, after):
        costs, ranks, taken = _forward(costs, ranks, codes[k])
        total += taken
    return costs, ranks, total


def run_backward(codes: bytes, first: int, after: int, end: int) -> tuple:
    """Costs, but for a number that all share, from each state before ``codes[first:after]`` to ``end``."""
    costs = tuple(0 if s == end else _FAR for s in range(4))
    for k in range(after - 1, first - 1, -1):
        costs, _ = _backward(costs, codes[k])
    return costs


def hirschberg(codes: bytes, first: int, after: int, start: int, end: int) -> list[str]:
    """The least of the cheapest edits of each row on the way from ``start`` to ``end``."""
    if first == after:
        return []
    if after - first == 1:
        return [STEPS[codes[first]][start][end][1]]
    middle = (first + after) // 2
    ahead, ranks, _ = run_forward(codes, first, middle, start)
    behind = run_backward(codes, middle, after, end)
    crossing = min((s for s in range(4) if ahead[s] < _FAR), key=lambda s: (ahead[s] + behind[s], ranks[s]))
    return hirschberg(codes, first, middle, start, crossing) + hirschberg(codes, middle, after, crossing, end)


@lru_cache(maxsize=1 << 15)
def _solve_short(codes: bytes, start: int, end: int) -> tuple[str, ...]:
    return tuple(hirschberg(codes, 0, len(codes), start, end))


def _solve(codes: bytes, start: int, end: int) -> tuple[str, ...] | list[str]:
    """Short conversations look alike, so their edits are remembered."""
    return _solve_short(codes, start, end) if len(codes) <= 32 else hirschberg(codes, 0, len(codes), start, end)


def rebuild(rows: list[tuple], edits: tuple[str, ...] | list[str], codes: bytes, state: int) -> list[dict]:
    """The repaired ``role`` and ``text`` rows; edits beyond the rows are turns at the end."""
    out = []
    for k, own in enumerate(edits):
        for edit in own:
            if edit in "IR":
                state = _TURN[state]
                out.append({"role": _ROLE[state], "text": rows[k][2] if edit == "R" else ""})
            elif edit == "K":
                state = _KEPT[_INITIALS[codes[k] // 3]][state]
                out.append({"role": rows[k][1], "text": rows[k][2]})
    return out


def look(rows: list[tuple], known: set | None = None) -> tuple[bytes, dict]:
    """Codes of ``(turn, role, text)`` rows, and what to report of them; ``known`` rows were seen before."""
    seen, codes = set(), bytearray()
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns = set()
    previous = None
    for turn, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = SOUND
        if not body:
            counts["blank"] += 1
            fault = REMOVED
        elif (role, text) in seen or (known and message_key(role, text) in known):
            counts["duplicate"] += 1
            fault = REMOVED
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            fault = CUT
        seen.add((role, text))
        initial = role[:1]
        counts["illegal"] += previous is not None and previous + initial not in _LEGAL
        previous = initial
        codes.append(3 * ("sua".index(initial) if initial and initial in "sua" else 3) + fault)
        if turn is not None:
            turns.add(turn)
    return bytes(codes), counts | {
        "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(turns),
        "first_initial": rows[0][1][:1], "last_initial": rows[-1][1][:1],
    }


def message_key(role: str, text: str) -> str:
    """As ``_message_key`` has it in Spark."""
    return hashlib.md5(f"{hashlib.md5(role.encode()).hexdigest()}{text}".encode()).hexdigest()


def _message_key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.md5(role), text))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults that the crc32 of ``conv_id:turn`` deals out."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(conversations["conv_id"].cast("string"), blank), F.lit(":"), F.coalesce(conversations["turn"].cast("string"), blank)
    )
    dealt = conversations.select(
        "conv_id", conversations["turn"].cast("bigint").alias("turn"), F.coalesce(conversations["role"].cast("string"), blank).alias("role"),
        F.coalesce(conversations["text"].cast("string"), blank).alias("text"), (F.crc32(key) % 20).alias("fault"),
    ).filter("fault != 0")
    return dealt.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_MESSAGES = "array<struct<role:string,text:string>>"
_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages")


def _repair_whole(rows: list[tuple]) -> dict:
    codes, seen = look(rows)
    codes += bytes([END])
    edits = _solve(codes, START, START)
    return {
        "gaps": seen["last_turn"] - seen["first_turn"] + 1 - seen["turns"] if seen["turns"] else 0,
        **{k: seen[k] for k in _RESULT[1:5]}, "cost": run_forward(codes, 0, len(codes), START)[2], "audit": "".join(edits),
        "messages": rebuild(rows, edits, codes, START),
    }


def _fragments(schema: pa.Schema, most_rows: int, most_bytes: int):
    """Cut sorted rows into fragments; whole conversations are repaired at once."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 33, 0
        conv, rows, size = None, [], 0
        edge = True  # the first conversation may have begun in the range before, and one that was cut goes on
        out: list[dict] = []

        def fragment(whole: bool) -> dict:
            nonlocal number
            number += 1
            own = {"conv_id": conv, "at": base + number, "rows": None, **dict.fromkeys(_RESULT)}
            return own | (_repair_whole(rows) if whole else {"rows": [{"turn": t, "role": r, "text": x} for t, r, x in rows]})

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema)

        held = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")]
            for own, turn, role, text in zip(*columns, strict=True):
                if rows and (own != conv or len(rows) >= most_rows or size + len(text) > most_bytes):
                    same = own == conv
                    out.append(fragment(not edge and not same))
                    held += size
                    edge = same
                    rows, size = [], 0
                    if held > most_bytes:
                        yield batch_of(out)
                        out, held = [], 0
                conv = own
                rows.append((turn, role, text))
                size += len(text) + 64
        if rows:
            out.append(fragment(False))  # it may go on in the next range
        if out:
            yield batch_of(out)

    return cut


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair(rows: DataFrame, most_rows: int = FRAGMENT_ROWS, most_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """``(conv_id, at, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, messages)`` per fragment of ``(conv_id, turn, role, text)``.

    The numbers of a conversation's fragments add up to its own; ``audit`` and
    ``messages`` follow each other in the order of ``at``. ``whole`` fragments are
    all of their conversation.
    """
    conv_type = rows.schema["conv_id"].dataType
    counted = [T.StructField(k, T.LongType()) for k in _RESULT[:6]]
    results = [*counted, T.StructField("audit", T.StringType()), T.StructField("messages", T.DataType.fromDDL(_MESSAGES))]
    fields = [
        T.StructField("conv_id", conv_type), T.StructField("at", T.LongType()),
        T.StructField("rows", T.DataType.fromDDL("array<struct<turn:bigint,role:string,text:string>>")), *results,
    ]
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])
    order = [F.col("conv_id"), F.col("turn"), F.md5(F.concat_ws(":", "role", "text")), F.monotonically_increasing_id()]
    keyed = rows.select("conv_id", "turn", "role", "text", order[2].alias("tie"), order[3].alias("number"))
    # The number only lets equal rows be dealt to several ranges.
    dealt = keyed.repartitionByRange("conv_id", "turn", "tie", "number").sortWithinPartitions("conv_id", "turn", "tie", "number")
    cut = materialize(dealt.select("conv_id", "turn", "role", "text").mapInArrow(_fragments(arrow, most_rows, most_bytes), schema), "fragments")
    whole = cut.filter("rows IS NULL").withColumn("whole", F.lit(True))
    parts = _repair_parts(cut.filter("rows IS NOT NULL").select("conv_id", "at", "rows"), results)
    names = ["conv_id", "at", "whole", *_RESULT]
    return whole.select(*names).unionByName(parts.withColumn("whole", F.lit(False)).select(*names))


def _conv_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def _seen_before(parts: DataFrame) -> DataFrame:
    """``(at, known)``: the messages of a fragment that an earlier one of its conversation has."""
    message = F.transform("rows", lambda r: _message_key(r["role"], r["text"]))
    each = parts.select(_conv_key(), "at", F.explode(F.array_distinct(message)).alias("message"))
    first = each.groupBy("conv", "message").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return each.join(materialize(first, "first"), ["conv", "message"]).filter("at > first").groupBy("at").agg(F.collect_list("message").alias("known"))


_LOOK = (
    "conv string, at bigint, codes binary, costs array<bigint>, ranks array<int>, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_turn bigint, last_turn bigint, turns bigint, first_initial string, last_initial string"
)
_BORDERS = "at bigint, start int, goal int, tail string, gaps bigint, illegal bigint, cost bigint"


def _look_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {}
        for conv, at, rows, known in zip(*(batch.column(k).to_pylist() for k in ("conv", "at", "rows", "known")), strict=True):
            codes, seen = look([(r["turn"], r["role"], r["text"]) for r in rows], set(known or ()))
            costs, ranks = [], []
            for start in range(4):
                reached, order, total = run_forward(codes, 0, len(codes), start)
                costs += [c + total if c < _FAR else _FAR for c in reached]
                ranks += order
            for k, v in ({"conv": conv, "at": at, "codes": codes, "costs": costs, "ranks": ranks} | seen).items():
                out.setdefault(k, []).append(v)
        if out:
            yield pa.RecordBatch.from_pydict({
                **{k: out[k] for k in ("conv", "at", "codes")}, "costs": pa.array(out["costs"], pa.list_(pa.int64())),
                "ranks": pa.array(out["ranks"], pa.list_(pa.int32())),
                **{k: pa.array(out[k], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns")},
                **{k: out[k] for k in ("first_initial", "last_initial")},
            })


def _settle_borders(table: pa.Table) -> pa.RecordBatch:
    """The states at the cuts of one conversation, from the matrices of its fragments in order."""
    parts = table.select(["at", "costs", "ranks", "illegal", "first_turn", "last_turn", "turns", "first_initial", "last_initial"]).to_pylist()
    left = [tuple(STEPS[END][s].get(START, (_FAR, ""))[0] for s in range(4))]
    for part in reversed(parts):
        left.append(tuple(min(part["costs"][4 * s + t] + left[-1][t] for t in range(4)) for s in range(4)))
    left.reverse()
    state, turns, last, out = START, 0, None, []
    for k, part in enumerate(parts):
        reached = range(4 * state, 4 * state + 4)
        goal = min(
            (t for t in range(4) if part["costs"][reached[t]] < _FAR), key=lambda t: (part["costs"][reached[t]] + left[k + 1][t], part["ranks"][reached[t]])
        )
        # A turn that a cut goes through counts once.
        turns += part["turns"] - (last is not None and part["first_turn"] == last)
        last = part["last_turn"] if part["last_turn"] is not None else last
        illegal = part["illegal"] + (k > 0 and parts[k - 1]["last_initial"] + part["first_initial"] not in _LEGAL)
        out.append({"at": part["at"], "start": state, "goal": goal, "tail": "", "gaps": 0, "illegal": illegal, "cost": 0})
        state = goal
    out[-1]["tail"] = STEPS[END][state][START][1]
    first = min((p["first_turn"] for p in parts if p["turns"]), default=0)
    out[0] |= {"cost": left[0][START], "gaps": last - first + 1 - turns if turns else 0}
    return pa.RecordBatch.from_pylist(out, pa.schema([
        ("at", pa.int64()), ("start", pa.int32()), ("goal", pa.int32()), ("tail", pa.string()), ("gaps", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())
    ]))


def _repair_parts(parts: DataFrame, results: list[T.StructField]) -> DataFrame:
    """The fragments of conversations that were cut."""
    looked = materialize(
        parts.join(_seen_before(parts), "at", "left").select(_conv_key(), "at", "rows", "known").mapInArrow(_look_at, _LOOK), "looked"
    )
    borders = looked.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(complete_groups(_settle_borders, "conv"), _BORDERS)
    ready = parts.join(looked.select("at", "codes", "blank", "duplicate", "truncated"), "at").join(materialize(borders, "borders"), "at")
    fields = [parts.schema["conv_id"], parts.schema["at"], *results]
    schema = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                codes = row["codes"] + (bytes([END]) if row["tail"] else b"")
                edits = [*_solve(row["codes"], row["start"], row["goal"]), *([row["tail"]] if row["tail"] else [])]
                rows = [(r["turn"], r["role"], r["text"]) for r in row["rows"]]
                out = {f.name: row.get(f.name) for f in fields} | {"audit": "".join(edits), "messages": rebuild(rows, edits, codes, row["start"])}
                yield pa.RecordBatch.from_pylist([out], schema)

    return ready.mapInArrow(finish, T.StructType(fields))


def _digest_parts(parts: DataFrame) -> DataFrame:
    """Audit and hash of conversations in several fragments, one fragment in memory at a time."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    own = parts.select(
        _conv_key(), "conv_id", "at", *counts, "audit", F.when(F.size("messages") > 0, lines).alias("lines")
    ).repartition("conv").sortWithinPartitions("conv", "at")
    schema = T.StructType([own.schema["conv_id"], *[T.StructField(k, T.LongType()) for k in counts], T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, None
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if done is None or row["conv"] != last:
                    if done is not None:
                        out.append(done)
                    last = row["conv"]
                    done = {"conv_id": row["conv_id"], **dict.fromkeys(counts, 0), "audit": [], "hash": hashlib.sha256(), "any": False}
                for c in counts:
                    done[c] += row[c]
                done["audit"].append(row["audit"])
                if row["lines"] is not None:
                    done["hash"].update((b"\n" if done["any"] else b"") + row["lines"].encode())
                    done["any"] = True
            if out:
                yield record(out)
        if done is not None:
            yield record([done])

    def record(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([
            {**{k: r[k] for k in ("conv_id", *counts)}, "audit": "".join(r["audit"]), "repaired_sha256": r["hash"].hexdigest()} for r in rows
        ], arrow)

    return own.mapInArrow(digest, schema)


def digest(fragments: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``conversations``: its numbers, audit and the hash of what ``repair`` made of it."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    whole = fragments.filter("whole").select("conv_id", *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    found = whole.unionByName(_digest_parts(fragments.filter("NOT whole")))
    every = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "every_id")
    joined = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
