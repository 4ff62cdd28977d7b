"""Conversation structure repair: the cheapest edits that make the turns alternate, by Hirschberg's division.

The roles of a good conversation read ``(s?(ua)+)?`` by their initials: an
optional system turn, then user and assistant in turn.  Four states say how far
a conversation has come: nothing yet, after s, after u, after a; it may end in
the first and the last.  Every row is kept (0), re-roled to user or assistant
(1) or deleted (2; blank rows and repeated ones must be), user or assistant
turns without text may be inserted anywhere (5 each), and a truncated row that
stays adds 5.  Of the cheapest lists of edits, the one whose initials (K, R, D,
I) come first in ASCII order is taken.

For the search a row is one of twelve kinds (initial s, u, a or other; sound,
truncated or to be deleted), and each kind is a step: the cost from any state
to any other, with the inserts before the row as part of it.  So no list of
edits up to a row begins another one, and it is enough to know their order:
the forward vector holds a cost and a rank for each state, the backward vector
costs.  They meet in the middle; among the crossings of least total cost the
one of least forward rank is taken, and both halves are solved alike between
the states found.  Nothing but two vectors is kept on the way.

At scale: rows are sorted by conversation and turn over ranges, so a
conversation of any length spreads over as many tasks as it needs.  A task cuts
its rows into blocks of at most ``BLOCK_ROWS`` rows of one conversation, each
with its own step (costs and ranks between all states).  The upper part of the
division runs over the steps of the blocks of a conversation, some hundred bytes
each; the lower part runs inside every block between the states found.  A text
is read as it streams by, in blocks of at most ``BLOCK_CHARS`` (or one row).
A digest over a conversation is one value, so its blocks stream through one task
in order, one at a time.

Rows are taken in order of turn (nulls first), role and text.  Nulls and odd
rows: null roles and texts are one space; a null conv_id is a conversation of
its own; a null turn comes before all others and counts in no gap; repeated
rows are duplicates; conversations of blank rows end up empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.session import materialize

BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
WHITE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
NEVER = 1 << 60
#: fixed values: what the edits cost
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SOUND, TRUNCATED, GONE = range(3)
_NEXT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}


def _spoken(state: int) -> tuple[str, int]:
    """The role that may follow a state, of user and assistant, and the state after it."""
    return ("assistant", AFTER_A) if state == AFTER_U else ("user", AFTER_U)


class Step:
    """Costs between states and, for each state before, the order of the lists of edits to the states after."""

    def __init__(self, cost: Sequence[Sequence[int]], order: Sequence[Sequence[int]]):
        self.cost, self.order = cost, order


def _step_of(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple[Step, dict]:
    cost = [[ways.get((s, t), (NEVER, ""))[0] for t in STATES] for s in STATES]
    order = []
    for s in STATES:
        told = sorted(ways[s, t][1] for t in STATES if (s, t) in ways)
        order.append([told.index(ways[s, t][1]) if (s, t) in ways else 4 for t in STATES])
    return Step(cost, order), {k: edits for k, (_, edits) in ways.items()}


def _row_step(initial: str, fault: int) -> tuple[Step, dict]:
    """The step of a row: the best inserts and edit between any two states."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}
    for s in STATES:
        at = s
        for inserts in range(3):           # a third insert leads back to where the first one led
            stays = CUT if fault == TRUNCATED else 0
            edits = [("D", DELETE, at)]
            if fault != GONE:
                edits.append(("R", REROLE + stays, _spoken(at)[1]))
                if (initial, at) in _NEXT:
                    edits.append(("K", stays, _NEXT[initial, at]))
            for name, cost, t in edits:
                way = (cost + INSERT * inserts, "I" * inserts + name)
                ways[s, t] = min(ways.get((s, t), way), way)
            at = _spoken(at)[1]
    return _step_of(ways)


INITIALS = ("s", "u", "a", "")
KINDS = [_row_step(i, fault) for i in INITIALS for fault in (SOUND, TRUNCATED, GONE)]
#: after the last row: inserts to a state where a conversation may end, called START
END, END_EDITS = _step_of({(START, START): (0, ""), (AFTER_S, START): (2 * INSERT, "II"), (AFTER_U, START): (INSERT, "I"),
                           (AFTER_A, START): (0, "")})


def kind(initial: str, fault: int) -> int:
    return 3 * (INITIALS.index(initial) if initial in ("s", "u", "a") else 3) + fault


def forward(steps: Sequence[Step], start: int) -> list[tuple[int, int]]:
    """(cost, rank) of the best way from ``start`` through all steps to each state; ranks order the ways' edits."""
    now = [(0, 0) if s == start else (NEVER, 4) for s in STATES]
    for step in steps:
        found = []
        for t in STATES:
            cost, rank, s = min((now[s][0] + step.cost[s][t], now[s][1], s) for s in STATES)
            found.append((cost, rank, step.order[s][t]) if cost < NEVER else (NEVER, 4, 4))
        ranks = sorted({x[1:] for x in found})
        now = [(x[0], ranks.index(x[1:])) if x[0] < NEVER else (NEVER, 4) for x in found]
    return now


def backward(steps: Sequence[Step], end: int) -> list[int]:
    """Cost of the best way through all steps from each state to ``end``."""
    now = [0 if s == end else NEVER for s in STATES]
    for step in reversed(steps):
        now = [min(NEVER, min(step.cost[s][t] + now[t] for t in STATES)) for s in STATES]
    return now


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The states between the steps of the best way from ``start`` to ``end``."""
    if len(steps) < 2:
        return []
    middle = len(steps) // 2
    left, right = forward(steps[:middle], start), backward(steps[middle:], end)
    state = min(STATES, key=lambda s: (left[s][0] + right[s], left[s][1]))
    return [*crossings(steps[:middle], start, state), state, *crossings(steps[middle:], state, end)]


def joined(steps: Sequence[Step]) -> Step:
    """All steps as one."""
    ways = [forward(steps, s) for s in STATES]
    return Step([[c for c, _ in w] for w in ways], [[r for _, r in w] for w in ways])


def _edits(kinds: bytes, start: int, end: int) -> list[tuple[str, int]]:
    """Edits of each row of a block and the state before them."""
    states = [start, *crossings([KINDS[k][0] for k in kinds], start, end), end]
    return [(KINDS[k][1][s, t], s) for k, s, t in zip(kinds, states, states[1:])]


_short_edits = functools.lru_cache(1 << 14)(_edits)
_short_joined = functools.lru_cache(1 << 14)(lambda kinds: joined([KINDS[k][0] for k in kinds]))


def edits(kinds: bytes, start: int, end: int) -> list[tuple[str, int]]:
    return (_short_edits if len(kinds) <= 32 else _edits)(kinds, start, end) if kinds else []


# ------------------------------------------------------------------ rows and blocks
def ordered(rows: DataFrame) -> DataFrame:
    """Rows that differ, with the number of times each is there and its faults, sorted over ranges."""
    text = F.coalesce("text", F.lit(" "))
    body = F.btrim(text, F.lit(WHITE))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("copy"),
                       (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    some = each.groupBy("conv_id", "turn", "role", "copy").agg(
        F.first("text").alias("text"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count(F.lit(1)).alias("times"))
    first = (some.groupBy("conv_id", "role", "copy").agg(F.min(F.struct("turn")).alias("at"))
             .select(F.col("conv_id").alias("_conv_id"), F.col("role").alias("_role"), F.col("copy").alias("_copy"), F.col("at.turn").alias("_turn"),
                     F.lit(True).alias("is_first")))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in ("conv_id", "role", "copy", "turn")]
    return (some.join(first, functools.reduce(lambda a, b: a & b, same), "left")
            .select("conv_id", "turn", "role", "text", "times", "blank", "cut", F.col("is_first").isNull().alias("seen"))
            .repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text"))


BLOCK = ("conv_id long, part int, number int, kinds binary, roles array<string>, texts array<string>, rows long, blank long, "
         "duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, "
         "cost array<long>, ranks array<long>")
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 10, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r["texts"])) if r.get("texts") else len(r.get("audit") or "")
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark_schema: str) -> pa.Schema:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, plain[t]) for n, t in (x.split() for x in spark_schema.split(", "))])


def _cut(rows: Iterator[dict], part: int) -> Iterator[dict]:
    """Blocks of consecutive rows of one conversation."""
    number = 0

    def new(conv_id):
        return {"conv_id": conv_id, "part": part, "kinds": bytearray(), "roles": [], "texts": [], "first": None, "last": None, "low": None,
                "high": None, "turns": 0, **dict.fromkeys(COUNTS, 0)}

    def closed(b):
        nonlocal number
        b["kinds"], b["number"] = bytes(b["kinds"]), number
        step = _short_joined(b["kinds"]) if len(b["kinds"]) <= 32 else joined([KINDS[k][0] for k in b["kinds"]])
        b["cost"], b["ranks"] = [c for w in step.cost for c in w], [r for w in step.order for r in w]
        number += 1
        return b

    for conv_id, mine in groupby(rows, key=lambda r: r["conv_id"]):
        b, size = new(conv_id), 0
        for r in mine:
            times, initial, first = r["times"], r["role"][:1], True
            while times:
                if len(b["kinds"]) >= BLOCK_ROWS or size >= BLOCK_CHARS:
                    yield closed(b)
                    b, size = new(conv_id), 0
                n = min(times, BLOCK_ROWS - len(b["kinds"]))
                fresh = first and not r["blank"] and not r["seen"]
                if fresh:
                    b["roles"].append(r["role"])
                    b["texts"].append(r["text"])
                    b["truncated"] += r["cut"]
                    b["kinds"].append(kind(initial, TRUNCATED if r["cut"] else SOUND))
                    size += len(r["text"])
                b["kinds"] += bytes([kind(initial, GONE)]) * (n - fresh)
                b["blank" if r["blank"] else "duplicate"] += n - fresh
                pairs = ([b["last"] + initial] if b["last"] is not None else []) + [initial * 2] * min(1, n - 1)
                b["illegal"] += sum(p not in ("su", "ua", "au") for p in pairs) + max(0, n - 2)
                b["first"], b["last"] = initial if b["first"] is None else b["first"], initial
                if r["turn"] is not None and r["turn"] != b["high"]:
                    b["low"] = r["turn"] if b["low"] is None else b["low"]
                    b["high"], b["turns"] = r["turn"], b["turns"] + 1
                b["rows"] += n
                times, first = times - n, False
        yield closed(b)


def cut(rows: DataFrame) -> DataFrame:
    """The blocks of all conversations (columns of ``BLOCK``), written as a table; part and number give their order."""
    schema = _arrow(BLOCK)

    def blocks(batches):
        from pyspark import TaskContext
        return _batches(_cut(_records(batches), TaskContext.get().partitionId()), schema)
    return materialize(ordered(rows).mapInArrow(blocks, BLOCK), "conversation-blocks")


def _by_conversation(blocks: DataFrame, *then: str) -> DataFrame:
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", *then)


def _meetings(blocks: Iterator[dict]) -> Iterator[dict]:
    for conv_id, mine in groupby(blocks, key=lambda b: b["conv_id"]):
        mine = list(mine)
        steps = [Step(*[[b[c][4 * s:4 * s + 4] for s in STATES] for c in ("cost", "ranks")]) for b in mine]
        states = [START, *crossings([*steps, END], START, START)]
        for b, s, t in zip(mine, states, states[1:]):
            yield {"conv_id": conv_id, "part": b["part"], "number": b["number"], "enter": s, "leave": t}


MEETING = "conv_id long, part int, number int, enter int, leave int"


def meetings(blocks: DataFrame) -> DataFrame:
    """The states in which the best edits of a conversation enter and leave each of its blocks."""
    schema = _arrow(MEETING)
    return (_by_conversation(blocks.select("conv_id", "part", "number", "cost", "ranks"))
            .mapInArrow(lambda batches: _batches(_meetings(_records(batches)), schema), MEETING))


def _with_states(blocks: DataFrame) -> DataFrame:
    """Each block just after its meeting, the blocks of a conversation in order in one task's stream."""
    both = meetings(blocks).withColumn("block", F.lit(0)).unionByName(
        blocks.drop("cost", "ranks").withColumn("block", F.lit(1)), allowMissingColumns=True)
    return _by_conversation(both, "block")


def _solved(records: Iterator[dict]) -> Iterator[tuple[dict, str, int, list[tuple[str, str, str]]]]:
    """Per block: (block, edits, cost, the messages that it leaves as (edit, role, text))."""
    for meeting, b in zip(records, records):
        audit, cost, out, left = [], 0, [], zip(b["roles"], b["texts"])
        for k, (told, s) in zip(b["kinds"], edits(b["kinds"], meeting["enter"], meeting["leave"])):
            role, text = next(left) if k % 3 != GONE else ("", "")
            cost += INSERT * (len(told) - 1) + {"D": DELETE, "R": REROLE, "K": 0}[told[-1]] + CUT * (k % 3 == TRUNCATED and told[-1] != "D")
            for edit in told:
                spoken, after = _spoken(s)
                if edit != "D":
                    out.append((edit, role if edit == "K" else spoken, "" if edit == "I" else text))
                s = after if edit in "IR" else s
            audit.append(told)
        yield b | {"leave": meeting["leave"]}, "".join(audit), cost, out


def _tail(state: int) -> tuple[str, int, list[tuple[str, str, str]]]:
    """What follows the last row: edits, cost, messages."""
    told, out = END_EDITS[state, START], []
    for edit in told:
        role, state = _spoken(state)
        out.append((edit, role, ""))
    return told, INSERT * len(told), out


MESSAGES = "conv_id long, part int, number int, edits array<string>, roles array<string>, texts array<string>"


def _repaired(records: Iterator[dict]) -> Iterator[dict]:
    for conv_id, mine in groupby(_solved(iter(records)), key=lambda x: x[0]["conv_id"]):
        b = None
        for b, _, _, out in mine:
            edit, role, text = zip(*out) if out else ((), (), ())
            yield {"conv_id": conv_id, "part": b["part"], "number": b["number"], "edits": edit, "roles": role, "texts": text}
        _, _, out = _tail(b["leave"])
        if out:
            edit, role, text = zip(*out)
            yield {"conv_id": conv_id, "part": b["part"], "number": b["number"] + 1, "edits": edit, "roles": role, "texts": text}


def repair(rows: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, at (their order: part, number, place), edit (K, R or I), role, text."""
    schema = _arrow(MESSAGES)
    out = _with_states(cut(rows)).mapInArrow(lambda batches: _batches(_repaired(_records(batches)), schema), MESSAGES)
    return (out.select("conv_id", "part", "number", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "m"))
            .select("conv_id", F.struct("part", "number", "place").alias("at"), F.col("m.edits").alias("edit"),
                    F.col("m.roles").alias("role"), F.col("m.texts").alias("text")))


AUDIT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "repaired_sha256 string")


def _audited(records: Iterator[dict]) -> Iterator[dict]:
    for conv_id, mine in groupby(_solved(iter(records)), key=lambda x: x[0]["conv_id"]):
        total, audit, cost, low, high, turns, last, b = dict.fromkeys(COUNTS, 0), [], 0, None, None, 0, None, None
        digest, parting = hashlib.sha256(), b""
        for b, told, paid, out in mine:
            for c in COUNTS:
                total[c] += b[c]
            total["illegal"] += last is not None and last + b["first"] not in ("su", "ua", "au")
            last = b["last"]
            if b["turns"]:
                turns += b["turns"] - (b["low"] == high)
                low, high = b["low"] if low is None else low, b["high"]
            audit.append(told)
            cost += paid
            for _, role, text in out:
                digest.update(parting + f"{role}:{text}".encode())
                parting = b"\n"
        told, paid, out = _tail(b["leave"])
        for _, role, text in out:
            digest.update(parting + f"{role}:{text}".encode())
            parting = b"\n"
        yield {"conv_id": conv_id, "gaps": high - low + 1 - turns if turns else 0, **{c: total[c] for c in COUNTS[1:]},
               "cost": cost + paid, "audit": "".join(audit) + told, "repaired_sha256": digest.hexdigest()}


def audit(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, the cost and initials of the edits, and a digest of the repaired conversation."""
    schema = _arrow(AUDIT)
    return _with_states(cut(rows)).mapInArrow(lambda batches: _batches(_audited(_records(batches)), schema), AUDIT)
