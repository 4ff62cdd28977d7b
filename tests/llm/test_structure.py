"""Conversation repair: brute force over all edits, blocks against wholes, odd rows."""

import hashlib
import random
import re
import zlib

from tablekeeper.llm import structure as S
from tablekeeper.llm.queries import QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def best_of_all(kinds):
    """The least (cost, edits) among all lists of edits with at most two inserts in a row, by trying them."""
    found = []

    def go(i, roles, told, cost, inserts):
        if found and cost > found[0][0]:
            return
        if i == len(kinds) and GOOD.fullmatch(roles):
            found.append((cost, told))
            found.sort()
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, told + "I", cost + 5, inserts + 1)
        if i < len(kinds):
            initial, fault = S.INITIALS[kinds[i] // 3] or "x", kinds[i] % 3
            go(i + 1, roles, told + "D", cost + 2, 0)
            if fault != S.GONE:
                more = 5 if fault == S.TRUNCATED else 0
                go(i + 1, roles + initial, told + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, roles + r, told + "R", cost + 1 + more, 0)
    found.append((2 * len(kinds), "D" * len(kinds)))
    go(0, "", "", 0, 0)
    return found[0]


def walked(kinds):
    """(cost, edits) of a whole conversation and of its blocks."""
    steps = [S.KINDS[k][0] for k in kinds]
    states = [S.START, *S.crossings([*steps, S.END], S.START, S.START)]
    told = "".join(S.KINDS[k][1][s, t] for k, s, t in zip(kinds, states, states[1:])) + S.END_EDITS[states[-1], S.START]
    return S.forward([*steps, S.END], S.START)[S.START][0], told


def test_against_all_edits():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 4, 4, 5] * 12:
        kinds = bytes(rng.choices(range(12), weights=[1, 1, 1, 4, 2, 2, 4, 2, 2, 1, 1, 1], k=n))
        assert walked(kinds) == best_of_all(kinds), list(kinds)


def forward_by_text(kinds):
    """Plain table over rows with whole lists of edits, without division or ranks."""
    now = {0: (0, "")}
    for k in kinds:
        new = {}
        for s, (c, told) in now.items():
            at, paid, extra = s, c, ""
            for _ in range(3):
                initial, fault = S.INITIALS[k // 3], k % 3
                more = 5 if fault == 1 else 0
                ways = [("D", 2, at)]
                if fault < 2:
                    ways.append(("R", 1 + more, 3 if at == 2 else 2))
                    if (initial, at) in {("s", 0): 1, ("u", 0): 1, ("u", 1): 1, ("u", 3): 1, ("a", 2): 1}:
                        ways.append(("K", more, {"s": 1, "u": 2, "a": 3}[initial]))
                for e, cost, t in ways:
                    new[t] = min(new.get(t, (1 << 60, "")), (paid + cost, told + extra + e))
                at, paid, extra = 3 if at == 2 else 2, paid + 5, extra + "I"
        now = new
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    return min((c + 5 * len(ends[s]), told + ends[s]) for s, (c, told) in now.items())


def test_long_ones_and_blocks():
    rng = random.Random(4)
    for n in (30, 200, 1500):
        kinds = bytes(rng.choices(range(12), k=n))
        want = forward_by_text(kinds)
        assert walked(kinds) == want
        cuts = sorted(rng.sample(range(1, n), 5))
        blocks = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        steps = [S.joined([S.KINDS[k][0] for k in b]) for b in blocks]
        states = [S.START, *S.crossings([*steps, S.END], S.START, S.START)]
        told = "".join(e for b, s, t in zip(blocks, states, states[1:]) for e, _ in S.edits(b, s, t))
        assert told + S.END_EDITS[states[-1], S.START] == want[1]


def brute_audit(rows):
    """The contract's row of one conversation from its damaged rows (turn, role, text)."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    seen, kinds, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.strip(S.WHITE)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        if fault is not None:
            n[fault] += 1
        seen.add((role, text))
        kinds.append(S.kind(role[:1], S.SOUND if fault is None else S.TRUNCATED if fault == 2 else S.GONE))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, told = forward_by_text(kinds)
    out, left = [], iter(rows)
    for e in told:
        last = out[-1][:1] if out else ""
        spoken = "assistant" if last == "u" else "user"
        if e == "I":
            out.append(f"{spoken}:")
            continue
        _, role, text = next(left)
        if e != "D":
            out.append(f"{role if e == 'K' else spoken}:{text}")
    return gaps, *n, illegal, cost, told, hashlib.sha256("\n".join(out).encode()).hexdigest()


def hurt(rows):
    """Damage of (conv_id, turn, role, text) rows by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            mine += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def odd_rows():
    rng = random.Random(9)
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.choice([0, 1, 2, 4, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "ok", " \n", "", None, "same.", f"é 漢 {turn}?", "end. \t", "a:b\nc."])))
    rows += [rows[3], rows[3], (-1, 5, "user", "x" * 100_000 + "."), (-1, 2, "ass", "b."), (-2, None, "u", "x."), (-3, 9, "user", "x."), (-3, 2, "assistant", "x.")]
    return rows


def audited(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_query_against_brute_force(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", kinds int, number string").repartition(7)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_structure_repair"](spark, str(tmp_path))
    assert got.count() == len({r[0] for r in rows})
    assert audited(got) == {conv: brute_audit(mine) for conv, mine in hurt(rows).items()}


def test_one_long_conversation(spark):
    """Far more rows than a block holds, a third of them one row, split over many tasks."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"line {t}.", f"cut {t}", "same."])) for t in range(9000)]
    rows += [(1, 4000, "user", "again and again.")] * 4500 + [(2, 0, "user", "hi."), (2, 1, "assistant", "hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert S.cut(df).where("conv_id = 1").count() > 3
    got = audited(S.audit(df))
    assert got[1] == brute_audit([r[1:] for r in rows if r[0] == 1]) and got[2][5:7] == (0, "KK")


def test_repaired_messages(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    told = audited(S.audit(df))
    mine = {}
    for r in S.repair(df).orderBy("conv_id", "at").collect():
        mine.setdefault(r["conv_id"], []).append(r)
    for conv, x in told.items():
        out = mine.get(conv, [])
        assert GOOD.fullmatch("".join(r["role"][0] for r in out))
        assert [r["edit"] for r in out] == [e for e in x[6] if e != "D"]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in out).encode()).hexdigest() == x[7]


def test_empty_table(spark, tmp_path):
    nothing = spark.createDataFrame([], SCHEMA)
    assert S.repair(nothing).count() == 0 and S.audit(damaged(nothing)).count() == 0
    nothing.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversation_structure_repair"](spark, str(tmp_path)).count() == 0
