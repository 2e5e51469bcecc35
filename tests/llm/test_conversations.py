"""Repair of conversations against an enumeration of all edits, and against a plain fold over a conversation's rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from tempestry.llm import conversations as c

SPACE = " \t\n\x0b\f\r"
COLUMNS = ["conv_id", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit", "repaired_sha256"]


def one(x):
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = one(role), one(text)
        fault = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def applied(rows, audit):
    """The outputs of an audit, or None where it doesn't fit."""
    out, last, at = [], "", 0
    for edit in audit:
        wanted = "a" if last == "u" else "u"
        if edit == "I":
            out.append(c.ROLES[wanted] + ":")
            last = wanted
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else wanted
        if initial not in c.MOVES or (initial == "s" and last) or (initial == "u" and last == "u") or (initial == "a" and last != "u"):
            return None
        out.append(f"{role if edit == 'K' else c.ROLES[wanted]}:{text}")
        last = initial
    return out if at == len(rows) and last in ("", "a") else None


def price(audit, kinds):
    cost, at = 0, 0
    for edit in audit:
        if edit == "I":
            cost += 5
            continue
        if edit != "D" and kinds[at] in ("blank", "duplicate"):
            return None
        cost += {"K": 0, "R": 1, "D": 2}[edit] + (5 if edit != "D" and kinds[at] == "truncated" else 0)
        at += 1
    return cost


def enumerated(rows, kinds):
    """All audits of up to two inserts."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        for where in product(range(len(rows) + 1), repeat=2):
            for n in range(3):
                audit = list(edits)
                for w in sorted(where[:n], reverse=True):
                    audit.insert(w, "I")
                cost = price(audit, kinds)
                if cost is not None and applied(rows, audit) is not None:
                    best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
    return best


def folded(rows, kinds):
    """State by state, with all audits of the least cost of each: inserts are tried before each row and at the end."""
    ways = {"": (0, "")}
    roles = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}

    def put(new, state, way):
        new[state] = min(new.get(state, way), way)

    def inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                put(out, "a" if state == "u" else "u", (cost + 5, audit + "I"))
        return out

    for (_, role, _), kind in zip(rows, kinds, strict=True):
        new = {}
        for state, (cost, audit) in inserts(ways).items():
            put(new, state, (cost + 2, audit + "D"))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            if state in roles.get(role[:1], ()):
                put(new, role[:1], (cost + more, audit + "K"))
            put(new, "a" if state == "u" else "u", (cost + more + 1, audit + "R"))
        ways = new
    return min(w for s, w in inserts(ways).items() if s in ("", "a"))


def sorted_turns(spark, rows):
    """Rows with the hash that orders ties."""
    df = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "i int, text string")
    h = {r.i: r.h for r in df.select("i", F.xxhash64("text").alias("h")).collect()}
    key = lambda ir: (ir[1][1] is not None, ir[1][1] or 0, ir[1][2].encode(), h[ir[0]])
    return [r for _, r in sorted(enumerate(rows), key=key)]


def brute(spark, original):
    out, rows = [], sorted_turns(spark, damaged(original))
    for conv in {r[0] for r in original}:
        mine = [r[1:] for r in rows if r[0] == conv]
        kinds = faults(mine)
        cost, audit = folded(mine, kinds)
        turns = {r[0] for r in mine} - {None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:], strict=False))
        text = "\n".join(applied(mine, audit))
        out.append((conv, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, max(turns) - min(turns) + 1 - len(turns) if turns else 0, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "open", " ", "", None, "\tÉté. \n", f"t{conv}.{turn}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 2, -turn, 3, None]), role, text))
    rows += rng.choices(rows, k=30) + [(900, t, ["user", "assistant"][t % 2], f"x{t}.") for t in range(700)] + [(901, 1, "assistant", "same.")] * 300
    return rows + [(902, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", "d."])) for t in range(500)] + [(903, 1, "user", "long " * 200_000 + ".")]


def frame(spark, rows):
    extra = {x: F.lit(5) for x in ("place", "run", "letter", "h", "kind", "audit", "k", "cost", "copy", "fault")}
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def expected(spark):
    return brute(spark, corpus())


@pytest.mark.parametrize(("run_bits", "fan"), [(c.RUN_BITS, c.FAN), (3, 2), (0, 3)])
def test_equals_plain_fold(spark, expected, run_bits, fan):
    """Whole runs, and conversations that are cut into runs of eight rows and of one."""
    turns = frame(spark, corpus())
    rows = c.damage(turns)
    found = c.digest(rows, c.plans(rows, turns.select("conv_id"), run_bits, fan))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected


def test_sql_is_the_same(spark):
    """Rows of distinct conversation and turn, as ties go by text there and by its hash here."""
    rows = [r for r in {(r[0], r[1]): r for r in corpus() if r[0] not in (900, 902, 903)}.values()]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cur = con.execute(c.oracle_sql())
    assert [d[0] for d in cur.description] == COLUMNS
    assert sorted(cur.fetchall(), key=str) == brute(spark, rows)


def test_fold_and_matrices_equal_enumeration():
    rng = random.Random(2)
    letter = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    for _ in range(150):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["p.", "q", "r.", "", "t?"])) for t in range(rng.randint(0, 4))]
        kinds = faults(rows)
        best = enumerated(rows, kinds)
        letters = "".join(c.LETTERS[letter[k]]["suax".index(r[1][0] if r[1][0] in "sua" else "x")] for r, k in zip(rows, kinds, strict=True))
        assert folded(rows, kinds) == best == c.cheapest(c.run_matrix(letters))


def test_product_is_associative():
    rng = random.Random(5)
    for _ in range(300):
        x, y, z = (c.tree([c.letter_matrix(rng.choice("suaxSUAX1234")) for _ in range(rng.randint(1, 6))]) for _ in range(3))
        assert c.times(c.times(x, y), z) == c.times(x, c.times(y, z))
        assert c.times(c.IDENTITY, x) == x == c.times(x, c.IDENTITY)


def test_repaired_rows(spark):
    rows = frame(spark, [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go"), (1, 2, "assistant", "Done."), (2, 0, "system", "Be kind."), (2, 5, "user", "Well?"), (2, 5, "user", "Well?"), (3, 1, "tool", "")])
    planned = c.plans(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in planned.collect()} == {1: (3, "RDK"), 2: (4, "RRD"), 3: (2, "D")}
    got = [tuple(r) for r in c.repaired(rows, planned).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "R", 0, "user", "Hi."), (1, 1, "K", 2, "assistant", "Done."), (2, 0, "R", 0, "user", "Be kind."), (2, 1, "R", 5, "assistant", "Well?")]


def test_runs_of_one_role(spark):
    long = [("system", "Rules."), ("user", "Q1?"), ("user", "Q2?"), ("user", "Q3?")]
    pair = [("user", "A."), ("assistant", "B."), ("user", "C."), ("assistant", "D."), ("assistant", "E."), ("user", "F."), ("assistant", "G.")]
    rows = frame(spark, [(1, i, *x) for i, x in enumerate(long)] + [(2, i, *x) for i, x in enumerate(pair)])
    planned = c.plans(rows)
    for r in planned.collect():
        assert (r.cost, r.audit) == folded([(0, *x) for x in (long if r.conv_id == 1 else pair)], [""] * (4 if r.conv_id == 1 else 7))


def test_rules_by_hand(spark):
    """Worked out on paper: a lone answer is deleted (2), not given a question (5)."""
    rows = frame(spark, [(1, 3, "assistant", "Hi."), (2, 1, "user", "A?"), (2, 9, "assistant", "B"), (3, None, "user", "Q?"), (3, None, "assistant", "A.")])
    got = {r.conv_id: r for r in c.plans(rows).collect()}
    assert (got[1].cost, got[1].audit, got[1].gaps, got[1].illegal) == (2, "D", 0, 0)
    assert (got[2].cost, got[2].audit, got[2].gaps, got[2].truncated) == (4, "DD", 7, 1)
    assert (got[3].blank, got[3].gaps) == (0, 0)


def test_empty_table(spark):
    rows = frame(spark, corpus()).limit(0)
    assert c.digest(rows, c.plans(rows)).count() == 0
    assert c.repaired(rows, c.plans(rows)).count() == 0
