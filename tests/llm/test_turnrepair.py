import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from gapline.llm import turnrepair as R

BLANKS = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(BLANKS)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plainly(rows):
    """The result for rows (turn, role, text) in order, by trying edits row by row and keeping the cheapest for each
    sequence of roles' last initial and length's parity; allowed ends are told by the expression itself."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    why = faults(rows)
    best = {"": (0, "", ())}

    def put(into, roles, edits):
        # two sequences that the expression goes on with alike are the same
        if re.fullmatch(r"s?(ua)*u?", roles):
            roles = roles[-1:] if roles in ("", "s") else "s"[: roles[0] == "s"] + ("u" if roles[-1] == "u" else "ua")
            into[roles] = min(into.get(roles, edits), edits)

    def inserted(now):
        for _ in range(3):
            for roles, (cost, audit, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    put(now, roles + role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return now

    for (_, role, text), fault in zip(rows, why):
        then = {}
        for roles, (cost, audit, lines) in inserted(best).items():
            put(then, roles, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                put(then, roles + (role[:1] or "?"), (more, audit + "K", (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    put(then, roles + other[0], (more + 2, audit + "R", (*lines, f"{other}:{text}")))
        best = then
    cost, audit, lines = min(v for k, v in inserted(best).items() if re.fullmatch(r"(s?(ua)+)?", k))
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, why.count("blank"), why.count("duplicate"), why.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def all_edits(rows):
    """(cost, audit) of the cheapest edits of a few rows, by every sequence of edits there is."""
    why, found = faults(rows), []

    def go(i, roles, cost, audit, inserts):
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < 2:
            for role in "ua":
                go(i, roles + role, cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if why[i] in ("", "truncated"):
                more = cost + (why[i] == "truncated")
                go(i + 1, roles + rows[i][1][:1] if rows[i][1] else roles + "?", more, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, more + 2, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def drawn(n, seed, roles=("system", "user", "assistant", "tool", ""), texts=("A.", "b", "", " ", "c?", "d! \n", "e")):
    draw = random.Random(seed)
    return [(i, draw.choice(roles), draw.choice(texts)) for i in range(n)]


def test_cheapest_of_all_edits():
    for seed in range(60):
        rows = drawn(seed % 5, seed)
        got = R.repaired_whole([(*r, 1) for r in rows]) if rows else {"cost": 0, "audit": ""}
        assert (got["cost"], got["audit"]) == all_edits(rows)


def test_product_is_associative():
    draw = random.Random(5)
    for _ in range(50):
        a, b, c = (R.TURNS[draw.choice(list(R.TURNS))] for _ in range(3))
        for _ in range(draw.randrange(4)):
            a, b = R.times(a, c), R.times(c, b)
        assert R.times(R.times(a, b), c) == R.times(a, R.times(b, c))
    assert R.times(R.INSERTS, R.INSERTS) == R.INSERTS


CASES = {
    1: [(0, "system", "S."), (1, "user", "Hi."), (2, "assistant", "Yes.")],
    2: [(None, None, None), (None, "user", "x."), (3, "user", "x."), (3, "user", "x."), (7, "assistant", "cut off")],
    3: [(0, "system", "Only."), (0, "system", "Only.")],
    4: [(0, "assistant", "A."), (1, "assistant", "B."), (2, "system", "C.")],
    5: [(4, "user", "")],
    6: [(0, "user", "long " * 60_000 + "."), (1, "assistant", "😀é.")],
    None: [(0, "user", "of no id."), (2, "user", "b.")],
}


def rows_of(cases):
    return [(c, *r) for c, rows in cases.items() for r in rows]


def found(frame, **how):
    return {r[0]: tuple(r)[1:] for r in R.repair(frame, **how).collect()}


def test_against_brute_force(spark):
    cases = CASES | {100 + i: drawn(1 + i % 13, i) for i in range(150)}
    want = {c: plainly(rows) for c, rows in cases.items()}
    frame = spark.createDataFrame(rows_of(cases), KIND)
    assert found(frame) == want
    # parts of few rows: the matrices and segments of every conversation
    assert found(frame.repartition(3), part_rows=2) == want


def test_a_very_long_conversation(spark):
    """It is a third of all rows, and its matrices are multiplied level by level over tasks."""
    long = drawn(1500, 9, texts=("A.", "b", "", "c?", *(f"t{i}." for i in range(400))))
    cases = {7: long, 8: [(0, "user", "same.")] * 400} | {100 + i: drawn(6, i) for i in range(200)}
    frame = spark.createDataFrame(rows_of(cases), KIND).repartition(5)
    assert found(frame, part_rows=3) == {c: plainly(rows) for c, rows in cases.items()}


def test_damage(spark):
    rows = [(i, t, "assistant", f"T{t}. Yes! ok?") for i in range(40) for t in range(6)] + [(None, 1, None, None), (2, None, "user", "x")]
    got = sorted(map(str, map(tuple, R.damage(spark.createDataFrame(rows, KIND)).collect())))
    want = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(map(str, want))


def test_conversations_without_rows_and_empty_table(spark):
    some = spark.createDataFrame([(1, 0, "user", "a."), (None, 0, "user", "b.")], KIND)
    none = spark.createDataFrame([], KIND)
    assert R.repair(none).count() == 0
    got = {r[0]: tuple(r)[1:] for r in R.with_all(R.repair(some.filter("conv_id = 1")), some.withColumn("audit", F.lit(1))).collect()}
    assert got == {1: plainly([(0, "user", "a.")]), None: (0, 0, 0, 0, 0, 0, "", R.EMPTY_SHA)}
    assert R.with_all(R.repair(none), none).count() == 0
