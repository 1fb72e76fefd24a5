"""Conversation structure repair: a min-plus matrix scan over the turns of each conversation.

After repair the role initials of a conversation's rows are ``(s?(ua)+)?``. Four states read them: nothing yet, after
the system row, after a user row, after an assistant row. A row is a 4x4 matrix over (cost, audit): kept it costs 0,
with another role 2, deleted 3 (all that may be done with blank and repeated rows), and a truncated row that stays 1
more; inserted rows (2 each) are the closure of a matrix of their own. Addition takes the lesser cost, then the
ASCII-least audit; multiplication adds costs and joins audits. From a state an audit says which states it passes, so of two
audits of the same cost between the same states none begins with the other, and choice and joining may be swapped: the
product is associative, and cheapest edits of a conversation are those of its parts.

*Parts.* Rows are dealt by range of conversation, turn, role and text, sorted, and cut into parts of at most ``PART_ROWS``
rows and ``PART_BYTES`` of text. A conversation that lies whole in one is repaired there. Of one that reaches over a cut
or a task's border each part becomes a matrix; ``FAN_IN`` neighbours are multiplied at a time, level by level, until one
is left. Its audit is cut into the parts' segments, each part is rewritten by its own, and the rewritten parts go in
order through SHA-256. Identical rows travel as one row with a count. Which rows are seen earlier is worked out from a
hash of role and text for each part, not each row.

What grows with a conversation in one task: its audit, which is a value of its result (up to 16 of them while matrices
are multiplied), the numbers of its parts, and its bytes as they stream through SHA-256.

Defined cases: a null role or text is one space; null turns come first; rows of one turn follow each other by role and
text; null ids are one conversation; roles that begin with none of s, u, a have to go or get another role; empty and
very long texts and conversations are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.common import encode, materialize

BLANKS = "\x20\t\n\x0b\x0c\r"
PART_ROWS, PART_BYTES, FAN_IN = 2048, 32 << 10, 16
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER, BEFORE_ASSISTANT = (START, SYSTEM, ASSISTANT), (USER,)
COUNTS = ("blank", "duplicate", "truncated", "illegal")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

Element = tuple[int, str] | None
Matrix = list[list[Element]]


# --- the semiring ---------------------------------------------------------------------------------------------


def times(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; `left` may have fewer rows than four."""
    out = []
    for row in left:
        made = []
        for j in range(4):
            cost = min((row[k][0] + right[k][j][0] for k in range(4) if row[k] and right[k][j]), default=None)
            best = None
            if cost is not None:
                best = cost, min(row[k][1] + right[k][j][1] for k in range(4) if row[k] and right[k][j] and row[k][0] + right[k][j][0] == cost)
            made.append(best)
        out.append(made)
    return out


def edges(*given: tuple[int, int, int, str]) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i, j, cost, audit in given:
        out[i][j] = min(out[i][j] or (cost, audit), (cost, audit))
    return out


def closure(matrix: Matrix) -> Matrix:
    """Any number of steps: squares of (one or none) until nothing changes."""
    now = [[min((0, ""), matrix[i][j]) if i == j and matrix[i][j] else (0, "") if i == j else matrix[i][j] for j in range(4)] for i in range(4)]
    while (then := times(now, now)) != now:
        now = then
    return now


def by_role(cost: int, audit: str, initial: str) -> list[tuple[int, int, int, str]]:
    steps = {"s": [(START, SYSTEM)], "u": [(i, USER) for i in BEFORE_USER], "a": [(i, ASSISTANT) for i in BEFORE_ASSISTANT]}
    return [(i, j, cost, audit) for i, j in steps.get(initial, [])]


INSERTS = closure(edges(*by_role(2, "I", "u"), *by_role(2, "I", "a")))


def turn_matrix(initial: str, truncated: bool, delete: bool) -> Matrix:
    """A row's edits and then any insertions."""
    known = [(i, i, 3, "D") for i in range(4)]
    if not delete:
        known += by_role(int(truncated), "K", initial) + by_role(2 + truncated, "R", "u") + by_role(2 + truncated, "R", "a")
    return times(edges(*known), INSERTS)


TURNS = {(c, t, d): turn_matrix(c, t, d) for c in ("s", "u", "a", "") for t in (False, True) for d in (False, True)}


def power(matrix: Matrix, n: int) -> Matrix:
    out = closure(edges())
    while n:
        out = times(out, matrix) if n & 1 else out
        matrix, n = times(matrix, matrix) if n > 1 else matrix, n >> 1
    return out


def cheapest(row: list[Element]) -> tuple[int, str]:
    """Of what leads from the start to an allowed end."""
    return min(e for e in (row[START], row[ASSISTANT]) if e)


# --- rows -----------------------------------------------------------------------------------------------------


def fault(role: str, text: str, seen: bool) -> str:
    rest = text.rstrip(BLANKS)
    return "blank" if not rest else "duplicate" if seen else "" if rest[-1] in ".!?" else "truncated"


def part_of(rows: list[tuple], seen, whole: bool) -> dict:
    """Matrix (the start's row of it, for a whole conversation), counts and borders of rows (turn, role, text, copies);
    seen(i): whether the i-th row's role and text stand in an earlier one."""
    matrix = INSERTS[:1] if whole else INSERTS
    found = dict.fromkeys(COUNTS, 0)
    before, n = None, 0
    for i, (_, role, text, copies) in enumerate(rows):
        why = fault(role, text, seen(i))
        initial = role[:1]
        kind = initial if initial in ("s", "u", "a") else ""
        matrix = times(matrix, TURNS[kind, why == "truncated", why in ("blank", "duplicate")])
        if why:
            found[why] += 1
        if before is not None:
            found["illegal"] += before + initial not in ("su", "ua", "au")
        if copies > 1:  # the others are repeats
            again = "blank" if why == "blank" else "duplicate"
            found[again] += copies - 1
            found["illegal"] += copies - 1  # no initial may follow itself
            matrix = times(matrix, power(TURNS["", False, True], copies - 1))
        before, n = initial, n + copies
    turns = [t for t, *_ in rows if t is not None]
    return found | {
        "matrix": matrix, "n": n, "first_role": rows[0][1][:1], "last_role": before, "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring parts as one."""
    out = {c: a[c] + b[c] for c in (*COUNTS, "n", "turns")}
    out["illegal"] += a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return out | {"first_role": a["first_role"], "last_role": b["last_role"], "matrix": times(a["matrix"], b["matrix"])}


def gaps(part: dict) -> int:
    return 0 if part["first_turn"] is None else part["last_turn"] - part["first_turn"] + 1 - part["turns"]


def begins_with_system(audit: str) -> bool:
    """The rows that come out are in pairs, but for a system row."""
    return (len(audit) - audit.count("D")) % 2 == 1


def rewritten(rows: list[tuple], audit: str, out: int, system: bool) -> list[str]:
    """`role:text` of the rows under their edits; `out`: how many rows of the conversation came out before."""
    lines, at = [], iter((role, text) for _, role, text, copies in rows for _ in range(copies))
    for edit in audit:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if (out - system) % 2 == 0 else "assistant"
        lines.append(f"{role}:{text}")
        out += 1
    return lines


# --- tasks ----------------------------------------------------------------------------------------------------


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


RESULT = [("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
ROWS = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]
PLACE = [("task", pa.int32()), ("seq", pa.int64())]
RESULT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS_SQL = "turns array<long>, roles array<string>, texts array<string>, copies array<long>"
MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
PART = [
    ("at", pa.int64()), ("matrix", MATRIX), *((c, pa.int64()) for c in (*COUNTS, "n", "turns")), ("first_role", pa.string()), ("last_role", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("sizes", pa.list_(pa.int64())),
]
PART_SQL = f"at long, matrix array<struct<cost:long,audit:string>>, {', '.join(f'{c} long' for c in (*COUNTS, 'n', 'turns'))}, first_role string, last_role string, first_turn long, last_turn long, sizes array<long>"


def flat(matrix: Matrix) -> list:
    return [e and {"cost": e[0], "audit": e[1]} for row in matrix for e in row]


def square(cells: list) -> Matrix:
    found = [c and (c["cost"], c["audit"]) for c in cells]
    return [found[i : i + 4] for i in range(0, len(found), 4)]


def repaired_whole(rows: list[tuple]) -> dict:
    """The result of a conversation that is whole."""
    known, seen = set(), []
    for _, role, text, _ in rows:
        seen.append((role, text) in known)
        known.add((role, text))
    part = part_of(rows, seen.__getitem__, True)
    cost, audit = cheapest(part["matrix"][0])
    lines = rewritten(rows, audit, 0, begins_with_system(audit))
    return {c: part[c] for c in COUNTS} | {"gaps": gaps(part), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(encode("\n".join(lines))).hexdigest()}


def cut(part_rows: int, part_bytes: int):
    """Sorted rows to whole conversations' results and to parts of the others: `done` says which."""

    def run(batches):
        task, seq, schema = TaskContext.get().partitionId(), 0, None

        def out(conv, rows, whole):
            nonlocal seq
            seq += 1
            place = {"conv": conv, "task": task, "seq": seq, "done": whole}
            if whole:
                return place | repaired_whole(rows)
            return place | dict(zip(("turns", "roles", "texts", "copies"), map(list, zip(*rows))))

        def parts():
            nonlocal schema
            conv, rows, size, whole, begun = None, [], 0, False, False
            for batch in batches:
                schema = schema or pa.schema([("conv", batch.schema.field("conv_id").type), *PLACE, ("done", pa.bool_()), *RESULT, *ROWS])
                for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                    if not begun or row[0] != conv:
                        if rows:
                            yield out(conv, rows, whole)
                        # what stands first in a task may have begun in the one before
                        conv, rows, size, whole, begun = row[0], [], 0, begun, True
                    elif len(rows) >= part_rows or size > part_bytes:
                        yield out(conv, rows, False)
                        rows, size, whole = [], 0, False
                    rows.append(row[1:])
                    size += len(row[3])
            if rows:  # may go on in the next task
                yield out(conv, rows, False)

        found = parts()
        for first in found:
            yield from batches_of((r for part in ([first], found) for r in part), schema)

    return run


def to_matrices(batches):
    """Parts with the hashes that earlier parts of their conversation hold to matrices."""
    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), *PART])

        def rows():
            for r in batch.to_pylist():
                known, seen = set(r["earlier"] or []), []
                for h in r["hashes"]:
                    seen.append(h in known)
                    known.add(h)
                part = part_of(list(zip(r["turns"], r["roles"], r["texts"], r["copies"])), seen.__getitem__, False)
                yield part | {"conv": r["conv"], "at": r["at"], "matrix": flat(part["matrix"]), "sizes": [part["n"]]}

        yield from batches_of(rows(), schema)


def multiply(table: pa.Table) -> pa.Table:
    """Neighbouring parts of a conversation to one, from left to right."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    first = rows[0]
    total, sizes = first | {"matrix": square(first["matrix"])}, list(first["sizes"])
    if first["at"] == 0:
        total["matrix"] = total["matrix"][:1]  # nothing stands before: it is left from the start only
    for r in rows[1:]:
        total = joined(total, r | {"matrix": square(r["matrix"])})
        sizes += r["sizes"]
    out = total | {"conv": first["conv"], "at": first["at"] // FAN_IN, "matrix": flat(total["matrix"]), "sizes": sizes}
    return pa.Table.from_pylist([out], pa.schema([("conv", table.schema.field("conv").type), *PART]))


def to_segments(batches):
    """A conversation's product to its result and a segment of the audit for each part."""
    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("at", pa.int64()), *((c, pa.int64()) for c in ("gaps", *COUNTS, "cost")), ("audit", pa.string()), ("segment", pa.string()), ("out", pa.int64()), ("system", pa.bool_())])

        def rows():
            for r in batch.to_pylist():
                cost, audit = cheapest(square(r["matrix"])[0])
                edits = np.frombuffer(audit.encode(), np.uint8)
                taken = np.flatnonzero(edits != ord("I")) + 1  # a part's segment ends with its last row's edit
                came_out = np.concatenate([[0], np.cumsum(edits != ord("D"))])
                ends = [int(taken[k - 1]) for k in np.cumsum(r["sizes"])]
                ends[-1] = len(audit)
                system = begins_with_system(audit)
                head = {c: r[c] for c in COUNTS} | {"gaps": gaps(r), "cost": cost, "audit": audit}
                for at, (begin, end) in enumerate(zip([0, *ends], ends)):
                    yield (head if at == 0 else {}) | {"conv": r["conv"], "at": at, "segment": audit[begin:end], "out": int(came_out[begin]), "system": system}

        yield from batches_of(rows(), schema)


def rewrite(batches):
    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("at", pa.int64()), ("body", pa.binary())])

        def rows():
            for r in batch.to_pylist():
                lines = rewritten(list(zip(r["turns"], r["roles"], r["texts"], r["copies"])), r["segment"], r["out"], r["system"])
                yield {"conv": r["conv"], "at": r["at"], "body": encode("\n".join(lines)) if lines else None}

        yield from batches_of(rows(), schema)


def digest(batches):
    """Rewritten parts, sorted, through SHA-256: one conversation after the other, one part in hand."""
    schema = None

    def rows():
        nonlocal schema
        conv, sha, lines, begun = None, None, 0, False
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("repaired_sha256", pa.string())])
            for here, body in zip(batch.column("conv").to_pylist(), batch.column("body").to_pylist()):
                if not begun or here != conv:
                    if begun:
                        yield {"conv": conv, "repaired_sha256": sha.hexdigest()}
                    conv, sha, lines, begun = here, hashlib.sha256(), 0, True
                if body is not None:
                    sha.update(b"\n" + body if lines else body)
                    lines += 1
        if begun:
            yield {"conv": conv, "repaired_sha256": sha.hexdigest()}

    found = rows()
    for first in found:
        yield from batches_of((r for part in ([first], found) for r in part), schema)


# --- the job --------------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as crc32 of ``conv_id:turn`` spoils them: one of twenty is dropped, emptied,
    robbed of its ends of sentences, repeated, or made the user's. Nulls are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times_ = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), times_)).alias("x")).drop("x")


def repair(turns: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of the
    rows (conv_id, turn, role, text)."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    named = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role"), named("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    stored = materialize(dealt.mapInArrow(cut(part_rows, part_bytes), f"conv {conv}, task int, seq long, done boolean, {RESULT_SQL}, {ROWS_SQL}"), "turn-parts")
    names = [c for c, _ in RESULT]
    done = stored.filter("done").select(F.col("conv").alias("conv_id"), *names)
    parts = numbered(stored.filter("not done").select("conv", "task", "seq", *[c for c, _ in ROWS]))
    most = parts.agg(F.max("at")).first()[0]
    if most is None:
        return done
    product = with_earlier(parts).mapInArrow(to_matrices, f"conv {conv}, {PART_SQL}")
    while True:  # the last level leaves one row a conversation
        product = product.groupBy("conv", F.floor(F.col("at") / FAN_IN).alias("__group")).applyInArrow(multiply, f"conv {conv}, {PART_SQL}")
        if most < FAN_IN:
            break
        most //= FAN_IN
    segments = f"conv {conv}, at long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, segment string, out long, system boolean"
    cut_up = materialize(product.mapInArrow(to_segments, segments), "turn-segments")
    mine = cut_up.select(F.col("conv").alias("__conv"), F.col("at").alias("__at"), "segment", "out", "system")
    bodies = parts.join(mine, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("at") == F.col("__at")))
    bodies = bodies.select("conv", "at", "turns", "roles", "texts", "copies", "segment", "out", "system").mapInArrow(rewrite, f"conv {conv}, at long, body binary")
    hashed = bodies.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(digest, f"conv {conv}, repaired_sha256 string")
    hashed = hashed.select(F.col("conv").alias("__conv"), "repaired_sha256")
    heads = cut_up.filter("at = 0").select("conv", *names[:-1])
    long = heads.join(hashed, F.col("conv").eqNullSafe(F.col("__conv"))).select(F.col("conv").alias("conv_id"), *names)
    return done.unionByName(long)


def numbered(parts: DataFrame) -> DataFrame:
    """Adds `at`, a part's number in its conversation: parts are counted by task, and tasks' counts are summed."""
    counts = parts.groupBy("conv", "task").agg(F.count("*").alias("n"), F.min("seq").alias("from"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv").alias("__conv"), F.col("task").alias("__task"), "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    found = parts.join(starts, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("task") == F.col("__task")))
    return found.select(*parts.columns, (F.col("start") + F.col("seq") - F.col("from")).alias("at"))


def with_earlier(parts: DataFrame) -> DataFrame:
    """Adds hashes of each row's role and text, and `earlier`: those of them that earlier parts hold."""
    pair = F.arrays_zip("roles", "texts")
    hashed = parts.withColumn("hashes", F.transform(pair, lambda x: F.sha2(F.concat(F.char_length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"]).cast("binary"), 256)))
    held = hashed.select("conv", "at", F.explode(F.array_distinct("hashes")).alias("h"))
    firsts = held.groupBy("conv", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv").alias("__conv"), F.col("h").alias("__h"), "first")
    again = held.join(firsts, (F.col("h") == F.col("__h")) & F.col("conv").eqNullSafe(F.col("__conv"))).filter("at > first")
    # at most a part's rows are gathered
    again = again.groupBy(F.col("conv").alias("__conv"), F.col("at").alias("__at")).agg(F.collect_list("h").alias("earlier"))
    return hashed.join(again, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("at") == F.col("__at")), "left").drop("__conv", "__at")


def with_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """The results of every conversation of a table: those without rows have zeros and nothing repaired."""
    every = conversations.select(F.col("conv_id").alias("__id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(EMPTY_SHA)}
    kept = [c for c, _ in RESULT]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left").select(F.col("__id").alias("conv_id"), *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in kept])
