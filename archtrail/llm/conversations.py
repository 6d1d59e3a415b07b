"""Repair of damaged conversations: least-cost edits to a legal order of roles.

Legal are the role initials ``(s?(ua)+)?``. Rows are kept (K, 0), get another role (R, 3),
are deleted (D, 4; blank and duplicate rows must be) or an empty turn is inserted (I, 3); a
truncated row that stays adds 3. Of the cheapest edits those with the ASCII-least letters
are taken.

An automaton of four states (nothing, ``s``, ``u``, ``a`` last) reads the repaired roles,
and a letter decides the next state, so a run of rows is a 4 x 4 table of least costs and the
order of their letters. Hirschberg's scheme finds the edits in linear space: costs and
letter ranks run forward to the middle, costs run backward from the end, the optimal
crossing with the least letters splits the problem in two.

Rows are sorted by conversation and turn over all tasks; a conversation that lies in several
blocks (a task's end, or ``BLOCK_ROWS``) is split the same way: tables of blocks are
multiplied in a tree of ``FAN`` children, states at the block ends come down that tree, and
each block repairs itself. So no conversation, however long, is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows (and bytes of text) of a block; blocks of one conversation that are multiplied at once (bits).
BLOCK_ROWS, BLOCK_BYTES, FAN_BITS = 4096, 4_000_000, 10
NEVER = 1 << 60
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the output of a role, by the state before it (-1: not legal).
_NEXT = {"s": (AFTER_S, -1, -1, -1), "u": (AFTER_U, AFTER_U, -1, AFTER_U), "a": (-1, -1, AFTER_A, -1)}
#: Roles that edits make in each state.
_MADE = ("user", "user", "assistant", "user")
#: Kinds of rows: by role initial and fault (clean, truncated, must go), and the end.
KINDS = [(r, f) for r in ("s", "u", "a", "") for f in ("clean", "truncated", "gone")]
END = len(KINDS)
FAULTS = ("blank", "duplicate", "truncated")


@lru_cache(maxsize=1)
def steps() -> list[list[list[tuple[int, str]]]]:
    """Per kind of row, state before and state after: least cost and the least letters of that cost."""

    def best(found: list[tuple[int, str, int]]) -> list[tuple[int, str]]:
        return [min(((c, w) for c, w, t in found if t == state), default=(NEVER, "")) for state in range(4)]

    def inserted(state: int, times: int) -> int:
        for _ in range(times):
            state = AFTER_A if state == AFTER_U else AFTER_U
        return state

    table = []
    for role, fault in KINDS:
        rows = []
        for before in range(4):
            found = []
            for times in range(4):
                state, cost, word = inserted(before, times), INSERT * times, "I" * times
                found.append((cost + DELETE, word + "D", state))
                if fault != "gone":
                    extra = TRUNCATED if fault == "truncated" else 0
                    if role and _NEXT[role][state] >= 0:
                        found.append((cost + KEEP + extra, word + "K", _NEXT[role][state]))
                    found.append((cost + REROLE + extra, word + "R", AFTER_A if state == AFTER_U else AFTER_U))
            rows.append(best(found))
        table.append(rows)
    ends = [[(INSERT * k, "I" * k, START) for k in range(4) if inserted(before, k) in (START, AFTER_A)] for before in range(4)]
    table.append([best(found) for found in ends])
    return table


Vector = list[tuple[int, int]]  # per state: least cost, and the rank of its letters among the states


def _ranked(found: list[tuple[int, tuple] | None]) -> Vector:
    order = {x[1]: k for k, x in enumerate(sorted((x for x in found if x), key=lambda x: x[1]))}
    return [(x[0], order[x[1]]) if x else (NEVER, 0) for x in found]


def forward(kinds: bytes, vector: Vector) -> Vector:
    """Carry costs and ranks of the letters over rows of these kinds."""
    table = steps()
    for kind in kinds:
        found: list[tuple[int, tuple] | None] = [None] * 4
        for before, (cost, rank) in enumerate(vector):
            if cost < NEVER:
                for after, (more, word) in enumerate(table[kind][before]):
                    if more < NEVER:
                        new = (cost + more, (rank, word))
                        if found[after] is None or new < found[after]:
                            found[after] = new
        vector = _ranked(found)
    return vector


def backward(kinds: bytes, costs: list[int]) -> list[int]:
    """Least costs from each state before rows of these kinds to their end."""
    table = steps()
    for kind in reversed(kinds):
        costs = [min(more + costs[after] for after, (more, _) in enumerate(row)) for row in table[kind]]
    return costs


def only(state: int) -> Vector:
    return [(0, 0) if s == state else (NEVER, 0) for s in range(4)]


def crossing(left: Vector, right: list[int]) -> int:
    """The state with the least sum; of several that with the least letters so far."""
    return min(range(4), key=lambda s: (left[s][0] + right[s], left[s][1]))


def letters(kinds: bytes, entry: int, leave: int) -> str:
    """The least of the cheapest letters from ``entry`` to ``leave``."""
    out, waiting = [], [(0, len(kinds), entry, leave)]
    while waiting:
        first, end, a, b = waiting.pop()
        if end - first == 0:
            continue
        if end - first == 1:
            out.append(steps()[kinds[first]][a][b][1])
            continue
        middle = (first + end) // 2
        state = crossing(forward(kinds[first:middle], only(a)), backward(kinds[middle:end], [0 if s == b else NEVER for s in range(4)]))
        waiting += [(middle, end, state, b), (first, middle, a, state)]
    return "".join(out)


Table = list[Vector]  # by state before: costs and ranks by state after


def multiply(vector: Vector, table: Table) -> tuple[Vector, list[int]]:
    """Carry a vector over a block; also the state before that each state after comes from."""
    found: list[tuple[int, tuple] | None] = [None] * 4
    for before, (cost, rank) in enumerate(vector):
        if cost < NEVER:
            for after, (more, own) in enumerate(table[before]):
                if more < NEVER and (found[after] is None or (cost + more, (rank, own, before)) < found[after]):
                    found[after] = (cost + more, (rank, own, before))
    return _ranked(found), [x[1][2] if x else 0 for x in found]


def product(tables: list[Table]) -> Table:
    out = []
    for entry in range(4):
        vector = only(entry)
        for table in tables:
            vector = multiply(vector, table)[0]
        out.append(vector)
    return out


def crossings(tables: list[Table], entry: int, leave: int) -> list[int]:
    """States before each block and after the last on the way from ``entry`` to ``leave``."""
    vector, came = only(entry), []
    for table in tables:
        vector, before = multiply(vector, table)
        came.append(before)
    states = [leave]
    for before in reversed(came):
        states.append(before[states[-1]])
    return states[::-1]


def _flat(table: Table) -> list[int]:
    return [x for row in table for pair in row for x in pair]


def _table(flat: list[int]) -> Table:
    return [[(flat[8 * s + 2 * t], flat[8 * s + 2 * t + 1]) for t in range(4)] for s in range(4)]


# ---- rows


def damaged(rows: DataFrame) -> DataFrame:
    """The trial damage: by ``crc32(conv_id:turn) % 20`` a row is dropped (0), emptied (1), loses ``[.!?]`` (2),
    is repeated (3) or becomes a user's (4). Null strings are one space. Dropped rows have ``copies`` 0."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _last_sign(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, ``fault`` of the first copy (the others are duplicates or blank) and ``kind``.

    A row is a duplicate where role and text stand in an earlier row of its conversation.
    Equal rows are counted first and texts compared by SHA-256, so that a group of very many
    repeats is reduced where it is read.
    """
    own = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    own = written(own.withColumn("saying", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = own.groupBy("conv_id", "saying").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = first.select(F.col("conv_id").alias("first_conv"), F.col("saying").alias("first_saying"), "first")
    joined = own.join(named, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("saying") == F.col("first_saying")), "left")
    sign = _last_sign(F.col("text"))
    fault = F.when(sign == "", "blank").when(F.coalesce(turn > F.col("first"), F.lit(False)), "duplicate").when(~sign.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("")
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = 3 * place + F.when(fault.isNull(), 0).when(fault == "truncated", 1).otherwise(2)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), kind.cast("int").alias("kind"))


BLOCK = "conv_id long, block long, turns array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<string>, kinds array<int>"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``faults`` in order, as blocks: a row per conversation and block with its rows as lists.

    Turns ascend (null first), rows of one turn by role and text. Blocks of a conversation
    ascend too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 30
        held, rows_held, bytes_held, last = [], 0, 0, None
        ready: list[list] = []

        def close() -> None:
            nonlocal number, held, rows_held, bytes_held
            if held:
                ready.append([held[0][0], number, *(list(c) for c in list(zip(*held, strict=True))[1:])])
                number += 1
                held, rows_held, bytes_held = [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready, strict=True), _types(BLOCK), strict=True)], names=_names(BLOCK))

        waiting = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last or rows_held >= BLOCK_ROWS or bytes_held > BLOCK_BYTES:
                    close()
                    last = row[0]
                    if waiting > BLOCK_BYTES or len(ready) >= 2000:
                        yield out()
                        ready, waiting = [], 0
                held.append(row)
                rows_held += 1
                bytes_held += len(row[3])
                waiting += len(row[3])
        close()
        if ready:
            yield out()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(ranged.select("conv_id", "turn", "role", "text", "copies", "fault", "kind").mapInArrow(run, BLOCK))


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    of = lambda t: pa.list_(of(t[6:-1])) if t.startswith("array<") else kinds[t]
    return [of(f.strip().split(" ")[1]) for f in schema.split(", ")]


# ---- conversations that lie in several blocks

_SUMMARY = "conv_id long, key long, flat array<long>"
_STATES = "conv_id long, key long, entry int, leave int"


def _rows_to_batch(found: list[tuple], schema: str) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [[] for _ in _names(schema)]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _types(schema), strict=True)], names=_names(schema))


def block_states(packed: DataFrame) -> DataFrame:
    """``conv_id, block, entry, leave, last`` of every block: the states the cheapest, least letters have at its ends."""
    many = packed.groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.max("block").alias("last_block"))
    many = many.select(F.col("conv_id").alias("of_conv"), "n_blocks", "last_block")
    with_ends = packed.join(many, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv")
    split = with_ends.where("n_blocks > 1").select("conv_id", "block", "kinds", (F.col("block") == F.col("last_block")).alias("last"))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for conv, block, kinds, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = bytes(kinds) + bytes([END] * last)
                found.append((conv, block, _flat([forward(run, only(s)) for s in range(4)])))
            yield from _rows_to_batch(found, _SUMMARY).to_batches()

    level = written(split.mapInArrow(summary, _SUMMARY))
    levels = [level]

    def up(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["key"])
        return _rows_to_batch([(rows[0]["conv_id"], rows[0]["key"] >> FAN_BITS, _flat(product([_table(r["flat"]) for r in rows])))], _SUMMARY)

    while not levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        parents = levels[-1].withColumn("parent", F.shiftright("key", FAN_BITS)).groupBy("conv_id", "parent")
        levels.append(written(parents.applyInArrow(up, _SUMMARY)))
    states = levels[-1].select("conv_id", "key", F.lit(START).alias("entry"), F.lit(START).alias("leave"))

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ends = sorted(left.to_pylist(), key=lambda r: r["key"]), right.to_pylist()[0]
        way = crossings([_table(r["flat"]) for r in rows], ends["entry"], ends["leave"])
        return _rows_to_batch([(r["conv_id"], r["key"], way[k], way[k + 1]) for k, r in enumerate(rows)], _STATES)

    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.shiftright("key", FAN_BITS)).groupBy("conv_id", "parent")
        states = written(children.cogroup(states.withColumn("parent", F.col("key")).groupBy("conv_id", "parent")).applyInArrow(down, _STATES))
    named = states.select(F.col("conv_id").alias("of_conv"), "key", "entry", "leave")
    with_states = with_ends.join(named, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("key")), "left")
    return with_states.select(
        *packed.columns, F.coalesce("entry", F.lit(START)).alias("entry"), F.coalesce("leave", F.lit(START)).alias("leave"),
        (F.col("block") == F.col("last_block")).alias("last"), (F.col("n_blocks") == 1).alias("whole"),
    )


REPAIRED = (
    "conv_id long, block long, whole boolean, edits string, cost long, blank long, duplicate long, truncated long, illegal long, initials array<string>, "
    "edit_roles array<string>, edit_texts array<string>, edit_turns array<long>"
)
LEGAL_PAIRS = ("su", "ua", "au")


def _repair(row: dict) -> tuple:
    """One block's row of ``REPAIRED``."""
    kinds = bytes(row["kinds"]) + bytes([END] * row["last"])
    state, at, cost, edits, turns = row["entry"], 0, 0, [], []
    for letter in letters(kinds, row["entry"], row["leave"]):
        if letter == "I":
            turns.append((_MADE[state], "", None))
            state, cost = AFTER_A if state == AFTER_U else AFTER_U, cost + INSERT
            edits.append("I")
            continue
        more = row["copies"][at] - 1  # further copies go
        cost += DELETE * (more + (letter == "D"))
        if letter != "D":
            role = row["roles"][at] if letter == "K" else _MADE[state]
            state, cost = _NEXT[role[0]][state], cost + REROLE * (letter == "R") + TRUNCATED * (row["faults"][at] == "truncated")
            turns.append((role, row["texts"][at], row["turns"][at]))
        edits.append(letter + "D" * more)
        at += 1
    counts = dict.fromkeys(FAULTS, 0)
    for fault, copies in zip(row["faults"], row["copies"], strict=True):
        if fault == "blank":
            counts["blank"] += copies
        else:
            counts["duplicate"] += copies if fault == "duplicate" else copies - 1
            counts["truncated"] += fault == "truncated"
    initials = [r[:1] for r in row["roles"]]
    illegal = sum(row["copies"]) - len(initials) + sum(x + y not in LEGAL_PAIRS for x, y in zip(initials, initials[1:], strict=False))
    roles, texts, numbers = ([t[k] for t in turns] for k in range(3))
    return (row["conv_id"], row["block"], row["whole"], "".join(edits), cost, *counts.values(), illegal, [initials[0], initials[-1]], roles, texts, numbers)


def repair_blocks(packed: DataFrame) -> DataFrame:
    """Edits of every block, and of the turns they leave role, text and turn (inserted: null).

    ``initials`` are those of the first and last row; ``illegal`` counts pairs within the
    block; ``whole`` says that the block is its whole conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield from _rows_to_batch([_repair(row) for row in batch.slice(k, 256).to_pylist()], REPAIRED).to_batches()

    columns = ["conv_id", "block", "turns", "roles", "texts", "copies", "faults", "kinds", "entry", "leave", "last", "whole"]
    return block_states(packed).select(*columns).mapInArrow(run, REPAIRED)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows: ``conv_id, block, place, turn, role, text`` (order by block and place)."""
    zipped = F.arrays_zip("edit_roles", "edit_texts", "edit_turns")
    return repaired.select("conv_id", "block", F.posexplode(zipped).alias("place", "t")).select(
        "conv_id", "block", "place", F.col("t.edit_turns").alias("turn"), F.col("t.edit_roles").alias("role"), F.col("t.edit_texts").alias("text"))


DIGEST = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the blocks of long conversations together; they come in order, one block is held at a time."""
    last, found = None, None

    def out() -> pa.RecordBatch:
        conv, *counts, audit, sha, _, _ = found
        return _rows_to_batch([(conv, *counts, "".join(audit), sha.hexdigest())], DIGEST).to_batches()[0]

    for batch in batches:
        for conv, _, blank, duplicate, truncated, illegal, cost, edits, body, n_turns, initials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is None or conv != last:
                if found is not None:
                    yield out()
                last, found = conv, [conv, 0, 0, 0, 0, 0, [], hashlib.sha256(), False, None]
            if found[9] is not None:
                illegal += found[9] + initials[0] not in LEGAL_PAIRS
            for k, value in enumerate((blank, duplicate, truncated, illegal, cost), 1):
                found[k] += value
            found[6].append(edits)
            if n_turns:
                found[7].update((("\n" if found[8] else "") + body).encode())
                found[8] = True
            found[9] = initials[1]
    if found is not None:
        yield out()


def conversation_report(rows: DataFrame, damage: bool = True) -> DataFrame:
    """One row per ``conv_id`` of the input (null is one too): counts of faults, cost and letters of the edits, digest.

    ``rows`` has ``conv_id, turn, role, text`` (other columns are not read). With ``damage``
    the trial damage is done first. ``gaps``: turns between the smallest and the largest that
    no row has; ``illegal``: neighbouring rows whose role initials are not ``su``, ``ua`` or
    ``au``; ``audit``: the letters; ``repaired_sha256``: of the repaired ``role:text`` lines. A
    null role or text is one space. Rows of one turn are taken by role and text; equal rows
    stand together. A conversation without rows has zeros, no letters and the digest of the
    empty string; an empty table gives no rows.
    """
    if damage:
        rows = damaged(rows)
    else:
        rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps")
    every = rows.groupBy("conv_id").agg(gaps)
    repaired = written(repair_blocks(blocks(faults(rows))))
    body = F.array_join(F.transform(F.arrays_zip("edit_roles", "edit_texts"), lambda t: F.concat(t.edit_roles, F.lit(":"), t.edit_texts)), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = repaired.where("whole").select("conv_id", *counts, F.col("edits").alias("audit"), F.sha2(body, 256).alias("repaired_sha256"))
    long = repaired.where("not whole").select("conv_id", "block", *counts, "edits", body.alias("body"), F.size("edit_roles").alias("n_turns"), "initials")
    long = long.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block").mapInArrow(_stream_digests, DIGEST)
    done = whole.unionByName(long).withColumnRenamed("conv_id", "of_conv")
    zero = F.lit(0).cast("long")
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left").select(
        "conv_id", F.col("gaps").cast("long").alias("gaps"), *(F.coalesce(c, zero).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
