"""Conversation repair against a search over all states and letters."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from cases import SF, rows_of

from archtrail.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, own in out.items()}


def brute(own):
    """All columns of one conversation's rows; least (cost, letters) for every state, row by row."""
    turns = {t for t, _, _ in own if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in own:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    # a state is the last output initial ('' none)
    made = {"": "user", "s": "user", "a": "user", "u": "assistant"}
    with_inserts = lambda best: closure(best, made)
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(own, faults):
        new = {}
        for state, (cost, word, out) in with_inserts(best).items():
            offer(new, state, (cost + 4, word + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 3 * (fault == "truncated")
            if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                offer(new, role[:1], (more, word + "K", (*out, f"{role}:{text}")))
            offer(new, made[state][0], (more + 3, word + "R", (*out, f"{made[state]}:{text}")))
        best = new
    ends = [x for state, x in with_inserts(best).items() if state in ("", "a")] if own else [(0, "", ())]
    cost, word, out = min(ends)
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in C.FAULTS), illegal, cost, word, sha)


def offer(best, state, value):
    if state not in best or value < best[state]:
        best[state] = value


def closure(best, made):
    out = dict(best)
    for _ in range(4):
        for state, (cost, word, turns) in list(out.items()):
            offer(out, made[state][0], (cost + 3, word + "I", (*turns, made[state] + ":")))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("block", "kinds", "copies", "of_conv"):
        frame = frame.withColumn(name, C.F.lit("other"))
    want = {conv: brute(own) for conv, own in after_damage(rows).items()}
    got = rows_of(C.conversation_report(frame).select(*COLUMNS))
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r[1:]) for r in got} == {conv: want.get(conv) for conv in {r[0] for r in rows}}


def drawn(seed, convs, rows_each):
    random.seed(seed)
    texts = ["Fine.", "Fine.", "no end", "", " \t", "What?", "So!\n", "No. ", None, "…", "Ünd.", "one more"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "university"]
    return [
        (conv if conv else None, random.choice([None, *range(-3, rows_each)]), random.choice(roles), random.choice(texts) if random.random() < 0.4 else f"text {random.random()}{random.choice('.!?x')}")
        for conv in range(convs) for _ in range(random.randint(1, rows_each))
    ]


def test_against_brute_force(spark):
    check(spark, drawn(1, 60, 12))


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 2)
    monkeypatch.setattr(C, "FAN_BITS", 1)
    check(spark, drawn(2, 6, 60))


def test_hirschberg_equals_greedy_on_costs():
    random.seed(3)
    for n in [0, 1, 2, 3, 5, 17, 64]:
        for _ in range(20):
            kinds = bytes(random.randrange(C.END) for _ in range(n)) + bytes([C.END])
            vector = {C.START: (0, "")}
            for kind in kinds:
                new = {}
                for a, (cost, word) in vector.items():
                    for b, (more, own) in enumerate(C.steps()[kind][a]):
                        if more < C.NEVER:
                            new[b] = min(new.get(b, (C.NEVER, "")), (cost + more, word + own))
                vector = new
            assert C.letters(kinds, C.START, C.START) == vector[C.START][1]


def test_every_row_dropped_and_empty_table(spark):
    dropped = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Hi."), (None, None, None, None), (7, None, "assistant", "Yes.")])
    assert C.conversation_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_text_and_very_many_copies(spark):
    check(spark, [(1, 5, "user", "x" * 300_000 + ".")] * 300 + [(1, 6, "assistant", "Done.")])


@pytest.mark.parametrize("rows", [[(3, 1, "user", "Hi."), (3, 2, "assistant", "Hello.")], [(3, 1, "system", "Be kind.")]])
def test_undamaged(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = [(t, r, x) for _, t, r, x in rows]
    assert rows_of(C.conversation_report(frame, damage=False).select(*COLUMNS)) == [(3, *brute(own))]
    turns = C.repaired_turns(C.repair_blocks(C.blocks(C.faults(frame.withColumn("copies", C.F.lit(1).cast("long")))))).collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in sorted(turns, key=lambda t: (t.block, t.place))))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
