"""Conversation repair against a suffix table and all edits of tiny conversations."""

import itertools
import os
import random
import re

from tablewright.llm import conversations as C
from tablewright.llm.queries import QUERIES
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = {"u": "user", "a": "assistant"}


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "usher", "", " "]
    kinds = ["", "", "", "truncated", "blank", "duplicate"]
    return [(i, rng.choice(roles), f"t{i}", rng.choice(kinds)) for i in range(n)]


def all_edits(rows):
    """The best of all combinations of edits with up to two insertions at each place."""
    inserts, found = ("", "u", "a", "ua", "au"), []
    for combo in itertools.product(*[[(o, i) for o in ("K", "Ru", "Ra", "D") for i in inserts] for _ in rows]):
        for tail in inserts:
            cost, audit, initials, lines = 0, "", "", []
            for (edit, before), row in zip([*combo, ("", tail)], [*rows, None], strict=True):
                cost, audit, initials = cost + 3 * len(before), audit + "I" * len(before), initials + before
                lines += [f"{ROLES[c]}:" for c in before]
                if row is None:
                    continue
                _, role, text, kind = row
                if edit != "D" and kind in ("blank", "duplicate"):
                    initials += "!"
                cost += 4 if edit == "D" else (3 if kind else 0) + (3 if edit[0] == "R" else 0)
                audit += edit[0]
                if edit != "D":
                    initials += edit[1:] or role[:1] or "!"
                    lines.append(f"{ROLES[edit[1]] if edit[1:] else role}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials):
                found.append((cost, audit, tuple(lines)))
    return min(found, key=lambda f: f[:2])


def test_the_suffix_table_equals_all_edits():
    rng = random.Random(3)
    for _ in range(40):
        rows = random_rows(rng, rng.randrange(3))
        assert brute.cheapest_repair(rows) == all_edits(rows)


def test_agenda_in_any_chunks():
    rng = random.Random(4)
    for _ in range(1500):
        rows = random_rows(rng, rng.randrange(1, 40))
        elements = [C.Element(r[1][:1], r[3] or "fine", 1) for r in rows]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(5))))
        parts = [elements[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        moves = [{(s, h): v for s in C.STATES for h, v in C.solve_chunk(p, s).items()} for p in parts]
        cost, audits, starts = C.join_chunks(moves)
        assert (cost, C.spelled("".join(audits))) == brute.cheapest_repair(rows)[:2]
        assert starts[0] == "0" and len(audits) == len(parts)


def found(spark, rows, damaged=True):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "conv_id long, turn long, role string, text string, key string, n int, digest string")
    repair = C.repair_conversations(C.damage(df) if damaged else df)
    full = C.with_all_conversations(repair.conversations, C.rows_digest(repair.rows), df)
    return sorted((tuple(r) for r in full.select(*NAMES).collect()), key=str), repair


def test_every_conversation_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_lightest_repair"](spark, FOLDER)
    assert sorted((tuple(r) for r in got.select(*NAMES).collect()), key=str) == brute.repaired(rows)


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = [(None, None, None, None)] * 3 + [(None, t, "user", "Hi.") for t in (None, 1, 5)] + [(8, None, "user", "a."), (8, None, "user", "b.")]
    rows += [(9, 3, "system", ""), (10, 2, "", "?"), (11, 1, "user", "x" * 2_000_000 + "."), (11, 2, "assistant", " ")]
    rows += [(c, rng.randrange(-3, 9), rng.choice(["user", "assistant", "system", None]), rng.choice(["A.", "B!", "c", " \n", None])) for c in range(7) for _ in range(9)]
    got, repair = found(spark, rows)
    assert got == brute.repaired(rows)
    assert set(repair.rows.columns) == {"conv_id", "place", "turn", "role", "text", "edit"}
    again, _ = found(spark, list(reversed(rows)))
    assert again == got


def test_long_conversations_are_solved_in_chunks(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(900)}{rng.choice('.!? ')}") for t in range(1500)]
    rows += [(2, 4, "user", "Same."), (1, 3000, "assistant", "End.")] + [(3, t // 700, "user", "Same.") for t in range(1400)]
    got, _ = found(spark, rows)
    assert got == brute.repaired(rows)


def test_empty_and_dropped(spark):
    got, repair = found(spark, [])
    assert got == [] and repair.rows.count() == 0
    # a conversation whose only row is dropped
    import zlib

    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got, _ = found(spark, [(dropped, 0, "user", "Hi.")])
    assert got == [(dropped, 0, 0, 0, 0, 0, 0, "", brute.sha(""))]
