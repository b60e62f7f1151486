import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tests.oracle_check import connect, differences
from tidewatch.llm.conversations import ENDS, START, cheapest, damaged, intact, repair

FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, piece int, print string, cost string"


def edits(rows):
    """All edit sequences worth trying: cost, audit and lines of the least; plain search by row and initial."""
    best = {"": (0, "", ())}

    def put(table, key, label):
        if key not in table or label[:2] < table[key][:2]:
            table[key] = label

    def grown(table):
        for _ in range(4):
            for q, (c, a, out) in list(table.items()):
                for r in ("user", "assistant"):
                    if (r[0] == "u") == (q != "u"):
                        put(table, r[0], (c + 2, a + "I", (*out, f"{r}:")))
        return table

    for role, text, fault in rows:
        after = {}
        for q, (c, a, out) in grown(best).items():
            put(after, q, (c + 3, a + "D", out))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] == "s" and q == "" or role[:1] == "u" and q != "u" or role[:1] == "a" and q == "u":
                    put(after, role[0], (c + cut, a + "K", (*out, f"{role}:{text}")))
                made = "assistant" if q == "u" else "user"
                put(after, made[0], (c + cut + 2, a + "R", (*out, f"{made}:{text}")))
        best = after
    return min((grown(best)[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def expected(data, damage):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in data:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 19
        rows = found[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit, lines = edits(marked)
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def made(seed, sizes):
    rng, data = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for k in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None])
            text = rng.choice(["Yes.", "No!", "why", " \n", "", None, f"Line {k}.\x0b ", f"open {k}", "été 🎉?"])
            data.append((conv if conv else None, rng.choice([k, k, k + 1, None]), role, text, 1, "p", "c"))
    return data


def result(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("damage", [True, False])
def test_awkward_conversations(spark, damage):
    data = made(3, [5, 0, 1, 2, 7, 9, 12, *([6] * 40)])
    docs = spark.createDataFrame(data, SCHEMA)
    assert result(repair(damaged(docs) if damage else intact(docs))) == expected(data, damage)


def test_long_conversations_are_repaired_in_pieces(spark):
    """Pieces of four rows, three to a round: conversations of many pieces, and rows repeated many times."""
    data = made(4, [30, 3, 150, 5, 70]) + [(9, 4, "user", "again.", 1, "p", "c")] * 33 + [(9, 3, "assistant", "once", 1, "p", "c")]
    docs = spark.createDataFrame(data, SCHEMA)
    assert result(repair(intact(docs), size=4, fan=3)) == expected(data, False)
    assert result(repair(intact(docs.repartition(7)), size=64, fan=2)) == expected(data, False)


def test_least_audit_of_all_ways():
    """Every sequence of edits of short conversations, against the search from both ends."""
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("sua?"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 1, 2])) for _ in range(rng.randrange(5))]
        ways = set()

        def go(place, state, cost, audit, inserted, rows=rows, ways=ways):
            if place == len(rows) and state in ENDS:
                ways.add((cost, audit))
            if inserted < 3:
                for after in {0: [2], 1: [2], 2: [3], 3: [2]}[state]:
                    go(place, after, cost + 2, audit + "I", inserted + 1)
            if place < len(rows):
                initial, must_go, cut, copies = rows[place]
                more = "D" * (copies - 1)
                go(place + 1, state, cost + 3 * copies, audit + "D" + more, 0)
                if not must_go:
                    kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)
                    if kept:
                        go(place + 1, kept, cost + cut + 3 * (copies - 1), audit + "K" + more, 0)
                    go(place + 1, 3 if state == 2 else 2, cost + 2 + cut + 3 * (copies - 1), audit + "R" + more, 0)

        go(0, START, 0, "", 0)
        assert cheapest(rows, START, ENDS, True) == min(ways)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(empty)).count() == 0
    data = [(1, 0, "user", "word " * 200_000 + "end.", 1, "p", "c"), (1, 1, "assistant", "x" * 500_000, 1, "p", "c")]
    assert result(repair(intact(spark.createDataFrame(data, SCHEMA)))) == expected(data, False)


def test_query_agrees_with_sql(spark, small):
    assert differences(spark, small, connect(small), "op13_conversation_repair") is None
