"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over an edit lattice.

A lattice node is a place between rows and the last initial written: nothing yet, ``s``, ``u`` or ``a``. Keeping,
rewriting or deleting a row moves on by a row, an inserted row only changes the initial. Two heaps settle nodes from both
ends; when the sum of their least costs passes the best crossing, all crossings of that cost are joined and the least
audit stays.

Spark sorts the rows by conversation and turn into ranges, so a conversation of any length is spread over tasks, and a
task cuts it into pieces of a bounded number of rows. Pieces that may go on elsewhere are solved between every pair of
initials and put together in rounds, by cost and by the rank of a piece's audits: audits of one piece all end with the
same row, so none starts another and ranks decide as whole audits would. Texts take no part in that; they are shuffled
once, for the digest, which one task takes along a conversation's sorted rows without holding them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidewatch.llm.base import query, table
from tidewatch.session import materialize

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Initials a reading may be at: none yet, then the last one written. A repaired conversation ends at the first or last.
STATES = ("", "s", "u", "a")
START, ENDS = 0, (0, 3)
#: What may follow an initial, as a state.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
LEGAL = {"su", "ua", "au"}
WRITTEN = {"u": "user", "a": "assistant"}
#: Lattice rows of a piece, and pieces put together in one round.
PIECE, FAN = 512, 64
GAP = r"[^\x20\x09-\x0D]"

Row = tuple[str, bool, bool, int]


def steps(row: Row, state: int) -> Iterator[tuple[int, str, int]]:
    """Ways past a row: next state, letters, cost. ``row`` is its initial, whether it must go, whether it is cut, copies."""
    initial, must_go, cut, copies = row
    more, dearer = "D" * (copies - 1), DELETE * (copies - 1)
    yield state, "D" + more, DELETE + dearer
    if not must_go:
        for letter, after in NEXT[state].items():
            if letter == initial:
                yield after, "K" + more, CUT * cut + dearer
            elif letter in WRITTEN:
                yield after, "R" + more, REROLE + CUT * cut + dearer


def inserted(state: int) -> Iterator[int]:
    for letter, after in NEXT[state].items():
        if letter in WRITTEN:
            yield after


def cheapest(rows: Sequence[Row], start: int, ends: tuple[int, ...], closing: bool) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way from state ``start`` past all rows to one of ``ends``; None if there is none.

    Of equally cheap ways the one with the least audit. ``closing`` allows insertions after the last row.
    Each heap takes nodes by cost, then along its direction, so rows kept for nothing are passed in order and a
    node's audit is the least one when the node is settled.
    """
    n = len(rows)
    source = (0, start)
    if n == 0 and not closing:
        return (0, "") if start in ends else None
    ahead: dict = {source: (0, "")}
    back: dict = {(n, q): (0, "") for q in ends}
    forward, backward = [(0, 0, "", source)], [(0, 0, "", (n, q)) for q in ends]
    done_ahead: set = set()
    done_back: set = set()
    best = None

    def onward(node):
        place, state = node
        if place < n:
            for after, letters, cost in steps(rows[place], state):
                yield (place + 1, after), letters, cost
        if place < n or closing:
            for after in inserted(state):
                yield (place, after), "I", INSERT

    def inward(node):
        place, state = node
        for before in range(len(STATES)):
            if place:
                for after, letters, cost in steps(rows[place - 1], before):
                    if after == state:
                        yield (place - 1, before), letters, cost
            if (place < n or closing) and state in inserted(before):
                yield (place, before), "I", INSERT

    def settle(heap, labels, done, other, moves, from_start):
        nonlocal best
        cost, _, audit, node = heapq.heappop(heap)
        if node in done:
            return
        done.add(node)
        if node in other:
            total = cost + other[node][0]
            best = total if best is None else min(best, total)
        for after, letters, step in moves(node):
            label = (cost + step, audit + letters if from_start else letters + audit)
            if after not in done and (after not in labels or label < labels[after]):
                labels[after] = label
                heapq.heappush(heap, (label[0], after[0] if from_start else n - after[0], label[1], after))

    while forward and backward and (best is None or forward[0][0] + backward[0][0] <= best):
        if len(forward) <= len(backward):
            settle(forward, ahead, done_ahead, back, onward, True)
        else:
            settle(backward, back, done_back, ahead, inward, False)
    if best is None:
        return None
    # Both ends are settled from the start, also if the other heap ran out first.
    done_ahead.add(source)
    done_back.update((n, q) for q in ends)
    crossings = []
    for node in done_ahead:
        cost, audit = ahead[node]
        if node in done_back and cost + back[node][0] == best:
            crossings.append(audit + back[node][1])
        for after, letters, step in onward(node):
            if after in done_back and cost + step + back[after][0] == best:
                crossings.append(audit + letters + back[after][1])
    return best, min(crossings)


def closed(state: int) -> tuple[int, str] | None:
    """The cheapest insertions after the last row."""
    return {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}[state]


def written(audit: str, state: int, rows: list[tuple[str, int]]) -> list[tuple[int, str, str]]:
    """What an audit does: for each row left, its place, the roles inserted before it and its new role.

    ``rows`` are initials and copies. An empty new role keeps the row's own. Place -1 stands for what follows the last row.
    """
    out, before, place, at = [], [], 0, 0
    while at < len(audit):
        letter = audit[at]
        if letter in "IR":
            # After nothing, s or a the next one written is u.
            state = 3 if state == 2 else 2
        if letter == "I":
            before.append(WRITTEN[STATES[state]])
            at += 1
            continue
        if letter != "D":
            out.append((place, " ".join(before), WRITTEN[STATES[state]] if letter == "R" else ""))
            before = []
        if letter == "K":
            state = NEXT[state][rows[place][0]]
        at += rows[place][1]
        place += 1
    if before:
        out.append((-1, " ".join(before), ""))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows after damage; ``copies`` is 0 for a dropped and 2 for a repeated row.

    Damage follows the CRC-32 of ``conv_id:turn``. Null roles and texts, and null parts of the key, are one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def intact(conversations: DataFrame) -> DataFrame:
    """``conversations`` as ``repair`` takes them, without damage."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role"), part("text"), F.lit(1).cast("long").alias("copies"))


def facts(rows: DataFrame) -> DataFrame:
    """One row for all equal rows of a turn, without its text: ``conv_id, turn, role, print, initial, blank, cut, copies, again``.

    ``again`` says that an earlier turn of the conversation has the same role and text.
    """
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    each = rows.where("copies > 0").select(
        "conv_id",
        "turn",
        "role",
        F.sha2("text", 256).alias("print"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(GAP)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
        "copies",
    )
    narrow = materialize(each.groupBy("conv_id", "turn", "role", "print", "initial", "blank", "cut").agg(F.sum("copies").alias("copies")), "conv-rows")
    # Nulls come first in the order of turns, and compare as the least.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = narrow.groupBy("conv_id", "role", "print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p"))
    again = F.col("first").isNotNull() & ~(F.col("turn").eqNullSafe(F.col("first.turn")))
    return narrow.join(firsts, same, "left").select(*narrow.columns, again.alias("again"))


def counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` of every conversation of ``rows``."""
    turns = found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("again") & F.col("cut"), 1)).alias("truncated"),
    )
    ids = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), *(F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return turns.unionByName(ids).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        whole("blank"),
        whole("duplicate"),
        whole("truncated"),
    )


# Short conversations repeat each other's lattices.
_known = functools.lru_cache(1 << 14)(cheapest)


def _solved(rows: list[dict], piece: int, whole: bool) -> pa.RecordBatch:
    lattice = tuple((r["initial"], r["blank"] or r["again"] or r["chunk"] > 0, r["cut"], r["run"]) for r in rows)
    search = _known if len(lattice) <= 16 else cheapest
    initials = [r["initial"] for r in rows]
    illegal = sum(r["run"] - 1 for r in rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    ways = []
    for start in (START,) if whole else range(len(STATES)):
        for ends in (ENDS,) if whole else ((q,) for q in range(len(STATES))):
            found = search(lattice, start, ends, whole)
            if found:
                ways.append({"start": start, "end": ends[0], "cost": found[0], "audit": found[1]})
    ranks = {a: k for k, a in enumerate(sorted({w["audit"] for w in ways}))}
    for w in ways:
        w["rank"] = ranks[w["audit"]]
    names = [{k: r[k] for k in ("turn", "role", "print", "initial", "run")} for r in rows]
    out = {"conv_id": rows[0]["conv_id"], "piece": piece, "whole": whole, "head": initials[0], "tail": initials[-1], "illegal": illegal, "ways": ways, "rows": names}
    return pa.RecordBatch.from_pylist([out], schema=PIECES)


def _cutter(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut a sorted range into pieces and solve them. A conversation that neither starts nor ends the range, in one piece, is whole."""
        piece = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        apart = True
        for row in (r for batch in batches for r in batch.to_pylist()):
            ended = held and row["conv_id"] != held[-1]["conv_id"]
            if ended or len(held) == size:
                apart = apart or not ended
                yield _solved(held, piece, not apart)
                apart, held, piece = apart and not ended, [], piece + 1
            held.append(row)
        if held:
            yield _solved(held, piece, False)

    return cut


WAY = "array<struct<start:int,end:int,cost:bigint,audit:string,rank:int>>"
PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("whole", pa.bool_()),
        ("head", pa.string()),
        ("tail", pa.string()),
        ("illegal", pa.int64()),
        ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("rank", pa.int32())]))),
        ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("print", pa.string()), ("initial", pa.string()), ("run", pa.int64())]))),
    ]
)
PIECES_SQL = (
    f"conv_id bigint, piece bigint, whole boolean, head string, tail string, illegal bigint, ways {WAY}, "
    "rows array<struct<turn:bigint,role:string,print:string,initial:string,run:bigint>>"
)


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of all conversations in order, each with its ways. Copies beyond ``size`` are rows of their own."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {size}")))
    spread = found.withColumn("chunk", runs).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        "role",
        "print",
        "chunk",
        "initial",
        "blank",
        "again",
        "cut",
        F.least(F.lit(size), F.col("copies") - F.col("chunk") * size).cast("long").alias("run"),
    )
    order = ["conv_id", "turn", "role", "print", "chunk"]
    spread = materialize(spread, "conv-spread")
    return materialize(spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cutter(size), PIECES_SQL), "conv-pieces")


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """Put some neighbouring pieces together: the cheapest way between each pair of states, with the states passed."""
    pieces = pieces.sort_values("piece")
    ways: dict = {(q, q): (0, (), (q,)) for q in range(len(STATES))}
    for each in pieces["ways"]:
        after: dict = {}
        for (start, at), (cost, ranks, passed) in ways.items():
            for w in each:
                if w["start"] == at:
                    label = (cost + w["cost"], (*ranks, w["rank"]), (*passed, w["end"]))
                    key = (start, w["end"])
                    if key not in after or label < after[key]:
                        after[key] = label
        ways = after
    ranks = {r: k for k, r in enumerate(sorted({w[1] for w in ways.values()}))}
    heads, tails = list(pieces["head"]), list(pieces["tail"])
    illegal = int(pieces["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(tails, heads[1:], strict=False))
    out = [{"start": s, "end": e, "cost": w[0], "rank": ranks[w[1]], "passed": list(w[2])} for (s, e), w in ways.items()]
    names = pieces.iloc[0]
    first = {"conv_id": names["conv_id"], "parent": names["parent"], "head": heads[0], "tail": tails[-1], "illegal": illegal, "ways": out, "children": list(pieces["piece"])}
    return pd.DataFrame([first])


JOINED = (
    "conv_id bigint, parent bigint, head string, tail string, illegal bigint, "
    "ways array<struct<start:int,end:int,cost:bigint,rank:int,passed:array<int>>>, children array<bigint>"
)


def chosen(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """The way taken through each piece of conversations in several pieces: ``conv_id, piece, start, end, cost, illegal``.

    ``cost`` and ``illegal`` are those of the whole conversation. Rounds put ``fan`` neighbours together until one is left,
    then the ways are handed down again; a round's tasks see at most ``fan`` rows of a conversation.
    """
    level = parts.select("conv_id", "piece", "head", "tail", "illegal", F.transform("ways", lambda w: F.struct(w.start.alias("start"), w.end.alias("end"), w.cost.alias("cost"), w["rank"].alias("rank"))).alias("ways"))
    # Pieces are numbered by counting smaller ones in their range and the ranges before, so no task sees a whole conversation.
    block = F.shiftright("piece", 32)
    sizes = parts.groupBy("conv_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("least"))
    before = sizes.select(F.col("conv_id").alias("c"), "block", "least", (F.sum("n").over(W.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    level = level.join(before, same & (F.shiftright("piece", 32) == F.col("block"))).withColumn("place", F.col("before") + F.col("piece") - F.col("least"))
    names = materialize(level.select("conv_id", "piece", "place"), "conv-places")
    level = materialize(level.select("conv_id", F.col("place").alias("piece"), "head", "tail", "illegal", "ways"), "conv-level")
    rounds = []
    while True:
        up = level.withColumn("parent", F.expr(f"piece div {fan}"))
        joined = materialize(up.groupBy("conv_id", "parent").applyInPandas(_joined, JOINED), "conv-joined")
        rounds.append(joined)
        if not joined.where("parent > 0").head(1):
            break
        level = joined.select("conv_id", F.col("parent").alias("piece"), "head", "tail", "illegal", "ways")
    # The whole conversation: from nothing written to a state that can be closed.
    ends = F.create_map(*(F.lit(x) for q in range(len(STATES)) for x in (q, closed(q)[0])))
    letters = F.create_map(*(F.lit(x) for q in range(len(STATES)) for x in (q, closed(q)[1])))
    way = F.explode(F.filter("ways", lambda w: w.start == START))
    top = rounds[-1].withColumn("way", way).withColumn("total", F.col("way.cost") + ends[F.col("way.end")])
    best = top.groupBy("conv_id").agg(F.min(F.struct("total", F.col("way.rank").alias("rank"), letters[F.col("way.end")].alias("close"), F.col("way.end").alias("end"), "illegal")).alias("best"))
    ways = best.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(START).alias("start"), F.col("best.end").alias("end"), F.col("best.total").alias("cost"), F.col("best.illegal").alias("illegal"))
    for joined in reversed(rounds):
        each = ways.select(F.col("conv_id").alias("c"), F.col("piece").alias("parent_piece"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("cost").alias("whole_cost"), F.col("illegal").alias("whole_illegal"))
        down = joined.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("parent_piece")))
        passed = F.element_at(F.filter("ways", lambda w: (w.start == F.col("from")) & (w.end == F.col("to"))), 1)["passed"]
        ways = materialize(
            down.withColumn("passed", passed)
            .select("conv_id", "whole_cost", "whole_illegal", F.posexplode("children").alias("k", "piece"), "passed")
            .select("conv_id", "piece", F.element_at("passed", F.col("k") + 1).alias("start"), F.element_at("passed", F.col("k") + 2).alias("end"), F.col("whole_cost").alias("cost"), F.col("whole_illegal").alias("illegal")),
            "conv-ways",
        )
    named = names.select(F.col("conv_id").alias("c"), F.col("piece").alias("at"), "place")
    return ways.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("place"))).select("conv_id", F.col("at").alias("piece"), F.col("place"), "start", "end", "cost", "illegal")


def solved(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """``conv_id, piece, place, last, start, cost, illegal, audit, rows``: the audit of each piece of the cheapest repair."""
    whole = parts.where("whole").select(
        "conv_id", "piece", F.lit(0).cast("long").alias("place"), F.lit(True).alias("last"), F.lit(START).alias("start"), F.col("ways")[0]["cost"].alias("cost"), "illegal", F.col("ways")[0]["audit"].alias("audit"), "rows"
    )
    open_parts = parts.where("not whole")
    if not open_parts.head(1):
        return whole
    ways = chosen(open_parts, fan)
    ends = materialize(ways.groupBy("conv_id").agg(F.max("place").alias("most")), "conv-ends").select(F.col("conv_id").alias("c"), "most")
    ways = ways.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    letters = F.create_map(*(F.lit(x) for q in range(len(STATES)) for x in (q, closed(q)[1])))
    both = open_parts.select(F.col("piece").alias("at"), "ways", "rows").join(ways, F.col("at") == F.col("piece"))
    taken = F.element_at(F.filter("ways", lambda w: (w.start == F.col("start")) & (w.end == F.col("end"))), 1)["audit"]
    last = F.col("place") == F.col("most")
    audit = F.concat(taken, F.when(last, letters[F.col("end")]).otherwise(""))
    return whole.unionByName(both.select("conv_id", "piece", "place", last.alias("last"), "start", "cost", "illegal", audit.alias("audit"), "rows"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "closing", "turn", "role", "print", "before", "becomes"]
    for batch in batches:
        for r in batch.to_pylist():
            out = []
            for place, before, becomes in written(r["audit"], r["start"], [(x["initial"], x["run"]) for x in r["rows"]]):
                row = r["rows"][place] if place >= 0 else {"turn": None, "role": "", "print": ""}
                out.append((r["conv_id"], place < 0, row["turn"], row["role"], row["print"], before, becomes))
            if out:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines. An edit comes directly before the row it is for; a row without one is left out."""
    names = ["conv_id", "repaired_sha256"]
    now, state, begun, edit, started = None, None, False, None, False
    ids, sums = [], []

    def add(line: str) -> None:
        nonlocal begun
        state.update(("\n" if begun else "").encode() + line.encode())
        begun = True

    for batch in batches:
        for r in batch.to_pylist():
            if not started or r["conv_id"] != now:
                if started:
                    ids.append(now), sums.append(state.hexdigest())
                now, state, begun, edit, started = r["conv_id"], hashlib.sha256(), False, None, True
            key = (r["turn"], r["role"], r["print"])
            if r["becomes"] is not None:
                for role in r["before"].split():
                    add(f"{role}:")
                edit = None if r["closing"] else (key, r["becomes"])
            elif edit and edit[0] == key:
                add(f"{edit[1] or r['role']}:{r['text']}")
                edit = None
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names)
            ids, sums = [], []
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names)


def lines(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Edits and rows of each conversation in one order: ``conv_id, closing, turn, role, print, text, before, becomes``."""
    schema = "conv_id bigint, closing boolean, turn bigint, role string, print string, before string, becomes string"
    edits = repairs.select("conv_id", "start", "audit", "rows").mapInArrow(_edits, schema).withColumn("text", F.lit(None).cast("string"))
    texts = rows.where("copies > 0").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.lit(False).alias("closing"),
        "turn",
        "role",
        F.sha2("text", 256).alias("print"),
        F.lit(None).cast("string").alias("before"),
        F.lit(None).cast("string").alias("becomes"),
        "text",
    )
    both = edits.unionByName(texts)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "closing", "turn", "role", "print", F.col("becomes").isNull())


def repair(rows: DataFrame, size: int = PIECE, fan: int = FAN) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows`` are those of ``damaged`` or ``intact``. Rows are taken by turn, nulls first; of one turn by role and then by
    their text's SHA-256, equal rows next to each other. A row without a word is blank, one whose role and text came
    before is a duplicate, both must go; an empty text is blank. Roles count by their first character, an empty role by none.
    Conversations of any length and rows repeated any number of times are taken whole; a null id is a conversation of its
    own. One without rows has zeros, an empty audit and the digest of the empty string; an empty table gives no rows.
    Other columns aren't read.
    """
    found = materialize(facts(rows), "conv-facts")
    repairs = materialize(solved(pieces(found, size), fan), "conv-repairs")
    digests = lines(rows, repairs).mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    whole = repairs.groupBy("conv_id").agg(
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "audit"))), lambda p: p["audit"]), "").alias("audit")
    )
    named = counts(rows, found)
    right = lambda df, tag: df.withColumnRenamed("conv_id", tag)
    out = named.join(right(whole, "c"), F.col("conv_id").cast("long").eqNullSafe(F.col("c")), "left").join(right(digests, "d"), F.col("conv_id").cast("long").eqNullSafe(F.col("d")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _oracle() -> str:
    """The same repair in SQL: least (cost, audit) by state, row by row, then the audit read letter by letter."""
    add = lambda q, cost, letter: f"lpad(CAST(CAST(left(x[{q}], 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr(x[{q}], 13) || '{letter}'"
    u_from, spare = (1, 2, 4), "CASE WHEN NOT must_go THEN {} END"
    insert = f"[x[1], x[2], least(x[3], {', '.join(add(q, 2, 'I') for q in u_from)}), least(x[4], {add(3, 2, 'I')})]"
    keep = lambda q, c: f"CASE WHEN NOT must_go AND initial = '{c}' THEN {add(q, 'cut', 'K')} END"
    rerole = lambda q: spare.format(add(q, "2 + cut", "R"))
    past = (
        f"[{add(1, 3, 'D')}, least({add(2, 3, 'D')}, {keep(1, 's')}), "
        f"least({add(3, 3, 'D')}, {', '.join(f'{keep(q, chr(117))}, {rerole(q)}' for q in u_from)}), "
        f"least({add(4, 3, 'D')}, {keep(3, 'a')}, {rerole(3)})]"
    )
    return rf"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                          lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
    FROM conversations
), kinds AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
    FROM keyed CROSS JOIN crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM kinds)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), faults AS (
    SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS joint
    FROM placed
), items AS (
    SELECT conv_id AS c, i AS pos, role, text, initial, blank OR again AS must_go, CAST(NOT blank AND NOT again AND unended AS INT) AS cut FROM faults
), ways AS (
    SELECT conv_id, 0 AS i, [repeat('0', 12), NULL, NULL, NULL] AS x FROM (SELECT DISTINCT conv_id FROM faults)
    UNION ALL
    SELECT conv_id, i + 1, {past} FROM (SELECT conv_id, i, {insert} AS x FROM (SELECT conv_id, i, {insert} AS x FROM ways))
    JOIN items ON conv_id IS NOT DISTINCT FROM c AND pos = i + 1
), ends AS (
    SELECT conv_id, least(x[1], x[4]) AS best
    FROM (SELECT conv_id, {insert} AS x FROM (SELECT conv_id, {insert} AS x FROM ways
          WHERE i = (SELECT count(*) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM ways.conv_id)))
), audits AS (
    SELECT conv_id, CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM ends
), reading AS (
    SELECT conv_id, audit, 0 AS k, 0 AS i, '' AS state, CAST([] AS VARCHAR[]) AS lines FROM audits
    UNION ALL
    SELECT conv_id, audit, k + 1, CASE WHEN letter = 'I' THEN i ELSE i + 1 END,
           CASE letter WHEN 'D' THEN state WHEN 'K' THEN initial ELSE left(made, 1) END,
           CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                       WHEN 'R' THEN list_append(lines, made || ':' || text) ELSE list_append(lines, made || ':') END
    FROM (SELECT *, substr(audit, k + 1, 1) AS letter, CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS made
          FROM reading WHERE k < length(audit))
    LEFT JOIN items ON conv_id IS NOT DISTINCT FROM c AND pos = i + 1
), repaired AS (
    SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM reading WHERE k = length(audit)
), stats AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
           count(*) FILTER (NOT blank AND NOT again AND unended) AS truncated,
           count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query("op13_conversation_repair", _oracle())
def repair_query(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(table(spark, folder, "conversations")))
