"""Conversations brought back into turn order (a system turn, then user and assistant in turn) by cheapest edits.

An audit has one letter per edit: K keeps a turn, R gives it the other role, D deletes
it, I inserts an empty one.  What follows a turn depends only on which of four states
the repaired turns so far end in: nothing yet, after system, after user, after
assistant.  So the costs of a part of a conversation are a vector of four numbers from
either side, and the cheapest audit is found by halving: the forward vector of the
first half meets the backward vector of the second, the state in which the cheapest
audits cross is fixed, and both halves are solved alone.  Memory is linear, a byte a turn.

Of equally cheap audits the least by characters counts.  Prefixes that end in different
states never begin one another (each ends with the edit of its last turn), so a forward
vector carries, next to the costs, the order of the four least prefixes; the crossing is
the least in that order.  Orders compose like costs do, hence a conversation that is too
long for one task is solved over segments first and inside of each segment then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import spread_join
from ..sources.scratch import written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED_COST = 3
NEVER = 1 << 50
#: State after a turn of role system, user or assistant in each of the four states; None where it may not stand.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: What an inserted or rerolled turn has to be in each state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: Inserted turns that end a conversation properly.
ENDING = ("", "II", "I", "")
INITIALS = "sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)

#: Costs and order keys from a state (row) to a state (column) over one turn or one part.
Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple, ...]]


def _turn_step(code: int) -> Step:
    """The cheapest way over one turn, insertions before it included; the key is its piece of the audit."""
    initial, fault = divmod(code, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for inserted in range(3):
            ways = [(DELETE, "D", state)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                ways.append((REROLE + more, "R", NEXT[state]))
                kept = AFTER[INITIALS[initial]][state] if initial < 3 else None
                if kept is not None:
                    ways.append((KEEP + more, "K", kept))
            for cost, letter, end in ways:
                found = (INSERT * inserted + cost, "I" * inserted + letter)
                best[start, end] = min(best.get((start, end), found), found)
            state = NEXT[state]
    return (tuple(tuple(best.get((p, q), (NEVER,))[0] for q in range(4)) for p in range(4)),
            tuple(tuple(best.get((p, q), (0, ""))[1] for q in range(4)) for p in range(4)))


STEPS = [_turn_step(code) for code in range(16)]
ENDS = [INSERT * len(e) for e in ENDING]


def _only(state: int) -> list[int]:
    return [0 if q == state else NEVER for q in range(4)]


def forward(steps: Sequence[Step], start: int) -> tuple[list[int], list[int]]:
    """Least cost to each state, and the place of its least audit among the four."""
    costs, order = _only(start), [0, 0, 0, 0]
    for cost, key in steps:
        ways = [min((costs[p] + cost[p][q], order[p], key[p][q]) for p in range(4) if costs[p] < NEVER) for q in range(4)]
        ranked = sorted((w[1:], q) for q, w in enumerate(ways) if w[0] < NEVER)
        costs, order = [min(w[0], NEVER) for w in ways], [9, 9, 9, 9]
        for place, (_, q) in enumerate(ranked):
            order[q] = place
    return costs, order


def backward(steps: Sequence[Step], ends: Sequence[int]) -> list[int]:
    """Least cost from each state to the end."""
    costs = list(ends)
    for cost, _ in reversed(steps):
        costs = [min(min(c + d for c, d in zip(row, costs, strict=True)), NEVER) for row in cost]
    return costs


def crossings(steps: Sequence[Step], start: int, ends: Sequence[int]) -> list[int]:
    """The state after every step on the cheapest and then least way, by halving."""
    if not steps:
        return []
    if len(steps) == 1:
        cost, key = steps[0]
        return [min(range(4), key=lambda q: (min(cost[start][q] + ends[q], NEVER), key[start][q]))]
    middle = len(steps) // 2
    there, order = forward(steps[:middle], start)
    back = backward(steps[middle:], ends)
    cross = min(range(4), key=lambda q: (min(there[q] + back[q], NEVER), order[q]))
    return crossings(steps[:middle], start, _only(cross)) + crossings(steps[middle:], cross, ends)


def edits(codes: bytes, start: int = 0, ends: Sequence[int] = ENDS) -> tuple[list[str], int]:
    """The piece of the audit of every turn (insertions stand before the turn), and the last state."""
    states = crossings([STEPS[c] for c in codes], start, ends)
    pieces = [STEPS[c][1][p][q] for c, p, q in zip(codes, [start, *states], states)]
    return pieces, states[-1] if states else start


class Repaired:
    """Turns under their edits, one at a time: the audit and the digest of what stays."""

    def __init__(self) -> None:
        self.state, self.audit, self.cost, self.lines, self.digest = 0, [], 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def turn(self, piece: str, role: str, text: str, truncated: bool) -> None:
        self.audit.append(piece)
        for letter in piece:
            if letter == "D":
                self.cost += DELETE
                continue
            self.cost += {"I": INSERT, "R": REROLE, "K": KEEP}[letter] + TRUNCATED_COST * (truncated and letter != "I")
            self.line(role if letter == "K" else WANTED[self.state], "" if letter == "I" else text)
            self.state = AFTER[role[:1]][self.state] if letter == "K" else NEXT[self.state]

    def end(self) -> tuple[str, int, str]:
        for _ in ENDING[self.state]:
            self.turn("I", "", "", False)
        return "".join(self.audit), self.cost, self.digest.hexdigest()


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _facts(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Own column names: key (null-safe), turn, role, text, its digest, and the code of what a turn alone shows."""
    body, own_role = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    last = F.substring(F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), 1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED)
    return (turns.select(F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit("")).alias("key"),
                         F.col(turn).cast("long").alias("turn"), own_role.alias("role"), body.alias("text"))
            .withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("code", (_initial(F.col("role")) * 4 + fault).cast("int")))


#: In a conversation: by turn, NULL first (Spark's order); then by role and by digest of the text.
ORDER = ["key", "turn", "role", "digest"]
COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
RESULT = f"key string, {COUNTS}, cost bigint, audit string, repaired_sha256 string"


def _legal(first: int, second: int) -> bool:
    return (first, second) in ((0, 1), (1, 2), (2, 1))


def _solved(key: str, rows: list[tuple]) -> dict:
    """One conversation: (turn, role, text, digest, code) in order."""
    seen, codes = set(), bytearray()
    for _, role, _, digest, code in rows:
        if code % 4 != BLANK and (role, digest) in seen:
            code = code - code % 4 + DUPLICATE
        seen.add((role, digest))
        codes.append(code)
    known = {r[0] for r in rows} - {None}
    out = Repaired()
    for piece, (_, role, text, _, _), code in zip(edits(bytes(codes))[0], rows, codes, strict=True):
        out.turn(piece, role, text, code % 4 == TRUNCATED)
    audit, cost, digest = out.end()
    faults = [sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return {"key": key, "gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": faults[0], "duplicate": faults[1],
            "truncated": faults[2], "illegal": sum(not _legal(a // 4, b // 4) for a, b in zip(codes, codes[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": digest}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """The rows of each key, from batches sorted by key (the first column)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return ((key, (r[1:] for r in own)) for key, own in groupby(rows, key=lambda r: r[0]))


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_TEXT, _LONG = pa.string(), pa.int64()
_RESULT = pa.schema([("key", _TEXT), *((c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", _TEXT), ("repaired_sha256", _TEXT)])


def _short(facts: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((_solved(key, list(rows)) for key, rows in _runs(batches)), _RESULT)

    rows = facts.repartition("key").sortWithinPartitions(*ORDER).select("key", "turn", "role", "text", "digest", "code")
    return rows.mapInArrow(solve, RESULT)


def _segment(codes: bytes) -> dict:
    """Costs and order of a segment from every state to every state."""
    ways = [forward([STEPS[c] for c in codes], start) for start in range(4)]
    return {"codes": codes, "costs": [c for costs, _ in ways for c in costs], "places": [o for _, order in ways for o in order],
            "illegal": sum(not _legal(a // 4, b // 4) for a, b in zip(codes, codes[1:])), "first": codes[0] // 4, "last": codes[-1] // 4}


def _four(flat: list[int]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(flat[4 * p:4 * p + 4]) for p in range(4))


def _long(facts: DataFrame, segment_bits: int) -> DataFrame:
    """Conversations of any length: turns ordered over all tasks, segments of 2^segment_bits turns, states at their borders, then the insides.

    Only the last pass takes a conversation in one task, as a stream: its digest is one
    chain over the whole repaired text, and its audit is one string.
    """
    by = [*ORDER, "salt"]  # equal turns may stand in any order
    ordered = written(facts.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
                      .select("key", "turn", "role", "text", "digest", "code", F.monotonically_increasing_id().alias("place")), "long-turns")
    firsts = ordered.groupBy("key", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    again = (F.col("code") % 4 != BLANK) & F.col("is_first").isNull()
    coded = written(ordered.select("key", "turn", "code", "place").join(firsts, "place", "left").select(
        "key", "turn", "place", F.when(again, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")).alias("code")), "long-codes")

    def fault(kind: int) -> Column:
        return F.count_if(F.col("code") % 4 == kind)

    counts = coded.groupBy("key").agg(fault(BLANK).alias("blank"), fault(DUPLICATE).alias("duplicate"), fault(TRUNCATED).alias("truncated"))
    gaps = coded.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))

    lists = coded.groupBy("key", F.shiftright("place", segment_bits).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("turns"))
    shape = pa.schema([("key", _TEXT), ("segment", _LONG), ("codes", pa.binary()), ("costs", pa.list_(_LONG)), ("places", pa.list_(_LONG)),
                       ("illegal", _LONG), ("first", _LONG), ("last", _LONG)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batched(({"key": k, "segment": s} | _segment(bytes(t["code"] for t in turns))
                                 for k, s, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True)), shape)

    segments = written(lists.mapInArrow(measure, "key string, segment bigint, codes binary, costs array<bigint>, places array<bigint>, "
                                                 "illegal bigint, first bigint, last bigint"), "segments")
    chains = segments.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("segment", "costs", "places", "illegal", "first", "last"))).alias("chain"))
    border = pa.schema([("key", _TEXT), ("segment", _LONG), ("enters", _LONG), ("leaves", _LONG), ("illegal", _LONG)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch):
            for key, chain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                states = crossings([(_four(s["costs"]), _four(s["places"])) for s in chain], 0, ENDS)
                for s, before, enters, leaves in zip(chain, [None, *chain], [0, *states], states):
                    joint = before is not None and not _legal(before["last"], s["first"])
                    yield {"key": key, "segment": s["segment"], "enters": enters, "leaves": leaves, "illegal": s["illegal"] + joint}
        for batch in batches:
            yield from _batched(rows(batch), border)

    borders = written(chains.mapInArrow(meet, "key string, segment bigint, enters bigint, leaves bigint, illegal bigint"), "segment-states")
    illegal = borders.groupBy("key").agg(F.sum("illegal").alias("illegal"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [edits(codes, enters, _only(leaves))[0] for codes, enters, leaves in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pieces, pa.list_(_TEXT))], names=["key", "segment", "pieces"])

    solved = segments.join(borders, ["key", "segment"]).select("key", "segment", "codes", "enters", "leaves").mapInArrow(
        inside, "key string, segment bigint, pieces array<string>")
    # A segment may begin late in its numbers' range: its turns are numbered from its own first one.
    begins = coded.groupBy("key", F.shiftright("place", segment_bits).alias("segment")).agg(F.min("place").alias("begin"))
    pieces = solved.join(begins, ["key", "segment"]).select("begin", F.posexplode("pieces").alias("at", "piece")).select(
        (F.col("begin") + F.col("at")).alias("place"), "piece")
    stream = (ordered.join(pieces, "place").repartition("key").sortWithinPartitions("key", "place")
              .select("key", "role", "text", (F.col("code") % 4 == TRUNCATED).alias("cut"), "piece"))
    shape_out = pa.schema([("key", _TEXT), ("cost", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, turns in _runs(batches):
                out = Repaired()
                for role, text, cut, piece in turns:
                    out.turn(piece, role, text, cut)
                yield dict(zip(("key", "audit", "cost", "repaired_sha256"), (key, *out.end()), strict=True))
        yield from _batched(rows(), shape_out, 1)

    audits = stream.mapInArrow(repair, "key string, cost bigint, audit string, repaired_sha256 string")
    return counts.join(gaps, "key").join(illegal, "key").join(audits, "key").select(*(c.split()[0] for c in RESULT.split(", ")))


def repair_conversations(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         most_turns: int = 100_000, most_bytes: int = 1 << 26, segment_bits: int = 16) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    NULL roles and texts are one space, a NULL id is a conversation as well.  Turns stand
    by number, NULL first; turns of one number by role, then by SHA-256 of the text; equal
    rows are duplicates of each other.  Other columns are not read, so their names don't
    matter.  An empty table gives no rows.

    Conversations of at most ``most_turns`` turns and ``most_bytes`` of text are solved in
    the task that their turns are sent to; longer ones over segments (``_long``).  Both
    give the same rows.
    """
    facts = _facts(turns, conversation, turn, role, text)
    sizes = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select("key"), "long-conversations")
    if long.isEmpty():
        out = _short(facts)
    else:
        out = _short(spread_join(facts, long, ["key"], "left_anti", by=["turn", "digest"])).unionByName(
            _long(spread_join(facts, long, ["key"], "left_semi", by=["turn", "digest"]), segment_bits))
    own = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(turns.schema[conversation].dataType)
    return out.select(own.alias(conversation), *(c for c in out.columns if c != "key"))


def damaged(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with faults by CRC-32 of id and number: some are lost, emptied, cut, repeated or given to the user.

    NULLs are one space, in the CRC's input as well.  Columns conversation, turn, role and text under their names.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(conversation), F.lit(":"), shown(turn))) % 20
    own_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text))
    rows = turns.select(F.col(conversation), F.col(turn), F.when(kind == 4, "user").otherwise(shown(role)).alias(role), own_text.alias(text),
                        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_times"))
    return rows.select(*rows.columns, F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_time")).drop("_times", "_time")
