"""Repair of the turn structure of conversations, at the least cost of edits.

A conversation should read as an optional system turn and then pairs of user and assistant. The cheapest edits come from a
dynamic program over (row, grammar state): ``costs to go`` are found from the last row back, then a walk from the first row
forward takes, of the edits that keep to the least cost, the one whose initial is least in ASCII order. Since the state
fixes which role an edit may give, the initials alone tell the repaired turns.

Rows are range-partitioned in the order of their conversations. A conversation that lies within a partition is repaired
there. What a border cuts, and any conversation larger than ``FRAGMENT``, is worked on in fragments: one sums up as a
matrix of least costs from state to state, fragments' matrices are chained per conversation, and each fragment then walks
from the state it is entered in. So no task holds a conversation's rows; only the audit itself and the running digest of the
repaired text, which is sequential by definition, come together in one place, in order and piece by piece.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabulon.llm.common import cut, partitions, table

#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; where the grammar may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: For each state, the state after a user or assistant turn, whichever it must be, and its role.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = (None, None, "user", "assistant")
#: For each initial, the states in which it may follow and the state it leads to.
_FOLLOWS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
_LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Rows and characters of a fragment; code points of a text that set its place before its hash does.
FRAGMENT_ROWS, FRAGMENT_CHARS, PREFIX = 50_000, 4_000_000, 64
_SPACES = " \t\n\x0b\x0c\r"


def fault(text: str) -> int:
    """1 for a blank text, 2 for one that does not end a sentence, 0 else."""
    whole = text.rstrip(_SPACES)
    return 1 if not whole else 0 if whole[-1] in ".!?" else 2


def digest(conv: int | None, role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{conv}:{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def back(initial: str, kind: int, after: list[int]) -> list[int]:
    """Costs to go before a row, by state, from those after it. ``kind``: 1 must go, 2 truncated, 0 sound."""
    out = [DELETE + c for c in after]
    if kind != 1:
        stays = TRUNCATED if kind == 2 else 0
        states, to = _FOLLOWS.get(initial, ((), 0))
        for q in range(4):
            out[q] = min(out[q], REROLE + stays + after[TURN[q]])
            if q in states:
                out[q] = min(out[q], stays + after[to])
    return inserted(out)


def inserted(costs: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first; two in a row lead from either of these states to itself or the other."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(start, INSERT + user), min(system, INSERT + user), user, assistant]


def final() -> list[int]:
    return inserted([0 if q in ENDS else FAR for q in range(4)])


def forward(initial: str, kind: int, state: int, here: list[int], after: list[int]) -> tuple[str, int]:
    """The edits around one row, least in ASCII order among the cheapest, and the state they lead to."""
    edits, stays = "", TRUNCATED if kind == 2 else 0
    states, to = _FOLLOWS.get(initial, ((), 0))
    left = here[state]
    while True:
        if DELETE + after[state] == left:
            return edits + "D", state
        if INSERT + here[TURN[state]] == left:
            edits, state = edits + "I", TURN[state]
            left = here[state]
        elif kind != 1 and state in states and stays + after[to] == left:
            return edits + "K", to
        else:
            return edits + "R", TURN[state]


class Fragment(NamedTuple):
    """Rows of one conversation in order; ``again`` holds the places of texts that came earlier with the same role."""

    turns: list[int | None]
    roles: list[str]
    texts: list[str]
    copies: list[int]
    again: set[int]

    def rows(self) -> list[tuple[str, int, bool]]:
        """(role's initial, kind for the program, duplicate) of every row, copies one by one."""
        out = []
        for i, (role, text, copies) in enumerate(zip(self.roles, self.texts, self.copies, strict=True)):
            bad = fault(text)
            for n in range(copies):
                again = bad != 1 and (n > 0 or i in self.again)
                out.append((role[:1], 1 if again else bad, again))
        return out

    def spread(self) -> tuple[int | None, int | None, int]:
        """Least and greatest turn and how many there are; rows are in order of turn, nulls first."""
        known = [t for t, n in zip(self.turns, self.copies, strict=True) if n and t is not None]
        return (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:], strict=False))) if known else (None, None, 0)


Rows = list[tuple[str, int, bool]]


def togo(rows: Rows, after: list[int]) -> list[list[int]]:
    """Costs to go before each row and, last, ``after``."""
    out = [after]
    for initial, kind, _ in reversed(rows):
        out.append(back(initial, kind, out[-1]))
    out.reverse()
    return out


def matrix(rows: Rows) -> list[int]:
    """Least costs from state to state over a fragment's rows, as 4 x 4 with a row for each state it is entered in."""
    ends = [togo(rows, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
    return [min(ends[end][start], FAR) for start in range(4) for end in range(4)]


def edits_of(rows: Rows, state: int, costs: list[list[int]]) -> tuple[list[str], int]:
    """Edits around each row and the state they lead to."""
    out = []
    for n, (initial, kind, _) in enumerate(rows):
        edits, state = forward(initial, kind, state, costs[n], costs[n + 1])
        out.append(edits)
    return out, state


def rebuilt(fragment: Fragment, edits: list[str], state: int) -> list[str]:
    """The turns that the edits leave, as role:text."""
    turns, n = [], 0
    for role, text, copies in zip(fragment.roles, fragment.texts, fragment.copies, strict=True):
        for _ in range(copies):
            for edit in edits[n]:
                if edit in "IR":
                    state = TURN[state]
                    turns.append(f"{ROLE[state]}:{text if edit == 'R' else ''}")
                elif edit == "K":
                    state = _FOLLOWS[role[0]][1]
                    turns.append(f"{role}:{text}")
            n += 1
    return turns


def ended(state: int) -> tuple[str, list[str]]:
    """Insertions after the last row, and their turns."""
    turns = []
    while state not in ENDS:
        state = TURN[state]
        turns.append(f"{ROLE[state]}:")
    return "I" * len(turns), turns


def tallies(rows: Rows) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and adjacent roles that may not follow each other."""
    again, lost, short = sum(r[2] for r in rows), sum(r[1] == 1 for r in rows), sum(r[1] == 2 for r in rows)
    return lost - again, again, short, sum(a[0] + b[0] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))


def whole(fragment: Fragment) -> tuple:
    """The result columns of a conversation that is one fragment."""
    rows = fragment.rows()
    costs = togo(rows, final())
    edits, state = edits_of(rows, START, costs)
    more, turns = ended(state)
    text = "\n".join([*rebuilt(fragment, edits, START), *turns])
    low, high, distinct = fragment.spread()
    gaps = high - low + 1 - distinct if distinct else 0
    return gaps, *tallies(rows), costs[0][START], "".join(edits) + more, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_SUMS = ["blank", "duplicate", "truncated", "illegal"]
_COUNTS = ["gaps", *_SUMS, "cost"]
_WHOLE = ", ".join([*(f"{n} long" for n in _COUNTS), "audit string, repaired_sha256 string"])
_PART = "part long, low long, high long, distinct_turns long, head string, tail string, turns array<long>, roles array<string>, texts array<string>, copies array<long>, again array<long>, fresh array<long>, digests array<binary>"
_HEAD = ["conv_id", "part", "low", "high", "distinct_turns", "head", "tail"]


class _Rows:
    """Rows on their way out, as one Arrow batch at a time."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.held = schema, {n: [] for n in schema.names}

    def add(self, **values: Any) -> None:
        for n, column in self.held.items():
            column.append(values.get(n))

    def __len__(self) -> int:
        return len(self.held["conv_id"])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.held[f.name], f.type) for f in self.schema], schema=self.schema)
        for column in self.held.values():
            column.clear()
        return out


def _first_pass(schema: pa.Schema, most_rows: int, most_chars: int):  # noqa: ANN202
    """For sorted partitions: results of conversations that lie within, and fragments (part is not null) of the others.

    A partition cannot know whether its first and last conversation go on elsewhere, so these become fragments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = itertools.count(TaskContext.get().partitionId() << 32)
        out, key, begun, cut_up = _Rows(schema), None, False, True  # the first conversation may have begun elsewhere
        turns: list[int | None] = []
        roles, texts, copies, size, waiting = [], [], [], 0, 0

        def taken() -> Fragment:
            nonlocal turns, roles, texts, copies, size
            seen, again = set(), set()
            for i, (role, text, n) in enumerate(zip(roles, texts, copies, strict=True)):
                if n:
                    again.update([i] if (role, text) in seen else ())
                    seen.add((role, text))
            made = Fragment(turns, roles, texts, copies, again)
            turns, roles, texts, copies, size = [], [], [], [], 0
            return made

        def fragment() -> None:
            nonlocal waiting
            waiting += size
            f = taken()
            rows = f.rows()
            low, high, distinct = f.spread()
            fresh = [i for i, n in enumerate(f.copies) if n and i not in f.again]
            known = {"conv_id": key, "part": next(parts), "low": low, "high": high, "distinct_turns": distinct, "head": rows[0][0] if rows else None, "tail": rows[-1][0] if rows else None}
            out.add(**known, **f._asdict() | {"again": sorted(f.again)}, fresh=fresh, digests=[digest(key, f.roles[i], f.texts[i]) for i in fresh])

        for batch in batches:
            for conv, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != key:
                    if cut_up:
                        fragment()
                    else:
                        out.add(conv_id=key, **dict(zip([*_COUNTS, "audit", "repaired_sha256"], whole(taken()), strict=True)))
                    cut_up = False
                elif len(turns) >= most_rows or size >= most_chars:
                    cut_up = True
                    fragment()
                key, begun, size = conv, True, size + len(role) + len(text)
                for column, value in ((turns, turn), (roles, role), (texts, text), (copies, n)):
                    column.append(value)
                if len(out) >= 500 or waiting >= most_chars:
                    waiting = 0
                    yield out.batch()
        if begun:
            fragment()
        yield out.batch()

    return run


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Fragment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Fragment(row["turns"], row["roles"], row["texts"], row["copies"], {*row["again"], *(row["elsewhere"] or ())})


def _summaries(schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for row, f in _fragments(batches):
            rows = f.rows()
            out.add(**{n: row[n] for n in _HEAD}, costs=matrix(rows), **dict(zip(_SUMS, tallies(rows), strict=True)))
            yield out.batch()

    return run


def _chained(schema: pa.Schema):  # noqa: ANN202
    """For the summaries of one conversation: the costs to go behind each fragment, and with the first the conversation's counts."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        behind = [final()]
        for r in reversed(rows):
            behind.append([min(FAR, *(r["costs"][q * 4 + end] + behind[-1][end] for end in range(4))) for q in range(4)])
        behind.reverse()
        counts = {n: sum(r[n] for r in rows) for n in _SUMS}
        tail = low = high = None
        distinct = 0
        for r in rows:
            if r["head"] is not None:
                counts["illegal"] += tail is not None and tail + r["head"] not in _LEGAL
                tail = r["tail"]
            if r["low"] is not None:
                distinct += r["distinct_turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        counts |= {"gaps": high - low + 1 - distinct if distinct else 0, "cost": behind[0][START]}
        made = [{"conv_id": r["conv_id"], "part": r["part"], "after": behind[i + 1], "last": i + 1 == len(rows)} | (counts if i == 0 else {}) for i, r in enumerate(rows)]
        return pa.Table.from_pylist(made, schema=schema)

    return run


def _ends(schema: pa.Schema):  # noqa: ANN202
    """For each state that a fragment may be entered in, the one that its cheapest edits lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for row, f in _fragments(batches):
            rows = f.rows()
            costs = togo(rows, row["after"])
            out.add(conv_id=row["conv_id"], part=row["part"], ends=[edits_of(rows, q, costs)[1] if costs[0][q] < FAR else q for q in range(4)])
            yield out.batch()

    return run


def _entered(schema: pa.Schema):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        state, made = START, []
        for r in sorted(group.to_pylist(), key=lambda r: r["part"]):
            made.append({"part": r["part"], "state": state})
            state = r["ends"][state]
        return pa.Table.from_pylist(made, schema=schema)

    return run


def _walked(schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for row, f in _fragments(batches):
            rows = f.rows()
            edits, state = edits_of(rows, row["state"], togo(rows, row["after"]))
            turns, more = rebuilt(f, edits, row["state"]), ""
            if row["last"]:
                more, added = ended(state)
                turns += added
            out.add(**{n: row[n] for n in ("conv_id", "part", *_COUNTS)}, audit="".join(edits) + more, turns_made=len(turns), body="\n".join(turns))
            yield out.batch()

    return run


def _joined(schema: pa.Schema):  # noqa: ANN202
    """For partitions sorted by conversation and part: audits put together, and the digest carried on from part to part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, audit, sha, any_turn = _Rows(schema), None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["cost"] is not None:  # a conversation's first part has its counts
                    if known:
                        out.add(**known, audit="".join(audit), repaired_sha256=sha.hexdigest())
                    known, audit, sha, any_turn = {n: row[n] for n in ("conv_id", *_COUNTS)}, [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["turns_made"]:
                    sha.update((("\n" if any_turn else "") + row["body"]).encode("utf-8", "surrogatepass"))
                    any_turn = True
            yield out.batch()
        if known:
            out.add(**known, audit="".join(audit), repaired_sha256=sha.hexdigest())
        yield out.batch()

    return run


def ordered(turns: DataFrame, most_rows: int) -> DataFrame:
    """Rows in the order of their conversations, dealt to range partitions.

    Within a conversation: by turn, nulls first, then role, then text. Where texts of one turn and role agree in their first ``PREFIX``
    code points, a hash stands before the text, so that what is compared for the borders stays short. Equal rows may lie on either side of a border.
    """
    rows = turns.withColumns({"prefix": F.substring("text", 1, PREFIX), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "prefix", "hash"]
    return rows.repartitionByRange(partitions(turns.sparkSession), *order, "salt").sortWithinPartitions(*order, "text", "salt").select("conv_id", "turn", "role", "text", "copies")


def repair(turns: DataFrame, most_rows: int = FRAGMENT_ROWS, most_chars: int = FRAGMENT_CHARS) -> DataFrame:
    """One row for each conversation: faults, the least cost of edits, the edits, and the digest of the repaired turns.

    ``turns`` has conv_id and turn (integers), role, text and copies, how often the row stands there in a row; 0 lets a
    conversation be known that has no rows, which gives zeros, an empty audit and the digest of nothing. A null conv_id is a
    conversation like others, null turns come first; role and text must not be null. Repeated rows are duplicates. A role that is empty or
    has another initial than s, u and a fits nowhere. Other columns are left out; an empty table gives no rows.
    """
    spark = turns.sparkSession
    key = turns.schema["conv_id"].dataType.simpleString()

    def arrow(columns: str) -> pa.Schema:
        return to_arrow_schema(StructType.fromDDL(columns))

    def mapped(df: DataFrame, make, columns: str) -> DataFrame:  # noqa: ANN001
        return df.mapInArrow(make(arrow(columns)), columns)

    first = f"conv_id {key}, {_WHOLE}, {_PART}"
    sorted_ = ordered(turns, most_rows)
    made = cut(sorted_.mapInArrow(_first_pass(arrow(first), most_rows, most_chars), first))
    results = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    some = made.where("part IS NULL").select(*results)
    cut_up = made.where("part IS NOT NULL").drop(*results[1:])
    # a text is told by its digest: where fragments share one, it is new in the first of them only
    places = cut_up.select("part", F.explode(F.arrays_zip("fresh", "digests")).alias("x")).select("part", "x.fresh", F.col("x.digests").alias("digest"))
    shared = places.groupBy("digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    elsewhere = places.join(shared, "digest").where("part <> first").groupBy("part").agg(F.collect_list("fresh").alias("elsewhere"))
    flagged = cut(cut_up.drop("fresh", "digests").join(elsewhere, "part", "left"))
    summary = ", ".join([f"conv_id {key}, part long, low long, high long, distinct_turns long, head string, tail string, costs array<long>", *(f"{n} long" for n in _SUMS)])
    counts = ", ".join(f"{n} long" for n in _COUNTS)
    chain = f"conv_id {key}, part long, after array<long>, last boolean, {counts}"
    chained = cut(mapped(flagged, _summaries, summary).groupBy("conv_id").applyInArrow(_chained(arrow(chain)), chain))
    known = flagged.join(chained.drop("conv_id"), "part")
    ends = mapped(known, _ends, f"conv_id {key}, part long, ends array<long>")
    entered = ends.groupBy("conv_id").applyInArrow(_entered(arrow("part long, state long")), "part long, state long")
    walked = mapped(known.join(entered, "part"), _walked, f"conv_id {key}, part long, {counts}, audit string, turns_made long, body string")
    joined = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return some.unionByName(mapped(joined, _joined, f"conv_id {key}, {_WHOLE}"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage of their key's checksum: dropped, emptied, without stops, repeated, or given to the user.

    Nulls count as one space, in the key as in role and text. A dropped row stays with no copies, so that its conversation is known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(n == 1, "").when(n == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(n == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(n == 0, 0).when(n == 3, 2).otherwise(1).cast("long").alias("copies"))
    gone = F.col("copies") == 0
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), *(F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")), "copies")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
