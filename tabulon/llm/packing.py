"""Best-fit packing of documents into sequences of a fixed capacity, planned on the histogram of lengths.

A plan depends on how many pieces have each length, not on which ones: at most ``capacity`` counts reach the
driver, whatever the size of the corpus. The plan is made in two steps.

1. Pattern packing. Lengths fall into classes, each named by its longest member (with few lengths, each its own);
   a pattern is a class or a pair of classes, completed by the largest classes that still fit, of a few documents in
   all. Non-negative least squares fits repeat counts of the patterns to the histogram; the counts are rounded, held to
   what is there, and filled with real lengths, longest first, the last part with the longest that fits the room left.
2. Residuals. Lengths that no pattern took go, longest first, to the tightest gap that holds them (gaps of patterns
   included), or to new sequences. Equal sequences are handled together, so this too costs by distinct lengths.

The plan is a table of intervals: "the pieces of length L with ranks a .. b go to these sequences at this offset". Its
size is bounded by the capacity, so it is broadcast. Spark ranks the pieces of each length in salted groups.
"""

from __future__ import annotations

import itertools
import warnings
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulon.llm.common import cut, partitions, table, without
from tabulon.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Fits to try: numbers of size classes, and the share of the capacity below which a piece is in no pattern but
#: kept for the gaps. The fit with the fewest sequences is used, of equal ones the first.
FITS = ((48, 0.02), (96, 0.05), (96, 0.1), (96, 0.25), (96, 0.4))
#: Ranks of pieces of one length stay below this.
_RANKS = 1 << 46


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set; warns if it has not settled after ``steps``."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[columns] = solved
                break
            bad = solved <= 0
            now = x[columns]
            step = (now[bad] / np.maximum(now[bad] - solved[bad], 1e-300)).min()
            x[columns] = np.maximum(now + step * (solved - now), 0)
            active[columns[bad & (x[columns] <= 1e-12)]] = False
            x[~active] = 0
            if not active.any():
                break
    else:
        warnings.warn(f"least squares have not settled after {steps} steps", stacklevel=2)
    return x


def patterns(sizes: list[int], capacity: int, parts: int) -> list[tuple[int, ...]]:
    """Falling ways to fill ``capacity`` with at most ``parts`` of the sizes: every one and every pair, completed by the largest that fit."""

    def completed(way: tuple[int, ...]) -> tuple[int, ...]:
        room = capacity - sum(way)
        while len(way) < parts and (at := bisect_right(sizes, room)):
            way = (*way, sizes[at - 1])
            room -= sizes[at - 1]
        return tuple(sorted(way, reverse=True))

    sizes = sorted(sizes)
    pairs = ((a, b) for i, a in enumerate(sizes) for b in sizes[: i + 1] if a + b <= capacity)
    return sorted({completed(way) for way in itertools.chain(((a,) for a in sizes if a <= capacity), pairs)})


class _Bins:
    """Open sequences: groups of equal ones, by the room that is left in each."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
        self.full: list[tuple[int, tuple]] = []
        #: Pieces that patterns placed.
        self.in_patterns = 0

    def add(self, room: int, copies: int, slots: tuple) -> None:
        if room == 0:
            self.full.append((copies, slots))
            return
        if not self.groups[room]:
            insort(self.rooms, room)
        self.groups[room].append((copies, slots))

    def take(self, length: int) -> tuple[int, int, tuple] | None:
        """The group with the least room for ``length``."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        copies, slots = self.groups[room].pop()
        if not self.groups[room]:
            del self.rooms[at]
        return room, copies, slots

    def all(self) -> Iterator[tuple[int, tuple]]:
        yield from self.full
        for room in self.rooms:
            yield from self.groups[room]


def _classes(left: dict[int, int], most: int) -> dict[int, int]:
    """The class of each length, named by its longest member: at most ``most`` runs of lengths with about equal counts of ids."""
    total, out, run, held = sum(x * n for x, n in left.items()), {}, [], 0
    for x in sorted(left):
        run.append(x)
        held += x * left[x]
        if held * most >= total or len(left) <= most:
            out |= dict.fromkeys(run, x)
            run, held = [], 0
    return out | dict.fromkeys(run, run[-1] if run else 0)


def _fill_patterns(left: dict[int, int], capacity: int, classes: int, small: int, parts: int, bins: _Bins) -> int:
    """Fits the patterns and fills them with lengths, largest first; how many pieces they took.

    The last part of a pattern may be any length that is left: the largest that fits the room that real lengths leave.
    """
    named = _classes({x: n for x, n in left.items() if x >= small}, classes)
    queues: dict[int, list[int]] = defaultdict(list)
    for length in sorted(named):
        queues[named[length]].append(length)  # the longest at the end, where they are taken
    rows = {c: i for i, c in enumerate(sorted(queues))}
    ways = patterns(list(rows), capacity, parts)
    if not ways:
        return 0
    a = np.zeros((len(rows), len(ways)))
    for j, way in enumerate(ways):
        for c in way:
            a[rows[c], j] += 1
    weight = np.array(sorted(queues), dtype=float)[:, None]
    b = np.array([sum(left[x] for x in queues[c]) for c in sorted(queues)], dtype=float)
    # a row for the capacity that patterns waste, so that of equal fits the fuller patterns are taken
    waste = np.array([[capacity - sum(way) for way in ways]], dtype=float)
    counts = np.rint(nnls(np.vstack([a * weight, waste]), np.append(b * weight[:, 0], 0.0))).astype(np.int64)
    known, placed = sorted(named), 0  # lengths of which some are left
    for j in sorted(np.flatnonzero(counts).tolist(), key=lambda j: (capacity - sum(ways[j]), j)):
        way, repeats = ways[j], int(counts[j])
        while repeats:
            lengths: list[int] = []
            for c in way[: max(1, len(way) - 1)]:
                used = Counter(lengths)
                found = next((x for x in reversed(queues[c]) if left[x] > used[x]), None)
                if found is None:
                    break
                lengths.append(found)
            else:
                room = capacity - sum(lengths)
                if len(way) > 1:
                    used = Counter(lengths)
                    at = bisect_right(known, room) - 1
                    while at >= 0 and left[known[at]] <= used[known[at]]:
                        at -= 1
                    if at >= 0:
                        lengths.append(known[at])
            if len(lengths) < len(way):
                break
            copies = min(repeats, *(left[x] // n for x, n in Counter(lengths).items()))
            slots: tuple = ()
            for x in lengths:
                left[x] -= copies
                slots = (x, 1, slots)
            for x in set(lengths):
                if not left[x]:
                    queues[named[x]].remove(x)
                    known.pop(bisect_left(known, x))
            bins.add(capacity - sum(lengths), copies, slots)
            repeats -= copies
            placed += copies * len(lengths)
    return placed


def _fit(histogram: dict[int, int], capacity: int, classes: int, small: float, parts: int) -> _Bins:
    left, bins = dict(histogram), _Bins()
    bins.in_patterns = _fill_patterns(left, capacity, classes, max(1, round(small * capacity)), parts, bins)
    for length in sorted((x for x in left if left[x]), reverse=True):
        count = left[length]
        while count:
            if found := bins.take(length):
                room, copies, slots = found
                if copies > count:
                    bins.add(room, copies - count, slots)
                    copies = count
                bins.add(room - length, copies, (length, 1, slots))
                count -= copies
            else:
                each = min(capacity // length, count)
                copies = count // each
                bins.add(capacity - each * length, copies, (length, each, ()))
                count -= copies * each
    return bins


def plan(histogram: dict[int, int], capacity: int, fits: tuple = FITS, parts: int = 4) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, sequences, first sequence, offset), by length and rank.

    ``histogram`` counts lengths from 1 to ``capacity``; ``parts`` is how many documents a pattern may hold.
    """
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    tried = [_fit(counts, capacity, classes, small, parts) for classes, small in fits]
    bins = min(tried, key=lambda x: sum(copies for copies, _ in x.all()))
    rows, ranks, sequence = [], defaultdict(int), 0
    for copies, slots in bins.all():
        order = []
        while slots:
            order.append(slots[:2])
            slots = slots[2]
        offset = 0
        for length, each in reversed(order):
            rows.append((length, ranks[length], each, copies, sequence, offset))
            ranks[length] += each * copies
            offset += each * length
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(df: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``: rows packed into few sequences of at most ``capacity``.

    Rows of one length are interchangeable to the plan; ``order`` names the columns that rank them, so that a lost
    task gives the same places when it is run again (rows that agree in all of them must be equal). Places in a
    sequence are gapless from 0. Rows whose length is null, below 1 or above ``capacity`` get null in both columns. Columns of these names
    in the input are replaced. ``df`` is computed once and kept in the checkpoint folder.
    """
    df = cut(without(df, ["sequence_id", "offset"]))
    spark = df.sparkSession
    fits = F.col(length).between(1, capacity)
    counted = df.where(fits).groupBy(F.col(length).cast("long").alias("length")).count().collect()
    rows = plan({r["length"]: r["count"] for r in counted}, capacity)
    keys = rows[:, 0] * _RANKS + rows[:, 1]
    shared = spark.sparkContext.broadcast((keys, rows))

    def salted(d: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64(*order), F.lit(partitions(spark)))
        return d.withColumns({"__salt": salt, "__length": F.when(fits, F.col(length).cast("long"))})

    group = ["__length", "__salt"]
    before = Window.partitionBy("__length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted(df).groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    ranked = salted(df).withColumn("__row", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    same = [ranked[c].eqNullSafe(bases[c]) for c in group]
    ranked = ranked.join(bases, same, "left").select(*(ranked[c] for c in [*df.columns, "__length"]), (F.col("__row") - 1 + F.col("__base")).alias("__rank"))

    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = list(to_arrow_schema(schema).names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            lengths = batch.column(batch.num_columns - 2)
            there = np.asarray(lengths.is_valid())
            n = np.asarray(lengths.fill_null(0), dtype=np.int64)
            rank = np.asarray(batch.column(batch.num_columns - 1).fill_null(0), dtype=np.int64)
            sequence = offset = np.zeros(len(n), dtype=np.int64)
            if len(rows):
                row = rows[np.maximum(np.searchsorted(keys, n * _RANKS + rank, side="right") - 1, 0)]
                nth, slot = np.divmod(rank - row[:, 1], row[:, 2])
                sequence, offset = row[:, 4] + nth, row[:, 5] + slot * n
            out = [pa.array(x, pa.int64(), mask=~there) for x in (sequence, offset)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + out, names=names)

    return ranked.mapInArrow(place, schema)


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text counts as empty; ``end_id`` closes every document, so each has a piece. Only documents of more than
    ``capacity`` ids are cut. Repeated rows give repeated pieces; other columns of ``docs`` are left out.
    """
    fields = [T.StructField(key, docs.schema[key].dataType)]
    fields += [T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    last, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(x or "") + last
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = [k, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    row += [np.frombuffer(part, "<u4").astype(np.int32)] * with_ids
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def sequences(packed: DataFrame, ids: str = "ids", extra: Column | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids)))
    return packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p[ids])).alias(ids))


PLACES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes; see ``token_pieces`` and ``pack``."""
    pieces = token_pieces(docs, path or tokenizer_path("word_bpe_49k.json"))
    return pack(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"]).select(*PLACES)


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
