"""Which short texts stand somewhere inside long ones: a substring join without a nested loop.

A short text is looked up by anchors: a few of its runs of ``WIDTH`` code points, those of least hash. Long texts are cut into all their
runs. A short text one of whose anchors is nowhere cannot be contained; of the others the rarest anchor is joined by hash
with its places, and each place is verified against the pieces of the long text that it touches. So a long text
is never copied for each short one found in it, and what is shuffled grows with the texts and not with their product. Runs of long texts that no
anchor can equal are left out before the shuffle, by a bitmap of the anchors' hashes of a fixed size: few short texts leave little of many long ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import kept

#: Code points of a run, anchors of a short text, and code points of a piece of a long text.
WIDTH, ANCHORS, PIECE = 8, 4, 4096
#: Bits of the bitmap of anchors, as a power of two: 2 MB, in 2^15 words.
BITS, WORD = 24, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` code points, by place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = (out + codes[j : j + n] + np.uint64(1)) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _bits(found: np.ndarray) -> np.ndarray:
    """The bit of each run in the bitmap."""
    return (found.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(asked: DataFrame) -> np.ndarray:
    """Which bits the runs of ``asked`` set; parts of it are made in tasks, and its size does not depend on the runs."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            held[_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        some = np.flatnonzero(held)
        parts = np.split(some, np.flatnonzero(np.diff(some // WORD)) + 1) if len(some) else []
        yield pa.RecordBatch.from_pydict({"word": pa.array([int(x[0]) // WORD for x in parts], pa.int32()), "bits": pa.array([_packed(x % WORD) for x in parts], pa.binary())})

    def either(group: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"word": group.column("word").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for r in asked.select("run").mapInArrow(words, "word int, bits binary").groupBy("word").applyInArrow(either, "word int, bits binary").collect():
        out[r["word"] * WORD // 8 : (r["word"] + 1) * WORD // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _packed(places: np.ndarray) -> bytes:
    bits = np.zeros(WORD, dtype=bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _places(width: int, most: int | None, shared: Broadcast | None = None):  # noqa: ANN202
    """(id, at, run) of every run of a text or, with ``most``, of the distinct runs of least hash; with a bitmap, of runs that it may hold."""
    names = ["id", "at", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = runs(text or "", width)
                at = np.arange(len(found))
                if most is not None:
                    found, at = np.unique(found, return_index=True)
                    found, at = found[:most], at[:most]
                if shared is not None and len(found):
                    bit = _bits(found)
                    may = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                    found, at = found[may], at[may]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, dtype=np.int64)), pa.array(at.astype(np.int64)), pa.array(found)], names=names)

    return run


def contained(short: DataFrame, long: DataFrame, least: int = WIDTH, width: int = WIDTH, anchors: int = ANCHORS, piece: int = PIECE) -> DataFrame:
    """(text): the distinct texts of ``short`` with ``least`` code points or more that are substrings of a text of ``long``.

    Both have one column ``text``. Null and shorter texts are never found. Both sides may be large, a text of either may be very
    long, and one text may be found in every other.
    """
    spark, width = short.sparkSession, min(width, max(least, 1))
    lines = short.where(F.length("text") >= max(least, 1)).select("text").distinct()
    lines = kept(lines.withColumn("id", F.monotonically_increasing_id()), "contained-short")  # numbers stand once they are written
    blobs = kept(long.where(F.length("text") >= width).select(F.monotonically_increasing_id().alias("id"), "text"), "contained-long")
    schema = "id long, at long, run long"
    asked = kept(lines.select("id", "text").mapInArrow(_places(width, anchors), schema), "contained-anchors")
    places = kept(blobs.select("id", "text").mapInArrow(_places(width, None, spark.sparkContext.broadcast(_bitmap(asked))), schema), "contained-places")
    known = places.groupBy("run").agg(F.count("*").alias("n"))
    weighed = asked.join(known, "run", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "run")).alias("best"))
    anchored = weighed.where("best.n > 0").select(F.col("id").alias("line"), F.col("best.at").alias("shift"), F.col("best.run").alias("run"))
    met = places.select("run", F.col("id").alias("blob"), "at").join(anchored, "run").select("line", "blob", (F.col("at") - F.col("shift")).alias("start")).where("start >= 0")
    size = F.length("text").cast("long")
    spread = met.join(lines.withColumnRenamed("id", "line"), "line").withColumn("size", size)
    spread = spread.withColumn("no", F.explode(F.sequence(F.floor(F.col("start") / piece), F.floor((F.col("start") + F.col("size") - 1) / piece))))
    pieces = blobs.select(F.col("id").alias("blob"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("no", "part")).withColumn("no", F.col("no").cast("long"))
    low = F.greatest(F.col("start"), F.col("no") * piece)
    high = F.least(F.col("start") + F.col("size"), (F.col("no") + 1) * piece)
    mine = F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    theirs = F.substring("part", (low - F.col("no") * piece + 1).cast("int"), (high - low).cast("int"))
    same = spread.join(pieces, ["blob", "no"], "left").select("line", "blob", "start", "size", F.coalesce(mine == theirs, F.lit(False)).alias("same"), "no")
    whole = same.groupBy("line", "blob", "start").agg(F.min("same").alias("same")).where("same").select(F.col("line").alias("id")).distinct()
    return lines.join(whole, "id", "left_semi").select("text")
