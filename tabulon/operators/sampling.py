"""Sampling by hash order: the same rows on every engine and partitioning, whatever the number of tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import digest

SEED = 42


def stratified(df: DataFrame, stratum: str | Column, key: str, n: int | Column, seed: int = SEED) -> DataFrame:
    """Up to ``n`` rows of each stratum, those whose keys hash lowest.

    Rows are first ranked within hash buckets of a stratum, so that a frequent stratum is not sorted in one task; at
    most ``n`` of each bucket then meet.
    """
    by = df[stratum] if isinstance(stratum, str) else stratum
    most = F.lit(n) if isinstance(n, int) else n
    marked = df.withColumns({"__by": by, "__h": digest(seed, F.col(key).cast("string")), "__n": most})
    marked = marked.withColumn("__b", F.substring("__h", 31, 2))
    first = marked.withColumn("__r", F.row_number().over(Window.partitionBy("__by", "__b").orderBy("__h", key))).where("__r <= __n")
    ranked = first.withColumn("__r", F.row_number().over(Window.partitionBy("__by").orderBy("__h", key)))
    return ranked.where("__r <= __n").select(*df.columns)


def long_form(df: DataFrame, stratum: str, key: str, size: str, n: int = 50, floor: int = 500, enough: int = 25, seed: int = SEED) -> DataFrame:
    """A stratified sample of long rows: above ``floor``, or from the upper quartile where fewer than ``enough`` are."""
    cuts = df.groupBy(stratum).agg(F.count(F.when(F.col(size) > floor, 1)).alias("__long"), F.percentile(size, 0.75).alias("__q75"))
    cuts = cuts.select(F.col(stratum).alias("__s"), "__long", "__q75")
    kept = df.join(cuts, F.col(stratum).eqNullSafe(F.col("__s")))
    kept = kept.where(F.when(F.col("__long") >= enough, F.col(size) > floor).otherwise(F.col(size) >= F.col("__q75"))).select(*df.columns)
    return stratified(kept, stratum, key, n, seed)


#: Keys of one block, whose rows one task numbers.
BLOCK = 4096


def running(df: DataFrame, by: Sequence[str], key: str, weight: Column | None = None, name: str = "place") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before it in its group, by an integer key; without a weight, its place from 0.

    Sums are taken within blocks of keys and over the blocks, so that no window holds a group: a row for BLOCK keys at most.
    """
    w = F.lit(1) if weight is None else weight
    cols = df.withColumns({"__b": F.floor(F.col(key) / BLOCK), "__w": w.cast("long")})
    before = lambda parts, order: Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cols.groupBy(*by, "__b").agg(F.sum("__w").alias("__s"))
    bases = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__b").alias("__block"), F.coalesce(F.sum("__s").over(before(by, "__b")), F.lit(0)).alias("__base"))
    within = cols.withColumn("__in", F.coalesce(F.sum("__w").over(before([*by, "__b"], key)), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__b").eqNullSafe(F.col("__block"))]
    return within.join(bases, same).select(*df.columns, (F.col("__base") + F.col("__in")).alias(name))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to a given number of tasks: rows are small and their work is not, so they would be put together in a few otherwise."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parity(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """``half``: 0 for even and 1 for odd places within a stratum, by key."""
    return running(df, [stratum], key, name="half").withColumn("half", F.pmod("half", F.lit(2)))


def top(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by an order that leaves no ties open."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def draws(stream: DataFrame, group: str, reps: int, size: Column | None = None, length: Column | int | None = None, seed: int = SEED) -> DataFrame:
    """(group, rep, start, len): contiguous blocks of equal length of ordered streams, ``reps`` of each, a row a block.

    Length is that of the shortest stream unless given; ``size`` sums a stream's rows up to its length, which are counted
    otherwise. Starts come from a hash.
    """
    from tabulon.functions.stats import uniform

    sizes = stream.groupBy(group).agg((F.count("*") if size is None else size).alias("n"))
    if length is None:
        sizes = sizes.crossJoin(sizes.agg(F.min("n").alias("len")))
    else:
        sizes = sizes.withColumn("len", F.lit(length) if isinstance(length, int) else length)
    drawn = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    room = F.greatest(F.col("n") - F.col("len"), F.lit(0))
    return drawn.select(group, "rep", F.floor(uniform(seed, F.col("rep").cast("string"), F.col(group)) * room).cast("long").alias("start"), F.col("len").cast("long").alias("len"))


def blocks(stream: DataFrame, group: str, seq: str, reps: int, length: Column | int | None = None, seed: int = SEED) -> DataFrame:
    """Rows of contiguous blocks of equal length from ordered streams (``draws``): (group, rep, seq, ...); ``seq`` counts from 0 in each group."""
    drawn = draws(stream, group, reps, length=length, seed=seed).select(F.col(group).alias("__g"), "rep", F.col("start").alias("__start"), F.col("len").alias("__len"))
    inside = (F.col(group) == F.col("__g")) & (F.col(seq) >= F.col("__start")) & (F.col(seq) < F.col("__start") + F.col("__len"))
    # a row a group and draw; joined by group in a shuffle, a group would meet in one task
    return stream.join(F.broadcast(drawn), inside).drop("__g", "__start", "__len")
