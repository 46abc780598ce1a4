"""Closed-form statistics as Column expressions, and exact small-sample tests on the driver's side of an aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.arrays import let, let_all

Z95 = 1.96


def uniform(*parts: Column | str) -> Column:
    """A reproducible draw in [0, 1) from the hash of its parts, the same on every engine and partitioning."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def digest(*parts: Column | str) -> Column:
    """An order for reproducible shuffles."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """(low, high) of Wilson's interval for a share, held to [0, 1]; null for n = 0."""
    share, d = k / n, 1 + z * z / n
    mid = (share + z * z / (2 * n)) / d
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / d
    both = F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))
    return F.when(n > 0, both)


def permutation_p(hits: Column, n: Column) -> Column:
    """(r + 1) / (n + 1): never 0."""
    return (hits + 1) / (n + 1)


def two_sided(upper: Column, lower: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.least(upper, lower))


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str] = (), tie: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """``df`` with step-up adjusted p values within each family; null p values stay null and do not count.

    Families are small tables of tests, so a window holds one.
    """
    some = F.col(p).isNotNull()
    by = Window.partitionBy(*family, some)
    up = by.orderBy(F.col(p).asc(), *tie)
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count("*").over(by))
    down = by.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down))
    return ranked.withColumn(name, F.when(some, adjusted)).drop("__rank", "__m")


def log_factorial(n: Column) -> Column:
    """ln n!: a sum of logarithms up to 32, Stirling's series above, whose error is below a double's there."""

    def of(n: Column) -> Column:
        few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
        series = n * F.log(n) - n + F.log(n * (2 * math.pi)) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
        return F.when(n <= 32, few).otherwise(series)

    return let(n.cast("double"), of)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test, ties left out beforehand; 1 when nothing is left.

    The tail is summed from its largest term down; terms more than six roots of n below it are under e^-72 of it, less than a double holds.
    """

    def tail(n: Column, k: Column) -> Column:
        least = F.greatest(F.lit(0).cast("long"), k - F.ceil(6 * F.sqrt(n.cast("double"))) - 10)
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def step(acc: Column, i: Column) -> Column:
            term = acc["term"] * i / (n - i + 1)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        below = F.when(k > least, F.sequence(k, least + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        largest = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
        return F.exp(largest) * F.aggregate(below, start, step, lambda acc: acc["sum"])

    def p(n: Column, k: Column) -> Column:
        return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail(n, k)))

    return let_all(p, n=(wins + losses).cast("long"), k=F.least(wins, losses).cast("long"))


def _ranks(values: Sequence[float]) -> list[int]:
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    out = [0] * len(values)
    for rank, i in enumerate(order):
        out[i] = rank
    return out


def spearman_exact(xs: Sequence[float], ys: Sequence[float]) -> tuple[float, float, float]:
    """Rank correlation with its exact two-sided and upper one-sided p over all orders; for a handful of aggregated rows."""
    n = len(xs)
    if n < 3 or n > 9:
        raise ValueError("exact Spearman takes 3 to 9 pairs")
    a, b = _ranks(xs), _ranks(ys)

    def rho(r: Sequence[int]) -> float:
        return 1 - 6 * sum((x - y) ** 2 for x, y in zip(a, r, strict=True)) / (n * (n * n - 1))

    seen = rho(b)
    every = [rho(p) for p in permutations(range(n))]
    two = sum(abs(r) >= abs(seen) - 1e-12 for r in every) / len(every)
    return seen, two, sum(r >= seen - 1e-12 for r in every) / len(every)


def primes(low: int, high: int) -> list[int]:
    return [n for n in range(max(low, 2), high + 1) if all(n % d for d in range(2, math.isqrt(n) + 1))]
