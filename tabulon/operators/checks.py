"""Checks as tables: each returns the rows that break it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def corpus(df: DataFrame, key: str) -> DataFrame:
    """(rows, ids, unique): size of a corpus and whether its ids are distinct."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids")).withColumn("unique", F.col("rows") == F.col("ids"))


def unstamped(rows: DataFrame, audits: DataFrame, key: str = "probe", status: str = "DO_NOT_CITE") -> DataFrame:
    """Rows of discredited probes that do not carry the discredit."""
    bad = audits.where(F.col("status") == status).select(key)
    return rows.join(bad, key, "left_semi").where(~F.col("status").eqNullSafe(F.lit(status)))


def differing(metrics: DataFrame, published: DataFrame, key: Sequence[str], value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """Metrics that are missing or off from what was published."""
    was = published.select(*key, F.col(value).alias("published"))
    both = was.join(metrics.select(*key, F.col(value).alias("now")), [*key], "left")
    return both.where(F.col("now").isNull() | (F.abs(F.col("now") - F.col("published")) > tolerance))


def assertions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, checked, failed, held) of named conditions over the rows of a table; null counts as failed."""
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in rules.items()))
    out = df.select(F.explode(each).alias("r")).groupBy("r.rule").agg(F.count("*").alias("checked"), F.sum((~F.col("r.ok")).cast("long")).alias("failed"))
    return out.withColumn("held", F.col("failed") == 0)


def near(df: DataFrame, text: str, claim: str, correction: str, before: int = 300, after: int = 800) -> DataFrame:
    """Rows whose text makes a claim without a correction from ``before`` code points ahead of it to ``after`` behind."""
    t = F.col(text)
    at = F.instr(t, claim)
    around = F.substring(t, F.greatest(at - before, F.lit(1)), F.lit(before + after + len(claim)))
    return df.where(t.contains(claim) & ~around.contains(correction))
