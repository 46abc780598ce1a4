"""Sinks: Parquet, CSV, JSON with readable text, write-once snapshots, and the check that no source line leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import text as X


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; text is written as UTF-8, nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def freeze(df: DataFrame, path: str) -> bool:
    """Write once: False if a snapshot is there already."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException:
        return False
    return True


def leaked_lines(docs: DataFrame, outputs: DataFrame, text: str = "text", blob: str = "blob", least: int = 8) -> DataFrame:
    """Document lines of ``least`` code points or more that stand verbatim anywhere in an output; empty when private.

    A line counts wherever it stands, also inside a longer line or a JSON string; lines are stripped, as they are everywhere here.
    """
    from tabulon.operators.substrings import contained

    lines = docs.select(F.explode(X.lines(F.col(text))).alias("text"))
    return contained(lines, outputs.select(F.col(blob).alias("text")), least).withColumnRenamed("text", "line")
