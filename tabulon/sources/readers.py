"""Sources: Parquet tables, split corpora, zipped JSON trees, commit logs, tool transcripts, Markdown and vectors."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.operators.ranks import ranked

LEMMAS = "member string, pnum string, line_no int, tok_no int, form string, cf string, gw string, pos string"


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A Parquet table of a folder; with ``columns``, only those are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet splits read as one table with a ``split`` column; columns that a split lacks are null."""
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, written from ``build`` first if it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def _lemmas(node: object, line: list[int], out: list[tuple], ordered: bool) -> None:
    if isinstance(node, list):
        for x in node:
            _lemmas(x, line, out, ordered)
    elif isinstance(node, dict):
        if node.get("node") == "d" and node.get("type") == "line-start":
            line[0] += 1
        f = node.get("f")
        if isinstance(f, dict) and "form" in f and (not ordered or node.get("node") == "l"):
            out.append((line[0], f.get("form"), f.get("cf"), f.get("gw"), f.get("pos")))
        for k, x in node.items():
            if k != "f":
                _lemmas(x, line, out, ordered)


def lemma_zip(spark: SparkSession, path: str, members: str = r"\.json$", ordered: bool = False) -> DataFrame:
    """Lemma tokens of JSON trees in zip archives: (member, pnum, line_no, tok_no, form, cf, gw, pos).

    Archives and members that cannot be read are skipped. ``ordered`` takes only lemma nodes and numbers lines at
    line-start nodes; otherwise every node with a form counts. ``pnum`` is the member's file name without extension.
    """
    import re

    wanted = re.compile(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if not wanted.search(name):
                        continue
                    try:
                        tree = json.loads(archive.read(name))
                    except (ValueError, zipfile.BadZipFile, RuntimeError):
                        continue
                    found: list[tuple] = []
                    _lemmas(tree, [-1], found, ordered)
                    pnum = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    rows += [(name, pnum, line, n, *rest) for n, (line, *rest) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEMMAS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, LEMMAS)


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(msg, lines) of a saved log whose messages are separated by U+0001; messages without lines are dropped.

    Messages are numbered from 0 by file and digest of their lines, which does not depend on how files are split; equal messages
    of a file follow each other.
    """
    raw = spark.read.option("lineSep", "\x01").text(path).select(F.col("_metadata.file_path").alias("file"), X.lines(F.col("value")).alias("lines"))
    some = raw.where(F.size("lines") > 0).withColumns({"digest": F.sha2(F.array_join("lines", "\n"), 256), "tie": F.monotonically_increasing_id()})
    return ranked(some, [], [F.col("file"), F.col("digest"), F.col("tie")], "at").select((F.col("at") - 1).alias("msg"), "lines")  # the tie deals copies to several tasks


TRANSCRIPT = "message struct<content:array<struct<type:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>>>"


def _clipped(text: Column, most: int, width: int) -> Column:
    return F.slice(F.transform(X.lines(text), lambda x: F.substring(x, 1, width)), 1, most)


def tool_records(spark: SparkSession, path: str, most: int = 12, width: int = 200, least: int = 2) -> DataFrame:
    """(file, id, lines): each tool call of JSON-lines transcripts with its result, as a record of lines.

    A record has the tool's name, up to 3 lines of each of the first 4 inputs and then the result, ``most`` lines of
    ``width`` code points in all; records of fewer than ``least`` lines, and lines that are not JSON, are dropped. A
    call without a result keeps its head.
    """
    raw = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    item = raw.select("file", F.explode("message.content").alias("c"))
    inputs = F.flatten(F.transform(F.slice(F.map_entries("c.input"), 1, 4), lambda e: F.slice(_clipped(F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))), 3, width), 1, 3)))
    used = item.where("c.type = 'tool_use'").select("file", F.col("c.id").alias("id"), F.concat(F.array("c.name"), F.coalesce(inputs, F.array().cast("array<string>"))).alias("head"))
    given = item.where("c.type = 'tool_result'").select(F.col("file"), F.col("c.tool_use_id").alias("id"), _clipped(F.col("c.content"), most, width).alias("tail"))
    joined = used.join(given, ["file", "id"], "left")
    record = F.slice(F.concat("head", F.coalesce("tail", F.array().cast("array<string>"))), 1, most)
    return joined.select("file", "id", record.alias("lines")).where(F.size("lines") >= least)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, truth): non-blank lines of Markdown files; second-level headings become boundaries and are removed."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    marked = F.regexp_replace("value", r"(?m)^##\s.*$", X.RULING)
    parsed = X.boundaries(marked)
    return raw.select("file", parsed["lines"].alias("lines"), parsed["cuts"].alias("truth"))


def embed(lines: DataFrame, text: str, service: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """(key, vector) of distinct texts, embedded a batch at a time and scaled to length 1.

    The key is the SHA-256 of the text, so a cache written from this is valid for exactly the texts it holds.
    """
    import numpy as np

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), batch):
            v = np.asarray(service(texts.iloc[at : at + batch].tolist()), dtype=np.float32)
            out += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
        return pd.Series(out)

    distinct = lines.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    return distinct.select(F.sha2("text", 256).alias("key"), run("text").alias("vector"))


def embed_cached(lines: DataFrame, text: str, service: Callable[[list[str]], list[list[float]]], path: str, batch: int = 128) -> DataFrame:
    """(key, vector) of distinct texts from the cache at ``path``, after the service was asked for those that it lacks.

    The cache is keyed by content, so it serves any collection and never goes stale. New vectors are appended once they are all
    there; an append that is repeated, or that two jobs make at once, adds rows of keys that are known, of which one is read.
    """
    from pyspark.errors import AnalysisException

    spark = lines.sparkSession
    asked = lines.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("key", F.sha2("text", 256))
    try:
        known = spark.read.schema("key string, vector array<float>").parquet(path).select("key").distinct()
        new = asked.join(known, "key", "left_anti")
    except AnalysisException:
        new = asked
    if not new.isEmpty():
        embed(new, "text", service, batch).write.mode("append").parquet(path)
    try:
        cache = spark.read.schema("key string, vector array<float>").parquet(path)
    except AnalysisException:  # nothing was ever asked for
        return spark.createDataFrame([], "key string, vector array<float>")
    return cache.join(asked.select("key"), "key", "left_semi").groupBy("key").agg(F.min("vector").alias("vector"))
