"""Scores of random cuts, metrics of methods as one long table, and verdicts as declared conditions over it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import segmentation as G
from tabulon.operators.resampling import generator

METRICS = ("pk", "window_diff", "f1", "f1_near", "k_mae")
SCORES = ("pk", "window_diff", "f1", "f1_near", "k_error")


def plain_scores(n: int, truth: Sequence[int], cuts: np.ndarray) -> np.ndarray:
    """(draws, 4): pk, window_diff, f1 and f1_near of each row of ``cuts``, a mark for each place between lines."""
    true = np.zeros(n - 1, dtype=bool)
    true[list(truth)] = True
    w = max(2, round(n / (len(truth) + 1) / 2))
    out = np.zeros((len(cuts), 4))
    if n > w:
        padded = lambda x: np.concatenate([np.zeros((len(x), 1), dtype=int), np.cumsum(x, axis=1), x.sum(axis=1, keepdims=True)], axis=1)
        runs = [p[:, w:n] - p[:, : n - w] for p in (padded(true[None, :]), padded(cuts))]
        out[:, 0] = ((runs[0] > 0) != (runs[1] > 0)).mean(axis=1)
        out[:, 1] = (runs[0] != runs[1]).mean(axis=1)
    total = true.sum() + cuts.sum(axis=1)
    out[:, 2] = np.where(total == 0, 1.0, 2 * (cuts & true).sum(axis=1) / np.maximum(total, 1))
    # each cut takes the lowest true one near it that is left, so those taken rise; a place at a time, for all draws
    last, hits = np.full(len(cuts), -2), np.zeros(len(cuts))
    for c in np.flatnonzero(np.convolve(true, [1, 1, 1])[1:-1] if n > 1 else []).tolist():
        free = cuts[:, c].copy()
        for t in (c - 1, c, c + 1):
            if 0 <= t < n - 1 and true[t]:
                taken = free & (last < t)
                last[taken] = t
                hits += taken
                free &= ~taken
    out[:, 3] = np.where(total == 0, 1.0, 2 * hits / np.maximum(total, 1))
    return out


def random_scores(docs: DataFrame, reps: int = 200, seed: int = 42, key: str = "doc_id", keep: Sequence[str] = ("corpus", "marked")) -> DataFrame:
    """Scores of cuts drawn at random, as many as there are true ones: means over ``reps`` draws of each document, method ``random``."""
    kept = [c for c in keep if c in docs.columns]
    source = docs.select(key, *kept, F.col("n").cast("int").alias("n"), "truth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, truth in zip(batch[key], batch["n"], batch["truth"], strict=True):
                cuts = np.zeros((reps, max(n - 1, 0)), dtype=bool)
                if len(truth):
                    order = generator(seed, int(doc) if isinstance(doc, (int, np.integer)) else doc).random(cuts.shape).argsort(axis=1)
                    np.put_along_axis(cuts, order[:, : len(truth)], True, axis=1)
                rows.append(plain_scores(n, truth, cuts).mean(axis=0).round(6) if n > 1 else np.array([0.0, 0.0, 1.0, 1.0]))
            made = pd.DataFrame(np.array(rows).reshape(-1, 4), columns=SCORES[:4])
            yield pd.concat([batch[[key, *kept]].reset_index(drop=True), made], axis=1).assign(method="random", k_error=0)

    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (key, *kept))
    return G.spread(source, key).mapInPandas(run, f"{types}, pk double, window_diff double, f1 double, f1_near double, method string, k_error int")


def strata(scores: DataFrame, flag: str, named: tuple[str, str] = ("with_markers", "without_markers")) -> DataFrame:
    """``scores`` twice: all documents as stratum ``all``, and again by ``flag``."""
    split = F.when(F.col(flag), named[0]).otherwise(named[1])
    return scores.withColumn("stratum", F.explode(F.array(F.lit("all"), split)))


def metrics(scores: DataFrame, pairs: Sequence[tuple[str, str]], least: int = 30, by: Sequence[str] = ("corpus", "stratum")) -> DataFrame:
    """(…, subject, metric, value, n): means of methods and paired tests of methods, a row each.

    A stratum has tests and an adjustment of its own. Strata below ``least`` documents are left out, stratum ``all`` never is.
    """
    enough = (F.col("stratum") == "all") | (F.col("docs") >= least)
    means = G.summary(scores, [*by, "method"]).where(enough)
    tests = G.paired(scores, pairs, by=by).where(enough)
    long = lambda df, subject, names: df.select(*by, subject.alias("subject"), F.col("docs").alias("n"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("x")).select(*by, "subject", "x.metric", "x.value", "n")
    return long(means, F.col("method"), METRICS).unionByName(long(tests, F.concat_ws("_vs_", "a", "b"), ("wins", "losses", "p", "p_adjusted")))


class Verdict(NamedTuple):
    """A condition over metrics, which it names ``[corpus/stratum/subject/metric]``; ``void`` says why it has no standing, whatever it gives."""

    name: str
    condition: str
    void: str = ""

    @property
    def needs(self) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\[([^\]]+)\]", self.condition)))


def verdicts(long: DataFrame, rules: Sequence[Verdict]) -> DataFrame:
    """(rule, status, needed, found): held, failed, not evaluated where a metric is missing or null, or void.

    Rules and what they name are literals; only the metrics that some rule names are looked at.
    """
    spark = long.sparkSession
    needed = spark.createDataFrame([(r.name, k) for r in rules for k in r.needs] or [("", "")], "rule string, at string")
    keyed = long.select(F.concat_ws("/", "corpus", "stratum", "subject", "metric").alias("at"), "value").where("value IS NOT NULL")
    found = keyed.join(F.broadcast(needed), "at").groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"), F.count_distinct("at").alias("found"))
    names = spark.createDataFrame([(r.name, len(r.needs), r.void) for r in rules], "rule string, needed int, void string")
    known = names.join(found, "rule", "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("int"))

    def holds(r: Verdict) -> Column:
        return F.expr(re.sub(r"\[([^\]]+)\]", lambda k: f"try_element_at(m, '{k[1]}')", r.condition))

    held = F.lit(None).cast("boolean")
    for r in rules:
        held = F.when(F.col("rule") == r.name, holds(r)).otherwise(held)
    status = F.when(F.col("void") != "", "void").when((F.col("found") < F.col("needed")) | held.isNull(), "not evaluated").when(held, "held").otherwise("failed")
    return known.select("rule", status.alias("status"), "needed", "found")
