"""Full-size nulls against exact moments and brute force, and substrings against ``in``."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import permutation, resampling, substrings
from tabulon.plans import inference
from tabulon.sources.sinks import leaked_lines

from .conftest import DATA


def moments(n, k, h):
    return k * h / n, k * h / n * (n - h) / n * (n - k) / (n - 1)


@pytest.mark.parametrize(("n", "k", "h", "groups"), [(10, 3, 4, 1), (10, 3, 4, 5000), (7, 7, 3, 9), (200, 60, 1, 40), (50_000, 900, 20_000, 2), (3 * 10**9, 10**6, 10**9, 1)])
def test_hits_have_the_exact_moments(n, k, h, groups):
    x = resampling.hits(resampling.generator("t", n), n, k, h, groups, 20_000)
    mean, variance = (groups * m for m in moments(n, k, h))
    assert abs(x.mean() - mean) <= 5 * math.sqrt(variance / 20_000) + 1e-9
    assert abs(x.var() - variance) <= 0.06 * variance + 1e-9
    assert x.min() >= groups * max(0, k + h - n) and x.max() <= groups * min(k, h)


def test_one_group_has_the_exact_distribution():
    x = resampling.hits(resampling.generator("one"), 12, 5, 4, 1, 50_000)
    y = resampling.hits(resampling.generator("many"), 12, 5, 4, 50_000, 1)
    exact = [math.comb(4, j) * math.comb(8, 5 - j) / math.comb(12, 5) for j in range(5)]
    assert np.allclose(np.bincount(x.astype(int), minlength=5) / 50_000, exact, atol=0.01) and abs(y[0] / 50_000 - 5 * 4 / 12) < 0.02


@pytest.mark.parametrize("strata", [None, 10])
def test_enrichment_agrees_with_permuted_rows(spark, strata):
    lines = inference._interior(spark, DATA).persist()
    whole = {(r.genre, r.flag): r for r in resampling.enrichment(lines, inference.FLAGS, 2000, strata=strata).collect()}
    few = {(r.genre, r.flag): r for r in permutation.enrichment(lines, inference.FLAGS, 60, strata=strata).collect()}
    assert whole.keys() == few.keys()
    for k, r in whole.items():
        f = few[k]
        assert (r.cuts, r.rate_before, r.rate_other) == (f.cuts, f.rate_before, f.rate_other)
        assert abs(r.null_mean - r.drawn_mean) <= 5 * r.drawn_sd / math.sqrt(2000) + 1e-6
        assert abs(r.null_mean - f.null_rate) <= 5 * r.drawn_sd / math.sqrt(60) + 1e-6
        assert abs(r.p - f.p) < 0.25
    again = resampling.enrichment(lines.repartition(7), inference.FLAGS, 2000, strata=strata).collect()
    assert {(r.genre, r.flag): r for r in again} == whole  # whichever way rows are dealt


@pytest.mark.parametrize("strata", [None, 3])
def test_enrichment_draws_lines_by_hash(spark, strata):
    """Lines drawn are those of the lowest hashes in a document or stratum, and a row of work is a document, not a line and replicate."""
    rng, reps = random.Random(9), 7
    rows = [(g, d, i, n, rng.random() < 0.3, rng.choice([True, False, None])) for g in "ab" for d in range(10 * ord(g), 10 * ord(g) + 9) for n in [rng.randint(1, 60)] for i in range(n)]
    df = spark.createDataFrame(rows, "genre string, doc long, i int, n int, pre boolean, f boolean").repartition(3)
    plan = permutation.enrichment(df, ["f"], reps, strata=strata)
    if strata is None:
        assert "sequence(0" not in plan._jdf.queryExecution().analyzed().toString()
    got = {r.genre: r for r in plan.collect()}
    mean = lambda xs: (lambda k: sum(k) / len(k))([x for x in xs if x is not None])
    for g in "ab":
        mine, null = [r for r in rows if r[0] == g], []
        for rep in range(reps):
            picked = []
            for key in {(r[1] if strata is None else min(2, r[2] * 3 // r[3])) for r in mine}:
                group = [r for r in mine if key == (r[1] if strata is None else min(2, r[2] * 3 // r[3]))]
                group.sort(key=lambda r: hashlib.md5(f"42|{rep}|{r[1]}|{r[2]}".encode()).hexdigest())
                picked += [r[5] for r in group[: sum(r[4] for r in group)]]
            null.append(mean(picked))
        seen = mean([r[5] for r in mine if r[4]])
        assert (got[g].cuts, got[g].rate_before, got[g].rate_other) == (sum(r[4] for r in mine), round(seen, 6), round(mean([r[5] for r in mine if not r[4]]), 6))
        assert got[g].null_rate == pytest.approx(np.mean(null), abs=1e-6) and got[g].p == round((1 + sum(round(x, 9) >= round(seen, 9) for x in null)) / (reps + 1), 6)


@pytest.mark.parametrize("block", [3, 8192])
def test_bootstrap_agrees_with_drawn_rows(spark, block):
    rng = random.Random(4)
    rows = [("a", float(rng.randint(0, 30))) for _ in range(400)] + [("b", rng.random()) for _ in range(60)] + [("c", 2.5), ("c", None)]
    found = {r.g: r for r in resampling.bootstrap_ci(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 4000, block=block).collect()}
    for g in "abc":
        v = np.array([x for k, x in rows if k == g and x is not None])
        means = np.random.default_rng(1).choice(v, size=(4000, len(v))).mean(axis=1)
        r, wide = found[g], v.std() / math.sqrt(len(v))
        assert r.n == len(v) and math.isclose(r["mean"], v.mean(), abs_tol=1e-6)
        assert np.allclose([r.low, r.high], np.quantile(means, [0.025, 0.975]), atol=0.25 * wide + 1e-6)


def places(rng, n):
    return [(i, "x" if rng.random() < 0.4 else "y", rng.randint(4, 40), rng.random() ** (2 if i % 3 else 1)) for i in range(n) for _ in range(rng.randint(1, 4))]


def plain_entropy(values):
    counts = np.bincount([min(9, int(v * 10)) for v in values], minlength=10)
    q = counts[counts > 0] / counts.sum()
    return float(-(q * np.log2(q)).sum())


def test_matched_entropy_agrees_with_subsamples(spark):
    rows = places(random.Random(5), 300)
    large, small = ([p for _, k, _, p in rows if k == x] for x in "yx")
    r = resampling.matched_entropy(spark.createDataFrame(rows, "doc int, label string, size int, place double"), "label", ("y", "x"), 1500).first()
    rng = np.random.default_rng(2)
    null = [plain_entropy(rng.choice(large, len(small), replace=False)) for _ in range(1500)]
    assert r.n == len(small) and math.isclose(r.small_entropy, plain_entropy(small), abs_tol=1e-6)
    assert abs(r["mean"] - np.mean(null)) < 0.004 and np.allclose([r.low, r.high], np.quantile(null, [0.025, 0.975]), atol=0.012)


@pytest.mark.parametrize("block", [4, 8192])
def test_stratified_entropy_agrees_with_permuted_labels(spark, block):
    seen, docs = places(random.Random(6), 150), {}
    rng = random.Random(7)
    sizes, labels = {i: rng.randint(4, 40) for i in range(150)}, {i: rng.choice("xxy") for i in range(150)}
    rows = [(i, labels[i], sizes[i], p) for i, _, _, p in seen]
    for i, _, _, p in rows:
        docs.setdefault(i, []).append(p)
    r = resampling.stratified_entropy(spark.createDataFrame(rows, "doc int, label string, size int, place double"), "doc", "label", ("x", "y"), "size", 1500, block=block).first()
    ids = sorted(docs)
    cuts = np.quantile([sizes[i] for i in ids], [0.2, 0.4, 0.6, 0.8])
    strata = [sum(c <= sizes[i] for c in cuts) for i in ids]

    def stat(of):
        return plain_entropy([p for i in ids if of[i] == "x" for p in docs[i]]) - plain_entropy([p for i in ids if of[i] == "y" for p in docs[i]])

    null, shuffle = [], random.Random(8)
    for _ in range(600):
        of = {}
        for s in set(strata):
            mine = [i for i, t in zip(ids, strata, strict=True) if t == s]
            kept = [labels[i] for i in mine]
            shuffle.shuffle(kept)
            of |= dict(zip(mine, kept, strict=True))
        null.append(stat(of))
    assert math.isclose(r.observed, stat(labels), abs_tol=1e-6) and abs(r.null_mean - np.mean(null)) < 0.012
    assert abs(r.p_upper - np.mean([x >= stat(labels) for x in null])) < 0.07


# --- substrings ---


def test_substrings(spark):
    rng = random.Random(3)
    words = "ash birch cedar durum elder fir gorse hazel iris".split()
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "x" * 9000, "ash " * 4000 + "the end of it", "é\U0001f600" * 3000]
    short = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    short += ["x" * n for n in (7, 8, 4095, 4096, 4097, 9000, 9001)] + ["ash ash the end", "he end of it", "é\U0001f600" * 2500, "\U0001f600é" * 2999, "\U0001f600é" * 3000, None, "", "absent words", long[0][3:40], long[0][3:40], "ash " * 2000 + "ash"]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string").repartition(3)
    for least, width, piece in ((8, 8, 4096), (8, 8, 16), (3, 8, 64)):
        got = [r.text for r in substrings.contained(df(short), df(long), least, width, piece=piece).collect()]
        expected = {s for s in short if s and len(s) >= least and any(t and s in t for t in long)}
        assert len(got) == len(set(got)) and set(got) == expected
    assert substrings.contained(df(short).limit(0), df(long)).collect() == [] == substrings.contained(df(short), df(long).limit(0)).collect()


def test_leak_inside_a_longer_line(spark):
    docs = spark.createDataFrame([("  a secret line  \nshort\nanother one here",)], "text string")
    out = spark.createDataFrame([(json.dumps({"n": 3, "note": "said: a secret line, twice"}),)], "blob string")
    assert [r.line for r in leaked_lines(docs, out).collect()] == ["a secret line"]


def test_no_nested_loop(spark):
    docs = spark.range(5).select(F.concat(F.lit("some line of text "), F.col("id").cast("string")).alias("text"))
    plan = substrings.contained(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("null", ["A", "B", "C"])
def test_generated_nulls_agree_with_hashed(spark, null):
    chunks = inference._chunks(spark, DATA).persist()
    ours = {r.genre: r for r in permutation.overlap_test(chunks, null, 300, hashed=False).collect()}
    theirs = {r.genre: r for r in permutation.overlap_test(chunks, null, 200).collect()}
    for g, r in ours.items():
        assert (r.pairs, r.observed) == (theirs[g].pairs, theirs[g].observed)
        assert abs(r.null_mean - theirs[g].null_mean) < 0.015 and abs(r.p_upper - theirs[g].p_upper) < 0.2
    assert {r.genre: r for r in permutation.overlap_test(chunks.repartition(7), null, 300, hashed=False).collect()} == ours
