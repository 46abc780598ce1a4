"""Steps whose work must not grow faster than their input: results against plain versions, at sizes that a slower step would not end at."""

import json
import math
import time
import zipfile
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import stats
from tabulon.operators import describe, permutation, substrings
from tabulon.operators import segmentation as G
from tabulon.sources import archives


def test_sign_test_of_many(spark):
    few = [(0, 0), (1, 0), (3, 9), (40, 25), (700, 640), (1010, 990)]
    rows = spark.createDataFrame([*few, (200_300, 199_700)], "w long, l long")
    began = time.time()
    got = {(r.w, r.l): r.p for r in rows.select("w", "l", stats.sign_test(F.col("w"), F.col("l")).alias("p")).collect()}
    assert time.time() - began < 60
    for w, l in few:
        n, k = w + l, min(w, l)
        exact = min(Fraction(1), 2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)) if n else 1
        assert got[(w, l)] == pytest.approx(float(exact), rel=1e-9)
    assert got[(200_300, 199_700)] == pytest.approx(math.erfc(599 / math.sqrt(2 * 400_000)), rel=1e-4)  # normal, half a step less


@pytest.mark.parametrize("method", ["overlap_min", "hybrid", "emb_global"])
def test_search_over_a_long_document(spark, method):
    rng = np.random.default_rng(5)
    tokens = [[f"w{x}" for x in rng.integers(0, 12, 6)] for _ in range(120)]
    marks = (rng.random(120) < 0.1).tolist()
    vectors = rng.random((120, 16)).tolist()
    docs = spark.createDataFrame([(i, tokens, 25, marks, vectors) for i in range(4)], "doc_id long, tokens array<array<string>>, k int, marks array<boolean>, vectors array<array<double>>")
    G.solve(docs.limit(1), "lex_valley").collect()
    began = time.time()
    found = [(r.solver, len(r.cuts)) for r in G.solve(docs, method).collect()]
    assert time.time() - began < 10
    assert found == [("exact", 24)] * 4


def _plain_shared(tokens, lens):
    sets, at = [], 0
    for n in lens:
        own = tokens[at : at + n]
        sets.append(set(zip(own, own[1:], own[2:])))
        at += n
    return sum(len(a & b) for a, b in zip(sets, sets[1:]))


def test_shared_trigrams_as_arrays():
    rng = np.random.default_rng(3)
    for words, m in ((2, 5), (5, 9), (40, 4), (3, 1)):
        lens = rng.integers(1, 14, m)
        tokens = rng.integers(0, words, lens.sum())
        moved = np.stack([rng.permutation(lens) for _ in range(40)])
        assert permutation.shared_by_lengths(tokens, moved).tolist() == [_plain_shared(tokens.tolist(), x.tolist()) for x in moved]
        dealt = np.stack([rng.permutation(tokens) for _ in range(40)])
        assert permutation.shared_by_tokens(dealt, lens).tolist() == [_plain_shared(x.tolist(), lens.tolist()) for x in dealt]


@pytest.mark.parametrize("null", ["A", "B"])
def test_many_replicates_of_many_texts(spark, null):
    rng = np.random.default_rng(4)
    rows = [("g", i, [f"w{i}_{j}" for j in range(300)] if i % 20 else [f"w{x}" for x in rng.integers(0, 60, 300)], [60] * 5) for i in range(600)]
    chunks = spark.createDataFrame(rows, "genre string, doc long, tokens array<string>, lens array<int>")
    permutation.overlap_null(chunks.limit(1), null, 1, hashed=False).collect()
    began = time.time()
    assert permutation.overlap_null(chunks, null, 10_000, hashed=False).count() == 10_000
    assert time.time() - began < 30


def test_archives_are_dealt_by_size(spark, tmp_path):
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as z:
            for i in range(50):
                z.writestr(f"c/P{a}{i:02d}.json", json.dumps({"cdl": [{"node": "l", "f": {"form": f"x{i}"}}]}))
    for size in (600, 5_000, 1 << 20):
        shares = archives._Reader({"path": f"{tmp_path}/*.zip", "bytes": str(size)}).partitions()
        assert not any(hasattr(s, "members") for s in shares) and all(len(s.files) <= 3 for s in shares)  # the driver holds no members
        got = archives.lemma_archives(spark, f"{tmp_path}/*.zip", size=size)
        assert got.count() == got.select("archive", "member").distinct().count() == 150


def test_only_runs_of_anchors_are_shuffled(spark):
    rng = np.random.default_rng(6)
    long = ["".join(rng.choice(list("abcdefghij"), 3000)) for _ in range(40)]
    short = [long[3][100:140], long[9][2950:], "z" * 20]
    frame = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, text string")
    asked = frame(short).mapInArrow(substrings._places(8, 4), "id long, at long, run long")
    shared = spark.sparkContext.broadcast(substrings._bitmap(asked))
    left = frame(long).mapInArrow(substrings._places(8, None, shared), "id long, at long, run long")
    own = {r.run for r in asked.collect()}
    runs = [r.run for r in left.collect()]
    assert len(runs) < 100 and own & set(runs) == own - {int(x) for x in substrings.runs("z" * 20, 8)}
    assert sorted(r.text for r in substrings.contained(frame(short).select("text"), frame(long).select("text")).collect()) == sorted(short[:2])


def test_ngrams_are_counted_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", "x y", 9), ("b", "x y", 1), ("b", "u v", 7)], "genre string, ngram string, freq long")
    got = describe.distinctive(rows.mapInArrow(counted, rows.schema)).collect()
    assert made.value == 3 and sorted(r.ngram for r in got) == ["u v", "x y"]


def test_position_templates_of_blank_texts(spark):
    """A text without lines has no opening; it failed at the first line of an empty array."""
    rows = [("en", None), ("en", ""), ("fr", " \n\t "), ("fr", "<RULING>"), ("de", "one two three four\nfive six"), ("de", "x"), (None, "a b\nc d")]
    for n in (1, 7):  # also where blank texts alone are in a task
        df = spark.createDataFrame(rows, "lang string, text string").repartition(n)
        got = {(r.genre, r.place, r.template, r.n) for r in describe.position_templates(df, "lang", "text").collect()}
        assert got == {("de", "opening", "one two three", 1), ("de", "closing", "five six", 1), ("de", "opening", "x", 1), (None, "opening", "a b", 1), (None, "closing", "c d", 1)}
