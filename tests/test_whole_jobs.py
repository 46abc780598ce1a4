"""Queries against DuckDB on tables with odd rows, and the steps of whole jobs."""

import hashlib
import itertools
import random
import shutil
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions.hashes import md5_heads
from tabulon.operators import describe, permutation, powerlaw, sampling
from tabulon.plans import catalog

from .conftest import DATA
from .test_queries import plain


def test_template_catalog_of_blank_texts(spark, tmp_path):
    """Blank and null texts ended the job."""
    for t in ("documents", "pages"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    texts = "CASE doc_id % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) WHEN 3 THEN '<RULING>' ELSE text END AS text"
    duckdb.sql(f"COPY (SELECT doc_id, {texts}, lang, source, n_chars FROM '{DATA}/documents.parquet') TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ours = plain(catalog.queries()["template_catalog"](spark, str(tmp_path)).toPandas())
    pd.testing.assert_frame_equal(ours, plain(con.execute(catalog.oracle_sql()["template_catalog"]).df()), check_dtype=False)


def _texts(spark):
    rng = random.Random(4)
    docs = [(g, k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for g, n in (("a", 60), ("b", 25), (None, 30), ("one", 22)) for k in range(n)]
    docs += [("a", 70, None), ("b", 71, "<RULING> \n <unk>"), ("b", 72, " \t")]
    return spark.createDataFrame([(g, k * 3, t if g != "one" else "w " * 60) for g, k, t in docs], "lang string, doc_id long, text string").repartition(5)


def test_block_types_are_those_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 64)
    df = _texts(spark)
    stream, texts = describe.token_stream(df, "lang", "doc_id", "text"), describe.token_texts(df, "lang", "doc_id", "text")
    for length in (None, 100):
        ours = describe.block_types(texts, sampling.draws(texts, "genre", 9, F.sum("n"), length)).collect()
        rows = sampling.blocks(stream, "genre", "seq", 9, length).groupBy("genre", "rep", "token").agg(F.count("*").alias("freq")).collect()
        assert len(ours) == len(rows) and {(r.genre, r.rep, r.token, r.freq) for r in ours} == {(r.genre, r.rep, r.token, r.freq) for r in rows}


def test_zipf_of_counts_is_that_of_ranked_types(spark, monkeypatch):
    monkeypatch.setattr(describe, "RANKS", 7)
    tokens = describe.token_stream(_texts(spark), "lang", "doc_id", "text").withColumn("token", F.when(F.col("genre") == "b", (F.col("seq") % 6).cast("string")).otherwise(F.col("token")))
    ranked = describe.spectrum(tokens.where("genre <> 'b' OR seq < 600"))
    theirs = {r.genre: r for r in describe.zipf(ranked).collect()}
    ours = {r.genre: r for r in describe.zipf_of_counts(ranked.groupBy("genre", "freq").agg(F.count("*").alias("types")), ["genre"]).collect()}
    assert ours == theirs and ours["one"].exponent is None and ours["b"].r2 == 1 and ours["a"].exponent > 0


def test_zipf_length_control_has_all_draws(spark):
    """It had five draws of 25."""
    assert {r.draws for r in catalog.queries()["zipf_length_control"](spark, DATA).collect()} == {25}


def test_power_law_that_begins_beyond_forty_values():
    """Uneven up to 60, a power law from there on: only the first forty values were tried."""
    low, high = np.arange(2, 60), np.arange(60, 10_060)
    law = high.astype(float) ** -2.5
    values, counts = np.append(low, high), np.append(np.where(low % 7 == 0, 3000, 200), np.random.default_rng(5).multinomial(40_000, law / law.sum()))
    values, counts = values[counts > 0], counts[counts > 0]
    x_min, alpha, ks, tail = powerlaw.fit(values, counts)
    assert 55 < x_min < 70 and abs(alpha - 2.5) < 0.02 and tail == counts[values >= x_min].sum()
    every = [(powerlaw._ks(values[values >= m], counts[values >= m], m, powerlaw._alpha(values[values >= m], counts[values >= m], m)), m) for m in values.tolist() if counts[values >= m].sum() >= 50]
    assert len(every) > 200 and (ks, x_min) == min(every)


@pytest.mark.parametrize("prefix", [b"", b"42|3|user|", b"x" * 50, b"y" * 55, b"z" * 63, b"k" * 64, "qé".encode() * 70])
def test_hashes_over_arrays(prefix):
    for low, high in ((0, 1200), (9_999_990, 10_000_050), (5, 5)):
        assert md5_heads(prefix, low, high).tolist() == [int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:8], 16) for i in range(low, high)]


def _interval(values, name, reps):
    means = []
    for rep in range(reps):
        at = [int(int(hashlib.md5(f"42|{rep}|{name}|{i}".encode()).hexdigest()[:8], 16) / 4294967296.0 * len(values)) for i in range(len(values))]
        known = [values[i] for i in at if values[i] is not None]
        means.append(sum(known) / len(known))
    return [round(float(x), 6) for x in np.quantile(means, (0.025, 0.975))]


def test_bootstrap_draws_of_parts(spark, monkeypatch):
    """Values come in several rows, and draws are hashed again for each part that is held; nulls are drawn and not counted."""
    rng = random.Random(8)
    rows = [(g, k, None if k % 11 == 0 else rng.randint(1, 900)) for g, n in (("a", 130), ("bé", 61)) for k in range(n)] + [(None, 1, 5)]
    for name, size in (("VALUES", 8), ("HELD", 40), ("PLACES", 50), ("BOOTSTRAPS", 7)):
        monkeypatch.setattr(permutation, name, size)
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(3)
    got = {r.g: [r.low, r.high] for r in permutation.bootstrap_ci(df, ["g"], "k", "v", 60).collect()}
    assert got == {g: _interval([v for h, _, v in rows if h == g], g, 60) for g in ("a", "bé")}


def test_bootstrap_has_all_draws(spark):
    """It had 30 draws of 10,000."""
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").where("role = 'system'").orderBy("conv_id", "turn").select(F.length("text")).collect()
    got = next(r for r in catalog.queries()["bootstrap_ci"](spark, DATA).collect() if r.role == "system")
    assert [got.low, got.high] == _interval([r[0] for r in rows], "system", 10_000)


def test_lengths_are_permuted_together():
    """Ten thousand orders of a text's chunks are drawn as one array, each order as often as any other; one by one they took 45 ms."""
    drawn = permutation.drawn_lengths((1, "A", "doc", 0), [4, 5, 9], 60_000, "A")
    orders, times = np.unique(drawn, axis=0, return_counts=True)
    assert sorted(map(tuple, orders.tolist())) == sorted(itertools.permutations((4, 5, 9))) and abs(times - 10_000).max() < 500
    began = time.process_time()
    for i in range(20):
        permutation.drawn_lengths((1, "A", i, 0), [30, 12, 44, 9, 25], 10_000, "A")
    assert time.process_time() - began < 0.4


def test_a_text_is_shuffled_once_for_all_replicates(spark):
    rows = [("g", i, [f"w{i}_{j}" for j in range(40)] * 2, [20] * 4) for i in range(50)]
    chunks = spark.createDataFrame(rows, "genre string, doc long, tokens array<string>, lens array<int>")
    null = permutation.overlap_null(chunks, "A", 1000, hashed=False)
    assert "explode" not in null._jdf.queryExecution().toString().lower() and null.count() == 1000


def test_streams_of_texts_are_those_of_tokens(spark, monkeypatch):
    """Rows of texts give the ratios and blocks that rows of tokens give, with fewer rows in the shuffle; packs stay small."""
    monkeypatch.setattr(sampling, "BLOCK", 64)
    monkeypatch.setattr(describe, "PACKED", 300)
    df = _texts(spark)
    stream, joined, texts = describe.token_stream(df, "lang", "doc_id", "text"), describe.joined_texts(df, "lang", "doc_id", "text"), describe.token_texts(df, "lang", "doc_id", "text")
    assert joined.count() < stream.count() / 20
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(describe.zlib_ratio(joined, seq="k", piece=64)) == rows(describe.zlib_ratio(stream))
    assert max(r.size for r in describe._packed(joined, ["genre"], "k", 64).collect()) < 300 + 2 * 200
    drawn = sampling.draws(texts, "genre", 6, F.sum("n"), 100)
    ours = describe.redundancy(describe.block_texts(texts, drawn), 3, by=["genre", "rep"], types=describe.block_types(texts, drawn))
    theirs = describe.redundancy(sampling.blocks(stream, "genre", "seq", 6, 100), 3, by=["genre", "rep"])
    assert rows(ours) == rows(theirs) and len(rows(ours)) > 12
