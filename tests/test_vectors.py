"""Worked vectors: small cases with answers computed by hand."""

import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import lexicon as L
from tabulon.functions import patterns as R
from tabulon.functions import stats
from tabulon.functions import text as X
from tabulon.operators import describe, ledger, permutation, powerlaw, probes, sampling, segmentation as G, sealedlog as S
from tabulon.plans import inference
from tabulon.sources import readers, sinks

from .conftest import DATA


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*map(F.lit, xs)).cast("array<int>")


@pytest.mark.parametrize(("n", "k", "cuts"), [(10, 3, [2, 6]), (5, 2, [1]), (5, 1, []), (1, 2, [])])
def test_equal_cuts(spark, n, k, cuts):
    assert one(spark, G.equal_cuts(F.lit(n), F.lit(k))) == cuts


def test_metrics(spark):
    assert one(spark, G.pk(F.lit(6), ints(2), ints(1))) == 0.5
    assert one(spark, G.window_diff(F.lit(6), ints(2), ints(1))) == 0.5
    assert one(spark, G.boundary_f1(ints(2), ints(1))) == 0
    assert one(spark, G.boundary_f1(ints(2), ints(1), 1)) == 1
    assert one(spark, G.pk(F.lit(6), ints(2), ints(2))) == 0


def test_planners(spark):
    marks = F.array(*(F.lit(x) for x in (False, True, True, False, True)))
    assert one(spark, G.marker_cuts_unknown_k(marks)) == [2]
    assert one(spark, G.length_prior_cuts(F.lit(7), F.lit(3))) == [2, 5]
    six = F.array(*(F.lit(x) for x in (False, True, False, True, True, False)))
    assert one(spark, G.marker_cuts(six, F.lit(3))) == [1, 3]


def test_boundaries(spark):
    text = F.lit("a\n<RULING>\nb\n<RULING>\n<RULING>\nc\n<RULING>")
    got = one(spark, X.boundaries(text))
    assert got["lines"] == ["a", "b", "c"] and got["cuts"] == [0, 1]
    assert one(spark, X.boundaries(F.lit("<RULING>\na\nb")))["cuts"] == []
    assert one(spark, X.boundaries(F.lit(None).cast("string")))["lines"] == []


def test_solver_is_exact(spark):
    """The dynamic program against all cut sets."""
    from itertools import combinations

    lines = [f"{a} {b} {c} {a} {b}".split() for a, b, c in ("xyz", "xyz", "pqr", "pqr", "xyq", "uvw")]
    docs = spark.createDataFrame([(1, lines, 3)], "doc_id long, tokens array<array<string>>, k int")
    cuts = G.solve(docs, "overlap_min").first()["cuts"]

    def cost(cs):
        edges = [0, *(c + 1 for c in cs), len(lines)]
        sets = []
        for a, b in zip(edges, edges[1:], strict=False):
            t = [x for line in lines[a:b] for x in line]
            sets.append(set(zip(t, t[1:], t[2:], strict=False)))
        return sum(len(p & q) for p, q in zip(sets, sets[1:], strict=False))

    assert tuple(cuts) == min(combinations(range(len(lines) - 1), 2), key=lambda c: (cost(c), c))


def test_tests(spark):
    assert one(spark, stats.sign_test(F.lit(5), F.lit(0))) == pytest.approx(0.0625)
    assert one(spark, stats.sign_test(F.lit(44), F.lit(24))) == pytest.approx(0.02053, abs=1e-5)
    assert one(spark, stats.sign_test(F.lit(1), F.lit(1))) == 1
    assert one(spark, stats.sign_test(F.lit(0), F.lit(0))) == 1
    assert one(spark, stats.permutation_p(F.lit(0), F.lit(10_000))) == 1 / 10_001
    ci = one(spark, stats.wilson(F.lit(6), F.lit(789)))
    assert (round(ci["low"], 4), round(ci["high"], 4)) == (0.0035, 0.0165)
    rho, _, upper = stats.spearman_exact([1, 2, 3, 4, 5], [2, 3, 5, 7, 9])
    assert rho == 1 and upper == pytest.approx(1 / 120)


def test_word_boundary_is_pythons(spark):
    cases = [("la₂-ia₃ 1(aš)", r"\bla₂-ia₃\b"), ("ensi₂", r"\bensi₂\b"), ("u₃-na-a-du₁₁", r"\bu₃-na-a-du₁₁\b"), ("x maš₂y", r"\bmaš₂\b"), ("šu  ba-ti", r"\bšu\s+ba-ti\b")]
    for text, pattern in cases:
        assert one(spark, R.found(F.lit(text), pattern)) == bool(re.search(pattern, text)), text


@pytest.mark.parametrize("probe", L.PROBES, ids=lambda p: p.name)
def test_probes_match_as_python_does(spark, probe):
    texts = ["kišib₃ lugal-ezem dumu ur-nigin", "mu us₂-sa ma₂ ba-hul", "šu ba-ti iti ezem", "nam-ti nam-lugal nam-ki", "šu-nigin₂ 1(geš₂) udu {d}šul-gi {ki}", "la₂-ia₃ diri zi-ga e₂ gal ensi₂", "igi lu₂-še₃ giri₃ x"]
    for t in texts:
        assert one(spark, R.count(F.lit(t), probe.pattern)) == len(re.findall(probe.pattern, t)), t
    if "(ti|ki" in probe.pattern:
        assert one(spark, R.matches(F.lit(texts[3]), probe.pattern)) == ["ti", "lugal", "ki"]


def test_numerals(spark):
    assert one(spark, ledger.classify(F.lit("1(geš₂) 2(u) 3(diš) udu")))["values"] == [60, 20, 3]
    assert one(spark, ledger.classify(F.lit("8(diš) ab₂ mu 3(aš)")))["kind"] == "noncounted"
    assert one(spark, X.morphemes(F.lit("5(diš) udu <unk> niga"))) == []
    # a numeral group is of ASCII letters and subscripts alone
    assert one(spark, X.morphemes(F.lit("5(diš) udu niga"))) == ["5(diš)", "udu", "niga"]
    assert one(spark, X.morphemes(F.lit("5(u) 1(ban₂) udu niga"))) == ["<N>", "<N>", "udu", "niga"]


def test_verdict_order(spark):
    rules = L.AUDITS["year_formula"]
    got = [one(spark, probes.verdict(F.lit(m), rules))["verdict"] for m in ("mu-na-an", "mu us₂-sa x", "mu <RULING>", "mu x")]
    assert got == ["FALSE", "TRUE", "FALSE", "TRUE"]


def test_power_law_recovers_exponent():
    import numpy as np

    rng = np.random.default_rng(1)
    support = np.arange(2, 5000)
    w = support**-2.2
    c = rng.multinomial(20_000, w / w.sum())
    x_min, alpha, _, _ = powerlaw.fit(support[c > 0], c[c > 0])
    assert abs(alpha - 2.2) < 0.15 and x_min >= 2
    assert math.isclose(powerlaw.zeta(2.0, 1), math.pi**2 / 6, rel_tol=1e-3)


def test_canonical_bytes():
    a = S.canonical("p", "s", ["w"], "d", 1.5, 3)
    assert a == b'{"by_seal":"s","payload":"p","period":"d","seq":3,"witnesses":["w"],"written_at":1.5}'


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/P1.json", '{"cdl": [{"node": "d", "type": "line-start"}, {"node": "l", "f": {"form": "udu", "cf": "udu", "gw": "sheep", "pos": "N"}}, {"node": "c", "cdl": [{"node": "d", "type": "line-start"}, {"node": "l", "f": {"form": "mu"}}]}]}')
        z.writestr("x/bad.json", "{")
        z.writestr("x/readme.txt", "no")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    got = readers.lemma_zip(spark, str(tmp_path / "*.zip"), ordered=True).orderBy("tok_no").collect()
    assert [(r.pnum, r.line_no, r.form) for r in got] == [("P1", 0, "udu"), ("P1", 1, "mu")]
    (tmp_path / "log.txt").write_text("fix\n\nbody\x01\x01second\n")
    assert sorted(r.lines for r in readers.commit_log(spark, str(tmp_path / "log.txt")).collect()) == [["fix", "body"], ["second"]]
    (tmp_path / "m.md").write_text("intro\n## A\nx\n\n## B\ny\n")
    r = readers.markdown(spark, str(tmp_path / "m.md")).first()
    assert r.lines == ["intro", "x", "y"] and r.truth == [0, 1]
    (tmp_path / "t.jsonl").write_text('{"message": {"content": [{"type": "tool_use", "id": "1", "name": "grep", "input": {"q": "a"}}]}}\nnot json\n{"message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "one\\ntwo"}]}}\n')
    assert readers.tool_records(spark, str(tmp_path / "t.jsonl")).first().lines == ["grep", "q: a", "one", "two"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "a int, b string")
    sinks.csv(df, str(tmp_path / "c"))
    sinks.json(df, str(tmp_path / "j"))
    assert "ä" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert sinks.freeze(df, str(tmp_path / "f")) and not sinks.freeze(df, str(tmp_path / "f"))
    assert readers.materialised(spark, str(tmp_path / "f"), lambda: 1 / 0).count() == 2
    parts = readers.splits(spark, {"train": str(tmp_path / "f"), "test": str(tmp_path / "f")})
    assert parts.groupBy("split").count().count() == 2


def test_stream_appends_what_a_batch_would(spark, tmp_path):
    from tabulon.streaming import log as stream

    people, periods, asked = S.fixture(spark)
    seals = S.mint(people, "root", F.lit(1_000.0))
    asked.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    stream.append(source, seals, periods, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "log"))
    assert written.count() == 50
    assert S.verify_all(written.drop("epoch"), seals).first()["valid"] == 50


def test_partitioning_does_not_matter(spark):
    from tabulon.plans import inference

    from .conftest import DATA

    first = sorted(map(tuple, inference.null_length_permute(spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, inference.null_length_permute(spark, DATA).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _repeats(stream, skips):
    return [sum(v >= 3 for v in Counter(stream[::k]).values()) for k in skips]


def test_els_scan_sees_every_token_and_skip(spark):
    """Whole streams, skips 2..100 and p below 1/11; nulls as of plain shuffles."""
    rng, skips = random.Random(3), range(2, 101)
    a = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(6000)]
    for i in range(3000, 6000, 50):  # a planted letter sequence beyond the first 3000 tokens
        a[i] = f"late{i // 200}"
    streams = {"a": a, "b": [rng.choice("xyz") for _ in range(300)], "short": ["x"] * 199}
    df = spark.createDataFrame([(g, i, t) for g, s in streams.items() for i, t in enumerate(s)], "genre string, seq long, token string")
    got = {(r.genre, r["skip"]): r for r in describe.els_scan(df, skips, 200).collect()}
    assert set(got) == {(g, k) for g in "ab" for k in skips}
    again = {(r.genre, r["skip"]): r for r in describe.els_scan(df.repartition(7), skips, 200).collect()}
    assert got == again
    for g in "ab":
        assert [got[g, k].repeated for k in skips] == _repeats(streams[g], skips)
        plain = np.array([_repeats(rng.sample(streams[g], len(streams[g])), skips) for _ in range(200)])
        ours = np.array([got[g, k].null_mean for k in skips])
        assert (abs(ours - plain.mean(0)) <= 5 * np.sqrt(2 * plain.var(0) / 200) + 0.05).all()
    assert got["a", 50].p == round(1 / 201, 6) and got["a", 50].z > 4


def test_blocks_of_a_shuffle_are_a_shuffle():
    """Streams of many blocks: exact where every order gives the same, and with the moments of plain shuffles."""
    skips, rng = (2, 3, 7), np.random.default_rng(8)
    assert describe.shuffled_repeats(np.array([50]), skips, 3, rng, block=8).tolist() == [1, 1, 1]
    freqs = np.array([1, 2, 2, 3, 4, 5, 6, 8, 12, 20])
    stream = np.repeat(np.arange(len(freqs)), freqs).tolist()
    ours = np.array([describe.shuffled_repeats(freqs, skips, 3, rng, block=7) for _ in range(4000)])
    plain = np.array([_repeats(rng.permutation(stream).tolist(), skips) for _ in range(4000)])
    assert (abs(ours.mean(0) - plain.mean(0)) < 0.1).all() and (abs(ours.std(0) - plain.std(0)) < 0.1).all()


def test_drawn_repeats_are_those_of_shuffles():
    """Counts drawn without a shuffle have the spread of plain ones; a stream of 10^8 tokens takes seconds, where a thousand shuffles take hours."""
    rng = np.random.default_rng(8)
    freqs = np.repeat([1, 2, 3, 4, 5, 6, 8, 12, 20], [2, 2, 7, 8, 1, 1, 1, 1, 1])
    distinct, types = np.unique(freqs, return_counts=True)
    stream = np.repeat(np.arange(len(freqs)), freqs).tolist()
    plain = np.array([_repeats(rng.permutation(stream).tolist(), (2, 3, 7)) for _ in range(4000)])
    for i, k in enumerate((2, 3, 7)):
        ours = describe.drawn_repeats(distinct, types, -(-len(stream) // k), 3, 4000, rng)
        shares = [np.bincount(x, minlength=len(freqs)) / 4000 for x in (ours, plain[:, i])]
        assert abs(shares[0] - shares[1]).max() < 0.04
    assert describe.drawn_repeats(distinct, types, len(stream), 3, 2, rng).tolist() == [20, 20]
    assert describe.drawn_repeats(np.array([50]), np.array([1]), 25, 3, 3, rng).tolist() == [1, 1, 1]
    assert describe.drawn_repeats(np.array([1, 2]), np.array([9, 9]), 5, 3, 2, rng).tolist() == [0, 0]
    many = np.maximum(1, 6_666_666 // np.arange(1, 3_000_000))
    distinct, types = np.unique(many, return_counts=True)
    found = describe.drawn_repeats(distinct, types, -(-int(many.sum()) // 2), 3, 50, rng)
    half = [1 - sum(math.comb(int(f), x) for x in range(3)) / 2.0 ** int(f) for f in distinct[distinct < 900]]
    expected = np.dot(half, types[distinct < 900]) + types[distinct >= 900].sum()
    assert abs(found.mean() - expected) < 5 * found.std() / np.sqrt(50)


def test_boundaries_beside_letters(spark):
    """Patterns with boundaries find what Python's do, beside letters, optional ones, classes, subscripts and marks; texts are read once."""
    patterns = [r"\bmu\b", r"\bmu?\b", r"\bx*y\b", r"mu\b-", r"\b[mš]u\b", r"\bsag₂\b", r"kišib(?:₃)?\b", r"\s\bmu", r"\d\b", r"\b₃a", r"\ba|b\b", r"\bm{2}\b", r"a\b\s", r"\b\w+\b", r"u\b\bx", r"\x2d\b", r"\bu\b-"]
    rng = random.Random(1)
    texts = ["", "mu", "mu₂ mu_ mu-mu", "éa ₃a a₃a"] + ["".join(rng.choice("mušxyab₃₂_ -\n3é") for _ in range(rng.randint(1, 30))) + rng.choice(["", "mu", "kišib₃", " sag₂"]) for _ in range(300)]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "id long, g string, t string")
    for p in [*patterns, *(x.pattern for x in L.PROBES)]:
        got = {r.id: r.n for r in df.select("id", R.count(F.col("t"), p).alias("n")).collect()}
        assert got == {i: len(re.findall(p, t)) for i, t in enumerate(texts)}, p
    assert R.BOUNDARY not in R.portable(r"\bmu\b[^\n]{0,4}")
    hits = probes.hits(df, [probes.Probe("mu", r"\bmu\b", "r")], "g", "id", "t")
    assert "regexp" not in hits._jdf.queryExecution().optimizedPlan().toString().lower()
    assert hits.first().total_matches == sum(len(re.findall(r"\bmu\b", t)) for t in texts)


def test_spearman_takes_every_row(spark):
    """Values against numpy's ranks; few rows are exact, many near the exact p, and every source of the tables counts."""
    rng = np.random.default_rng(4)
    xs, ys = rng.random(20), rng.random(20)
    df = spark.createDataFrame([(f"s{i}", float(x), float(x + y)) for i, (x, y) in enumerate(zip(xs, ys))], "k string, x double, y double")
    r = permutation.spearman(df, "k", "x", "y").first()
    ranks = [np.argsort(np.argsort(v)) for v in (xs, xs + ys)]
    plain = [np.corrcoef(ranks[0], rng.permutation(20))[0, 1] for _ in range(20_000)]
    seen = np.corrcoef(*ranks)[0, 1]
    assert r.n == 20 and r.rho == pytest.approx(seen, abs=1e-6)
    assert r.p_one_sided == pytest.approx(np.mean(np.array(plain) >= seen - 1e-9), abs=0.02)
    assert r.p_two_sided == pytest.approx(np.mean(np.abs(plain) >= abs(seen) - 1e-9), abs=0.02)
    few = df.where("k IN ('s1', 's2', 's3', 's4', 's5')")
    some = sorted(few.collect())
    exact = stats.spearman_exact([x.x for x in some], [x.y for x in some])
    assert tuple(permutation.spearman(few, "k", "x", "y").first()) == (5, *(round(v, 6) for v in exact))
    assert tuple(permutation.spearman(few.limit(2), "k", "x", "y").first()) == (2, None, None, None)
    n = spark.read.parquet(f"{DATA}/documents.parquet").select("source").distinct().count()
    assert n > 6 and inference.spearman_exact(spark, DATA).first().n == n


def test_running_sums_by_blocks(spark):
    """Places and sums over blocks of keys equal those over the whole group; null groups and negative keys too."""
    rng = np.random.default_rng(2)
    data = [(("a", "b", None)[int(g)], int(k), int(w)) for g, k, w in zip(rng.integers(0, 3, 500), rng.permutation(60_000)[:500] - 30_000, rng.integers(0, 9, 500))]
    df = spark.createDataFrame(data, "g string, k long, w int").repartition(3)
    got = {(r.g, r.k): (r.place, r.total) for r in sampling.running(sampling.running(df, ["g"], "k"), ["g"], "k", F.col("w"), "total").collect()}
    for g in ("a", "b", None):
        mine = sorted((k, w) for h, k, w in data if h == g)
        assert [got[g, k] for k, _ in mine] == [(i, sum(w for _, w in mine[:i])) for i in range(len(mine))]


def test_goodness_of_fit(spark):
    """A sample of the law is not ruled out, one with a bump is."""
    rng = np.random.default_rng(5)
    support = np.arange(2, 100_000)
    weight = support**-2.3
    c = rng.multinomial(3000, weight / weight.sum())
    bump = c.copy()
    bump[40:44] += 400
    rows = [(g, int(x), int(n)) for g, cs in (("law", c), ("bump", bump)) for x, n in zip(support, cs) if n]
    df = spark.createDataFrame(rows, "genre string, value long, count long")
    got = {r.genre: r for r in powerlaw.goodness(df, 60).collect()}
    assert got["law"].p > 0.1 > got["bump"].p and got["law"].reps == 60
