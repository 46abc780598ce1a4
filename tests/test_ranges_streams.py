"""Ranks by ranges, streams compressed in one go, deep trees and the cache of vectors."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.operators import describe
from tabulon.operators import sealedlog as S
from tabulon.operators.ranks import ranked
from tabulon.sources import readers


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), i) for i in range(900)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(5), ["g"], [F.desc("v"), F.col("i")]).collect()
    groups = {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        groups.setdefault(g, []).append((v, i))
    assert len(got) == 900 and all(groups[r.g][r["rank"] - 1] == (r.v, r.i) for r in got)
    none = spark.createDataFrame([], "g string, v int")
    assert ranked(none, ["g"], [F.col("v")]).collect() == []


def test_one_hot_group_lies_in_several_partitions(spark):
    out = ranked(spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("v")), ["g"], [F.col("v")])
    assert out.where("rank <> v + 1").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan


def test_stream_is_compressed_whole(spark, monkeypatch):
    monkeypatch.setattr(describe, "PIECE", 64)
    rng = random.Random(5)
    streams = {g: [rng.choice(["a", "bb", "é", "dd" * 9, f"w{rng.randint(0, 400)}"]) for _ in range(n)] for g, n in (("x", 5000), ("y", 63), ("z", 64), ("w", 1))}
    rows = [(g, i, t) for g, ts in streams.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    got = {r.genre: r for r in describe.zlib_ratio(spark.createDataFrame(rows, "genre string, seq long, token string")).collect()}
    for g, ts in streams.items():
        raw = " ".join(ts).encode()
        assert got[g].raw_bytes == len(raw) and got[g].ratio == round(len(zlib.compress(raw, 9)) / len(raw), 6)


def test_streams_are_packed_and_dealt_apart(spark, monkeypatch):
    """A task reads packed pieces of one stream: what a stream is made of is whole and in order, and no two streams share a task."""
    monkeypatch.setattr(describe, "PIECE", 1000)
    monkeypatch.setattr(describe, "PACKED", 400)
    rng = random.Random(7)
    streams = {g: [rng.choice(["river", "é", f"w{rng.randint(0, 9)}"]) for _ in range(n)] for g, n in (("x", 2500), (None, 1700), ("z", 1))}
    rows = [(g, i, t) for g, ts in streams.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "genre string, seq long, token string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        parts = sorted(describe._packed(df, ["genre"], "seq").collect(), key=lambda r: (str(r.genre), r.piece, r.part))
        codec = pa.Codec("zstd")
        for g, ts in streams.items():
            own = [r for r in parts if r.genre == g]
            assert b" ".join(codec.decompress(bytes(r.data), r.size, asbytes=True) for r in own) == " ".join(ts).encode()
            assert len({r.piece for r in own}) == -(-len(ts) // 1000) and all(r.size < 400 + 50 * 6 for r in own)
        got = describe.zlib_ratio(df).select("*", F.spark_partition_id().alias("p")).collect()
        assert {r.genre: r.raw_bytes for r in got} == {g: len(" ".join(ts).encode()) for g, ts in streams.items()}
        assert len({r.p for r in got}) == len(streams)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_shuffled_ratio_is_that_of_shuffles(block):
    rng = random.Random(6)
    tokens = [rng.choice(["aa", "bbb", "cccc"]) if rng.random() < 0.7 else f"w{rng.randint(0, 60)}" for _ in range(1500)]
    counts = Counter(tokens)
    words = [w.encode() for w in counts]
    ours = [describe.shuffled_ratio(words, np.array(list(counts.values())), np.random.default_rng(s), block=block) for s in range(60)]
    theirs = []
    for _ in range(60):
        rng.shuffle(tokens)
        raw = " ".join(tokens).encode()
        theirs.append(len(zlib.compress(raw, 9)) / len(raw))
    assert abs(np.mean(ours) - np.mean(theirs)) < 0.003 and 0.4 < np.std(ours) / np.std(theirs) < 2.5


def test_redundancy(spark):
    rows = [("ordered", i, f"w{i % 40}") for i in range(2000)]
    r = describe.redundancy(spark.createDataFrame(rows, "genre string, seq long, token string"), reps=4).first()
    assert r.delta > 0.2 and abs(r.delta - (r.shuffled - r.ratio)) < 2e-6


def test_types_are_dealt_where_they_stand():
    """Blocks hold the types that fall to them alone, so a stream of rare types is not drawn for all blocks; nothing is lost."""
    rng = np.random.default_rng(3)
    counts = np.concatenate((np.ones(200_000, np.int64), [5000, 12, 0]))
    blocks = list(describe.dealt(counts, 40, rng))
    assert len(blocks) == 40 and sum(len(types) for types, _ in blocks) < 1.01 * 200_100
    total = np.zeros_like(counts)
    for types, drawn in blocks:
        assert (drawn > 0).all()
        total[types] += drawn
    assert (total == counts).all()
    sizes = np.array([drawn.sum() for _, drawn in blocks])
    assert abs(sizes - counts.sum() / 40).max() < 6 * np.sqrt(counts.sum() / 40)


def test_shuffles_of_long_streams_lie_in_tasks_of_their_own(spark):
    """With as many tasks as shuffles, no task has two; before, they met by hash. No row holds all types of a stream."""
    rows = [(g, i, f"w{i % 900}") for g, n in (("a", 3000), ("b", 2000)) for i in range(n)]
    work = describe.shuffles(spark.createDataFrame(rows, "genre string, seq long, token string"), 8, ["genre"])
    placed = work.select("genre", "rep__", F.spark_partition_id().alias("task"), F.size("types").alias("n")).collect()
    assert len({(r.genre, r.rep__) for r in placed}) == len({r.task for r in placed}) == len({(r.genre, r.rep__, r.task) for r in placed}) == 16
    assert {r.task for r in placed if r.genre == "a"} == set(range(8)) and max(r.n for r in placed) < 30
    assert sum(r.n for r in placed) == 16 * 900


def test_deep_trees(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 5000)] + [("m0", None), ("m1", "m0"), ("c1", "c2"), ("c2", "c1"), ("lost", "nowhere")]
    people = spark.createDataFrame(chain, "principal string, parent string").repartition(6)
    got = {r.principal: r.depth for r in S.descendants(people, "n7").collect()}
    assert got == {f"n{i}": i - 7 for i in range(7, 5000)}
    assert {r.principal: r.depth for r in S.descendants(people, "c1").collect()} == {"c1": 0, "c2": 1}
    assert S.descendants(people, "none").collect() == []
    seals = S.mint(people.where("principal LIKE 'n%'"), "root", F.lit(0.0))
    assert S.cascade(seals, people, "n10", 5.0).where("newly").count() == 4990


def test_cached_vectors(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def service(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked():
        out = sorted(x for p in log.iterdir() for x in p.read_text().split("\n"))
        for p in log.iterdir():
            p.unlink()
        return out

    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "line string")
    path = str(tmp_path / "cache")
    first = readers.embed_cached(df("a", "bb", "a", None), "line", service, path).collect()
    assert len(first) == 2 and asked() == ["a", "bb"]
    assert sorted(readers.embed_cached(df("bb", "a"), "line", service, path).collect()) == sorted(first) and asked() == []
    assert len(readers.embed_cached(df("a", "ccc"), "line", service, path).collect()) == 2 and asked() == ["ccc"]
    spark.read.parquet(path).limit(2).write.mode("append").parquet(path)  # an append that ran twice
    assert len(readers.embed_cached(df("a", "bb", "ccc"), "line", service, path).collect()) == 3 and asked() == []
    assert readers.embed_cached(df(), "line", service, str(tmp_path / "none")).collect() == []


def test_commit_numbers_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(7)
    for f in ("a", "b"):
        (tmp_path / f).write_text("\x01".join(rng.choice(["wip", "wip\n\nbody", "", " \n", f"fix {i}", "long " * 40]) for i in range(300)))

    def numbered():
        return sorted((r.msg, tuple(r.lines)) for r in readers.commit_log(spark, str(tmp_path)).collect())

    first = numbered()
    assert [m for m, _ in first] == list(range(len(first))) and 300 < len(first) < 600
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert numbered() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_streamed_numbers_have_no_gaps(spark, tmp_path):
    """A stream stopped and started again writes what one batch would; a batch that is run again changes nothing."""
    from tabulon.streaming import log as stream

    people, periods, asked = S.fixture(spark)
    asked = asked.withColumn("by_seal", F.when(F.col("request") % 7 == 3, "seal-nobody").otherwise(F.col("by_seal")))
    seals = S.mint(people, "root", F.lit(1_000.0))
    path = {name: str(tmp_path / name) for name in ("in", "log", "bad", "cp")}
    source = lambda: spark.readStream.schema(asked.schema).parquet(path["in"])
    for low, high in ((0, 3), (3, 4), (4, 30), (30, 50)):  # of the second, none may be written
        asked.where((F.col("request") >= low) & (F.col("request") < high)).write.mode("append").parquet(path["in"])
        stream.append(source(), seals, periods, path["log"], path["bad"], path["cp"]).awaitTermination(120)

    def written():
        return sorted(map(tuple, spark.read.parquet(path["log"]).drop("epoch").collect()), key=repr)

    expected = sorted(map(tuple, S.post(asked, seals, periods).collect()), key=repr)
    assert written() == expected and sorted(r[0] for r in expected) == list(range(43))
    assert spark.read.parquet(path["bad"]).count() == 7
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"))  # as if the last batch had failed after it wrote
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stream.append(source(), seals, periods, path["log"], path["bad"], path["cp"]).awaitTermination(120)
    assert written() == expected and spark.read.parquet(path["bad"]).count() == 7
