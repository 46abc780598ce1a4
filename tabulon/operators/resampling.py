"""Permutation and bootstrap tests at full size, drawn from sufficient statistics.

What a replicate needs of its rows is often a few counts. How many of k cuts fall on flagged lines, if cuts move at random
within n lines of which h are flagged, is hypergeometric; a bootstrap draw of n values is a multinomial over the
histogram of values; how many of the documents that get a label have their places in each bin depends on the counts by block of
documents alone. So rows are counted once, by Spark, and a replicate is drawn from the counts: no row is multiplied by the replicates.

Work is a row for each group of counts and each ``CHUNK`` of replicates. Draws are seeded by the group and the chunk, so they
are the same however the work is dealt; sums over the groups of a task leave it as one array a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.stats import permutation_p

#: Replicates drawn together; distinct values, or documents, of a block; lines of a group above which a draw is normal.
CHUNK, BLOCK, LARGEST = 500, 8192, 900_000_000


def generator(*key: object) -> np.random.Generator:
    """A generator that depends on its key alone."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=16).digest(), "little"))


def hits(rng: np.random.Generator, n: int, k: int, h: int, groups: int, size: int) -> np.ndarray:
    """For each replicate: flagged lines among the cuts, over ``groups`` groups of n lines with k cuts and h flagged lines each.

    A sum of many equal hypergeometric draws is drawn as one multinomial over their values. Above ``LARGEST`` lines a
    draw is the normal one of the same mean and variance, rounded: the library's draws end there.
    """
    if k == 0 or h == 0:
        return np.zeros(size)
    low, high = max(0, k + h - n), min(k, h)
    if low == high:
        return np.full(size, float(groups * low))
    if n > LARGEST:
        mean, variance = k * h / n, k * h / n * (n - h) / n * (n - k) / (n - 1)
        return np.clip(np.rint(rng.normal(groups * mean, math.sqrt(groups * variance), size)), groups * low, groups * high)
    if groups <= high - low + 1:
        return rng.hypergeometric(h, n - h, k, size=(size, groups)).sum(axis=1).astype(float)
    values = np.arange(low, high + 1)
    steps = np.log((h - values[:-1]) * (k - values[:-1])) - np.log((values[:-1] + 1.0) * (n - h - k + values[:-1] + 1.0))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    shares = np.exp(logs - logs.max())
    return rng.multinomial(groups, shares / shares.sum(), size=size) @ values.astype(float)


def drawn(work: DataFrame, keys: Sequence[str], reps: int, draw: Callable[[dict, int, int], np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """(keys, rep, sums): ``draw(row, first, size)`` gives an array (size, width) for each row of ``work``; rows of the same keys are added."""
    key_types = {k: work.schema[k].dataType.simpleString() for k in keys}
    names = ", ".join(f"`{k}` {t}" for k, t in key_types.items())
    schema = f"{names}, first long, width long, sums array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        first_type = None
        for batch in batches:
            first_type = [batch.schema.field(k).type for k in keys]
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                size = min(chunk, reps - row["first"])
                made = draw(row, row["first"], size)
                at = (*(row[k] for k in keys), row["first"])
                held[at] = held[at] + made if at in held else made
        if held:
            columns = [pa.array([at[i] for at in held], t) for i, t in enumerate(first_type)]
            columns += [pa.array([at[-1] for at in held], pa.int64()), pa.array([x.shape[1] for x in held.values()], pa.int64()), pa.array([x.ravel() for x in held.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "first", "width", "sums"])

    def added(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        total = np.sum([np.asarray(x.values) for x in group.column("sums")], axis=0).reshape(-1, width)
        first = group.column("first")[0].as_py()
        columns = [pa.array([group.column(k)[0].as_py()] * len(total), group.schema.field(k).type) for k in keys]
        return pa.table([*columns, pa.array(np.arange(first, first + len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=[*keys, "rep", "sums"])

    tasks = 4 * int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = work.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"), F.lit(chunk).cast("long"))))
    dealt = spread.repartition(tasks, F.xxhash64(*work.columns, "first"))
    return dealt.mapInArrow(run, schema).groupBy(*keys, "first").applyInArrow(added, f"{names}, rep long, sums array<double>")


def enrichment(lines: DataFrame, flags: Sequence[str], reps: int = 10_000, seed: int = 42, within: Sequence[str] = ("doc",), strata: int | None = None) -> DataFrame:
    """How much likelier each flag is on a line before a cut than on other lines, against cuts moved at random.

    ``lines`` has genre, doc, i, n, pre and the flags. Without ``strata`` cuts move within their document, with it within all lines of a
    genre at about the same relative place. One row a genre and flag: rates, the null's exact mean, its drawn mean and deviation,
    enrichment and the one-sided p.
    """
    group = ["genre", *within] if strata is None else ["genre", "stratum"]
    if strata is not None:
        lines = lines.withColumn("stratum", F.least(F.lit(strata - 1), F.floor(F.col("i") * strata / F.col("n"))))
    pre = F.col("pre").cast("long")
    marks = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("long").alias("hit")) for f in flags))).alias("x")
    long = lines.select(*group, pre.alias("pre"), marks).select(*group, "pre", "x.*")
    per = long.groupBy(*group, "flag").agg(F.count("*").alias("lines"), F.sum("pre").alias("cuts"), F.sum("hit").alias("flagged"), F.sum(F.col("pre") * F.col("hit")).alias("seen"))
    seen = per.groupBy("genre", "flag").agg(
        F.sum("cuts").alias("cuts"), F.sum("seen").alias("hit"), F.sum("lines").alias("lines"), F.sum("flagged").alias("flagged"),
        F.sum(F.col("cuts") * F.col("flagged") / F.col("lines")).alias("mean"),
    ).where("cuts > 0")
    alike = per.where("cuts > 0").groupBy("genre", "flag", "lines", "cuts", "flagged").agg(F.count("*").alias("groups"))

    def draw(row: dict, first: int, size: int) -> np.ndarray:
        rng = generator(seed, row["genre"], row["flag"], row["lines"], row["cuts"], row["flagged"], first)
        return hits(rng, row["lines"], row["cuts"], row["flagged"], row["groups"], size)[:, None]

    null = drawn(alike, ["genre", "flag"], reps, draw).select("genre", "flag", F.col("sums")[0].alias("null"))
    both = null.join(seen, ["genre", "flag"])
    out = both.groupBy("genre", "flag", "cuts", "hit", "lines", "flagged", "mean").agg(
        F.avg("null").alias("m"), F.stddev_samp("null").alias("sd"), F.count(F.when(F.col("null") >= F.col("hit"), 1)).alias("hits"), F.count("*").alias("reps")
    )
    rate = lambda c: F.round(F.col(c) / F.col("cuts"), 6)
    return out.select(
        "genre", "flag", "cuts", rate("hit").alias("rate_before"), F.round(F.try_divide(F.col("flagged") - F.col("hit"), F.col("lines") - F.col("cuts")), 6).alias("rate_other"),
        rate("mean").alias("null_mean"), rate("m").alias("drawn_mean"), rate("sd").alias("drawn_sd"), F.round(F.try_divide(F.col("hit"), F.col("mean")), 4).alias("enrichment"), F.round(permutation_p(F.col("hits"), F.col("reps")), 6).alias("p"),
    )


def _interval(means: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by).agg(ends.alias("ci")).select(*by, F.round(F.element_at("ci", 1), 6).alias("low"), F.round(F.element_at("ci", 2), 6).alias("high"))


def _blocked(counted: DataFrame, by: Sequence[str], item: str, payload: Sequence[str], block: int) -> DataFrame:
    """Rows of ``counted`` gathered into blocks of about ``block`` rows a group: (by, no, sizes, items), with every block's size by number.

    ``item`` is what a row counts for; sizes are few numbers, one a block, and go with each block.
    """
    total = counted.groupBy(*by).agg(F.count("*").alias("rows")).select(*by, F.ceil(F.col("rows") / block).alias("blocks"))
    numbered = counted.join(total, [*by]).withColumn("no", F.pmod(F.xxhash64(*payload), F.col("blocks")))
    filled = numbered.groupBy(*by, "no").agg(F.sum(item).alias("size"), F.sort_array(F.collect_list(F.struct(*payload, F.col(item).alias("times")))).alias("items"))
    sizes = filled.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("no", "size"))).alias("sizes"))
    return filled.join(sizes, [*by]).select(*by, "no", "items", "sizes")


def _place(row: dict) -> tuple[np.ndarray, int]:
    """Sizes of the blocks of a row's group, and which of them is the row's."""
    numbers = [s["no"] for s in row["sizes"]]
    return np.array([s["size"] for s in row["sizes"]], dtype=np.int64), numbers.index(row["no"])


def bootstrap_ci(values: DataFrame, by: Sequence[str], value: str, reps: int = 10_000, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """95 % percentile interval of the mean by group: (by, n, mean, low, high).

    A replicate draws as many values as there are, with replacement: first how many fall into each block of distinct values,
    which every block draws alike, and then how often each value of the block comes. Null values are left out.
    """
    some = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    blocks = _blocked(some.groupBy(*by, "v").agg(F.count("*").alias("times")), by, "times", ["v"], block)

    def draw(row: dict, first: int, size: int) -> np.ndarray:
        key = [row[b] for b in by]
        sizes, at = _place(row)
        mine = generator(seed, "blocks", *key, first).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=size)[:, at]
        v = np.array([x["v"] for x in row["items"]])
        times = np.array([x["times"] for x in row["items"]], dtype=np.float64)
        picked = generator(seed, "values", *key, row["no"], first).multinomial(mine, times / times.sum())
        return (picked @ v)[:, None]

    seen = some.groupBy(*by).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    means = drawn(blocks, by, reps, draw).join(seen, [*by]).select(*by, (F.col("sums")[0] / F.col("n")).alias("m"))
    return seen.join(_interval(means, by, "m"), [*by]).select(*by, "n", F.round("mean", 6).alias("mean"), "low", "high")


BINS = 10


def _bin(place: str) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.col(place) * BINS)).cast("int")


def entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of counts; 0 for a row of none."""
    n = counts.sum(axis=1, keepdims=True)
    q = counts / np.maximum(n, 1)
    return -(q * np.log2(np.where(q > 0, q, 1))).sum(axis=1)


def matched_entropy(places: DataFrame, label: str, pair: tuple[str, str], reps: int = 1000, seed: int = 42, place: str = "place") -> DataFrame:
    """Entropy of the larger label's places in subsamples as large as the smaller label's: (n, small_entropy, mean, low, high).

    A subsample's counts by bin are multivariate hypergeometric, so ten counts are all that is sampled from.
    """
    large, small = pair
    counted = places.where(F.col(label).isin(large, small)).groupBy(label, _bin(place).alias("bin")).agg(F.count("*").alias("c"))
    vector = lambda of: F.array(*(F.coalesce(F.sum(F.when((F.col("bin") == b) & (F.col(label) == of), F.col("c"))), F.lit(0)) for b in range(BINS)))
    one = counted.agg(vector(large).alias("large"), vector(small).alias("small")).withColumn("one", F.lit(1))

    def draw(row: dict, first: int, size: int) -> np.ndarray:
        counts, n = np.array(row["large"]), int(sum(row["small"]))
        return entropy(generator(seed, large, small, first).multivariate_hypergeometric(counts, min(n, int(counts.sum())), size=size, method="marginals"))[:, None]

    null = drawn(one, ["one"], reps, draw).select("one", F.col("sums")[0].alias("entropy"))
    n = F.aggregate("small", F.lit(0).cast("long"), lambda s, x: s + x)
    share = F.transform("small", lambda c: c / n)
    seen = one.select("one", n.alias("n"), F.round(F.abs(F.aggregate(share, F.lit(0.0), lambda s, q: s - F.when(q > 0, q * F.log2(q)).otherwise(0.0))), 6).alias("small_entropy"))
    mean = null.groupBy("one").agg(F.round(F.avg("entropy"), 6).alias("mean"))
    return seen.join(mean, "one").join(_interval(null, ["one"], "entropy"), "one").select("n", "small_entropy", "mean", "low", "high")


def stratified_entropy(places: DataFrame, doc: str, label: str, pair: tuple[str, str], size: str, reps: int = 5000, seed: int = 42, place: str = "place", block: int = BLOCK) -> DataFrame:
    """Difference in decile entropy of places between two labels, labels moved at random among documents of like length.

    Strata are quintiles of ``size`` over the documents of both labels. A document is its counts by bin; documents of
    equal counts are one row with how many there are. A replicate draws how many of a stratum's first label fall into each block,
    then how many of each kind of document in the block; the bins follow. One row: observed, null mean, p of both tails.
    """
    a, b = pair
    rows = places.where(F.col(label).isin(a, b))
    bins = [F.count(F.when(_bin(place) == k, 1)) for k in range(BINS)]
    docs = rows.groupBy(doc, label).agg(F.first(size).alias("size"), F.array(*bins).alias("bins"))
    cuts = docs.agg(F.percentile("size", F.array(*(F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)))).alias("cuts"))
    placed = docs.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.size(F.filter("cuts", lambda c: c <= F.col("size"))))  # one row of four numbers
    kinds = placed.groupBy("stratum", "bins").agg(F.count("*").alias("times"))
    labelled = placed.groupBy("stratum").agg(F.sum((F.col(label) == a).cast("long")).alias("k"))
    blocks = _blocked(kinds, ["stratum"], "times", ["bins"], block).join(labelled, "stratum").withColumn("one", F.lit(1))

    def draw(row: dict, first: int, size_: int) -> np.ndarray:
        sizes, at = _place(row)
        mine = generator(seed, "blocks", row["stratum"], first).multivariate_hypergeometric(sizes, row["k"], size=size_, method="marginals")[:, at]
        times = np.array([x["times"] for x in row["items"]], dtype=np.int64)
        vectors = np.array([x["bins"] for x in row["items"]], dtype=np.float64)
        rng = generator(seed, "documents", row["stratum"], row["no"], first)
        picked = np.stack([rng.multivariate_hypergeometric(times, int(m), method="marginals") for m in mine])
        return picked @ vectors

    total = placed.agg(*(F.sum(F.col("bins")[k]).alias(f"t{k}") for k in range(BINS)), *(F.sum(F.when(F.col(label) == a, F.col("bins")[k]).otherwise(0)).alias(f"s{k}") for k in range(BINS)))
    both = drawn(blocks, ["one"], reps, draw).crossJoin(F.broadcast(total))  # one row of sums

    def bits(counts: list) -> Column:
        n = sum(counts[1:], counts[0])
        terms = [F.when(c > 0, -c / n * F.log2(c / n)).otherwise(F.lit(0.0)) for c in counts]
        return F.abs(sum(terms[1:], terms[0]))

    drawn_a = [F.col("sums")[k] for k in range(BINS)]
    stat = bits(drawn_a) - bits([F.col(f"t{k}") - F.col("sums")[k] for k in range(BINS)])
    seen = bits([F.col(f"s{k}") for k in range(BINS)]) - bits([F.col(f"t{k}") - F.col(f"s{k}") for k in range(BINS)])
    out = both.select(F.round(stat, 9).alias("stat"), F.round(seen, 9).alias("seen")).groupBy("seen").agg(
        F.avg("stat").alias("m"), F.count(F.when(F.col("stat") >= F.col("seen"), 1)).alias("above"), F.count(F.when(F.col("stat") <= F.col("seen"), 1)).alias("below"), F.count("*").alias("reps")
    )
    up, down = permutation_p(F.col("above"), F.col("reps")), permutation_p(F.col("below"), F.col("reps"))
    return out.select(F.round("seen", 6).alias("observed"), F.round("m", 6).alias("null_mean"), F.round(up, 6).alias("p_upper"), F.round(down, 6).alias("p_lower"))
