"""Permutation inference with replicates as data: one row a replicate and unit, drawn by hash order.

Draws depend on the seed, the replicate and the unit's key alone, so results do not change with partitioning, and no
loop runs on the driver. Chunked documents are small rows; a replicate's statistic is summed before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

try:
    from _md5 import md5  # half the time of hashlib's for short texts
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.functions.arrays import let, let_all
from tabulon.functions.hashes import md5_heads
from tabulon.functions.stats import digest, permutation_p, spearman_exact, two_sided
from tabulon.operators.sampling import running
from tabulon.sources.shared import kept

def chunked(df: DataFrame, genre: str, key: str, text: str, marker: str = X.RULING, least: int = 4) -> DataFrame:
    """(genre, doc, tokens, lens): tokens of the kept chunks in a row, and the chunks' lengths."""
    parts = df.select(F.col(genre).alias("genre"), F.col(key).alias("doc"), X.chunks(F.col(text), marker, least).alias("cs")).where(F.size("cs") > 0)
    return parts.select("genre", "doc", F.flatten("cs").alias("tokens"), F.transform("cs", lambda c: F.size(c)).alias("lens"))


def shared(tokens: Column, lens: Column) -> Column:
    """(total, pairs): trigrams shared by adjacent chunks of the given lengths, and how many pairs there are."""

    def sets(tokens: Column, lens: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))

        def step(acc: Column, n: Column) -> Column:
            gram = F.array_distinct(X.ngram_keys(F.slice(tokens, acc["at"] + 1, n), 3))
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(gram)).alias("out"))

        return F.aggregate(lens, start, step, lambda acc: acc["out"])

    def total(s: Column) -> Column:
        common = F.transform(F.slice(s, 1, F.size(s) - 1), lambda x, i: F.size(F.array_intersect(x, F.element_at(s, i + 2))))
        return F.struct(F.aggregate(common, F.lit(0), lambda a, x: a + x).alias("total"), (F.size(s) - 1).alias("pairs"))

    return let_all(lambda tokens, lens: let(sets(tokens, lens), total), tokens=tokens, lens=lens)


def observed(chunks: DataFrame) -> DataFrame:
    """Mean shared trigrams of adjacent chunks by genre, weighted by pairs, and the share of texts with chunks of one length."""
    s = chunks.select("genre", shared(F.col("tokens"), F.col("lens")).alias("s"), (F.size(F.array_distinct("lens")) == 1).cast("int").alias("level"))
    out = s.groupBy("genre").agg(F.count("*").alias("docs"), F.sum("s.pairs").alias("pairs"), F.sum("s.total").alias("total"), F.round(F.avg("level"), 6).alias("degenerate"))
    return out.select("genre", "docs", "pairs", F.round(F.try_divide(F.col("total"), F.col("pairs")), 6).alias("mean_shared"), "degenerate")


def _order(seed: int, rep: int, doc: object, n: int) -> list[str]:
    """Hashes that order n things, the same as ``digest`` of seed, replicate, document and place."""
    start = hashlib.md5(f"{seed}|{rep}|{doc}|".encode())
    out = []
    for i in range(n):
        h = start.copy()
        h.update(b"%d" % i)
        out.append(h.hexdigest())
    return out


def permuted_lengths(seed: int, rep: int, doc: object, lens: list[int]) -> list[int]:
    """Null A: the chunk lengths in another order, over the same tokens."""
    return [n for _, n in sorted(zip(_order(seed, rep, doc, len(lens)), lens, strict=True))]


def scattered_lengths(seed: int, rep: int, doc: object, lens: list[int], least: int = 4) -> list[int]:
    """Null B: as many chunks, each of ``least`` tokens and of a multinomial share of the rest.

    Tokens beyond the least are dropped one by one into hashed chunks: multinomial with equal chances, which is not
    uniform over cuts but concentrates near equal lengths. Texts too short for it become one chunk.
    """
    total, m = sum(lens), len(lens)
    slack = total - least * m
    if slack < 0:
        return [total]
    out = [least] * m
    for h in _order(seed, rep, doc, slack + 1)[1:]:
        out[int(int(h[:8], 16) / 4294967296.0 * m)] += 1
    return out


def shuffled_tokens(seed: int, rep: int, doc: object, tokens: list) -> list:
    """Null C, a contrast only: it destroys all local structure, so everything differs from it."""
    return [t for _, t in sorted(zip(_order(seed, rep, doc, len(tokens)), tokens, strict=True))]


def drawn_lengths(key: Sequence, lens: list[int], reps: int, null: str, least: int = 4) -> np.ndarray:
    """Chunk lengths under null A or B, a row a replicate, from a generator of the text's own: as fast as many replicates need."""
    from tabulon.operators.resampling import generator

    rng, total, m = generator(*key), sum(lens), len(lens)
    slack = total - least * m
    if null == "A":
        return rng.permuted(np.tile(lens, (reps, 1)), axis=1)
    if slack < 0:
        return np.full((reps, 1), total)
    return rng.multinomial(slack, [1 / m] * m, size=reps) + least


def drawn_tokens(key: Sequence, tokens: np.ndarray, reps: int) -> np.ndarray:
    from tabulon.operators.resampling import generator

    rng = generator(*key)
    return np.stack([tokens[rng.permutation(len(tokens))] for _ in range(reps)])


def _repeated(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, places) of the trigrams that a text holds more than once, by trigram and place; others are never shared."""
    if len(tokens) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, grams, times = np.unique(np.stack([tokens[:-2], tokens[1:-1], tokens[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    grams = grams.ravel()
    places = np.flatnonzero(times[grams] > 1)
    order = np.argsort(grams[places], kind="stable")
    return grams[places][order], places[order]


#: Occurrences times replicates that are looked at together.
TOGETHER = 1 << 20


def shared_by_lengths(tokens: np.ndarray, lens: np.ndarray, repeated: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Trigrams shared by adjacent chunks of the same tokens, for each row of chunk lengths.

    Chunks follow the places, so a trigram is shared as often as the next chunk that holds it is the next chunk. ``repeated`` is what
    ``_repeated`` gives, where it is known.
    """
    grams, places = repeated or _repeated(tokens)
    out = np.zeros(len(lens), dtype=np.int64)
    if not len(grams):
        return out
    step, n = max(1, TOGETHER // len(grams)), len(tokens) + 3
    for i in range(0, len(lens), step):
        ends = np.cumsum(lens[i : i + step], axis=1)
        shift = n * np.arange(len(ends))[:, None]
        at = np.searchsorted((ends + shift).ravel(), (places + shift).ravel(), side="right").reshape(len(ends), -1)
        last = np.searchsorted((ends + shift).ravel(), (places + 2 + shift).ravel(), side="right").reshape(len(ends), -1)
        inside = at == last  # a trigram that runs over a chunk's end is in none
        before = np.maximum.accumulate(np.where(inside, np.arange(len(grams)), -1), axis=1)[:, :-1]
        chunk = np.take_along_axis(at, np.maximum(before, 0), 1)
        out[i : i + step] = (inside[:, 1:] & (before >= 0) & (grams[np.maximum(before, 0)] == grams[1:]) & (at[:, 1:] - chunk == 1)).sum(axis=1)
    return out


def shared_by_tokens(tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Trigrams shared by adjacent chunks of the same lengths, for each row of tokens, which are numbers below the row's length."""
    out, width, m = np.zeros(len(tokens), dtype=np.int64), tokens.shape[1], len(lens)
    chunks = np.repeat(np.arange(m), lens)
    starts = np.flatnonzero(chunks[:-2] == chunks[2:]) if width > 2 else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return out
    step, own = max(1, TOGETHER // len(starts)), chunks[starts]
    for i in range(0, len(tokens), step):
        t = tokens[i : i + step].astype(np.int64)
        pairs = t[:, starts] * width + t[:, starts + 1]
        if width**3 * m >= 1 << 62:  # pairs by rank, so that a code is never too large for its type
            pairs = np.unique(pairs, return_inverse=True)[1].reshape(pairs.shape)
        codes = np.sort((pairs * width + t[:, starts + 2]) * m + own, axis=1)
        gram, chunk = np.divmod(codes, m)
        out[i : i + step] = ((gram[:, 1:] == gram[:, :-1]) & (chunk[:, 1:] - chunk[:, :-1] == 1)).sum(axis=1)
    return out


#: Replicates of a document that are drawn together.
REPLICATES = 250


def overlap_null(chunks: DataFrame, null: str, reps: int, seed: int = 42, least: int = 4, hashed: bool = True) -> DataFrame:
    """(genre, rep, stat) under null A, B or C; draws come from hashes, as SQL can follow, or else from a generator for each text and batch.

    A row of work is a document, which is shuffled once; REPLICATES replicates are compared as arrays, and sums of a batch leave the task.
    """
    if null not in ("A", "B", "C"):
        raise ValueError(f"no null {null!r}")
    # rows are small and their work is not, so the number of tasks is given, or they would be put together again
    tasks = 4 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = chunks.select("genre", F.col("doc").cast("string").alias("doc"), "tokens", "lens").repartition(tasks, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for row in batch.to_pylist():
                doc, lens = row["doc"], row["lens"]
                known: dict[str, int] = {}
                tokens = np.array([known.setdefault(t, len(known)) for t in row["tokens"]], dtype=np.int64)
                repeated = _repeated(tokens)
                for first in range(0, reps, REPLICATES):
                    here = range(first, min(first + REPLICATES, reps))
                    key = (seed, null, doc, first)
                    if null == "C":
                        drawn = np.array([shuffled_tokens(seed, rep, doc, tokens.tolist()) for rep in here]) if hashed else drawn_tokens(key, tokens, len(here))
                        total, pairs = shared_by_tokens(drawn, np.array(lens)), len(lens) - 1
                    elif not len(repeated[0]):
                        total, pairs = np.zeros(len(here), dtype=np.int64), 0 if null == "B" and sum(lens) < least * len(lens) else len(lens) - 1
                    else:
                        order = permuted_lengths if null == "A" else lambda *x: scattered_lengths(*x, least)
                        drawn = np.array([order(seed, rep, doc, lens) for rep in here]) if hashed else drawn_lengths(key, lens, len(here), null, least)
                        total, pairs = shared_by_lengths(tokens, drawn, repeated), drawn.shape[1] - 1
                    held = sums.setdefault((row["genre"], first), [np.zeros(len(here), dtype=np.int64), 0])
                    held[0] += total
                    held[1] += pairs
            rows = [(g, first + i, t, pairs) for (g, first), (total, pairs) in sums.items() for i, t in enumerate(total.tolist())]
            genres, numbers, totals, pairs = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_pydict({"genre": pa.array(genres, pa.string()), "rep": pa.array(numbers, pa.int32()), "total": pa.array(totals, pa.int64()), "pairs": pa.array(pairs, pa.int64())})

    out = work.mapInArrow(run, "genre string, rep int, total long, pairs long").groupBy("genre", "rep").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return out.select("genre", "rep", F.try_divide(F.col("total"), F.col("pairs")).alias("stat"))


def overlap_test(chunks: DataFrame, null: str, reps: int, seed: int = 42, least_pairs: int = 0, hashed: bool = True) -> DataFrame:
    """Observed against null: difference and p values of both tails; null p values below ``least_pairs`` pairs."""
    seen = observed(chunks).select("genre", "pairs", F.col("mean_shared").alias("seen"))
    both = overlap_null(chunks, null, reps, seed, hashed=hashed).join(seen, "genre").withColumn("stat", F.round("stat", 6))
    out = both.groupBy("genre", "pairs", "seen").agg(
        F.avg("stat").alias("null_mean"), F.count(F.when(F.col("stat") >= F.col("seen"), 1)).alias("above"), F.count(F.when(F.col("stat") <= F.col("seen"), 1)).alias("below"), F.count("*").alias("reps")
    )
    up, down = permutation_p(F.col("above"), F.col("reps")), permutation_p(F.col("below"), F.col("reps"))
    some = F.col("pairs") >= least_pairs
    return out.select(
        "genre", "pairs", F.col("seen").alias("observed"), F.round("null_mean", 6).alias("null_mean"), F.round(F.col("seen") - F.col("null_mean"), 6).alias("delta"),
        F.when(some, F.round(up, 6)).alias("p_upper"), F.when(some, F.round(down, 6)).alias("p_lower"), F.when(some, F.round(two_sided(up, down), 6)).alias("p"),
    )


#: Values of a row of work, values that are held, places that are drawn together, and replicates of a key of work.
VALUES, HELD, PLACES, BOOTSTRAPS = 4096, 1 << 22, 1 << 14, 250


def _bootstrap_sums(values: pa.Array, first: int, n: int, heads: Sequence[bytes]) -> list[tuple[float, int]]:
    """(sum, number of known) of the ``values`` that a replicate draws, a pair for each of the prefixes ``heads`` of its hashes.

    The values stand from place ``first`` on among ``n``; a draw that falls elsewhere adds nothing.
    """
    known = None if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    v, out = values.fill_null(0).to_numpy(zero_copy_only=False), [[0.0, 0] for _ in heads]
    for low in range(0, n, PLACES):
        for held, head in zip(out, heads, strict=True):
            at = (md5_heads(head, low, min(low + PLACES, n)) / 4294967296.0 * n).astype(np.int64)
            if len(v) < n:
                at = at[(at >= first) & (at < first + len(v))] - first
            held[0] += float(v[at].sum())
            held[1] += len(at) if known is None else int(known[at].sum())
    return [tuple(x) for x in out]


def bootstrap_ci(values: DataFrame, by: Sequence[str], key: str, value: str, reps: int, seed: int = 42) -> DataFrame:
    """95 % percentile interval of the mean: each replicate draws as many rows as there are, with replacement, by hash.

    A draw is a place in the order of keys. A key of work is a group and BOOTSTRAPS replicates, to which the group's values come in
    order, VALUES a row; draws are hashed as arrays, and a pair of sums a replicate leaves the task. Where a group has more than HELD
    values, its draws are hashed again for each HELD of them, so no task holds more.
    """
    numbers = values.groupBy(*by).agg(F.count("*").alias("n"))  # a row a group
    placed = running(values.select(*by, key, F.col(value).cast("double").alias("v")), by, key, name="at")
    parts = placed.groupBy(*by, F.floor(F.col("at") / VALUES).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vs"))
    head = F.concat_ws("|", *(F.col(b).cast("string") for b in by))
    each = parts.join(F.broadcast(numbers), [*by]).select(*by, head.alias("head"), "n", "part", "vs", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(BOOTSTRAPS))).alias("from"))
    tasks = 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = each.repartition(tasks, *by, "from").sortWithinPartitions(*by, "from", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, held, at, first = None, None, [], None, 0

        def sums() -> pa.RecordBatch:
            head, n, low = at
            heads = [f"{seed}|{rep}|{head}|".encode() for rep in range(low, min(low + BOOTSTRAPS, reps))]
            found = _bootstrap_sums(pa.concat_arrays(held), first, n, heads)
            same = [c.take(pa.array([0] * len(found))) for c in own]
            made = pa.array(range(low, low + len(found)), pa.int32()), pa.array([t for t, _ in found], pa.float64()), pa.array([k for _, k in found], pa.int64())
            return pa.RecordBatch.from_arrays([*same, *made], names=[*by, "rep", "total", "known"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = [batch.column(c)[i].as_py() for c in (*by, "from")]
                if key is not None and (now != key or sum(map(len, held)) >= HELD):
                    yield sums()
                    first, held = first + sum(map(len, held)) if now == key else 0, []
                own, key, at = [batch.column(c).slice(i, 1) for c in by], now, [batch.column(c)[i].as_py() for c in ("head", "n", "from")]
                held.append(batch.column("vs")[i].values)
        if key is not None:
            yield sums()

    schema = ", ".join(f"`{b}` {values.schema[b].dataType.simpleString()}" for b in by) + ", rep int, total double, known long"
    means = work.mapInArrow(run, schema).groupBy(*by, "rep").agg(F.try_divide(F.sum("total"), F.sum("known")).alias("mean"))
    out = means.groupBy(*by).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    seen = values.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return seen.join(out, [*by]).select(*by, "n", F.round("mean", 6).alias("mean"), F.round(F.element_at("ci", 1), 6).alias("low"), F.round(F.element_at("ci", 2), 6).alias("high"))


# --- markers before boundaries ---


def interior_lines(docs: DataFrame, genre: str, key: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """(genre, doc, i, n, pre, line, …flags over ``line``): lines but the last, and whether a cut follows."""
    rows = docs.select(F.col(genre).alias("genre"), F.col(key).alias("doc"), F.size("lines").alias("n"), "truth", F.posexplode("lines").alias("i", "line"))
    out = rows.where(F.col("i") < F.col("n") - 1).withColumn("pre", F.array_contains("truth", F.col("i"))).drop("truth")
    return out.withColumns(flags) if flags else out


#: Hashes of lines that are ordered together.
HASHES = 1 << 20


def _within_documents(docs: DataFrame, flags: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(genre, rep, lines, then sum and number of known values of each flag): of lines drawn in each replicate; -1 stands for lines before a cut, -2 for the others.

    ``docs`` has a row a document, with its lines as structs of i, pre and the flags. Replicates of a document are ordered as arrays
    where the document lies, and sums of a batch leave the task.
    """
    ks = [f"{x}{j}" for j in range(len(flags)) for x in ("t", "n")]
    width = reps + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ls")
            ends, lines = np.asarray(lists.offsets).astype(np.int64), lists.values
            sizes, names = np.diff(ends), batch.column("genre").dictionary_encode()
            own, doc = np.repeat(np.asarray(names.indices).astype(np.int64), sizes), np.repeat(np.arange(len(sizes)), sizes)
            lines = lines.slice(int(ends[0]), len(doc))
            starts = ends[:-1] - ends[0]
            pre = np.asarray(lines.field("pre").to_numpy(zero_copy_only=False), dtype=bool)
            k = np.bincount(doc, weights=pre, minlength=len(sizes)).astype(np.int64)
            values = [(v.fill_null(False).to_numpy(zero_copy_only=False).astype(np.float64), v.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)) for v in (lines.field(f) for f in flags)]
            sums = np.zeros((1 + len(ks), len(names.dictionary) * width), dtype=np.int64)

            def add(places: np.ndarray, cell: np.ndarray) -> None:
                sums[0] += np.bincount(cell, minlength=sums.shape[1])
                for j, (t, n) in enumerate(values):
                    sums[1 + 2 * j] += np.bincount(cell, weights=t[places], minlength=sums.shape[1]).astype(np.int64)
                    sums[2 + 2 * j] += np.bincount(cell, weights=n[places], minlength=sums.shape[1]).astype(np.int64)

            def draw(hashes: list[bytes], some: list[int]) -> None:
                h = np.frombuffer(b"".join(hashes), dtype=">u8").reshape(-1, 2).astype(np.uint64)
                groups, n = np.repeat(some, reps), sizes[some]  # a group is a document and a replicate
                each = np.repeat(n, reps)
                first = np.cumsum(each) - each
                group = np.repeat(np.arange(len(groups)), each)
                within = np.arange(len(group)) - first[group]
                order = np.argsort(h[:, 0])
                order = order[np.argsort(group[order], kind="stable")]
                if ((h[order[1:], 0] == h[order[:-1], 0]) & (group[order[1:]] == group[order[:-1]])).any():  # the rest of the hash decides
                    order = np.lexsort((h[:, 1], h[:, 0], group))
                taken = order[within < k[groups][group]]
                places = starts[groups[group[taken]]] + within[taken]
                add(places, own[places] * width + 2 + group[taken] % reps)

            if len(doc):
                add(np.arange(len(doc)), own * width + np.where(pre, 1, 0))
            tails, keys = [b"%d" % i for i in lines.field("i").to_pylist()], batch.column("doc").to_pylist()
            hashes, some = [], []
            for d in np.flatnonzero(k).tolist():
                if keys[d] is None:
                    continue
                mine, key = tails[starts[d] : starts[d] + sizes[d]], keys[d].encode()
                for rep in range(reps):
                    head = b"%d|%d|%s|" % (seed, rep, key)
                    hashes += [md5(head + t).digest() for t in mine]
                some.append(d)
                if len(hashes) >= HASHES:
                    draw(hashes, some)
                    hashes, some = [], []
            if some:
                draw(hashes, some)
            cells = np.flatnonzero(sums[0])
            genres = names.dictionary.take(pa.array(cells // width))
            yield pa.RecordBatch.from_arrays([genres, pa.array((cells % width - 2).astype(np.int32)), *(pa.array(x[cells]) for x in sums)], names=["genre", "rep", "lines", *ks])

    schema = f"genre {docs.schema['genre'].dataType.simpleString()}, rep int, lines long, " + ", ".join(f"{c} long" for c in ks)
    rows = docs.where(F.col("genre").isNotNull()).select("genre", F.col("doc").cast("string").alias("doc"), "ls").mapInArrow(run, schema)
    return rows.groupBy("genre", "rep").agg(*(F.sum(c).alias(c) for c in ("lines", *ks)))


def _over_documents(lines: DataFrame, flags: Sequence[str], reps: int, seed: int, group: Sequence[str]) -> DataFrame:
    """The same for groups of any size, which are never sorted whole: the first digits of hashes are counted, and only lines that
    share the digits of the last one drawn are put in order."""
    sums = [F.count("*").alias("lines")] + [c for j, f in enumerate(flags) for c in (F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f"t{j}"), F.count(f).alias(f"n{j}"))]
    seen = lines.withColumn("rep", F.when(F.col("pre"), -1).otherwise(-2)).groupBy("genre", "rep").agg(*sums)
    k = lines.groupBy(*group).agg(F.sum(F.col("pre").cast("int")).alias("k")).where("k > 0")
    h = digest(seed, F.col("rep").cast("string"), F.col("doc").cast("string"), F.col("i").cast("string"))
    drawn = lines.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("h", h).withColumn("b", F.substring("h", 1, 3))
    counted = drawn.groupBy("rep", *group, "b").agg(F.count("*").alias("c")).join(k, list(group))
    # a row for each of 4096 digits at most
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("rep", *group).orderBy("b")))
    last = upto.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("rep", *group, F.col("b").alias("last"), (F.col("k") - F.col("upto") + F.col("c")).alias("need"))
    near = drawn.join(last, ["rep", *group]) if "doc" in group else drawn.join(F.broadcast(last), ["rep", *group])  # strata are few
    below = near.where("b < last").groupBy("genre", "rep").agg(*sums)
    ranked = near.where("b = last").withColumn("r", F.row_number().over(Window.partitionBy("rep", *group).orderBy("h")))
    parts = below.unionByName(ranked.where("r <= need").groupBy("genre", "rep").agg(*sums)).unionByName(seen)
    return parts.groupBy("genre", "rep").agg(*(F.sum(c).alias(c) for c in parts.columns[2:]))


def enrichment(lines: DataFrame, flags: Sequence[str], reps: int, seed: int = 42, within: Sequence[str] = ("doc",), strata: int | None = None) -> DataFrame:
    """How much likelier each flag is on a line before a cut than on other lines, against permuted cuts.

    Without ``strata`` cuts move within their document. With it, they move over all documents of a genre among lines at
    about the same relative place: the null keeps how often cuts stand where in a document. ``lines`` may hold a row a document
    with its lines as an array ``ls``, which spares a shuffle.
    """
    if strata is None and tuple(within) == ("doc",):
        if "ls" not in lines.columns:
            lines = lines.groupBy("genre", "doc").agg(F.collect_list(F.struct("i", "pre", *flags)).alias("ls"))
        sums = _within_documents(lines, flags, reps, seed)
    elif strata is None:
        sums = _over_documents(lines, flags, reps, seed, ["genre", *within])
    else:
        sums = _over_documents(lines.withColumn("stratum", F.least(F.lit(strata - 1), F.floor(F.col("i") * strata / F.col("n")))), flags, reps, seed, ["genre", "stratum"])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.try_divide(F.col(f"t{j}"), F.col(f"n{j}")).alias("stat")) for j, f in enumerate(flags)))).alias("x")
    sums = sums.select("genre", "rep", "lines", each).select("genre", "rep", "lines", "x.*")
    one = Window.partitionBy("genre", "flag")  # a row a replicate
    at = lambda rep, c: F.max(F.when(F.col("rep") == rep, F.col(c))).over(one)
    both = sums.withColumns({"cuts": F.coalesce(at(-1, "lines"), F.lit(0)), "pre": at(-1, "stat"), "other": at(-2, "stat")}).where("rep >= 0")
    out = both.groupBy("genre", "flag", "cuts", "pre", "other").agg(F.avg("stat").alias("null_rate"), F.count(F.when(F.round("stat", 9) >= F.round("pre", 9), 1)).alias("hits"), F.count("*").alias("reps"))
    return out.select(
        "genre", "flag", "cuts", F.round("pre", 6).alias("rate_before"), F.round("other", 6).alias("rate_other"), F.round("null_rate", 6).alias("null_rate"),
        F.round(F.try_divide(F.col("pre"), F.col("null_rate")), 4).alias("enrichment"), F.round(permutation_p(F.col("hits"), F.col("reps")), 6).alias("p"),
    )


# --- where formulas stand ---


def stratified_entropy(places: DataFrame, doc: str, label: str, pair: tuple[str, str], size: str, reps: int, seed: int = 42) -> DataFrame:
    """Difference in decile entropy of places between two labels, labels permuted among documents of like length.

    Length strata are quintiles over documents of both labels. One row: observed difference, null mean, p of both tails.
    """
    from tabulon.operators.describe import decile_entropy

    a, b = pair
    docs = places.where(F.col(label).isin(a, b)).groupBy(doc, label).agg(F.first(size).alias("size"))
    cuts = docs.agg(F.percentile("size", F.array(*(F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)))).alias("cuts"))
    placed = docs.crossJoin(cuts).withColumn("stratum", F.size(F.filter("cuts", lambda c: c <= F.col("size"))))
    k = placed.groupBy("stratum").agg(F.sum((F.col(label) == a).cast("int")).alias("k"))
    reps_ = placed.join(k, "stratum").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    h = digest(seed, F.col("rep").cast("string"), F.col(doc).cast("string"))
    drawn = reps_.withColumn("r", F.row_number().over(Window.partitionBy("rep", "stratum").orderBy(h))).select(doc, "rep", F.when(F.col("r") <= F.col("k"), a).otherwise(b).alias("as_label"))
    rows = places.where(F.col(label).isin(a, b))
    null = decile_entropy(rows.join(drawn, doc), ["rep", "as_label"]).groupBy("rep").agg(
        (F.max(F.when(F.col("as_label") == a, F.col("entropy"))) - F.max(F.when(F.col("as_label") == b, F.col("entropy")))).alias("stat")
    )
    by = decile_entropy(rows, [label])
    seen = by.agg((F.max(F.when(F.col(label) == a, F.col("entropy"))) - F.max(F.when(F.col(label) == b, F.col("entropy")))).alias("seen"))
    out = null.crossJoin(seen).groupBy("seen").agg(F.avg("stat").alias("m"), F.count(F.when(F.round("stat", 6) >= F.round("seen", 6), 1)).alias("above"), F.count(F.when(F.round("stat", 6) <= F.round("seen", 6), 1)).alias("below"), F.count("*").alias("reps"))
    up, down = permutation_p(F.col("above"), F.col("reps")), permutation_p(F.col("below"), F.col("reps"))
    return out.select(F.round("seen", 6).alias("observed"), F.round("m", 6).alias("null_mean"), F.round(up, 6).alias("p_upper"), F.round(down, 6).alias("p_lower"))


def matched_entropy(places: DataFrame, label: str, pair: tuple[str, str], key: str, reps: int, seed: int = 42) -> DataFrame:
    """Entropy of the larger label in subsamples as large as the smaller label's: mean and 95 % interval."""
    from tabulon.operators.describe import decile_entropy

    large, small = pair
    n = places.where(F.col(label) == small).agg(F.count("*").alias("n"))
    drawn = places.where(F.col(label) == large).crossJoin(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    h = digest(seed, F.col("rep").cast("string"), F.col(key).cast("string"))
    picked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(h))).where("r <= n").select("rep", "place")
    ent = decile_entropy(picked, ["rep"])
    seen = decile_entropy(places.where(F.col(label) == small), [label]).select(F.col("n").alias("n"), F.col("entropy").alias("small_entropy"))
    out = ent.agg(F.round(F.avg("entropy"), 6).alias("mean"), F.percentile("entropy", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return seen.crossJoin(out).select("n", "small_entropy", "mean", F.round(F.element_at("ci", 1), 6).alias("low"), F.round(F.element_at("ci", 2), 6).alias("high"))


def spearman(df: DataFrame, key: str, x: str, y: str, reps: int = 9999, seed: int = 42) -> DataFrame:
    """Rank correlation over all rows, a row a group: (n, rho, p_two_sided, p_one_sided), one-sided for a positive one.

    p is exact up to 9 rows; above, one set of ranks is shuffled ``reps`` times by hash order. Ties are ranked by key, rows
    without both values are left out, and below 3 rows rho and p are null. Groups are few, so a window holds them all.
    """
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    places = [F.row_number().over(Window.orderBy(c, "k")).alias(n) for c, n in (("x", "a"), ("y", "b"))]
    ranked = kept(some.select("k", *places), "ranks")
    first = ranked.orderBy("k").limit(10).collect()
    if len(first) <= 9:
        made = spearman_exact([r["a"] for r in first], [r["b"] for r in first]) if len(first) > 2 else (None,) * 3
        return df.sparkSession.createDataFrame([(len(first), *(v if v is None else round(v, 6) for v in made))], "n int, rho double, p_two_sided double, p_one_sided double")
    seen = ranked.agg(F.count("*").cast("int").alias("n"), F.corr("a", "b").alias("rho"))
    drawn = ranked.crossJoin(F.broadcast(df.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    order = Window.partitionBy("rep").orderBy(digest(seed, F.col("rep").cast("string"), F.col("k").cast("string")), "k")
    null = drawn.select("rep", "a", F.row_number().over(order).alias("b")).groupBy("rep").agg(F.corr("a", "b").alias("r"))
    hits = null.crossJoin(F.broadcast(seen)).groupBy("n", "rho").agg(
        F.count(F.when(F.abs("r") >= F.abs("rho") - 1e-9, 1)).alias("two"), F.count(F.when(F.col("r") >= F.col("rho") - 1e-9, 1)).alias("one"), F.count("*").alias("reps")
    )
    p = {f"p_{name}_sided": F.round(permutation_p(F.col(name), F.col("reps")), 6) for name in ("two", "one")}
    return hits.select("n", F.round("rho", 6).alias("rho"), *(c.alias(n) for n, c in p.items()))
