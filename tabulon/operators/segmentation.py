"""Segmentation of documents: where to cut a list of lines, and how good the cuts are.

A document is a row with ``lines`` and, where known, ``truth``: sorted places of cuts, 0-based, a cut after line i, interior
only. Planners add ``cuts`` of the same form. What can be said in array functions is; the solvers that search over cut
sets run a document at a time in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import text as X
from tabulon.functions.arrays import let, let_all
from tabulon.functions.stats import benjamini_hochberg, digest, sign_test
from tabulon.operators.sampling import running, spread

_INTS = "array<int>"
MIN_TOKENS = 4
MOST_COMBINATIONS = 200_000


def none() -> Column:
    return F.array().cast(_INTS)


def span(start: Column | int, end: Column) -> Column:
    """start .. end, empty if end is lower."""
    first = F.lit(start) if isinstance(start, int) else start
    return F.when(end >= first, F.sequence(first.cast("int"), end.cast("int"))).otherwise(none())


# --- planners that know the number of segments ---


def equal_cuts(n: Column, k: Column) -> Column:
    """k segments of about equal length; rounding is half to even, repeated cuts fall together."""

    def cuts(n: Column, k: Column) -> Column:
        at = lambda i: F.greatest(F.lit(0), F.least(n - 2, F.bround(i * n / k).cast("int") - 1))
        return F.when((k < 2) | (n < 2), none()).otherwise(F.array_sort(F.array_distinct(F.transform(span(1, k - 1), at))))

    return let_all(cuts, n=n, k=k)


def marker_places(marks: Column) -> Column:
    """Interior places of marker lines."""
    return let(marks, lambda a: F.filter(F.transform(a, lambda m, i: F.when(m, i)), lambda i: i.isNotNull() & (i < F.size(a) - 1)))


def marker_cuts(marks: Column, k: Column) -> Column:
    """The first k - 1 marker lines; too few are filled up with equal cuts; none at all gives equal cuts."""

    def cuts(m: Column, equal: Column, k: Column) -> Column:
        fill = F.slice(F.array_except(equal, m), 1, F.greatest(k - 1 - F.size(m), F.lit(0)))
        return F.when(k < 2, none()).when(F.size(m) >= k - 1, F.slice(m, 1, F.greatest(k - 1, F.lit(0)))).otherwise(F.array_sort(F.concat(m, fill)))

    return let_all(lambda marks, k: let_all(cuts, m=marker_places(marks), equal=equal_cuts(F.size(marks), k), k=k), marks=marks, k=k)


def random_cuts(docs: DataFrame, reps: int, key: str = "doc_id", n: str = "n", k: str = "k", seed: int = 42) -> DataFrame:
    """``docs`` times ``reps`` draws of k - 1 cuts without replacement, by hash order."""
    drawn = docs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    order = F.transform(span(0, F.col(n) - 2), lambda i: F.struct(digest(seed, F.col("rep").cast("string"), F.col(key).cast("string"), i.cast("string")).alias("h"), i.alias("i")))
    some = F.slice(F.array_sort(order), 1, F.greatest(F.col(k) - 1, F.lit(0)))
    return drawn.withColumn("cuts", F.array_sort(F.transform(some, lambda s: s["i"])))


# --- planners that do not ---


def marker_cuts_unknown_k(marks: Column) -> Column:
    """A cut at the last line of each run of markers, none at the end of the document."""

    def cuts(a: Column) -> Column:
        last = lambda m, i: m & (i < F.size(a) - 1) & ~F.coalesce(F.get(a, i + 1), F.lit(False))
        return F.filter(F.transform(a, lambda m, i: F.when(last(m, i), i)), lambda i: i.isNotNull())

    return let(marks, cuts)


def length_prior_cuts(n: Column, length: Column) -> Column:
    """Every ``length`` lines."""
    return F.when((length >= 1) & (length - 1 <= n - 2), F.sequence((length - 1).cast("int"), (n - 2).cast("int"), length.cast("int"))).otherwise(none())


def length_prior(docs: DataFrame, by: Sequence[str], key: str, sizes: str) -> DataFrame:
    """(…, length): max(2, rounded median) of segment lengths over documents at even places."""
    held = running(docs, by, key, name="__place").where("__place % 2 = 0")
    one = held.select(*by, F.explode(sizes).alias("len"))
    return one.groupBy(*by).agg(F.greatest(F.lit(2), F.bround(F.percentile("len", 0.5)).cast("int")).alias("length"))


def threshold_cuts(scores: Column, z: float = 0.5) -> Column:
    """Gaps whose score is strictly above the mean by ``z`` population deviations."""

    def above(scores: Column, bar: Column) -> Column:
        return F.filter(F.transform(scores, lambda x, i: F.when(x > bar, i)), lambda i: i.isNotNull())

    def with_mean(scores: Column, mean: Column) -> Column:
        sd = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(scores))
        return let_all(above, scores=scores, bar=F.round(mean + z * sd, 9))

    def cuts(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        return F.when(F.size(a) == 0, none()).otherwise(let_all(with_mean, scores=a, mean=mean))

    return let(scores, cuts)


# --- gap scores ---


def line_trigrams(line_tokens: Column) -> Column:
    return F.array_distinct(X.ngram_keys(line_tokens, 3))


def _span_trigrams(tokens: Column, first: Column, length: Column) -> Column:
    return line_trigrams(F.flatten(F.slice(tokens, first, length)))


def lexical_gaps(tokens: Column, width: int = 2) -> Column:
    """1 - set cosine of trigrams of up to ``width`` lines on either side of each gap; 1 where a side has none.

    ``tokens`` are the token arrays of the lines.
    """

    def between(left: Column, right: Column) -> Column:
        a, b = F.size(left), F.size(right)
        return F.when((a == 0) | (b == 0), F.lit(1.0)).otherwise(1 - F.size(F.array_intersect(left, right)) / F.sqrt((a * b).cast("double")))

    def scores(ts: Column) -> Column:
        def score(i: Column) -> Column:
            left = _span_trigrams(ts, F.greatest(i - width + 2, F.lit(1)), F.least(i + 1, F.lit(width)))
            return let_all(between, left=left, right=_span_trigrams(ts, i + 2, F.lit(width)))

        return F.transform(span(0, F.size(ts) - 2), lambda i: F.round(score(i), 9))

    return let(tokens, scores)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def vector_gaps(vectors: Column, width: int = 2) -> Column:
    """1 - cosine of the mean vectors of up to ``width`` lines on either side of each gap; cosines of zero vectors are 0."""

    def total(vs: Column, first: Column, length: Column) -> Column:
        zero = F.transform(F.element_at(vs, 1), lambda x: F.lit(0.0))
        return F.aggregate(F.slice(vs, first, length), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))

    def scores(vs: Column) -> Column:
        def score(i: Column) -> Column:
            left = total(vs, F.greatest(i - width + 2, F.lit(1)), F.least(i + 1, F.lit(width)))
            return 1 - F.coalesce(let_all(cosine, a=left, b=total(vs, i + 2, F.lit(width))), F.lit(0.0))

        return F.transform(span(0, F.size(vs) - 2), lambda i: F.round(score(i), 9))

    return let(vectors, scores)


def feasible(sizes: Column, cuts: Column, least: int = MIN_TOKENS) -> Column:
    """Whether every segment has ``least`` tokens; ``sizes`` are token counts of lines."""

    def check(sizes: Column, ends: Column) -> Column:
        total = lambda a, b: F.aggregate(F.slice(sizes, a + 2, b - a), F.lit(0), lambda s, x: s + x)
        return F.forall(F.transform(ends, lambda b, i: total(F.coalesce(F.get(ends, i - 1), F.lit(-1)), b)), lambda s: s >= least)

    return let_all(check, sizes=sizes, ends=F.concat(cuts, F.array(F.size(sizes) - 1)))


# --- solvers ---


def _greedy(scores: Sequence[float], sizes: Sequence[int], k: int, least: int, fill: Sequence[int]) -> list[int]:
    """The best gaps that keep every segment feasible, filled up from equal cuts."""
    before = np.concatenate(([0], np.cumsum(sizes)))

    def fits(cuts: list[int]) -> bool:
        edges = [0, *(c + 1 for c in cuts), len(sizes)]
        return all(before[b] - before[a] >= least for a, b in zip(edges, edges[1:], strict=False))

    out: list[int] = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if len(out) == k - 1:
            break
        if fits(sorted([*out, i])):
            out.append(i)
    for c in fill:
        if len(out) >= k - 1:
            break
        if c not in out:
            out.append(c)
    return sorted(out)


def _cheapest(n: int, k: int, cost: Callable[[int], np.ndarray], bonus: Sequence[float], sizes: Sequence[int], least: int) -> list[int] | None:
    """Cuts into k segments that minimise the sum of costs of adjacent segments less the cuts' bonuses.

    ``cost(b)`` is a matrix over the starts 0 .. b of the segment that ends at b and the ends b + 1 .. n - 1 of the next one. A dynamic
    program from the back; of equal optima the first in order of cuts wins. None if no feasible cuts exist.
    """
    if k < 2:
        return []
    before = np.concatenate(([0], np.cumsum(sizes)))
    allowed = before[None, 1:] - before[:-1, None] >= least  # by start and end of a segment
    # value[j, a, b]: j cuts from b on, of which b is the first; its segment starts at a
    value = np.full((k, n, n), np.inf)
    value[0, :, n - 1] = np.where(allowed[:, n - 1], 0.0, np.inf)
    follow = np.zeros((k, n, n), dtype=np.int32)
    for b in range(n - 2, -1, -1):
        total = np.round(value[: k - 1, b + 1, None, b + 1 :] + (cost(b) - bonus[b])[None], 9)
        at = total.argmin(axis=2)
        value[1:, : b + 1, b] = np.where(allowed[None, : b + 1, b], np.take_along_axis(total, at[..., None], 2)[..., 0], np.inf)
        follow[1:, : b + 1, b] = at + b + 1
    first = int(value[k - 1, 0].argmin())
    if not np.isfinite(value[k - 1, 0, first]):
        return None
    out, start, end = [], 0, first
    for j in range(k - 1, 0, -1):
        out.append(end)
        start, end = end + 1, int(follow[j, start, end])
    return out


def _overlaps(lines: Sequence[Sequence[str]]) -> Callable[[int], np.ndarray]:
    """Trigrams shared by the lines a .. b and b + 1 .. c, as a matrix over a and c for each b.

    A trigram is in the one if its latest start among places that end by b is not before a, in the other if its earliest end among
    places that start after b is not beyond c: counts by both, summed up, are the matrix.
    """
    n, words = len(lines), [x for line in lines for x in line]
    of = np.repeat(np.arange(n), [len(x) for x in lines])
    known: dict[tuple, int] = {}
    grams = np.array([known.setdefault(g, len(known)) for g in zip(words, words[1:], words[2:], strict=False)], dtype=np.int64)
    starts, ends = of[: len(grams)], of[2:]
    latest = np.full((n, len(known)), -1, dtype=np.int32)  # by b
    earliest = np.full((n, len(known)), n, dtype=np.int32)
    np.maximum.at(latest, (ends, grams), starts)
    np.minimum.at(earliest, (starts, grams), ends)
    latest = np.maximum.accumulate(latest, axis=0)
    earliest = np.minimum.accumulate(earliest[::-1], axis=0)[::-1]

    def cost(b: int) -> np.ndarray:
        both = (latest[b] >= 0) & (earliest[b + 1] < n)
        held = np.bincount(latest[b][both] * n + earliest[b + 1][both], minlength=n * n).reshape(n, n)[: b + 1, b + 1 :]
        return np.cumsum(np.cumsum(held[::-1], axis=0)[::-1], axis=1).astype(np.float64)

    return cost


def _centroids(v: np.ndarray) -> Callable[[int], np.ndarray]:
    """Cosines of the sums of the vectors a .. b and b + 1 .. c, as a matrix over a and c for each b."""
    sums = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)))

    def cost(b: int) -> np.ndarray:
        x, y = sums[b + 1] - sums[: b + 1], sums[b + 2 :] - sums[b + 1]
        return (x @ y.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None], 1e-12)

    return cost


def _sets(lines: Sequence[Sequence[str]]) -> Callable[[int, int], frozenset]:
    known: dict[tuple[int, int], frozenset] = {}

    def of(a: int, b: int) -> frozenset:
        if (a, b) not in known:
            t = [x for line in lines[a : b + 1] for x in line]
            known[a, b] = frozenset(zip(t, t[1:], t[2:], strict=False))
        return known[a, b]

    return of


def _equal(n: int, k: int) -> list[int]:
    return sorted({max(0, min(n - 2, round(i * n / k) - 1)) for i in range(1, k)}) if k > 1 and n > 1 else []


def solve(docs: DataFrame, method: str | Sequence[str], key: str = "doc_id", least: int = MIN_TOKENS, bonus: float = 1.0, most_lines: int = 120, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """(key, …keep, method, cuts, solver) for documents with ``tokens`` (array of token arrays), ``k`` and, as needed, ``marks`` or ``vectors``.

    Methods: overlap_min (least shared trigrams between adjacent segments), hybrid (the same less ``bonus`` for each cut
    at a marker), lex_valley and emb_valley (highest gap scores first), emb_global (least cosine of adjacent centroids),
    shuffled (emb_valley on vectors permuted within the document). Solver says how: exact, greedy for the valleys, or
    fallback to equal cuts where no cuts are feasible, skipped with null cuts for the searches over more than ``most_lines`` lines.
    Several methods are a row each, from one reading of the documents.
    """
    methods = [method] if isinstance(method, str) else list(method)
    vectors = "vectors" in docs.columns
    columns = list(dict.fromkeys([key, *keep, "tokens", "k", *(c for c in ("marks", "vectors") if c in docs.columns)]))

    def one(row: dict, method: str, overlaps: Callable[[], Callable]) -> tuple[list[int] | None, str]:
        lines, k = row["tokens"], int(row["k"])
        n, sizes = len(lines), [len(x) for x in lines]
        equal = _equal(n, k)
        if k < 2 or n < 2:
            return [], "exact"
        v = np.stack([np.asarray(x, dtype=np.float64) for x in row["vectors"]]) if vectors and method not in ("overlap_min", "hybrid", "lex_valley") else None
        if method == "shuffled":
            import hashlib

            v = v[sorted(range(n), key=lambda i: hashlib.md5(f"{seed}|{row[key]}|{i}".encode()).hexdigest())]
        if method in ("emb_valley", "shuffled", "lex_valley"):
            trigrams = _sets(lines)

            def gap(i: int) -> float:
                if v is None:
                    a, b = trigrams(max(0, i - 1), i), trigrams(i + 1, min(n - 1, i + 2))
                    return 1.0 if not a or not b else 1 - len(a & b) / math.sqrt(len(a) * len(b))
                a, b = v[max(0, i - 1) : i + 1].sum(0), v[i + 1 : i + 3].sum(0)
                return 1 - float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12)

            return _greedy([round(gap(i), 9) for i in range(n - 1)], sizes, k, least, equal), "greedy"
        if n > most_lines:
            return None, "skipped"
        cost = _centroids(v) if method == "emb_global" else overlaps()
        marks = row["marks"] if method == "hybrid" else []
        cuts = _cheapest(n, k, cost, [bonus if marks and m else 0.0 for m in marks or [False] * n], sizes, least)
        return (equal, "fallback") if cuts is None else (cuts, "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                held = []  # what both searches for shared trigrams read

                def overlaps() -> Callable:
                    if not held:  # noqa: B023
                        held.append(_overlaps(row["tokens"]))  # noqa: B023
                    return held[0]  # noqa: B023

                made += [one(row, m, overlaps) for m in methods]
            taken = pa.array(np.repeat(np.arange(batch.num_rows), len(methods)))
            kept = [batch.column(c).take(taken) for c in (key, *keep)]
            found = [pa.array(methods * batch.num_rows, pa.string()), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[key, *keep, "method", "cuts", "solver"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return spread(docs.select(*columns), key).mapInArrow(run, f"{types}, method string, cuts array<int>, solver string")


# --- metrics ---


def window(n: Column, truth: Column) -> Column:
    """Half the mean true segment, rounded half to even, at least 2."""
    return F.greatest(F.lit(2), F.bround(n / (F.size(truth) + 1) / 2).cast("int"))


def _between(cuts: Column, i: Column, k: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: (c >= i) & (c < i + k)))


def _windowed(n: Column, truth: Column, cuts: Column, wrong: Callable[[Column, Column], Column]) -> Column:

    def share(n: Column, truth: Column, cuts: Column, k: Column) -> Column:
        errors = F.size(F.filter(span(0, n - k - 1), lambda i: wrong(_between(truth, i, k), _between(cuts, i, k))))
        return F.when(n <= k, F.lit(0.0)).otherwise(errors / (n - k))

    return let_all(lambda n, truth, cuts: let_all(share, n=n, truth=truth, cuts=cuts, k=window(n, truth)), n=n, truth=truth, cuts=cuts)


def pk(n: Column, truth: Column, cuts: Column) -> Column:
    """Share of windows that are wrong about whether their ends lie in one segment."""
    return _windowed(n, truth, cuts, lambda r, h: (r > 0) != (h > 0))


def window_diff(n: Column, truth: Column, cuts: Column) -> Column:
    """Share of windows with a wrong number of cuts."""
    return _windowed(n, truth, cuts, lambda r, h: r != h)


def boundary_f1(truth: Column, cuts: Column, tolerance: int = 0) -> Column:
    """F1 of cuts; within a tolerance each cut, in ascending order, takes the lowest true one that is free."""
    if tolerance == 0:
        hits = F.size(F.array_intersect(truth, cuts))
    else:
        start = F.struct(truth.cast(_INTS).alias("free"), F.lit(0).alias("hits"))

        def step(acc: Column, c: Column) -> Column:
            near = F.filter(acc["free"], lambda t: F.abs(t - c) <= tolerance)
            taken = F.size(near) > 0
            left = F.when(taken, F.filter(acc["free"], lambda t: t != near[0])).otherwise(acc["free"])
            return F.struct(left.alias("free"), (acc["hits"] + taken.cast("int")).alias("hits"))

        hits = F.aggregate(F.array_sort(cuts), start, step, lambda acc: acc["hits"])
    both = F.size(truth) + F.size(cuts)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * hits / both)


def scored(planned: DataFrame) -> DataFrame:
    """``planned`` (n, truth, cuts) with pk, window_diff, f1, f1_near and k_error."""
    n, t, c = F.col("n"), F.col("truth"), F.col("cuts")
    return planned.withColumns({
        "pk": F.round(pk(n, t, c), 6), "window_diff": F.round(window_diff(n, t, c), 6), "f1": F.round(boundary_f1(t, c), 6),
        "f1_near": F.round(boundary_f1(t, c, 1), 6), "k_error": F.size(c) - F.size(t),
    })


def summary(scores: DataFrame, by: Sequence[str] = ("corpus", "method")) -> DataFrame:
    """Means by method, with mean absolute and signed errors of the number of segments."""
    means = [F.round(F.avg(m), 6).alias(m) for m in ("pk", "window_diff", "f1", "f1_near")]
    return scores.groupBy(*by).agg(F.count("*").alias("docs"), *means, F.round(F.avg(F.abs("k_error")), 6).alias("k_mae"), F.round(F.avg("k_error"), 6).alias("k_bias"))


def paired(scores: DataFrame, pairs: Sequence[tuple[str, str]], key: str = "doc_id", metric: str = "pk", by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Method against method on the same documents: wins and losses (lower is better), exact sign test, adjusted p by family."""
    named = list(dict.fromkeys(m for pair in pairs for m in pair))
    # a row a document with its methods' values, then a row a pair of methods that both have one
    values = [F.max(F.when(F.col("method") == m, F.struct(F.col(metric).alias("v")))).alias(f"m{i}") for i, m in enumerate(named)]
    wide = scores.where(F.col("method").isin(named)).groupBy(*by, key).agg(*values)
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{named.index(a)}").alias("x"), F.col(f"m{named.index(b)}").alias("y")) for a, b in pairs]
    both = wide.select(*by, F.explode(F.array(*each)).alias("t")).where("t.x IS NOT NULL AND t.y IS NOT NULL").select(*by, "t.a", "t.b", F.col("t.x.v").alias("a_value"), F.col("t.y.v").alias("b_value"))
    out = both.groupBy(*by, "a", "b").agg(
        F.count("*").alias("docs"), F.count(F.when(F.col("a_value") < F.col("b_value"), 1)).alias("wins"), F.count(F.when(F.col("a_value") > F.col("b_value"), 1)).alias("losses")
    )
    out = out.withColumn("p", sign_test(F.col("wins"), F.col("losses")))
    adjusted = benjamini_hochberg(out, "p", by, ["a", "b"])
    return adjusted.withColumns({"p": F.round("p", 6), "p_adjusted": F.round("p_adjusted", 6)})


# --- document builders ---


def window_documents(records: DataFrame, source: str, key: str, lines: str, low: int = 3, high: int = 5, least: int = 6, most: int = 80, seed: int = 42) -> DataFrame:
    """Consecutive records joined to documents of ``low`` to ``high`` records, junctions being the true cuts.

    A document starts where the last one ended and has a hashed number of records, so where each starts is known without
    reading any: sizes are summed by blocks of documents. Documents that start among the last ``high`` records are left out,
    and so are those outside ``least`` to ``most`` lines. The key is an integer.
    """
    placed = running(records.select(source, key, F.col(lines).alias("ls")), [source], key, name="at")
    groups = records.groupBy(source).agg(F.count("*").alias("records"))
    drawn = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("records") / low).cast("long"))))
    width = low + F.pmod(F.conv(F.substring(digest(seed, F.col(source).cast("string"), F.col("block").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(high - low + 1))
    begun = running(drawn.withColumn("width", width), [source], "block", F.col("width"), "start").where(F.col("start") < F.col("records") - high)
    slots = begun.select(F.col(source).alias("__source"), "block", "width", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("slot"))
    met = placed.join(slots, F.col(source).eqNullSafe(F.col("__source")) & (F.col("at") == F.col("start") + F.col("slot")))
    out = met.groupBy(source, "block").agg(F.array_sort(F.collect_list(F.struct("slot", "ls"))).alias("rs"))
    out = out.select(F.col(source), F.col("block"), F.transform("rs", lambda r: r["ls"]).alias("records"))
    return from_records(out, "records").where(F.col("n").between(least, most))


def from_records(docs: DataFrame, records: str) -> DataFrame:
    """``docs`` with lines, truth, n and k from an array of records of lines."""
    ends = let(F.transform(records, lambda r: F.size(r)), lambda sizes: F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, x: a + x) - 1))
    docs = docs.withColumns({"lines": F.flatten(records), "truth": F.slice(ends, 1, F.greatest(F.size(records) - 1, F.lit(0)))})
    return docs.withColumns({"n": F.size("lines"), "k": F.size("truth") + 1})


DELIMITER = "=== end-of-tool-result ==="


def engineered(records: Column, delimiter: str = DELIMITER) -> Column:
    """Every record closed by a delimiter line."""
    return F.transform(records, lambda r: F.concat(r, F.array(F.lit(delimiter))))
