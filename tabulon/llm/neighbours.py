"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted at random and ordered along a Hilbert curve; several curves
with different projections and shifts make it unlikely that a near pair is far apart on all of them. Places along the
curves come from a range partitioning. A query takes part in the curves on which its own projection is longest, as those
tell most about it, and meets there the candidates in a window of places around its own. The windows' best are merged
over the curves and ranked by exact scores.

The measure is the largest inner product. A coordinate is added that gives all candidates one length, which turns it
into the nearest neighbour for the curves; candidates are dealt to bands of like length first, so that a single long
vector does not flatten the others. Scores come from the original vectors.

How wide a window must be depends on the data: where a few directions hold most of the variance, short ones do; in
vectors spread evenly over many dimensions no ordering keeps neighbours together. So the share of a curve that a window
spans is fitted, band by band: a bounded sample of queries is searched exhaustively, and the share is the smallest in
which ``recall`` of their true neighbours lie. The fit is the same at every size and adds no result by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import cut, partitions, table

#: Curves, how many of them a query takes part in, directions of a curve and bits of a direction.
CURVES, PROBES, DIRECTIONS, BITS = 12, 6, 3, 16
SEED = 20_25
#: Candidates that a task holds at a time, and queries that it multiplies with them at once.
TILE, QUERIES = 8192, 256
#: Share of the sampled queries' neighbours that the windows must hold; sampled queries, and rows that set the scales.
RECALL, ASKED, SCALED = 0.94, 256, 2048
_LAST = np.iinfo(np.int64).max


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows of ``cells``, below 2^bits), as unsigned 64-bit integers."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the rotations and reflections, from the coarsest cell down
        q = np.uint64(1 << b)
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            mirrored = (x[i] & q) != 0
            swap = np.where(mirrored, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & np.uint64(1 << b), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def _lane(dimension: int, band: int, curve: int) -> int:
    """One number for a curve over the candidates of one dimension and band of lengths."""
    return (dimension << 24) + ((band + 2048) << 8) + curve


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _vectors(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)]


def units(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors scaled to length one, in double precision; divided by their largest component first, so that no square over- or underflows."""
    out = []
    for v in _vectors(column):
        x = v / np.abs(v).max()
        out.append(x / math.sqrt(float(x @ x)))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logarithms (of base 2) of lengths, and bands of lengths within a factor of two with their borders between the powers of two.

    They are worked out here alone and carried as columns, so rounding cannot put a vector into two bands.
    """
    for batch in batches:
        logs = []
        for v in _vectors(batch.column(1)):
            most = float(np.abs(v).max())
            x = v / most
            logs.append(math.log2(most) + 0.5 * math.log2(float(x @ x)))
        log = np.array(logs, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log), pa.array(np.floor(log + 0.5).astype(np.int64))], names=["vec_id", "vector", "asks", "log", "band"])


class Curves:
    """The orderings: random directions with scales and shifts, fitted to a sample of the rows of each dimension.

    Vectors have length one; ``longest`` has the logarithm of the greatest length by dimension and band.
    """

    def __init__(self, sample: list[np.ndarray], longest: dict[tuple[int, int], float], curves: int, probes: int, directions: int = DIRECTIONS, bits: int = BITS) -> None:
        self.longest, self.curves, self.probes, self.bits = longest, curves, min(probes, curves), bits
        self.axes: dict[int, np.ndarray] = {}
        self.scales: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({d for d, _ in longest}):
            rng = np.random.default_rng([SEED, d])
            some = min(directions, d + 1)
            rows: list[np.ndarray] = []  # disjoint groups of orthogonal directions, as long as a rotation has any left
            while len(rows) < curves:
                turned = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0].T
                rows += [turned[i : i + some] for i in range(0, d + 2 - some, some)]
            self.axes[d] = np.stack(rows[:curves])
            known = np.array([v for v in sample if len(v) == d]).reshape(-1, d)
            at = self._projected(d, known, np.zeros(len(known)))
            spread = at.std(axis=0) if len(at) > 1 else np.zeros(at.shape[1:])
            centre = at.mean(axis=0) if len(at) else np.zeros(at.shape[1:])
            # four deviations on either side take half of the range; where that half lies is drawn
            self.scales[d] = 16 * np.maximum(spread, 1e-6), 0.25 + 0.5 * rng.random(spread.shape) - centre / (16 * np.maximum(spread, 1e-6))

    def _projected(self, d: int, points: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """(row, curve, direction)"""
        return np.einsum("nd,cjd->ncj", np.column_stack([points, extra]), self.axes[d], optimize=True)

    def _keys(self, d: int, at: np.ndarray) -> np.ndarray:
        width, shift = self.scales[d]
        cells = np.clip((at / width + shift) * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c], self.bits).astype(np.int64) for c in range(self.curves)], axis=1)

    def candidates(self, d: int, v: np.ndarray, logs: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes and keys of vectors of one dimension, a row a vector, with the logarithms and bands of their lengths."""
        share = np.exp2(np.minimum(logs - np.array([self.longest[d, b] for b in bands.tolist()]), 0))
        keys = self._keys(d, self._projected(d, v * share[:, None], np.sqrt(np.maximum(1 - share**2, 0))))
        lanes = np.array([_lane(d, b, 0) for b in bands.tolist()])[:, None] + np.arange(self.curves)
        return lanes, keys

    def queries(self, d: int, v: np.ndarray, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._projected(d, v, np.zeros(len(v)))
        chosen = np.argsort(-(at**2).sum(axis=2), axis=1, kind="stable")[:, : self.probes]
        keys = np.take_along_axis(self._keys(d, at), chosen, axis=1)
        bands = [b for dim, b in sorted(self.longest) if dim == d]
        lanes = np.concatenate([_lane(d, b, 0) + chosen for b in bands], axis=1)
        return lanes, np.tile(keys, len(bands))


def _keyed(rows: DataFrame, curves: Curves) -> DataFrame:
    """(lane, key, query, vec_id, row): each vector on every curve of its band, each query on its curves of every band."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)
    schema = pa.schema([("lane", pa.int64()), ("key", pa.int64()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, asks, logs, bands = units(batch.column(2)), *(np.asarray(batch.column(i)) for i in (3, 4, 5))
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes).tolist():
                for query in (False, True):
                    here = np.flatnonzero((sizes == d) & (asks if query else True))
                    if not len(here):
                        continue
                    made = shared.value.queries if query else shared.value.candidates
                    lanes, keys = made(d, np.stack([vectors[i] for i in here]), logs[here], bands[here])
                    at = pa.array(np.repeat(here, lanes.shape[1]))
                    columns = [pa.array(lanes.ravel(), pa.int64()), pa.array(keys.ravel(), pa.int64()), pa.array(np.full(len(at), query)), batch.column(0).take(at), batch.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("vec_id", "row", "vector", "asks", "log", "band").mapInArrow(run, "lane long, key long, query boolean, vec_id long, row long")


def numbered_along(keyed: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(lane, query, row, place): rows numbered along their curve by sizes of range partitions; and rows by lane.

    Of equal keys queries come first and then the smaller ids, so that a window over many equal vectors starts with them.
    """
    spark = keyed.sparkSession
    order = [F.col("lane"), F.col("key"), F.col("query").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranged = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("lane", "query", "row", F.spark_partition_id().alias("p")))
    before, total = {}, {}
    for r in sorted(ranged.groupBy("p", "lane").count().collect(), key=lambda r: (r["lane"], r["p"])):
        before[r["p"], r["lane"]] = total.get(r["lane"], 0)
        total[r["lane"]] = total.get(r["lane"], 0) + r["count"]
    shared = spark.sparkContext.broadcast(before)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            lane, p = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            if not len(lane):
                continue
            edges = [0, *(np.flatnonzero(np.diff(lane)) + 1).tolist(), len(lane)]
            place = np.zeros(len(lane), dtype=np.int64)
            for a, b in zip(edges, edges[1:], strict=False):
                at = seen.get(int(lane[a]), shared.value[int(p[a]), int(lane[a])])
                place[a:b] = at + np.arange(b - a)
                seen[int(lane[a])] = at + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place)], names=["lane", "query", "row", "place"])

    return ranged.mapInArrow(number, "lane long, query boolean, row long, place long"), total


def _top(scores: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best of each row of ``scores``, which are products of ``a`` and ``b`` or -inf; ties by id."""
    top = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(top), top, 0)))
    rows, cols = np.nonzero((scores >= (top - slack)[:, None]) & (scores > -np.inf))
    # the products are summed one way for all pairs: equal vectors have equal scores
    exact = np.concatenate([(a[rows[i : i + 65_536]] * b[cols[i : i + 65_536]]).sum(axis=1) for i in range(0, len(rows), 65_536)] or [np.zeros(0)])
    order = np.lexsort((ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept], exact[kept]


def _true_neighbours(rows: DataFrame, sampled: list, k: int) -> list[tuple[int, int]]:
    """(query's row, neighbour's row) of the exact ``k`` neighbours of the sampled queries: one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast([(r["row"], np.asarray(r["vector"], dtype=np.float64)) for r in sampled])
    schema = pa.schema([("asked", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(2))
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes).tolist():
                asked = [(row, v) for row, v in shared.value if len(v) == d]
                if not asked:
                    continue
                here = np.flatnonzero(sizes == d)
                a, b = np.stack([v for _, v in asked]), np.stack([vectors[i] for i in here])
                own, own_rows = np.array([row for row, _ in asked]), np.asarray(batch.column(1))[here]
                ids = np.asarray(batch.column(0).fill_null(_LAST))[here]
                scores = a @ b.T
                scores[own[:, None] == own_rows[None, :]] = -np.inf
                i, j, score = _top(scores, a, b, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own_rows[j]), pa.array(ids[j]), pa.array(score)], schema=schema)

    best = rows.select("vec_id", "row", "vector").mapInArrow(run, "asked long, row long, vec_id long, score double")
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("n") <= k)
    return [(r["asked"], r["row"]) for r in ranked.select("asked", "row").collect()]  # at most k a sampled query


def fit_shares(placed: DataFrame, totals: dict[int, int], pairs: list[tuple[int, int]], recall: float) -> dict[int, float]:
    """By band: the smallest share of a curve that a window must span to hold ``recall`` of ``pairs`` of rows on some curve.

    Bands that hold none of the pairs are left out.
    """
    if not pairs:
        return {}
    spark = placed.sparkSession
    asked, found = {a for a, _ in pairs}, {b for _, b in pairs}
    some = spark.createDataFrame([(True, x) for x in sorted(asked)] + [(False, x) for x in sorted(found)], "query boolean, row long")
    places: dict[tuple[bool, int], dict[int, int]] = {}
    for r in placed.join(F.broadcast(some), ["query", "row"]).collect():  # a place a curve for rows of the sample
        places.setdefault((r["query"], r["row"]), {})[r["lane"]] = r["place"]
    needed: dict[int, list[float]] = {}
    for a, b in pairs:
        at, mine = places[True, a], places[False, b]
        shares = [1.0]
        for lane in at.keys() & mine.keys():
            p, c, n = at[lane], mine[lane], totals[lane]
            side = min(c - p, (c + 1) // 2) if c > p else min(p - c, (n - c) // 2)
            shares.append((2 * side + 1) / n)
        needed.setdefault(next(iter(mine)) >> 8, []).append(min(shares))
    return {band: sorted(x)[max(0, math.ceil(recall * len(x)) - 1)] for band, x in needed.items()}


def _search(k: int):  # noqa: ANN202
    """For partitions sorted by lane, tile and kind: the best candidates of each query within its window, tile by tile.

    Columns: lane, tile, query, low, high, vec_id, row, vector; a candidate has its place in low. Only one tile's
    candidates are held, queries stream past them.
    """
    schema = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        matrix = places = ids = rows = known = None
        for batch in batches:
            lanes, tiles, query = (np.asarray(batch.column(i)) for i in range(3))
            if not len(lanes):
                continue
            edges = [0, *(np.flatnonzero((np.diff(lanes) != 0) | (np.diff(tiles) != 0) | (query[1:] != query[:-1])) + 1).tolist(), len(lanes)]
            for s, e in zip(edges, edges[1:], strict=False):
                if (lanes[s], tiles[s]) != tile:
                    tile, held, matrix = (lanes[s], tiles[s]), [], None
                part = batch.slice(s, e - s)
                v = np.stack(_vectors(part.column(7)))
                at, own, key = np.asarray(part.column(3)), np.asarray(part.column(6)), part.column(5)
                if not query[s]:
                    held.append((v, at, own, np.asarray(key.fill_null(_LAST)), np.asarray(key.is_valid())))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, places, rows, ids, known = (np.concatenate(x) for x in zip(*held, strict=True))
                high, asked = np.asarray(part.column(4)), np.asarray(key)
                for i in range(0, len(v), QUERIES):
                    block = slice(i, i + QUERIES)
                    first, last = np.searchsorted(places, [at[block].min(), high[block].max() + 1])
                    if first == last:
                        continue
                    near = slice(first, last)
                    scores = v[block] @ matrix[near].T
                    scores[(places[near] < at[block, None]) | (places[near] > high[block, None]) | (rows[near] == own[block, None])] = -np.inf
                    q, c, score = _top(scores, v[block], matrix[near], ids[near], k)
                    q, c = q + i, c + first
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(asked[q]), pa.array(rows[c]), pa.array(ids[c], mask=~known[c]), pa.array(score)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, probes: int = PROBES, recall: float = RECALL, share: float | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of largest inner product found for each row where ``asks``.

    Candidates are all rows but the query's own; ties go to the smaller id. Null and zero vectors and vectors with null or
    non-finite components take no part; vectors of different lengths have no inner product, so they are no candidates of
    each other. Rows that repeat an id are candidates and queries each by itself, so an id may appear more than once; rows with a null id
    can be found, as null and after equal scores. Other columns are left out. Fewer candidates than ``k`` give fewer rows, an empty
    table none. ``share`` sets the windows instead of the fit; they hold ``k`` places on either side at least.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")).where(usable("vector"))
    measured = rows.mapInArrow(_measured, f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, asks boolean, log double, band long")
    rows = cut(measured.withColumn("row", F.monotonically_increasing_id()))  # numbers stand once they are written
    sized = rows.groupBy(F.size("vector").alias("d"), "band").agg(F.max("log").alias("longest")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    order = F.xxhash64("row", F.lit(SEED))
    sampled = rows.where("asks").orderBy(order, "row").limit(ASKED).select("row", "vector").collect()
    if not sized or not sampled:
        return spark.createDataFrame([], schema)
    scaled = units(pa.array([r["vector"] for r in rows.orderBy(order, "row").limit(SCALED).select("vector").collect()]))
    placed, totals = numbered_along(_keyed(rows, Curves(scaled, {(r["d"], r["band"]): r["longest"] for r in sized}, curves, probes)))
    shares = fit_shares(placed, totals, _true_neighbours(rows, sampled, k), recall) if share is None else {}
    sides = {lane: max(k, math.ceil(shares.get(lane >> 8, share or 0.0) * n / 2)) for lane, n in totals.items()}
    total, side = (F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("lane")] for of in (totals, sides))
    # windows keep their width at the ends of a curve
    low = F.greatest(F.lit(0), F.least(F.col("place") - side, total - 1 - 2 * side))
    spans = F.when(F.col("query"), F.struct(low.alias("low"), (low + 2 * side).alias("high"))).otherwise(F.struct(F.col("place").alias("low"), F.col("place").alias("high")))
    tiles = F.sequence(F.floor(F.col("low") / TILE), F.floor(F.least("high", total - 1) / TILE))
    spread = placed.select("lane", "query", "row", spans.alias("x")).select("lane", "query", "row", "x.*").withColumn("tile", F.explode(tiles))
    own = rows.select("row", "vec_id", "vector")
    met = spread.join(own, "row").select("lane", "tile", "query", "low", "high", "vec_id", "row", "vector")
    dealt = met.repartition("lane", "tile").sortWithinPartitions("lane", "tile", "query", "low", "row")
    found = dealt.mapInArrow(_search(k), "asked long, query_id long, row long, vec_id long, score double")
    merged = found.dropDuplicates(["asked", "row"])
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
