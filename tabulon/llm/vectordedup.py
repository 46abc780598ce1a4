"""Near-duplicates among vectors by sorted projection passes.

In each pass vectors are ordered by concatenated random hashes: which of a few random directions, or its opposite, is closest to the
vector, again and again with new directions. Near vectors agree in their first hashes more often than others, so they stand close to each
other in some passes. Each is compared with a window of ``WINDOW`` that follow it in the order; pairs that are verified are united
across the passes.

How many passes it takes follows from how many hashes two vectors must share to meet in a window, so from the number of
rows, and from how often vectors at the threshold agree in one, which is simulated: ``MISSED`` is the chance that such a pair stays unseen.

Windows find the groups, but not how many partners each member of a large group has. These are counted within the
groups afterwards, block against block. In groups of more than one block, members are binned by their angle to one of them:
two whose angles add up to less than the threshold's are surely linked, two whose angles differ by more are surely not, and only the others are compared.
So thousands of near copies cost counts of bins, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import cut, partitions, table
from tabulon.llm.components import components
from tabulon.llm.neighbours import numbered_along, units, usable

THRESHOLD, SEED, WINDOW, MISSED, LEAST_PASSES = 0.9, 12, 128, 0.002, 6
#: Directions of a hash at most, hashes of a key, and rows of a tile and of a block.
DIRECTIONS, HASHES, TILE, BLOCK = 64, 7, 8192, 4096
#: Tasks that share the members of a large group.
SALTS = 32


@cache
def directions(dimension: int, at: int) -> np.ndarray:
    """Orthonormal random directions (as columns) of the hashes at a place, the same wherever they are drawn."""
    m = min(dimension, DIRECTIONS)
    return np.linalg.qr(np.random.default_rng([SEED, dimension, at]).standard_normal((dimension, m)))[0]


def hashed(unit: np.ndarray, at: int) -> np.ndarray:
    """For each row: which direction is closest, with its sign."""
    along = unit @ directions(unit.shape[1], at)
    best = np.abs(along).argmax(axis=1)
    return 2 * best + (along[np.arange(len(along)), best] < 0)


def keys(unit: np.ndarray, number: int) -> np.ndarray:
    """The key of pass ``number``: concatenated hashes."""
    out = np.zeros(len(unit), dtype=np.int64)
    for h in range(HASHES):
        out = (out << 8) | hashed(unit, number * HASHES + h)
    return out


@cache
def agreement(dimension: int, threshold: float, pairs: int = 4000) -> float:
    """How often two vectors at the threshold agree in one hash."""
    if dimension == 1:
        return 1.0
    rng = np.random.default_rng([SEED, dimension])
    x, y = rng.standard_normal((2, pairs, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return float(max((hashed(x, 0) == hashed(threshold * x + math.sqrt(1 - threshold**2) * y, 0)).mean(), 0.01))


def passes(rows: int, dimension: int, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold is unseen with a chance of ``missed``, among rows spread evenly."""
    bits = math.log2(2 * min(dimension, DIRECTIONS))
    shared = math.log2(max(rows / window, 1)) / bits
    met = agreement(dimension, threshold) ** shared
    return max(LEAST_PASSES, math.ceil(math.log(missed) / math.log1p(-met)) if met < 1 else 1)


def _lanes(batches: Iterator[pa.RecordBatch], counts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, rows = units(batch.column(1)), np.asarray(batch.column(0))
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == d)
            unit = np.stack([vectors[i] for i in here])
            for p in range(counts[d]):
                n = len(here)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, (d << 24) + p)), pa.array(keys(unit, p)), pa.array(np.zeros(n, dtype=bool)), pa.array(rows[here]), pa.array(rows[here])], names=["lane", "key", "query", "vec_id", "row"]
                )


class Forest:
    """Groups of numbered things, united by links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.label[self.label], self.label):
                self.label = jumped


def _windows(threshold: float, window: int):  # noqa: ANN202
    """For partitions sorted by lane, tile and place: enough of the verified pairs within windows to unite all that they unite.

    Columns: lane, tile, place, row, vector. A tile's last rows are also the next one's first.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(rows: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        found = Forest(len(rows))
        for at in range(0, len(rows), window):
            near = unit[at : at + window] @ unit[at : at + 2 * window].T
            i, j = np.nonzero(near >= threshold)
            later = i < j
            found.unite(i[later] + at, j[later] + at)
        tied = np.flatnonzero(found.label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[found.label[tied]]), pa.array(rows[tied])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def close() -> pa.RecordBatch:
            return links(np.concatenate([r for r, _ in held]), np.concatenate([v for _, v in held]))

        for batch in batches:
            lanes, tiles, rows = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            if not len(lanes):
                continue
            edges = [0, *(np.flatnonzero((np.diff(lanes) != 0) | (np.diff(tiles) != 0)) + 1).tolist(), len(lanes)]
            for s, e in zip(edges, edges[1:], strict=False):
                if (lanes[s], tiles[s]) != tile and held:
                    yield close()
                    held = []
                tile = (lanes[s], tiles[s])
                held.append((rows[s:e], np.stack(units(batch.column(4).slice(s, e - s)))))
        if held:
            yield close()

    return run


def verified_links(rows: DataFrame, counts: dict[int, int], threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(u, v): rows of vectors whose cosine reaches the threshold, or that a chain of such pairs within a tile connects.

    ``rows`` has row and vector; ``counts``: passes by dimension.
    """
    lanes = rows.select("row", "vector").mapInArrow(lambda x: _lanes(x, counts), "lane long, key long, query boolean, vec_id long, row long")
    placed, _ = numbered_along(lanes)
    tile = F.floor(F.col("place") / TILE)
    both = F.when(F.col("place") % TILE < window, F.array(tile - 1, tile)).otherwise(F.array(tile))
    spread = placed.select("lane", "row", "place", F.explode(both).alias("tile"))
    met = spread.join(rows.select("row", "vector"), "row").select("lane", "tile", "place", "row", "vector")
    dealt = met.repartition("lane", "tile").sortWithinPartitions("lane", "tile", "place")
    return dealt.mapInArrow(_windows(threshold, window), "u long, v long")


def _degrees(threshold: float):  # noqa: ANN202
    """For one pair of blocks: how many partners each row of the first has in the second, itself not counted."""

    def run(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks"))
        rows = np.asarray(group.column("row"))
        unit = np.stack(units(group.column("vector").combine_chunks()))
        other = np.flatnonzero(np.asarray(group.column("asked")))
        mine = np.flatnonzero(asks)
        n = np.zeros(len(mine), dtype=np.int64)
        for at in range(0, len(mine), 512):
            here = mine[at : at + 512]
            near = unit[here] @ unit[other].T >= threshold
            n[at : at + 512] = near.sum(axis=1) - (near & (rows[here][:, None] == rows[other][None, :])).sum(axis=1)
        return pa.table({"row": pa.array(rows[mine]), "n": pa.array(n)})

    return run


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own, pivots = units(batch.column(2)), units(batch.column(3))
            degrees = [math.degrees(math.acos(min(1.0, max(-1.0, float(a @ b))))) for a, b in zip(own, pivots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.floor(degrees).astype(np.int64))], names=["root", "row", "vector", "bin"])


def degrees(members: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(row, n_links): for each member of a group, the others of the group whose cosine with it reaches the threshold.

    ``members`` has root, row and vector, ``sizes`` root and size.
    """
    schema = "row long, n long"
    known = members.join(sizes, "root")
    kind = members.schema["vector"].dataType.simpleString()
    # several small groups go to a task together where Spark puts them; one is never larger than a block
    small = known.where(F.col("size") <= block).select("root", "row", "vector", F.lit(True).alias("asks"), F.lit(True).alias("asked"))
    out = small.groupBy("root").applyInArrow(_degrees(threshold), schema)
    large = sizes.where(F.col("size") > block)
    if large.isEmpty():
        return out.select("row", F.col("n").alias("n_links"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    pivots = members.where("root = row").join(large, "root").select("root", F.col("vector").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    binned = cut(known.where(F.col("size") > block).withColumn("salt", salt).join(pivots, ["root", "salt"]).select("root", "row", "vector", "pivot").mapInArrow(_angles, f"root long, row long, vector {kind}, bin long"))
    bins = cut(binned.groupBy("root", "bin").agg(F.count("*").alias("size")))
    # a bin holds angles from its number to the next; half a hundredth of a degree is left for rounding
    angle = math.degrees(math.acos(threshold))
    a, b = bins.alias("a"), bins.alias("b")
    pairs = a.join(b, F.col("a.root") == F.col("b.root")).select(F.col("a.root").alias("root"), F.col("a.bin").alias("bin"), F.col("b.bin").alias("other"), F.col("a.size").alias("size"), F.col("b.size").alias("other_size"))
    sure = F.col("bin") + F.col("other") + 2 <= angle - 0.005
    apart = F.abs(F.col("bin") - F.col("other")) - 1 >= angle + 0.005
    certain = pairs.where(sure).groupBy("root", "bin").agg(F.sum(F.col("other_size") - (F.col("bin") == F.col("other")).cast("long")).alias("n"))
    spread = certain.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    counted = binned.select("root", "bin", "row").withColumn("salt", salt).join(spread, ["root", "bin", "salt"]).select("row", "n")
    open_ = pairs.where(~sure & ~apart)
    blocks = lambda n: F.ceil(F.col(n) / block)
    dealt = open_.select("root", "bin", "other", blocks("size").alias("k"), blocks("other_size").alias("l"))
    part = lambda n: F.pmod(F.xxhash64("row", F.lit(3)), F.col(n))
    own = binned.join(dealt, ["root", "bin"]).select("root", "bin", "other", part("k").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)).alias("j"), "row", "vector", F.lit(True).alias("asks"), F.lit(False).alias("asked"))
    theirs = binned.withColumnRenamed("bin", "other").join(dealt, ["root", "other"]).select("root", "bin", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"), part("l").alias("j"), "row", "vector", F.lit(False).alias("asks"), F.lit(True).alias("asked"))
    compared = own.unionByName(theirs).groupBy("root", "bin", "other", "i", "j").applyInArrow(_degrees(threshold), schema)
    return out.unionByName(counted).unionByName(compared).groupBy("row").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    n_links counts the other rows whose cosine reaches the threshold, component_id is the smallest id that links reach, the row's own
    included, and kept says that it is the row's. Null and zero vectors, and vectors with null or non-finite components, link with nothing; so
    do vectors of different lengths with each other. Repeated rows are linked copies. Rows with a null id count like others and have the
    component of those they are linked with, null and kept where no id is known. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = cut(rows.withColumn("vector", F.when(usable("vector"), F.col("vector"))).withColumn("row", F.monotonically_increasing_id()))  # numbers stand once they are written
    taking_part = rows.where("vector IS NOT NULL")
    counts = {r["d"]: passes(r["n"], r["d"], threshold, window) for r in taking_part.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    roots = cut(components(verified_links(taking_part, counts, threshold, window)).distinct())
    grouped = cut(roots.select(F.col("node").alias("row"), "root"))
    salted = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    sizes = grouped.groupBy("root", salted.alias("salt")).count().groupBy("root").agg(F.sum("count").alias("size"))
    members = taking_part.join(grouped, "row").select("root", "row", "vector")
    linked = degrees(members, sizes, threshold, block)
    least = grouped.join(rows.select("row", "vec_id"), "row").groupBy("root", salted.alias("salt")).agg(F.min("vec_id").alias("m")).groupBy("root").agg(F.min("m").alias("component_id"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = grouped.withColumn("salt", salted).join(spread, ["root", "salt"]).select("row", "root", "component_id")
    whole = rows.select("row", "vec_id").join(named, "row", "left").join(linked, "row", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
