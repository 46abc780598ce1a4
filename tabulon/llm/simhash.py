"""Near-duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

Fingerprints within ``radius`` bits are found without fail. Give every bit position a vector of radius + 1 bits. For
each nonzero vector v there is a table, whose key keeps the positions with an odd inner product with v and drops the
rest. The vectors of any ``radius`` positions lie in a hyperplane, so some v is orthogonal to all of them: in that table
a pair that differs just there has equal keys. With radius 4 there are 31 tables, each keeping about half the bits.

Equal fingerprints are merged before anything else. A table's bucket yields a spanning forest of its links, not its
pairs; buckets too large for that in one go are cut into blocks, and each pair of blocks is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import cut, table, with_text_columns
from tabulon.llm.components import components

RADIUS = 4
WORDS = 4
SEED = 42
#: Distinct fingerprints that one task compares with each other; larger buckets are cut into blocks.
BUCKET = 20_000
#: Tasks that share the fingerprints of one component.
SALTS = 32


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 of all shingles of ``words`` words, A-Z lower-cased; 0 for a text with no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``bits``, the fingerprint as a signed 64-bit integer."""

    def compute(texts: list[str | None]) -> Sequence[Sequence]:
        return [np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)]

    return with_text_columns(docs, text, [T.StructField("bits", T.LongType())], compute, keep)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks; positions get the nonzero vectors of radius + 1 bits in turn."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _forest(values: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links between distinct fingerprints within ``radius``, less those that close a cycle.

    With ``split``, only links between the first ``split`` values and the rest matter.
    """
    values = values.view(np.uint64)
    n, parent, out = len(values), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, 4_000_000 // max(n, 1))
    for at in range(0, n if split is None else split, step):
        rows = values[at : at + step] if split is None else values[at : min(at + step, split)]
        near = np.bitwise_count(rows[:, None] ^ values[None, :]) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            i = int(i) + at
            if i < j and (split is None or j >= split) and (a := root(i)) != (b := root(int(j))):
                parent[b] = a
                out.append((i, int(j)))
    return [(int(values[i : i + 1].view(np.int64)[0]), int(values[j : j + 1].view(np.int64)[0])) for i, j in out]


_LINK = "u long, v long, bucket long, size long"


def _links_of_buckets(radius: int, most: int):  # noqa: ANN202
    """For partitions sorted by bucket: links, and a row (bucket, size) for every bucket above ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, held, size = None, [], 0, 0
        u, v, keys, sizes = [], [], [], []

        def close() -> None:
            nonlocal parts, held
            if size > most:
                u.append(None), v.append(None), keys.append(bucket), sizes.append(size)
            elif size > 1:
                for a, b in _forest(np.concatenate(parts), radius):
                    u.append(a), v.append(b), keys.append(None), sizes.append(None)
            parts, held = [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, keys, sizes)], names=["u", "v", "bucket", "size"])
            for x in (u, v, keys, sizes):
                x.clear()
            return out

        for batch in batches:
            k, bits = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.diff(k)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(k)], strict=True):
                if a == b:
                    continue
                if k[a] != bucket:
                    if size > 1:
                        close()
                    bucket, parts, held, size = int(k[a]), [], 0, 0
                size += b - a
                if held <= most:  # beyond that only the size is of use
                    parts.append(bits[a:b])
                    held += b - a
            if len(u) >= 10_000:
                yield flush()
        if size > 1:
            close()
        yield flush()

    return run


def _block_links(radius: int):  # noqa: ANN202
    """Links within a pair of blocks of one bucket; ``first`` tells the blocks apart."""

    def run(groups: pa.Table) -> pa.Table:
        first, bits = np.asarray(groups.column("first")), np.asarray(groups.column("bits"))
        order = np.argsort(~first, kind="stable")
        split = int(first.sum())
        links = _forest(bits[order], radius, None if split in (0, len(bits)) else split)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(u, v): enough links within ``radius`` between fingerprints ``bits``, which are distinct, to connect all that are linked."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for i, m in enumerate(covering_masks(radius))))
    tables = distinct.select(F.explode(keys).alias("bucket"), "bits")
    sorted_ = tables.repartition("bucket").sortWithinPartitions("bucket")
    found = cut(sorted_.mapInArrow(_links_of_buckets(radius, most), _LINK))
    out = found.where("bucket IS NULL").select("u", "v")
    large = found.where("bucket IS NOT NULL").select("bucket", F.ceil(F.col("size") / (most // 2)).alias("blocks"))
    if large.isEmpty():
        return out
    rows = tables.join(large, "bucket").withColumn("block", F.pmod(F.xxhash64("bits", F.lit(7)), F.col("blocks")))
    paired = rows.select("bucket", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("first"), "bits")
    return out.unionByName(paired.groupBy("bucket", "a", "b").applyInArrow(_block_links(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest key that
    links reach, the document's own included. Null and empty texts have fingerprint 0 and are linked like any other.
    Rows with a null key get the component of their fingerprint, null if all of it has null keys; repeated rows stay.
    The key is an integer. Computed fingerprints are kept in the checkpoint folder, texts are not.
    """
    prints = cut(fingerprints(docs, text, [key]))
    distinct = cut(prints.groupBy("bits").agg(F.min(key).alias("least")))
    roots = cut(components(links(distinct, radius, most)))
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least", "root")
    # only fingerprints with links need their root's least key; a root of many is dealt to SALTS tasks
    linked = rooted.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)))
    smallest = linked.groupBy("root", "salt").agg(F.min("least").alias("m")).groupBy("root").agg(F.min("m").alias("component_id"))
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    by_bits = linked.join(spread, ["root", "salt"]).select("bits", "component_id").unionByName(rooted.where("root IS NULL").select("bits", F.col("least").alias("component_id")))
    return prints.join(by_bits, "bits").select(key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less all near-duplicates but the one with the smallest key of each group; columns as they were.

    Rows with a null key are kept only if no other document is in their group, and repeated rows of a kept key stay
    together: a key is taken to name one document.
    """
    marked = near_duplicates(docs, key, text)
    stay = marked.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__key")).distinct()
    return docs.join(stay, docs[key].eqNullSafe(stay["__key"]), "left_semi")


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
