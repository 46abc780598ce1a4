"""Token-id files: fixed-width bit packing with block offsets.

A shard is one self-contained byte string: a header, the documents in it (id and first token), the byte offset of every
block, and the blocks, each of ``BLOCK`` ids in the fewest bits that hold the vocabulary. A block starts at a whole byte,
so numpy unpacks any range of ids without reading what lies before it.

Spark writes shards as the ``data`` column of a Parquet dataset: commits, retries and remote stores are Spark's, and
readers skip to shards by partition and part. Documents are dealt to ranges of their ids before they are encoded, so
shards in order of (partition, part) hold all documents in ascending order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import shared_path, table
from tabulon.llm.tokens import encoder, tokenizer_path

MAGIC = b"TBP1"
BLOCK = 4096
#: Ids after which a shard is closed; a longer document has a shard to itself.
SHARD = 1 << 20
_HEADER = struct.Struct("<4sBIQQQ")
_CHUNK = BLOCK * 64


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first; BLOCK ids end at a whole byte whatever the width."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), _CHUNK):
        part = np.ascontiguousarray(ids[at : at + _CHUNK], dtype="<u4")
        out.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    padded = np.zeros((count, 32), dtype=np.uint8)
    padded[:, :bits] = flags
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(count)


class Shard(NamedTuple):
    """A shard that has been opened; nothing is unpacked until it is asked for."""

    bits: int
    tokens: int
    keys: np.ndarray  # document ids
    null: np.ndarray  # documents whose id is null
    starts: np.ndarray  # first token of each document, and the number of tokens
    blocks: np.ndarray  # byte offsets of the blocks
    data: memoryview

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the tokens from ``start`` up to ``end``, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, dtype="<u4")
        first = start // BLOCK
        count = min(self.tokens, -(-end // BLOCK) * BLOCK) - first * BLOCK
        found = unpack_bits(self.data[int(self.blocks[first]) :][: (count * self.bits + 7) // 8], self.bits, count)
        return found[start - first * BLOCK : end - first * BLOCK]

    def document(self, at: int) -> np.ndarray:
        return self.ids(int(self.starts[at]), int(self.starts[at + 1]))


def build_shard(keys: list[int | None], ids: list[bytes], bits: int) -> bytes:
    sizes = np.array([len(x) // 4 for x in ids], dtype="<u8")
    starts = np.concatenate((np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")))
    tokens = int(starts[-1])
    payload = pack_bits(np.frombuffer(b"".join(ids), "<u4"), bits)
    header = _HEADER.size + len(keys) * 9 + len(starts) * 8
    blocks = -(-tokens // BLOCK)
    offsets = header + blocks * 8 + np.arange(blocks, dtype="<u8") * (BLOCK * bits // 8)
    values = np.array([k or 0 for k in keys], dtype="<i8")
    null = np.array([k is None for k in keys], dtype=np.uint8)
    return b"".join([_HEADER.pack(MAGIC, bits, BLOCK, len(keys), tokens, blocks), values.tobytes(), null.tobytes(), starts.tobytes(), offsets.astype("<u8").tobytes(), payload])


def open_shard(data: bytes) -> Shard:
    magic, bits, block, docs, tokens, blocks = _HEADER.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a shard of this format")
    at = _HEADER.size
    keys = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
    starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs)
    offsets = np.frombuffer(data, "<u8", blocks, at + 9 * docs + 8 * (docs + 1))
    return Shard(bits, tokens, keys, null, starts, offsets, memoryview(data))


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, each closed by ``end_id``, and write them as shards in ascending order of ``key``.

    A null text counts as empty. Null keys come first, repeated keys lie together in the order of a hash of their texts.
    The key is an integer; other columns are not written. An empty table gives a dataset without shards.
    """
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        partition, part, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal part, before, held
            row = {"partition": [partition], "part": [part], "first_token": [before], "n_tokens": [held // 4], "n_docs": [len(keys)], "data": [build_shard(keys, ids, bits)]}
            part, before, held = part + 1, before + held // 4, 0
            keys.clear(), ids.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("partition", pa.int32()), ("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = enc.ids(x or "") + last
                if held and held + len(made) > 4 * SHARD:
                    yield close()
                keys.append(k), ids.append(made)
                held += len(made)
        if keys:
            yield close()

    tie = F.xxhash64(text)
    ranged = docs.select(key, text).withColumn("__tie", tie).repartitionByRange(key, "__tie").sortWithinPartitions(key, "__tie").select(key, text)
    shards = ranged.mapInArrow(run, "partition int, part int, first_token long, n_tokens long, n_docs long, data binary")
    shards.write.option("compression", "uncompressed").parquet(out)


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32), and the ids if asked for, of every document in the files at ``path``.

    start counts the ids of all documents before; only one total for each partition of the files reaches the driver.
    """
    files = spark.read.parquet(path)
    totals = dict(files.groupBy("partition").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = {}, 0
    for k in sorted(totals):
        bases[k] = base
        base += totals[k]
    shared = spark.sparkContext.broadcast(bases)
    fields = [(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = open_shard(batch.column(2)[i].as_py())
                before = shared.value[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                ids, starts = shard.ids(0, shard.tokens), shard.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = [pa.array(shard.keys, pa.int64(), mask=shard.null), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("partition", "first_token", "data").mapInArrow(run, ddl)


def op8_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"))
    return read_documents(spark, out)
