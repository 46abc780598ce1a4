"""Which tokens of two tokenizers spell the same bytes, and how often each pair of ids meets in the corpus.

A text is encoded twice. Running sums of token lengths give the byte offsets where tokens end; offsets that both sides share
cut the tokens into groups, and a search of each offset among those cuts tells its group. Pairs of tokens whose bytes overlap are links: for
each token of one side, the first and last token of the other side that it meets, expanded by repetition. All of that is
done for the texts of a batch at once.

White space, and a stop behind a letter, start a new token on both sides, so chunks of a text are aligned by themselves; most
chunks of a text were seen before, and what was found for them is remembered.

Links stay where they are made. Texts are gathered into blocks of about ``LINKS`` links, a block's distinct pairs of
ids are numbered, the most frequent first, and each link is kept as its pair's number. Only the distinct pairs of blocks
are shuffled: counted in two stages, salted by block, and sent back to their blocks, where sums over the links of each text are taken.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm.common import shared_path, table
from tabulon.llm.tokens import _BYTES, _LATIN, _ODD, tokenizer_path

#: Links of a block, characters of text that are aligned together, chunks of text remembered, and salts of a pair's count.
LINKS, TOGETHER, REMEMBER, SALTS = 1_000_000, 500_000, 300_000, 32
SPACE = "▁"
#: White space and what follows it, and apart from that the stops behind a letter. A text with other white space, with carriage returns (which pieces of code end in), or with what may be a
#: special token, is one chunk.
_CHUNK = re.compile(rf"(?:[ \t-\r]+|[.,;:!?])[^ \t-\r.,;:!?]*(?:(?<![A-Za-z{_LATIN}])[.,;:!?][^ \t-\r.,;:!?]*)*")
# Fixed value: the pre-tokens of byte-level tokenizers of this kind.
_PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What no piece of several characters may hold where chunks are to be aligned by themselves.
_ACROSS = re.compile(rf"[^{SPACE}]{SPACE}|[\t-\x0c]|[A-Za-z{_LATIN}][.,;:!?]")


_PROBE = " It's  a probe\n\n of 3,14 kinds; (well), naïve...\tStraße\n x \n\n  end, 'twas  don't,  "


class Side:
    """One tokenizer: the ids of texts, which start with white space or a stop, and the bytes of its tokens."""

    def __init__(self, spelt: list[bytes]) -> None:
        self.spelt = spelt
        self.lengths = np.array([len(b) for b in spelt], dtype=np.int64)

    def ids(self, spaced: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level tokenizer file. Where its ids are in the order of its merges, as a probe tells, short texts are merged by rank."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        hidden = {chr(c): b for b, c in _BYTES.items()}
        added = {t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        spelt, ranks = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True), {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            spelt[i] = token.encode() if token in added else b"".join(bytes([hidden[c]]) if c in hidden else c.encode("latin-1") for c in token)
            if token not in added:
                ranks[spelt[i]] = i
        super().__init__(spelt)
        self.ranked = tiktoken.Encoding("by rank", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        chunks = _CHUNK.findall(_PROBE)
        whole = self._whole(_PROBE)
        self.by_rank = self.ranked.encode_ordinary(_PROBE) == whole
        self.apart = self.by_rank and [i for x in self.ids(chunks) for i in x] == whole

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, spaced: list[str]) -> list[list[int]]:
        short = self.ranked.encode_ordinary if self.by_rank else self._whole
        return [short(t) if len(t) < 200 else self._whole(t) for t in spaced]


class Pieces(Side):
    """A SentencePiece model; ``apart`` where no piece reaches over white space that follows something else."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        super().__init__(spelt)
        self.space = self.model.piece_to_id(SPACE)
        whole = self.space != self.model.unk_id() and not any(len(p) > 1 and _ACROSS.search(p) for p in pieces)
        self.apart = whole and [i for x in self.ids(_CHUNK.findall(_PROBE)) for i in x] == self.ids([_PROBE])[0]

    def ids(self, spaced: list[str]) -> list[list[int]]:
        # the model puts a space first itself; a line end merges with nothing and keeps that space away from other texts
        made = self.model.encode([t[1:] if t[0] == " " else f"\n{t}" for t in spaced], num_threads=1)
        return [[self.space] if t == " " else x if t[0] == " " else x[2:] for t, x in zip(spaced, made, strict=True)]


@cache
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """One pair a process."""
    return ByteLevel(path_a), Pieces(path_b)


@cache
def _spellings(n_a: int, n_b: int) -> list[bytes]:
    """Ids as text with what follows them: of the first side a comma or a bar, of the second a comma, a semicolon or nothing."""
    return [f"{i}{x}".encode() for i in range(n_a) for x in ",|"] + [f"{i}{x}".encode() for i in range(n_b) for x in (",", ";", "")]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ends, the first from 0."""
    run = np.concatenate(([0], np.cumsum(values)))
    return run[ends] - run[np.concatenate(([0], ends[:-1]))]


def align(spaced: list[str], a: Side, b: Side) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, which starts with white space: (n_a, n_b, n_groups, n_links) as a row, and its groups; the links of all in turn as ids of a and of b, and where each text's end.

    A text that either side doesn't spell byte by byte has no tokens.
    """
    ids: tuple[list[int], list[int]] = [], []
    sizes = np.zeros((len(spaced), 2), dtype=np.int64)
    spell_a, spell_b = a.spelt.__getitem__, b.spelt.__getitem__
    for n, (text, x, y) in enumerate(zip(spaced, a.ids(spaced), b.ids(spaced), strict=True)):
        if b"".join(map(spell_a, x)) == text.encode("utf-8", "surrogatepass") == b"".join(map(spell_b, y)):
            sizes[n] = len(x), len(y)
            ids[0].extend(x)
            ids[1].extend(y)
    ids_a, ids_b = (np.array(x, dtype=np.int64) for x in ids)
    last_a, last_b = np.cumsum(sizes, axis=0).T
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    starts_a, starts_b = ends_a - a.lengths[ids_a], ends_b - b.lengths[ids_b]
    # the tokens of the other side that a token meets: from the first that ends behind its start to the last that starts before its end
    first, stop = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a)
    meets = stop - first
    link_a = np.repeat(np.arange(len(ids_a)), meets)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(meets) - meets, meets) + np.repeat(first, meets)
    n_links = _sums(meets, last_a)
    groups_at = np.concatenate(([0], np.searchsorted(cuts, np.concatenate(([0], ends_a))[last_a], side="right")))
    counts = np.column_stack([sizes, np.diff(groups_at), n_links])
    # groups as text: tokens of both sides in the order of their groups, the first side's ahead
    n_a, n_b, total = len(a.spelt), len(b.spelt), len(cuts)
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=total))))
    upto_a = np.cumsum(np.bincount(group_a, minlength=total))
    end_a, end_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    kind_b = end_b.astype(np.int64)
    if len(ids_b):
        kind_b[last_b[sizes[:, 1] > 0] - 1] = 2
    merged = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    merged[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + end_a
    merged[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * n_a + 3 * ids_b + kind_b
    spelling, at, groups = _spellings(n_a, n_b).__getitem__, 0, []
    for n in sizes.sum(axis=1).tolist():
        groups.append(b"".join(map(spelling, merged[at : at + n].tolist())))
        at += n
    return counts, groups, ids_a[link_a], ids_b[link_b], np.cumsum(n_links)


def _longer(held: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind its first ``size`` rows; room is doubled when it runs out."""
    if size + len(more) > len(held):
        room = np.empty((max(2 * len(held), size + len(more), 1024), *held.shape[1:]), dtype=held.dtype)
        room[:size] = held[:size]
        held = room
    held[size : size + len(more)] = more
    return held


class Aligner:
    """Alignments of texts, put together from those of their chunks. Pairs of ids are numbered as they come."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        self.numbers: dict[int, int] = {}
        self.pairs = np.empty(0, dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts, self.ends, self.links, self.size = np.empty((0, 4), dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), 0

    def _learn(self, spaced: list[str]) -> None:
        """Aligns chunks, which get the next numbers in turn."""
        counts, groups, ids_a, ids_b, ends = align(spaced, self.a, self.b)
        codes = ids_a * len(self.b.spelt) + ids_b
        distinct, inverse = np.unique(codes, return_inverse=True)
        new = [c for c in distinct.tolist() if c not in self.numbers]
        self.pairs = _longer(self.pairs, len(self.numbers), np.array(new, dtype=np.int64))
        self.numbers |= dict(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        mine = np.array([self.numbers[c] for c in distinct.tolist()], dtype=np.int32)[inverse]
        n = len(self.groups)
        self.counts, self.ends = _longer(self.counts, n, counts), _longer(self.ends, n, ends + self.size)
        self.links = _longer(self.links, self.size, mine)
        self.groups += groups
        self.size += len(mine)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each text (n_a, n_b, n_groups, n_links) as a row, and the digest of its groups; the links of all in turn, as numbers of pairs.

        Null and empty texts, and those that either side changes, have no tokens and an empty digest.
        """
        if len(self.known) > REMEMBER:
            self.forget()
        apart = self.a.apart and self.b.apart
        each: list[list[int]] = []
        new: list[str] = []
        known, single = self.known, []
        for text in texts:
            spaced = f" {text}" if text else ""
            chunks = _CHUNK.findall(spaced) if apart and not _ODD.search(spaced) and "\r" not in spaced and "\0" not in spaced else [spaced] if spaced else []
            at = [known.get(c, -1) for c in chunks]
            if -1 in at:
                for i, x in enumerate(at):
                    if x < 0:
                        at[i] = known.setdefault(chunks[i], len(self.groups) + len(new))
                        if at[i] == len(self.groups) + len(new):
                            new.append(chunks[i])
                if len(chunks) == 1:
                    single.append(chunks[0])
            each.append(at)
        if new:
            self._learn(new)
        for c in single:  # whole texts hardly come again
            known.pop(c, None)
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        every = np.array([i for x in each for i in x], dtype=np.int64)
        counts = self.counts[every]
        ends = np.cumsum(sizes)
        # a chunk that is not spelt byte by byte leaves its text without tokens
        sound = _sums((counts[:, 0] == 0).astype(np.int64), ends) == 0
        rows = np.column_stack([_sums(counts[:, i], ends) for i in range(4)]) * sound[:, None]
        digests = [hashlib.sha256(b";".join([self.groups[i] for i in x])).hexdigest() if x and ok else "" for x, ok in zip(each, sound.tolist(), strict=True)]
        lasting = np.repeat(sound, sizes)
        some, meets = every[lasting], counts[lasting, 3]
        first = self.ends[some] - meets
        links = self.links[np.repeat(first - (np.cumsum(meets) - meets), meets) + np.arange(int(meets.sum()))]
        return rows, digests, links


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One a process and pair of files; Spark reuses its Python workers, so chunks stay known from task to task."""
    return Aligner(*sides(path_a, path_b))


_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_LISTS = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, codes array<long>, counts array<long>, links binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers below 2^32, compressed byte by byte plane."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(path_a: str, path_b: str, links: int, schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        keys, counts, digests, found, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, keys, counts, digests, found, held
            every = np.concatenate(found)
            times = np.bincount(every, minlength=1)
            order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
            rank = np.zeros(len(times), dtype=np.int64)
            rank[order] = np.arange(len(order))
            rows = np.concatenate(counts)
            codes = made.pairs[order] if len(order) else np.zeros(0, dtype=np.int64)
            values = [number, keys, *(rows[:, i] for i in range(4)), digests, codes, times[order], _packed(rank[every])]
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
            number += 1
            keys, counts, digests, found, held = [], [], [], [], 0
            return out

        for batch in batches:
            own, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            sizes = np.cumsum([len(t) if t else 0 for t in texts])
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER)))
                row, digest, pairs = made.texts(texts[at:stop])
                keys += own[at:stop]
                counts.append(row)
                digests += digest
                found.append(pairs)
                held += len(pairs)
                at = stop
                if held >= links:
                    yield block()
        if keys:
            yield block()

    return run


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text of a block: links whose count is the highest of their second id, and the sum of the counts."""
    names = ["doc_id", *_DOC, "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for i in range(batch.num_rows):
            at = {n: batch.column(n)[i] for n in batch.schema.names}
            links = _unpacked(at["links"].as_py())
            each = [at["ids"].values, *(at[n].values for n in _DOC)]
            ends = np.cumsum(np.asarray(at["n_links"].values))
            totals = np.zeros((2, len(at["codes"])), dtype=np.int64)
            if at["graded"].is_valid:
                graded = at["graded"].values
                totals[:, np.asarray(graded.field("pos"))] = np.stack([np.asarray(graded.field("total")), np.asarray(graded.field("best"))])
            yield pa.RecordBatch.from_arrays([*each, pa.array(_sums(totals[1][links], ends)), pa.array(_sums(totals[0][links], ends)), at["digests"].values], names=names)


def counted(pairs: DataFrame, width: int) -> DataFrame:
    """(code, total, best): how many links hold each pair of ids, and 1 where that is the most of its second id.

    ``pairs`` has block, code and n. Counts are summed by pair and salt and then by pair; a maximum for each second id,
    of which there are no more than the vocabulary has, is broadcast.
    """
    salted = pairs.groupBy("code", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    totals = salted.groupBy("code").agg(F.sum("n").alias("total")).withColumn("b", F.col("code") % width)
    most = totals.groupBy("b", (F.xxhash64("code") % SALTS).alias("salt")).agg(F.max("total").alias("most")).groupBy("b").agg(F.max("most").alias("most"))
    return totals.join(F.broadcast(most), "b").select("code", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", links: int = LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    Side a is a byte-level tokenizer file that gets a space before the text, side b a SentencePiece model that adds one itself. Strings of
    special tokens are plain text. Null and empty texts, and texts that either side changes, have zeros and an empty digest. Repeated rows and
    null keys stay; every row's links count. Other columns are left out; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path = shared_path(spark, "alignment")
    source.mapInArrow(_blocks(path_a, path_b, links, to_arrow_schema(StructType.fromDDL(_LISTS))), _LISTS).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(_LISTS).parquet(path)
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("codes", "counts")).alias("pos", "x")).select("block", F.col("pos").cast("long").alias("pos"), F.col("x.codes").alias("code"), F.col("x.counts").alias("n"))
    sent = pairs.join(counted(pairs, width), "code").groupBy("block").agg(F.collect_list(F.struct("pos", "total", "best")).alias("graded"))
    met = blocks.drop("counts").join(sent, "block", "left")
    return met.mapInArrow(_graded, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
