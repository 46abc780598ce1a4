"""Quality rules by compression bands: how well a text compresses, as a whole and in fixed chunks.

Prose compresses by a factor that depends mostly on its length. Text that repeats itself compresses far better; keys,
hashes and encoded files hardly at all. The least ratios below lie just above what random base64 reaches at the same
length and, above 6400 bytes, above random hex as well; clean prose lies above them. Shorter hex compresses as well as
dense prose of its length does, so the ratio cannot tell it apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.llm.common import table, with_text_columns

MIN_WORDS = 20
MAX_REPEATED_SHARE = 30  # per cent of words in repeated windows
WINDOW = 8
SYMBOLS = "#*$%&|<>"


class Bands(NamedTuple):
    """Limits on (bytes / compressed bytes): rows are (bytes up to, least ratio, most ratio), the last without an end."""

    limits: tuple[tuple[float, float, float], ...] = (
        (150, 0.0, 2.6),
        (200, 1.05, 2.6),
        (250, 1.12, 2.8),
        (300, 1.13, 2.8),
        (400, 1.18, 2.8),
        (500, 1.21, 3.0),
        (600, 1.25, 3.0),
        (800, 1.28, 3.0),
        (1_600, 1.35, 3.0),
        (3_200, 1.50, 3.4),
        (6_400, 1.70, 3.4),
        (12_800, 1.92, 3.8),
        (25_600, 1.97, 3.8),
        (float("inf"), 1.97, 4.2),
    )
    chunk_bytes: int = 4096
    #: Share of a text's bytes in chunks outside their limits above which the text is rejected.
    chunk_share: float = 0.34
    level: int = 3

    def outside(self, size: int, packed: int) -> bool:
        ratio = size / packed
        return next(not least <= ratio <= most for end, least, most in self.limits if size <= end)


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("bad_chunk_share", T.DoubleType()),
]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, every occurrence counted."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return 0
    span, left = 1, window
    while left > 1:  # windows of 2, 4, 8, ... words get equal numbers if and only if they are equal
        step = min(span, left - 1) if span * 2 > window else span
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span += step
        left = window - span + 1
    repeated = np.bincount(ids)[ids] > 1
    if not repeated.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[: len(ids)] += repeated
    edges[window : window + len(ids)] -= repeated
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Judge:
    """Measures and verdicts for batches of texts."""

    def __init__(self, bands: Bands) -> None:
        self.bands = bands
        self.compress = zstandard.ZstdCompressor(level=bands.level).compress

    def measure(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # of bytes, so at ASCII white space only
        blanks = sum(map(text.count, " \t\n\v\f\r"))
        repeats = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_SHARE * len(words)
        ratio, share = self.bands_of(raw)
        kept = not failed and not (ratio is None or self.bands.outside(len(raw), round(len(raw) / ratio))) and share <= self.bands.chunk_share
        return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, kept, ratio, share

    def bands_of(self, raw: bytes) -> tuple[float | None, float]:
        if not raw:
            return None, 0.0
        step = self.bands.chunk_bytes
        whole, bad = len(self.compress(raw)), 0
        if len(raw) > step:
            for at in range(0, len(raw), step):
                chunk = raw[at : at + step]
                bad += len(chunk) * self.bands.outside(len(chunk), len(self.compress(chunk)))
        return len(raw) / whole, bad / len(raw)

    def __call__(self, texts: list[str | None]) -> Sequence[Sequence]:
        return list(zip(*map(self.measure, texts), strict=True)) or [[] for _ in FIELDS]


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text, if not given) with the measures and verdicts of ``FIELDS``.

    One row out for each row in, repeated rows and null keys too. A null or empty text has no words, fails the base
    rules and has a null ratio. Columns with the names of ``FIELDS`` are replaced.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made: list[Judge] = []

    def compute(texts: list[str | None]) -> Sequence[Sequence]:
        if not made:
            made.append(Judge(bands))
        return made[0](texts)

    return with_text_columns(docs, text, FIELDS, compute, keep)


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they were."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = Judge(bands).measure
        for batch in batches:
            yield batch.filter(pa.array([verdict(x)[6] for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
