"""Text structure as Column expressions: lines, markers, tokens, n-grams and chunks.

Three readings of "content line" exist side by side, because analyses differ in what they skip:
``lines`` keeps every non-blank line, ``plain_lines`` drops lines that contain a marker, and ``content_lines`` drops only
lines that are a marker in capitals. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.arrays import let

# In-band structural markers.
MARKERS = ("<SURFACE>", "<COLUMN>", "<RULING>", "<BLANK_SPACE>", "<unk>")
RULING = "<RULING>"
MARKER_LINE = "^<[A-Z_]+>$"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
NUMERAL = r"\d+\([a-zA-Z₀-₉]+\)"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at either end (``trim`` alone leaves tabs)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(_text(text), "\n", -1), strip), lambda x: x != "")


def plain_lines(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Lines that contain no marker."""
    return F.filter(lines(text), lambda x: ~has_marker(x, markers))


def content_lines(text: Column) -> Column:
    """Lines that are not a capital marker by themselves; a lone <unk> is content."""
    return F.filter(lines(text), lambda x: ~x.rlike(MARKER_LINE))


def has_marker(line: Column, markers: Sequence[str] = MARKERS) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | line.contains(m)
    return out


def words(text: Column) -> Column:
    """Runs of non-white space."""
    return F.filter(F.split(_text(text), r"\s+", -1), lambda x: x != "")


def tokens(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Words that are not markers."""
    return F.filter(words(text), lambda x: ~x.isin(*markers)) if markers else words(text)


def morphemes(line: Column) -> Column:
    """Tokens of a line with numeral groups as <N>; none for a line with a marker."""
    some = F.filter(words(F.regexp_replace(line, NUMERAL, "<N>")), lambda x: x != "<unk>")
    return F.when(has_marker(line), F.array().cast("array<string>")).otherwise(some)


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items; none if there are fewer."""

    def runs(a: Column) -> Column:
        starts = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(a, i, n))

    return let(items, runs)


def ngram_keys(items: Column, n: int, sep: str = " ") -> Column:
    return F.transform(ngrams(items, n), lambda g: F.array_join(g, sep))


def chunks(text: Column, marker: str = RULING, least: int = 4, markers: Sequence[str] = MARKERS) -> Column:
    """Token arrays between markers; chunks below ``least`` tokens are dropped, and so are texts left with one chunk."""
    parts = F.filter(F.transform(F.split(_text(text), marker, -1), lambda c: tokens(c, markers)), lambda c: F.size(c) >= least)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<array<string>>"))


def without_subscripts(form: Column) -> Column:
    return F.translate(form, SUBSCRIPTS, "")


def collapsed(text: Column) -> Column:
    """White space as single spaces."""
    return F.regexp_replace(strip(text), r"\s+", " ")


def class_count(text: Column, char_class: str = r"[\x{12000}-\x{1247F}]") -> Column:
    """Code points of a class, markers left out."""
    return F.regexp_count(F.regexp_replace(_text(text), "<[A-Z_]+>", ""), F.lit(char_class))


def primary_label(label: Column, sep: str = ",", unknown: str = "Unknown") -> Column:
    """The first part of a list of labels; ``unknown`` stands for null."""
    return F.trim(F.element_at(F.split(F.coalesce(label, F.lit(unknown)), sep, -1), 1))


def relative_places(items: Column, least: int = 4) -> Column:
    """(place, item) with place from 0 to 1; none below ``least`` items."""

    def placed(a: Column) -> Column:
        return F.when(F.size(a) >= least, F.transform(a, lambda x, i: F.struct((i / (F.size(a) - 1)).alias("place"), x.alias("item"))))

    return let(items, placed)


def numeral_groups(line: Column) -> Column:
    """(count, unit) of every ``n(unit)`` group."""
    pattern = F.lit(r"(\d+)\(([^)]+)\)")
    counts, units = (F.regexp_extract_all(line, pattern, F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(counts.alias("n"), units.alias("unit")), lambda x: F.struct(x["n"].cast("long").alias("n"), x["unit"].alias("unit")))


def boundaries(text: Column, marker: str = RULING) -> Column:
    """(lines, cuts): content lines, and the interior places after which a marker line stands.

    A marker before any content, repeated markers and one after the last line add no cut.
    """
    every = lines(text)
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        at = F.size(acc["lines"]) - 1
        cut = F.when((x == marker) & (at >= 0), F.array_union(acc["cuts"], F.array(at))).otherwise(acc["cuts"])
        kept = F.when(x.rlike(MARKER_LINE), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(x)))
        return F.struct(kept.alias("lines"), cut.alias("cuts"))

    def interior(parsed: Column) -> Column:
        return F.struct(parsed["lines"].alias("lines"), F.filter(parsed["cuts"], lambda c: c < F.size(parsed["lines"]) - 1).alias("cuts"))

    return let(F.aggregate(every, start, step), interior)
