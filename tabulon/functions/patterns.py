"""Patterns that mean the same in Python and in Spark.

Java's word boundary does not count subscript digits and other number signs as word characters; Python's does. ``portable``
spells the boundary out with look-around over letters, numbers and the underscore.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _in_word(c: str) -> bool:
    return len(c) == 1 and c < "\U00010000" and (c == "_" or unicodedata.category(c)[0] in "LN")


def portable(pattern: str) -> str:
    """``pattern`` with Python's Unicode word boundary and word class, for Spark's regular expressions.

    Beside a letter of the pattern a boundary is a look to its other side alone, and before a letter it is looked for where the
    letter stands and not at every place of a text.
    """
    out, i, in_class, before = [], 0, False, ""
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            i += 2
            if pair == r"\b" and not in_class:
                after, then = pattern[i : i + 1], pattern[i + 1 : i + 2]
                pair = BOUNDARY
                if _in_word(before):
                    pair = f"(?!{_W})"
                elif _in_word(after) and then not in ("?", "*", "+", "{"):
                    pair = f"{after}(?<!{_W}{after})"
                    i += 1
            elif pair == r"\w":
                pair = _W[1:-1] if in_class else _W
            out.append(pair)
            before = pair[0] if pair.startswith(f"{pattern[i - 1 : i]}(?<!") else ""
            if pair[1] in "xu0123456789":  # digits of a code are no letters of the pattern
                code = re.match("[0-9a-fA-F]{0,4}", pattern[i:]).group()
                out.append(code)
                i += len(code)
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        before = "" if in_class else c
        i += 1
    return "".join(out)


def groups_in(pattern: str) -> int:
    return re.compile(pattern).groups


def matches(text: Column, pattern: str) -> Column:
    """Texts of all matches; with one group in the pattern, the group's text."""
    return F.regexp_extract_all(text, F.lit(portable(pattern)), F.lit(1 if groups_in(pattern) == 1 else 0))


def found(text: Column, pattern: str) -> Column:
    return text.rlike(portable(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(portable(pattern)))
