"""Binding: an expression used inside a lambda is evaluated for every element; bound by ``let``, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """``let`` for several values, passed to ``body`` by name."""
    packed = F.struct(*(v.alias(n) for n, v in values.items()))
    return let(packed, lambda s: body(**{n: s[n] for n in values}))
