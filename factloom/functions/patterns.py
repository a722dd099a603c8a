"""Patterns for rules: a test of a value's shape, and the columns it binds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Bind(str):
    """The name under which a part of the value is bound."""


ANY = Bind("")


def match(pattern: Any, value: Column) -> tuple[Column, dict[str, Column]]:
    """(does the value match, bound columns). A pattern is ANY, a Bind, a literal, a dict of field ->
    pattern, or a tuple whose parts match a struct's fields _1, _2, ... or an array's elements. A field
    that is null matches no pattern but ANY and None."""
    if isinstance(pattern, Bind):
        return F.lit(True) if pattern == "" else value.isNotNull(), {pattern: value} if pattern else {}
    if pattern is None:
        return value.isNull(), {}
    if isinstance(pattern, dict):
        parts = [match(p, value[k]) for k, p in pattern.items()]
    elif isinstance(pattern, tuple):
        parts = [match(p, F.get(value, F.lit(i))) for i, p in enumerate(pattern)]
        parts.append((F.size(value) == len(pattern), {}))
    else:
        return F.coalesce(value == F.lit(pattern), F.lit(False)), {}
    test, bound = F.lit(True), {}
    for t, b in parts:
        test, bound = test & t, bound | b
    return F.coalesce(test, F.lit(False)), bound
