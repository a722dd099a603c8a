"""Small column functions that fact-flow graphs use often."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def frequencies(words: Column) -> Column:
    """word -> count map of an array of words."""
    distinct = F.array_distinct(words)
    return F.map_from_entries(F.transform(distinct, lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def last(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))
