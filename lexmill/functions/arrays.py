"""Array helpers on SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def string(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fenced(df: DataFrame, name: str) -> DataFrame:
    """``df``; filters on the costly column ``name`` stay above it instead of computing it a second time.

    A filter on a computed column is pushed below the projection with the whole expression in it, but never below a generator.
    """
    return df.select(*(F.explode(F.array(c)).alias(c) if c == name else c for c in df.columns))


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def prefix_sums(array: str) -> str:
    """SQL: for each element of a bigint array, the sum of those before it. In blocks of about the square root of its length, so long arrays stay cheap."""
    add = "0L, (a, y) -> a + y"
    totals = f"transform(sequence(0, (size(_x) - 1) div _b), j -> aggregate(slice(_x, cast(j AS int) * _b + 1, _b), {add}))"
    heads = f"transform(_t, (s, j) -> aggregate(slice(_t, 1, j), {add}))"
    sums = f"transform(_x, (v, i) -> _h[cast(i div _b AS int)] + aggregate(slice(_x, cast(i div _b AS int) * _b + 1, i % _b), {add}))"
    body = let("_b", "cast(greatest(ceil(sqrt(size(_x))), 1) AS int)", let("_t", totals, let("_h", heads, sums)))
    return let("_x", array, f"CASE WHEN size(_x) = 0 THEN cast(array() AS array<bigint>) ELSE {body} END")


def prefix_maxima(array: str) -> str:
    """SQL: for each element of a bigint array, the largest of those before it (null for the first). In blocks, as ``prefix_sums``."""
    totals = "transform(sequence(0, (size(_x) - 1) div _b), j -> array_max(slice(_x, cast(j AS int) * _b + 1, _b)))"
    heads = "transform(_t, (s, j) -> array_max(slice(_t, 1, j)))"
    # greatest and array_max skip nulls; an empty slice has none
    maxima = "transform(_x, (v, i) -> greatest(_h[cast(i div _b AS int)], array_max(slice(_x, cast(i div _b AS int) * _b + 1, i % _b))))"
    body = let("_b", "cast(greatest(ceil(sqrt(size(_x))), 1) AS int)", let("_t", totals, let("_h", heads, maxima)))
    return let("_x", array, f"CASE WHEN size(_x) = 0 THEN cast(array() AS array<bigint>) ELSE {body} END")
