"""Edit distances (X3-X6): optimal string alignment, plain and weighted, as functions and Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hundredths; a change of case is free, a neighbouring key costs less
COSTS = {"insert": 100, "delete": 100, "replace": 100, "swap": 100, "case": 0, "near": 75}
_ROWS = [("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75)]
_AT = {c: (k + shift, row) for row, (keys, shift) in enumerate(_ROWS) for k, c in enumerate(keys)}


def near_keys(a: str, b: str) -> bool:
    """Next to each other on a QWERTY keyboard: in one row, or touching in the next.

    The top two rows touch to both sides; a bottom key touches the two keys above it, except that
    p has o and l only.
    """
    a, b = a.lower(), b.lower()
    if a not in _AT or b not in _AT or a == b:
        return False
    return b in _NEIGHBOURS[a]


def _neighbours() -> dict[str, set[str]]:
    top, middle, bottom = (keys for keys, _ in _ROWS)
    out: dict[str, set[str]] = {c: set() for c in _AT}
    for row in (top, middle, bottom):
        for x, y in zip(row, row[1:], strict=False):
            out[x].add(y)
            out[y].add(x)
    for upper, lower in ((top, middle), (middle, bottom)):
        for k, c in enumerate(lower):
            for other in upper[k : k + 2]:
                out[c].add(other)
                out[other].add(c)
    return out


_NEIGHBOURS = _neighbours()


def osa(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, no part edited twice."""
    return _align(a, b, lambda x, y: 0 if x == y else 1, 1, 1, None)


def weighted_osa(a: str, b: str, costs: dict[str, int] = COSTS) -> int:
    """X4."""

    def replace(x: str, y: str) -> int:
        if x == y:
            return 0
        if x.lower() == y.lower():
            return costs["case"]
        return costs["near"] if near_keys(x, y) else costs["replace"]

    return _align(a, b, replace, costs["insert"], costs["delete"], costs["swap"])


def _align(a: str, b: str, replace, insert: int, delete: int, swap: int | None) -> int:
    if not a:
        return len(b) * insert
    if not b:
        return len(a) * delete
    before, last = [], [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * delete]
        for j, y in enumerate(b, 1):
            price = replace(x, y)
            best = min(last[j - 1] + price, row[j - 1] + delete, last[j] + insert)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + (price if swap is None else swap))
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def weighted_osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StringType())
def nfc(words: pd.Series) -> pd.Series:
    """Composed form; Spark has no built-in for it. For non-ASCII words only."""
    return words.map(lambda w: w if w is None else unicodedata.normalize("NFC", w))
