"""String functions that Spark lacks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _match_counts(a: str, b: str) -> tuple[int, int]:
    """Matching characters within half the longer length, and those out of order."""
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    theirs = [c for c, f in zip(b, free) if not f]
    return len(mine), sum(x != y for x, y in zip(mine, theirs))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m, moved = _match_counts(a, b)
    return (m / len(a) + m / len(b) + (m - moved // 2) / m) / 3 if m else 0.0


def winkler(a: str | None, b: str | None, weight: float = 0.1) -> float:
    """Jaro-Winkler of trimmed, lower-cased strings, 4 digits; two empty ones are equal."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    j = jaro(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return round(j + prefix * weight * (1 - j), 4)


@F.pandas_udf(DoubleType())
def jaro_winkler(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = winkler(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")
