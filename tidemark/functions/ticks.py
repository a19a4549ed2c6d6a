"""Exact amounts of concentrated positions: whole numbers of up to 78 digits, as text, in Arrow batches."""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The range of ticks, the price of a tick, and the fraction bits of a square root price.
MIN_TICK, MAX_TICK, STEP, BITS = -887272, 887272, "1.0001", 96


@lru_cache(maxsize=1 << 16)
def root(tick: int) -> int | None:
    """The square root price of a tick, rounded down; null outside the range."""
    if not MIN_TICK <= tick <= MAX_TICK:
        return None
    with localcontext() as c:
        c.prec = 80
        return int((Decimal(STEP) ** tick).sqrt() * (1 << BITS))


def amounts(now: int, lower: int, upper: int, liquidity: int) -> tuple[int, int] | None:
    """Both amounts of a position at a square root price: outside its range it holds one token only."""
    if liquidity <= 0 or lower >= upper:
        return 0, 0
    a, b = root(lower), root(upper)
    if a is None or b is None:
        return None
    at = min(max(now, a), b)
    return liquidity * (b - at) * (1 << BITS) // (at * b), liquidity * (at - a) // (1 << BITS)


@F.pandas_udf(T.StringType())
def root_text(tick: pd.Series) -> pd.Series:
    """Square root prices of ticks, as text."""
    return tick.map(lambda t: None if pd.isna(t) or (r := root(int(t))) is None else str(r))


@F.pandas_udf(T.StructType([T.StructField("amount0", T.StringType()), T.StructField("amount1", T.StringType())]))
def exact_amounts(root_price: pd.Series, lower: pd.Series, upper: pd.Series, liquidity: pd.Series) -> pd.DataFrame:
    """struct(amount0, amount1) as text. root_price, liquidity: digits as text; lower, upper: ticks. Null if any is, or where a
    tick is out of range."""
    rows = []
    for p, a, b, n in zip(root_price, lower, upper, liquidity, strict=True):
        got = None if p is None or n is None or pd.isna(a) or pd.isna(b) else amounts(int(p), int(a), int(b), int(n))
        rows.append((None, None) if got is None else (str(got[0]), str(got[1])))
    return pd.DataFrame(rows, columns=["amount0", "amount1"], dtype=object)
