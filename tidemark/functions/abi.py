"""Fields of raw logs: topics and data in hex, words of 32 bytes. Column functions; null where a field is not there.

Whole numbers are DECIMAL(38,0), null beyond 38 digits; `number_text` gives those of any size as text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
NUMBER = "decimal(38,0)"


def digits(value: Column) -> Column:
    """Hex digits in lower case, without a prefix."""
    return F.lower(F.regexp_replace(value, r"^(0x|0X|\\x)", ""))


def word(data: Column, i: Column | int) -> Column:
    """The i-th word of the data, from 0."""
    at = (F.lit(i) if isinstance(i, int) else i) * WORD + 1
    found = F.substring(digits(data), at.cast("int"), F.lit(WORD))
    return F.when(F.length(found) == WORD, found)


def address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.right(digits(w), F.lit(40)))


def first_address(w: Column) -> Column:
    """The first 20 bytes: a pool's address in its id."""
    return F.concat(F.lit("0x"), F.substring(digits(w), 1, 40))


def uint(w: Column) -> Column:
    """An unsigned number of up to 38 digits: 30 hex digits are fewer, so longer ones are null."""
    return once(F.lpad(digits(w), WORD, "0"), lambda d: F.when(F.substring(d, 1, 34) == "0" * 34, _low(d)))


def integer(w: Column) -> Column:
    """A signed number in two's complement."""
    negative = lambda d: (_low(d) - F.lit(str(1 << 120)).cast(NUMBER)).cast(NUMBER)
    return once(F.lpad(digits(w), WORD, "0"), lambda d: F.when(F.substring(d, 1, 34) == "0" * 34, _low(d)).when(F.substring(d, 1, 34) == "f" * 34, negative(d)))


def _low(d: Column) -> Column:
    """The number in the last 30 of a word's digits."""
    part = lambda at: F.conv(F.substring(d, at, 15), 16, 10).cast(NUMBER)
    return (part(35) * F.lit(1 << 60).cast("decimal(20,0)") + part(50)).cast(NUMBER)


def array(data: Column, head: int) -> Column:
    """Words of a dynamic array; its head word is its place in bytes, where its length stands. Null where it is cut off."""
    place = lambda words: once((uint(F.get(words, F.lit(head))) / 32).try_cast("int"), lambda at: _items(words, at))
    return once(F.regexp_extract_all(digits(data), F.lit(f"(?s).{{{WORD}}}"), F.lit(0)), place)


def _items(words: Column, at: Column) -> Column:
    return once(uint(F.get(words, at)).try_cast("int"), lambda n: F.when(n <= F.size(words) - at - 1, F.slice(words, at + 2, n)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@F.pandas_udf(T.StringType())
def number_text(words: pd.Series) -> pd.Series:
    """A number of any size, as decimal text: ids beyond 38 digits."""
    return words.map(lambda x: None if x is None or x == "" else str(int(x.removeprefix("0x"), 16)))
