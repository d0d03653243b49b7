"""Text columns: symbols and arrays printed as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coin_name(symbol: Column, quote_length: int = 4) -> Column:
    """Symbol without its quote currency suffix."""
    return F.left(symbol, F.char_length(symbol) - quote_length)


def _numbers(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda word: word != "")
    return F.transform(words, lambda word: word.try_cast("double"))


def _strip_brackets(text: Column) -> Column:
    return F.btrim(text, F.lit("[]"))


def parse_vector(text: Column) -> Column:
    """``[1 2.5 3]`` to an array of doubles."""
    return _numbers(_strip_brackets(text))


def parse_matrix(text: Column) -> Column:
    """``[[1 2] [3 4]]`` to an array of arrays; any whitespace may separate the rows."""
    return F.transform(F.split(_strip_brackets(text), r"\]\s+\["), _numbers)
