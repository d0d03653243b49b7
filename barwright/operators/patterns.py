"""Read queries over matched price patterns, whose vectors are stored as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_matrix, parse_vector


def original_pairs(patterns: DataFrame) -> DataFrame:
    """When each original symbol's newest pattern starts."""
    return (
        patterns.groupBy(F.col("symbol2").alias("symbol"))
        .agg(F.max("start_date2").cast("string").alias("discovered_on"))
        .orderBy("symbol")
    )


def pattern_detail(patterns: DataFrame, original_pair: str) -> DataFrame:
    """Matches of one original symbol's newest pattern, in a fixed order; no row if there is none.

    The symbol is bound as a query parameter, never spliced into the text.
    """
    rows = patterns.sparkSession.sql(
        """
        select * from {patterns}
        where symbol2 = :pair and start_date2 = (select max(start_date2) from {patterns} where symbol2 = :pair)
        """,
        args={"pair": original_pair},
        patterns=patterns,
    )
    return rows.orderBy("symbol1", "start_date1").select(
        F.col("symbol2").alias("original_symbol"),
        F.col("start_date2").cast("string").alias("original_start_date"),
        F.col("end_date").cast("string").alias("original_end_date"),
        parse_vector(F.col("prices2")).alias("original_prices"),
        parse_vector(F.col("s2_norm")).alias("original_fibonacci"),
        F.array("symbol1").alias("similar_symbols"),
        F.array(F.col("start_date1").cast("string")).alias("similar_start_dates"),
        F.array(F.col("end_date").cast("string")).alias("similar_end_dates"),
        parse_matrix(F.col("prices1")).alias("similar_prices"),
        parse_matrix(F.col("s1_norm")).alias("similar_fibonacci"),
    )
