"""Keyed tables with insert-once rows on plain parquet."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timegrid import epoch_seconds, int_div
from ..schemas import CANDLE_KEY, CANDLES, PREDICTION_KEY, PREDICTIONS, SIGNAL_KEY, SIGNALS, SYNC_LOOKBACK, SYNC_SHIFT
from ..session import materialize, scratch
from .candles import clock
from .current import VersionedTable


def day_of(seconds: Column) -> Column:
    """UTC day of epoch seconds, whatever the session time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), int_div(seconds, F.lit(86400)).cast("int"))


class KeyedTable:
    """A parquet table whose rows are unique by key; an existing row is never replaced.

    Rows are laid out by their coarse key columns and by day, so reads prune to the intervals and days they need
    and an insert compares itself only with the days it touches. One job writes to a table at a time: appends of two
    writers that start together do not see each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], time: str,
                 partitions: Sequence[str] = ()):
        self.spark, self.path, self.key, self.time = spark, path, list(key), time
        self.partitions = [*partitions, "day"]
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField("day", T.DateType())])

    def provision(self) -> KeyedTable:
        """Create the table if it is absent."""
        self.spark.createDataFrame([], self.stored).write.mode("append").partitionBy(*self.partitions).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().select(*self.schema.names)

    def since(self, seconds: int) -> DataFrame:
        """Rows at or after a time, read from the days that can hold them."""
        return self.read().filter((F.col("day") >= day_of(F.lit(seconds))) & (F.col(self.time) >= seconds)).select(
            *self.schema.names
        )

    def before(self, seconds: int) -> DataFrame:
        """Rows before a time, read from the days that can hold them."""
        return self.read().filter((F.col("day") <= day_of(F.lit(seconds))) & (F.col(self.time) < seconds)).select(
            *self.schema.names
        )

    def between(self, first: int, end: int) -> DataFrame:
        """Rows from a time on and before another, read from the days that can hold them."""
        days = F.col("day").between(day_of(F.lit(first)), day_of(F.lit(end - 1)))
        return self.read().filter(days & (F.col(self.time) >= first) & (F.col(self.time) < end)).select(*self.schema.names)

    def on_days(self, days: Sequence[datetime.date]) -> DataFrame:
        """Stored rows of some days; no other day is read."""
        return self.read().filter(F.col("day").isin(list(days)))

    def insert_ignore(self, batch: DataFrame, order: Sequence[str] | None = None) -> list[datetime.date]:
        """Append the rows whose key is new: of several with one key the first by ``order`` (else by all columns).

        The batch is computed once; its days, the comparison and the append read what was written. Only the days that the batch
        has are compared, however far apart they lie. Returns them.
        """
        names = [*self.schema.names, *[name for name in order or () if name not in self.schema.names]]
        day = day_of(F.col(self.time))
        typed = batch.select(*names).withColumns({f.name: F.col(f.name).cast(f.dataType) for f in self.schema})
        with scratch(self.spark):
            rows = materialize(typed.withColumn("day", day), "batch")
            days = sorted(r["day"] for r in rows.select("day").distinct().collect() if r["day"] is not None)
            if days:
                fresh = insert_ignore(self.on_days(days), rows, self.key, order).select(*self.stored.names)
                # files by partition; adaptive execution splits large partitions and joins small ones
                fresh.hint("rebalance", *self.partitions).write.mode("append").partitionBy(*self.partitions).parquet(self.path)
                self._inserted(rows)
            return days

    def _inserted(self, batch: DataFrame) -> None:
        """Called with every batch, new rows and others, after the append."""


def first_per_key(batch: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key. An aggregate, so copies collapse before the shuffle however many there are of one key."""
    rest = [name for name in batch.columns if name not in key]
    order = list(order or rest)
    chosen = F.min_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*key).agg(chosen.alias("row")).select(*key, "row.*").select(*batch.columns)


def insert_ignore(existing: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``existing`` does not hold yet."""
    return first_per_key(batch, key, order).join(existing.select(*key), list(key), "left_anti")


class CandleTable(KeyedTable):
    """Base candles, with the time of the first and the newest candle of each symbol beside them.

    The marks follow every insert from its batch, so that jobs know which symbols have something new, and how far back, without a
    scan. Should a run die between the append and the marks, the same insert run again mends them.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CANDLES, CANDLE_KEY, "open_time")
        self._marks = VersionedTable(spark, f"{path.rstrip('/')}-marks", MARKS)

    def marks(self) -> DataFrame:
        """``symbol, first_time, last_time``. A table that was filled without marks is read once for them."""
        if not self._marks.exists():
            self._marks.replace(candle_marks(self.rows()))
        return self._marks.read()

    def _inserted(self, batch: DataFrame) -> None:
        known = self.marks()
        new = candle_marks(batch)
        self._marks.replace(
            known.unionByName(new).groupBy("symbol").agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
        )


MARKS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("first_time", T.LongType()), T.StructField("last_time", T.LongType())]
)


def candle_marks(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol").agg(F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


class SignalTable(KeyedTable):
    """Signal rows, with the newest row of each series beside them: all that a catch-up needs of what is stored."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SIGNALS, SIGNAL_KEY, "bar_start", ["bar_interval"])
        self._newest = VersionedTable(spark, f"{path.rstrip('/')}-newest", SIGNALS)

    def newest(self) -> DataFrame:
        """The newest row of each series. A table that was filled without them is read once."""
        if not self._newest.exists():
            self._newest.replace(newest_rows(self.rows()))
        return self._newest.read()

    def replace_newest(self, days: Sequence[datetime.date]) -> None:
        """Takes over what an insert has stored on ``days``. The rows come from the table: a row that was there before holds."""
        self._newest.replace(newest_rows(self.newest().unionByName(self.on_days(days).select(*SIGNALS.names))))


def newest_rows(signals: DataFrame) -> DataFrame:
    """The newest row of each series."""
    newest = signals.groupBy("bar_interval", "symbol").agg(F.max_by(F.struct(*signals.columns), "bar_start").alias("row"))
    return newest.select("row.*")


def candle_table(spark: SparkSession, path: str) -> CandleTable:
    return CandleTable(spark, path)


def signal_table(spark: SparkSession, path: str) -> SignalTable:
    return SignalTable(spark, path)


def prediction_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, PREDICTIONS, PREDICTION_KEY, "open_time")


def shifted_predictions(source: DataFrame, as_of=None) -> DataFrame:
    """Recent priced predictions of a store that keeps local time (UTC+7), with UTC epoch times.

    ``open_time`` of the source is a timestamp; ``as_of`` is compared on the same clock, in epoch seconds.
    """
    kind = source.schema["open_time"].dataType
    wall_clock = isinstance(kind, T.TimestampNTZType)
    seconds = source.withColumn(
        "open_time", epoch_seconds(F.col("open_time")) if wall_clock else F.unix_seconds("open_time")
    )
    recent = seconds.filter(
        (F.col("last_price") > 0) & (F.col("open_time") > clock(seconds, as_of) - SYNC_LOOKBACK)
    )
    return recent.withColumn("open_time", F.col("open_time") - SYNC_SHIFT).select(*PREDICTIONS.names)
