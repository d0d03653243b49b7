"""Base candles: landed vendor records, stored tables, and the ranges incremental jobs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import to_number
from ..functions.timegrid import int_div
from ..schemas import CANDLES, INGEST_LAG, INGEST_LOOKBACK, LANDED_CANDLES, VALUE_COLUMNS


MALFORMED = "malformed"


def latest_time(df: DataFrame, column: str = "open_time") -> Column:
    """Newest time of a table as a scalar subquery: the clock of queries that are given none."""
    return df.agg(F.max(column).alias("latest")).scalar()


def clock(df: DataFrame, as_of: int | Column | None, column: str = "open_time") -> Column:
    if as_of is None:
        return latest_time(df, column)
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def read_landed(spark: SparkSession, path: str | list[str], file_format: str = "json") -> DataFrame:
    """Vendor files as they landed, one or more per symbol, with each row's file and, where it is malformed, its text.

    A file that cannot be read does not stop the others; ``unread_files`` lists it.
    """
    schema = T.StructType([*LANDED_CANDLES.fields, T.StructField(MALFORMED, T.StringType())])
    rows = (
        spark.read.format(file_format)
        .schema(schema if file_format in ("json", "csv") else LANDED_CANDLES)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("ignoreCorruptFiles", "true")
        .load(path)
    )
    if file_format not in ("json", "csv"):
        rows = rows.withColumn(MALFORMED, F.lit(None).cast("string"))
    return rows.withColumn("file", F.col("_metadata.file_path"))


def unread_files(spark: SparkSession, path: str | list[str], landed: DataFrame) -> DataFrame:
    """``file, reason`` of the landed files that no record came from: damaged, half written, or empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    read = landed.select(plain_path("file").alias("file")).distinct()
    return files.select(plain_path("file").alias("file")).join(read, "file", "left_anti").select(
        "file", F.lit("no record could be read").alias("reason")
    )


def plain_path(name: str) -> Column:
    """A file's path without the scheme of a local store, which readers write differently."""
    return F.regexp_replace(name, "^file:/+", "/")


def file_ledger(spark: SparkSession, path: str | list[str], landed: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """What each landed JSON or CSV file should hold and what was read of it: one row a file.

    ``expected_bytes`` is the file's size, of a gzip file the size that its trailer states for the text inside; ``read_bytes`` is the
    text that came out of it. ``expected`` (``file, records``, as the sender lists them) adds ``expected_records``; ``lost`` is how many
    of them are neither candles nor rejects. ``status`` is ``whole``, ``cut off`` (less text or fewer records than expected) or
    ``unread`` (nothing came of it, or it never came). Empty files show only where the sender lists them.
    """
    store = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    zipped = F.lower("path").endswith(".gz")
    # the last four bytes, least first: the text's size modulo 2^32
    trailer = _little_endian(F.substring("content", -4, 4))
    files = store.select(
        plain_path("path").alias("file"), F.col("length").alias("bytes"),
        F.when(zipped, trailer).otherwise(F.col("length")).alias("expected_bytes"), zipped.alias("zipped"),
    )
    lines = (
        spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
        .select(plain_path("_metadata.file_path").alias("file"), (F.octet_length("value") + 1).alias("size"))
        .groupBy("file").agg(F.sum("size").alias("read_bytes"))
    )
    bad = reject_reason(landed).isNotNull()
    counts = landed.groupBy(plain_path("file").alias("file")).agg(
        F.count_if(~bad).alias("candles"), F.count_if(bad).alias("rejected")
    )
    if expected is None:
        expected = files.select("file", F.lit(None).cast("long").alias("records")).limit(0)
    named = expected.select(plain_path("file").alias("file"), F.col("records").cast("long").alias("expected_records"))
    # files that the sender lists and that never came, or came empty, have a row too
    rows = files.join(named, "file", "full").join(lines, "file", "left").join(counts, "file", "left").na.fill(
        0, ["bytes", "expected_bytes", "read_bytes", "candles", "rejected"]
    ).na.fill(False, ["zipped"])
    read = F.col("candles") + F.col("rejected")
    lost = F.greatest(F.col("expected_records") - read, F.lit(0))
    # the last line may end without a line feed; sizes of zipped texts are known modulo 2^32
    size = F.when(F.col("zipped"), F.col("read_bytes") % 4294967296).otherwise(F.col("read_bytes"))
    short = ~size.isin(F.col("expected_bytes"), F.col("expected_bytes") + 1)
    return rows.select(
        "file", "bytes", "expected_bytes", "read_bytes", "expected_records", "candles", "rejected", lost.alias("lost"),
        F.when((read == 0) & ((F.col("bytes") > 0) | (lost > 0)), "unread").when(short | (lost > 0), "cut off").otherwise("whole").alias("status"),
    )


def _little_endian(four: Column) -> Column:
    digits = [F.conv(F.hex(F.substring(four, at, 1)), 16, 10).cast("long") for at in (1, 2, 3, 4)]
    return digits[0] + digits[1] * 256 + digits[2] * 65536 + digits[3] * 16777216


def reject_reason(landed: DataFrame) -> Column:
    """Why a landed record cannot become a candle; NULL if it can."""
    reason = F.when(F.col(MALFORMED).isNotNull(), "malformed record") if MALFORMED in landed.columns else F.when(F.lit(False), "")
    return reason.when(F.col("symbol").isNull(), "no symbol").when(F.col("time").try_cast("long").isNull(), "no usable time")


def rejected(landed: DataFrame) -> DataFrame:
    """Landed records that cannot become candles, as they are, with the reason."""
    return landed.withColumn("reason", reject_reason(landed)).filter(F.col("reason").isNotNull())


def read_candles(spark: SparkSession, source: str | None = None, file_format: str = "parquet", **options: str) -> DataFrame:
    """Stored base candles: a path, or another store through its format (``jdbc`` with url and dbtable)."""
    reader = spark.read.format(file_format).options(**options)
    if file_format == "jdbc":
        return reader.load().select(*CANDLES.names)
    return reader.schema(CANDLES).load(source)


def normalize_landed(landed: DataFrame) -> DataFrame:
    """Candles from landed text records.

    Values are coerced first (what is no number counts as 0), then the symbol is attached in upper case. A record's
    millisecond time marks the end of its minute. Records that ``rejected`` names are not among them.
    """
    time = F.col("time").try_cast("long")
    typed = landed.filter(reject_reason(landed).isNull()).select(
        F.upper("symbol").alias("symbol"),
        (int_div(time, F.lit(1000)) - 60).alias("open_time"),
        *[to_number(F.col(name)).alias(name) for name in VALUE_COLUMNS],
    )
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in CANDLES])


def ingest_window(base: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """One row: where the next fetch starts (after the newest candle of the last hour) and where it ends."""
    now = clock(base, as_of)
    recent = base.filter(F.col("open_time") > now - INGEST_LOOKBACK)
    return recent.agg((F.max("open_time") + 1).alias("start_time")).select(
        "start_time", (now - INGEST_LAG).alias("end_time")
    )


def look_back(df: DataFrame, as_of: int | Column | None, seconds: int, column: str = "open_time") -> DataFrame:
    """Rows no older than ``seconds`` before the clock; the bound reaches the scan."""
    return df.filter(F.col(column) >= clock(df, as_of, column) - seconds)


def gather(parts: list[DataFrame]) -> DataFrame:
    """Per-symbol batches as one frame."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
