"""Landed kline files: scan, epoch normalisation, tidying, checksums and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.expr import col, finite
from barloom.schema import KLINE_COLUMNS, PANEL_SCHEMA

# Epochs at or above the first bound are microseconds, below it
# milliseconds; anything outside [LOW, HIGH) is not a plausible timestamp.
MICRO_FROM = 10**15
EPOCH_LOW = 10**12
EPOCH_HIGH = 10**16

# The file's own line order decides which duplicate is the last one.
INGEST_ORDER = ("_file", "_line")


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """All CSVs under ``path`` as twelve strings, with file and line order.

    A header is recognised per file by its first field; a symbol is the name of the
    directory holding the file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in KLINE_COLUMNS])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .csv(path, recursiveFileLookup=True)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    # Within one split monotonically_increasing_id follows the lines; splits of a file
    # are ordered by their start offset.
    numbered = raw.withColumn(
        "_line", F.struct("_block", F.monotonically_increasing_id().alias("_row"))
    ).drop("_block")
    return numbered.filter(F.lower(F.trim("open_time")) != "open_time").withColumn(
        "symbol", F.element_at(F.split("_file", "/"), -2)
    )


def epoch_micros(c: Column | str) -> Column:
    """Milliseconds or microseconds, decided per row, as microseconds; else NULL."""
    x = col(c).try_cast("bigint")
    return F.when(
        (x >= EPOCH_LOW) & (x < EPOCH_HIGH),
        F.when(x >= MICRO_FROM, x).otherwise(x * 1000),
    )


def epoch_problems(df: DataFrame, c: str) -> DataFrame:
    """Rows whose epoch is present but outside the plausible range."""
    return df.filter(F.col(c).try_cast("bigint").isNotNull() & epoch_micros(c).isNull())


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Drop duplicates of ``keys``, keeping the row that is last by ``order``.

    ``max_by`` aggregates map-side, so a key repeated any number of times is reduced
    before the shuffle instead of being collected in one window partition.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    )
    return latest.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def tidy_klines(raw: DataFrame, order=INGEST_ORDER) -> DataFrame:
    """Typed bars: unparsable numbers become NULL, missing trade counts zero."""
    number = lambda c: finite(F.col(c).try_cast("double"))
    typed = raw.select(
        "symbol",
        F.timestamp_micros(epoch_micros("open_time")).alias("open_ts"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")],
        F.coalesce(number("trades").cast("bigint"), F.lit(0).cast("bigint")).alias("trades"),
        number("taker_buy_quote_volume").alias("taker_buy_quote_volume"),
        *order,
    )
    typed = typed.withColumn("date", F.to_date("open_ts")).filter(
        F.col("date").isNotNull() & F.col("close").isNotNull()
    )
    return keep_last(typed, ["symbol", "date"], order).drop(*order)


def assemble_panel(bars: DataFrame, symbols: dict[str, str], source: str) -> DataFrame:
    """Rename symbols to assets, tag the source and cast to the panel schema."""
    pairs = [F.lit(x) for kv in symbols.items() for x in kv]
    asset = F.create_map(*pairs)[F.col("symbol")]
    tagged = bars.withColumn("asset", asset).withColumn("source", F.lit(source))
    return tagged.filter(F.col("asset").isNotNull()).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL_SCHEMA.fields]
    )


def ingest_findings(raw: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """(severity, check, symbol, n): rows that tidying or assembling leaves out, counted per symbol.

    Implausible or unreadable epochs and closes, and symbols the map lacks, are errors; a clean landing gives no row.
    """
    close = F.col("close").try_cast("double")
    checks = {
        "implausible_epoch": F.col("open_time").try_cast("bigint").isNotNull() & epoch_micros("open_time").isNull(),
        "unreadable_epoch": F.col("open_time").try_cast("bigint").isNull(),
        "unreadable_close": finite(close).isNull(),
        "unmapped_symbol": ~F.coalesce(F.col("symbol").isin(*symbols), F.lit(False)),
    }
    counts = raw.groupBy("symbol").agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    long = counts.unpivot(["symbol"], list(checks), "check", "n").filter("n > 0")
    return long.select(F.lit("error").alias("severity"), "check", "symbol", "n")


def verify_checksums(spark: SparkSession, path: str, suffix: str = ".CHECKSUM") -> DataFrame:
    """SHA-256 of every landed file against the first token of its checksum file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_sum = F.col("path").endswith(suffix)
    data = files.filter(~is_sum).select("path", F.sha2("content", 256).alias("actual"))
    sums = files.filter(is_sum).select(
        F.expr(f"left(path, length(path) - {len(suffix)})").alias("path"),
        F.lower(F.split(F.trim(F.col("content").cast("string")), r"\s+")[0]).alias("expected"),
    )
    return data.join(sums, "path", "left").select(
        "path", "expected", "actual",
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"),
    )


def month_coverage(landed: DataFrame, start: str, end: str) -> DataFrame:
    """Per symbol, how many months of [start, end] have landed and which have not.

    ``landed`` has columns (symbol, month DATE on the first of the month).
    """
    months = F.explode(
        F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 month"))
    )
    wanted = landed.select("symbol").distinct().select("symbol", months.alias("month"))
    have = landed.select("symbol", "month", F.lit(True).alias("landed")).distinct()
    return (
        wanted.join(have, ["symbol", "month"], "left")
        .groupBy("symbol")
        .agg(
            F.count("landed").alias("months_ok"),
            F.sum(F.when(F.col("landed").isNull(), 1).otherwise(0)).alias("months_unavailable"),
            F.min(F.when(F.col("landed").isNull(), F.col("month"))).alias("first_unavailable"),
        )
    )


