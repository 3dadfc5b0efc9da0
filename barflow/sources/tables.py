"""Parquet tables laid out for pruning: partitioned by symbol, timeframe and month, sorted by time."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.session import stage

PARTITIONS = ["symbol", "timeframe", "month"]


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Append or replace partitions. Rows are clustered by key and month, so a hot symbol is many files."""
    (bars.withColumn("month", month_of(F.col("bar_ts"))).repartition(*PARTITIONS)
     .sortWithinPartitions("symbol", "timeframe", "bar_ts")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars at ``path``; filters on symbol and timeframe prune folders, and so does a range given by ``start`` and ``end``."""
    d = spark.read.parquet(path)
    for bound, keep in ((start, lambda m, b: m >= b), (end, lambda m, b: m <= b)):
        if bound is not None:
            ts = F.lit(bound).cast("timestamp_ntz")
            d = d.filter(keep(F.col("month"), month_of(ts)) & keep(F.col("bar_ts"), ts))
    return d.drop("month")


def upsert_bars(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Merge a batch into the table: only the folders that the batch touches are read and written again."""
    touched = batch.select("symbol", "timeframe", month_of(F.col("bar_ts")).alias("month")).distinct()
    stored = spark.read.parquet(path).join(touched, PARTITIONS, "left_semi").drop("month")
    # Written aside first: the folders being replaced are those being read.
    write_bars(stage(B.upsert(stored, batch)), path, "overwrite")


def load_partition(labeled: DataFrame, timeframe: str) -> DataFrame:
    """The rows of one timeframe; on a table partitioned by timeframe this prunes folders."""
    return labeled.filter(F.col("timeframe") == timeframe)


def write_labeled(labeled: DataFrame, folder: str, timeframes: list[str]) -> None:
    """Replace ``labeled_{timeframe}.parquet`` under ``folder`` for each of the given timeframes.

    Rows are range partitioned by series and time, so a hot symbol is many files and row groups can be skipped by time.
    """
    for name in timeframes:
        rows = labeled.filter(F.col("timeframe") == name)
        rows.repartitionByRange("symbol", "bar_ts").sortWithinPartitions("symbol", "bar_ts").write.mode("overwrite").parquet(os.path.join(folder, f"labeled_{name}.parquet"))


def read_labeled(spark: SparkSession, folder: str, timeframe: str) -> DataFrame | None:
    """``labeled_{timeframe}.parquet`` under ``folder``, None if it does not exist."""
    try:
        return spark.read.parquet(os.path.join(folder, f"labeled_{timeframe}.parquet"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
