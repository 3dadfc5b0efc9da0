"""Audit and trade sinks: typed projections, idempotent inserts, partitioned appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_audit(df: DataFrame) -> DataFrame:
    return df.select("request_id", "model_version", F.round("confidence", 4).cast("decimal(5,4)").alias("confidence"),
                     F.round("latency_ms", 2).cast("decimal(12,2)").alias("latency_ms"), "outcome_reference")


def trade_outcomes(df: DataFrame) -> DataFrame:
    money = [F.col(c).cast("decimal(24,8)").alias(c) for c in ("entry_price", "exit_price", "pnl")]
    return df.select("trade_id", "symbol", "side", *money, F.col("pnl_pct").cast("decimal(12,6)").alias("pnl_pct"), "close_reason", "opened_at", "closed_at")


def new_trades(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid rows of a batch whose id is not stored yet; a repeated id in the batch is inserted once."""
    ok = batch.filter(F.col("side").isin("BUY", "SELL") & (F.col("quantity") > 0) & (F.col("price") > 0))
    return ok.dropDuplicates(["trade_id"]).join(stored.select("trade_id"), "trade_id", "left_anti")


def append(df: DataFrame, path: str, day_of: str, files: int = 8) -> None:
    """Append partitioned by day; the rows of a day share ``files`` files, each written by its own task."""
    d = df.withColumn("day", F.to_date(day_of))
    d.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("append").partitionBy("day").parquet(path)
