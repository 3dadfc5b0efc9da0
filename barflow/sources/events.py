"""JSON event envelopes: parsing, dead letters and routing by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "event_id string, event_type string, timestamp string, source string, payload string, correlation_id string"

# Payload schemas by event type.
PAYLOADS = {
    "market_tick": "symbol string, price double, volume double, timestamp string, bid double, ask double",
    "price_fluctuation": "symbol string, price double, previous_price double, change_pct double, volume double, threshold_pct double",
    "candle_closed": "symbol string, interval string, open double, high double, low double, close double, volume double, timestamp string",
    "feature_computed": "symbol string, features map<string,double>, quality_score double",
    "model_prediction": "symbol string, model_name string, prediction double, confidence double, features_used array<string>, feature_importance map<string,double>",
    "decision_ready": "symbol string, signal string, confidence double, position_size double",
    "risk_approved": "symbol string, side string, quantity double, price double, stop_loss double, take_profit double",
    "order_fill": "order_id string, trade_id string, symbol string, side string, quantity double, fill_price double",
    "position_closed": "position_id string, symbol string, entry_price double, exit_price double, pnl double, exit_reason string",
}


def parse_events(raw: DataFrame, message_id: str, body: str) -> DataFrame:
    """Envelope columns plus ``reason``, which is NULL for a good row."""
    text = F.trim(F.col(body))
    d = raw.select(F.col(message_id).alias("message_id"), F.col(body).alias("event_data"),
                   F.from_json(body, f"{ENVELOPE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_e"))
    empty = F.col("event_data").isNull() | (F.trim("event_data") == "")
    reason = (F.when(empty, "empty").when(F.col("_e").isNull() | F.col("_e._bad").isNotNull(), "malformed_json")
              .when(F.coalesce(F.col("_e.event_type"), F.lit("")) == "", "missing_event_type")
              .when(F.coalesce(F.col("_e.source"), F.lit("")) == "", "missing_source"))
    return d.select("message_id", "event_data", *[f"_e.{c.split()[0]}" for c in ENVELOPE.split(", ")], reason.alias("reason"))


def dead_letters(parsed: DataFrame, failed_at: Column) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select(
        F.col("message_id").alias("original_message_id"), failed_at.alias("failed_at"), "reason", F.substring(F.coalesce("event_data", F.lit("{}")), 1, 1000).alias("event_data"))


def route(parsed: DataFrame, event_type: str) -> DataFrame:
    """Good events of one type with their typed payload."""
    good = parsed.filter(F.col("reason").isNull() & (F.col("event_type") == event_type))
    return good.withColumn("p", F.from_json("payload", PAYLOADS[event_type]))
