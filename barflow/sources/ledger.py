"""Pipe-delimited ledger lines: TRADE and CLOSE, positional fields and then k=v."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positional fields of each line kind, after the kind itself.
TRADE_FIELDS = ["time", "trade_id", "symbol", "side", "quantity", "price"]
CLOSE_FIELDS = ["time", "position_id", "symbol", "side", "entry_price", "exit_price", "quantity", "pnl", "exit_reason"]
NUMBERS = {"quantity", "price", "entry_price", "exit_price", "pnl"}


def _parse(lines: DataFrame, kind: str, fields: list[str], line: str) -> DataFrame:
    keep = [c for c in lines.columns if c != line]
    d = lines.filter(F.col(line).startswith(f"{kind}|")).withColumn("_f", F.split(F.trim(F.col(line)), r"\|"))
    rest = F.slice("_f", len(fields) + 2, F.greatest(F.size("_f") - len(fields) - 1, F.lit(0)))
    pairs = F.transform(rest, lambda s: F.struct(F.substring_index(s, "=", 1), F.regexp_replace(s, "^[^=]*=", "")))
    cols = [F.get("_f", F.lit(n + 1)).alias(c) for n, c in enumerate(fields)]
    d = d.select(*keep, *cols, F.map_from_entries(pairs).alias("attributes"))
    return d.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in fields if c in NUMBERS})


def parse_trades(lines: DataFrame, line: str = "line") -> DataFrame:
    return _parse(lines, "TRADE", TRADE_FIELDS, line)


def parse_closes(lines: DataFrame, line: str = "line") -> DataFrame:
    return _parse(lines, "CLOSE", CLOSE_FIELDS, line)


def line_counts(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """TRADE and CLOSE lines per file; the row with a NULL file is the total."""
    text = F.trim(F.col(line))
    return lines.rollup(file).agg(F.count_if(text.startswith("TRADE|")).alias("trades"), F.count_if(text.startswith("CLOSE|")).alias("closes"))
