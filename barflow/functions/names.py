"""Short names for the columns that bar expressions use most; columns are made on access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COLUMNS = {
    "O": "open", "H": "high", "L": "low", "C": "close", "V": "volume", "I": "bar_idx", "ATR": "_atr",
    "BODY": "_body", "UP": "_up", "DOWN": "_down", "BR": "_br", "UR": "_ur", "LR": "_lr", "BULL": "_bull",
}


class _Names:
    def __getattr__(self, name: str) -> Column:
        if name == "TP":
            return (F.col("high") + F.col("low") + F.col("close")) / 3
        return F.col(_COLUMNS[name])


b = _Names()
