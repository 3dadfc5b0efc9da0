"""foreachBatch handlers: dead letters, routing, upserts and features of the newest bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators import indicators as I
from barflow.sources import events as E


def newest_features(bars: DataFrame, minutes: int, cache: int = 500, min_rows: int = 30, keys=("symbol", "timeframe")) -> DataFrame:
    """Canonical features of the newest bar of each series, from its last ``cache`` bars."""
    kept = B.tail(bars, cache, keys).drop("bar_idx")
    d = I.canonical(kept, minutes, keys=keys)
    newest = F.max_by(F.struct("bar_ts", *I.CANONICAL), "bar_idx").alias("_r")
    return d.groupBy(*keys).agg(newest, F.max("bar_idx").alias("_i")).filter(F.col("_i") >= min_rows - 1).select(*keys, "_r.*")


def feature_handler(read_bars: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], minutes: int):
    """On a batch of closed bars: features of the series that got one, from stored bars plus the batch."""

    def handle(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("symbol", "timeframe").distinct()
        stored = read_bars().join(touched, ["symbol", "timeframe"], "left_semi")
        write(newest_features(B.upsert(stored, batch), minutes), epoch)

    return handle


def routing_handler(message_id: str, body: str, sinks: dict[str, Callable[[DataFrame, int], None]], dead: Callable[[DataFrame, int], None]):
    """Parse a batch of raw messages once, hand each type to its sink and the bad rows to the dead letters."""

    def handle(batch: DataFrame, epoch: int) -> None:
        parsed = E.parse_events(batch, message_id, body).persist()
        try:
            dead(E.dead_letters(parsed, F.current_timestamp()), epoch)
            for kind, sink in sinks.items():
                sink(E.route(parsed, kind), epoch)
        finally:
            parsed.unpersist()

    return handle


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch; a replayed batch overwrites its own folder, so replays add nothing."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest_handler(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys=("symbol",)):
    """Keep the newest row per key: stored rows and the batch through one aggregate."""
    from barflow.operators.ticks import latest

    def handle(batch: DataFrame, epoch: int) -> None:
        old = read()
        write(latest(batch if old is None else old.unionByName(batch), keys))

    return handle
