"""Market regime rules and the persistence filter over regime labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import col
from barflow.operators.folds import chunk_fold
from barflow.operators.series import CHUNK, KEYS

# Regime names and rule thresholds.
REGIMES = ["crisis", "trending", "ranging", "neutral"]
CRISIS_VOL, CRISIS_VOL_OF_VOL = 3.0, 2.0


def regime_label(hurst: Column, adx: Column, vol_regime: Column, vol_of_vol: Column) -> Column:
    return (F.when((vol_regime > CRISIS_VOL) | (vol_of_vol > CRISIS_VOL_OF_VOL), "crisis")
            .when((hurst > 0.55) & (adx > 22), "trending")
            .when((hurst < 0.47) & (adx < 18), "ranging").otherwise("neutral"))


def context_regime(volatility: Column, trend: Column) -> Column:
    return F.when(volatility > 0.03, "high_volatility").when(trend > 0.7, "trending").otherwise("ranging")


def crisis_guard(df: DataFrame, keys=KEYS) -> DataFrame:
    """Is the newest bar of each series in a crisis."""
    crisis = (F.col("vol_regime") > CRISIS_VOL) | (F.col("vol_of_vol") > CRISIS_VOL_OF_VOL)
    last = F.max_by(F.struct("bar_ts", crisis.alias("crisis")), "bar_idx").alias("r")
    return df.groupBy(*keys).agg(last).select(*keys, "r.*")


def cyclical_time(ts) -> dict[str, Column]:
    hour = F.hour(col(ts)) + F.minute(col(ts)) / 60.0
    day = F.weekday(col(ts)).cast("double")
    turn = F.lit(2 * math.pi)
    return {"hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24),
            "dow_sin": F.sin(turn * day / 7), "dow_cos": F.cos(turn * day / 7)}


def smooth_labels(df: DataFrame, label: str, out: str, min_bars: int = 6, keys=KEYS, chunk: int = CHUNK) -> DataFrame:
    """Hold a label until its own matches number ``min_bars``; then the next other label takes over.

    The rule is a finite automaton over (held label, matches up to ``min_bars``), so a chunk is
    summarised by the state it ends in for each of the states it can be entered with.
    """
    names, width = REGIMES, min_bars + 1
    states = len(names) * width
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)).cast("int") - 1
    code = F.when(place < 0, F.raise_error(F.concat(F.lit("unknown regime: "), F.col(label))).cast("int")).otherwise(place)

    def runs(codes):
        """Code and length of each stretch of equal codes."""
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
        return [(int(codes[a]), int(b - a)) for a, b in zip(cuts, cuts[1:])]

    def step(held, seen, x, n):
        """All states over a stretch of n equal codes: it matches, it takes over at its first row, or nothing happens."""
        same = held == x
        flip = ~same & (seen >= min_bars)
        return np.where(flip, x, held), np.where(same, np.minimum(seen + n, min_bars), np.where(flip, np.minimum(n, min_bars), seen))

    def summarise(v, first):
        codes = v["_code"]
        held, seen = np.divmod(np.arange(states), width)
        if first:
            held, seen, codes = np.full(states, codes[0]), np.zeros(states, int), codes[1:]
        for x, n in runs(codes) if len(codes) else []:
            held, seen = step(held, seen, x, n)
        return (held * width + seen).tolist()

    def advance(state, table):
        return table[0 if state is None else state]

    def compose(a, b):
        return [b[state] for state in a]

    def emit(v, state):
        codes, at = v["_code"], 0
        res = np.empty(len(codes), object)
        if state is None:
            held, seen, at = int(codes[0]), 0, 1
            res[0] = names[held]
        else:
            held, seen = divmod(state, width)
        for x, n in runs(codes[at:]) if at < len(codes) else []:
            if x == held:
                seen = min(seen + n, min_bars)
            elif seen >= min_bars:
                held, seen = x, min(n, min_bars)
            res[at:at + n] = names[held]
            at += n
        return res

    return chunk_fold(df.withColumn("_code", code), list(keys), ["_code"], summarise, advance, compose, emit, None, out, "string", chunk).drop("_code")
