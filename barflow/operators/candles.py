"""Candlestick patterns: geometry, then one boolean expression per pattern over lagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import clip, flag
from barflow.functions.names import b
from barflow.operators.series import KEYS, Roll, framed, running

# Pattern weights of the two scores.
BULL_WEIGHTS = {
    "cdl_hammer": 0.8, "cdl_dragonfly_doji": 0.6, "cdl_bull_engulfing": 0.95, "cdl_bull_harami": 0.6,
    "cdl_piercing": 0.75, "cdl_morning_star": 0.9, "cdl_three_white_soldiers": 0.85, "cdl_bull_marubozu": 0.7,
    "cdl_tweezer_bottom": 0.65, "cdl_three_inside_up": 0.7, "cdl_abandoned_baby_bull": 0.95,
    "cdl_bull_kicker": 0.9, "cdl_inv_hammer": 0.5,
}
BEAR_WEIGHTS = {
    "cdl_shooting_star": 0.8, "cdl_gravestone_doji": 0.6, "cdl_bear_engulfing": 0.95, "cdl_bear_harami": 0.6,
    "cdl_dark_cloud": 0.75, "cdl_evening_star": 0.9, "cdl_three_black_crows": 0.85, "cdl_bear_marubozu": 0.7,
    "cdl_tweezer_top": 0.65, "cdl_three_inside_down": 0.7, "cdl_abandoned_baby_bear": 0.95,
    "cdl_bear_kicker": 0.9, "cdl_hanging_man": 0.7,
}

SINGLE = [
    "doji", "long_legged_doji", "dragonfly_doji", "gravestone_doji", "hammer",
    "inv_hammer", "hanging_man", "shooting_star", "bull_marubozu", "bear_marubozu",
    "spinning_top",
]
DOUBLE = [
    "bull_engulfing", "bear_engulfing", "bull_harami", "bear_harami", "piercing",
    "dark_cloud", "tweezer_top", "tweezer_bottom", "bull_kicker", "bear_kicker",
]
TRIPLE = [
    "morning_star", "evening_star", "three_white_soldiers", "three_black_crows", "three_inside_up",
    "three_inside_down", "abandoned_baby_bull", "abandoned_baby_bear",
]
SCORES = ["bull_score", "bear_score", "net_score", "reversal_signal", "indecision_score"]


def geometry(d: DataFrame) -> DataFrame:
    rng = F.greatest(b.H - b.L, F.lit(1e-10))
    up, down = b.H - F.greatest(b.O, b.C), F.least(b.O, b.C) - b.L
    return d.withColumns({"_body": F.abs(b.C - b.O), "_up": up, "_down": down, "_br": F.abs(b.C - b.O) / rng,
                          "_ur": up / rng, "_lr": down / rng, "_bull": b.C >= b.O})


def _typical_move(avg: Column) -> Column:
    return F.when(avg > 0, avg).otherwise(b.C * 0.01)


def single(r: Roll) -> dict[str, Column]:
    small = b.BR < 0.10
    hammer = (b.DOWN >= 2 * b.BODY) & (b.UR < 0.20) & (b.BR > 0.05)
    inverted = (b.UP >= 2 * b.BODY) & (b.LR < 0.20) & (b.BR > 0.05)
    move = _typical_move(r.mean("_move", 14))
    return {
        "doji": small & (b.H - b.L > 0), "long_legged_doji": small & (b.UR > 0.30) & (b.LR > 0.30),
        "dragonfly_doji": small & (b.UR < 0.05) & (b.LR > 0.60), "gravestone_doji": small & (b.LR < 0.05) & (b.UR > 0.60),
        "hammer": hammer & (b.H - b.L > move * 0.5), "inv_hammer": inverted, "hanging_man": hammer,
        "shooting_star": inverted & ~b.BULL, "bull_marubozu": b.BULL & (b.BR > 0.95), "bear_marubozu": ~b.BULL & (b.BR > 0.95),
        "spinning_top": (b.BR > 0.10) & (b.BR < 0.40) & (b.UR > 0.20) & (b.LR > 0.20),
    }


def double(r: Roll) -> dict[str, Column]:
    po, ph, pl, pc = (r.lag(x) for x in (b.O, b.H, b.L, b.C))
    pbull, pbody = r.lag(b.BULL), r.lag(b.BODY)
    up, down = ~pbull & b.BULL, pbull & ~b.BULL
    mid = (po + pc) / 2
    move = _typical_move(r.mean("_move", 13, 1, 1)) * 0.1
    return {
        "bull_engulfing": up & (b.O <= pc) & (b.C >= po), "bear_engulfing": down & (b.O >= pc) & (b.C <= po),
        "bull_harami": up & (b.BODY < pbody * 0.5) & (b.O > pc) & (b.C < po),
        "bear_harami": down & (b.BODY < pbody * 0.5) & (b.O < pc) & (b.C > po),
        "piercing": up & (b.O < pc) & (b.C > mid), "dark_cloud": down & (b.O > pc) & (b.C < mid),
        "tweezer_top": ~b.BULL & (F.abs(b.H - ph) < move), "tweezer_bottom": b.BULL & (F.abs(b.L - pl) < move),
        "bull_kicker": up & (b.O > po) & (b.BR > 0.5), "bear_kicker": down & (b.O < po) & (b.BR > 0.5),
    }


def triple(r: Roll) -> dict[str, Column]:
    two = {n: r.lag(x, 2) for n, x in (("o", b.O), ("h", b.H), ("l", b.L), ("c", b.C), ("br", b.BR), ("body", b.BODY), ("bull", b.BULL))}
    one = {n: r.lag(x, 1) for n, x in (("h", b.H), ("l", b.L), ("c", b.C), ("br", b.BR), ("body", b.BODY), ("bull", b.BULL))}
    mid = (two["o"] + two["c"]) / 2
    star = (two["br"] > 0.4) & (one["br"] < 0.3)
    strong = (two["br"] > 0.5) & (one["br"] > 0.5) & (b.BR > 0.5)
    return {
        "morning_star": ~two["bull"] & star & b.BULL & (b.C > mid), "evening_star": two["bull"] & star & ~b.BULL & (b.C < mid),
        "three_white_soldiers": two["bull"] & one["bull"] & b.BULL & (b.C > one["c"]) & (one["c"] > two["c"]) & strong,
        "three_black_crows": ~two["bull"] & ~one["bull"] & ~b.BULL & (b.C < one["c"]) & (one["c"] < two["c"]) & strong,
        "three_inside_up": ~two["bull"] & one["bull"] & b.BULL & (one["body"] < two["body"]) & (b.C > one["c"]),
        "three_inside_down": two["bull"] & ~one["bull"] & ~b.BULL & (one["body"] < two["body"]) & (b.C < one["c"]),
        "abandoned_baby_bull": ~two["bull"] & (one["br"] < 0.10) & b.BULL & (one["l"] < two["l"]) & (b.L > one["h"]),
        "abandoned_baby_bear": two["bull"] & (one["br"] < 0.10) & ~b.BULL & (one["h"] > two["h"]) & (b.H < one["l"]),
    }


def scores() -> dict[str, Column]:
    def weighted(weights):
        return clip(sum(F.col(n) * w for n, w in weights.items()) / F.lit(sum(weights.values())), 0.0, 1.0)

    bull, bear = weighted(BULL_WEIGHTS), weighted(BEAR_WEIGHTS)
    doubt = F.col("cdl_doji") * 0.6 + F.col("cdl_long_legged_doji") * 0.8 + F.col("cdl_spinning_top") * 0.4
    return {"cdl_bull_score": bull, "cdl_bear_score": bear, "cdl_net_score": bull - bear,
            "cdl_reversal_signal": clip(bull - bear, -1.0, 1.0), "cdl_indecision_score": clip(doubt, 0.0, 1.0)}


def candlestick_patterns(indexed: DataFrame, keys=KEYS) -> DataFrame:
    """All 39 outputs: one framed pass of reach 16, plus one running pass for the two streaks."""

    def build(d, r):
        d = geometry(d).withColumn("_move", F.abs(r.diff(b.C)))
        found = {**single(r), **double(r), **triple(r)}
        d = d.withColumns({f"cdl_{n}": flag(e) for n, e in found.items()})
        return d.withColumns({**scores(), "cdl_body_ratio": b.BR, "cdl_upper_wick_ratio": b.UR, "cdl_lower_wick_ratio": b.LR})

    d = framed(indexed, build, before=16, keys=keys)
    i = F.col("bar_idx")
    d = running(d, {"_lb": ("max", F.when(~b.BULL, i)), "_lg": ("max", F.when(b.BULL, i))}, keys)
    return d.withColumns({"cdl_consecutive_bull": i - F.coalesce("_lb", F.lit(-1)),
                          "cdl_consecutive_bear": i - F.coalesce("_lg", F.lit(-1))})
