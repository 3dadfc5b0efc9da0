"""The older feature set: short-history defaults, population deviations, last-value ADX."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import div
from barflow.functions.names import b
from barflow.operators import indicators as I
from barflow.operators.series import KEYS, framed, scan

def legacy_features(bars: DataFrame, keys=KEYS) -> DataFrame:
    """Indexed bars to the older features of every bar; a feature short of history has its default."""
    d = framed(bars, lambda x, r: I.flows(I.base(x, r)), before=1, keys=keys)
    d = d.withColumn("_obv0", F.when(F.col("bar_idx") == 0, b.V).otherwise(F.col("_obv")))
    d = scan(d, [*I.CLOSE_EMAS, I.total("obv", "_obv0"), I.total("_adl", "_ad")], keys)
    n = F.col("bar_idx") + 1

    def held(rows, value, default):
        return F.coalesce(F.when(n >= rows, value), F.lit(default) if not hasattr(default, "alias") else default)

    def build(x, r):
        live = F.col("bar_idx") > 0
        gain, loss = (r.mean(F.when(live, F.col(c)), 14, 1) for c in ("_gain", "_loss"))
        mid, sd = r.mean(b.C, 20, 1), r._agg(F.stddev_pop, b.C, 20, 1)
        st, ar = I.stochastic(r), I.aroon(r)
        p, m = r.mean("_pdm", 14, 1), r.mean("_mdm", 14, 1)
        rsi = F.when(F.coalesce(loss, F.lit(0.0)) == 0, 100.0).otherwise(100 - div(100.0, 1 + div(gain, loss)))
        return x.withColumns({
            "rsi_14": rsi, "bb_upper": held(20, mid + 2 * sd, b.C), "bb_lower": held(20, mid - 2 * sd, b.C),
            "volatility": held(20, r._agg(F.stddev_pop, "_ret", 19, 1) * 100, 0.0),
            "stochastic_k_14": held(14, st["stochastic_k_14"], 50.0), "williams_r_14": held(14, st["williams_r_14"], -50.0),
            "cci_20": held(20, I.cci(r)["cci_20"], 0.0), "aroon_up": held(14, ar["aroon_up"], 50.0),
            "aroon_down": held(14, ar["aroon_down"], 50.0), "atr_14": held(15, r.mean("_tr", 14, 1), 0.0),
            "adx_14": held(15, div(100 * F.abs(p - m), p + m), 0.0),
            "chaikin_oscillator": held(10, r.mean("_adl", 3, 1, 7) - r.mean("_adl", 10, 1), 0.0),
            "log_returns": F.coalesce(F.when(F.col("_pc") > 0, F.log(div(b.C, "_pc")) * 100), F.lit(0.0)),
            "returns_1": F.coalesce(F.when(F.col("_pc") > 0, div(b.C - F.col("_pc"), "_pc") * 100), F.lit(0.0)),
            "volume_change_pct": F.coalesce(div(r.diff(b.V), r.lag(b.V)) * 100, F.lit(0.0)),
            "high_low_ratio": F.when(b.L > 0, div(b.H, b.L)).otherwise(1.0)})

    d = framed(d, build, before=32, keys=keys)
    macd = I.macd_columns()
    return d.withColumns({"macd": held(26, macd["macd"], 0.0), "macd_signal": held(26, macd["macd_signal"], 0.0)})
