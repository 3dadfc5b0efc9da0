"""Thresholds, classification scores and fold bookkeeping over tables of scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions.columns import div
from barflow.operators.ranking import ordered_counts, quantiles

# Percentile of each regime's own scores that becomes its threshold.
REGIME_PERCENTILES = {"trending": 0.70, "ranging": 0.75, "neutral": 0.78, "crisis": 1.00}


def label_distribution(df: DataFrame, label: str, keys, sell=0, hold=1, buy=2) -> DataFrame:
    n = F.count(F.lit(1))
    s, h, g = (F.count_if(F.col(label) == v) for v in (sell, hold, buy))
    return df.groupBy(*keys).agg(n.alias("rows"), s.alias("sell"), h.alias("hold"), g.alias("buy"), (s / n).alias("sell_share"),
                                 (h / n).alias("hold_share"), (g / n).alias("buy_share"),
                                 F.coalesce(div(g, s), F.lit(0.0)).alias("buy_sell_ratio"), ((s + g) / n * 100).alias("actionable_pct"))


def ts_folds(indexed: DataFrame, label: str, splits: int, gap: int, keys, min_pos: int = 5) -> DataFrame:
    """Expanding time folds: bounds, positives on both sides, and whether the fold is usable."""
    size = indexed.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("_n"))
    d = indexed.join(size, list(keys))
    step = F.floor(F.col("_n") / (splits + 1))
    i, pos = F.col("bar_idx"), F.col(label) == 1
    start = [F.col("_n") - (splits - k) * step for k in range(splits)]
    cells = []
    for k, s in enumerate(start):
        cells += [F.max(s - gap).alias(f"te_{k}"), F.max(s).alias(f"vs_{k}"), F.max(s + step).alias(f"ve_{k}"),
                  F.count_if(pos & (i < s - gap)).alias(f"tp_{k}"), F.count_if(pos & (i >= s) & (i < s + step)).alias(f"vp_{k}")]
    wide = d.groupBy(*keys).agg(*cells)
    names = {"train_end": "te", "val_start": "vs", "val_end": "ve", "train_pos": "tp", "val_pos": "vp"}
    rows = F.array(*[F.struct(F.lit(k).alias("fold"), *[F.col(f"{p}_{k}").alias(n) for n, p in names.items()]) for k in range(splits)])
    out = wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    return out.withColumn("usable", (F.col("train_pos") >= min_pos) & (F.col("val_pos") >= min_pos))


def oof_threshold(scores: DataFrame, keys, gain: float, loss: float, lo: float = 0.80, hi: float = 0.90) -> DataFrame:
    """Percentile threshold capped by a higher one, and the expected value at it."""
    q = quantiles(scores, "score", {"_lo": lo, "_hi": hi}, list(keys)).select(*keys, F.least("_lo", "_hi").alias("threshold"))
    above = F.col("score") >= F.col("threshold")
    # A row per key, sent to the scores: shuffled by key, all scores of a key would be sorted in one task.
    out = scores.join(F.broadcast(q), list(keys)).groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.count_if(above).alias("above"), F.avg(F.when(above, F.col("y").cast("double"))).alias("_wr"))
    wr = F.when(F.col("above") >= 20, F.col("_wr")).otherwise(0.0)
    return out.select(*keys, "threshold", "above", (wr * gain - (1 - wr) * loss).alias("ev"))


def ev_threshold(scores: DataFrame, keys, gain: float, loss: float, min_above: int = 20) -> DataFrame:
    """Scan percentiles 50..94 for the best expected value; a negative best falls back to P80."""
    keys = list(keys)
    pcts = list(range(50, 96, 2))
    q = quantiles(scores, "score", {f"q{p}": p / 100 for p in pcts}, keys)
    arr = q.select(*keys, F.array(*[F.col(f"q{p}") for p in pcts]).alias("_t"))
    passed = F.size(F.filter("_t", lambda t: t <= F.col("score")))
    # A row per key, sent to the scores: shuffled by key, all scores of a key would be sorted in one task.
    slots = scores.join(F.broadcast(arr), keys).groupBy(*keys, passed.alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("y").cast("double")).alias("_w"))
    # Rows at or above threshold j are those passing more than j thresholds: at most 24 slots per key.
    rows = arr.select(*keys, F.posexplode("_t").alias("_j", "threshold")).join(slots, keys).filter(F.col("_k") > F.col("_j"))
    per = rows.groupBy(*keys, "_j", "threshold").agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).filter(F.col("n") >= min_above)
    wr = F.col("w") / F.col("n")
    per = per.withColumn("ev", wr * gain - (1 - wr) * loss)
    best = per.groupBy(*keys).agg(F.max_by(F.struct("threshold", "ev"), F.struct("ev", -F.col("_j"))).alias("_b"))
    return best.join(q.select(*keys, F.col("q80").alias("_p80")), keys).select(
        *keys, F.when(F.col("_b.ev") < 0, F.col("_p80")).otherwise(F.col("_b.threshold")).alias("threshold"), F.col("_b.ev").alias("best_ev"))


def regime_threshold(scores: DataFrame, keys, min_rows: int = 100, floor: float = 0.05) -> DataFrame:
    keys = [*keys, "regime"]
    q = quantiles(scores, "score", {r: p for r, p in REGIME_PERCENTILES.items()}, keys)
    n = scores.groupBy(*keys).agg(F.count("score").alias("rows"))
    raw = F.coalesce(*[F.when(F.col("regime") == r, F.col(r)) for r in REGIME_PERCENTILES])
    return q.join(n, keys).filter(F.col("rows") >= min_rows).select(*keys, "rows", F.greatest(raw, F.lit(floor)).alias("threshold"))


def threshold_sweep(scores: DataFrame, keys, thresholds=(0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)) -> DataFrame:
    """Precision, recall and F1 of the positive class at fixed thresholds, in one aggregate."""
    pos = F.col("y") == 1
    wide = scores.groupBy(*keys).agg(F.count_if(pos).alias("_p"), *[e for k, t in enumerate(thresholds) for e in (
        F.count_if(F.col("score") >= t).alias(f"_n{k}"), F.count_if((F.col("score") >= t) & pos).alias(f"_t{k}"))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{k}").alias("n"), F.col(f"_t{k}").alias("tp")) for k, t in enumerate(thresholds)])
    d = wide.select(*keys, "_p", F.explode(rows).alias("_r")).select(*keys, "_p", "_r.*")
    zero = F.lit(0.0)
    p, r = F.coalesce(div("tp", "n"), zero), F.coalesce(div("tp", "_p"), zero)
    return d.select(*keys, "threshold", p.alias("precision"), r.alias("recall"), F.coalesce(div(2 * p * r, p + r), zero).alias("f1"))


def proba_stats(scores: DataFrame, keys) -> DataFrame:
    q = quantiles(scores, "score", {"p50": 0.5, "p80": 0.8, "p95": 0.95}, list(keys))
    s = scores.groupBy(*keys).agg(F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return s.join(q, list(keys)) if keys else s.withColumn("_q", F.struct(*[q.select(c).scalar().alias(c) for c in ("p50", "p80", "p95")])).select("min", "max", "mean", "std", "_q.*")


def scorecard(df: DataFrame, truth: str, pred: str, keys) -> DataFrame:
    """Macro F1 (absent classes score 0), accuracy and correct-to-incorrect ratio from the confusion counts.

    The running count of correct predictions never falls, so its drawdown is 0 for any input.
    """
    cells = df.groupBy(*keys, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(0)
    sides = cells.select(*keys, "_n", hit.alias("_h"), F.explode(F.array(
        F.struct(F.col("_t").alias("c"), F.lit(1).alias("is_t")), F.struct(F.col("_p").alias("c"), F.lit(0).alias("is_t")))).alias("_s"))
    per = sides.groupBy(*keys, F.col("_s.c").alias("_c")).agg(
        F.sum(F.when(F.col("_s.is_t") == 1, F.col("_n")).otherwise(0)).alias("_true"), F.sum(F.when(F.col("_s.is_t") == 0, F.col("_n")).otherwise(0)).alias("_pred"),
        F.sum(F.when(F.col("_s.is_t") == 1, F.col("_h")).otherwise(0)).alias("_tp"))
    f1 = F.coalesce(div(2 * F.col("_tp"), F.col("_true") + F.col("_pred")), F.lit(0.0))
    n, ok = F.sum("_true"), F.sum("_tp")
    return per.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), (ok / n).alias("accuracy"), (ok / F.greatest(n - ok, F.lit(1))).alias("profit_factor"),
                                  F.lit(0.0).alias("max_drawdown"))


def upgrade_gate(old: DataFrame, new: DataFrame, keys, margin: float = 0.0, tol=(0.02, 0.05, 0.02)) -> DataFrame:
    names = ["macro_f1", "accuracy", "profit_factor", "max_drawdown"]
    both = old.select(*keys, *[F.col(n).alias(f"old_{n}") for n in names]).join(new.select(*keys, *[F.col(n).alias(f"new_{n}") for n in names]), list(keys))
    c = F.col
    f1 = c("new_macro_f1") >= c("old_macro_f1") + margin
    rest = ((c("new_accuracy") + tol[0] >= c("old_accuracy")) & (c("new_profit_factor") + tol[1] >= c("old_profit_factor"))
            & (c("new_max_drawdown") <= c("old_max_drawdown") + tol[2]))
    return both.select(*keys, c("old_macro_f1").alias("old_f1"), c("new_macro_f1").alias("new_f1"), f1.alias("f1_ok"), (f1 & rest).alias("accepted"),
                       F.when(~f1, "f1_gate").when(~rest, "scorecard_gate").alias("rejected_reason"))


def rank_metrics(scores: DataFrame, keys) -> DataFrame:
    """ROC-AUC by ranks (ties count half), average precision, and Pearson correlation."""
    keys = list(keys)
    c = ordered_counts(scores, "score", keys, {"pos": F.col("y").cast("int")})
    pos, neg, neg_before = F.col("pos"), F.col("n") - F.col("pos"), F.col("before") - F.col("pos_before")
    p, n = F.col("pos_total"), F.col("total") - F.col("pos_total")
    ap = div(pos, p) * div(p - F.col("pos_before"), F.col("total") - F.col("before"))
    m = c.groupBy(*keys).agg(div(F.sum(pos * (neg_before + neg / 2)), F.max(p * n)).alias("auc"), F.sum(ap).alias("average_precision"))
    r = scores.groupBy(*keys).agg(F.corr("score", F.col("y").cast("double")).alias("pearson"))
    return m.join(r, keys)


def walkforward_summary(folds: DataFrame, keys=()) -> DataFrame:
    return folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.avg("total_return").alias("mean_return"), F.avg("sharpe").alias("mean_sharpe"),
                                    (F.avg((F.col("total_return") > 0).cast("double")) * 100).alias("profitable_pct"))


def recommended_threshold(df: DataFrame, keys, lo: float = 0.46, hi: float = 0.80) -> DataFrame:
    q = quantiles(df, "recommended", {"_m": 0.5}, list(keys))
    return q.select(*keys, F.least(F.greatest("_m", F.lit(lo)), F.lit(hi)).alias("threshold"))


def reliability_table(df: DataFrame, score: str, outcome: str, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean score beside the observed rate in bins of equal rank; equal scores share the bin of their first rank."""
    c = ordered_counts(df.filter(F.col(outcome).isNotNull()), score, keys, {"hits": F.col(outcome).cast("int")})
    c = c.withColumn("bin", F.floor(F.col("before") * bins / F.col("total")).cast("int"))
    n = F.sum("n")
    return c.groupBy(*keys, "bin").agg(n.alias("rows"), (F.sum(F.col("value") * F.col("n")) / n).alias("mean_score"), (F.sum("hits") / n).alias("observed_rate"))
