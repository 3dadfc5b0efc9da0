"""Feature statistics, drift tests and pruning. Features are compared as (key, feature, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.functions.columns import clip, div, pick
from barflow.operators.ranking import long_form, ordered_counts, quantiles

PATTERN_PREFIXES = ("cdl_", "chp_", "sr_", "tl_", "bo_")


def _unpivot(wide: DataFrame, features: list[str], parts: dict[str, str], keys) -> DataFrame:
    """Wide aggregates ``{part}{feature}`` to one row per feature."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{p}{f}").alias(n) for n, p in parts.items()]) for f in features])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def feature_stats(df: DataFrame, features: list[str], keys=()) -> DataFrame:
    """Mean and sample deviation per feature in one aggregate."""
    wide = df.groupBy(*keys).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_samp(f).alias(f"_s_{f}") for f in features])
    return _unpivot(wide, features, {"mean": "_m_", "std": "_s_"}, keys)


def feature_medians(df: DataFrame, features: list[str], keys=()) -> DataFrame:
    return quantiles(long_form(df, features, list(keys)), "value", {"median": 0.5}, [*keys, "feature"])


def sigma_drift(df: DataFrame, features: list[str], stats: DataFrame, ids: list[str], sigma: float = 4.0, keys=()) -> DataFrame:
    """Values further than ``sigma`` deviations from the training mean."""
    rows = long_form(df, features, [*ids, *keys]).join(stats, [*keys, "feature"])
    rows = rows.filter(F.col("std") >= 1e-12).withColumn("z", F.abs((F.col("value") - F.col("mean")) / F.col("std")))
    return rows.filter(F.col("z") > sigma)


def activation_rate(df: DataFrame, features: list[str], keys=()) -> DataFrame:
    """Share of rows above 0.5 for pattern features."""
    features = [f for f in features if f.startswith(PATTERN_PREFIXES)]
    wide = df.groupBy(*keys).agg(*[F.avg(F.when(F.col(f) > 0.5, 1.0).otherwise(0.0)).alias(f"_a_{f}") for f in features])
    return _unpivot(wide, features, {"rate": "_a_"}, keys)


def activation_drift(live: DataFrame, train: DataFrame, limit: float = 0.15, keys=()) -> DataFrame:
    both = live.withColumnRenamed("rate", "live_rate").join(train.withColumnRenamed("rate", "train_rate"), [*keys, "feature"])
    return both.filter(F.abs(F.col("live_rate") - F.col("train_rate")) > limit)


def kolmogorov(stat: Column, n: Column, m: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    lam2 = stat * stat * n * m / (n + m)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(lam2 < 1e-3, 1.0).otherwise(clip(series, 0.0, 1.0))


def ks_test(rows: DataFrame, keys: list[str], recent: str = "recent", min_rows: int = 50) -> DataFrame:
    """Two-sample KS per key; rows hold ``value`` and the boolean ``recent``."""
    c = ordered_counts(rows, "value", keys, {"b": F.col(recent).cast("int")})
    na, nb = F.col("total") - F.col("b_total"), F.col("b_total")
    fa = div(F.col("before") + F.col("n") - F.col("b_before") - F.col("b"), na)
    fb = div(F.col("b_before") + F.col("b"), nb)
    out = c.groupBy(*keys).agg(F.max(F.abs(fa - fb)).alias("stat"), F.max(na).alias("n_past"), F.max(nb).alias("n_recent"))
    out = out.filter((F.col("n_past") >= min_rows) & (F.col("n_recent") >= min_rows))
    return out.withColumn("p", kolmogorov(F.col("stat"), F.col("n_past").cast("double"), F.col("n_recent").cast("double")))


def ks_drift(rows: DataFrame, keys: list[str], alpha: float = 0.01, stat: float = 0.10, min_rows: int = 50) -> DataFrame:
    return ks_test(rows, keys, min_rows=min_rows).filter((F.col("p") < alpha) & (F.col("stat") > stat))


def psi(rows: DataFrame, keys: list[str], recent: str = "recent", floor: float = 1e-6, widen: float = 0.0,
        min_rows: int = 50, bins: int = 10) -> DataFrame:
    """Population stability index over the deciles of the past.

    ``floor`` is the least share of a bin; ``widen`` moves the outer edges out. Values outside the edges
    are not counted. Bins empty on both sides add nothing, so only occupied ones are aggregated.
    """
    past = rows.filter(~F.col(recent))
    probs = {f"_q{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(past, "value", probs, keys)
    arr = F.array_distinct(F.array(F.col("_q0") - widen, *[F.col(f"_q{i}") for i in range(1, bins)], F.col(f"_q{bins}") + widen))
    edges = edges.select(*keys, arr.alias("_edges"))
    x, e = F.col("value"), F.col("_edges")
    slot = F.least(F.size(F.filter(e, lambda v: v <= x)), F.size(e) - 1)
    placed = rows.filter(x.isNotNull()).join(edges, keys).withColumn("_bin", slot)
    sizes = placed.groupBy(*keys, "_bin").agg(
        F.count_if(~F.col(recent)).alias("_a"), F.count_if(F.col(recent)).alias("_b"),
        F.count_if(~F.col(recent) & (x >= e[0]) & (x <= F.element_at(e, -1))).alias("_e"),
        F.count_if(F.col(recent) & (x >= e[0]) & (x <= F.element_at(e, -1))).alias("_r"), F.first(F.size(e)).alias("_k"))
    w = Window.partitionBy(*keys)
    pe = F.greatest(div("_e", F.sum("_e").over(w)), F.lit(floor))
    pr = F.greatest(F.coalesce(div("_r", F.sum("_r").over(w)), F.lit(0.0)), F.lit(floor))
    sizes = sizes.withColumns({"_pe": F.coalesce(pe, F.lit(floor)), "_pr": pr})
    term = F.when((F.col("_e") > 0) | (F.col("_r") > 0), (F.col("_pr") - F.col("_pe")) * F.log(F.col("_pr") / F.col("_pe"))).otherwise(0.0)
    out = sizes.groupBy(*keys).agg(F.sum(term).alias("psi"), F.sum("_a").alias("n_past"), F.sum("_b").alias("n_recent"), F.max("_k").alias("_k"))
    out = out.filter((F.col("n_past") >= min_rows) & (F.col("n_recent") >= min_rows))
    return out.withColumn("psi", F.when(F.col("_k") >= 3, F.col("psi")).otherwise(0.0)).drop("_k")


def windows_from_end(indexed: DataFrame, past: int, recent: int, keys) -> DataFrame:
    """The last ``recent`` rows of each series and the ``past`` rows before them, marked ``recent``."""
    size = indexed.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("_n"))
    back = F.col("_n") - F.col("bar_idx")
    return (indexed.join(size, list(keys)).filter((back <= past + recent) & (F.col("_n") >= past + recent))
            .withColumn("recent", back <= recent).drop("_n"))


def short_series(rows: DataFrame, needed: int, keys) -> DataFrame:
    """Series with fewer rows than both windows take, which therefore have no result."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < needed).select(*keys, F.lit("too_short").alias("state"))


def drift_limits(df: DataFrame, keys, ks: float = 0.10, psi_limit: float = 0.20, count: int = 5) -> DataFrame:
    """Limits scaled by the newest volatility regime over its median, between 0.5 and 3."""
    now = df.groupBy(*keys).agg(F.max_by("vol_regime", "bar_idx").alias("_now"))
    mid = quantiles(df, "vol_regime", {"_mid": 0.5}, list(keys))
    ratio = clip(F.col("_now") / (F.col("_mid") + 1e-9), 0.5, 3.0)
    return now.join(mid, list(keys)).select(*keys, (ratio * ks).alias("ks_limit"), (ratio * psi_limit).alias("psi_limit"),
                                            F.greatest(F.lit(2), F.floor(ratio * count)).alias("count_limit"))


def drift_decision(ks: DataFrame, psi_rows: DataFrame, guard: DataFrame, keys, limit: int, metric: str = "either",
                   max_nulls: float = 0.15) -> DataFrame:
    """Counts of drifted features against ``limit``; skipped where the recent window is too sparse."""
    a = ks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ks"))
    p = psi_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_psi"))
    d = guard.join(a, list(keys), "left").join(p, list(keys), "left")
    nk, np_ = F.coalesce("_ks", F.lit(0)), F.coalesce("_psi", F.lit(0))
    fired = {"ks": nk > limit, "psi": np_ > limit, "both": (nk > limit) & (np_ > limit), "either": (nk > limit) | (np_ > limit)}[metric]
    action = pick((F.col("null_ratio") > max_nulls, F.lit("skip_sparse")), (fired, F.lit("retrain")), default=F.lit("skip"))
    return d.select(*keys, "null_ratio", nk.alias("ks_count"), np_.alias("psi_count"), action.alias("action"))


def null_ratio(df: DataFrame, features: list[str], keys) -> DataFrame:
    """Mean over features of the share of NULL rows."""
    parts = [F.avg(F.col(f).isNull().cast("double")) for f in features]
    return df.groupBy(*keys).agg((sum(parts[1:], parts[0]) / len(parts)).alias("null_ratio"))


def sanitize(df: DataFrame, features: list[str], keys=(), max_nulls: float = 0.30) -> DataFrame:
    """Which features to keep: not constant, and under 30 % NULL."""
    wide = df.groupBy(*keys).agg(*[e for f in features for e in (
        F.coalesce(F.min(f) != F.max(f), F.lit(False)).alias(f"_v_{f}"), F.avg(F.col(f).isNull().cast("double")).alias(f"_n_{f}"))])
    out = _unpivot(wide, features, {"varies": "_v_", "null_share": "_n_"}, keys)
    return out.withColumn("keep", F.col("varies") & (F.col("null_share") < max_nulls))


def correlation_prune(df: DataFrame, features: list[str], threshold: float, keys=()) -> DataFrame:
    """A feature is dropped if any earlier one correlates above ``threshold``; all pairs in one aggregate."""
    pairs = [(a, c) for j, c in enumerate(features) for a in features[:j]]
    wide = df.groupBy(*keys).agg(*[F.abs(F.corr(a, c)).alias(f"_c_{a}_{c}") for a, c in pairs])

    def worst(c, j):
        cells = [F.col(f"_c_{a}_{c}") for a in features[:j]]
        return F.lit(None).cast("double") if not cells else cells[0] if len(cells) == 1 else F.greatest(*cells)

    rows = F.array(*[F.struct(F.lit(c).alias("feature"), worst(c, j).alias("max_corr")) for j, c in enumerate(features)])
    out = wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    return out.withColumn("dropped", F.coalesce(F.col("max_corr") > threshold, F.lit(False)))


def feature_stability(indexed: DataFrame, features: list[str], label: str, keys, chunks: int = 3, limit: float = 0.08,
                      min_rows: int = 200, min_kept: int = 5) -> DataFrame:
    """Population deviation over chunks of |corr(feature, label)|; too few stable ones keeps all."""
    size = indexed.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("_n"))
    base, extra = F.floor(F.col("_n") / chunks), F.col("_n") % chunks
    i = F.col("bar_idx")
    chunk = F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / base))
    d = indexed.join(size, list(keys)).withColumn("_ch", chunk)
    per = d.groupBy(*keys, "_ch").agg(F.count(F.lit(1)).alias("_rows"), *[F.abs(F.corr(f, label)).alias(f"_c_{f}") for f in features])
    rows = _unpivot(per.filter(F.col("_rows") >= min_rows), features, {"score": "_c_"}, [*keys, "_ch"])
    good = F.col("score").isNotNull() & ~F.isnan("score")
    out = rows.groupBy(*keys, "feature").agg(F.count_if(good).alias("scores"), F.stddev_pop(F.when(good, F.col("score"))).alias("spread"))
    out = out.withColumn("stable", (F.col("scores") >= 2) & (F.col("spread") <= limit))
    kept = F.count_if("stable").over(Window.partitionBy(*keys))
    return out.withColumn("keep", F.col("stable") | (kept < min_kept))


def retrain_window(indexed: DataFrame, anchor: int, rolling: int, recent: int, keys) -> DataFrame:
    """First ``anchor`` rows plus up to ``rolling`` rows before the ``recent`` ones."""
    size = indexed.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("_n"))
    i, n = F.col("bar_idx"), F.col("_n")
    part = pick((i < anchor, F.lit("anchor")), ((i >= n - recent - rolling) & (i < n - recent), F.lit("rolling")))
    return (indexed.join(size, list(keys)).filter(n > anchor + recent).withColumn("part", part)
            .filter(F.col("part").isNotNull()).drop("_n"))
