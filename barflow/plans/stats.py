"""Registered statistics, drift and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.columns import rounded
from barflow.functions.names import b
from barflow.operators import candles as K
from barflow.operators import drift as R
from barflow.operators import evaluation as E
from barflow.operators import indicators as I
from barflow.operators import quality as Q
from barflow.operators import ranking as N
from barflow.operators import series as S
from barflow.plans import domain as D

from barflow.plans.registry import cte, query
from barflow.session import stage

KEYS = ["symbol", "timeframe"]
FEATS = ["ret", "rng", "vol", "body", "c2"]


def feats(spark, sf):
    d = I.with_base(D.indexed(spark, sf))
    hurt = F.when(b.I % 11 != 3, b.C - b.O)
    lead = S.framed(d, lambda x, r: x.withColumn("label", F.coalesce((F.try_divide(r.lead("close", 6), b.C) > 1.2).cast("int"), F.lit(0))), after=6)
    return lead.select(*KEYS, "bar_ts", "bar_idx", F.col("_ret").alias("ret"), (b.H - b.L).alias("rng"), b.V.alias("vol"), hurt.alias("body"),
                       (b.H + b.L).alias("c2"), "label")


cte("ft", """SELECT symbol, bar_ts, i, n_, ret, high - low AS rng, volume AS vol, CASE WHEN i % 11 <> 3 THEN close - open END AS body, high + low AS c2, label FROM
  (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_, coalesce((lead(close, 6) OVER (PARTITION BY symbol ORDER BY i) / nullif(close, 0) > 1.2::DOUBLE)::INT, 0) AS label FROM x)""", ("x",))
cte("fl", "SELECT symbol, bar_ts, i, n_, label, unnest(['ret', 'rng', 'vol', 'body', 'c2']) AS feature, unnest([ret, rng, vol, body, c2]) AS value FROM ft", ("ft",))
cte("fw", "SELECT *, n_ - i <= 500 AS recent FROM fl WHERE n_ - i <= 1000 AND n_ >= 1000", ("fl",))


def windows(spark, sf):
    d = R.windows_from_end(feats(spark, sf), 500, 500, KEYS)
    return stage(d)


def with_short(out, spark, sf):
    """Results as state ok, and a row for every series that is shorter than both windows."""
    return out.withColumn("state", F.lit("ok")).unionByName(R.short_series(D.bars(spark, sf), 1000, ["symbol"]), allowMissingColumns=True)


def short_sql(nulls: str) -> str:
    return f" UNION ALL SELECT symbol, {nulls}, 'too_short' FROM b GROUP BY symbol HAVING count(*) < 1000"


def long_windows(d):
    return N.long_form(d, FEATS, [*KEYS, "recent"])


@query("feature_stats", "SELECT symbol, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM fl GROUP BY ALL", ("fl",))
def feature_stats(spark, sf):
    return rounded(R.feature_stats(feats(spark, sf), FEATS, KEYS).drop("timeframe"))


@query("feature_median", "SELECT symbol, feature, round(quantile_cont(value, .5), 6) AS median FROM fl GROUP BY ALL", ("fl",))
def feature_median(spark, sf):
    return rounded(R.feature_medians(feats(spark, sf), FEATS, KEYS).drop("timeframe"))


@query("sigma_drift", """SELECT symbol, bar_ts, feature, round(value, 6) AS value, round(abs((value - m) / s), 5) AS z FROM fl JOIN
  (SELECT symbol, feature, avg(value) AS m, stddev_samp(value) AS s FROM fl GROUP BY ALL) USING (symbol, feature)
  WHERE s >= 1e-12 AND abs((value - m) / s) > 4""", ("fl",))
def sigma_drift(spark, sf):
    d = stage(feats(spark, sf))
    out = R.sigma_drift(d, FEATS, R.feature_stats(d, FEATS, KEYS), ["bar_ts"], 4.0, KEYS)
    return rounded(out.select("symbol", "bar_ts", "feature", "value", "z"), 6, {"z": 5})


CDL = [f"cdl_{n}" for n in (*K.SINGLE, *K.DOUBLE, *K.TRIPLE)]


@query("activation_rate", "SELECT symbol, feature, round(avg(CASE WHEN v > .5 THEN 1.0 ELSE 0 END::DOUBLE), 9) AS rate FROM (SELECT symbol, unnest(["
       + ", ".join(f"'{c}'" for c in CDL) + "]) AS feature, unnest([" + ", ".join(CDL) + "]) AS v FROM k3) GROUP BY ALL", ("k3",))
def activation_rate(spark, sf):
    return rounded(R.activation_rate(K.candlestick_patterns(D.indexed(spark, sf)), CDL, ["symbol"]), 9)


cte("act", "SELECT feature, avg(CASE WHEN v > .5 THEN 1.0 ELSE 0 END::DOUBLE) FILTER (symbol = 'click') AS live_rate, avg(CASE WHEN v > .5 THEN 1.0 ELSE 0 END::DOUBLE) FILTER (bar_ts < TIMESTAMP '2024-01-02') AS train_rate FROM (SELECT symbol, bar_ts, unnest(["
    + ", ".join(f"'{c}'" for c in CDL) + "]) AS feature, unnest([" + ", ".join(CDL) + "]) AS v FROM k3) GROUP BY ALL", ("k3",))


@query("activation_drift", "SELECT feature, round(live_rate, 9) AS live_rate, round(train_rate, 9) AS train_rate FROM act WHERE abs(live_rate - train_rate) > .02", ("act",))
def activation_drift(spark, sf):
    d = stage(K.candlestick_patterns(D.indexed(spark, sf)).select("symbol", "bar_ts", *CDL))
    train = d.filter(F.col("bar_ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    return rounded(R.activation_drift(R.activation_rate(d.filter("symbol = 'click'"), CDL), R.activation_rate(train, CDL), 0.02), 9)


cte("ksd", """SELECT symbol, feature, max(abs(fa - fb)) AS stat, max(na) AS n_past, max(nb) AS n_recent FROM (SELECT symbol, feature,
  sum(a) OVER w / max(ta) OVER (PARTITION BY symbol, feature) AS fa, sum(r) OVER w / max(tb) OVER (PARTITION BY symbol, feature) AS fb, ta AS na, tb AS nb FROM
  (SELECT symbol, feature, value, CAST(count(*) FILTER (NOT recent) AS DOUBLE) AS a, CAST(count(*) FILTER (recent) AS DOUBLE) AS r,
   sum(count(*) FILTER (NOT recent)) OVER (PARTITION BY symbol, feature) AS ta, sum(count(*) FILTER (recent)) OVER (PARTITION BY symbol, feature) AS tb
   FROM fw WHERE value IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY symbol, feature ORDER BY value)) GROUP BY ALL""", ("fw",))
cte("ksp", """SELECT *, CASE WHEN l2 < 1e-3 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 41), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * l2))), 0), 1) END AS p
  FROM (SELECT symbol, feature, stat, CAST(n_past AS BIGINT) AS n_past, CAST(n_recent AS BIGINT) AS n_recent, stat * stat * n_past::DOUBLE * n_recent::DOUBLE / (n_past::DOUBLE + n_recent::DOUBLE) AS l2 FROM ksd)""", ("ksd",))


@query("ks_drift", "SELECT symbol, feature, round(stat, 9) AS stat, round(p, 9) AS p, n_past, n_recent, p < .05 AND stat > .05 AS drifted, 'ok' AS state FROM ksp" + short_sql("NULL, NULL, NULL, NULL, NULL, NULL"), ("ksp", "b"))
def ks_drift(spark, sf):
    out = R.ks_test(long_windows(windows(spark, sf)), [*KEYS, "feature"])
    return with_short(rounded(out.withColumn("drifted", (F.col("p") < 0.05) & (F.col("stat") > 0.05)).drop("timeframe"), 9), spark, sf)


def psi_sql(floor, widen, tail):
    q = ", ".join(f"quantile_cont(value, {i / 10})" + (f" - {widen}" if i == 0 else f" + {widen}" if i == 10 else "") for i in range(11))
    return f"""SELECT symbol, feature, sum(CASE WHEN e > 0 OR r > 0 THEN (pr - pe) * ln(pr / pe) ELSE 0 END) AS psi FROM (SELECT *, greatest(e / (sum(e) OVER w{tail}), {floor}) AS pe,
      greatest(r / (sum(r) OVER w{tail}), {floor}) AS pr FROM (SELECT symbol, feature, least(len(list_filter(ed, lambda v: v <= value)), len(ed) - 1) AS bn,
      CAST(count(*) FILTER (NOT recent AND value BETWEEN ed[1] AND ed[-1]) AS DOUBLE) AS e, CAST(count(*) FILTER (recent AND value BETWEEN ed[1] AND ed[-1]) AS DOUBLE) AS r
      FROM fw JOIN (SELECT symbol, feature, list_sort(list_distinct([{q}])) AS ed FROM fw WHERE NOT recent GROUP BY ALL) USING (symbol, feature) WHERE value IS NOT NULL GROUP BY ALL)
      WINDOW w AS (PARTITION BY symbol, feature)) GROUP BY ALL"""


cte("psi_a", psi_sql("1e-6", "0", ""), ("fw",))
cte("psi_n", psi_sql("1e-4", "1e-9", ""), ("fw",))


@query("psi_drift", "SELECT symbol, feature, round(psi, 8) AS psi, psi > .02 AS drifted, 'ok' AS state FROM psi_a" + short_sql("NULL, NULL, NULL"), ("psi_a", "b"))
def psi_drift(spark, sf):
    out = R.psi(long_windows(windows(spark, sf)), [*KEYS, "feature"])
    return with_short(rounded(out.select("symbol", "feature", "psi", (F.col("psi") > 0.02).alias("drifted")), 8), spark, sf)


@query("psi_drift_v39", "SELECT symbol, feature, round(psi, 8) AS psi, 'ok' AS state FROM psi_n" + short_sql("NULL, NULL"), ("psi_n", "b"))
def psi_drift_v39(spark, sf):
    out = R.psi(long_windows(windows(spark, sf)), [*KEYS, "feature"], floor=1e-4, widen=1e-9, min_rows=30)
    return with_short(rounded(out.select("symbol", "feature", "psi"), 8), spark, sf)


@query("consensus_drift", "SELECT symbol, feature FROM ksp WHERE p < .5 AND stat > .03 INTERSECT SELECT symbol, feature FROM psi_n WHERE psi > .015", ("ksp", "psi_n"))
def consensus_drift(spark, sf):
    rows = stage(long_windows(windows(spark, sf)))
    keys = [*KEYS, "feature"]
    a = R.ks_drift(rows, keys, 0.5, 0.03, 30).select("symbol", "feature")
    p = R.psi(rows, keys, floor=1e-4, widen=1e-9, min_rows=30).filter("psi > 0.015").select("symbol", "feature")
    return a.intersect(p)


@query("top_drift", "SELECT symbol, feature, round(stat, 9) AS stat FROM ksp ORDER BY stat DESC, symbol, feature LIMIT 3", ("ksp",))
def top_drift(spark, sf):
    out = R.ks_test(long_windows(windows(spark, sf)), [*KEYS, "feature"])
    return rounded(out.orderBy(F.desc("stat"), "symbol", "feature").limit(3).select("symbol", "feature", "stat"), 9)


@query("drift_limits", """SELECT symbol, round(r * .1, 6) AS ks_limit, round(r * .2, 6) AS psi_limit, greatest(2, CAST(floor(r * 5) AS BIGINT)) AS count_limit FROM
  (SELECT symbol, least(greatest(arg_max(vol_regime, i) / (quantile_cont(vol_regime, .5) + 1e-9), .5), 3)::DOUBLE AS r FROM rgi GROUP BY 1)""", ("rgi",))
def drift_limits(spark, sf):
    from barflow.plans.indicators import vol_regime
    d = S.framed(D.indexed(spark, sf), lambda x, r: vol_regime(I.base(x, r), r), before=72)
    return rounded(R.drift_limits(stage(d.select(*KEYS, "bar_idx", "vol_regime")), KEYS).drop("timeframe"))


@query("drift_decision", """SELECT symbol, round(nr, 9) AS null_ratio, coalesce(k, 0) AS ks_count, coalesce(p, 0) AS psi_count,
  CASE WHEN nr > .15 THEN 'skip_sparse' WHEN coalesce(k, 0) > 0 OR coalesce(p, 0) > 0 THEN 'retrain' ELSE 'skip' END AS action, 'ok' AS state FROM
  (SELECT symbol, avg(x) AS nr FROM (SELECT symbol, feature, avg((value IS NULL)::INT) AS x FROM fw WHERE recent GROUP BY ALL) GROUP BY 1)
  LEFT JOIN (SELECT symbol, count(*) AS k FROM ksp WHERE p < .05 AND stat > .05 GROUP BY 1) USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS p FROM psi_a WHERE psi > .05 GROUP BY 1) USING (symbol)""" + short_sql("NULL, NULL, NULL, NULL"), ("fw", "ksp", "psi_a", "b"))
def drift_decision(spark, sf):
    d = windows(spark, sf)
    rows = long_windows(d)
    keys = [*KEYS, "feature"]
    out = R.drift_decision(R.ks_drift(rows, keys, 0.05, 0.05), R.psi(rows, keys).filter("psi > 0.05"), R.null_ratio(d.filter("recent"), FEATS, KEYS), KEYS, 0)
    return with_short(rounded(out.drop("timeframe"), 9), spark, sf)


@query("feature_sanitize", """SELECT symbol, feature, min(value) <> max(value) AS varies, round(avg((value IS NULL)::INT), 9) AS null_share,
  min(value) <> max(value) AND avg((value IS NULL)::INT) < .05 AS keep FROM fl GROUP BY ALL""", ("fl",))
def feature_sanitize(spark, sf):
    return rounded(R.sanitize(feats(spark, sf), FEATS, KEYS, 0.05).drop("timeframe"), 9)


@query("corr_prune", "SELECT symbol, feature, round(m, 8) AS max_corr, coalesce(m > .5, false) AS dropped FROM (SELECT symbol, unnest(['ret', 'rng', 'vol', 'body', 'c2']) AS feature, unnest([NULL, abs(corr(ret, rng)), greatest("
       + "abs(corr(ret, vol)), abs(corr(rng, vol))), greatest(abs(corr(ret, body)), abs(corr(rng, body)), abs(corr(vol, body))), greatest(abs(corr(ret, c2)), abs(corr(rng, c2)), abs(corr(vol, c2)), abs(corr(body, c2)))]) AS m FROM ft GROUP BY symbol)", ("ft",))
def corr_prune(spark, sf):
    return rounded(R.correlation_prune(feats(spark, sf), FEATS, 0.5, KEYS).drop("timeframe"), 8)


@query("feature_stability", """SELECT symbol, feature, scores, round(spread, 8) AS spread, scores >= 2 AND spread <= .08 AS stable,
  (scores >= 2 AND spread <= .08) OR count(*) FILTER (scores >= 2 AND spread <= .08) OVER (PARTITION BY symbol) < 5 AS keep FROM
  (SELECT symbol, feature, count(s) AS scores, stddev_pop(s) AS spread FROM (SELECT symbol, feature, ch, abs(corr(value, label)) AS s FROM
   (SELECT *, CASE WHEN i < (n_ % 3) * (n_ // 3 + 1) THEN i // (n_ // 3 + 1) ELSE n_ % 3 + (i - (n_ % 3) * (n_ // 3 + 1)) // (n_ // 3) END AS ch FROM fl)
   GROUP BY ALL HAVING count(*) >= 200) GROUP BY ALL)""", ("fl",))
def feature_stability(spark, sf):
    return rounded(R.feature_stability(stage(feats(spark, sf)), FEATS, "label", KEYS).drop("timeframe"), 8)


@query("retrain_window", """SELECT symbol, bar_ts, CASE WHEN i < 100 THEN 'anchor' ELSE 'rolling' END AS part FROM ft
  WHERE n_ > 300 AND (i < 100 OR (i >= 100 AND i >= n_ - 200 - 300 AND i < n_ - 200))""", ("ft",))
def retrain_window(spark, sf):
    return R.retrain_window(D.indexed(spark, sf), 100, 300, 200, KEYS).select("symbol", "bar_ts", "part")


LASTV = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), m.{c}, 0) AS {c}" for c in FEATS)
MEDS = ", ".join(f"quantile_cont({c}, .5) AS {c}" for c in FEATS)


@query("training_matrix", f"SELECT symbol, bar_ts, label, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM (SELECT symbol, bar_ts, label, {LASTV.replace('last_value(', 'last_value(ft.')} FROM ft, (SELECT {MEDS} FROM ft) m)", ("ft",))
def training_matrix(spark, sf):
    d = stage(feats(spark, sf))
    out = Q.training_matrix(d, FEATS, "label", R.feature_medians(d, FEATS))
    return rounded(out.select("symbol", "bar_ts", "label", *FEATS))


@query("feature_vector", f"SELECT symbol, bar_ts, [{', '.join(f'round(coalesce({c}, (SELECT quantile_cont({c}, .5) FROM ft), 0), 6)' for c in FEATS)}] AS vector FROM ft", ("ft",))
def feature_vector(spark, sf):
    from barflow.functions.vectors import assemble
    d = stage(feats(spark, sf))
    return assemble(d, FEATS, R.feature_medians(d, FEATS)).select("symbol", "bar_ts", F.transform("vector", lambda v: F.round(v, 6)).alias("vector"))


@query("label_distribution", """SELECT symbol, count(*) AS rows, count(*) FILTER (label = 0) AS sell, count(*) FILTER (label = 1) AS hold, count(*) FILTER (label = 2) AS buy,
  round(count(*) FILTER (label = 0) / count(*), 9) AS sell_share, round(count(*) FILTER (label = 1) / count(*), 9) AS hold_share, round(count(*) FILTER (label = 2) / count(*), 9) AS buy_share,
  round(coalesce(count(*) FILTER (label = 2) / nullif(count(*) FILTER (label = 0), 0), 0), 9) AS buy_sell_ratio, round(count(*) FILTER (label <> 1) / count(*) * 100, 9) AS actionable_pct FROM f3 GROUP BY 1""", ("f3",))
def label_distribution(spark, sf):
    from barflow.plans.labels import outcome3
    return rounded(E.label_distribution(outcome3(spark, sf), "label", KEYS).drop("timeframe"), 9)


@query("ts_folds", """SELECT symbol, fold, ANY_VALUE(s - 50) AS train_end, ANY_VALUE(s) AS val_start, ANY_VALUE(s + st) AS val_end, count(*) FILTER (label = 1 AND i < s - 50) AS train_pos,
  count(*) FILTER (label = 1 AND i >= s AND i < s + st) AS val_pos, count(*) FILTER (label = 1 AND i < s - 50) >= 5 AND count(*) FILTER (label = 1 AND i >= s AND i < s + st) >= 5 AS usable FROM
  (SELECT *, n_ // 6 AS st, n_ - (5 - fold) * (n_ // 6) AS s FROM ft, (SELECT unnest(range(0, 5)) AS fold)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY symbol, fold"), ("ft",))
def ts_folds(spark, sf):
    return E.ts_folds(feats(spark, sf), "label", 5, 50, KEYS).drop("timeframe")


# scores -----------------------------------------------------------------------------------------


def scores(spark, sf):
    li = D.table(spark, sf, "lineitem")
    flag = F.concat("l_linestatus", "l_returnflag")
    regime = F.when(flag.isin("FA", "OA"), "trending").when(F.col("l_returnflag") == "R", "ranging").when(flag == "FN", "neutral").otherwise("crisis")
    k = (F.col("l_partkey") * 11 + F.col("l_quantity").cast("bigint") * 37) % 1000
    return li.select(F.col("l_linestatus").alias("model"), regime.alias("regime"), (k / 1000.0).alias("score"),
                     ((F.col("l_tax") * 100 + k / 200.0) > 5.5).cast("int").alias("y"), (F.col("l_discount") * 8 + 0.2).alias("recommended"))


cte("sc", """SELECT l_linestatus AS model, CASE WHEN l_returnflag = 'A' THEN 'trending' WHEN l_returnflag = 'R' THEN 'ranging' WHEN l_linestatus = 'F' THEN 'neutral' ELSE 'crisis' END AS regime,
  k / 1000.0::DOUBLE AS score, ((l_tax * 100 + k / 200.0::DOUBLE) > 5.5)::INT AS y, l_discount * 8 + .2::DOUBLE AS recommended FROM (SELECT *, (l_partkey * 11 + l_quantity::BIGINT * 37) % 1000 AS k FROM lineitem)""")
GAIN, LOSS = 0.02, 0.03


@query("oof_threshold", f"""SELECT model, round(t, 9) AS threshold, above, round(wr * {GAIN}::DOUBLE - (1 - wr) * {LOSS}::DOUBLE, 9) AS ev FROM (SELECT model, max(t) AS t, count(*) FILTER (score >= t) AS above,
  CASE WHEN count(*) FILTER (score >= t) >= 20 THEN avg(y) FILTER (score >= t) ELSE 0 END AS wr FROM sc JOIN (SELECT model, least(quantile_cont(score, .8), quantile_cont(score, .9)) AS t FROM sc GROUP BY 1) USING (model) GROUP BY 1)""", ("sc",))
def oof_threshold(spark, sf):
    return rounded(E.oof_threshold(scores(spark, sf), ["model"], GAIN, LOSS), 9)


@query("ev_threshold", f"""SELECT model, round(CASE WHEN ev < 0 THEN p80 ELSE t END, 9) AS threshold, round(ev, 9) AS best_ev FROM (SELECT model, arg_max(t, (ev, -pc)) AS t, max(p80) AS p80, max(ev) AS ev FROM
  (SELECT model, pc, t, max(p80) AS p80, avg(y) * {GAIN}::DOUBLE - (1 - avg(y)) * {LOSS}::DOUBLE AS ev FROM sc JOIN (SELECT model, p80, unnest(range(50, 96, 2)) AS pc, unnest(qs) AS t FROM
   (SELECT model, quantile_cont(score, .8) AS p80, quantile_cont(score, [{', '.join(str(p / 100) for p in range(50, 96, 2))}]) AS qs FROM sc GROUP BY 1)) USING (model) WHERE score >= t GROUP BY ALL HAVING count(*) >= 20) GROUP BY model)""".replace("GROUP BY ALL HAVING", "GROUP BY model, pc, t HAVING"), ("sc",))
def ev_threshold(spark, sf):
    return rounded(E.ev_threshold(scores(spark, sf), ["model"], GAIN, LOSS), 9)


@query("regime_threshold", """SELECT model, regime, count(*) AS rows, round(greatest(CASE regime WHEN 'trending' THEN quantile_cont(score, .7) WHEN 'ranging' THEN quantile_cont(score, .75) WHEN 'neutral' THEN quantile_cont(score, .78)
  ELSE max(score) END, .05), 9) AS threshold FROM sc GROUP BY model, regime HAVING count(*) >= 100""", ("sc",))
def regime_threshold(spark, sf):
    return rounded(E.regime_threshold(scores(spark, sf), ["model"]), 9)


@query("threshold_sweep", """SELECT model, threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM (SELECT model, th AS threshold,
  coalesce(count(*) FILTER (score >= th AND y = 1) / nullif(count(*) FILTER (score >= th), 0), 0) AS p, coalesce(count(*) FILTER (score >= th AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS r
  FROM sc, (SELECT unnest([.5, .55, .6, .65, .7, .75, .8]::DOUBLE[]) AS th) GROUP BY model, th)""", ("sc",))
def threshold_sweep(spark, sf):
    return rounded(E.threshold_sweep(scores(spark, sf), ["model"]), 9)


@query("proba_stats", """SELECT model, min(score) AS min, max(score) AS max, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(quantile_cont(score, .5), 9) AS p50, round(quantile_cont(score, .8), 9) AS p80,
  round(quantile_cont(score, .95), 9) AS p95 FROM sc GROUP BY 1""", ("sc",))
def proba_stats(spark, sf):
    return rounded(E.proba_stats(scores(spark, sf), ["model"]), 9)


@query("rank_metrics", """SELECT model, round(auc, 9) AS auc, round(ap, 9) AS average_precision, round(pe, 9) AS pearson FROM (SELECT model, sum(ps * (nb + (n - ps) / 2)) / (max(tp) * (max(tn) - max(tp))) AS auc, sum(ps / tp * (tp - pb) / (tn - bf)) AS ap FROM
  (SELECT *, coalesce(sum(n - ps) OVER w, 0) AS nb, coalesce(sum(ps) OVER w, 0) AS pb, coalesce(sum(n) OVER w, 0) AS bf, sum(ps) OVER (PARTITION BY model) AS tp, sum(n) OVER (PARTITION BY model) AS tn FROM
  (SELECT model, score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ps FROM sc GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1) JOIN (SELECT model, corr(score, y) AS pe FROM sc GROUP BY 1) USING (model)""", ("sc",))
def rank_metrics(spark, sf):
    return rounded(E.rank_metrics(scores(spark, sf), ["model"]), 9)


@query("recommended_threshold", "SELECT model, round(least(greatest(quantile_cont(recommended, .5), .46), .8), 9) AS threshold FROM sc GROUP BY 1", ("sc",))
def recommended_threshold(spark, sf):
    return rounded(E.recommended_threshold(scores(spark, sf), ["model"]), 9)


def classes(spark, sf):
    c = lambda x: F.when(x > 0.2, 2).when(x < -0.2, 0).otherwise(1)
    return D.fills(spark, sf).select("model", c(F.col("actual")).alias("y"), c(F.col("prediction")).alias("old"), c(F.col("actual") + F.col("prediction") * 0.5).alias("new"))


def c3(x):
    return f"CASE WHEN {x} > .2::DOUBLE THEN 2 WHEN {x} < -.2::DOUBLE THEN 0 ELSE 1 END"


cte("cls", f"SELECT model, {c3('actual')} AS y, {c3('prediction')} AS old, {c3('(actual + prediction * .5)')} AS new FROM fills", ("fills",))


def card_sql(p):
    return f"""SELECT model, avg(2 * tp / (t + p)) AS macro_f1, sum(tp) / sum(t) AS accuracy, sum(tp) / greatest(sum(t) - sum(tp), 1) AS profit_factor FROM (SELECT model, c, count(*) FILTER (y = c) AS t, count(*) FILTER ({p} = c) AS p,
      count(*) FILTER (y = c AND {p} = c) AS tp FROM cls, (SELECT unnest([0, 1, 2]) AS c) GROUP BY model, c HAVING t + p > 0) GROUP BY 1"""


cte("card_old", card_sql("old"), ("cls",))
cte("card_new", card_sql("new"), ("cls",))


@query("classification_scorecard", "SELECT model, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy, round(profit_factor, 9) AS profit_factor, 0.0::DOUBLE AS max_drawdown FROM card_old", ("card_old",))
def classification_scorecard(spark, sf):
    return rounded(E.scorecard(classes(spark, sf), "y", "old", ["model"]), 9)


@query("upgrade_gate", """SELECT model, round(o.macro_f1, 9) AS old_f1, round(n.macro_f1, 9) AS new_f1, n.macro_f1 >= o.macro_f1 + .01 AS f1_ok, n.macro_f1 >= o.macro_f1 + .01 AND n.accuracy + .02 >= o.accuracy AND n.profit_factor + .05 >= o.profit_factor AS accepted,
  CASE WHEN NOT n.macro_f1 >= o.macro_f1 + .01 THEN 'f1_gate' WHEN NOT (n.accuracy + .02 >= o.accuracy AND n.profit_factor + .05 >= o.profit_factor) THEN 'scorecard_gate' END AS rejected_reason FROM card_old o JOIN card_new n USING (model)""", ("card_old", "card_new"))
def upgrade_gate(spark, sf):
    d = classes(spark, sf)
    return rounded(E.upgrade_gate(E.scorecard(d, "y", "old", ["model"]), E.scorecard(d, "y", "new", ["model"]), ["model"], 0.01), 9)


@query("walkforward_summary", """SELECT model, count(*) AS folds, round(avg(tr), 6) AS mean_return, round(avg(sh), 6) AS mean_sharpe, round(avg((tr > 0)::INT) * 100, 6) AS profitable_pct FROM
  (SELECT model, year(ts) AS fold, sum(pnl) / 1e6 AS tr, avg(pnl) / stddev_samp(pnl) AS sh FROM fills GROUP BY ALL) GROUP BY 1""", ("fills",))
def walkforward_summary(spark, sf):
    folds = D.fills(spark, sf).groupBy("model", F.year("ts").alias("fold")).agg((F.sum("pnl") / 1e6).alias("total_return"), (F.avg("pnl") / F.stddev_samp("pnl")).alias("sharpe"))
    return rounded(E.walkforward_summary(folds, ["model"]))


@query("reliability_table", """SELECT model, bin, CAST(sum(n) AS BIGINT) AS rows, round(sum(value * n) / sum(n), 8) AS mean_score, round(sum(hits) / sum(n), 8) AS observed_rate FROM
  (SELECT *, CAST(floor((upto - n) * 10 / total) AS INT) AS bin FROM (SELECT model, confidence AS value, count(*) AS n, sum((pnl > 0)::INT) AS hits,
   sum(count(*)) OVER (PARTITION BY model ORDER BY confidence) AS upto, sum(count(*)) OVER (PARTITION BY model) AS total FROM fills GROUP BY 1, 2)) GROUP BY 1, 2""", ("fills",))
def reliability_table(spark, sf):
    d = D.fills(spark, sf).withColumn("won", F.col("pnl") > 0)
    return rounded(E.reliability_table(d, "confidence", "won", ["model"]), 8)


FITTED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SEEN = "l_orderkey % 4 <> 0 AND l_discount < .08"
LATER = {"l_quantity": "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity * 1.5 END", "l_tax": "NULL::DOUBLE"}
BOUNDED = ", ".join(f"round(CASE WHEN {LATER.get(c, c)} IS NULL THEN {c}_mid ELSE least(greatest({LATER.get(c, c)}, {c}_lo), {c}_hi) END, 6) AS {c}" for c in FITTED)
MADE = ", ".join(f"quantile_cont({c}, .5) AS {c}_mid, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in FITTED)


@query("fitted_features", f"SELECT l_orderkey, l_linenumber, {BOUNDED} FROM lineitem, (SELECT {MADE} FROM lineitem WHERE {SEEN}) WHERE l_orderkey % 4 = 0")
def fitted_features(spark, sf):
    """Fitted on most orders; applied to the others, whose frame lacks a feature, has gaps, larger values and further columns."""
    from barflow.operators.fitted import FeaturePipeline
    li = D.table(spark, sf, "lineitem")
    model = FeaturePipeline(list(FITTED), ["l_orderkey", "l_linenumber"]).fit(li.filter(SEEN))
    later = li.filter("l_orderkey % 4 = 0").drop("l_tax").withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_quantity") * 1.5))
    return rounded(model.transform(later))
