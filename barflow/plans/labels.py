"""Registered label and outcome queries over the 30-minute bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.columns import EPS, rounded
from barflow.functions.names import b
from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators import series as S
from barflow.plans import domain as D
from barflow.plans.indicators import avg, fr, lag
from barflow.plans.patterns import emit
from barflow.plans.registry import cte, query
from barflow.session import stage

H = 12
AHEAD = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)"


def hit(lst, cond):
    return f"nullif(coalesce(list_position(list_transform({lst}, lambda v: {cond}), true), 0), 0)"


def before(a, z):
    return f"coalesce({a} IS NOT NULL AND ({z} IS NULL OR {a} < {z}), false)"


def not_after(a, z):
    return f"coalesce({a} IS NOT NULL AND ({z} IS NULL OR {a} <= {z}), false)"


cte("f", f"""SELECT *, list(high) {AHEAD} AS hs, list(low) {AHEAD} AS ls, lead(close, {H}) OVER (PARTITION BY symbol ORDER BY i) IS NOT NULL AS full_,
  funding_rate, list(coalesce(funding_rate, 0)) {AHEAD} AS fs FROM x LEFT JOIN (SELECT symbol, bar_ts, funding_rate FROM
  (SELECT b.symbol, b.bar_ts, f.funding_rate FROM bars b ASOF LEFT JOIN funding_s f ON b.bar_ts >= f.bar_ts)) USING (symbol, bar_ts)""", ("x", "bars", "funding_s"))


def with_funding(spark, sf):
    from barflow.plans.bars import _per_symbol
    bars = D.bars(spark, sf)
    d = S.asof_join(bars, [(_per_symbol(bars, D.funding(spark, sf)), "bar_ts", {"funding_rate": "funding_rate"})])
    return S.index_series(stage(d))


TP_SL = f"""CASE WHEN full_ THEN {before(hit('hs', 'v >= close * (1 + .5::DOUBLE + .01::DOUBLE)'), hit('ls', 'v <= close * (1 - .4::DOUBLE)'))}::INT ELSE -1 END"""
emit("label_tp_sl", lambda s, f: L.tp_sl(D.indexed(s, f), 0.5, 0.4, H, 0.01), {"target": TP_SL}, "f")
cte("iir", f"""(SELECT symbol, i, tr0 * {2 / 15!r}::DOUBLE AS y FROM x WHERE i = 0 UNION ALL
  SELECT x.symbol, x.i, {1 - 2 / 15!r}::DOUBLE * iir.y + {2 / 15!r}::DOUBLE * tr0 FROM iir JOIN x ON x.symbol = iir.symbol AND x.i = iir.i + 1)""", ("x",))
cte("fa", "SELECT f.*, CASE WHEN f.i = 0 THEN tr0 ELSE y END AS atr FROM f JOIN iir USING (symbol, i)", ("f", "iir"))
emit("label_atr", lambda s, f: L.atr_tp_sl(D.indexed(s, f), 1.0, 1.0, H),
     {"target": f"CASE WHEN full_ THEN {before(hit('hs', 'v >= close + atr'), hit('ls', 'v <= close - atr'))}::INT ELSE -1 END"}, "fa")


def out3(tp, sl):
    ltp, stp = hit("hs", f"v >= close * (1 + {tp})"), hit("ls", f"v <= close * (1 - {tp})")
    lw, sw = not_after(ltp, hit("ls", f"v <= close * (1 - {sl})")), not_after(stp, hit("hs", f"v >= close * (1 + {sl})"))
    return f"CASE WHEN {lw} AND {sw} THEN CASE WHEN {ltp} <= {stp} THEN 2 ELSE 0 END WHEN {lw} THEN 2 WHEN {sw} THEN 0 ELSE 1 END"


OUT3 = f"CASE WHEN full_ THEN {out3('.5::DOUBLE', '.6::DOUBLE')} ELSE 1 END"
cte("f3", f"SELECT *, {OUT3} AS label FROM f", ("f",))


def outcome3(spark, sf):
    return L.outcome3(D.indexed(spark, sf), 0.5, 0.6, H, 0.001)


emit("label_outcome3", outcome3, {"label": "label"}, "f3")
emit("label_binary", lambda s, f: outcome3(s, f).withColumns(L.binary(F.col("label"))), {"long_label": "(label = 2)::INT", "short_label": "(label = 0)::INT"}, "f3")
cte("fd", f"SELECT *, ({avg('tr0', 14)}) / nullif(close, 0) AS ap FROM f", ("f",))
cte("fd2", "SELECT *, first_value(ap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS apf FROM fd", ("fd",))
cte("fd3", "SELECT *, least(greatest(apf * .2, .1), .8) AS tpp, least(greatest(apf * .16, .1 * .8), .8 * .7) AS slp FROM fd2", ("fd2",))
emit("label_adaptive", lambda s, f: L.adaptive(D.indexed(s, f), 0.2, 0.16, 0.1, 0.8, H, 0.06),
     {"label": f"CASE WHEN full_ AND tpp - 2 * .06::DOUBLE > 0 THEN {out3('tpp', 'slp')} ELSE 1 END", "tp": "tpp", "sl": "slp"},
     "fd3")
KT, KS = hit("hs", "v >= close * 1.5::DOUBLE"), hit("ls", "v <= close * .6::DOUBLE")
PAID = f"list_sum(list_transform(list_slice(fs, 1, {KT}), lambda v: abs(v) / .016::DOUBLE))"
emit("label_funding", lambda s, f: L.funding_single(with_funding(s, f), 0.5, 0.4, H, 0.001, 0.016),
     {"label": f"""CASE WHEN NOT full_ THEN 1 WHEN {not_after(KT, KS)} THEN CASE WHEN .5 - 2 * .001::DOUBLE - {PAID} > 0 THEN 2 ELSE 1 END
       WHEN {KS} IS NOT NULL THEN 0 ELSE 1 END"""}, "f")
cte("f2s", f"SELECT *, {hit('hs', 'v >= close * 1.5::DOUBLE')} AS lt, {hit('ls', 'v <= close * .6::DOUBLE')} AS lx, {hit('ls', 'v <= close * .7::DOUBLE')} AS st, {hit('hs', 'v >= close * 1.4::DOUBLE')} AS sx FROM f", ("f",))
cte("f2t", f"SELECT *, CASE WHEN (lt IS NOT NULL OR lx IS NOT NULL) AND (st IS NOT NULL OR sx IS NOT NULL) THEN greatest(least(lt, lx), least(st, sx)) ELSE {H} END AS en FROM f2s", ("f2s",))
PL, PS = (f"list_sum(list_transform(list_slice(fs, 1, en), lambda v: greatest({s}v, 0) / .004::DOUBLE))" for s in ("", "-"))
emit("label_funding2", lambda s, f: L.funding_two_sided(with_funding(s, f), (1.5, 0.6), (0.7, 1.4), H, 0.001, 0.004),
     {"label": f"""CASE WHEN NOT full_ THEN 1 WHEN {not_after('lt', 'lx')} AND (1.5::DOUBLE - 1) - 2 * .001::DOUBLE - {PL} > 0 THEN 2
       WHEN {not_after('st', 'sx')} AND (1 - .7::DOUBLE) - 2 * .001::DOUBLE - {PS} > 0 THEN 0 ELSE 1 END"""}, "f2t")


def ld(x, k):
    return f"lead({x}, {k}) OVER (PARTITION BY symbol ORDER BY i)"


FWD = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 13 FOLLOWING)"
cte("fn", f"""SELECT *, {ld('open', 1)} AS en, {ld('close', 13)} AS ex, {ld('close', 14)} IS NOT NULL AS live, sum(greatest(coalesce(funding_rate, 0), 0) / 16.0::DOUBLE) {FWD} AS fp,
  sum(greatest(-coalesce(funding_rate, 0), 0) / 16.0::DOUBLE) {FWD} AS fm, coalesce(({avg('tr0', 14)}) / nullif(close, 0), 0) AS atr_pct FROM f""", ("f",))
cte("fn2", """SELECT *, live AND en > 0 AND atr_pct >= .5 AS ok, (ex - en) / nullif(en, 0) - (.003::DOUBLE + 2 * .01::DOUBLE * atr_pct) - fp AS ln,
  (en - ex) / nullif(en, 0) - (.003::DOUBLE + 2 * .01::DOUBLE * atr_pct) - fm AS sn FROM fn""", ("fn",))


def net_edge(spark, sf):
    d = with_funding(spark, sf)
    d = S.framed(d, lambda x, r: (lambda y: y.withColumn("atr_pct", F.try_divide(r.mean("_tr0", 14), b.C)))(I.base(x, r)), before=15)
    return L.net_edge(d, 12, 1, 0.003, 0.01, 16.0, 0.05, 0.5)


NE = {"label": "CASE WHEN ok AND ln > .05 AND ln > sn THEN 2 WHEN ok AND sn > .05 AND sn > ln THEN 0 ELSE 1 END",
      "target_net_return": "CASE WHEN ok THEN CASE WHEN ln >= sn THEN ln ELSE -sn END ELSE 0 END"}
cte("f_edge", f"SELECT symbol, bar_ts, i, close, {', '.join(f'{e} AS {c}' for c, e in NE.items())} FROM fn2", ("fn2",))
emit("label_net_edge", net_edge, {c: c for c in NE}, "f_edge")
R6 = f"({ld('close', 6)} / nullif(close, 0) - 1)"
emit("label_return", lambda s, f: L.return_labels(D.indexed(s, f), 6, 0.25), {
    "entry_label": f"CASE WHEN {R6} > .25 THEN 2 WHEN {R6} < -.25 THEN 0 ELSE 1 END", "class_label": f"CASE WHEN {R6} * 100 > 25 THEN 1 WHEN {R6} * 100 < -25 THEN -1 ELSE 0 END",
    "long_label": f"coalesce(({R6} > .25)::INT, 0)", "short_label": f"coalesce(({R6} < -.25)::INT, 0)"}, "x")
emit("label_regression", lambda s, f: L.future_price(D.indexed(s, f), 6), {"future_close": f"coalesce({ld('close', 6)}, close)"}, "x")
emit("forward_return", lambda s, f: L.forward_return(D.indexed(s, f), (1, 6, 24)), {f"fwd_{k}": f"{ld('close', k)} / nullif(close, 0) - 1" for k in (1, 6, 24)}, "x")
cte("fb", f"SELECT *, {avg('tr0', 14, 1)} AS a, list_zip(hs, ls) AS hl FROM f", ("f",))
BL, BS = hit("hl", "v[2] <= close - a OR v[1] >= close + a * 1.5::DOUBLE"), hit("hl", "v[1] >= close + a OR v[2] <= close - a * 1.5::DOUBLE")
emit("label_barrier", lambda s, f: L.barrier(D.indexed(s, f), 1.5, 1.0, H), {"label": f"CASE WHEN {not_after(BL, BS)} THEN 1 WHEN {BS} IS NOT NULL THEN -1 ELSE 0 END"}, "fb")


@query("embargo_split", """SELECT a.symbol, bar_ts, CASE WHEN i < c - 24 THEN 'train' WHEN i < c THEN 'embargo' ELSE 'holdout' END AS part,
  CASE WHEN bar_ts <= e THEN 'train' WHEN i < nf + 210 AND total - nf > 210 THEN 'gap' ELSE 'oos' END AS oos_part FROM b a JOIN
  (SELECT symbol, count(*) AS total, floor(count(*) * .8::DOUBLE) AS c, max(bar_ts) - INTERVAL '7 days' AS e FROM b GROUP BY 1) USING (symbol) JOIN
  (SELECT symbol, count(*) FILTER (bar_ts <= m - INTERVAL '7 days') AS nf FROM (SELECT *, max(bar_ts) OVER (PARTITION BY symbol) AS m FROM b) GROUP BY 1) USING (symbol)""", ("b",))
def embargo_split(spark, sf):
    d = stage(D.indexed(spark, sf))
    d = L.embargo_split(d, 0.8, 24)
    return L.oos_split(d.withColumnRenamed("part", "p1"), 7, 210).select("symbol", "bar_ts", F.col("p1").alias("part"), F.col("part").alias("oos_part"))


def signals(indexed):
    side = F.when(b.C > b.O * 1.2, 1).when(b.C < b.O * 0.8, -1).otherwise(0)
    return indexed.withColumn("signal", side)


def _outcome_sql(name, start, stop_first):
    n = 24
    w = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {start} FOLLOWING AND {start + n - 1} FOLLOWING)"
    cte(f"{name}0", f"""SELECT * FROM (SELECT symbol, bar_ts, i, CASE WHEN close > open * 1.2::DOUBLE THEN 1 WHEN close < open * .8::DOUBLE THEN -1 ELSE 0 END AS signal, {ld('open', 1)} AS e,
      list({{'o': open, 'h': high, 'l': low, 'c': close, 't': bar_ts}}) {w} AS w FROM b) WHERE signal <> 0 AND e IS NOT NULL AND len(w) > 0""", ("b",))
    cte(f"{name}1", f"SELECT *, e * (1 + signal * .001::DOUBLE) AS entry FROM {name}0", (f"{name}0",))
    cte(f"{name}2", f"SELECT *, entry * (1 - signal * .4::DOUBLE) AS stop, entry * (1 + signal * .5::DOUBLE) AS goal FROM {name}1", (f"{name}1",))
    bad = hit("w", "CASE WHEN signal > 0 THEN v.l <= stop ELSE v.h >= stop END")
    gap = hit("w", "CASE WHEN signal > 0 THEN v.o <= stop ELSE v.o >= stop END")
    good = hit("w", "CASE WHEN signal > 0 THEN v.h >= goal ELSE v.l <= goal END")
    cte(f"{name}3", f"SELECT *, {f'least({bad}, {gap})' if stop_first else bad} AS kb, {good} AS kg FROM {name}2", (f"{name}2",))
    cte(f"{name}4", f"SELECT *, {not_after('kb', 'kg') if stop_first else before('kb', 'kg')} AS st FROM {name}3", (f"{name}3",))
    cte(f"{name}5", f"SELECT *, CASE WHEN st THEN kb WHEN kg IS NOT NULL THEN kg ELSE len(w) END AS k FROM {name}4", (f"{name}4",))
    g = "(CASE WHEN signal > 0 THEN w[k].o <= stop ELSE w[k].o >= stop END)" if stop_first else "false"
    cte(name, f"""SELECT *, side_exit * (1 - signal * .001::DOUBLE) AS exit FROM (SELECT *, CASE WHEN st AND {g} THEN w[k].o WHEN st THEN stop WHEN kg IS NOT NULL THEN goal ELSE w[k].c END AS side_exit,
      CASE WHEN st AND {g} THEN 'sl_gap' WHEN st THEN 'sl' WHEN kg IS NOT NULL THEN 'tp' ELSE 'timeout' END AS exit_reason, w[k].t AS exit_ts, k + {start - 1} AS bars_held FROM {name}5)""", (f"{name}5",))
    return f"""SELECT symbol, bar_ts, signal, round(entry, 10) AS entry, round(exit, 10) AS exit, exit_reason, exit_ts, bars_held,
      round(signal * (exit - entry) / entry - 2 * .0005::DOUBLE, 6) AS pnl_pct FROM {name}"""


OUT_COLS = ["symbol", "bar_ts", "signal", "entry", "exit", "exit_reason", "exit_ts", "bars_held", "pnl_pct"]


def outcomes(spark, sf, rule="stop_first"):
    return L.signal_outcome(signals(D.indexed(spark, sf)), "signal", 0.5, 0.4, 24, 0.001, 0.0005, rule)


@query("signal_outcome", _outcome_sql("so1", 2, True), ("so1",))
def signal_outcome(spark, sf):
    return rounded(outcomes(spark, sf).select(*OUT_COLS), 6, {"entry": 10, "exit": 10})


@query("signal_outcome_target_first", _outcome_sql("so2", 1, False), ("so2",))
def signal_outcome_target_first(spark, sf):
    return rounded(outcomes(spark, sf, "target_first").select(*OUT_COLS), 6, {"entry": 10, "exit": 10})
