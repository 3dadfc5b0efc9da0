"""Rules whose state depends on what they accepted before, without one task per series.

``chunk_fold`` runs such a rule over chunks of an indexed series. Each chunk is summarised for every state it
could be entered with; the summaries of ``GROUP`` neighbouring chunks are composed to one, group by group in
parallel; only groups are chained per series; and from a group's entry state the entry states of its chunks
follow, group by group again. Each chunk is then run from its true entry state. A task sees one chunk of rows,
the summaries of one group, or one row per group of a series.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import micros
from barflow.operators.series import CHUNK, TICK_CHUNK, framed, index_series, running
from barflow.session import stage

#: Chunks whose summaries are composed in one task.
GROUP = 256
_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def chunk_fold(df: DataFrame, keys: list[str], cols: list[str], summarise: Callable, advance: Callable, compose: Callable, emit: Callable,
               start, out: str, out_type: str, chunk: int = CHUNK, idx: str = "bar_idx", group: int | None = None) -> DataFrame:
    """Add ``out`` to an indexed frame.

    summarise(values, first) -> JSON value; compose(earlier, later) -> JSON value; advance(state, summary) ->
    state; emit(values, state) -> array. ``values`` holds the arrays of ``cols`` and the index of one chunk in
    order; ``first`` tells the first chunk of a series.
    """
    kinds = dict(df.dtypes)
    base = df.withColumn("_blk", F.floor(F.col(idx) / F.lit(chunk)))
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    top = F.floor(F.col("_blk") / F.lit(group or GROUP)).alias("_top")

    def named(key, names, **more):
        return pa.table({**{n: pa.array([k.as_py()], k.type) for n, k in zip(names, key)}, **more})

    def arrays(t):
        return {c: t.column(c).to_numpy() for c in {*cols, idx}}

    def summary(key, t):
        text = json.dumps(summarise(arrays(t.sort_by(idx)), key[-1].as_py() == 0))
        return named(key, [*keys, "_blk"], _sum=pa.array([text]))

    def composed(key, t):
        parts = map(json.loads, t.sort_by("_blk").column("_sum").to_pylist())
        return named(key, [*keys, "_top"], _sum=pa.array([json.dumps(functools.reduce(compose, parts))]))

    def chain(batches):
        current, state = None, start
        for t in batches:
            entry = []
            for *key, text in zip(*[t.column(k).to_pylist() for k in [*keys, "_sum"]]):
                if key != current:
                    current, state = key, start
                entry.append(json.dumps(state))
                state = advance(state, json.loads(text))
            yield pa.RecordBatch.from_arrays([t.column(k) for k in [*keys, "_top"]] + [pa.array(entry, pa.string())], names=[*keys, "_top", "_entry"])

    def descend(t, above):
        t = t.sort_by("_blk")
        state, entry = json.loads(above.column("_entry")[0].as_py()), []
        for text in t.column("_sum").to_pylist():
            entry.append(json.dumps(state))
            state = advance(state, json.loads(text))
        return t.select([*keys, "_blk"]).append_column("_entry", pa.array(entry, pa.string()))

    def run(t, above):
        t = t.sort_by(idx)
        values = emit(arrays(t), json.loads(above.column("_entry")[0].as_py()))
        return t.drop_columns(["_blk"]).append_column(out, pa.array(values, _ARROW[out_type], from_pandas=True))

    sums = stage(base.select(*keys, "_blk", idx, *cols).groupBy(*keys, "_blk").applyInArrow(summary, f"{key_schema}, _blk bigint, _sum string"))
    placed = sums.select("*", top)
    tops = placed.groupBy(*keys, "_top").applyInArrow(composed, f"{key_schema}, _top bigint, _sum string")
    entered = tops.repartition(*keys).sortWithinPartitions(*keys, "_top").mapInArrow(chain, f"{key_schema}, _top bigint, _entry string")
    entries = placed.groupBy(*keys, "_top").cogroup(entered.groupBy(*keys, "_top")).applyInArrow(descend, f"{key_schema}, _blk bigint, _entry string")
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` {out_type}"
    return base.groupBy(*keys, "_blk").cogroup(entries.groupBy(*keys, "_blk")).applyInArrow(run, schema)


def spaced(us: np.ndarray, last: int | None, gap_us: int) -> tuple[np.ndarray, int | None]:
    """Which of the times in order are at least the gap after the last accepted one, and the last accepted."""
    flags = np.zeros(len(us), bool)
    i = 0 if last is None else int(np.searchsorted(us, last + gap_us, side="left"))
    while i < len(us):
        flags[i], last = True, int(us[i])
        i = int(np.searchsorted(us, last + gap_us, side="left"))
    return flags, last


def capped(us: np.ndarray, taken: list[int], n: int, window_us: int) -> tuple[np.ndarray, list[int]]:
    """Which of the times in order are accepted, at most n in a window, and the last n accepted."""
    flags, i = np.zeros(len(us), bool), 0
    while i < len(us):
        if len(taken) == n:  # nothing passes until the oldest of the last n is a window away
            i = max(i, int(np.searchsorted(us, taken[0] + window_us, side="left")))
            if i >= len(us):
                break
            taken = taken[1:]
        flags[i] = True
        taken = [*taken, int(us[i])]
        i += 1
    return flags, taken


def departs(p, base: float, threshold: float):
    return (base != 0) & (np.abs((p - base) / (base if base != 0 else 1.0)) >= threshold)


def departure(prices: np.ndarray, at: int, base: float, threshold: float) -> int:
    """The next row from ``at`` that departs from ``base``, or the number of rows."""
    width = 64
    while at < len(prices) and base != 0:
        hit = np.flatnonzero(departs(prices[at:at + width], base, threshold))
        if len(hit):
            return at + int(hit[0])
        at, width = at + width, width * 2
    return len(prices)


def followed(prices: np.ndarray, base: float | None, threshold: float) -> tuple[np.ndarray, float | None]:
    """The baseline in force before each price, and the one after all; the first price of all becomes the baseline."""
    used, at = np.full(len(prices), np.nan), 0
    if base is None and len(prices):
        base, at = float(prices[0]), 1
    while at < len(prices):
        nxt = departure(prices, at, base, threshold)
        used[at:nxt + 1] = base
        if nxt < len(prices):
            base = float(prices[nxt])
        at = nxt + 1
    return used, base


def spaced_groups(starts: np.ndarray, us: np.ndarray, gap_us: int) -> np.ndarray:
    """Which of the times are accepted by ``spaced`` in each group, for all groups together; groups begin at ``starts``."""
    flags, ends = np.zeros(len(us), bool), np.r_[starts[1:], len(us)]
    if not len(us):
        return flags
    # Groups one after the other on one clock, so that one search finds the next row of each.
    first, reach = us[starts], us[ends - 1] - us[starts] + gap_us + 1
    base = np.r_[0, np.cumsum(reach)[:-1]]
    clock = us + np.repeat(base - first, ends - starts)
    at = starts
    while len(at):
        flags[at] = True
        nxt = np.searchsorted(clock, clock[at] + gap_us, side="left")
        on = nxt < ends
        at, ends = nxt[on], ends[on]
    return flags


def walked(d: DataFrame, keys: list[str], gap_us: int, out: str) -> DataFrame:
    """Add the accepted flag to segments (``_seg``: the index of the first row) of a bounded number of rows."""

    def flagged(t, starts):
        flags = spaced_groups(starts, t.column("_us").to_numpy(), gap_us)
        yield from t.append_column(out, pa.array(flags)).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            starts = np.flatnonzero(t.column("bar_idx").to_numpy() == t.column("_seg").to_numpy())
            held = t.slice(starts[-1])  # the last segment may go on
            yield from flagged(t.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from flagged(held, np.zeros(1, np.int64))

    schema = ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + f", `{out}` boolean"
    n = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return d.repartition(n, *keys, "_seg").sortWithinPartitions(*keys, "bar_idx").mapInArrow(run, schema)


def greedy_spacing(df: DataFrame, keys: list[str], gap_us: int, order=("ts",), out: str = "accepted", chunk: int = TICK_CHUNK) -> DataFrame:
    """Accept a row if at least ``gap_us`` has passed since the last accepted one of its key.

    A row that far behind its predecessor is accepted whatever came before, so it starts a segment of its own.
    In a segment shorter than the gap only that row is accepted; repeated ids have no others and never leave the
    JVM. Of longer segments those of up to ``chunk`` rows are walked many at a time, the others are folded, each as a series of
    its own.
    """
    idx = index_series(df, keys, order, balanced=True).withColumn("_us", micros(order[0]))

    def cuts(d, r):
        prev = r.lag("_us")
        return d.withColumn("_cut", prev.isNull() | (F.col("_us") - prev >= gap_us))

    d = framed(idx, cuts, before=1, keys=keys)
    d = stage(running(d, {"_seg": ("max", F.when(F.col("_cut"), F.col("bar_idx")))}, keys, ("bar_idx",)))
    spans = d.groupBy(*keys, "_seg").agg((F.max("_us") - F.min("_us") >= gap_us).alias("_long"), F.count(F.lit(1)).alias("_rows")).filter("_long")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_seg"]]
    d = d.join(spans.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_seg"]], "_long", "_rows"), functools.reduce(lambda a, b: a & b, same), "left")
    d = d.drop(*[f"_of_{k}" for k in [*keys, "_seg"]])
    short = d.filter(F.col("_long").isNull()).withColumn(out, F.col("_cut"))
    many = walked(d.filter(F.col("_long") & (F.col("_rows") <= chunk)), keys, gap_us, out)
    long_ = d.filter(F.col("_long") & (F.col("_rows") > chunk)).drop("_rows").withColumn("_in", F.col("bar_idx") - F.col("_seg"))

    def merged(start, at, final):
        """Only entries that a state before ``start`` can reach; neighbours with one end are one, named by the latest."""
        n = int(np.searchsorted(at, start + gap_us, side="left")) + 1
        at, final = np.asarray(at[:n], np.int64), np.asarray(final[:n], np.int64)
        keep = np.r_[final[1:] != final[:-1], True]
        return [int(start), at[keep].tolist(), final[keep].tolist()]

    def summarise(v, first):
        us = v["_us"]
        n = len(us)
        nxt = np.searchsorted(us, us + gap_us, side="left")
        last = np.where(nxt < n, nxt, np.arange(n))
        while True:  # twice as far each time
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        return merged(us[0], us, us[last])

    def advance(state, s):
        _, at, final = s
        need = -(2**62) if state is None else state + gap_us
        i = int(np.searchsorted(at, need, side="left"))
        return final[i] if i < len(at) else state

    def compose(a, b):
        later = int(np.searchsorted(b[1], a[1][-1], side="right"))
        return merged(a[0], a[1] + b[1][later:], [advance(f, b) for f in a[2]] + b[2][later:])

    def emit(v, state):
        return spaced(v["_us"], state, gap_us)[0]

    folded = chunk_fold(long_, [*keys, "_seg"], ["_us"], summarise, advance, compose, emit, None, out, "boolean", chunk, "_in").drop("_in")
    return short.unionByName(many).drop("_rows").unionByName(folded).drop("_us", "_cut", "_seg", "_long", "bar_idx")


def moving_baseline(indexed: DataFrame, keys: list[str], price: str, threshold: float, out: str = "baseline", chunk: int = CHUNK) -> DataFrame:
    """Baseline in force before each row; it moves to the price that departs from it by ``threshold``.

    From any entry baseline the first departure in a chunk is a new high or low of the chunk, so a chunk is
    summarised by those records and the baseline each would lead to at its end. Neighbouring highs, or lows,
    that lead to the same end are one, named by the latest.
    """

    def final(prices, i, memo):
        path = []
        while i not in memo:
            path.append(i)
            nxt = departure(prices, i + 1, prices[i], threshold)
            if nxt == len(prices):
                memo[i] = float(prices[i])
                break
            i = nxt
        for j in path:
            memo[j] = memo[i]
        return memo[i]

    def merged(records, ends, from_first):
        r, e = np.asarray(records), np.asarray(ends)
        up = np.r_[True, r[1:] > np.maximum.accumulate(r)[:-1]]
        # A record goes if the next one is of the same kind and leads to the same end.
        keep = np.r_[~((up[1:] == up[:-1]) & (e[1:] == e[:-1])), True]
        keep[0] = True  # the first is high and low at once
        return [r[keep].tolist(), e[keep].tolist(), from_first]

    def summarise(v, first):
        p = v[price].astype(float)
        hi, lo = np.maximum.accumulate(p), np.minimum.accumulate(p)
        new = np.flatnonzero(np.r_[True, (p[1:] > hi[:-1]) | (p[1:] < lo[:-1])])
        memo = {}
        return merged(p[new], [final(p, int(i), memo) for i in new], final(p, 0, memo))

    def advance(state, s):
        records, ends, from_first = s
        if state is None:
            return from_first
        hit = np.flatnonzero(departs(np.asarray(records), state, threshold))
        return ends[hit[0]] if len(hit) else state

    def compose(a, b):
        hi, lo = max(a[0]), min(a[0])
        new = [(r, e) for r, e in zip(b[0], b[1]) if r > hi or r < lo]
        return merged(a[0] + [r for r, _ in new], [advance(e, b) for e in a[1]] + [e for _, e in new], advance(a[2], b))

    def emit(v, state):
        return followed(v[price].astype(float), state, threshold)[0]

    return chunk_fold(indexed, keys, [price], summarise, advance, compose, emit, None, out, "double", chunk)


def gap_and_daily_cap(indexed: DataFrame, keys: list[str], candidate: str, day: str, gap: int, cap: int, out: str = "accepted",
                      chunk: int = CHUNK) -> DataFrame:
    """Accept a candidate bar at least ``gap`` bars after the last accepted one, at most ``cap`` per day.

    A chunk can be entered in (gap + 1) x (cap + 1) states: bars since the last accepted one, and how many the
    first day of the chunk has taken already. Candidates are walked once for all states together.
    """
    states = [(s, u) for s in range(gap + 1) for u in range(cap + 1)]

    def fold(v, since, used):
        """Arrays of states through the candidates of a chunk; the accepted flags of each state if there is one."""
        i, days = v["bar_idx"], v[day]
        last, used, today = i[0] - np.asarray(since), np.asarray(used).copy(), days[0]
        flags = np.zeros((len(i), len(used)), bool) if len(used) == 1 else None
        for k in np.flatnonzero(v[candidate].astype(bool)):
            if days[k] != today:
                today, used[:] = days[k], 0
            ok = (i[k] - last >= gap) & (used < cap)
            last, used = np.where(ok, i[k], last), used + ok
            if flags is not None:
                flags[k] = ok
        if days[-1] != today:
            today, used[:] = days[-1], 0
        return flags, np.minimum(gap, i[-1] + 1 - last), used, int(today)

    def summarise(v, first):
        _, since, used, today = fold(v, *zip(*states))
        return [int(v[day][0]), [[int(s), int(u), today] for s, u in zip(since, used)]]

    def entry(state, day0):
        since, used, today = state
        return min(gap, since), (used if today == day0 else 0)

    def advance(state, s):
        since, used = entry(state, s[0])
        return s[1][since * (cap + 1) + used]

    def compose(a, b):
        return [a[0], [advance(state, b) for state in a[1]]]

    def emit(v, state):
        since, used = entry(state, int(v[day][0]))
        return fold(v, [since], [used])[0][:, 0]

    return chunk_fold(indexed, keys, [candidate, day], summarise, advance, compose, emit, [gap, 0, -1], out, "boolean", chunk)


def rolling_cap(df: DataFrame, keys: list[str], n: int, window_us: int, order=("ts",), out: str = "accepted") -> DataFrame:
    """Accept while fewer than ``n`` rows were accepted in the window before (its far edge excluded).

    The state is the last n accepted times, which has no small summary. Rows are cut where a whole window passed
    without any row, sorted by Spark, and streamed through in Arrow batches; memory is n times, tasks follow the
    segments, and only accepted rows are walked.
    """
    idx = index_series(df, keys, order, balanced=True).withColumn("_us", micros(order[0]))
    d = framed(idx, lambda x, r: x.withColumn("_cut", r.lag("_us").isNull() | (F.col("_us") - r.lag("_us") >= window_us)), before=1, keys=keys)
    d = running(d, {"_seg": ("max", F.when(F.col("_cut"), F.col("bar_idx")))}, keys, ("bar_idx",))
    d = d.repartition(*keys, "_seg").sortWithinPartitions(*keys, "bar_idx").drop("_cut")

    def run(batches):
        current, taken = None, []
        for pdf in batches:
            us, flags = pdf["_us"].to_numpy(), np.zeros(len(pdf), bool)
            ids = pd.MultiIndex.from_frame(pdf[[*keys, "_seg"]])
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if ids[lo] != current:
                    current, taken = ids[lo], []
                flags[lo:hi], taken = capped(us[lo:hi], taken, n, window_us)
            yield pdf.assign(**{out: flags})

    schema = ", ".join(f"`{c}` {t}" for c, t in d.dtypes) + f", {out} boolean"
    return d.mapInPandas(run, schema).drop("_us", "_seg", "bar_idx")
