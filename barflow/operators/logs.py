"""Reports over structured log entries, and reconciliation of id sets and ledgers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import div, reasons

# Error levels, what a message pattern leaves out (times, long hex words, digits, runs of blanks), slow words.
ERRORS = ["ERROR", "CRITICAL"]
NORMALISE = [(r"\d{4}-\d{2}-\d{2}[\st]\d{2}:\d{2}:\d{2}", ""), (r"\b[a-f0-9]{8,}\b", ""), (r"\d+", ""), (r"\s+", " ")]
SLOW = ["timeout", "slow", "latency", "performance"]


def is_error() -> Column:
    return F.upper("level").isin(*ERRORS)


def error_report(logs: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent error types, components and warnings; one counting pass over the log."""
    err, warn = is_error(), F.upper("level") == "WARNING"
    keys = F.array_compact(F.array(
        F.when(err, F.struct(F.lit("error_type").alias("kind"), F.coalesce("error_type", F.lit("UnknownError")).alias("key"))),
        F.when(err, F.struct(F.lit("component").alias("kind"), F.coalesce("component", "service", F.lit("unknown")).alias("key"))),
        F.when(warn, F.struct(F.lit("warning").alias("kind"), F.coalesce("message", F.lit("unknown_warning")).alias("key")))))
    counts = logs.select(F.explode(keys).alias("_k")).groupBy("_k.kind", "_k.key").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql.window import Window
    w = Window.partitionBy("kind").orderBy(F.desc("count"), "key")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def recent(logs: DataFrame, n: int, *tie: str) -> DataFrame:
    return logs.filter(is_error()).orderBy(F.desc("timestamp"), *tie).limit(n)


def pattern_key(message: Column) -> Column:
    """Message without times, long hex words and digits, spaces squeezed."""
    m = F.lower(message)
    for p, r in NORMALISE:
        m = F.regexp_replace(m, p, r)
    return F.trim(m)


def error_patterns(logs: DataFrame, samples: int = 3, order: str = "timestamp") -> DataFrame:
    """Recurring messages. Samples are the earliest distinct ones, held in a bounded way: messages are
    counted first, then ranked, so no task gathers all messages of a pattern."""
    from pyspark.sql.window import Window
    d = logs.withColumn("pattern", pattern_key(F.col("message"))).filter(F.length("pattern") >= 10)
    per = d.groupBy("pattern", "message").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_a"), F.max(order).alias("_z"),
                                              F.collect_set("service").alias("_s"), F.collect_set("component").alias("_c"))
    w = Window.partitionBy("pattern").orderBy("_a", "message")
    first = per.select("pattern", "message", "_a").withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= samples)
    first = first.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("_rk", "message"))).alias("_m"))
    head = per.groupBy("pattern").agg(F.sum("_n").alias("count"), F.min("_a").alias("first_seen"), F.max("_z").alias("last_seen"))
    names = per.select("pattern", F.explode(F.concat(F.transform("_s", lambda s: F.struct(F.lit("s").alias("k"), s.alias("v"))), F.transform("_c", lambda s: F.struct(F.lit("c").alias("k"), s.alias("v"))))).alias("_x"))
    names = names.groupBy("pattern").agg(F.sort_array(F.collect_set(F.when(F.col("_x.k") == "s", F.col("_x.v")))).alias("services"), F.sort_array(F.collect_set(F.when(F.col("_x.k") == "c", F.col("_x.v")))).alias("components"))
    return head.filter(F.col("count") > 1).join(names, "pattern", "left").join(first, "pattern").select(
        "pattern", "count", "first_seen", "last_seen", F.coalesce("services", F.array().cast("array<string>")).alias("services"),
        F.coalesce("components", F.array().cast("array<string>")).alias("components"), F.transform("_m", lambda m: m["message"]).alias("samples"))


def unhandled() -> Column:
    m = F.lower("message")
    return is_error() & (m.contains("exception") | m.contains("traceback") | (F.coalesce("stack_trace", F.lit("")) != ""))


def slices(logs: DataFrame) -> DataFrame:
    """Rows tagged with every slice they belong to."""
    m = F.lower("message")
    slow = functools.reduce(Column.__or__, [m.contains(word) for word in SLOW])
    untyped = m.contains("exception") & (F.coalesce("error_type", F.lit("")) == "")
    tags = reasons((unhandled(), "unhandled"), (slow, "performance"), (untyped, "untyped_exception"))
    return logs.withColumn("slice", F.explode(tags))


def health(logs: DataFrame, keys=()) -> DataFrame:
    n = F.count(F.lit(1))
    lvl = F.upper("level")
    a = logs.groupBy(*keys).agg(n.alias("entries"), F.count_if(is_error()).alias("errors"), F.count_if(lvl == "WARNING").alias("warnings"),
                                F.count_if(lvl == "CRITICAL").alias("critical"), F.count_if(unhandled()).alias("unhandled"))
    c = F.col
    part = lambda cap, x: F.least(F.lit(cap), x)
    score = 1.0 - part(0.5, 2 * div("errors", "entries")) - part(0.2, 0.5 * div("warnings", "entries")) - part(0.3, 0.1 * c("critical")) - part(0.2, 0.05 * c("unhandled"))
    return a.withColumn("score", F.greatest(F.lit(0.0), score))


def reconcile_sets(approved: DataFrame, filled: DataFrame, rejected: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Approved ids nothing accounts for, and fills nobody approved."""
    ids = lambda d: d.select(key).distinct()
    accounted = ids(filled).union(ids(rejected)).union(ids(failed))
    orphans = ids(approved).join(accounted, key, "left_anti").withColumn("kind", F.lit("orphan"))
    return orphans.unionByName(ids(filled).join(ids(approved), key, "left_anti").withColumn("kind", F.lit("unexpected_fill")))


def reconcile_ledger(ledger: DataFrame, table: DataFrame, key: str = "trade_id") -> DataFrame:
    both = ledger.select(key, F.lit(1).alias("_l")).join(table.select(key, F.lit(1).alias("_t")), key, "full")
    state = F.when(F.col("_l").isNull(), "table_only").when(F.col("_t").isNull(), "ledger_only").otherwise("matched")
    return both.select(key, state.alias("state"))
