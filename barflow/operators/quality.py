"""Data-quality reports. Every check is a report row, never an exception in the middle of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barflow.functions.columns import EPS, div, flag, micros
from barflow.operators.bars import OHLCV
from barflow.operators.series import KEYS, framed, index_series, running

# Weight of each quality class in the overall score.
QUALITY_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4, "DEGRADED": 0.1, "UNAVAILABLE": 0.0}


def _with_step(bars: DataFrame, keys) -> DataFrame:
    def build(df, r):
        return (df.withColumn("_step", (micros("bar_ts") - micros(r.lag("bar_ts"))) / F.lit(1e6))
                .withColumn("_final", r.lead("bar_ts").isNull()))

    return framed(index_series(bars, keys), build, before=1, after=1, keys=keys)


def validate(bars: DataFrame, seconds: int, min_rows: int = 0, allow_last_irregular: bool = False,
             keys=KEYS) -> DataFrame:
    """One row per series and violated rule, with how many rows violate it.

    Without an arrival column the rows of a series have no order but their time, so "not increasing"
    shows as a duplicate time.
    """
    missing = sorted({*OHLCV, "bar_ts"} - set(bars.columns))
    if missing:
        names = F.array(*[F.lit(f"missing_column:{m}") for m in missing])
        return (bars.select(*keys).distinct()
                .select(*keys, F.explode(names).alias("rule"), F.lit(1).cast("bigint").alias("violations")))
    dated = _with_step(bars.filter(F.col("bar_ts").isNotNull()), keys)
    exempt = (F.col("_final") & (F.col("bar_idx") >= 2)) if allow_last_irregular else F.lit(False)
    o, h, l, c = (F.col(x) for x in OHLCV[:4])
    checks = {
        "duplicate_ts": F.count_if(F.col("_step") == 0),
        "irregular_step": F.count_if((F.col("_step") != seconds) & ~exempt),
        "high_below_low": F.count_if(h < l),
        "outside_range": F.count_if((c > h) | (c < l) | (o > h) | (o < l)),
        "single_row": (F.count(F.lit(1)) == 1).cast("bigint"),
        "too_few_rows": (F.count(F.lit(1)) < min_rows).cast("bigint"),
    }
    per = dated.groupBy(*keys).agg(*[e.alias(n) for n, e in checks.items()])
    out = per.unpivot(list(keys), list(checks), "rule", "violations")
    nulls = (bars.filter(F.col("bar_ts").isNull()).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("null_ts")))
    return out.unionByName(nulls).filter("violations > 0")


def gaps(bars: DataFrame, seconds: int, keys=KEYS) -> DataFrame:
    """Steps above twice the bar length: how many and the largest."""
    wide = F.col("_step") > 2 * seconds
    return _with_step(bars, keys).groupBy(*keys).agg(
        F.count_if(wide).alias("gaps"), F.max(F.when(wide, F.col("_step"))).alias("largest_seconds"))


def spikes(bars: DataFrame, limit: float = 0.10, keys=KEYS) -> DataFrame:
    """Bars whose range is above ``limit`` of the close: how many, and the worst one."""
    size = (F.col("high") - F.col("low")) / (F.col("close") + EPS)
    worst = F.max_by("bar_ts", F.struct(size, -micros("bar_ts")))
    return (bars.withColumn("_s", size).filter(F.col("_s") > limit).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("spikes"), F.max("_s").alias("worst"), worst.alias("worst_ts")))


def sanity(bars: DataFrame, min_rows: int, keys=KEYS) -> DataFrame:
    """Load checks in one pass; repeated times are counted by (key, time) first."""
    per_time = bars.groupBy(*keys, "bar_ts").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("close") <= 0).alias("_c"),
        F.count_if(F.col("high") < F.col("low")).alias("_h"), F.count_if(F.col("volume") < 0).alias("_v"))
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_c").alias("bad_close"), F.sum("_h").alias("bad_range"),
        F.sum("_v").alias("bad_volume"), F.sum(F.col("_n") - 1).alias("duplicates"),
        ((F.sum("_c") + F.sum("_h") + F.sum("_v") + F.sum(F.col("_n") - 1) == 0)
         & (F.sum("_n") >= min_rows)).alias("passed"))


def grid_report(bars: DataFrame, filled: DataFrame, seconds: int, keys=KEYS) -> DataFrame:
    """Before and after of the grid fill: duplicates, gaps, missing bars, rows and range."""
    distinct = bars.groupBy(*keys, "bar_ts").agg(F.count(F.lit(1)).alias("_n"))
    raw = _with_step(distinct, keys).groupBy(*keys).agg(
        F.sum(F.col("_n") - 1).alias("duplicates"), F.count_if(F.col("_step") > seconds).alias("raw_gaps"))
    done = filled.groupBy(*keys).agg(
        F.count_if("filled").alias("missing"), F.count(F.lit(1)).alias("final_rows"),
        F.count_if(F.col("close").isNull()).alias("null_rows"),
        F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))
    return raw.join(done, list(keys))


def coverage(bars: DataFrame, target: int, floor: float, divisor: int = 1, keys=KEYS) -> DataFrame:
    """Rows held over rows wanted; ``divisor`` scales finer bars down (3 for 5m counted as 15m)."""
    held = F.floor(F.count(F.lit(1)) / F.lit(divisor))
    return bars.groupBy(*keys).agg(
        held.alias("rows"), (held / F.lit(target)).alias("share"), (held / F.lit(target) >= floor).alias("passed"))


def dataset_gate(df: DataFrame, columns: list[str], min_rows: int, keys=KEYS) -> DataFrame:
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in columns[1:]),
                F.sum(F.col(columns[0]).isNull().cast("bigint")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"),
        ((F.count(F.lit(1)) >= min_rows) & (nulls == 0)).alias("passed"))


def side_coverage(bars: DataFrame, side: DataFrame, step_seconds: int, slack_seconds: int, keys=KEYS) -> DataFrame:
    """Does the side series start in time for each bar series, and how many bars lie before it."""
    start = side.agg(F.min("bar_ts")).scalar()
    ahead = F.greatest((micros(start) - micros(F.min("bar_ts"))) / F.lit(1e6), F.lit(0.0))
    return bars.groupBy(*keys).agg(
        F.min("bar_ts").alias("bars_from"), start.alias("side_from"),
        (micros(start) <= micros(F.min("bar_ts")) + slack_seconds * 1_000_000).alias("aligned"),
        F.floor(ahead / F.lit(step_seconds)).alias("rows_at_risk"))


def quality_class(value: Column, age_seconds: Column) -> Column:
    return (F.when(value.isNull() | F.isnan(value), "DEGRADED").when(age_seconds > 3600, "LOW")
            .when(age_seconds > 600, "MEDIUM").when(F.abs(value) > 1e6, "DEGRADED").otherwise("HIGH"))


def quality_score(df: DataFrame, keys, quality: str = "quality") -> DataFrame:
    weights = F.create_map(*[F.lit(x) for p in QUALITY_WEIGHTS.items() for x in p])
    score = F.avg(F.coalesce(weights[F.col(quality)], F.lit(0.0)))
    return df.groupBy(*keys).agg(score.alias("score")).withColumn("overall", quality_band(F.col("score")))


def quality_band(score: Column) -> Column:
    return (F.when(score >= 0.9, "HIGH").when(score >= 0.7, "MEDIUM").when(score >= 0.4, "LOW")
            .when(score > 0, "DEGRADED").otherwise("UNAVAILABLE"))


def freshness(age_seconds: Column) -> Column:
    """Display bucket of an age."""
    out = F.when(age_seconds < 30, "live")
    for limit, name in ((60, "fresh"), (120, "recent"), (300, "aging"), (900, "stale")):
        out = out.when(age_seconds < limit, name)
    return out.otherwise("very_stale")


def table_diff(expected: DataFrame, actual: DataFrame, key: list[str], tolerance: float = 0.0) -> DataFrame:
    """Long list of differences between two keyed tables: missing, extra, or value."""
    values = [c for c in expected.columns if c not in key]
    types = dict(expected.dtypes), dict(actual.dtypes)
    both = (expected.select(*key, *[F.col(c).alias(f"_e_{c}") for c in values], F.lit(True).alias("_in_e"))
            .join(actual.select(*key, *[F.col(c).alias(f"_a_{c}") for c in values if c in actual.columns],
                                F.lit(True).alias("_in_a")), key, "full"))
    here = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()

    def cell(c):
        e = F.col(f"_e_{c}")
        if c not in actual.columns:
            return F.when(here, F.struct(F.lit(c).alias("column"), F.lit("missing_column").alias("kind"),
                                         e.cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
        a = F.col(f"_a_{c}")
        numeric = all(t[c] in ("double", "float", "int", "bigint") or t[c].startswith("decimal") for t in types)
        if types[0][c] != types[1][c] and not numeric:
            kind, bad = "type", ~(e.isNull() & a.isNull())
        elif numeric:
            kind = "value"
            bad = ~F.coalesce(F.abs(e - a) <= tolerance, e.isNull() & a.isNull())
        else:
            kind, bad = "value", ~e.eqNullSafe(a)
        return F.when(here & bad, F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                                           e.cast("string").alias("expected"), a.cast("string").alias("actual")))

    def row(kind):
        null = F.lit(None).cast("string")
        return F.struct(null.alias("column"), F.lit(kind).alias("kind"), null.alias("expected"), null.alias("actual"))

    found = F.array_compact(F.array(
        F.when(F.col("_in_a").isNull(), row("missing")), F.when(F.col("_in_e").isNull(), row("extra")),
        *[cell(c) for c in values]))
    return both.select(*key, F.explode(found).alias("_d")).select(*key, "_d.*")


def schema_check(spark, df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Required fields and types against a frame's schema; reads metadata only."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name),
             "missing" if f.name not in have else "ok" if have[f.name] == f.dataType.simpleString() else "type")
            for f in wanted.fields]
    return spark.createDataFrame(rows, "field string, wanted string, found string, state string")


def payload_check(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """JSON payload structure: per required field, rows lacking it and rows of another JSON type."""
    parsed = df.select(F.col(column).alias("_p"), F.try_parse_json(F.col(column)).alias("_j"))
    out = []
    for name, kind in fields.items():
        v = F.try_variant_get("_j", f"$.{name}", "variant")
        t = F.schema_of_variant(v)
        out += [F.count_if(v.isNull()).alias(f"missing_{name}"),
                F.count_if(v.isNotNull() & (t != kind)).alias(f"type_{name}")]
    return parsed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_j").isNull()).alias("malformed"), *out)


def check_contract(df: DataFrame, names: list[str]) -> list[str]:
    """Differences between a frame's columns and a declared, ordered list; empty when they agree."""
    found = df.columns
    out = [f"missing {n}" for n in names if n not in found] + [f"extra {n}" for n in found if n not in names]
    if not out and found != list(names):
        out.append("order")
    return out


def feature_union(groups: dict[str, DataFrame], ids) -> DataFrame:
    """Sorted union of the feature columns of several frames: position, feature, the groups that have it, and its values.

    One pass over each frame; from there on a row per group and feature. Features sort by code point.
    """
    found = None
    for group, d in sorted(groups.items()):
        cells = [F.struct(F.lit(group).alias("group"), F.lit(n).alias("feature"), F.count(f"`{n}`").alias("n")) for n in d.columns if n not in ids]
        rows = d.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
        found = rows if found is None else found.unionByName(rows)
    per = found.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"), F.sum("n").alias("n_values"))
    # A row per feature name passes through this window.
    return per.withColumn("position", (F.row_number().over(Window.orderBy("feature")) - 1).cast("bigint"))


def fill_forward(df: DataFrame, columns: list[str], limit: int | None, keys=KEYS) -> DataFrame:
    """Forward fill, over at most ``limit`` rows (a row frame) or without limit (a running last)."""
    if limit is None:
        tmp = running(df, {f"_f_{c}": ("last", c) for c in columns}, keys)
        return tmp.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])

    def build(d, r):
        return d.withColumns({c: r.over(F.last(F.col(c), ignorenulls=True), -limit, 0) for c in columns})

    return framed(df, build, before=limit, keys=keys)


def clean_dataset(df: DataFrame, warmup: int = 250, limit: int = 5, keys=KEYS) -> DataFrame:
    """Drop the warm-up rows, fill short holes, drop rows still lacking OHLCV."""
    late = (index_series(df, keys).filter(F.col("bar_idx") >= warmup)
            .withColumn("bar_idx", F.col("bar_idx") - warmup))
    return fill_forward(late, OHLCV, limit, keys).dropna(subset=OHLCV).drop("bar_idx")


def training_matrix(df: DataFrame, features: list[str], label: str, medians: DataFrame, limit: int = 5,
                    keys=KEYS) -> DataFrame:
    """Infinities to NULL, short fill, drop unlabelled rows, then the median of each feature."""
    clean = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))
                            for c in features})
    filled = fill_forward(clean, features, limit, keys).filter(F.col(label).isNotNull())
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
    mid = filled.withColumn("_m", row)
    return mid.withColumns({c: F.coalesce(F.col(c), F.col("_m")[c], F.lit(0.0)) for c in features}).drop("_m")


