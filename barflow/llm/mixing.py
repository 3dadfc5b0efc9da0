"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded coin per document.

Sources in code point order, NULL last, weigh ``weights`` in turn and share all words. A target stops at
``most`` times its source's size and the excess goes to the others by weight until none is above. With
rate = target / size, a document is emitted floor(rate) times, and once more with a probability equal to the
fraction. The draw is systematic: the documents of a source stand in order of size, the longest first, and
document number i gets the extra copy if phase + i x fraction passes a whole number there, phase being a hash of seed
and source. So a source comes within about one document of its target, which coins tossed without regard to each other do
not. Sizes are compared by their first ``DIGITS`` binary digits; of the documents of one such grade as many are taken
as whole numbers are passed in it, those with the lowest coins, a hash of seed, doc_id and text. Grades are at most a few
thousand per source whatever the input.

NULL or empty texts have size 0 and are emitted like any other row; a table without words gives targets and
rates 0. Rows with a NULL doc_id toss coins by their texts; repeated rows (doc_id and text) toss the same coin, so they
get the extra copy together, or none does. Only the
columns named as arguments are read by name, so any further column may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import stage, table, word_count
from barflow.llm.registry import query

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Binary digits of a size that count in the order of a source's documents.
DIGITS = 8
#: Slices of the coin in which a limit is looked for.
SLICES = 1024


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, size): source, source_size, target. One row per source passes through the windows.

    Capped sources are those with the smallest cap per weight; the level at the first source that is not
    capped is the share of one unit of weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / others.cast("double")
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    per = per.withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    share = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("place"))).over(whole)
    target = F.coalesce(F.least(F.col("cap").cast("double"), share * F.col("weight")), F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def coin(*parts: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def grade(size: str) -> Column:
    """The size with all binary digits after the first ``DIGITS`` set to zero."""
    rest = f"greatest(length(bin({size})) - {DIGITS}, 0)"
    return F.expr(f"shiftleft(shiftright({size}, {rest}), {rest})")


def tossed(seed: str = SEED, row: str = "") -> Column:
    """The coin of a document."""
    return coin(F.col(f"{row}doc_id"), F.md5(F.coalesce(F.col(f"{row}text"), F.lit("")).cast("binary")), seed=seed)


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, grade (of the size) and coin of every row."""
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tossed(seed).alias("coin"))
    return d.withColumn("grade", grade("size"))


def limits(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per stratum (of, of_grade): source_size, target, whole (copies of every document) and the limit of its coins.

    The limit is a single order statistic: counts by slices of the coin tell the slice it is in, and only the
    rows of that slice, a thousandth of a stratum, are ranked.
    """
    targets = source_targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "of")
    slice_ = F.floor(F.col("coin") * SLICES)
    per = stage(rows.groupBy("source", "grade", slice_.alias("slice")).agg(F.count(F.lit(1)).alias("n")))
    strata = per.groupBy("source", "grade").agg(F.sum("n").alias("all"))
    # A row per grade of a source passes through this window.
    longer = Window.partitionBy("source").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, 0)
    strata = strata.withColumn("upto", F.sum("all").over(longer)).join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    strata = strata.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("phase", coin(F.col("source"), seed=seed))
    passed = lambda n: F.floor(F.col("phase") + (F.col("rate") - F.col("whole")) * n)
    taken = passed(F.col("upto")) - passed(F.col("upto") - F.col("all"))
    strata = stage(strata.select(F.col("source").alias("of"), F.col("grade").alias("of_grade"), "source_size", "target", "whole", taken.alias("taken")))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("grade") == F.col("of_grade"))
    stratum = Window.partitionBy("source", "grade")
    per = per.withColumn("before", F.coalesce(F.sum("n").over(stratum.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = per.join(strata, same).filter((F.col("before") <= F.col("taken")) & (F.col("taken") < F.col("before") + F.col("n")))
    cut = cut.select("of", "of_grade", F.col("slice").alias("of_slice"), (F.col("taken") - F.col("before")).alias("skip"))
    ranked = rows.select("source", "grade", "coin", slice_.alias("slice")).join(cut, same & (F.col("slice") == F.col("of_slice")))
    ranked = ranked.withColumn("place", F.row_number().over(stratum.orderBy("coin")) - 1).filter(F.col("place") == F.col("skip"))
    found = ranked.select("source", "grade", F.col("coin").alias("limit"))
    return strata.join(found, same, "left").select("of", "of_grade", "source_size", "target", "whole", F.coalesce("limit", F.lit(1.0)).alias("limit"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed table: the rows of ``docs`` (doc_id, source, text and whatever else), each as often as its copies say."""
    plan = stage(limits(stage(sized(docs, seed)), weights, most, seed))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.select("row", "source", grade("size").alias("grade"), tossed(seed, "row.").alias("coin"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("grade") == F.col("of_grade")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), copies().cast("int"))).alias("one")).select("row.*")


def copies() -> Column:
    return (F.col("whole") + (F.col("coin") < F.col("limit")).cast("long")).cast("long")


@query("op8_mixing", """
WITH sized AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(text, '')) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sized GROUP BY source),
level AS (SELECT *, 3 * source_size AS cap, row_number() OVER o AS place,
  (sum(source_size) OVER () - COALESCE(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - COALESCE(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM per WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
share AS (SELECT arg_min(level, place) AS share FROM level WHERE cap / weight >= level),
target AS (SELECT source, source_size, COALESCE(least(cap::DOUBLE, share * weight), cap::DOUBLE) AS target FROM level, share),
rated AS (SELECT doc_id, size, t.source, size - size % (1::BIGINT << greatest(length(bin(size)) - 8, 0)) AS grade, source_size, target,
  CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
  ('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS coin,
  ('0x' || substr(md5('mix-1:' || COALESCE(t.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS phase
  FROM sized JOIN target t ON sized.source IS NOT DISTINCT FROM t.source),
graded AS (SELECT *, row_number() OVER (PARTITION BY source, grade ORDER BY coin) - 1 AS place, count(*) OVER (PARTITION BY source, grade) AS n,
  count(*) OVER (PARTITION BY source ORDER BY grade DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rated),
placed AS (SELECT *, floor(phase + (rate - floor(rate)) * upto) - floor(phase + (rate - floor(rate)) * (upto - n)) AS n_taken FROM graded),
limited AS (SELECT *, COALESCE(max(CASE WHEN place = n_taken THEN coin END) OVER (PARTITION BY source, grade), 1) AS coin_limit FROM placed)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < coin_limit THEN 1 ELSE 0 END))::BIGINT AS taken FROM limited
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    rows = stage(sized(table(spark, sf_dir)))
    plan = stage(limits(rows))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("grade") == F.col("of_grade")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))
