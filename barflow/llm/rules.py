"""Quality rules: plain counts that fail a document outright, and a hashed n-gram log-likelihood ratio for the rest.

Words and pairs of words are hashed into buckets: the fewest, as a power of two and ``BUCKETS`` at least, that hold
at most ``LOAD`` distinct n-grams each, as the empty buckets of the count tell. So the ratios grow with the corpus,
and smoothing and threshold mean the same at every size. Two multinomials over the buckets are counted, one
over the trusted target (the documents that ``labels`` marks with quality 1), one over all documents. A text's
score is the sum of log(target / raw) over its words and pairs, divided by their number; a document is kept if it
reaches ``LEAST``, the same for all and without chance.

Within a text, five-word windows are compared by a 64-bit hash of their words. Everything is a DataFrame
expression: windows are built by zipping hashed words with themselves, shifted; only texts with a repeated window
look for its places. Up to ``HELD`` buckets the ratios are broadcast, packed as arrays of ``PACK``; above, they are
joined by a shuffle of each text's buckets.

Counting is one pass over the texts in map tasks of ``MAP_BYTES``, so that many sums meet before they are shuffled; up to ``HELD``
buckets ``WIDE`` neighbours share a row. Up to ``IDS`` trusted ids are broadcast to it (counted first); more are joined by a shuffle
of the texts.

NULL and empty texts have no words and fail. Without a trusted document every ratio is 0. Repeated rows come
back as often as they came and count as often in the raw corpus. Only doc_id and text are read, and of labels
doc_id and quality.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import stage, table
from barflow.llm.registry import query

#: The fewest buckets, and the distinct n-grams that a bucket holds at most on average.
BUCKETS = 1 << 16
LOAD = 6
#: Buckets whose counts (4 bytes each) are broadcast at most, and how many lie in a row.
HELD = 1 << 24
PACK = 1 << 10
#: Bytes of text for a bucket of the first count.
GUESS = 64
#: Counts below this are broadcast as half of a number; a bucket beyond it has an entry of its own.
HEAVY = 1 << 16
#: Buckets of a row while they are counted, the text of a map task, and the trusted ids that are broadcast at most.
WIDE = 8
MAP_BYTES = 96 << 20
IDS = 1 << 22
SMOOTH = 1.0
LEAST = -0.2
WINDOW = 5
# Fixed values of the plain rules.
SYMBOLS = r"[#*$%&|<>]"
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _zipped(left: Column, right: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places later of ``right``; as many as ``right`` allows."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), _shifted(right, by), lambda a, b: F.xxhash64(a, b))


def with_repeated_words(d: DataFrame) -> DataFrame:
    """Replace ``windows`` by n_repeat_words, the words covered by windows whose hash occurs twice or more in the list.

    Each step is a column of its own: what a lambda refers to would else be made anew for every element.
    """
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("placed", F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(x: Column, i: Column) -> Column:
        return (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"])

    d = d.withColumn("at", F.array_sort(F.transform(F.filter("placed", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"])))
    apart = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), _shifted(F.col("at"), 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(apart, F.lit(WINDOW), lambda total, n: total + n)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "placed", "at")


def counted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the plain counts, and the hashed words and pairs (hashes, pairs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", words_of(F.col("text")).alias("words"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    d = d.select("doc_id", "n_symbols", "n_dup_lines", F.size("words").cast("long").alias("n_words"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    d = d.withColumn("pairs", _zipped(F.col("hashes"), F.col("hashes"), 1))
    d = d.withColumn("windows", _zipped(_zipped(F.col("pairs"), F.col("pairs"), 2), F.col("hashes"), WINDOW - 1))
    return with_repeated_words(d).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long"))


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _grams(hashes: str) -> Column:
    return F.concat(hashes, _zipped(F.col(hashes), F.col(hashes), 1))


def power_of_two(least: float) -> int:
    """The smallest power of two that is ``BUCKETS`` at least and not below ``least``."""
    n = BUCKETS
    while n < least:
        n *= 2
    return n


def laid(grams: DataFrame, buckets: int) -> DataFrame:
    """(bucket, good, raw) summed to (wide, good, raw): the counts of the buckets of a row, in order."""
    wide = WIDE if buckets <= HELD else 1
    here = [F.col("bucket").bitwiseAND(F.lit(wide - 1).cast("long")) == j for j in range(wide)]
    sums = [F.sum(F.when(h, F.col(name)).otherwise(0)).alias(f"{name}{j}") for name in ("good", "raw") for j, h in enumerate(here)]
    rows = grams.groupBy(F.shiftright("bucket", wide.bit_length() - 1).alias("wide")).agg(*sums)
    return rows.select("wide", *[F.array(*[f"{name}{j}" for j in range(wide)]).alias(name) for name in ("good", "raw")])


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int, size: int, ids: int = IDS) -> DataFrame:
    """(wide, good, raw): for the buckets of a row, in order, how often they occur in trusted documents and in all."""
    trusted = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("of")).distinct()
    how = "broadcast" if trusted.limit(ids + 1).count() <= ids else "merge"
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // MAP_BYTES))
    flagged = docs.select("doc_id", "text").coalesce(tasks).join(trusted.hint(how), F.col("doc_id") == F.col("of"), "left")
    hashed = flagged.select(F.col("of").isNotNull().cast("long").alias("good"), _hashes(F.col("text")).alias("hashes"))
    grams = hashed.select("good", F.explode(_grams("hashes")).alias("h"))
    return laid(grams.select(bucket(F.col("h"), buckets).alias("bucket"), "good", F.lit(1).cast("long").alias("raw")), buckets)


class Ratios(NamedTuple):
    """Counts (wide, good, raw) of the buckets that occur, the number of buckets, and the sums of both counts."""

    counts: DataFrame
    buckets: int
    good: int
    raw: int

    def of(self, good: Column, raw: Column) -> Column:
        """The log-likelihood ratio of a bucket with these counts."""
        if not self.good:
            return F.lit(0.0)
        return F.log((good + SMOOTH) / (self.good + SMOOTH * self.buckets)) - F.log((raw + SMOOTH) / (self.raw + SMOOTH * self.buckets))

    @property
    def rows(self) -> DataFrame:
        """(bucket, good, raw) of the buckets that occur."""
        rows = self.counts.select("wide", F.size("raw").alias("n"), F.posexplode(F.arrays_zip("good", "raw")).alias("j", "x")).filter("x.raw > 0")
        return rows.select((F.col("wide") * F.col("n") + F.col("j")).alias("bucket"), "x.good", "x.raw")

    @property
    def table(self) -> DataFrame:
        """(bucket, ratio) of the buckets that occur."""
        return self.rows.select("bucket", self.of(F.col("good"), F.col("raw")).alias("ratio"))


def ratios(docs: DataFrame, labels: DataFrame) -> Ratios:
    """The counts behind the log-likelihood ratios, summed in the map tasks before they are shuffled.

    Counted once, in buckets guessed from the bytes of text. How many of these stay empty tells the number of distinct
    n-grams (linear counting); counts in too many buckets are folded, too few are counted again in as many as it takes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total = lambda name: F.sum(F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x)).alias(name)
    have = power_of_two(size / GUESS)
    while True:
        counts = stage(bucket_counts(docs, labels, have, size))
        sums = counts.agg(total("good"), total("raw"), F.sum(F.size(F.filter("raw", lambda n: n > 0))).alias("used")).first()  # three numbers
        used = sums["used"] or 0
        need = power_of_two(-have * math.log1p(-used / have) / LOAD) if used < have else 4 * have
        if need <= have:
            break
        have = need
    model = Ratios(counts, have, sums["good"] or 0, sums["raw"] or 0)
    if need < have:
        model = model._replace(counts=stage(laid(model.rows.withColumn("bucket", bucket(F.col("bucket"), need)), need)), buckets=need)
    return model


def packed(model: Ratios) -> DataFrame:
    """(pack, codes, heavy): for ``PACK`` buckets in order good and raw as the halves of one number, 0 for one that does not
    occur or is heavy; heavy maps the places of those to their ratio."""
    rows = model.counts.select(F.shiftright("wide", (PACK // WIDE).bit_length() - 1).alias("pack"), F.col("wide").bitwiseAND(F.lit(PACK // WIDE - 1).cast("long")).cast("int").alias("at"), "good", "raw")
    code = F.zip_with("good", "raw", lambda g, r: F.when(r < HEAVY, F.shiftleft(g, 16).bitwiseOR(r)).otherwise(0).cast("long"))
    halves = F.transform(code, lambda c: F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int"))
    heavy = F.filter(F.transform(F.arrays_zip("good", "raw"), lambda x, j: F.when(x["raw"] >= HEAVY, F.struct((F.col("at") * WIDE + j).alias("k"), model.of(x["good"], x["raw"]).alias("v")))), lambda x: x.isNotNull())
    packs = rows.select("pack", F.struct("at", halves.alias("codes")).alias("x"), heavy.alias("heavy")).groupBy("pack").agg(
        F.map_from_entries(F.collect_list("x")).alias("x"), F.map_from_entries(F.flatten(F.collect_list("heavy"))).alias("heavy"))
    none = F.array_repeat(F.lit(0), WIDE)
    codes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PACK // WIDE - 1)), lambda i: F.coalesce(F.try_element_at("x", i), none)))
    return stage(packs.select("pack", codes.alias("codes"), "heavy"))


def judge(docs: DataFrame, model: Ratios, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, score and kept."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = counted(docs).withColumn("row", F.monotonically_increasing_id())
    grams = rows.select("row", *names, F.posexplode_outer(F.concat("hashes", "pairs")).alias("at", "h"))
    grams = grams.withColumn("bucket", bucket(F.col("h"), model.buckets))
    if model.buckets <= HELD:
        # A row's n-grams stay in its task, so summing them again by row shuffles one line per document.
        rated = grams.withColumn("pack", F.shiftright("bucket", PACK.bit_length() - 1)).join(F.broadcast(packed(model)), "pack", "left")
        place = F.col("bucket").bitwiseAND(F.lit(PACK - 1).cast("long")).cast("int")
        rated = rated.withColumn("code", F.get("codes", place)).withColumn("entry", F.when(F.col("code") == 0, F.try_element_at("heavy", place)))
        ratio = model.of(F.shiftrightunsigned("code", 16), F.col("code").bitwiseAND(F.lit(0xFFFF)))
        rated = rated.withColumn("ratio", F.when(F.col("code") == 0, F.col("entry")).otherwise(ratio))
    else:
        # Only a row's first n-gram carries its counts through the shuffle.
        grams = grams.withColumns({n: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(n)) for n in names})
        rated = grams.join(model.table.hint("merge"), "bucket", "left")
    one = rated.groupBy("row").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names], F.sum("ratio").alias("total"), F.count("h").alias("n"))
    score = F.when(F.col("n") > 0, F.coalesce("total", F.lit(0.0)) / F.col("n")).otherwise(F.lit(0.0))
    return one.select(*names, score.alias("score")).withColumn("kept", ~F.col("base_failed") & (F.round("score", 9) >= least))


@query("op7_rules")
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir)
    return judge(docs, ratios(docs, table(spark, sf_dir, "labels")))
