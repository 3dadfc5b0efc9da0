"""From raw documents to tokens: quality, near duplicates, secrets, mixture, encoding.

Each stage works on all rows its predecessor kept and returns the columns of documents, the last one a row of
digests and tokens per emitted document. Between stages the rows are written as Parquet in the shared folder.

Empty tables pass through every stage. Rows with NULL or empty text are scored, linked, scanned, mixed and encoded
like others. Further columns of documents stay until the mixture. The near-duplicate stage decides by text, not by
doc_id: rows that share a doc_id, or have none, are linked and dropped or kept each by its own text, and of repeated
rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import bpe, mixing, near, quality, secrets
from barflow.llm.common import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, likeness of 0.8) the row with the smallest doc_id, one without only if there is no other.

    Candidates come from SimHash fingerprints with pigeonring chains, as in op4_simhash, and from bands of min-hashes; whole
    shingle sets are compared after.
    """
    found = near.grouped(docs, 5)
    lead = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")).select("root", F.col("least.mark").alias("lead"))
    marks = found.groupBy("mark").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("times")).join(lead, "root")
    # Few marks are broadcast, so that whole rows are not shuffled.
    dropped = near.sent(stage(marks.filter(F.col("mark") != F.col("lead")).select("mark")))
    repeated = near.sent(stage(marks.filter((F.col("mark") == F.col("lead")) & (F.col("times") > 1)).select("mark")))
    kept = docs.select(F.struct("*").alias("row"), near.row_mark(docs).alias("mark")).join(dropped, "mark", "left_anti")
    once = kept.join(repeated, "mark", "left_anti").select("row")
    one = kept.join(repeated, "mark", "left_semi").groupBy("mark").agg(F.first("row").alias("row")).select("row")
    return once.union(one).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars follows."""
    return secrets.redact_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and their digests, one row per emitted document."""
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("tokens", encode_texts),
]

#: SQL cannot express the fitted model and the encoder; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
