"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``places`` fixed places. Every shard owns ``vnodes`` of them; a document's place is a hash of its
doc_id (of the text where there is none), and it belongs to the first virtual node clockwise. A shard is full once its bytes reach
(1 + slack) times the mean; what meets a full shard goes on clockwise to the next other shard. The law is
``bytes``: no shard exceeds that bound by more than the documents of one place. An extra shard takes the
places before its own virtual nodes and what the smaller bound pushes on, so most documents stay.

Overflow is settled on bytes per place, a table of at most ``places`` rows whatever the input: in round r every
place that has no shard yet asks the r-th shard clockwise, which takes places in ring order while it has room.
After as many rounds as shards all are placed, since all shards full would exceed the total.

NULL and empty texts have size 1 and crc32 0. Rows without a doc_id are placed by their texts, so many
of them spread like others; equal texts among them share a place, and so do rows with one doc_id, which therefore stay in one
shard however many they are. An empty table gives no rows. Only doc_id and text are read, further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import stage, table
from barflow.llm.registry import query

SHARDS = 8
VNODES = 128
PLACES = 1 << 14
SLACK = 0.001


def ring(spark: SparkSession, shards: int = SHARDS, vnodes: int = VNODES, places: int = PLACES) -> DataFrame:
    """For each place the shards in clockwise order: (place, prefs). Two turns are laid out so that the last places wrap."""
    shard, replica = F.col("id") % shards, F.floor(F.col("id") / shards)  # a shard's nodes do not depend on how many shards there are
    nodes = spark.range(shards * vnodes).select(shard.alias("shard"), F.pmod(F.xxhash64(F.lit("node"), shard, replica), F.lit(places)).alias("at"))
    owned = nodes.groupBy("at").agg(*[F.max(F.col("shard") == s).alias(f"has{s}") for s in range(shards)])
    turns = spark.range(2 * places).withColumnRenamed("id", "step").join(
        owned, F.pmod(F.col("step"), F.lit(places)) == F.col("at"), "left")
    back = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = turns.select("step", *[F.last(F.when(F.col(f"has{s}"), F.col("step")), True).over(back).alias(f"next{s}") for s in range(shards)])
    # Shards that share a place rank by a hash of both, else the lower number would always win.
    each = [F.struct(F.coalesce(F.col(f"next{s}"), F.lit(4 * places)).alias("at"), F.xxhash64(F.lit(s), F.pmod(F.col(f"next{s}"), F.lit(places))).alias("tie"),
                     F.lit(s).alias("shard")) for s in range(shards)]
    return ahead.filter(F.col("step") < places).select(
        F.col("step").alias("place"), F.transform(F.array_sort(F.array(*each)), lambda x: x["shard"]).alias("prefs"))


def assign_places(totals: DataFrame, prefs: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """From (place, bytes, rows) and the ring: place, shard, first_slot. At most one row per place everywhere."""
    bound = F.ceil(F.sum("bytes").over(Window.partitionBy()) * (1 + slack) / shards)
    t = totals.join(prefs, "place").select("*", bound.alias("bound"), F.lit(None).cast("int").alias("shard"))
    for r in range(shards):
        t = t.withColumn("asked", F.coalesce("shard", F.element_at("prefs", r + 1)))
        shard = Window.partitionBy("asked")
        before = shard.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        held = F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("bytes"))).over(shard), F.lit(0))
        ahead = F.coalesce(F.sum(F.when(F.col("shard").isNull(), F.col("bytes"))).over(before), F.lit(0))
        t = t.withColumn("shard", F.when(F.col("shard").isNotNull(), F.col("shard")).when(held + ahead < F.col("bound"), F.col("asked")))
    first = F.sum("rows").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return t.select("place", "shard", F.coalesce(first, F.lit(0)).alias("first_slot"))


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, places: int = PLACES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) of every row of ``docs``."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), data)).otherwise(F.xxhash64(F.lit("key"), F.col("doc_id").cast("string")))
    sized = stage(docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                              F.pmod(place, F.lit(places)).alias("place")))
    totals = sized.groupBy("place").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    placed = stage(assign_places(totals, ring(spark, shards, vnodes, places), shards, slack))
    # The table of places has at most ``places`` rows whatever the input.
    out = sized.join(F.broadcast(placed), "place")
    within = F.row_number().over(Window.partitionBy("place").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")) - 1
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + within).cast("long").alias("slot"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    return shard(table(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
