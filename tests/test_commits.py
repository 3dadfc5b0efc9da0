"""Append and keyed tables under replay and failure, event suppression by id, and the fitted pipeline."""

import os

import pytest
from pyspark.sql import functions as F

from barflow.operators import ticks as T
from barflow.operators.fitted import FeaturePipeline, FeaturePipelineModel
from barflow.plans import domain as D
from barflow.plans.flows import IDS, identified
from barflow.sources.commits import AppendTable, KeyedTable, append_handler, upsert_handler
from barflow.streaming import stateful
from tests.test_streaming import drain, same

SCHEMA = "id long, v long, at timestamp_ntz"


def _rows(spark, *rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "id long, v long").withColumn("at", F.make_dt_interval(F.col("v").cast("int")) + F.lit("2024-01-01").cast("timestamp_ntz"))


def _got(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_replayed_appends_add_nothing(spark, tmp_path):
    t = AppendTable(spark, str(tmp_path / "a"), SCHEMA, "at", 2)
    assert t.read().collect() == [] and set(t.read().columns) == {"id", "v", "at", "epoch", "day"}
    assert t.append(_rows(spark, (1, 1), (2, 2), (2, 2)), 0)
    assert not t.append(_rows(spark, (1, 1), (2, 2), (2, 2)), 0)
    assert t.append(_rows(spark, (1, 1)), 7) and t.append(_rows(spark), 8) and not t.append(_rows(spark, (9, 9)), 8)
    # An attempt that wrote but did not commit: not read, and replaced.
    _rows(spark, (5, 5)).withColumn("day", F.date_format("at", "yyyy-MM-dd")).write.partitionBy("day").parquet(str(tmp_path / "a/data/epoch=9"))
    assert _got(t.read()) == [(1, 1), (1, 1), (2, 2), (2, 2)]
    assert t.append(_rows(spark, (6, 6)), 9)
    assert _got(t.read()) == [(1, 1), (1, 1), (2, 2), (2, 2), (6, 6)]
    assert t.read().filter("day = '2024-01-07'").count() == 1


def _newest(rows):
    return rows.groupBy("id").agg(F.max("v").alias("v"), F.max_by("at", "v").alias("at"))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = tmp_path / "k"
    t = KeyedTable(spark, str(path), SCHEMA, ["id"], _newest, 8)
    assert t.read().collect() == []
    first = t.upsert(_rows(spark, *[(i, i) for i in range(40)]), 0)
    assert first == list(range(8)) and len(os.listdir(path / "data/epoch=0")) >= 8
    touched = t.upsert(_rows(spark, (3, 100), (3, 50), (4, 1)), 1)
    folders = [f for f in os.listdir(path / "data/epoch=1") if f.startswith("_bucket=")]
    assert 1 <= len(touched) <= 2 and sorted(folders) == sorted(f"_bucket={b}" for b in touched)
    want = sorted([(i, i) for i in range(40) if i != 3] + [(3, 100)])
    assert _got(t.read()) == want
    assert t.upsert(_rows(spark, (3, 999)), 1) == [] and t.upsert(_rows(spark, (3, 999)), 0) == [] and t.upsert(_rows(spark), 2) == []
    _rows(spark, (3, 777)).write.parquet(str(path / "data/epoch=3/_bucket=0"))  # never committed
    assert _got(t.read()) == want
    assert len(t.upsert(_rows(spark, (None, 1), (3, 5), (77, 7)), 3)) >= 1
    assert sorted((-1 if r.id is None else r.id, r.v) for r in t.read().collect()) == sorted([*want, (-1, 1), (77, 7)])


def test_streams_into_both_tables(spark, sf, tmp_path):
    ticks = D.ticks(spark, sf).select("symbol", "ts", "event_id", "price")
    source, schema = str(tmp_path / "src"), ", ".join(f"{c} {k}" for c, k in ticks.dtypes)
    ticks.repartition(3, "event_id").write.parquet(source)
    keyed = KeyedTable(spark, str(tmp_path / "k"), schema, ["symbol"], T.latest, 4)
    added = AppendTable(spark, str(tmp_path / "a"), schema, "ts", 1, "month")
    for handler in (upsert_handler(keyed), append_handler(added)):
        rows = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(source)
        for replay in range(2):  # a new checkpoint gives the same epochs again
            q = rows.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / f"cp{id(handler)}{replay}")).start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()
    same(keyed.read(), T.latest(ticks), "symbol", "ts", "event_id", "price")
    same(added.read(), ticks, "symbol", "ts", "event_id", "price")


def test_event_ids_in_batch_and_stream(spark, sf, tmp_path):
    events = identified(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    want = T.deduplicate_events(events, IDS, order=("ts", "n"))
    plain, last = 0, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.n)):
        key = r.event_id or r.correlation_id or r.payload_id
        if not key or key not in last or (r.ts - last[key]).total_seconds() >= 300:
            plain += 1
            last[key] = r.ts
    assert want.count() == plain < events.count()
    path = str(tmp_path / "ev")
    cuts = [0, *(x * 86_400 // 3 for x in (1, 2, 3))]
    for a, b in zip(cuts, cuts[1:]):
        second = F.pmod(F.unix_timestamp("ts"), F.lit(86_400))
        events.filter((second >= a) & (second < b)).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    same(drain(stateful.deduplicate_events(rows.withWatermark("ts", "10 minutes"), IDS)), want, "ts", T.event_key(*IDS).alias("key"))


def test_late_events_change_nothing(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "event_id string, correlation_id string, ts timestamp"
    batches = [[("a", None, "2024-01-01 10:00:00"), ("", "a", "2024-01-01 10:04:59"), (None, None, "2024-01-01 10:00:00")],
               [("a", "x", "2024-01-01 09:00:00"), (None, "a", "2024-01-01 10:05:00"), (None, "", "2024-01-01 10:00:00")],
               [("a", None, "2024-01-01 10:05:01"), ("b", "a", "2024-01-01 12:00:00")], [("a", None, "2024-01-01 12:00:00")]]
    for b in batches:
        spark.createDataFrame(b, "event_id string, correlation_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "1 minute")
    got = drain(stateful.deduplicate_events(rows)).select("event_id", "correlation_id", F.date_format("ts", "HH:mm:ss").alias("at"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("a", None, "10:00:00"), (None, None, "10:00:00"), (None, "", "10:00:00"), (None, "a", "10:05:00"), ("b", "a", "12:00:00"), ("a", None, "12:00:00")], key=repr)


def test_fitted_pipeline(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0, 10, None), (2, 3.0, 20, None), (3, nan, 60, None), (4, inf, None, None), (5, None, 40, None)], "id long, a double, b int, c double")
    model = FeaturePipeline(idCols=["id"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = FeaturePipelineModel.load(str(tmp_path / "m"))
    other = spark.createDataFrame([(7, "x", 99.0, -5.0), (8, "y", -inf, 2.0), (None, "z", 35.0, nan)], "id long, extra string, b double, a double")
    for m in (model, loaded):
        out = m.transform(other)
        assert out.columns == ["id", "a", "b", "c"]
        assert sorted(map(tuple, out.collect()), key=repr) == sorted([(7, 1.0, 60.0, 0.0), (8, 2.0, 30.0, 0.0), (None, 2.0, 35.0, 0.0)], key=repr)
    assert model.transform(other.limit(0)).collect() == [] and model.transform(df.drop("a", "b")).first()[1:] == (2.0, 30.0, 0.0)
    with pytest.raises(Exception, match="absent"):
        FeaturePipeline(["absent"]).fit(df)
