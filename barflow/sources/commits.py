"""Tables whose writes happen once, also when a micro-batch is replayed.

Data of a write lies in a folder of its epoch; the write counts once its epoch stands in the log, which Spark commits last. What an
attempt left behind before that is overwritten by the next one and never read; an epoch in the log is not written again.

* ``AppendTable``  rows are added, partitioned by day.
* ``KeyedTable``   rows are dealt into buckets by the hash of their key. A write reads and rewrites only the buckets
  that its batch touches; the log's newest entry tells the epoch of each bucket, so a reader takes one folder a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.session import stage


class _Logged:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, epoch long").parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, epoch long")

    def _commit(self, rows: list[tuple], schema: str, epoch: int) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/epoch={epoch}")


class AppendTable(_Logged):
    """Rows by day, or by month where days are small; ``files`` files for each of them in a write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str, files: int = 8, every: str = "day"):
        super().__init__(spark, path)
        self.schema, self.time, self.files, self.every = schema, time, files, every

    def append(self, df: DataFrame, epoch: int) -> bool:
        """Add the rows of an epoch; False, and nothing is done, if it was added before."""
        if not self._log("rows long").filter(F.col("epoch") == epoch).isEmpty():
            return False
        d = df.withColumn(self.every, F.date_format(self.time, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[self.every]))
        dealt = d.repartition(self.every, F.pmod(F.xxhash64(*df.columns), F.lit(self.files)))
        target = f"{self.path}/data/epoch={epoch}"
        dealt.write.mode("overwrite").partitionBy(self.every).parquet(target)
        self._commit([(self.spark.read.schema(self.schema).parquet(target).count(),)], "rows long", epoch)
        return True

    def read(self) -> DataFrame:
        """The rows of all epochs in the log, with epoch and the day or month."""
        log = self._log("rows long").filter("rows > 0")
        if log.isEmpty():
            return self.spark.createDataFrame([], f"{self.schema}, epoch long, {self.every} string")
        rows = self.spark.read.schema(f"{self.schema}, epoch long, {self.every} string").parquet(f"{self.path}/data")
        return rows.join(log.select("epoch"), "epoch", "left_semi")


class KeyedTable(_Logged):
    """One state per key; ``merge`` makes it from stored rows and new ones of the same columns."""

    STATE = "bucket int, written long"

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        super().__init__(spark, path)
        self.schema, self.keys, self.merge, self.buckets = schema, keys, merge, buckets

    def _state(self) -> tuple[int, dict[int, int]]:
        """The newest epoch and the epoch of each bucket: a number for each bucket comes to the driver."""
        log = self._log(self.STATE)
        last = log.agg(F.max("epoch")).first()[0]
        rows = [] if last is None else log.filter(F.col("epoch") == last).collect()
        return (-1 if last is None else last), {r.bucket: r.written for r in rows if r.bucket >= 0}

    def _rows(self, state: dict[int, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/epoch={e}/_bucket={b}" for b, e in sorted(state.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, epoch: int) -> list[int]:
        """Merge the rows of an epoch into the buckets they touch, which are returned; none if the epoch came before."""
        last, state = self._state()
        if epoch <= last:
            return []
        columns = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = stage(batch.select(*columns).withColumn("_bucket", bucket))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # numbers of buckets
        if touched:
            rows = self.merge(self._rows(state, touched).unionByName(new.drop("_bucket"))).select(*columns).withColumn("_bucket", bucket)
            rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/epoch={epoch}")
        state |= dict.fromkeys(touched, epoch)
        self._commit([*state.items()] or [(-1, epoch)], self.STATE, epoch)
        return touched

    def read(self) -> DataFrame:
        return self._rows(self._state()[1])


def append_handler(table: AppendTable, rows: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``rows`` of each micro-batch, once."""

    def handle(batch: DataFrame, epoch: int) -> None:
        table.append(rows(batch), epoch)

    return handle


def upsert_handler(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch into its buckets, once."""

    def handle(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, epoch)

    return handle
