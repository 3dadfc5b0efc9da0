"""Log lines: JSON with several spellings of each field, or one of three text shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("timestamp string, time string, `@timestamp` string, level string, service string, component string, logger string, message string, msg string, "
          "event string, correlation_id string, request_id string, error string, error_type string, error_message string, exc_info string")

# The text shapes, tried in this order.
BRACKETED = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s+(\w+):\s+(.+)"
DATED = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\w+)\s+(.+)"
PLAIN = r"^(\w+):\s+(.+)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they came from and its stem as default service."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return d.withColumn("stem", F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1))


def parse_logs(lines: DataFrame, line: str = "line", stem: str = "stem") -> DataFrame:
    """Structured entries; lines of no known shape are dropped. Extra columns pass through."""
    keep = [c for c in lines.columns if c not in (line, stem)]
    d = lines.withColumns({"_l": F.col(line), "_j": F.when(F.ltrim(F.col(line)).startswith("{"), F.from_json(line, SCHEMA))})
    is_json = F.col("_j").isNotNull() & F.coalesce(F.expr("try_parse_json(_l) IS NOT NULL"), F.lit(False))
    j = lambda n: F.col("_j").getField(n)
    nested = F.when(F.ltrim(j("error")).startswith("{"), F.from_json(j("error"), "type string, message string, stack string"))
    shape = F.when(F.col("_l").rlike(BRACKETED), 1).when(F.col("_l").rlike(DATED), 2).when(F.col("_l").rlike(PLAIN), 3)
    d = d.withColumns({"_k": F.when(is_json, 0).otherwise(shape), "_n": nested}).filter(F.col("_k").isNotNull())
    k = F.col("_k")

    def text(group1, group2, group3):
        """Group number to take from each text shape; None where the shape has no such part."""
        out = None
        for n, (pattern, g) in enumerate(((BRACKETED, group1), (DATED, group2), (PLAIN, group3)), 1):
            if g:
                piece = F.regexp_extract("_l", pattern, g)
                out = F.when(k == n, piece) if out is None else out.when(k == n, piece)
        return out

    filled = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c])
    stamp = F.when(k == 0, filled(j("timestamp"), j("time"), j("@timestamp"))).otherwise(text(1, 1, None))
    typed = lambda a, flat: F.when(F.col("_n").isNotNull(), F.col(f"_n.{a}")).otherwise(j(flat))
    return d.select(
        *keep, F.try_to_timestamp(F.regexp_replace(stamp, "Z$", "")).cast("timestamp_ntz").alias("timestamp"),
        F.upper(F.when(k == 0, F.coalesce(j("level"), F.lit("INFO"))).otherwise(text(2, 2, 1))).alias("level"),
        F.coalesce(F.when(k == 0, j("service")), F.col(stem)).alias("service"), F.when(k == 0, filled(j("component"), j("logger"))).alias("component"),
        F.when(k == 0, F.coalesce(filled(j("message"), j("msg"), j("event")), F.lit(""))).otherwise(text(3, 3, 2)).alias("message"),
        F.when(k == 0, j("event")).alias("event"), F.when(k == 0, filled(j("correlation_id"), j("request_id"))).alias("correlation_id"),
        F.when(k == 0, typed("type", "error_type")).alias("error_type"), F.when(k == 0, typed("message", "error_message")).alias("error_message"),
        F.when(k == 0, typed("stack", "exc_info")).alias("stack_trace"))
