"""Shared pieces: reading tables, staging in the cluster's shared folder, words and hashes in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task holds as arrays at a time (a longer single text is taken whole).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barflow-llm-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/barflow-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- inside tasks

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 256 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, one row at least."""
    _, offsets = strings(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word (n + 1 entries)."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    if len(data):
        edges = offsets[offsets < len(data)]
        before[edges] = True
        before[0] = True
        after[-1] = True
        edges = offsets[1:-1]
        after[edges[edges > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum of table entries by byte and place, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    entry = _TABLE[((place & 255) << 8) + data[np.flatnonzero(~_SPACE[data])]]
    if int(lengths.max()) > 256:
        entry *= (2 * (place >> 8) + 1).astype(np.uint64)
    return mix(np.add.reduceat(entry, firsts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(values: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values (len - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for i in range(1, k):
        out *= np.uint64(base)
        out += values[i : i + n]
    return mix(out)
