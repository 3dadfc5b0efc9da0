"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Each shingle of five words (a shorter text is one shingle) is hashed once; the top bits of the hash choose one of
``BINS`` bins and the rest competes for the bin's minimum. An empty bin takes the value of the first filled bin on
its own probe sequence, a fixed permutation of the bins that is the same for every text, so equal bins stay
comparable and any number of empty bins is filled. Of each bin, salted by its number, the lowest ``LOW`` bits are
kept, one hexadecimal digit. Two fingerprints agree by chance in 2^-LOW of the bins; likeness subtracts that and is cut to 0..1.

NULL, empty and blank texts have the empty fingerprint: like each other (1), unlike any other (0). Texts are read
whole. Documents are ordered by doc_id with NULL last, then by a hash of the text; the last is followed by the
first, and a single document by itself. Only doc_id and text are read.

The next document's text is needed beside one's own, in order. Documents go once, whole, to the bin of their
doc_id between quantiles of all ids and are sorted there; the first document of each bin is sent to the bin
before it as well. Tasks then stream over sorted rows and hold one document back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import CHUNK_BYTES, mix, rolling, slices, strings, table, word_hashes, words
from barflow.llm.registry import query

SHINGLE = 5
BINS = 512
LOW = 4

#: Row i: the order in which an empty bin i asks the others (an affine permutation with an odd factor).
_BITS = BINS.bit_length() - 1
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64))
_PROBES = ((_SEEDS[:BINS, None] | np.uint64(1)) * np.arange(BINS, dtype=np.uint64) + _SEEDS[BINS:, None]).astype(np.int64) & (BINS - 1)

_SALT = mix(np.arange(BINS, dtype=np.uint64) + np.uint64(1 << 32))


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty bins; at least one is filled."""
    rest = np.flatnonzero(~filled)
    at = 0
    for width in (8, 56, BINS - 64):
        if not len(rest):
            break
        asked = _PROBES[rest, at : at + width]
        hit = filled[asked]
        first = hit.argmax(axis=1)
        got = hit[np.arange(len(rest)), first]
        values[rest[got]] = values[asked[got, first[got]]]
        rest, at = rest[~got], at + width
    return values


def sketches(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The kept bits of every bin, a row per text; 255 throughout where a text has no word."""
    out = np.full((len(column), BINS), 255, np.uint8)
    for lo, hi in slices(column):
        data, offsets = strings(column[lo:hi])
        starts, ends, first = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        grams = rolling(hashes, size)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            own = grams[a : b - size + 1] if b - a >= size else rolling(hashes[a:b], b - a)
            own = np.sort(own)  # by bin, then value
            bins = (own >> np.uint64(64 - _BITS)).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
            values[bins[heads]] = own[heads]
            filled[bins[heads]] = True
            # A salt per bin: copies of one value in many bins must not agree by chance all at once.
            out[lo + i] = mix(densify(values, filled) ^ _SALT) & np.uint64((1 << LOW) - 1)
    return out


def packed(sketch: np.ndarray) -> str:
    """One hexadecimal digit per bin; empty for a text without words."""
    return "" if sketch[0] == 255 else (sketch[0::2] << 4 | sketch[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a[0] == 255 or b[0] == 255:
        return float(a[0] == b[0])
    chance = 2.0**-LOW
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(s) for s in sketches(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bin(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(
        (n + step <= len(bounds)) & (F.get(held, n + step - 1) <= key), step).otherwise(0))


def in_order(docs: DataFrame) -> DataFrame:
    """(bin, ahead, doc_id, text): partitions sorted by bin and document, each bin followed by the head of the next.

    The bounds are quantiles of doc_id, four to a shuffle partition; they and one head per bin are all that is
    collected or broadcast.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(key.alias("key"))
    found = ids.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0] or []
    bounds = sorted(set(found))
    heads = ids.groupBy(_bin(F.col("key"), bounds).alias("bin")).agg(F.min("key").alias("key")).orderBy("bin").collect()
    own = docs.select(_bin(key, bounds).alias("bin"), F.lit(False).alias("ahead"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if heads:
        before = spark.createDataFrame([(h["key"], heads[i - 1]["bin"]) for i, h in enumerate(heads)], "head long, before int")
        copies = own.join(F.broadcast(before), F.col("key") == F.col("head"))
        own = own.union(copies.select(F.col("before").alias("bin"), F.lit(True).alias("ahead"), "key", "doc_id", "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "bin").sortWithinPartitions("bin", "ahead", "key", F.xxhash64("text"), "text").select("bin", "ahead", "doc_id", "text")


def compare_next(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (see op1), and the likeness to it and to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(ids, texts, prints, pairs):
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in pairs]
        others = sketches(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([len(texts[i]) for i, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([packed(prints[i]) for i, _ in pairs], pa.string()), pa.array([packed(o) for o in others], pa.string()),
            pa.array([likeness(prints[i], o) for (i, _), o in zip(pairs, others)], pa.float64()),
            pa.array([likeness(prints[i], prints[j]) for i, j in pairs], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose successor is still to come: bin, ahead, doc_id, text, sketch
        for batch in batches:
            for lo, hi in slices(batch.column(3), 2 * CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                bins, ahead, ids = (part.column(i).to_pylist() for i in range(3))
                texts = [t or "" for t in part.column(3).to_pylist()]
                prints = sketches(part.column(3))
                if last is not None:
                    bins, ahead, ids, texts = [last[0], *bins], [last[1], *ahead], [last[2], *ids], [last[3], *texts]
                    prints = np.concatenate([last[4][None], prints])
                pairs = [(i, i + 1) for i in range(len(bins) - 1) if not ahead[i] and bins[i] == bins[i + 1]]
                if pairs:
                    yield rows(ids, texts, prints, pairs)
                last = bins[-1], ahead[-1], ids[-1], texts[-1], prints[-1]

    return in_order(docs).mapInArrow(run, schema)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against its edited form and against the next document."""
    return compare_next(table(spark, sf_dir))
