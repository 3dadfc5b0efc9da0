"""Substring dedup on a compacted De Bruijn graph of words.

Edges are the 20-word windows (each joins its first and last 19 words). A word is removed if a window that covers
it also starts earlier, in the order of doc_id (NULL last) and start, judged on the input.

Compaction. Windows whose smallest hashed six-word sequence (seed, the leftmost if equal) is the same occurrence
form a run, a path of up to 15 edges. Equal windows have equal seeds, so all occurrences of an edge meet under
one seed. A seed under which all runs are equal does not branch: the run of the first source coordinate stays, the
others repeat it as a whole, without looking at edges. Only where runs differ under a seed does the graph branch
there; the first occurrence of each of these different runs is joined with its text and opened into its edges, and
these are grouped again. One run stands for up to 15 edges, and what most texts have, runs that occur once, ends
after the first grouping. The last join brings the repeated paths of a document, as source coordinates, back to
its text, where neighbouring ones unite.

Equality is that of two independent 64-bit hashes (seed and run, or two of the window). Before they are shuffled,
equal runs of one batch are reduced to the first; the others are known to repeat and are dealt out by their own
coordinate, so a passage that a third of all documents share does not meet in one task.

NULL and empty texts have no words and no removals. Documents are told apart by doc_id and a 64-bit hash of the text, and
are in order of both, NULL ids last: rows with the same doc_id and text count as one document and are all treated as
it; rows with the same doc_id (or none) and different texts are documents of their own, the one with the smaller hash first. Texts
are read whole; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import mix, rolling, slices, stage, strings, table, word_hashes, words
from barflow.llm.registry import query

WINDOW = 20
SEED_WORDS = 6
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


class Spans:
    """Hashes of any span of a list of hashed words by differences of prefix sums (arithmetic modulo 2^64)."""

    def __init__(self, hashes: np.ndarray, salt: int):
        n = len(hashes)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), _BASE, np.uint64)])[:n]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), _INVERSE, np.uint64)])[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)) * powers, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def seeds_of_windows(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive seeds the place of its smallest, the leftmost if equal."""

    def better(a, b):
        return np.where(seeds[b] < seeds[a], b, a)

    at, have = np.arange(len(seeds)), 1
    while 2 * have <= width:
        at, have = better(at[:-have], at[have:]), 2 * have
    rest = width - have
    return better(at[: len(at) - rest], at[rest:]) if rest else at


def runs_of(column: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of a chunk of texts: text number, first word, number of windows, seed, hash of the whole run."""
    data, offsets = strings(column)
    starts, ends, first = words(data, offsets)
    n = len(starts)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = word_hashes(data, starts, ends)
    seeds = rolling(hashes, SEED_WORDS)
    least = seeds_of_windows(seeds, window - SEED_WORDS + 1)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    valid = text[: n - window + 1] == text[window - 1 :]
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    a = np.flatnonzero(begins)
    # A run ends where the next begins or where a window is not within one text.
    stops = np.flatnonzero(np.r_[begins | ~valid, True])
    b = stops[np.searchsorted(stops, a, "right")]
    size = b - a
    whole = Spans(hashes, 1).of(a, b + window - 1)
    run = mix(whole + (least[a] - a).astype(np.uint64))
    return text[a], a - first[text[a]], size, seeds[least[a]], run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids with NULL as the largest number, and which are NULL."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False), null


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text) to one row per run; repeated tells that an equal run of the batch starts earlier."""
    for batch in batches:
        ids, null = _ids(batch.column(0))
        marks = batch.column(1).to_numpy(zero_copy_only=False)
        parts = []
        for lo, hi in slices(batch.column(2)):
            text, pos, size, seed, run = runs_of(batch.column(2)[lo:hi])
            parts.append((text + lo, pos, size, seed, run))
        if not parts:
            continue
        text, pos, size, seed, run = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((pos, marks[text], ids[text], null[text], run, seed))
        text, pos, size, seed, run = text[order], pos[order], size[order], seed[order], run[order]
        head = np.r_[True, (seed[1:] != seed[:-1]) | (run[1:] != run[:-1])] if len(seed) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, int)
        doc, mark, none = ids[text], marks[text], null[text]
        repeated = (doc != doc[lead]) | (mark != mark[lead]) | (none != none[lead]) | (pos != pos[lead])
        own = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mark.view(np.uint64)) + pos.astype(np.uint64)
        key = np.where(repeated, mix(own), seed)
        yield pa.RecordBatch.from_arrays([
            pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(doc, pa.int64(), mask=none), pa.array(mark, pa.int64()),
            pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(repeated)],
            names=["key", "run", "doc_id", "mark", "pos", "size", "repeated"])


def _emit_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text, paths) to one row per window of the given paths, with two hashes."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            data, offsets = strings(part.column(2))
            starts, ends, first = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            one, two = Spans(hashes, 1), Spans(hashes, 2)
            counts = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
            paths = part.column(3).flatten()
            pos, size = (paths.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            text = np.repeat(np.repeat(np.arange(hi - lo), counts), size)
            at = np.repeat(pos - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            a = first[text] + at
            yield pa.RecordBatch.from_arrays([
                pa.array(one.of(a, a + WINDOW).view(np.int64)), pa.array(two.of(a, a + WINDOW).view(np.int64)),
                part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(at.astype(np.int32))],
                names=["h1", "h2", "doc_id", "mark", "pos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, paths) to what is left of each text."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, paths in zip(batch.column(1), batch.column(2)):
            parts = (text.as_py() or "").encode().split()  # the six blanks and no others
            n_words.append(len(parts))
            if paths.is_valid and len(paths):
                pos, size = (paths.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                change = np.zeros(len(parts) + 1, np.int64)
                np.add.at(change, pos, 1)
                np.add.at(change, pos + size + WINDOW - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
                parts = [parts[i] for i in np.flatnonzero(stays)]
            n_removed.append(n_words[-1] - len(parts))
            kept.append(b" ".join(parts).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark of the text, by which rows that share a doc_id are told apart and ordered."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def paths_of(docs: DataFrame) -> DataFrame:
    """The first grouping: (doc_id, mark, pos, size, repeated) of runs that repeat an earlier one, or (not repeated) branch."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("doc_id", "mark", "text").mapInArrow(
        _emit_runs, "key long, run long, doc_id long, mark long, pos int, size int, repeated boolean").repartition(n, "key")
    same = Window.partitionBy("key", "run").orderBy(F.col("doc_id").asc_nulls_last(), "mark", "pos")
    seed = Window.partitionBy("key")
    told = runs.withColumn("place", F.rank().over(same)).withColumn("branches", F.min("run").over(seed) != F.max("run").over(seed))
    later = F.col("repeated") | (F.col("place") > 1)
    return told.filter(later | F.col("branches")).select("doc_id", "mark", "pos", "size", later.alias("repeated"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of ``docs``."""
    docs = _documents(docs)
    found = stage(paths_of(docs))

    def by_text(paths: DataFrame) -> DataFrame:
        return paths.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("pos", "size")).alias("paths")).select(
            F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "paths")

    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))
    opened = docs.join(by_text(found.filter(~F.col("repeated"))), same).select("doc_id", "mark", "text", "paths")
    edges = opened.mapInArrow(_emit_edges, "h1 long, h2 long, doc_id long, mark long, pos int")
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "mark", "pos"))
    later = edges.withColumn("place", place).filter(F.col("place") > 1).select("doc_id", "mark", "pos", F.lit(1).alias("size"))
    paths = by_text(found.filter("repeated").select("doc_id", "mark", "pos", "size").union(later))
    return docs.join(paths, same, "left").select("doc_id", "text", "paths").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept string")


@query("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return remove_repeats(table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
