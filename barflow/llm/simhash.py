"""Near duplicates by SimHash, with pigeonring filtering of candidates.

A fingerprint bit is set if more than half of the XXH64 hashes of a text's shingles (words, A-Z in lower case)
have it set. Fingerprints within ``BITS`` bits of each other are linked; documents of linked fingerprints form
a component, named by its smallest doc_id.

Pigeonring: cut the 64 bits into five segments on a ring. If two fingerprints differ in at most four bits, there
is a segment from which every chain of l consecutive segments has at most floor(l * 4 / 5) differing bits: none
in the first, one in the first two, two in three, three in four, four in all. The first two conditions are the
join key: a segment as it is, and the next one without a group of two or three bits, for every start and every
group. What meets under a key must satisfy all chains before all 64 bits are compared. Within a key, links are
found by a search that leaves out what it has reached, so a group of n fingerprints gives at most n - 1 links, not
all pairs. Only distinct fingerprints take part: copies cost nothing.

With ``words`` above 1 the likeness itself decides (see ``barflow.llm.near``): fingerprints and chains give its first
candidates, and a row's words are a sketch of min-hashes, searched under the keys of their bands.

NULL, empty and blank texts have fingerprint zero and are linked like any other. Texts are read whole. Repeated
rows come back as often as they came. A row with a NULL doc_id takes part under no id: it gets its fingerprint
and the component of its fingerprint's other documents, or NULL if there are none. Only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import mix, stage, table
from barflow.llm.graph import components
from barflow.llm.registry import query

SHINGLE = 4
SEED = 42
BITS = 4
#: Bits of the five segments, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
#: Bits of a segment that are left out together.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10), (11, 12))
#: Part of the min-hashes in which the sketches of a candidate differ at most; 0.15 is expected at a likeness of 0.8.
APART = 44 / 128


def shingles(text: str | None, size: int) -> np.ndarray:
    """The XXH64 of each shingle in order; one of no words for a blank text, one of all words for a short one."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six blanks split
    n = max(1, len(parts) - size + 1)
    line = b" ".join(parts)
    starts = [0, *np.cumsum([len(w) + 1 for w in parts]).tolist()]
    last = min(size, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[starts[i] : max(0, starts[i + last] - 1)], SEED) for i in range(n)], np.uint64)


def bits(hashes: np.ndarray) -> np.uint64:
    """The 64 bits that more than half of the hashes have set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def simhash(text: str | None, size: int = SHINGLE, words: int = 1) -> np.ndarray:
    """The fingerprint of a text, ``words`` times 64 bits."""
    if not (text or "").encode().split():
        return np.zeros(words, np.uint64)
    hashes = shingles(text, size)
    return np.array([bits(hashes if word == 0 else mix(hashes ^ np.uint64(word))) for word in range(words)], np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id and fp0, fp1, ... (64 bits each as a signed number) of every row."""
    names = [f"fp{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(text.as_py(), size, words) for text in batch.column(1)], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(words)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def chain_keys(fps: list[Column]) -> Column:
    """All keys of a fingerprint: word and start, group left out, the start's segment, and the rest of the next."""
    keys = []
    for w, fp in enumerate(fps):
        part = [F.shiftrightunsigned(fp, sum(SEGMENTS[:i])).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1)) for i in range(len(SEGMENTS))]
        for i in range(len(SEGMENTS)):
            j = (i + 1) % len(SEGMENTS)
            for g, group in enumerate(GROUPS):
                rest = part[j].bitwiseAND(F.lit(((1 << SEGMENTS[j]) - 1) & ~sum(1 << bit for bit in group)))
                keys.append(F.lit(((w * len(SEGMENTS) + i) * 8 + g) << 32).cast("long").bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(rest))
    return F.array(*keys)


def _near(fps: np.ndarray, one: np.ndarray, start: int) -> np.ndarray:
    """Which fingerprints (a row each) are linked to ``one``: all chains from ``start``, or the min-hashes of wide ones."""
    apart = fps ^ one
    if fps.shape[1] > 1:
        half = fps.shape[1] // 2  # two planes of bits
        return np.bitwise_count(apart[:, :half] | apart[:, half:]).sum(axis=1) <= APART * 64 * half
    apart, ok, mask = apart[:, 0], np.ones(len(fps), bool), np.uint64(0)
    for chain in range(1, len(SEGMENTS) + 1):
        i = (start + chain - 1) % len(SEGMENTS)
        mask |= np.uint64(((1 << SEGMENTS[i]) - 1) << sum(SEGMENTS[:i]))
        ok &= np.bitwise_count(apart & mask) <= chain * BITS // len(SEGMENTS)
    return ok


def _search(fps: np.ndarray, ids: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect what is connected under one key by chains from ``start``."""
    links, rest = [], np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _near(fps[rest], fps[at], start)
            if near.any():
                found = rest[near]
                links += [(int(ids[at]), int(ids[x])) for x in found]
                front += found.tolist()
                rest = rest[~near]
    return links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, fp0, ...) sorted by key to links (a, b). A key's fingerprints are distinct, a few bytes each."""
    held: list[np.ndarray] = []

    def flush(keys, ids, *fps):
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
        table, found = np.stack(fps, axis=1).view(np.uint64), []
        for a in np.flatnonzero(np.diff(cuts) > 1):
            lo, hi = cuts[a], cuts[a + 1]
            found += _search(table[lo:hi], ids[lo:hi], int(keys[lo] >> 35) % len(SEGMENTS))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        cols = [np.concatenate(pair) for pair in zip(held, cols)] if held else cols
        if len(cols[0]):
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            held = [c[cut:].copy() for c in cols]
            yield flush(*[c[:cut] for c in cols])
    if held:
        yield flush(*held)


def links(distinct: DataFrame, words: int = 1) -> DataFrame:
    """From distinct fingerprints (fp0, ..., id; keys if wide): links (a, b) between ids, enough to connect all that are linked."""
    names = [f"fp{w}" for w in range(words)]
    keys = distinct.select(F.explode(chain_keys([F.col("fp0")]) if words == 1 else F.col("keys")).alias("key"), "id", *names)
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(_runs, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, fp0, ..., component_id of every row of ``docs``."""
    names = [f"fp{w}" for w in range(words)]
    if words > 1:
        from barflow.llm import near

        rows = near.grouped(docs, size, words)
        least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return rows.join(least, "root").select("doc_id", *names, "component_id")
    prints = stage(fingerprints(docs, size, words))
    distinct = stage(prints.groupBy(*names).agg(F.min("doc_id").alias("id")).filter(F.col("id").isNotNull()))
    roots = components(links(distinct, words))
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        *[F.col(n).alias(f"of_{n}") for n in names], F.coalesce("root", "id").alias("component_id"))
    same = [F.col(n) == F.col(f"of_{n}") for n in names]
    return prints.join(named, same, "left").select("doc_id", *names, "component_id")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
