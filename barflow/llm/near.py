"""Near duplicates by exact likeness: texts are linked if the Jaccard of their shingle sets is at least ``LEAST``.

A node is a distinct set of shingles (words, A-Z in lower case), so copies cost nothing. The first candidates are those of
``op4_simhash``: SimHash fingerprints that pigeonring chains find within its four bits. That is not all that is alike, so
further ones come from 32 min-hashes for each of ``words``, in bands of four. At a likeness of 0.8 two nodes miss all 32 bands of four words with a
probability of 5e-8, and more alike ones with less. What meets under a band's key is searched by the sketches (two bits
of each min-hash), which a pair of 0.8 fails less often than once in a million; the search gives at most n - 1 candidates for n
nodes, and candidates that are connected form a cluster. Every link is inside a cluster.

Each cluster then gets its texts, once, and all its pairs are compared by their whole sets; links that connect
what is connected are kept, at most n - 1. A cluster of more than ``BLOCK`` shingles is dealt into blocks, and each pair
of blocks is a task's own, so no cluster has to fit one machine.

Blank texts, NULL included, are one node; a text of fewer words than a shingle is one shingle. Rows take part under
their node, whatever their doc_id, NULL and repeated ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import mix, stage
from barflow.llm.graph import components
from barflow.llm.simhash import bits, links, shingles

LEAST = (4, 5)
BAND = 4
BLOCK = 1 << 19
#: Marks of rows that are broadcast, 8 bytes each; rows are shuffled beside more.
SENT = 4_000_000


def sketch(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """From distinct shingle hashes: ``words`` words of bits (a plane of low bits, one of the next), and the band keys."""
    factors = mix(np.arange(1, 32 * words + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * factors).min(axis=0))
    least = mix(least)
    planes = [np.packbits((least >> np.uint64(i) & np.uint64(1)).astype(np.uint8)).view(np.uint64) for i in (0, 1)]
    bands = least.reshape(-1, BAND)
    keys = np.arange(len(bands), dtype=np.uint64)
    for i in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return np.concatenate(planes), keys


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns of a row, the same for repeated rows only."""
    cols = [docs[f"`{n}`"] if "map<" not in kind else F.to_json(docs[f"`{n}`"]) for n, kind in docs.dtypes]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def prints(docs: DataFrame, size: int, words: int) -> DataFrame:
    """mark, doc_id, node, n (shingles), simhash, fp0, ... and keys of every row."""
    names = [f"fp{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, prints_, fps, keys = [], [], [], [], []
            for text in batch.column(2):
                every = shingles(text.as_py(), size)
                hashes = np.unique(every)
                prints_.append(bits(every))
                nodes.append(mix(hashes).sum(dtype=np.uint64))
                counts.append(len(hashes))
                fp, key = sketch(hashes, words)
                fps.append(fp)
                keys.append(key)
            fps = np.array(fps, np.uint64).reshape(-1, words).view(np.int64)
            each = 32 * words // BAND
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(nodes) + 1) * each, each, dtype=np.int32)),
                                            pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(counts, pa.int64()),
                                              pa.array(np.array(prints_, np.uint64).view(np.int64)), *[pa.array(np.ascontiguousarray(fps[:, w])) for w in range(words)], keys],
                                             names=["mark", "doc_id", "node", "n", "simhash", *names, "keys"])

    schema = "mark long, doc_id long, node long, n long, simhash long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>"
    return docs.select(row_mark(docs).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def like(sets: list[np.ndarray], ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among all pairs of the sets (sorted distinct hashes)."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    members, begins = owner[order], np.r_[0, np.cumsum(np.bincount(token))]
    starts, label, out = np.r_[0, np.cumsum(sizes)], np.arange(len(sets)), []
    for x in range(len(sets)):
        mine = token[starts[x] : starts[x + 1]]
        common = np.bincount(np.concatenate([members[begins[t] : begins[t + 1]] for t in mine]), minlength=len(sets))
        alike = np.flatnonzero((LEAST[1] * common >= LEAST[0] * (sizes + sizes[x] - common)) & (label != label[x]))
        if len(alike):
            groups, first = np.unique(label[alike], return_index=True)
            out += [(int(ids[x]), int(ids[y])) for y in alike[first]]
            label[np.isin(label, groups)] = label[x]
    return out


def confirmed(members: DataFrame, size: int) -> DataFrame:
    """From (root, low, high, node, text), a node's text in each pair of blocks it is in: links (a, b) of exact likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}

        def flush():
            found = like(list(held.values()), np.array(list(held), np.int64)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *group, node, text in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4)):
                if group != current:
                    yield flush()
                    current, held = group, {}
                if node not in held:  # repeated rows
                    held[node] = np.unique(shingles(text.as_py(), size))
        yield flush()

    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.select("root", "low", "high", "node", "text").repartition(n, "root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    return dealt.mapInArrow(run, "a long, b long")


def sent(marks: DataFrame) -> DataFrame:
    """Marks as the small side of a join with rows: broadcast up to ``SENT`` of them, so that the rows stay where they are."""
    return F.broadcast(marks) if marks.count() <= SENT else marks


def candidates(distinct: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between nodes to be compared: by SimHash and pigeonring, and by bands of min-hashes.

    Nodes of one fingerprint are linked to the smallest of them, which alone takes part in the search.
    """
    prints = distinct.select("id", "simhash")
    least = stage(prints.groupBy("simhash").agg(F.min("id").alias("least")))
    same = prints.join(least, "simhash").filter(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    return links(least.select(F.col("simhash").alias("fp0"), F.col("least").alias("id"))).union(same).union(links(distinct, words))


def grouped(docs: DataFrame, size: int, words: int = 4) -> DataFrame:
    """mark, doc_id, node, n, simhash, fp0, ... and root (the smallest node it is connected to) of every row of ``docs``.

    Texts are shuffled only of the rows that a cluster needs, while the marks of these can be broadcast.
    """
    rows = stage(prints(docs, size, words))
    names = [f"fp{w}" for w in range(words)]
    # A node's rows differ in order and repeats of shingles at most; one of their SimHash values stands for it.
    distinct = rows.groupBy("node", "n", *names, "keys").agg(F.min("mark").alias("mark"), F.min("simhash").alias("simhash")).withColumnRenamed("node", "id")
    distinct = stage(distinct)
    star = components(candidates(distinct, words)).withColumnRenamed("node", "id")
    both = star.union(star.select("root", "root").distinct())
    clusters = stage(distinct.select("id", "n", "mark").join(both, "id"))
    blocks = clusters.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = clusters.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("IF(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x <> mine))")))
    dealt = stage(dealt.select("mark", "root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.col("id").alias("node")))
    needed = docs.select(row_mark(docs).alias("mark"), "text").join(sent(clusters.select("mark")), "mark", "left_semi")
    texts = needed.join(dealt, "mark")
    roots = components(stage(confirmed(texts, size)))
    return stage(rows.drop("keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
