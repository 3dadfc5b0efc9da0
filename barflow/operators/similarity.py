"""Cosine top-k of query vectors over a vector table.

Both sides are cut into blocks, and a pair of blocks is one matrix product in one task. Which pairs are needed is decided
by a metric index with exact bounds. Angles obey the triangle inequality, so from the angle between two pivots, and the
least and the largest angle of a block's vectors to their pivot, follows an angle below which no vector of one block can lie to
one of the other.

1. Pivots are ``PIVOTS`` vectors for each length, those with the smallest hash; each vector goes to its nearest pivot.
2. The vectors of a pivot are counted by cells of their angle to it; cells are joined to blocks of about ``block``
   vectors in order of angle (rings), and a cell that is larger is dealt by hash.
3. Each query block is scored against the block of vectors nearest to it, which gives each query its k-th best so far.
4. Of the other pairs only those are scored whose bound reaches the floor and the lowest k-th best of the query block.

A pair left out holds nothing that could enter a result, so results are those of all pairs. On few blocks all pairs
are scored at once. A block pair's bound is a row of numbers.

A block is one row with its ids and its vectors as bytes. Vectors are shuffled to make the blocks and once more for step 3; the
pairs of step 4 are not shuffled: a task keeps about ``block`` queries and streams the stored blocks past them (a Cartesian product
whose condition is the list of pairs), with the k best of each query so far. What leaves a task is k rows a query, so the shuffle grows
with the vectors while the products, without clusters, grow with their square. Other columns are joined to the final rows.

NULL, empty and zero vectors and those with gaps match nothing; vectors of another length never match. Cosines are rounded to 12
digits, ties go to the smaller vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barflow.session import stage

#: Vectors, or queries, in a block; a task holds one block of each at a time.
BLOCK = 4096
PIVOTS = 128
#: Cells of the angle to a pivot, from 0 to pi.
CELLS = 512
#: Pairs of blocks up to which all are scored without an index.
DIRECT = 64
#: Tasks that score, at least; vectors are cut into parts only where there are fewer blocks of queries.
TASKS = 64
#: Queries and vectors of one product inside a task.
ROWS, COLUMNS = 256, 512
#: Allowed for rounding of angles and products.
SLACK = 1e-6


def _ranked(d: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return d.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def _unit(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and rows of length 1; zero vectors and vectors with gaps are left out."""
    out = {}
    lengths = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for size in set(lengths.tolist()) - {-1, 0}:
        rows = np.flatnonzero(lengths == size)
        m = np.array([np.asarray(v, dtype=float) for v in vectors.iloc[rows]])
        norm = np.sqrt((m * m).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        out[size] = rows[ok], m[ok] / norm[ok, None]
    return out


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """By length, at most ``most`` unit vectors: those with the smallest hash of vec_id. No more than that reaches the driver."""
    sized = vectors.select("embedding", F.size("embedding").alias("size"), F.xxhash64("vec_id").alias("h")).filter("size > 0")
    # Two steps, so that the vectors of one length never meet in one window.
    salted = sized.withColumn("rk", F.row_number().over(Window.partitionBy("size", F.pmod("h", F.lit(64))).orderBy("h"))).filter(F.col("rk") <= most)
    few = salted.withColumn("rk", F.row_number().over(Window.partitionBy("size").orderBy("h"))).filter(F.col("rk") <= most).select("embedding").toPandas()
    return {size: rows for size, (_, rows) in _unit(few["embedding"]).items() if len(rows)} if len(few) else {}


def assigned(df: DataFrame, vector: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add the vector's length, its nearest pivot and the angle to it; rows that match nothing are dropped."""

    def run(batches):
        for pdf in batches:
            parts = []
            for size, (rows, m) in _unit(pdf[vector]).items():
                part = pdf.iloc[rows]
                if size in pivots and len(rows):
                    cosine = m @ pivots[size].T
                    near = cosine.argmax(axis=1)
                    angle = np.arccos(np.clip(cosine[np.arange(len(m)), near], -1, 1))
                else:
                    near, angle = np.full(len(rows), -1), np.zeros(len(rows))
                parts.append(part.assign(_size=size, _pivot=near.astype("int32"), _angle=angle))
            if parts:
                yield pd.concat(parts)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{schema}, _size int, _pivot int, _angle double")


def blocked(df: DataFrame, id_: str, block: int) -> DataFrame:
    """Add ``_block`` (a struct) to assigned rows: rings of about ``block`` vectors around each pivot."""
    cell = F.least(F.floor(F.col("_angle") / math.pi * CELLS), F.lit(CELLS - 1)).cast("int")
    df = df.withColumn("_cell", cell)
    cells = df.groupBy("_size", "_pivot", "_cell").agg(F.count(F.lit(1)).alias("_n"))  # CELLS rows a pivot at most
    before = Window.partitionBy("_size", "_pivot").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ring", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block)).withColumn("_parts", F.ceil(F.col("_n") / block))
    cells = stage(cells)  # its size is known then, so that the vectors are not shuffled for this join
    dealt = df.join(cells, ["_size", "_pivot", "_cell"])
    part = F.pmod(F.xxhash64(id_), F.col("_parts"))
    return dealt.withColumn("_block", F.struct(F.col("_size").alias("size"), F.col("_pivot").alias("pivot"), F.col("_ring").alias("ring"), part.alias("part"))).drop("_cell", "_n", "_ring", "_parts")


def packed(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """One row for each ``_block``: size, angles and number of its vectors, ids, rows (``_row``) and vectors as bytes."""
    types, keys = dict(df.dtypes), ["size", "pivot", "ring", "part"]

    def pack(t: pa.Table) -> pa.Table:
        values = t[vector].combine_chunks().flatten()
        if not (pa.types.is_float32(values.type) or pa.types.is_float64(values.type)):
            values = values.cast(pa.float64())
        n, angles = len(t), pc.min_max(t["_angle"]).as_py()
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t[c].combine_chunks()) for c in ("id", "_row")]
        block = [t[c].slice(0, 1) for c in keys]
        columns = [pa.array([angles["min"]], pa.float64()), pa.array([angles["max"]], pa.float64()), pa.array([n], pa.int64())]
        return pa.table([*block, *columns, *lists, pa.array([values.to_numpy().tobytes()], pa.binary())], names=[*keys, "lo", "hi", "n", "ids", "rows", "data"])

    rows = df.select("_block.*", "_angle", F.col(id_).alias("id"), F.col("_row") if "_row" in types else F.lit(0).cast("long").alias("_row"), vector)
    made = rows.groupBy(*keys).applyInArrow(pack, f"size int, pivot int, ring long, part long, lo double, hi double, n long, ids array<{types[id_]}>, rows array<long>, data binary")
    return made.select(F.struct(*keys).alias("_block"), "lo", "hi", "n", "ids", "rows", "data")


def _stats(d: DataFrame, side: str) -> DataFrame:
    return d.select(F.col("_block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("lo", "hi", "n")])


def bounds(q: DataFrame, v: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(q, v, least): for each pair of blocks of one length, the least angle that two of their vectors can have."""
    spark = q.sparkSession
    angles = [(int(size), i, j, float(x)) for size, p in pivots.items() for i, row in enumerate(np.arccos(np.clip(p @ p.T, -1, 1))) for j, x in enumerate(row)]
    between = spark.createDataFrame(angles, "size int, i int, j int, apart double")
    pairs = _stats(q, "q").join(_stats(v, "v"), F.col("q.size") == F.col("v.size"))
    pairs = pairs.join(between, (F.col("q.size") == F.col("size")) & (F.col("q.pivot") == F.col("i")) & (F.col("v.pivot") == F.col("j")), "left")
    apart = F.col("apart")
    least = F.greatest(F.lit(0.0), apart - F.col("hi_q") - F.col("hi_v"), F.col("lo_v") - apart - F.col("hi_q"), F.col("lo_q") - apart - F.col("hi_v"))
    return pairs.select("q", "v", "n_q", "n_v", F.coalesce(F.when(apart.isNotNull(), least), F.lit(0.0)).alias("least"))


def _numbers(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_numpy(zero_copy_only=False)


def _rows(data: bytes, n: int, size: int) -> np.ndarray:
    """The vectors of a block, of length 1."""
    m = np.frombuffer(data, np.float32 if len(data) == 4 * n * size else np.float64).reshape(n, size).astype(float)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


class _Best:
    """The k best so far of each query of a block."""

    def __init__(self, ids: pa.Array, k: int, floor: float):
        self.query, self.mine, self.k, self.floor = ids, _numbers(ids), k, floor
        self.similarity = np.full((len(ids), k), -np.inf)
        self.row = np.zeros((len(ids), k), dtype=np.int64)
        self.id = None

    def take(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.id is None:
            self.id = np.zeros(self.row.shape, dtype=ids.dtype)
        elif self.id.dtype != ids.dtype:
            self.id = self.id.astype(object)
        for x in range(0, len(a), ROWS):
            for y in range(0, len(b), COLUMNS):
                cosine = a[x : x + ROWS] @ b[y : y + COLUMNS].T
                least = np.maximum(self.similarity[x : x + ROWS, -1], self.floor) - 1e-11
                hit = np.flatnonzero(cosine >= least[:, None])
                if len(hit):
                    at, of = np.divmod(hit, cosine.shape[1])
                    # Equal vectors tie, whatever the order of summing.
                    self._merge(at + x, np.round(cosine.ravel()[hit], 12), ids[of + y], rows[of + y])

    def _merge(self, at: np.ndarray, similarity: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        last = self.similarity[at, -1]
        ok = (similarity >= np.maximum(last, self.floor)) & ((ids != self.mine[at]) | pd.isna(ids))
        if self.id.dtype != object:
            ok &= (similarity > last) | (ids <= self.id[at, -1])
        at, similarity, ids, rows = at[ok], similarity[ok], ids[ok], rows[ok]
        touched = np.unique(at)
        old = self.similarity[touched].ravel()
        kept = old > -np.inf
        at = np.concatenate([np.repeat(touched, self.k)[kept], at])
        similarity = np.concatenate([old[kept], similarity])
        ids = np.concatenate([self.id[touched].ravel()[kept], ids])
        rows = np.concatenate([self.row[touched].ravel()[kept], rows])
        order = ids
        if ids.dtype == object:  # by value, NULL last
            order = pd.factorize(ids, sort=True)[0]
            order[order < 0] = len(ids)
        sort = np.lexsort((rows, order, -similarity, at))
        at = at[sort]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        sort, at, rank = sort[rank < self.k], at[rank < self.k], rank[rank < self.k]
        self.similarity[at, rank], self.id[at, rank], self.row[at, rank] = similarity[sort], ids[sort], rows[sort]

    def found(self, kind: pa.DataType) -> pa.RecordBatch:
        at, rank = np.nonzero(self.similarity > -np.inf)
        columns = [self.query.take(pa.array(at)), pa.array(self.id[at, rank], kind), pa.array(self.row[at, rank]), pa.array(self.similarity[at, rank])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "_row", "similarity"])


def _score(q: DataFrame, v: DataFrame, pairs: DataFrame, k: int, floor: float) -> DataFrame:
    """The best k of each query in the given pairs of blocks (columns of q and v, those of q with the prefix q_), for each task."""

    def run(batches):
        best, last, kind = {}, None, None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                key, size, q_ids, q_data, ids, rows, data = (batch.column(c)[i] for c in range(7))
                key, size = key.as_py(), size.as_py()
                if key != last:
                    last, mine = key, _rows(q_data.as_buffer(), len(q_ids), size)
                    if key not in best:
                        best[key] = _Best(q_ids.values, k, floor)
                    state = best[key]
                state.take(mine, _rows(data.as_buffer(), len(ids), size), _numbers(ids.values), rows.values.to_numpy())
        for state in best.values():
            yield state.found(kind)

    kinds = [dict(d.dtypes)["ids"][len("array<") : -1] for d in (q, v)]
    columns = [F.to_json("q_block").alias("q"), F.col("_block.size").alias("size"), "q_ids", "q_data", "ids", "rows", "data"]
    return pairs.select(*columns).mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, _row long, similarity double")


def _streamed(q: DataFrame, v: DataFrame, on: Column, parts: int, k: int, floor: float) -> DataFrame:
    """Scores of the pairs that ``on`` holds for: each of ``parts`` tasks, or more, has its queries and reads all vectors, or a part of them."""
    mine = q.repartitionByRange(parts, "q_block")  # the right side is held, the left one streamed
    pairs = v.coalesce(-(-TASKS // parts)).hint("shuffle_replicate_nl").join(mine, on)
    return _score(q.withColumnRenamed("q_ids", "ids"), v, pairs, k, floor)


def _mine(q: DataFrame) -> DataFrame:
    return q.select(F.col("_block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))


def _hashed(df: DataFrame, id_: str, n: int) -> DataFrame:
    """Blocks by hash alone, as one ring."""
    part = F.pmod(F.xxhash64(id_), F.lit(n).cast("long"))
    return df.withColumn("_block", F.struct(F.col("_size").alias("size"), F.col("_pivot").alias("pivot"), F.lit(0).cast("long").alias("ring"), part.alias("part")))


def plan(queries: DataFrame, vectors: DataFrame, k: int, floor: float, block: int, pivots: int = PIVOTS) -> dict:
    """The index and what it leaves to do: assigned vectors, blocks of both sides, first results, and the pairs still to be scored."""
    found = pivots_of(vectors, pivots)
    v = stage(blocked(assigned(vectors, "embedding", found), "vec_id", block).withColumn("_row", F.monotonically_increasing_id()))
    theirs = stage(packed(v, "vec_id", "embedding"))
    mine = stage(packed(blocked(assigned(queries.select("query_id", "query"), "query", found), "query_id", block), "query_id", "query"))
    every = stage(bounds(mine, theirs, found).filter(F.col("least") <= math.acos(max(-1.0, min(1.0, floor))) + SLACK))
    nearest = every.groupBy("q").agg(F.min_by("v", F.struct("least", "v")).alias("v"))
    near = theirs.join(nearest, F.col("_block") == F.col("v")).join(_mine(mine), F.col("q") == F.col("q_block"))
    first = stage(_score(mine, theirs, near, k, floor))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("kth"))
    asked = mine.select(F.col("_block").alias("q"), F.explode("ids").alias("query_id"))
    reached = asked.join(kth, "query_id", "left").groupBy("q").agg(F.min(F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(floor))).alias("reached"))
    rest = every.join(nearest, ["q", "v"], "left_anti").join(reached, "q")
    rest = stage(rest.filter(F.col("least") <= F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "reached"))) + SLACK).select("q", "v", "n_q", "n_v"))
    return {"v": v, "mine": mine, "theirs": theirs, "first": first, "rest": rest, "every": every}


def similar_topk(queries: DataFrame, vectors: DataFrame, k: int, floor: float, block: int = BLOCK, pivots: int = PIVOTS, direct: int = DIRECT) -> DataFrame:
    """Exact top-k by cosine at or above ``floor``; vectors of another length never match."""
    n_q, n_v = (max(1, -(-d.count() // block)) for d in (queries, vectors))
    if n_q * n_v <= direct:
        v = stage(_hashed(assigned(vectors, "embedding", {}), "vec_id", n_v).withColumn("_row", F.monotonically_increasing_id()))
        mine = packed(_hashed(assigned(queries.select("query_id", "query"), "query", {}), "query_id", n_q), "query_id", "query")
        found = _streamed(_mine(mine), packed(v, "vec_id", "embedding"), F.col("_block.size") == F.col("q_block.size"), n_q, k, floor)
    else:
        made = plan(queries, vectors, k, floor, block, pivots)
        v, wanted = made["v"], made["rest"].groupBy("q").agg(F.collect_list("v").alias("wanted"))
        mine = _mine(made["mine"]).join(wanted, F.col("q_block") == F.col("q"))
        found = made["first"].unionByName(_streamed(mine, made["theirs"], F.array_contains("wanted", F.col("_block")), n_q, k, floor))
    others = [c for c in vectors.columns if c != "vec_id"]
    return _ranked(found, k).join(v.select("_row", *others), "_row").select(*vectors.columns, "query_id", "similarity")


def similar_with_outcome(queries: DataFrame, vectors: DataFrame, k: int, floor: float, has_outcome: Column) -> DataFrame:
    """The first k with an outcome among the 2k most similar."""
    return _ranked(similar_topk(queries, vectors, 2 * k, floor).filter(has_outcome), k)
