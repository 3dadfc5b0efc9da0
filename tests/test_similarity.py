"""The metric index against all pairs: same results, fewer products."""

import pathlib

import numpy as np
import pytest

from barflow.operators import similarity as V


def _rows(spread, n, dims=24, groups=30, seed=1):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, dims))
    m = centres[g.integers(groups, size=n)] + spread * g.normal(size=(n, dims))
    return [(i, [float(x) for x in row], i % 5) for i, row in enumerate(m)]


def _frames(spark, rows, asked):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    return v.filter(asked).selectExpr("vec_id AS query_id", "embedding AS query"), v


def _brute(queries, rows, k, floor):
    valid = [(i, np.array(m, float)) for i, m, _ in rows if m and all(x is not None for x in m) and np.isfinite(m).all() and np.linalg.norm(m) > 0]
    units = {i: m / np.linalg.norm(m) for i, m in valid}
    out = set()
    for q in queries:
        if q in units:
            mine = units[q]
            hits = [(-float(mine @ u), i) for i, u in units.items() if i != q and len(u) == len(mine) and mine @ u >= floor]
            out |= {(q, i, round(-s, 9)) for s, i in sorted((round(s, 12), i) for s, i in hits)[:k]}
    return out


def _got(df):
    return {(r.query_id, r.vec_id, round(r.similarity, 9)) for r in df.collect()}


@pytest.mark.parametrize("spread,floor", [(0.05, 0.1), (0.4, 0.5), (2.0, -1.0)])
def test_index_equals_all_pairs(spark, spread, floor):
    rows = _rows(spread, 900)
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [1.0, None] * 12, 0), (2004, [1.0, 2.0], 0), (2005, [2.0, 4.1], 0), (2006, [float("nan")] * 24, 0)]
    rows += [(3000 + i, rows[7][1], 0) for i in range(60)]  # many equal vectors: ties, and a cell beyond a block
    q, v = _frames(spark, rows, "vec_id % 3 = 0 OR vec_id >= 2000")
    asked = [i for i, _, _ in rows if i % 3 == 0 or i >= 2000]
    got = V.similar_topk(q, v, 4, floor, block=25, pivots=16, direct=0)
    assert _got(got) == _brute(asked, rows, 4, floor)
    assert set(got.columns) == {"vec_id", "embedding", "label", "query_id", "similarity"}


def test_blocks_are_bounded_and_most_pairs_are_left_out(spark):
    """Clustered contexts: rings hold what they should, and products are a small part of all pairs."""
    rows = _rows(0.05, 1500, groups=12)
    q, v = _frames(spark, rows, "true")
    made = V.plan(q, v, 3, 0.1, 50, 60)
    sizes = [r["count"] for r in made["v"].groupBy("_block").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 3 * 50
    scored = made["rest"].selectExpr("sum(n_q * n_v)").first()[0] or 0
    assert scored < 0.2 * 1500 * 1500
    copies = made["rest"].selectExpr("sum(n_v)").first()[0] or 0
    assert copies < 0.2 * 1500 * len(sizes)
    few = V.similar_topk(q, v, 3, 0.1, 50, 60, direct=0)
    assert _got(few) == _brute([i for i, _, _ in rows], rows, 3, 0.1)


def test_empty_sides(spark):
    q, v = _frames(spark, _rows(0.1, 20), "vec_id < 5")
    for a, b in ((q.limit(0), v), (q, v.limit(0)), (q.limit(0), v.limit(0))):
        for direct in (0, 64):
            assert V.similar_topk(a, b, 2, 0.0, direct=direct).collect() == []


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffle_grows_with_the_vectors(spark):
    """Vectors without clusters, so that no pair of blocks is left out: four times the vectors, not sixteen times the bytes."""
    written = []
    for n in (400, 1600):
        rows = _rows(5.0, n)
        q, v = _frames(spark, rows, "true")
        before = set(_shuffle_files(spark))
        got = V.similar_topk(q, v, 3, -1.0, block=20, pivots=8, direct=0)
        assert _got(got) == _brute([i for i, _, _ in rows], rows, 3, -1.0)
        written.append(sum(size for f, size in _shuffle_files(spark).items() if f not in before))
    assert written[1] < 6 * written[0]


@pytest.mark.parametrize("direct", [0, 64])
def test_repeated_and_missing_ids(spark, direct):
    """Rows that share an id do not match each other and keep their own columns; rows without one match."""
    rows = [(1, [1.0, 0.0], 10), (1, [0.0, 1.0], 11), (2, [1.0, 0.1], 20), (2, [0.1, 1.0], 21), (None, [1.0, 0.0], 30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.filter("label IN (10, 21)").selectExpr("vec_id AS query_id", "embedding AS query")
    got = V.similar_topk(q, v, 2, 0.5, block=2, pivots=2, direct=direct)
    assert {(r.query_id, r.vec_id, r.label) for r in got.collect()} == {(1, None, 30), (1, 2, 20), (2, 1, 11)}
