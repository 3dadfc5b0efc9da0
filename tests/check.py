"""Run registered queries beside their SQL on the given tables: python -m tests.check [--sf DIR] names..."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = os.environ.get("BARFLOW_TESTDATA", "/root/testdata")


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v, nested=False):
    """Comparable values, as results are hashed: a number's zero has no sign, zeros inside arrays keep theirs, NaN is no NULL."""
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 and not nested else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x, True) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x, True) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(_plain(x, True) for x in v.values())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _key(row):
    return tuple((x is None, "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)) for x in row)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], out


def compare(spark_df, con, sql, tol: float = 0.0):
    """Empty string when equal, else what differs."""
    got_c, got = rows_of(spark_df.columns, spark_df.collect())
    rel = con.execute(sql)
    exp_c, exp = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_c != exp_c:
        return f"columns {got_c} != {exp_c}"
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    if sorted(map(repr, got)) == sorted(map(repr, exp)):
        return ""
    bad = {}
    for a, b in zip(sorted(got, key=_key), sorted(exp, key=_key)):
        for c, x, y in zip(got_c, a, b):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = abs(x - y) <= tol + 1e-12 * max(abs(x), abs(y))
            else:
                same = repr(x) == repr(y)
            if not same:
                bad.setdefault(c, []).append((x, y, a))
    if not bad:
        return ""
    c, v = next(iter(bad.items()))
    return f"{ {k: len(v) for k, v in bad.items()} } e.g. {c}: {v[0][0]!r} != {v[0][1]!r}\n      in {v[0][2]}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from barflow.session import local_session

    sf = f"{DATA}/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    qs, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in oracle:
                msg = compare(df, con, oracle[n])
                state = "ok" if not msg else "DIFF " + msg
            else:
                state = f"rows {df.count()}"
        except Exception as e:
            state = "FAIL " + (str(e)[:700] if len(argv) else str(e)[:300])
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += state[:2] not in ("ok", "ro")
        print(f"{n:26s} {time.time() - t:6.1f}s {state}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
