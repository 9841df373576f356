"""Run registered queries beside their oracles and compare the rows.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v).__name__ in ("int", "float", "bool") and float(v) or v), str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, con, query, oracle: str | None, sf: str) -> tuple[bool, str]:
    df = query(spark, sf)
    cols = sorted(df.columns)
    t = time.time()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t
    if oracle is None:
        return True, f"rows {len(got)} (no oracle) {took:.1f}s"
    t = time.time()
    res = con.execute(oracle)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in res.fetchall()]
    duck = time.time() - t
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    for g, w in zip(got, want):
        if not all(_same(a, b) for a, b in zip(g, w)):
            return False, f"first difference\n   spark {g}\n   duck  {w}"
        if not all(type(a) is type(b) for a, b in zip(g, w)):
            return False, f"types differ {g} {w}"
    return True, f"rows {len(got)} spark {took:.1f}s duck {duck:.1f}s"


def main() -> int:
    import __spark_entry__ as entry

    from codeloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, note = compare(spark, con, queries[name], oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001 - a report line per query
            ok, note = False, f"{type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
