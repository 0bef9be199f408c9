"""Run registered queries against their SQL: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), "" if v is None else v) for v in row)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same rows, with equal column names, types of values and values."""
    columns = sorted(spark_df.columns)
    ours = [tuple(r) for r in spark_df.select(*columns).collect()]
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    place = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in place) for r in made.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(sorted(ours, key=_key), sorted(theirs, key=_key)):
        for a, b in zip(mine, other):
            close = isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12)
            if type(a) is not type(b) or not (a == b or close):
                return f"{mine} against {other}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from fairstream.plans.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in oracles or sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), con, oracles[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
