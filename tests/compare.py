"""Run registered queries against their SQL in DuckDB: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str, build, sql: str) -> str | None:
    """What is different between the two engines, or None."""
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)}/{len(want)} rows; only here {list(a - b)[:3]}; only there {list(b - a)[:3]}"
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if t != kinds[c]}
    return f"types {odd}" if odd else None


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con, bad = make_session(), connect(folder), 0
    sqls = entry.oracle_sql()
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = difference(spark, con, folder, name, build, sqls[name])
            else:
                diff = None if build(spark, folder).count() else "no rows"
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
