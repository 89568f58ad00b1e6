"""Runs registered queries next to their SQL and compares them: python tests/compare.py [dir] [name...]."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x.isoformat() if hasattr(x, "isoformat") else x

    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), (got[-1:], want[-1:]))
        return f"{len(got)} and {len(want)} rows, first difference {first!r:.400}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from conftest import make_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(where)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        try:
            said = difference(queries[name](spark, where), con, sql[name]) or "equal" if name in sql else f"{queries[name](spark, where).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001  a report of all queries
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, said, flush=True)
