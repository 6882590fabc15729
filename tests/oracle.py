"""Compare a Spark result with DuckDB's on the same Parquet tables."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def assert_same(frame, sql, con):
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    want = con.sql(sql)
    assert got == canonical(want.columns, want.fetchall())
