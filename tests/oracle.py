"""Compare a Spark result with DuckDB SQL over the same tables, whatever the order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(df, sql, sf):
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=repr)
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(([r[names.index(c)] for c in cols] for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
