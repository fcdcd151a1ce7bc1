"""Side-by-side runs of a query and its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows) -> list[tuple]:
    return sorted((tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows))


def differences(spark, sf_dir: str, build, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    made = build(spark, sf_dir)
    names = sorted(made.columns)
    got = plain(made.select(*(f"`{n}`" for n in names)).collect())
    cursor = connect(sf_dir).execute(f"SELECT * FROM ({sql})")
    theirs = [d[0] for d in cursor.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    want = plain([tuple(r[i] for i in order) for r in cursor.fetchall()])
    if got == want:
        return ""
    only, lack = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only here {only}; only there {lack}"
