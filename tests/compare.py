"""Runs a query and its SQL on the same tables and compares rows as sets of values."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v)


def differences(spark_df, con, sql):
    names = sorted(spark_df.columns)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {sorted(set(columns) ^ set(names))}"
    order = [columns.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
    return f"{len(got)} and {len(want)} rows; {names}\n  only Spark {len(a)}: {a[:2]}\n  only SQL {len(b)}: {b[:2]}"
