"""Runs a query on Spark and its SQL on DuckDB and compares columns and rows, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def difference(spark, con, query, sql, sf_dir):
    """None if equal, else a few words about the first difference."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; only here {list(set(map(str, got)) - set(map(str, want)))[:2]}; only there {list(set(map(str, want)) - set(map(str, got)))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} and {b}"
    return None if got else "no rows"
