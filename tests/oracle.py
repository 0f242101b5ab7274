"""Spark results held against DuckDB's on the same Parquet files."""

import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(spark, folder, query, sql):
    made = query(spark, folder)
    got = made.collect()
    found = connection(folder).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows_of(made.columns, got) == rows_of(columns, found.fetchall())
