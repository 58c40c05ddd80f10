"""Side-by-side comparison of a query with its SQL."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows_of(names, rows):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
