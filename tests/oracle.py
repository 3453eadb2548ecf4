"""Hold a query against its SQL on DuckDB."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    connection = duckdb.connect()
    for f in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    found = connection.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    mine, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (sorted(names), a, b)
    return len(mine)
